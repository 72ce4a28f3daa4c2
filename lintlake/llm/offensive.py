"""Problem 8: a counterfactually regularised classifier for abusive, hateful and sexual content.

The labels are of whole documents, the offence is in a sentence: a document scores as its worst sentence, and the model is fitted
in that way (multiple instances).  Words are read through common disguises.  In labelled sentences identity terms are swapped,
and a change of the score is penalised, so that naming a group counts for nothing by itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Labelled documents that the classifier is fitted on at most (a sample by the hash of the id).
LABELLED = 20_000
#: Characters of labelled documents that the classifier is fitted on at most, in the same order; the rest is scored, but not learnt from.
CHARACTERS = 40_000_000
#: Weights of the model.
WEIGHTS = 1 << 18
#: Strengths of the pull to zero and of the counterfactual penalty; steps of each fitting.
RIDGE, SWAP, STEPS = 0.07, 0.5, 80
#: Labelled documents in which a feature has to stand, and words of a span with the step from one to the next.
SEEN, SPAN = 3, (12, 5)
#: Share of labels that are taken to be wrong.
WRONG = 0.05
#: Score from which a document is offending.
THRESHOLD = 0.4
#: Sentences that a task remembers.
REMEMBERED = 200_000

#: Terms for people and groups (fixed values); patterns take those that no list can hold.
IDENTITY = """women woman men man girls boys immigrants immigrant foreigners foreigner refugees migrants muslims muslim jews jewish christians christian
hindus buddhists atheists blacks whites asians africans arabs mexicans germans frenchmen americans chinese indians turks russians gays gay lesbians
trans queer disabled blind deaf old elderly elders seniors pensioners young teenagers folks islanders southerners northerners foreigners veterans
frauen männer ausländer flüchtlinge juden muslime christen mujeres hombres extranjeros inmigrantes musulmanes judíos 女人 男人 外地人 外国人 老人""".split()
_SPLIT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_LEAD = re.compile(r"^\s*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]\s*\w+:\s*|(?:[\w./\\-]+\.\w+:\d+:\s*)|>+\s*|[-*•]\s+|\d+[.)]\s+|#+\s*)+")
_HIDDEN = re.compile("[​-‏‪-‮⁠-⁤﻿­︀-️]")
_CODE = re.compile(r"`[^`\n]*`|\b\w*_\w+\b")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\s.\-_*·|/]{1,2}){2,}[^\W\d_](?![^\W_])")
_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g", "+": "t", "|": "i", "€": "e"})
_MIXED = re.compile(r"(?=[^\s]*[^\W\d_])[^\W_]*(?:[@430157$!+|€][^\W_]*)+(?<![!.,])")
_LEETS = re.compile(r"[@430157$!+|€]")
_STARRED = re.compile(r"\b([^\W\d_]+)([*#_]{1,4})([^\W\d_]*)", re.I)
#: Letters of other scripts that look like Latin ones (fixed values).
_LOOKS = str.maketrans("аеорсухіјѕԁһкмтвнοαρυνικ", "aeopcyxijsdhkmtbhoapuvik")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+|[ⓃⓆ?!]")
_WORDS = re.compile(r"[㐀-鿿]|[^\s㐀-鿿]+")
_STARS = re.compile(r"(?<![^\W_*])(?=[^\s*]*\*)(?=[^\s]*[^\W\d_])[^\W_*]*(?:\*+[^\W_*]*)+")


def sentences(text: str) -> list[str]:
    out = []
    for part in _SPLIT.split(text):
        part = _LEAD.sub("", part).strip()
        if part:
            out.append(part)
    return out


def plain(sentence: str) -> str:
    """The sentence in lower case with disguises undone: hidden marks, spaced letters, digits and signs for letters."""
    t = sentence.lower()
    if not sentence.isascii():
        t = _HIDDEN.sub("", unicodedata.normalize("NFKC", sentence)).lower().replace("ⓠ", "Ⓠ")
    if "`" in t or "_" in t:
        t = _CODE.sub(" Ⓠ ", t)
    if not t.isascii() and re.search("[Ѐ-ӿͰ-Ͽ]", t) and re.search("[a-z]", t):
        t = t.translate(_LOOKS)
    t = _SPACED.sub(lambda m: (lambda j: f"{j} {j[1:]}" if j[0] in "aiyo" and len(j) > 4 else j)(re.sub(r"[^\w]|_", "", m[0])), t)
    if "@" in t:
        t = re.sub(r"(?<!\w)@(\w+)", r"@\1 \1", t)  # a mention or a disguised letter: read both ways
    if _LEETS.search(t):
        t = _MIXED.sub(lambda m: m[0].translate(_LEET) if sum(c.isalpha() for c in m[0]) * 2 >= len(m[0]) - 1 and len(m[0]) > 2 else m[0], t)
    return re.sub(r"([^\W\d_])\1+", r"\1", re.sub(r"\d+", "Ⓝ", t))  # letters drawn out or doubled count once


#: The same terms as they stand in forms.
_NAMES = list(dict.fromkeys(plain(x) for x in IDENTITY))
_CJK = re.compile("[㐀-鿿]")
_GROUP = re.compile(
    r"\b(?:people from \w+|\w+ believers|(?:" + "|".join(sorted((x for x in _NAMES if not _CJK.search(x)), key=len, reverse=True)) + r")|\w{3,}(?:ians|rans|rians|ians|vians|ishmen|ites))\b|"
    + "|".join(sorted((x for x in _NAMES if _CJK.search(x)), key=len, reverse=True))
)


def spans(form: str) -> list[str]:
    """The form in pieces of SPAN[0] words, so that a long sentence does not outweigh an offence within it."""
    if len(form) < 40:
        return [form]
    at = [m.start() for m in _WORDS.finditer(form)]
    if len(at) <= SPAN[0]:
        return [form]
    return [form[at[i] : at[i + SPAN[0]] if i + SPAN[0] < len(at) else len(form)] for i in range(0, len(at) - SPAN[0] + SPAN[1], SPAN[1])]


def features(form: str) -> list[int]:
    """Hashed words, pairs of words and parts of words."""
    import xxhash

    ws = _TOKEN.findall(form)
    out = {f"w{w}" for w in ws} | {f"p{a} {b}" for a, b in zip(ws, ws[1:], strict=False)} | {f"t{a} {b} {c}" for a, b, c in zip(ws, ws[1:], ws[2:], strict=False) if len(a) == len(b) == len(c) == 1}
    for w in ws:
        if len(w) > 4 and w.isalpha():
            padded = f"<{w}>"
            out |= {f"c{padded[i : i + 5]}" for i in range(len(padded) - 4)}
    for m in _STARRED.finditer(form):
        out.add(f"s{m[1]}*{m[3]}")
        out.add("starred")
    return [xxhash.xxh32_intdigest(x) % WEIGHTS for x in out]


class _Matrix:
    def __init__(self, rows: list[list[int]], kept: np.ndarray):
        rows = [[c for c in r if kept[c]] or [0] for r in rows]
        self.start = np.cumsum([0, *[len(r) for r in rows]])[:-1]
        self.cols = np.asarray([c for r in rows for c in r], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.cols], self.start) if len(self.cols) else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=g[self.row], minlength=WEIGHTS)


def swapped(form: str, k: int) -> str | None:
    """The form with its group exchanged for another one."""
    alike = {cjk: [x for x in _NAMES if bool(_CJK.search(x)) == cjk] for cjk in (False, True)}
    out = _GROUP.sub(lambda m: (names := alike[bool(_CJK.search(m[0]))])[(hash_of(m[0]) + k) % len(names)], form)
    return out if out != form else None


def hash_of(x: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(x)


def fit(texts: list[str], labels: list[int]) -> np.ndarray:
    """The weights, the last one the bias.  Documents without a sentence tell nothing."""
    bags: list[list[int]] = []
    index: dict[str, int] = {}
    for t in texts:
        bags.append(sorted({index.setdefault(x, len(index)) for s in sentences(t) for x in spans(plain(s))}))
    y = np.asarray([v for v, b in zip(labels, bags, strict=True) if b], bool)
    bags = [b for b in bags if b]
    forms = list(index)
    if not bags or y.all() or not y.any():
        return np.append(np.zeros(WEIGHTS, np.float32), np.float32(-3.0))
    rows = [features(f) for f in forms]
    seen = np.zeros(WEIGHTS, np.int64)
    for b in bags:
        seen[list({c for i in b for c in rows[i]})] += 1
    kept = seen >= SEEN
    kept[0] = False
    x = _Matrix(rows, kept)
    pairs = [(i, s) for i, f in enumerate(forms) for k in (7, 19) if (s := swapped(f, k))]
    own, other = np.asarray([i for i, _ in pairs], np.int64), _Matrix([features(s) for _, s in pairs], kept) if pairs else None
    size = np.asarray([len(b) for b in bags])
    flat = np.concatenate([np.asarray(b) for b in bags])
    bag = np.repeat(np.arange(len(bags)), size)
    negative = np.bincount(flat[~y[bag]], minlength=len(forms)).astype(float)
    w, b = np.zeros(WEIGHTS), -3.0
    positive = np.bincount(flat[y[bag]], weights=(1 / size)[bag[y[bag]]], minlength=len(forms))
    for _ in range(4):
        w, b = _descend(x, other, own, positive, negative, w, b)
        s = x.scores(w) + b
        # the worst sentence of each positive document, ties included once
        order = np.lexsort((s[flat], bag))
        last = np.cumsum(size) - 1
        worst = flat[order[last]]
        # how far a label is believed depends on what the worst sentence looks like
        p = 1 / (1 + np.exp(-np.clip(s[worst[y]], -30, 30)))
        positive = np.bincount(worst[y], weights=p * (1 - WRONG) / (p * (1 - WRONG) + (1 - p) * WRONG), minlength=len(forms))
    return np.append(w, b).astype(np.float32)


def _descend(x, other, own, positive, negative, w, b):
    total = (positive + negative).sum()
    m, v, mb, vb = np.zeros(WEIGHTS), np.zeros(WEIGHTS), 0.0, 0.0
    for step in range(1, STEPS + 1):
        s = x.scores(w) + b
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        g = (p * (positive + negative) - positive) / total
        if other is not None:
            d = s[own] - other.scores(w) - b
            k = SWAP * d * (positive + negative)[own] / total / 10
            g = g + np.bincount(own, weights=k, minlength=len(g))
        gw = x.back(g) + RIDGE * w / total * 10
        if other is not None:
            gw -= other.back(k)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= 0.1 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    return w, b


def vocabulary(texts: list[str], w: np.ndarray) -> dict[int, list[tuple[str, float]]]:
    """Offending words by length, for words of which letters are starred out."""
    words = {x for t in texts for x in _TOKEN.findall(t.lower())}
    out: dict[int, list[tuple[str, float]]] = {}
    for x in sorted(words):
        v = float(w[hash_of(f"w{plain(x)}") % WEIGHTS])
        if v > 0.5 and len(x) > 2:
            out.setdefault(len(x), []).append((x, v))
    return out


def unstarred(sentence: str, known: dict) -> str:
    """The sentence with starred words filled in where an offending word fits."""
    def fill(m: re.Match) -> str:
        pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in m[0].lower()))
        fits = [(v, x) for x, v in known.get(len(m[0]), ()) if pattern.fullmatch(x)]
        return max(fits)[1] if fits else m[0]

    return _STARS.sub(fill, sentence)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, words), known = model.value, {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                worst = -30.0
                for sentence in sentences(text or ""):
                    form = plain(unstarred(sentence, words) if "*" in sentence else sentence)
                    s = known.get(form)
                    if s is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        s = known[form] = max(float(w[features(x)].sum() + w[-1]) for x in spans(form))
                    worst = max(worst, s)
                out.append(1 / (1 + np.exp(-max(worst, -30.0))) if text else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(out, pa.float64())], names=["doc_id", "source", "score"])

    return run


def labelled(documents: DataFrame, labels: DataFrame, most: int = LABELLED, characters: int = CHARACTERS) -> DataFrame:
    """(doc_id, text, is_abusive) of labelled documents: the annotators' majority, ties and null labels left out.

    The sample is taken in the order of the hashed ids: at most `most` rows, and of these as many as `characters` hold.
    """
    votes = labels.where("doc_id IS NOT NULL AND is_abusive IS NOT NULL").groupBy("doc_id").agg(F.avg("is_abusive").alias("share"))
    sure = votes.where("share <> 0.5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = sure.join(documents.select("doc_id", "text"), "doc_id").where("text IS NOT NULL").dropDuplicates(["doc_id"])
    place = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id")  # of `most` rows at most
    fits = found.withColumn("end", F.sum(F.length("text").cast("long")).over(place)).where(F.col("end") <= characters)
    return fits.select("doc_id", "text", (F.col("share") > 0.5).cast("int").alias("is_abusive"))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score) of every document; null and empty texts score 0, and without labels of both kinds nothing is offending."""
    rows = sorted(labelled(documents, labels).collect())
    texts = [r.text for r in rows]
    weights = fit(texts, [r.is_abusive for r in rows])
    model = documents.sparkSession.sparkContext.broadcast((weights, vocabulary(texts, weights)))
    return documents.select("doc_id", "source", "text").mapInArrow(_score(model), "doc_id long, source string, score double")


def rates(scored: DataFrame) -> DataFrame:
    """(source, documents, offending, share)."""
    out = scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= THRESHOLD).alias("offending"))
    return out.withColumn("share", F.col("offending") / F.col("documents"))
