"""Does a text end where its sentence ends?  Learnt from how the sentences of the corpus go on.

Sentences are reduced to forms (code, names and numbers become signs) and counted where they stand.  The beginnings of all
counted forms and their runs of three, two and one words tell how often a beginning goes on, is closed by a stop, or is where a
value ends.  A value without a closing sign is judged by the longest beginning that is known.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Marks that are left behind where a text was cut.
MARK = re.compile(r"(?:\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|[\[(<]\s*(?:truncated|cut|snip(?:ped)?|abgeschnitten|truncado|截断)\b[^\])>]*[\])>]))+\s*$", re.I)
_STOP = ".!?。！？"
_SPLIT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_CODE = re.compile(r"`([^`\n]*)`")
_NAME = re.compile(r"\w*_\w*(?:\(\))?")
_NUMBER = re.compile(r"[^\W_]*\d[\w.]*(?<!\.)")
_TOKEN = re.compile(r"[㐀-鿿぀-ヿ가-힯]|[^\W\d_]+|[^\s]")
_CJK = re.compile(r"[㐀-鿿぀-ヿ]")
#: A word never closes that goes on so often, and so many times as often as it closes.
NEVER = (50, 20)
#: So many values end one word after two words where that is how values end.
LAST = 2
#: Sentences that a task counts before it hands the counts on.
HELD = 50_000


def form(text: str) -> str:
    """Code, names and numbers as signs: Ⓠ a name, Ⓚ code, Ⓝ a number."""
    t = _CODE.sub(lambda m: "Ⓠ" if re.fullmatch(r"[\w.]+(?:\(\))?", m[1]) else "Ⓚ", text)
    return _NUMBER.sub("Ⓝ", _NAME.sub("Ⓠ", t)).lower()


def words(sentence: str) -> list[str]:
    return [x for w in _TOKEN.findall(sentence) for x in (re.findall("[㐀-鿿぀-ヿ]|[^㐀-鿿぀-ヿ]+", w) if _CJK.search(w) else [w])]


def last_sentence(text: str) -> str:
    return _SPLIT.split(text.rstrip())[-1]


def plain(text: str) -> str | None:
    """What can be told from the text alone: `whole`, `cut`, or None."""
    t = text.rstrip()
    if not t:
        return "whole"
    mark = MARK.search(t)
    if mark:
        t = t[: mark.start()].rstrip()
        if not t or re.search("trunc|cut|snip", mark[0], re.I):
            return "cut"
    end = last_sentence(t)
    if end.endswith("�"):
        return "cut"
    if t[-1] in _STOP:
        return "whole"
    if end.count("`") % 2:
        return "cut"
    if t[-1] in ")]}>」』）】" or t[-1] in "\"'”’»" and len(end) > 2:
        return "whole" if end.count("(") <= end.count(")") and end.count("[") <= end.count("]") else "cut"
    if t[-1] in ",;:([{-–—，、；：（":
        return "cut"
    if re.search(r"(?:^|[:：]\s*)\d+(?:\s*[,，、]\s*\d+)*$", end):
        return "whole"
    if re.search(r"`[^`]*[^\w`.][^`]*`$", end):
        return "whole"  # ends in code
    if len(re.findall(r"\(|（", end)) > len(re.findall(r"\)|）", end)) or end.count("[") > end.count("]"):
        return "cut"
    return None


def _key(level: int, *parts: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{level}|" + " ".join(parts)) - (1 << 63)


def _keys(tokens: list[str]) -> list[int]:
    """The two words before the last, whatever follows them; the sentence as a whole, and its last three, two and one words."""
    pad = ["^", "^", *tokens]
    return [_key(5, *pad[-3:-1]), _key(4, *tokens), *(_key(k, *pad[-k:]) for k in (3, 2, 1))]


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        keys = list(held)
        return pa.record_batch({"sentence": pa.array([k[0] for k in keys], pa.string()), "closed": pa.array([k[1] for k in keys], pa.string()), "n": pa.array([held[k] for k in keys], pa.int64())})

    for b in batches:
        for text in b.column("text").to_pylist():
            if not text:
                continue
            parts = _SPLIT.split(form(MARK.sub("", text.rstrip())))
            for i, s in enumerate(parts):
                s = s.strip()
                if s:
                    held[s.rstrip(_STOP), "stop" if s[-1] in _STOP else "end" if i == len(parts) - 1 else "line"] += 1
        if len(held) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


class _Steps:
    """Counts of runs of words in the sentences of a task; beginnings of words are worked out once for each different run."""

    def __init__(self):
        self.whole: Counter = Counter()
        self.runs: Counter = Counter()
        self.stops: Counter = Counter()
        self.ends: Counter = Counter()

    def add(self, ws: list[str], closed: str, n: int) -> None:
        if closed != "end":
            self.whole[_key(4, *ws)] += n
        pad = ["^", "^", *ws]
        for run in zip(pad, pad[1:], pad[2:], strict=False):
            self.runs[run] += n
        (self.ends if closed == "end" else self.stops)[run] += n

    def out(self) -> pa.RecordBatch:
        total: dict[int, list[int]] = {k: [0, n, 0] for k, n in self.whole.items()}
        runs, stops, ends = self.runs, self.stops, self.ends
        for run, n in runs.items():  # values that end one word after these two, and all else that follows
            x = total.setdefault(_key(5, *run[:-1]), [0, 0, 0])
            x[0] += n - ends[run]
            x[2] += ends[run]
        for run, n in stops.items():
            total.setdefault(_key(5, *run[1:]), [0, 0, 0])[0] += n
        for level in (3, 2, 1):
            for run, n in runs.items():
                s, e = stops[run], ends[run]
                x = total.setdefault(_key(level, *run), [0, 0, 0])
                x[0] += n - s - e
                x[1] += s
                x[2] += e
                w = run[-1]
                if n > e:  # the last word of an open value may be cut itself
                    for j in range(1, len(w)):
                        total.setdefault(_key(level, *run[:-1], w[:j]), [0, 0, 0])[0] += n - e
            runs, stops, ends = (_shorter(c) for c in (runs, stops, ends))
        keys = list(total)
        goes, stopped, ended = zip(*total.values(), strict=True) if total else ((), (), ())
        return pa.record_batch({"key": pa.array(keys, pa.int64()), "goes": pa.array(goes, pa.int64()), "stops": pa.array(stopped, pa.int64()), "ends": pa.array(ended, pa.int64())})


def _shorter(runs: Counter) -> Counter:
    out: Counter = Counter()
    for run, n in runs.items():
        out[run[1:]] += n
    return out


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Steps()
    for b in batches:
        for s, closed, n in zip(b.column("sentence").to_pylist(), b.column("closed").to_pylist(), b.column("n").to_pylist(), strict=True):
            if ws := words(s):
                held.add(ws, closed, n)
        if len(held.runs) > HELD or len(held.whole) > HELD:
            yield held.out()
            held = _Steps()
    yield held.out()


def learn(texts: DataFrame) -> DataFrame:
    """(key, goes, stops, ends) from all values of the column `text`: what follows each beginning, anywhere in the corpus."""
    counted = texts.where("text IS NOT NULL").select("text").mapInArrow(_sentences, "sentence string, closed string, n long")
    once = counted.groupBy("sentence", "closed").agg(F.sum("n").alias("n"))
    steps = once.mapInArrow(_steps, "key long, goes long, stops long, ends long")
    return steps.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("goes", "stops", "ends")])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, level, keys, word, own = [], [], [], [], []
        for k, text, copies in zip(b.column("ref").to_pylist(), b.column("text").to_pylist(), b.column("copies").to_pylist(), strict=True):
            ws = words(form(last_sentence(MARK.sub("", text.rstrip()))))
            for n, key in zip((5, 4, 3, 2, 1), _keys(ws), strict=True):
                rows.append(k)
                own.append(copies)
                level.append(n)
                keys.append(key)
                word.append(bool(ws) and ws[-1].isalpha() and ws[-1] not in "ⓆⓃⓀ")
        yield pa.record_batch({"ref": pa.array(rows, pa.string()), "level": pa.array(level, pa.int32()), "key": pa.array(keys, pa.int64()), "word": pa.array(word, pa.bool_()), "own": pa.array(own, pa.int64())})


def judge(values: DataFrame, model: DataFrame) -> DataFrame:
    """(ref, goes, stops, ends, level, never, last) for values(ref, text): the counts of the longest beginning that says something.

    `copies`, where the values have it, tells how often a value was learnt from; its own ends say nothing about it.
    `never`: the last word never closes; `last`: other values mostly end one word after the same two words.
    """
    copies = F.col("copies") if "copies" in values.columns else F.lit(1)
    asked = values.select(F.col("ref").cast("string").alias("ref"), "text", copies.cast("long").alias("copies")).mapInArrow(_asked, "ref string, level int, key long, word boolean, own long")
    known = asked.join(model, "key").withColumn("ends", F.greatest(F.col("ends") - F.col("own"), F.lit(0)))
    said = known.where("goes + stops + ends >= 1")
    never = (F.col("level") == 1) & F.col("word") & (F.col("goes") >= NEVER[0]) & (F.col("goes") > NEVER[1] * (F.col("stops") + F.col("ends")))
    last = (F.col("level") == 5) & (F.col("ends") >= LAST) & (F.col("ends") > F.col("goes"))
    counts = F.when(F.col("level") < 5, F.struct("goes", "stops", "ends", "level"))
    best = said.groupBy("ref").agg(F.max_by(counts, F.when(F.col("level") < 5, F.col("level"))).alias("x"), F.max(never).alias("never"), F.max(last).alias("last"))
    return best.where("x IS NOT NULL").select("ref", "x.*", "never", "last")


def is_cut():
    """Whether the counts speak for a cut: the beginning goes on more often than it closes, or its last word never closes."""
    return F.coalesce("never", F.lit(False)) | (F.col("goes") > 2 * F.col("stops")) & (F.col("goes") > F.col("ends"))


def is_cut_at(limit):
    """The same where `limit` tells whether the value ends at a length that is a limit.

    There it is enough that the beginning goes on as often as it closes.  At other lengths one or two words that are known
    from other sentences only must go on almost always, and not stand where values end.
    """
    goes, stops, ends = F.col("goes"), F.col("stops"), F.col("ends")
    never, last = F.coalesce("never", F.lit(False)), F.coalesce("last", F.lit(False))
    weak = (goes > 0) & (goes >= stops) & (goes >= ends) | never & ~last
    strong = F.when(F.col("level") >= 3, (goes > 2 * stops) & (goes > ends)).otherwise((goes > NEVER[1] * (stops + ends)) & ~last)
    return F.when(limit, weak).otherwise(strong | never & ~last)
