"""Problem 3: broken pairs of a request and its answer.

Each attempt of a log is put together with its answer.  Openings of answers are reduced to forms and clustered by MinHash with
verified similarity, connected through all bands.  A cluster that recurs across unrelated requests is a template; where plain
prose often came instead of the object that was asked for, the template is a refusal.  What refusals say is learnt from the
templates alone: runs of two and three words count by the requests under which they recur, and openings of their own that speak
like them are refusals too.  Copies, other languages, nothing at all and answers that stop early are told by checks on the pair.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lintlake.llm import endings
from lintlake.llm.env import reliable

#: Words of a shingle and similarity of openings that are one template; bands and rows of the MinHash.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
#: Words of an opening.
OPENING = 30
#: Parts of an answer's words that the request holds, and of the request's words that the answer holds, in a copy.
COPIED = (0.85, 0.5)

_ENTRY = re.compile(r"\n\n(?=\[\d{4}-)")
_HEAD = re.compile(r"\[[^\]\n]*\] ?")
_REQUEST = re.compile(r"Request:\n?([\s\S]*)")
_DONE = re.compile(r"Attempt (\d+) (succeeded|failed)\b")
_STARTED = re.compile(r"Attempt (\d+) started")
_RAW = re.compile(r"\nRaw model response:(?:\n|$)")
_FENCE = re.compile(r"^\s*```[\w-]*[ \t]*\n?|\n?[ \t]*```\s*$")
_BLANK = re.compile(
    r"""^[\s\W_]*(?:<\w+>|null|none|nil|n\s*/?\s*a|tbd|todo|tba|string|str|text|summary|placeholder|undefined|nan|empty|blank|unknown|pending|xxx+|lorem ipsum.{0,40}
    |no (?:summary|answer|response|content|output|comment)|not (?:available|applicable|provided|specified)|your (?:summary|answer)(?: here)?|insert (?:summary|answer)(?: here)?|the summary|keine(?: angabe)?|ninguno|ninguna|leer|vac[ií]o|无|暂无|空|待定|略)?[\s\W_]*$""",
    re.I | re.X,
)
#: Distinct requests under which an opening is a template; shares of plain prose among its answers from which it is a refusal, and
#: below which it is sound.
RECURS, REFUSES, SOUND = 3, 0.3, 0.1
#: Counters of runs of words, passes over the openings, and the mean weight of the runs from which an opening is a refusal.
RUNS, PASSES, SPEAKS = 1 << 20, 3, 0.8
#: Common words that tell a language (fixed values).
_STOPWORDS = {
    "en": "the of and is in to that with was are not for be has have by an this it its on at as but which from were been can may should does do more than only before after every you your please where what how no",
    "de": "der die das und ist nicht ein eine einen dem den des mit von zu auf für wird werden im bei auch sich oder als nach aus vor dass wurde wurden sind hat kann noch nur über durch keine kein bitte welche wie siehst du es werden soll höchstens antworte melde beschreibe",
    "es": "el la los las de del y es no una un en que qué por con para se su al lo como cómo más pero está sin sobre este esta son fue hay ningún todo desde cada ves busca responde explica habría informa máximo defectos problemas",
    "fr": "le la les des et est pas un une dans que qui pour avec sur au aux du ce cette sont ne se plus par ou il elle mais sans été être vous quels comment",
    "it": "il lo gli le di e è non un una che per con del della sono nel nella si più ma come anche da dei alla questo questa quali",
    "pt": "o os as de e é não um uma em que por com para do da dos das no na se mais mas como foi são ao sem este esta quais",
}
#: Letters and signs that speak for languages (fixed values).
_SIGNS = {"¿": "es", "¡": "es", "ñ": "es", "ß": "de", "ä": "de", "ö": "de", "ü": "de", "ã": "pt", "õ": "pt", "œ": "fr", "ê": "fr", "è": "fr"}
_SIGN = re.compile(f"[{''.join(_SIGNS)}]")
_SCRIPTS, _LETTER = re.compile("[぀-ヿ가-힣㐀-鿿Ѐ-ӿ؀-ۿͰ-Ͽ]"), re.compile(r"[^\W\d_]")
_JSON = json.JSONDecoder(strict=False)
_BY_WORD: dict[str, list[str]] = {}
for _lang, _list in _STOPWORDS.items():
    for _w in _list.split():
        _BY_WORD.setdefault(_w, []).append(_lang)
_QUOTED = re.compile(r"`[^`]*`|\"[^\"]*\"|“[^”]*”|«[^»]*»|「[^」]*」|'[^'\n]{0,3}[一-鿿][^'\n]*'|\S*[_/\\]\S*|\S+\.\w{1,4}\b")
_LABEL = re.compile(r"^\s*[\"'“]?(?:(?:you\s+(?:asked|wrote|said)|request|summary|question|prompt|task|answer|re|anfrage|frage|solicitud|pregunta|petici[óo]n|请求|问题|摘要)\s*[:：]\s*)+", re.I)


def attempts(log: str) -> list[tuple[int, str, str, str | None]]:
    """(number, request, outcome, raw response) of each attempt that ended."""
    out, request = [], ""
    for entry in _ENTRY.split(log):
        body = _HEAD.sub("", entry, count=1)
        if m := _REQUEST.match(body):
            request = m[1].strip()
        elif m := _DONE.match(body):
            raw = _RAW.split(body, 1)
            out.append((int(m[1]), request, m[2], raw[1] if len(raw) > 1 else None))
        elif _STARTED.match(body):
            request = ""
    return out


def language(text: str) -> str | None:
    """The language of the prose, or None where there is too little of it."""
    whole = _language(text)
    if whole is None:  # a sentence about a quoted comment counts for less than the rest
        return _language(" ".join(x for x in re.split(r"(?<=[.!?。])\s+", text) if not re.search(r"[\"“”«»]", x)))
    return whole


def _language(text: str) -> str | None:
    t = _QUOTED.sub(" ", text)
    other = _SCRIPTS.search(t)
    letters = len(_LETTER.findall(t)) if other else 0
    for name, pattern in () if not other else (("ja", "[぀-ヿ]"), ("ko", "[가-힣]"), ("zh", "[㐀-鿿]"), ("ru", "[Ѐ-ӿ]"), ("ar", "[؀-ۿ]"), ("el", "[Ͱ-Ͽ]")):
        n = len(re.findall(pattern, t))
        if n >= 4 and n > 0.2 * letters:
            return name
    votes: Counter = Counter()
    words = re.findall(r"[^\W\d_]+", t.lower())
    for w in words:
        for lang in _BY_WORD.get(w, ()):
            votes[lang] += 1 / len(_BY_WORD[w])
    for c in _SIGN.findall(text.lower()):
        votes[_SIGNS[c]] += 0.5
    if not votes:
        return None
    (first, n), *rest = votes.most_common(2)
    return first if n >= 2 and (not rest or n >= 1.3 * rest[0][1]) else None


def _bag(text: str) -> Counter:
    return Counter(re.findall(r"[㐀-鿿]|[^\W\d_㐀-鿿]+|\d+", text.lower()))


def copied(request: str, answer: str) -> bool:
    a, r = _bag(_LABEL.sub("", answer)), _bag(request)
    na, nr = sum(a.values()), sum(r.values())
    both = sum((a & r).values())
    return na >= 5 and both >= COPIED[0] * na and both >= COPIED[1] * nr


def unwrap(raw: str) -> tuple[str, object, bool]:
    """The prose of a raw response, its object if there is one, and whether an object or a fence is left open."""
    text = raw.strip()
    fenced = text.startswith("```")
    text = _FENCE.sub("", text).strip() if fenced else text
    at = min([i for i in (text.find("{"), text.find("[") if text.startswith("[") else -1) if i >= 0], default=-1)
    head = text[:at].strip() if at >= 0 else ""
    if at < 0 or at > 0 and not head.endswith(":") and not head.startswith("```") and len(head) > 60:
        return text, None, False
    body = text[at:]
    try:
        return text, _JSON.raw_decode(body)[0], False
    except ValueError:
        pass
    depth, quoted, skip = 0, False, False
    for i, c in enumerate(body):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return text, None, False
    return text, None, True


def check(request: str, summary: str | None, findings: int, raw: str | None) -> tuple[str | None, str, bool]:
    """(defect as far as the pair alone tells, prose, whether the prose still has to be looked at for its end)."""
    if raw is not None:
        findings = 0
        prose, value, open_ = unwrap(raw)
        if open_:
            return "truncated", prose, False
        if isinstance(value, dict):
            summary = value.get("summary")
            summary = summary if isinstance(summary, str) else "" if summary is None else json.dumps(summary)
            found = value.get("findings", value.get("finding"))
            findings = len(found) if isinstance(found, list) else int(bool(found))
            if not any(k in value for k in ("summary", "findings", "finding")) and value:
                summary = " ".join(v for v in value.values() if isinstance(v, str)) or "?" + json.dumps(value)
            prose = summary
        elif isinstance(value, list):
            findings, prose = len(value), "" if not value else json.dumps(value)
        elif prose.startswith('"') and prose.endswith('"') and len(prose) > 1:
            prose = prose[1:-1]
    else:
        prose = summary or ""
    bare = prose.strip().strip("\"'“”")
    if _BLANK.match(bare):
        return ("empty" if not findings else None), prose, False
    if copied(request, bare):
        return "copied", prose, False
    asked, given = language(request), language(bare)
    if asked and given and asked != given:
        return "language", prose, False
    return None, prose, True


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for task, log in zip(b.column("id").to_pylist(), b.column("model_log").to_pylist(), strict=True):
            for n, request, outcome, raw in attempts(log):
                if outcome == "succeeded" or raw is not None:
                    rows.append((task, n, request, raw if outcome == "failed" else None, outcome == "succeeded"))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()), strict=True)], ["task_id", "attempt", "request", "raw", "succeeded"])


def _opening(prose: str) -> str:
    return " ".join(endings.words(endings.form(prose))[:OPENING])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["task_id", "attempt", "defect", "opening", "bare", "found", "prose", "request", "said", "tail"]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string())
    for b in batches:
        rows = []
        for task, n, request, raw, summary, findings in zip(*(b.column(c).to_pylist() for c in ("task_id", "attempt", "request", "raw", "summary", "findings")), strict=True):
            defect, prose, rest = check(request or "", summary, findings or 0, raw)
            said = endings.plain(prose) if rest else None
            tail = endings.last_sentence(prose) if rest and said is None else None
            looked = rest or defect == "language"
            bare = bool(looked and raw is not None and unwrap(raw)[1] is None)
            rows.append((task, n, defect, _opening(prose) if looked else None, bare, bool(raw is None and findings), prose if rest else None, _hash(request or ""), said, tail))
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(endings.form(text)) - (1 << 63)


_SEEDS = np.random.default_rng(77).integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def shingles(opening: str) -> set[str]:
    ws = opening.split()
    return {" ".join(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))}


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        who, band = [], []
        for o in b.column("opening").to_pylist():
            h = np.asarray([xxhash.xxh64_intdigest(s) for s in shingles(o)], np.uint64)
            low = (h[:, None] * _SEEDS[None, :]).min(axis=0).reshape(BANDS, ROWS)
            for k in range(BANDS):
                who.append(o)
                band.append(xxhash.xxh64_intdigest(low[k].tobytes(), seed=k) - (1 << 63))
        yield pa.record_batch({"opening": pa.array(who, pa.string()), "band": pa.array(band, pa.int64())})


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by band and opening: each opening with the first in its bucket that it is similar to and that led others or none."""
    band, leaders = None, []
    for b in batches:
        who, lead = [], []
        for o, k in zip(b.column("opening").to_pylist(), b.column("band").to_pylist(), strict=True):
            if k != band:
                band, leaders = k, []
            s = shingles(o)
            met = next((x for x, t in leaders if len(s & t) >= SIMILARITY * len(s | t)), None)
            if met is None:
                leaders.append((o, s))
            elif met != o:
                who.append(o)
                lead.append(met)
        yield pa.record_batch({"opening": pa.array(who, pa.string()), "leader": pa.array(lead, pa.string())})


def _star(links: DataFrame) -> DataFrame:
    """(opening, leader): each opening that has links, except the first of its component, with the first (large and small stars in turn)."""
    before = None
    while True:
        links = reliable(links)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("opening", "leader").cast("decimal(38,0)"))).first()
        if before == now:
            return links
        before = now
        both = links.unionByName(links.select(F.col("leader").alias("opening"), F.col("opening").alias("leader")))
        least = both.groupBy("opening").agg(F.min("leader").alias("low")).withColumn("low", F.least("low", "opening"))
        large = both.join(least, "opening").where("leader > opening").select(F.col("leader").alias("opening"), F.col("low").alias("leader")).distinct()
        low = large.groupBy("opening").agg(F.min("leader").alias("low"))
        small = large.join(low, "opening").select(F.explode(F.array(F.struct("opening", F.col("low").alias("leader")), F.struct(F.col("leader").alias("opening"), F.col("low").alias("leader")))).alias("x"))
        links = small.select("x.*").where("opening <> leader").distinct()


def templates(openings: DataFrame) -> DataFrame:
    """(opening, leader) for distinct openings: the first opening of those it is connected to by verified similarity in MinHash buckets."""
    bands = openings.select("opening").mapInArrow(_bands, "opening string, band long").repartition("band").sortWithinPartitions("band", "opening")
    star = _star(bands.mapInArrow(_links, "opening string, leader string").distinct())
    return openings.select("opening").join(star, "opening", "left").withColumn("leader", F.coalesce("leader", "opening"))


def runs(opening: str) -> np.ndarray:
    """The counters of the different runs of two and three words of an opening."""
    import xxhash

    ws = opening.split()
    return np.asarray(sorted({xxhash.xxh64_intdigest(" ".join(ws[i : i + k])) % RUNS for k in (2, 3) for i in range(len(ws) - k + 1)}), np.int64)


def _speaks(r: np.ndarray, weights: np.ndarray | None) -> bool:
    return weights is not None and len(r) > 0 and float(weights[r].mean()) >= SPEAKS


def _tally(weights):
    """What the openings of a task add to each counter: requests under which refusals and sound answers have the run; -1 counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value if weights is not None else None
        told, sound = np.zeros(RUNS + 1, np.int64), np.zeros(RUNS + 1, np.int64)
        for b in batches:
            for o, refusal, good, n in zip(*(b.column(c).to_pylist() for c in ("opening", "refusal", "sound", "requests")), strict=True):
                r = runs(o)
                if refusal or _speaks(r, w):
                    told[r] += n
                    told[-1] += n
                elif good:
                    sound[r] += n
                    sound[-1] += n
        at = np.flatnonzero((told > 0) | (sound > 0))
        yield pa.record_batch({"run": pa.array(np.where(at == RUNS, -1, at)), "told": pa.array(told[at]), "sound": pa.array(sound[at])})

    return run


def wording(openings: DataFrame) -> np.ndarray:
    """Weights of RUNS runs of words (8 MB whatever the number of openings) from openings(opening, refusal, sound, requests).

    A weight is the log of how much more often a run recurs in refusals than in sound answers.  Each pass also learns from the
    openings that the pass before took for refusals.
    """
    context, weights, sent = openings.sparkSession.sparkContext, np.zeros(RUNS), None
    for _ in range(PASSES):
        rows = openings.mapInArrow(_tally(sent), "run long, told long, sound long").groupBy("run").agg(F.sum("told").alias("told"), F.sum("sound").alias("sound")).toArrow()
        run, told, sound = (np.asarray(rows.column(c), np.int64) for c in ("run", "told", "sound"))
        whole = run < 0
        if sent is not None:
            sent.destroy()
        all_told, all_sound = int(told[whole].sum()), int(sound[whole].sum())
        weights = np.zeros(RUNS)
        if all_told:
            weights[run[~whole]] = np.log((told[~whole] + 0.1) / (all_told + 1)) - np.log((sound[~whole] + 0.1) / (all_sound + 1))
        sent = context.broadcast(weights)
    return weights


def _judged(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            speaks = [bool(refusal) or _speaks(runs(o), weights.value) for o, refusal in zip(b.column("opening").to_pylist(), b.column("refusal").to_pylist(), strict=True)]
            yield pa.record_batch({"opening": b.column("opening").filter(pa.array(speaks, pa.bool_()))})

    return run


def refusals(answers: DataFrame) -> DataFrame:
    """(opening) of all refusals among answers(opening, request, bare, found), one row an answer.

    `bare`: plain prose came where an object was asked for; `found`: the answer has findings.  Where no template recurs under
    RECURS requests nothing is known, and nothing is a refusal.
    """
    forms = reliable(answers.groupBy("opening", "request").agg(F.count("*").alias("n"), F.count_if("bare").alias("bare"), F.count_if("found").alias("found")))
    grouped = reliable(templates(forms.select("opening").distinct()))
    verdict = forms.join(grouped, "opening").groupBy("leader").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare"), F.countDistinct("request").alias("requests")).where(F.col("requests") >= RECURS)
    kinds = verdict.select("leader", (F.col("bare") >= REFUSES * F.col("n")).alias("refusal"), (F.col("bare") < SOUND * F.col("n")).alias("whole"))
    each = forms.groupBy("opening").agg(F.count("*").alias("requests"), F.sum("bare").alias("bare"), F.sum("found").alias("found"))
    of = each.join(grouped, "opening").join(kinds, "leader", "left")
    sound = F.coalesce("whole", F.lit(False)) | (F.col("bare") == 0) & (F.col("found") > 0)
    openings = reliable(of.select("opening", F.coalesce("refusal", F.lit(False)).alias("refusal"), sound.alias("sound"), "requests"))
    weights = answers.sparkSession.sparkContext.broadcast(wording(openings))
    return openings.mapInArrow(_judged(weights), "opening string")


def broken(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """(task_id, attempt, defect) for every attempt with an answer; defect is null where the pair is sound.

    defect is `empty`, `copied`, `refusal`, `language` or `truncated`.  Tasks and reports given twice count once; null ids and
    null logs give no row; a successful attempt without a report is no pair.
    """
    logs = tasks.select("id", "model_log").where("id IS NOT NULL AND model_log IS NOT NULL")
    tried = logs.mapInArrow(_pairs, "task_id string, attempt int, request string, raw string, succeeded boolean").dropDuplicates(["task_id", "attempt"])
    answers = reports.select("task_id", F.coalesce("result_json.summary", "summary").alias("summary"), F.coalesce(F.size("result_json.findings"), F.lit(0)).alias("findings")).dropDuplicates(["task_id"])
    both = tried.join(answers, "task_id", "left").where("NOT succeeded OR findings IS NOT NULL")
    checked = reliable(both.select("task_id", "attempt", "request", "raw", "summary", "findings").mapInArrow(_checked, "task_id string, attempt int, defect string, opening string, bare boolean, found boolean, prose string, request long, said string, tail string"))
    rest = checked.where("opening IS NOT NULL")
    refusal = refusals(rest.select("opening", "request", "bare", "found")).select("opening", F.lit(True).alias("refusal"))
    ref = F.concat_ws("\t", "task_id", F.col("attempt").cast("string"))
    open_ = rest.where("tail IS NOT NULL").select(ref.alias("ref"), F.col("tail").alias("text"))
    counts = endings.judge(open_, endings.learn(checked.where("prose IS NOT NULL").select(F.col("prose").alias("text"))))
    ends = rest.withColumn("ref", ref).join(counts, "ref", "left").join(refusal, "opening", "left")
    cut = F.when(F.col("said").isNotNull(), F.col("said") == "cut").otherwise(F.col("level").isNotNull() & endings.is_cut())
    named = ends.withColumn("defect", F.when(F.col("refusal"), "refusal").when(F.col("defect").isNotNull(), F.col("defect")).when(cut, "truncated"))
    return named.select("task_id", "attempt", "defect").unionByName(checked.where("opening IS NULL").select("task_id", "attempt", "defect"))

