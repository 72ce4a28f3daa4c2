"""Problem 4: values that were cut on their way into the store.

Lengths: of all values of a field and source, the hazard of length L is the share of values that end at L among those that
reach it.  A limit shows as a hazard far above its neighbours'; all lengths are tested together with false-discovery control.
Endings: a value is a case where its ending is incomplete (see endings).  At a significant length weaker evidence is enough,
elsewhere it must be stronger; where nothing is known about its ending, the value counts only at a significant length.  A log that ends in a raw response counts with a mark of the cut, or where the response is
incomplete at a significant length: a response may end early inside a whole log.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lintlake.llm import answers, endings
from lintlake.llm.env import reliable

#: Neighbouring lengths that a hazard is held against, and the rate of false discoveries.
NEIGHBOURS, RATE = 12, 0.01
#: Classes of probabilities, by halves, within which they are ranked.
STEPS = 1_100
_ENTRY = re.compile(r"\n\n(?=\[\d{4}-)")
_STAMP = re.compile(r"^\[[^\]\n]*\] ?", re.M)
_RAW = "\nRaw model response:"


def _log_text(log: str) -> str:
    """The log without time stamps and raw responses."""
    return "\n".join(_STAMP.sub("", e.split(_RAW, 1)[0] if _RAW in e else e) for e in _ENTRY.split(log))


def _log_tail(log: str) -> tuple[str, bool]:
    """The last line, or the whole raw response where the log ends in one, and whether it is one."""
    last = _ENTRY.split(log.rstrip())[-1]
    head, raw, answer = last.partition(_RAW)
    return (answer.strip() if raw else _STAMP.sub("", head).rstrip().split("\n")[-1]), bool(raw)


def _raw_end(answer: str) -> tuple[str | None, str | None]:
    """What a raw response at the end of a log tells: `whole`, `cut` (a mark), `open` (a cut if the length is a limit), or the part to be judged."""
    mark = endings.MARK.search(answer)
    if mark and re.search("trunc|cut|snip|abgeschnitten|截断", mark[0], re.I):
        return "cut", None
    prose, value, open_ = answers.unwrap(answer)
    if open_ or not prose:
        return "open", None
    said = "whole" if value is not None else endings.plain(prose)
    return ("open" if said == "cut" else said), (None if said else endings.last_sentence(prose))


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each value what its text alone tells, and the part to be judged where that is nothing."""
    for b in batches:
        said, part, raws = [], [], []
        for field, text in zip(b.column("field").to_pylist(), b.column("text").to_pylist(), strict=True):
            tail, raw = _log_tail(text) if field == "model_log" else (endings.last_sentence(text), False)
            whole = text if field != "model_log" else tail
            say, tail = _raw_end(tail) if raw else (endings.plain(whole), tail)
            said.append(say)
            part.append(tail if say is None else None)
            raws.append(raw)
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("record_id", "field", "finding_no", "source", "length")], pa.array(said, pa.string()), pa.array(part, pa.string()), pa.array(raws, pa.bool_())], names=["record_id", "field", "finding_no", "source", "length", "said", "tail", "raw"])


def _learn_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch({"text": pa.array([_log_text(t) if f == "model_log" else t for f, t in zip(b.column("field").to_pylist(), b.column("text").to_pylist(), strict=True)], pa.string())})


def values(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """(record_id, field, finding_no, task_id, text): every stored value, null texts left out; rows given twice come twice."""
    logs = tasks.select(F.col("id").alias("record_id"), F.lit("model_log").alias("field"), F.lit(0).alias("finding_no"), F.col("id").alias("task_id"), F.col("model_log").alias("text"))
    each = reports.select(F.col("id").alias("record_id"), "task_id", F.posexplode("result_json.findings").alias("at", "f"))
    both = each.select("record_id", (F.col("at") + 1).alias("finding_no"), "task_id", F.explode(F.array(F.struct(F.lit("description").alias("field"), F.col("f.description").alias("text")), F.struct(F.lit("remediation").alias("field"), F.col("f.remediation").alias("text")))).alias("v"))
    return logs.unionByName(both.select("record_id", "v.field", "finding_no", "task_id", "v.text")).where("record_id IS NOT NULL AND text IS NOT NULL")


def hazards(lengths: DataFrame) -> DataFrame:
    """(field, source, length, n, at_risk, hazard, around, p, significant) from one row (field, source, length) a value.

    The probability is the Chernoff bound of the binomial tail under the neighbours' hazard; significance is by the step-up
    procedure of Benjamini and Hochberg over all lengths of all fields and sources.  Without values there are no rows.
    """
    counts = lengths.groupBy("field", "source", "length").agg(F.count("*").alias("n"))
    group = Window.partitionBy("field", "source").orderBy(F.col("length").desc())
    near = Window.partitionBy("field", "source").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    risk = counts.withColumn("at_risk", F.sum("n").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    around = (F.sum("n").over(near) - F.col("n") + 1) / ((F.sum("at_risk").over(near) - F.col("at_risk")) * (2.0 * NEIGHBOURS / F.greatest(F.count("*").over(near) - 1, F.lit(1))) + 2)
    h = risk.withColumn("hazard", F.col("n") / F.col("at_risk")).withColumn("around", F.least(around, F.lit(0.999)))
    x, q = F.least(F.col("hazard"), F.lit(1 - 1e-9)), F.col("around")
    kl = x * F.log(x / q) + (1 - x) * F.log((1 - x) / (1 - q))
    tested = h.withColumn("p", F.when(x > q, F.exp(-F.col("at_risk") * kl)).otherwise(1.0))
    # the step-up needs ranks over all tests: equal probabilities are counted, ranked within STEPS classes of their size, and the
    # tests of the classes before are added
    steps = tested.groupBy("p").agg(F.count("*").alias("k")).withColumn("class", F.when(F.col("p") > 0, F.least(F.floor(-F.log2("p")), F.lit(STEPS - 1))).otherwise(STEPS - 1).cast("int"))
    before = steps.groupBy("class").agg(F.sum("k").alias("n"))
    before = before.select("class", (F.sum("n").over(Window.orderBy(F.col("class").desc())) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("m"))  # STEPS rows at most
    ranked = steps.join(F.broadcast(before), "class").withColumn("rank", F.col("before") + F.sum("k").over(Window.partitionBy("class").orderBy("p")))
    limit = ranked.where(F.col("p") <= F.lit(RATE) * F.col("rank") / F.col("m")).agg(F.max("p").alias("limit"))
    return tested.crossJoin(F.broadcast(limit)).withColumn("significant", F.coalesce(F.col("p") <= F.col("limit"), F.lit(False))).drop("limit")


def judged(tasks: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each value with `cut`, hazards).  Null values have no row; rows given twice count once."""
    source = tasks.select(F.col("id").alias("task_id"), F.col("model_node_id").alias("source")).dropDuplicates(["task_id"])
    every = values(tasks, reports).join(source, "task_id", "left").withColumn("length", F.length("text"))
    model = endings.learn(values(tasks, reports).select("field", "text").mapInArrow(_learn_texts, "text string"))
    tails = every.select("record_id", "field", "finding_no", "source", "length", "text").mapInArrow(_tails, "record_id string, field string, finding_no int, source string, length int, said string, tail string, raw boolean")
    newest = F.first(F.struct("source", "length", "said", "tail", "raw")).alias("x")
    once = tails.groupBy("record_id", "field", "finding_no").agg(newest, F.count("*").alias("copies"))
    tails = reliable(once.select("record_id", "field", "finding_no", "x.*", "copies"))
    hazard = reliable(hazards(tails.select("field", "source", "length")))
    ref = F.concat_ws("\t", "record_id", "field", F.col("finding_no").cast("string"))
    open_ = tails.where("tail IS NOT NULL").withColumn("ref", ref)
    counts = endings.judge(open_.select("ref", F.col("tail").alias("text"), "copies"), model)
    limits = hazard.where("significant").select("field", "source", "length", F.lit(True).alias("limit"))
    limit = F.coalesce("limit", F.lit(False))
    at = tails.withColumn("ref", ref).join(limits, ["field", "source", "length"], "left")
    said = at.where("tail IS NOT NULL").join(counts, "ref", "left")
    cut = F.when(F.col("level").isNotNull(), endings.is_cut_at(limit) & (limit | ~F.col("raw"))).otherwise(limit)
    closed = at.where("tail IS NULL").withColumn("cut", (F.col("said") == "cut") | (F.col("said") == "open") & limit)
    cols = ["record_id", "field", "finding_no", "source", "length"]
    return closed.select(*cols, "cut").unionByName(said.withColumn("cut", cut).select(*cols, "cut")), hazard


def rates(cases: DataFrame) -> DataFrame:
    """(model_node_id, field, values, cut, share)."""
    out = cases.groupBy(F.col("source").alias("model_node_id"), "field").agg(F.count("*").alias("values"), F.count_if("cut").alias("cut"))
    return out.withColumn("share", F.col("cut") / F.col("values"))
