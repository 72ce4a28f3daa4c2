"""Problem 1: all pairs of texts whose sets of word triples are similar, by pigeonring filtering.

Two sets of a and b triples with a Jaccard similarity of at least t differ in at most D = (1-t)/(1+t)*(a+b) triples.

1.  Boxes.  Ordered by frequency, the first n-ceil(t*n)+c triples of a set are boxes of one triple each; the differences are too
    few to touch more than all but c of them, so similar sets agree in c boxes (pigeonhole), c = CHAIN.  Boxes are what is shuffled; the order puts triples
    of licences and other boilerplate last, and only the count that gives the order is approximate: any order is exact.
2.  Ring.  The triples of a set fall into M segments by hash, arranged in a ring.  Somewhere on the ring a chain of segments must
    start whose first l segments hold at most l*D/M differences, for every l up to M.  A sketch of 128 bytes a set bounds the
    differences of each segment from below; pairs without such a chain are pruned.
3.  What is left is checked by the full Hamming distance of the sets.

Texts with equal sets form one class and take part once; pairs of texts are written out at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lintlake.llm.blocks import blocks, mix, words
from lintlake.llm.env import reliable

SIMILARITY = 0.7
WORDS = 3
#: Counters of the frequency sketch, and segments of the ring with the bits of each.
COUNTERS, SEGMENTS, BITS = 1 << 22, 16, 32
#: Triples of a window of texts in which repeated ones are counted.
WINDOW = 8_000_000
#: Boxes in which two sets have to agree (all of them, if their overlap need not be so large).
CHAIN = 3
#: Sets that may share a box in one place; a box that more sets are expected to share is split into blocks that meet in pairs.
HOT = 200_000
#: Members of a class that are joined at a time when the pairs are written out.
PART = 2_000
#: Words of 64 bits of the filter that tells which sets are needed for the check: its least and its greatest size.
FILTER = (1 << 14, 1 << 22)
#: Pairs that a task looks at together.
CHUNK = 1_000_000
#: Bytes of boxes that one task and one bucket get on average, and bytes of a box.
TASK_BYTES, BUCKET_BYTES, BOX = 16_000_000, 1_000_000, 21
#: Texts by which a counter of all triples has to stand out.
BLUR = 1_000
#: Counters that are summed in one place at a time, and their pieces.
FAN, PIECES = 64, 64
#: Marks of a box that stands for two blocks of sets that meet: that it does, and which of the two the set is in.
_CROSS, _SIDE = 1 << 30, 1 << 31


class Sets:
    """The sets of a block of texts, each ordered by (frequency class, hash), one after the other."""

    def __init__(self, texts: pa.Array, order: np.ndarray | None = None, width: int = WORDS):
        h, row, _, _ = words(texts, ident=True, lower=False)
        n = max(0, len(h) - width + 1)
        same = row[:n] == row[len(row) - n :]
        g = np.zeros(n, np.uint64)
        for k in range(width):
            g += mix(h[k : k + n] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
        g, doc = mix(g)[same], row[:n][same]
        rank = np.zeros(len(g), np.uint64) if order is None else order[(g & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
        at = np.argsort((doc.astype(np.uint64) << np.uint64(48)) | (rank << np.uint64(40)) | (g >> np.uint64(24)))
        g, doc = g[at], doc[at]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        self.items, self.doc = g[new], doc[new]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.start = np.cumsum(self.size) - self.size
        total = np.zeros(len(self.items) + 1, np.uint64)
        np.cumsum(mix(self.items + np.uint64(0x51ED)), out=total[1:])
        self.key = mix(total[self.start + self.size] - total[self.start] + self.size.astype(np.uint64)).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all triples, and of those alone that occur in several texts of a window: the latter are not blurred by rare ones."""
    from pyspark import TaskContext

    again, every, held, n, texts = np.zeros(COUNTERS, np.int32), np.zeros(COUNTERS, np.int32), [], 0, 0

    def close() -> None:
        items, many = np.unique(np.concatenate(held), return_counts=True)
        at = (items & np.uint64(COUNTERS - 1)).astype(np.int64)
        np.add.at(every, at, many.astype(np.int32))
        np.add.at(again, at[many > 1], many[many > 1].astype(np.int32))
        held.clear()

    for batch in batches:
        for b in blocks(batch, "text"):
            s = Sets(b.column("text"))
            held.append(s.items)
            n += len(held[-1])
            texts += int((s.size > 0).sum())
            if n > WINDOW:
                close()
                n = 0
    if held:
        close()
    task, width = TaskContext.get().partitionId(), COUNTERS // PIECES
    for i in range(PIECES):
        counts = again[i * width : (i + 1) * width].tobytes() + every[i * width : (i + 1) * width].tobytes()
        yield pa.record_batch({"part": pa.array([i], pa.int32()), "task": pa.array([task], pa.int64()), "texts": pa.array([texts], pa.int64()), "wide": pa.array([False]), "counts": pa.array([counts], pa.binary())})


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(2 * COUNTERS // PIECES, np.int64)
    for wide, c in zip(t.column("wide").to_pylist(), t.column("counts"), strict=True):
        total += np.frombuffer(c.as_buffer(), np.int64 if wide else np.int32)
    return pa.table({"part": t.column("part")[:1], "task": t.column("task")[:1], "texts": pa.array([sum(t.column("texts").to_pylist())], pa.int64()), "wide": pa.array([True]), "counts": pa.array([total.tobytes()], pa.binary())})


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, texts, wide, counts in zip(*(b.column(c).to_pylist() for c in ("part", "texts", "wide", "counts")), strict=True):
            again, every = np.frombuffer(counts, np.int64 if wide else np.int32).reshape(2, -1)
            # what stands far out of the blur is hot, though it may never repeat within a window
            total = np.maximum(again, every - 2 * every.mean() - BLUR)
            classes = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "texts": pa.array([texts], pa.int64()), "items": pa.array([int(every.sum())], pa.int64()), "classes": pa.array([classes.tobytes()], pa.binary())})


def frequency_order(texts: DataFrame) -> tuple[np.ndarray, int, int]:
    """A class of frequency for each of COUNTERS hash values (4 MB whatever the number of texts), the texts with triples, and their triples.

    The counters of the tasks are added up FAN at a time, so that no place gets those of all tasks.
    """
    kind = "part int, task long, texts long, wide boolean, counts binary"
    counts, tasks = texts.mapInArrow(_count, kind), texts.rdd.getNumPartitions()
    while tasks > 1:
        counts = counts.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("part", "task").applyInArrow(_add, kind)
        tasks = math.ceil(tasks / FAN)
    rows = counts.mapInArrow(_classes, "part int, texts long, items long, classes binary").collect()
    parts = {r.part: np.frombuffer(r.classes, np.uint8) for r in rows}
    return np.concatenate([parts.get(i, np.zeros(COUNTERS // PIECES, np.uint8)) for i in range(PIECES)]), max((r.texts for r in rows), default=0), sum(r.items for r in rows)


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _boxes(order, buckets: int, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                s = Sets(b.column("text"), order.value)
                _, first = np.unique(s.key, return_index=True)
                mine = np.zeros(len(s.size), bool)
                mine[first] = True  # copies within the block count once
                prefix = s.size - _ceil(t * s.size) + CHAIN
                pos = np.arange(len(s.items)) - s.start[s.doc]
                take = (pos < prefix[s.doc]) & mine[s.doc]
                item, doc, pos = _split(s.items[take], s.doc[take], pos[take], s.key, order.value)
                bucket = (item >> np.uint64(40)) % np.uint64(buckets)
                at = np.argsort(bucket, kind="stable")
                item, doc, pos, bucket = item[at], doc[at], pos[at], bucket[at]
                found, begin = np.unique(bucket, return_index=True)
                cuts = [*begin.tolist(), len(bucket)]
                out = []
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    planes = [(item[lo:hi] & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], s.key[doc[lo:hi]].view(np.uint8).reshape(-1, 8), s.size[doc[lo:hi]].astype("<u4").view(np.uint8).reshape(-1, 4), pos[lo:hi].astype("<u4").view(np.uint8).reshape(-1, 4)]
                    out.append(np.concatenate(planes, axis=1).T.tobytes())  # by plane, which compresses better
                yield pa.record_batch({"bucket": pa.array(found.astype(np.int32)), "boxes": pa.array(out, pa.binary())})

    return run


def _split(item: np.ndarray, doc: np.ndarray, pos: np.ndarray, key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes that very many sets share, once for each block that their set's block has to meet."""
    expected = np.exp2(order[(item & np.uint64(COUNTERS - 1)).astype(np.int64)] / 8.0)
    hot = np.flatnonzero(expected > HOT)
    if not len(hot):
        return item, doc, pos
    n = np.ceil(expected[hot] / HOT).astype(np.int64)
    own = (mix(key[doc[hot]].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
    at = np.repeat(hot, n)
    other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    own = np.repeat(own, n)
    met = mix(item[at] + (np.minimum(own, other) * 65_536 + np.maximum(own, other) + 1).astype(np.uint64))
    marked = pos[at] + np.where(own != other, _CROSS, 0) + np.where(own > other, _SIDE, 0)
    cold = np.flatnonzero(expected <= HOT)
    return np.concatenate([item[cold], met]), np.concatenate([doc[cold], doc[at]]), np.concatenate([pos[cold], marked])


def _candidates(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [np.frombuffer(x, np.uint8).reshape(BOX, -1) for b in batches for x in b.column("boxes").to_pylist()]
        m = np.concatenate(raw, axis=1)
        item = np.ascontiguousarray(np.concatenate([m[:5], np.zeros((3, m.shape[1]), np.uint8)]).T).view(np.uint64).ravel()
        key, size, pos = (np.ascontiguousarray(m[a:b].T).view(k).ravel() for a, b, k in ((5, 13, np.int64), (13, 17, np.uint32), (17, 21, np.uint32)))
        _, back, many = np.unique(item, return_inverse=True, return_counts=True)
        keep = many[back] > 1
        item, key, size, pos = item[keep], key[keep], size[keep].astype(np.int64), pos[keep].astype(np.int64)
        at = np.lexsort((key, size, item))
        item, key, size, pos = item[at], key[at], size[at], pos[at]
        once = np.ones(len(item), bool)
        once[1:] = (item[1:] != item[:-1]) | (key[1:] != key[:-1])
        item, key, size, pos = item[once], key[once], size[once], pos[once]
        side, pos = pos & (_CROSS | _SIDE), pos & (_CROSS - 1)
        # of each box those that follow in the same list, as far as the sizes allow
        end = np.searchsorted(item, item, "right")
        if len(item):
            # sizes within a list ascend, so the last that is not too large is found by bisection
            lo, hi = np.arange(len(item)) + 1, end.copy()
            limit = np.floor(size / t + 1e-9).astype(np.int64)
            while (lo < hi).any():
                mid = (lo + hi) // 2
                go = (lo < hi) & (size[np.minimum(mid, len(size) - 1)] <= limit)
                stop = (lo < hi) & ~go
                lo, hi = np.where(go, mid + 1, lo), np.where(stop, mid, hi)
            end = lo
        follow = np.maximum(end - np.arange(len(item)) - 1, 0)
        done = np.concatenate([[0], np.cumsum(follow)])
        i = 0
        while i < len(item):
            j = max(i + 1, int(np.searchsorted(done, done[i] + CHUNK, "right")) - 1)
            n = follow[i:j]
            a = np.repeat(np.arange(i, j), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(done[i:j] - done[i], n)
            need = _ceil(t / (1 + t) * (size[a] + size[b]))
            # the r-th common box leaves room for the rest of the overlap, for each r up to CHAIN
            ok = (np.minimum(size[a] - pos[a], size[b] - pos[b]) >= need - (CHAIN - 1)) & (key[a] != key[b])
            ok &= (side[a] < _CROSS) | (side[a] != side[b])  # sets of one block meet in that block's own box
            x, y = key[a[ok]], key[b[ok]]
            if len(x):
                p, n = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), np.minimum(need[ok], CHAIN)], axis=1), axis=0, return_counts=True)
                yield pa.record_batch({"a": pa.array(p[:, 0], pa.int64()), "b": pa.array(p[:, 1], pa.int64()), "least": pa.array(p[:, 2], pa.int64()), "n": pa.array(n, pa.int64())})
            i = j

    return run


def _members(bits):
    """Every text's class, and for those that the check may need the sketch and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            for b in blocks(batch, "text"):
                s = Sets(b.column("text"))
                k = s.key.view(np.uint64)
                ask = (table[(k % np.uint64(len(table))).astype(np.int64)] >> (k >> np.uint64(58))) & np.uint64(1)
                sets = [s.items[x : x + n].tobytes() if yes else None for x, n, yes in zip(s.start.tolist(), s.size.tolist(), ask.tolist(), strict=True)]
                drawn = [x.tobytes() if yes else None for x, yes in zip(sketches(s), ask.tolist(), strict=True)]
                yield pa.record_batch({"id": b.column("id"), "key": pa.array(s.key), "sketch": pa.array(drawn, pa.binary()), "items": pa.array(sets, pa.binary())}).filter(pa.array(s.size > 0))

    return run


def sketches(s: Sets) -> np.ndarray:
    """Of each set the number of items in each segment, and the parity of each of its bits, as bytes."""
    n = len(s.size)
    seg = (s.items >> np.uint64(60)).astype(np.int64) % SEGMENTS
    bit = seg * BITS + ((s.items >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64)
    counts = np.bincount(s.doc * SEGMENTS + seg, minlength=n * SEGMENTS).astype("<u4").reshape(n, SEGMENTS)
    odd = (np.bincount(s.doc * (SEGMENTS * BITS) + bit, minlength=n * SEGMENTS * BITS) & 1).astype(np.uint8).reshape(n, -1)
    return np.concatenate([counts.view(np.uint8), np.packbits(odd, axis=1)], axis=1)


def lower_bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of sketches: the least possible differences of each segment, and the sizes of both sets together."""
    cx, cy = (np.ascontiguousarray(z[:, : 4 * SEGMENTS]).view("<u4").astype(np.int64) for z in (x, y))
    odd = np.unpackbits(x[:, 4 * SEGMENTS :] ^ y[:, 4 * SEGMENTS :], axis=1).reshape(len(x), SEGMENTS, BITS).sum(axis=2)
    return np.maximum(np.abs(cx - cy), odd), (cx + cy).sum(axis=1)


def chained(low: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """For each row of lower bounds of the segments' differences: whether some chain stays within its budgets all around the ring."""
    m = low.shape[1]
    share = budget[:, None] / m
    ring = np.concatenate([low, low], axis=1) - share
    total = np.concatenate([np.zeros((len(low), 1)), np.cumsum(ring, axis=1)], axis=1)
    out = np.zeros(len(low), bool)
    for s in range(m):
        out |= (total[:, s + 1 : s + m + 1] - total[:, s : s + 1]).max(axis=1) <= 1e-9
    return out


def _prune(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            low, size = lower_bounds(x, y)
            yield b.select(["a", "b"]).filter(pa.array(chained(low, np.floor((1 - t) / (1 + t) * size + 1e-9))))

    return run


def _verify(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("items_a").to_pylist(), b.column("items_b").to_pylist(), strict=True):
                differ = len(np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                good.append(differ <= math.floor((1 - t) / (1 + t) * (len(x) + len(y)) / 8 + 1e-9))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def similar(files: DataFrame, id_col: str = "id", text_col: str = "source_text", t: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(id, key) gives each text's class, links(a, b) all pairs of classes that are similar, a < b.

    Null ids, null texts and texts of fewer than three words belong to no class: they have no triples, so no similarity is
    defined.  Rows given twice count once; other columns are ignored, whatever their names.
    """
    spark = files.sparkSession
    texts = files.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    classes_, n, items = frequency_order(texts.select("text"))
    order = spark.sparkContext.broadcast(classes_)
    # buckets and tasks grow with the boxes, so that what one of them gets does not
    size = BOX * ((1 - t) * items + CHAIN * n)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    buckets = max(16 * tasks, math.ceil(size / BUCKET_BYTES))
    boxes = texts.select("text").mapInArrow(_boxes(order, buckets, t), "bucket int, boxes binary").repartition(tasks, "bucket")
    met = boxes.groupBy("bucket").applyInArrow(_candidates(t), "a long, b long, least long, n long")
    candidates = reliable(met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where("n >= least").select("a", "b"))
    bits = spark.sparkContext.broadcast(_needed(candidates))
    members = reliable(texts.mapInArrow(_members(bits), "id string, key long, sketch binary, items binary"))
    sets = members.where("items IS NOT NULL")

    def of(column: str, side: str) -> DataFrame:
        return sets.groupBy(F.col("key").alias(side)).agg(F.first(column).alias(f"{column}_{side}"))

    drawn = candidates.join(of("sketch", "a"), "a").join(of("sketch", "b"), "b").select("a", "b", "sketch_a", "sketch_b")
    near = drawn.mapInArrow(_prune(t), "a long, b long")
    links = near.join(of("items", "a"), "a").join(of("items", "b"), "b").select("a", "b", "items_a", "items_b").mapInArrow(_verify(t), "a long, b long")
    return members.select("id", "key").distinct(), links


def _needed(candidates: DataFrame) -> np.ndarray:
    """A filter of fixed greatest size that knows all classes of the candidates; when it is full it lets everything pass."""
    n = candidates.count()
    size = min(max(FILTER[0], 1 << max(0, math.ceil(math.log2(n + 1)) - 1)), FILTER[1])
    key = candidates.select(F.explode(F.array("a", "b")).alias("key"))
    # as in _members: word by the unsigned rest, bit by the top six bits; size is a power of two, so the rest is a mask
    word = F.col("key").bitwiseAND(F.lit(size - 1))
    rows = key.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 58) as int))")).alias("bits"))
    out = np.zeros(size, np.uint64)
    got = rows.toArrow()
    out[np.asarray(got.column("word"), np.int64)] = np.asarray(got.column("bits"), np.int64).view(np.uint64)
    return out


def pairs(members: DataFrame, links: DataFrame, part: int = PART) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of similar texts, copies included.

    The members of a large class are cut into parts, so that no task joins a whole class with another.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    several = sizes.where("n > 1").select(F.col("key").alias("a"), F.col("key").alias("b"))
    large = sizes.where(F.col("n") > part).select(F.col("key").alias("b"), F.ceil(F.col("n") / part).cast("int").alias("parts"))
    whole = F.coalesce("parts", F.lit(1))
    right = members.select(F.col("id").alias("y"), F.col("key").alias("b")).join(large, "b", "left").select("y", "b", F.pmod(F.xxhash64("y"), whole).cast("int").alias("part"))
    left = links.unionAll(several).join(members.select(F.col("id").alias("x"), F.col("key").alias("a")), "a").join(large, "b", "left")
    found = left.select("x", "a", "b", F.explode(F.sequence(F.lit(0), whole - 1)).alias("part")).join(right, ["b", "part"]).where("x <> y AND (a <> b OR x < y)")
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(file_id, class_id, copies, links): one row a text, with its class (its least id), the texts of the class, and the number of similar classes."""
    ends = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    sizes = members.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("class_id")).join(ends, "key", "left")
    return members.join(sizes, "key").select(F.col("id").alias("file_id"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
