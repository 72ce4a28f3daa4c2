"""Problem 7: evaluation passages in a corpus, by suffix arrays over the corpus.

Every shard (a bounded block of documents) gets a suffix array over its words, ordered by the first `run` words of each suffix.
Every suffix of the held-out items is searched in it by binary search, word by word, and gets the interval of the array that
begins with its first `run` words.  Of an interval only the places at which a common run begins are followed to their end.
Items that exceed one round are read in several; the suffix arrays are then written once and searched by all rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lintlake.llm.blocks import blocks, words
from lintlake.llm.env import reliable

#: Words of a run that count as a leak.
RUN = 12
#: Bytes of held-out text that go to the executors at a time; more is done in further rounds over the suffix arrays.
ITEMS_BYTES = 4_000_000
#: Bytes of a shard of the corpus.
SHARD = 4_000_000
#: Places of the shard that are looked at together.
CHUNK = 2_000_000
_OUT = "doc_id long, item_id long, run_words int, doc_word int, item_word int"
_PARTS = ("docs", "words", "rows", "numbers", "suffixes")


def _sequence(ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with a stop after each text, the row of each place, and the word's number in its text (-1: a stop)."""
    h, row, _, _ = words(texts, ident=False, lower=True)
    n = len(ids)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count + 1) - (count + 1)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    seq, rows, nums = np.zeros(len(row) + n, np.uint64), np.repeat(np.arange(n), count + 1), np.full(len(row) + n, -1, np.int64)
    seq[first[row] + number], nums[first[row] + number] = h, number
    return seq, rows, nums


def suffix_ranks(seq: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """By prefix doubling: the rank of each suffix among all, comparing its first `depth` words, and whether it has so many.

    Suffixes with equal first words share a rank.
    """
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    rank[stop] = 0
    level = {1: rank}
    done = 1
    while done * 2 <= depth:
        rank = _pair(level[done], level[done], done)
        done *= 2
        level[done] = rank
    have = done
    while have < depth:
        step = max(k for k in level if k <= depth - have)
        rank = _pair(rank, level[step], have)
        have += step
    return rank, rank > 0


def _pair(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    later = np.zeros(len(b), np.int64)
    later[: max(0, len(b) - shift)] = b[shift:]
    key = a * (int(b.max(initial=0)) + 1) + later
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    rank[(a == 0) | (later == 0)] = 0
    return rank


def shard(docs: np.ndarray, texts: pa.Array, run: int) -> tuple[np.ndarray, ...]:
    """The suffix array of some documents: their ids, the words, each word's row and number, and the places of all suffixes of `run` words in order."""
    seq, rows, nums = _sequence(docs, texts)
    # words count in the order of their hashes, so that ranks and words compare alike
    rank, full = suffix_ranks(seq, nums < 0, run)
    at = np.flatnonzero(full)
    return docs, seq, rows.astype(np.int32), nums.astype(np.int32), at[np.argsort(rank[at], kind="stable")].astype(np.int32)


def _bound(words_at: np.ndarray, suffixes: np.ndarray, j: int, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, *, right: bool) -> np.ndarray:
    """For each wanted word the least place of lo..hi whose word j is not smaller (right: is larger)."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        w = words_at[suffixes[mid] + j]
        less = w <= want[open_] if right else w < want[open_]
        lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
    return lo


def intervals(seq: np.ndarray, suffixes: np.ndarray, queries: np.ndarray, at: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the query places those whose first `run` words stand in the suffix array, and the interval of each in it."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(suffixes), np.int64)
    for j in range(run):
        want = queries[at + j]
        lo, hi = _bound(seq, suffixes, j, want, lo, hi, right=False), _bound(seq, suffixes, j, want, lo, hi, right=True)
        met = lo < hi
        at, lo, hi = at[met], lo[met], hi[met]
    return at, lo, hi


def _best(found: list[np.ndarray]) -> list[np.ndarray]:
    """Of each document and item the longest run, the first one among equals."""
    doc, item, length, d, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, d, -length, item, doc))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)
    return [x[order[first]] for x in (doc, item, length, d, q)]


def search(array: tuple[np.ndarray, ...], items: np.ndarray, item_texts: pa.Array, run: int) -> list[np.ndarray]:
    """doc_id, item_id, length and both places of the longest common run of each document and item that share `run` words."""
    docs, seq, rows, nums, suffixes = array
    qs, qrow, qnum = _sequence(items, item_texts)
    stops, places = np.flatnonzero(qnum < 0), np.arange(len(qs))
    after = stops[np.searchsorted(stops, places)] - places if len(stops) else places  # words from each place to the end of its item
    at, lo, hi = intervals(seq, suffixes, qs, np.flatnonzero(after >= run), run)
    many = hi - lo
    done = np.concatenate([[0], np.cumsum(many)])
    held: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5]
    size = i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(done, done[i] + CHUNK, "right")) - 1)
        n = many[i:j]
        q = np.repeat(at[i:j], n)
        d = suffixes[np.arange(int(n.sum())) - np.repeat(done[i:j] - done[i], n) + np.repeat(lo[i:j], n)].astype(np.int64)
        # a run begins where the words before differ, or where a text begins
        begins = (nums[d] == 0) | (qnum[q] == 0) | (seq[np.maximum(d - 1, 0)] != qs[np.maximum(q - 1, 0)])
        q, d = q[begins], d[begins]
        length = np.full(len(q), run, np.int64)
        going = np.arange(len(q))
        while len(going):
            x, y = d[going] + length[going], q[going] + length[going]
            going = going[(nums[x] > 0) & (qnum[y] > 0) & (seq[x] == qs[y])]
            length[going] += 1
        held.append([docs[rows[d]], items[qrow[q]], length, nums[d].astype(np.int64), qnum[q]])
        size += len(q)
        if size > CHUNK:
            held = [_best(held)]
            size = 0
        i = j
    return _best(held)


def _batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], ["doc_id", "item_id", "run_words", "doc_word", "item_word"])


def _arrays(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for b in blocks(batch, "text", SHARD):
            yield shard(np.asarray(b.column("doc_id"), np.int64), b.column("text"), run)


def _written(run: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for array in _arrays(batches, run):
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in array], list(_PARTS))

    return of


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for row in b.to_pylist():
            yield tuple(np.frombuffer(row[c], k) for c, k in zip(_PARTS, (np.int64, np.uint64, np.int32, np.int32, np.int32), strict=True))


def _searcher(items, run: int, written: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = np.asarray([i for i, _ in items.value], np.int64), pa.array([t for _, t in items.value], pa.string())
        for array in _read(batches) if written else _arrays(batches, run):
            yield _batch(search(array, ids, texts, run))

    return of


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, items_bytes: int = ITEMS_BYTES) -> DataFrame:
    """(doc_id, item_id, run_words, doc_word, item_word): of each document and item that share `run` words the longest common run and where it first stands.

    A word is a longest run of ASCII letters and digits, lower-cased.  Null texts and null ids give no rows; rows given twice
    count once.  The items are spread over rounds of about `items_bytes` bytes by their hash (one item is never split), and one
    round at a time passes the driver; with more than one round the suffix arrays and each round's rows are written first.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = math.ceil(total / items_bytes) if total > items_bytes else 1
    longest = F.struct("run_words", (-F.col("doc_word")).alias("doc"), (-F.col("item_word")).alias("item"))
    if rounds > 1:
        docs = reliable(docs.mapInArrow(_written(run), ", ".join(f"{c} binary" for c in _PARTS)))
        asked = reliable(asked)
    out = None
    for k in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k) if rounds > 1 else asked
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.distinct().collect()])
        found = docs.mapInArrow(_searcher(sent, run, rounds > 1), _OUT)
        if rounds > 1:
            found = reliable(found)
            sent.destroy()
        out = found if out is None else out.unionAll(found)
    best = out.groupBy("doc_id", "item_id").agg(F.max(longest).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.run_words").alias("run_words"), (-F.col("x.doc")).alias("doc_word"), (-F.col("x.item")).alias("item_word"))


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold none of the found passages, with all their columns."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
