"""Problem 6: token ids of a public byte-level BPE for a whole corpus.

Plan: every block of documents gives its distinct pre-tokens, numbered, and one head with the numbers in order (the positions).
Words are shuffled by word, so that each distinct word of the corpus is encoded once; heads are spread by block.  One shuffle by
block then brings the ids back to the heads.  A word travels with eight bytes for each block that holds it, never with its
positions, so the hottest word weighs as much as any other word that every block holds.
Decoding goes the same way: the distinct ids of a block are joined with the token-byte table and put back by position.
"""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lintlake.llm.blocks import blocks

#: Where the public vocabulary files lie unless a caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-token pattern published with the vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in a block.
BLOCK = 1_000_000


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def _numbered(pieces: Iterable[list]) -> tuple[dict, np.ndarray, list[int]]:
    """The distinct pieces with their numbers, the numbers in order, and how many pieces each list has."""
    number: dict = defaultdict(count().__next__)
    order, sizes = array("i"), []
    for p in pieces:
        order.extend(map(number.__getitem__, p))
        sizes.append(len(p))
    return number, np.frombuffer(order, np.int32), sizes


def _rows(block: int, ids: pa.Array, number: dict, order: np.ndarray, sizes: list[int], name: str, kind: pa.DataType) -> pa.RecordBatch:
    """The head of a block (a null piece) and its distinct pieces: `at` is the head's ids, sizes and order, and the number of a piece."""
    head = np.concatenate([np.asarray(ids, np.int64), np.asarray(sizes, np.int64)]).tobytes() + order.astype("<i4").tobytes()
    numbers = np.arange(len(number), dtype="<i8").tobytes()
    at = [len(ids).to_bytes(8, "little") + head, *(numbers[i : i + 8] for i in range(0, len(numbers), 8))]
    return pa.record_batch({"block": pa.array([block] * (len(number) + 1), pa.int64()), name: pa.array([None, *number], kind), "at": pa.array(at, pa.binary())})


def _put_back(at: list[bytes], codes: list, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the block's documents, where each of them begins in the flat sequence (and where the last ends), and the sequence."""
    head = next(x for x, c in zip(at, codes, strict=True) if c is None)
    n = int.from_bytes(head[:8], "little")
    docs, sizes = np.split(np.frombuffer(head, "<i8", 2 * n, 8), 2)
    order = np.frombuffer(head, "<i4", -1, 8 + 16 * n)
    number = np.frombuffer(b"".join(x for x, c in zip(at, codes, strict=True) if c is not None), "<i8")
    parts = [np.frombuffer(c, dtype) for c in codes if c is not None]
    size = np.zeros(len(parts), np.int64)
    size[number] = [len(p) for p in parts]
    start = np.zeros(len(parts) + 1, np.int64)  # of each piece among the pieces as they came
    np.cumsum([len(p) for p in parts], out=start[1:])
    begin = np.zeros(len(parts), np.int64)
    begin[number] = start[:-1]
    length = size[order]
    ends = np.cumsum(length)
    take = np.arange(int(length.sum())) - np.repeat(ends - length, length) + np.repeat(begin[order], length)
    flat = np.concatenate([*parts, np.zeros(0, dtype)])[take]
    return docs, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])], flat


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex
    from pyspark import TaskContext

    find, part, k = regex.compile(PATTERN).findall, TaskContext.get().partitionId(), 0
    for batch in batches:
        for b in blocks(batch, "text", BLOCK):
            yield _rows((part << 32) + k, b.column("doc_id"), *_numbered(find(t) if t else [] for t in b.column("text").to_pylist()), "word", pa.string())
            k += 1


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, ids = _encoder(path).encode_ordinary, None, b""
        for b in batches:
            out = []
            for w in b.column("word").to_pylist():
                if w is None:
                    out.append(None)
                    continue
                if w != last:
                    last, ids = w, np.asarray(encode(w), np.int32).tobytes()
                out.append(ids)
            yield pa.record_batch({"block": b.column("block"), "ids": pa.array(out, pa.binary()), "at": b.column("at")})

    return run


def _assemble(t: pa.Table) -> pa.Table:
    docs, offsets, flat = _put_back(t.column("at").to_pylist(), t.column("ids").to_pylist(), np.int32)
    return pa.table({"doc_id": pa.array(docs), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))})


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id BIGINT, ids ARRAY<INT>), one row for each row of documents whose id is not null.

    An empty and a null text give the empty list; what looks like a special token is ordinary text; rows given twice come out
    twice; other columns are ignored, whatever their names.
    """
    path = f"{tokenizers}/{vocabulary}"
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    found = docs.mapInArrow(_words, "block long, word string, at binary")
    by_word = found.repartition(F.coalesce("word", F.col("block").cast("string"))).sortWithinPartitions("word")
    return by_word.mapInArrow(_encode(path), "block long, ids binary, at binary").groupBy("block").applyInArrow(_assemble, "doc_id long, ids array<int>")


def token_bytes(spark, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id INT, bytes BINARY): the vocabulary; its size is fixed, 50,256 rows."""
    rows = [(i, bytearray(b)) for b, i in ranks(f"{tokenizers}/{vocabulary}").items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column("ids")), 0), np.int64)
        at = 0
        while at < batch.num_rows:  # as many documents as have BLOCK ids, at least one
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK, "right")))
            b = batch.slice(at, n)
            yield _rows((part << 32) + k, b.column("doc_id"), *_numbered(x or [] for x in b.column("ids").to_pylist()), "id", pa.int32())
            at, k = at + n, k + 1


def _spell(t: pa.Table) -> pa.Table:
    heads = t.column("id").to_pylist()
    codes = [None if i is None else c for i, c in zip(heads, t.column("bytes").to_pylist(), strict=True)]
    docs, offsets, flat = _put_back(t.column("at").to_pylist(), codes, np.uint8)
    whole = flat.tobytes()
    return pa.table({"doc_id": pa.array(docs), "text": pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())})


def decode_corpus(encoded: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the distinct ids of each block of documents are joined with the token-byte table.

    The table has a fixed size (50,256 rows), so it is broadcast; positions stay with their block.  Null ids of documents give
    no row, null lists the empty text; an id that the table lacks stops the query.
    """
    found = encoded.select("doc_id", "ids").where("doc_id IS NOT NULL").mapInArrow(_id_blocks, "block long, id int, at binary")
    spelt = found.join(F.broadcast(token_bytes(encoded.sparkSession, tokenizers, vocabulary)), "id", "left").select("block", "id", "at", "bytes")
    known = spelt.withColumn("bytes", F.when(F.col("id").isNotNull() & F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("no such token id: "), F.col("id").cast("string"))).cast("binary")).otherwise(F.col("bytes")))
    return known.groupBy("block").applyInArrow(_spell, "doc_id long, text string")
