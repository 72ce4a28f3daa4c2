"""Text functions: expressions where Catalyst has them, Arrow batches where a fold or a charset needs Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the interface.
LINE_BREAK = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85  ]"
PREFIX = 6
RATIO, FLOOR = 0.45, 1000
LOG_LIMIT = 12_000
MARGIN, LEAST_OUTPUT = 128, 128
SHORT_BUDGET = r"(?i)maximum context length is (\d+) tokens and your request has (\d+) input tokens"
LONG_BUDGET = r"(?is)maximum context length is (\d+) tokens\..*?requested \d+ tokens \((\d+) in the messages, \d+ in the completion\)"
IMPORTANT = r"(?i)error|failed|exception|traceback|docker:"
BOMS = [(b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
CHARSETS = ["gb18030", "gbk", "big5", "cp950", "cp1252", "latin-1"]


def lines(text: Column) -> Column:
    """The lines as Python's splitlines gives them: an empty text has none, and a last break opens no line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def budget(characters: int) -> int:
    """Characters that a chunk may have when the model takes so many."""
    kept = int(characters * RATIO)
    return max(1, min(characters, max(FLOOR, kept) if characters >= FLOOR else kept))


def payload(path: Column, source: Column) -> Column:
    """Characters of a file or chunk in a request."""
    return F.length(F.concat(F.lit("===== FILE: "), path, F.lit(" =====\n"), source))


def chunk(files: DataFrame, most: int) -> DataFrame:
    """(task_id, file_id, path, chunk, start_line, end_line, characters, size) of files(task_id, id, relative_path, source_text).

    Lines are numbered, long ones cut, and packed in order until the next would exceed `most`.  The fold runs once over each
    text within its own batch: nothing is exploded, and nothing is shuffled.
    """
    return files.select("task_id", "id", "relative_path", "source_text").where("source_text IS NOT NULL").mapInArrow(_chunker(most), "task_id string, file_id string, path string, chunk int, start_line int, end_line int, characters int, size int")


def _chunker(most: int):
    room = max(1, most - PREFIX - 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for task, file, path, source in zip(*(b.column(c).to_pylist() for c in ("task_id", "id", "relative_path", "source_text")), strict=True):
                frame = len(f"===== FILE: {path} =====\n") + 2
                all_lines = source.splitlines()
                if not all_lines:
                    out.append((task, file, path, 0, 1, 1, 0, frame + len(source)))
                    continue
                number, used, first = 0, 0, 1
                for at, line in enumerate(all_lines, 1):
                    width = max(PREFIX, len(str(at))) + 3  # number, colon, blank and line break
                    left = len(line)
                    while True:
                        cost = width + min(left, room)
                        if used and used + cost > most:
                            out.append((task, file, path, number, first, last, used, frame + used - 1))
                            number, used = number + 1, 0
                        if not used:
                            first = at
                        used, last = used + cost, at
                        left -= room
                        if left <= 0:
                            break
                out.append((task, file, path, number, first, last, used, frame + used - 1))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int32()] * 5, strict=True)], ["task_id", "file_id", "path", "chunk", "start_line", "end_line", "characters", "size"])

    return run


def pack(chunks: DataFrame, most: int) -> DataFrame:
    """(task_id, path, chunk, batch): chunks of a task packed in order of path and number, batches from 1.

    The fold runs along the sorted rows of a partition and keeps two numbers, whatever the chunks of a task are.
    """
    ordered = chunks.select("task_id", "path", "chunk", "size").repartition("task_id").sortWithinPartitions("task_id", "path", "chunk", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, used, number = (), 0, 0
        for b in batches:
            out = []
            for t, size in zip(b.column("task_id").to_pylist(), b.column("size").to_pylist(), strict=True):
                if (t,) != task:
                    task, used, number = (t,), 0, 0
                if number == 0 or used + size > most:
                    number, used = number + 1, 0
                used += size
                out.append(number)
            yield pa.RecordBatch.from_arrays([b.column("task_id"), b.column("path"), b.column("chunk"), pa.array(out, pa.int32())], ["task_id", "path", "chunk", "batch"])

    return ordered.mapInArrow(run, "task_id string, path string, chunk int, batch int")



def truncated(text: Column, limit: int = LOG_LIMIT) -> Column:
    """The first `limit` characters and a note of how many were left out."""
    rest = F.length(text) - limit
    return F.when(rest > 0, F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated "), rest.cast("string"), F.lit(" chars]"))).otherwise(text)


def appended(log: Column, stamp: Column, entry: Column, limit: int = LOG_LIMIT) -> Column:
    """The log with a stamped entry after an empty line, cut to its first `limit` characters; the oldest text stays."""
    new = F.concat(F.lit("["), iso(stamp), F.lit("] "), entry)
    return truncated(F.when(F.coalesce(log, F.lit("")) == "", new).otherwise(F.concat(log, F.lit("\n\n"), new)), limit)


def iso(stamp: Column) -> Column:
    """ISO 8601 in UTC; a fraction of zero is left out."""
    whole, fraction = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(stamp, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def batch_prompt(prompt: Column, note: str, index: Column, count: Column, chunks: Column) -> Column:
    """The request for one batch: the prompt, a note, the batch's number, and its chunks(path, start_line, end_line) one a line."""
    one = lambda c: F.concat(F.lit("- "), c.path, F.lit(", lines "), c.start_line.cast("string"), F.lit("-"), c.end_line.cast("string"))
    head = F.concat(F.lit("Batch "), index.cast("string"), F.lit(" of "), count.cast("string"), F.lit(", containing "), F.size(chunks).cast("string"), F.lit(" source chunk(s):\n"))
    return F.concat(prompt, F.lit(f"\n\n{note}\n"), head, F.array_join(F.transform(chunks, one), "\n"))


def location(path: Column, line: Column, unknown: str = "unknown") -> Column:
    """path:line, or the path alone where the line is missing or 0."""
    return F.concat(F.coalesce(path, F.lit(unknown)), F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def labelled(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key, or the key itself."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(names, key), key)


def tail(text: Column, n: int = 16_000) -> Column:
    return F.right(text, F.lit(n))


def unsafe_path(path: Column, longest: int = 512) -> Column:
    """The reason why a path is not taken, or null."""
    p = F.translate(path, "\\", "/")
    bad = (p == "") | p.startswith("/") | p.rlike("^[A-Za-z]:") | p.rlike(r"(^|/)\.\.(/|$)")
    return F.when(bad, "unsafe").when(F.length(p) > longest, "too_long")


def clean_path(path: Column) -> Column:
    """Slashes forward, none doubled, no `.` parts."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), r"(?<=.)/\.?$", "")


def suffix(path: Column) -> Column:
    """The extension in lower case; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(F.translate(path, "\\", "/"), r"[^/](\.[^./]+)$", 1))


def blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def important(text: Column, n: int = 3) -> Column:
    """The last n lines that speak of trouble."""
    hit = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(IMPORTANT))
    return F.array_join(F.slice(hit, F.greatest(F.size(hit) - n + 1, F.lit(1)), F.lit(n)), " / ")


def output_budget(error: Column, current: int) -> Column:
    """Tokens that are left for an answer according to the model's error text, or null."""
    def left(pattern: str) -> Column:
        c, i = (F.regexp_extract(error, pattern, k).try_cast("long") for k in (1, 2))
        return c - i - MARGIN

    available = F.when(error.rlike(SHORT_BUDGET), left(SHORT_BUDGET)).when(error.rlike(LONG_BUDGET), left(LONG_BUDGET))
    reduced = F.least(F.lit(current - 1).cast("long"), available)
    return F.when((available >= LEAST_OUTPUT) & (reduced >= LEAST_OUTPUT), reduced)


def context_error(error: Column) -> Column:
    return error.rlike(SHORT_BUDGET) | error.rlike(LONG_BUDGET) | F.lower(error).contains("maximum context length")


def general(x: Column) -> Column:
    """Six significant digits without trailing zeros, for the magnitudes that scores have."""
    s = F.format_string("%.6g", x)
    return F.when(x.isNull(), "").when(s.contains("e"), s).when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def character_classes(text: Column) -> list[Column]:
    kinds = {"cjk": "[\\x{4E00}-\\x{9FFF}]", "suspicious": "[\\x{0300}-\\x{05FF}\\x{FFFD}]", "kana": "[\\x{3040}-\\x{30FF}]", "nul": "\\x{0000}"}
    return [F.regexp_count(text, F.lit(p)).alias(k) for k, p in kinds.items()]


def _readable(content: bytes, charset: str) -> str | None:
    try:
        return content.decode(charset)
    except UnicodeError:
        return None


def _likeliness(text: str) -> tuple[int, ...]:
    """How a text of a guessed charset ranks: few zero characters, few marks and letters that only wrong charsets give, few kana, many ideographs (a fixed order)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    within = lambda a, b: int(((points >= a) & (points <= b)).sum())
    return -within(0, 0), -within(0x300, 0x5FF) - within(0xFFFD, 0xFFFD), -within(0x3040, 0x30FF), within(0x4E00, 0x9FFF)


def decoded(content: bytes) -> str:
    """Text of unknown charset: by its mark, as UTF-8, as UTF-16 where every other byte is often zero, else by the likeliest charset of a fixed list."""
    marked = [n for mark, n in BOMS if content.startswith(mark)]
    halves = {"utf-16-le": content[1::2], "utf-16-be": content[::2]} if len(content) >= 4 else {}
    wide = [n for n, half in halves.items() if half.count(0) > max(2, len(content) // 8)]
    for charset in (*marked, "utf-8", *wide):
        if (t := _readable(content, charset)) is not None:
            return t
    return max((t for c in CHARSETS if (t := _readable(content, c)) is not None), key=_likeliness)


def _decode(content):  # type: ignore[no-untyped-def]
    return content.map(lambda c: None if c is None else decoded(bytes(c)))


def decode(content: Column) -> Column:
    """Valid UTF-8 without a mark stays in the JVM; only the rest goes through Python."""
    plain = F.is_valid_utf8(content.cast("string")) & ~F.hex(F.substring(content, 1, 3)).rlike("^(EFBBBF|FFFE|FEFF|0000FE)")
    return F.when(plain, content.cast("string")).otherwise(F.pandas_udf(_decode, "string")(F.when(~plain, content)))


def escaped(text: Column) -> Column:
    """Text for HTML or XML."""
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def readable_bytes(size: Column) -> Column:
    """B below a kibibyte, then KB, MB, GB and TB with one place, half a tenth rounded up; null as `--`."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        tenths = F.floor(size * 10 / 1024.0**power + 0.5).cast("long")
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= 1024**power, shown).otherwise(out)
    return F.when(size.isNull(), "--").otherwise(out)


def readable_duration(ms: Column) -> Column:
    return F.when(ms.isNull(), "--").otherwise(F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.floor(ms % 1000 / 100).cast("string"), F.lit(" s")))


def kinds_text(kinds: Column, labels: dict[str, str], head: str) -> Column:
    """A heading and one line for each kind, by its label."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.concat(F.lit(head), F.array_join(F.transform(F.array_distinct(kinds), lambda k: F.concat(F.lit("\n- "), F.coalesce(F.try_element_at(names, k), k))), ""))


def attempts(log: Column) -> Column:
    """The ends of the attempts in a log, as an array of (number, outcome, reason)."""
    entries = F.filter(F.split(log, r"\n\n(?=\[\d{4}-)"), lambda e: e.rlike(r"^\[[^\]]*\] Attempt \d+ (succeeded|failed)"))
    part = lambda e, k: F.regexp_extract(e, r"^\[[^\]]*\] Attempt (\d+) (succeeded|failed)(?:: ([^\n]*))?", k)
    return F.transform(entries, lambda e: F.struct(part(e, 1).cast("int").alias("number"), part(e, 2).alias("outcome"), part(e, 3).alias("reason")))
