"""Problem 3: cutting oversized items into pieces at natural boundaries.

Method: lexical-cohesion segmentation.  Between each two lines the vocabulary of
the block before and the block after is compared (cosine); valleys of that
similarity mark topic boundaries.  Within each size window the deepest valley is
cut, then the stated number of lines is repeated at the start of the next piece.

Only oversized texts leave the JVM; each is handled whole in one row, so no
piece depends on another task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.llm.common import one_text

# Lines on each side whose words are compared.
BLOCK_LINES = 8
# A cut is sought in the last part of the window from this share of the limit on.
LEAST_FILL = 0.5
_TOKEN = re.compile(r"[^\W\d_]{2,}")
# More limits than this are no configuration table any more.
MAX_LIMITS = 10_000


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def valley_depths(lines: list[str]) -> list[float]:
    """For each gap i (before line i) the depth of the similarity valley there.

    Depth is how far the similarity climbs on both sides until it falls again;
    a blank line or a dedent next to a gap deepens it a little."""
    n = len(lines)
    if n < 2:
        return [0.0] * n
    bags = [Counter(w.lower() for w in _TOKEN.findall(line)) for line in lines]
    left, right = Counter(), Counter()
    for bag in bags[:BLOCK_LINES]:
        right.update(bag)
    similar = [1.0]
    for i in range(1, n):
        # Slide both blocks by one line.
        left.update(bags[i - 1])
        right.subtract(bags[i - 1])
        right += Counter()
        if i - 1 - BLOCK_LINES >= 0:
            left.subtract(bags[i - 1 - BLOCK_LINES])
            left += Counter()
        if i - 1 + BLOCK_LINES < n:
            right.update(bags[i - 1 + BLOCK_LINES])
        similar.append(_cosine(left, right))
    climb_left, climb_right = [0.0] * n, [0.0] * n
    top = similar[1]
    for i in range(1, n):
        top = max(similar[i], top) if i > 1 and similar[i - 1] >= similar[i] else similar[i]
        climb_left[i] = top - similar[i]
    top = similar[n - 1]
    for i in range(n - 1, 0, -1):
        top = max(similar[i], top) if i < n - 1 and similar[i + 1] >= similar[i] else similar[i]
        climb_right[i] = top - similar[i]
    depths = [0.0] * n
    for i in range(1, n):
        blank = 0.1 * (not lines[i - 1].strip()) + 0.03 * (lines[i][:1] not in (" ", "\t", "", "}", ")", "]"))
        depths[i] = climb_left[i] + climb_right[i] + blank
    return depths


def _lines_with_ends(text: str) -> list[str]:
    """Lines with their LF or CRLF; a lone CR is part of its line."""
    out = text.split("\n")
    lines = [x + "\n" for x in out[:-1]]
    return lines + [out[-1]] if out[-1] else lines


def _content(line: str) -> str:
    return line[:-2] if line.endswith("\r\n") else line[:-1] if line.endswith("\n") else line


def _cut_line(line: str, limit: int) -> list[str]:
    """A line over the limit in parts under it, cut after a blank or mark where one is near the end."""
    parts, rest = [], line
    while len(rest.encode("utf-8", "surrogatepass")) > limit:
        size = at = good = 0
        for ch in rest:
            n = len(ch.encode("utf-8", "surrogatepass"))
            if size + n > limit:
                break
            size += n
            at += 1
            if ch in " \t,;)}]>。、" and size >= limit * LEAST_FILL:
                good = at
        at = good or max(at, 1)
        if at < len(rest) and rest[at - 1] == "\r" and rest[at] == "\n":
            at -= 1
        parts.append(rest[:max(at, 1)])
        rest = rest[max(at, 1):]
    return [*parts, rest] if rest else parts


def split_text(text: str, limit: int, overlap: int) -> list[tuple[str, int, int, int, int | None]]:
    """Pieces (text, line offset, byte offset, own line, over-long line) of a text.

    Line offset and byte offset locate the piece's first line or part in the
    text, counted from 0; own line is the first line, from 1, that is no
    repeat (0 if the piece repeats nothing).  The last item is the number from
    1 of the line a piece is a part of, when that line alone exceeds the limit.
    Without their repeats the pieces joined give the text again.  A repeat that
    does not fit under the limit is shortened.
    """
    lines = _lines_with_ends(text)
    sizes = [len(x.encode("utf-8", "surrogatepass")) for x in lines]
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    depths = valley_depths([_content(x) for x in lines])
    pieces: list[tuple[str, int, int, int, int | None]] = []
    at, n = 0, len(lines)
    while at < n:
        if sizes[at] > limit:
            place = total[at]
            long = at + 1 if sizes[at] - (len(lines[at]) - len(_content(lines[at]))) > limit else None
            for part in _cut_line(lines[at], limit):
                pieces.append((part, at, place, 0, long))
                place += len(part.encode("utf-8", "surrogatepass"))
            at += 1
            continue
        # Repeat whole lines before this one while they and the line fit.
        first = at
        while pieces and at - first < overlap and first > 0 and sizes[first - 1] <= limit and total[at + 1] - total[first - 1] <= limit:
            first -= 1
        last = at + 1
        while last < n and sizes[last] <= limit and total[last + 1] - total[first] <= limit:
            last += 1
        if last < n and sizes[last] <= limit:
            least = total[first] + LEAST_FILL * limit
            inside = [i for i in range(at + 1, last + 1) if total[i] >= least]
            if inside:
                last = max(inside, key=lambda i: (depths[i], i))
        pieces.append(("".join(lines[first:last]), first, total[first], at - first + 1 if first < at else 0, None))
        at = last
    return pieces


_OUT = pa.schema([("blob_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("text", pa.string()), ("line_offset", pa.int32()),
                  ("byte_offset", pa.int64()), ("commit_line", pa.int32()), ("long_line", pa.int32())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob_id, text, limit, overlap, line0, byte0, owned in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = []
            pieces = split_text(text, limit, overlap)
            for no, (piece, line, byte, own, long) in enumerate(pieces, 1):
                # The blob may itself repeat lines of the piece before it in the source file.
                mine = max(own, owned - line, 0)
                rows.append((blob_id, no, len(pieces), piece, line0 + line, byte0 + byte, mine if mine > 1 or own or owned and no == 1 else 0, long))
            yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=_OUT)


def media_key(column: Column) -> Column:
    """A media type without parameters, blanks and letter case."""
    return F.lower(F.trim(F.substring_index(column, ";", 1)))


def pieces(blobs: DataFrame, limits: DataFrame) -> DataFrame:
    """The oversized blobs of ``blobs`` cut under the limit of their media type.

    ``blobs``: blob_id, text, media_type, line_offset, byte_offset, commit_line;
    ``limits``: media_type, max_bytes, overlap_lines, where ``*`` is for every
    other or null type.  Result: blob_id, piece_no, n_pieces, text, line_offset
    and byte_offset in the source file, commit_line (first own line of the
    piece, 0 if all are), long_line (see split_text).  A blob under its limit, a
    null text, id or limit gives nothing; null offsets count as 0, a null
    overlap as 0; a limit under 4 bytes counts as 4; a blob_id delivered twice
    comes once; without a ``*`` row other types have no limit.
    """
    rows = limits.select(media_key(F.col("media_type")).alias("k"), F.col("max_bytes").cast("int").alias("m"), F.coalesce(F.col("overlap_lines").cast("int"), F.lit(0)).alias("o")) \
        .where("k is not null and m is not null").groupBy("k").agg(F.min(F.struct("m", "o")).alias("x")).limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    by_type = {r["k"]: (max(4, r["x"]["m"]), max(0, r["x"]["o"])) for r in rows}
    other = by_type.pop("*", (None, None))
    table = blobs.sparkSession.createDataFrame([(k, *v) for k, v in by_type.items()], "k string, m int, o int")  # MAX_LIMITS rows at most
    source = blobs.select(
        F.col("blob_id").cast("bigint").alias("blob_id"), F.col("text").cast("string").alias("text"), media_key(F.col("media_type")).alias("k"),
        *(F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c) for c, t in (("line_offset", "int"), ("byte_offset", "bigint"), ("commit_line", "int"))))

    limited = source.join(F.broadcast(table), "k", "left").withColumns({"max_bytes": F.coalesce("m", F.lit(other[0]).cast("int")), "overlap": F.coalesce("o", F.lit(other[1]).cast("int"))})
    kept = limited.where("blob_id is not null and octet_length(text) > max_bytes")
    once = one_text(kept.select("blob_id", "text", "max_bytes", "overlap", "line_offset", "byte_offset", "commit_line"), "blob_id")
    return once.mapInArrow(_pieces, "blob_id bigint, piece_no int, n_pieces int, text string, line_offset int, byte_offset bigint, commit_line int, long_line int")
