"""Positions, lines, contexts, redaction and identity of matched values, as Columns.

Positions count code points from 0 (``start``); lines and columns from 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 96
LONG_LINE = 4096


def _prefix(text: Column, start: Column) -> Column:
    return F.substring(text, F.lit(1), start)


def line_no(text: Column, start: Column) -> Column:
    """Line of a position: line feeds before it, plus 1."""
    prefix = _prefix(text, start)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def column_no(text: Column, start: Column) -> Column:
    return F.length(F.substring_index(_prefix(text, start), "\n", -1)) + 1


def line_text(text: Column, start: Column, wide: int = LONG_LINE, around: int = 512) -> Column:
    """The line of a position; of one longer than ``wide`` only ``around`` characters each side."""
    left = F.substring_index(_prefix(text, start), "\n", -1)
    right = F.substring_index(F.substring(text, start + 1, F.length(text)), "\n", 1)
    whole = F.concat(left, right)
    part = F.concat(F.substring(left, F.greatest(F.length(left) - around + 1, F.lit(1)), F.lit(around)), F.substring(right, F.lit(1), F.lit(around)))
    return F.when(F.length(whole) > wide, part).otherwise(whole)


def context(text: Column, start: Column, length: Column, window: int = CONTEXT) -> Column:
    """Up to ``window`` characters on both sides; line breaks show as a mark."""
    left = F.greatest(start - window, F.lit(0))
    size = start + length + window - left
    snippet = F.substring(text, left + 1, size)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(snippet, "\r", " "), "\n", " ⏎ "), r"^\s+|\s+$", "")


# Characters after a position that can matter for its line or context.
AFTER = LONG_LINE + 1024


def around(text: Column, start: Column) -> tuple[Column, Column]:
    """(before, after) of a position: all before it, and as much after it as lines and contexts need."""
    return _prefix(text, start), F.substring(text, start + 1, F.lit(AFTER))


def hidden(snippet: Column, start: Column, spans: Column) -> Column:
    """``snippet``, which begins at ``start`` of its text, with the ``spans`` (at, end) of the text hidden.

    A span that is wholly in it shows as ``redact`` would; one that is cut off or
    overlaps another as stars.  Longer ones count first."""
    order = F.array_sort(spans, lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(b["end"] - a["end"]).cast("int"))
    none = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        a, b = F.greatest(span["at"] - start, acc["pos"]), F.least(span["end"] - start, F.length(snippet))
        whole = (span["at"] - start == a) & (span["end"] - start == b)
        shown = F.when(whole, redact(F.substring(snippet, a + 1, b - a))).otherwise(F.repeat(F.lit("*"), b - a))
        grown = F.struct(b.cast("int").alias("pos"), F.concat(acc["out"], F.substring(snippet, acc["pos"] + 1, a - acc["pos"]), shown).alias("out"))
        return F.when(b > a, grown).otherwise(acc)

    return F.aggregate(order, none, step, lambda acc: F.concat(acc["out"], F.substring(snippet, acc["pos"] + 1, F.length(snippet))))


def placed(before: Column, after: Column, size: Column, spans: Column | None = None) -> dict[str, Column]:
    """line, column_no, line_text, near and match_context from what stands around a match; ``spans`` are hidden in the context."""
    left, right = F.substring_index(before, "\n", -1), F.substring_index(after, "\n", 1)

    def line(wide: int, part: int) -> Column:
        cut = F.concat(F.substring(left, F.greatest(F.length(left) - part + 1, F.lit(1)), F.lit(part)), F.substring(right, F.lit(1), F.lit(part)))
        return F.when(F.length(left) + F.length(right) > wide, cut).otherwise(F.concat(left, right))

    snippet = F.concat(F.substring(before, F.greatest(F.length(before) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)), F.substring(after, F.lit(1), size + CONTEXT))
    if spans is not None:
        snippet = hidden(snippet, F.greatest(F.length(before) - CONTEXT, F.lit(0)), spans)
    shown = F.trim(F.replace(F.replace(snippet, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" ⏎ ")))
    return {"line": F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, "column_no": F.length(left) + 1, "line_text": line(LONG_LINE, 512), "near": line(320, 160), "match_context": shown}


def key_near(line: Column) -> Column:
    """The identifier before the last value of a line (first 512 characters), else null."""
    cleaned = F.regexp_replace(F.substring(line, 1, 512), r"[,;]\s*$", "")
    key = F.regexp_extract(cleaned, r"""["']?([A-Za-z0-9_.\-\[\]]{2,64})["']?\s*(?::=|=>|[:=])\s*["']?[^\s"']*["']?$""", 1)
    return F.nullif(key, F.lit(""))


def redact(secret: Column, keep: int = 4) -> Column:
    """Head and tail of a secret; only stars for 11 characters or fewer."""
    s = F.trim(secret)
    n = F.length(s)
    return F.when(n <= 11, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(s, 1, keep), F.lit("..."), F.substring(s, -keep, keep)))


def scrub(text: Column, secrets: Column) -> Column:
    """``text`` with every secret (array; 8 characters or more, longest first) redacted."""
    longest = F.array_sort(F.filter(secrets, lambda s: F.length(s) >= 8), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda t, s: F.replace(t, s, redact(s)))


def identity(secret: Column, second: Column | None = None) -> Column:
    """The value that identifies a finding: the combined one of a pair if there is one."""
    return secret if second is None else F.coalesce(F.nullif(second, F.lit("")), secret)


def fingerprint(rule_id: Column, logical_path: Column, secret: Column, second: Column | None = None) -> Column:
    """32 hex digits over rule, path and value, never the line; null if any of them is."""
    return F.substring(F.sha2(F.concat_ws("\0", rule_id, logical_path, identity(secret, second)), 256), 1, 32)


# Ranks of severities and of how much a finding calls for action.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
ACTION_RANK = {"verified-active": 4, "checksum-valid": 3, "high-confidence": 2, "candidate": 1, "verified-inactive": 0}


def _ranked(column: Column, ranks: dict[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in ranks.items():
        out = out.when(column == name, F.lit(rank))
    return out


def severity_rank(severity: Column) -> Column:
    return _ranked(F.lower(severity), SEVERITY_RANK)


def actionability(verified: Column, checksum: Column, confidence: Column) -> Column:
    return F.when(verified == "active", "verified-active").when(verified == "inactive", "verified-inactive") \
        .when(checksum, "checksum-valid").when(confidence >= 0.85, "high-confidence").otherwise("candidate")


def actionability_rank(tier: Column) -> Column:
    return _ranked(tier, ACTION_RANK)


def short_path(path: Column, width: int = 60) -> Column:
    """The end of a long path after an ellipsis."""
    return F.when(F.length(path) <= width, path).otherwise(F.concat(F.lit("…"), F.substring(path, -(width - 1), width - 1)))


def unquote(value: Column) -> Column:
    v = F.trim(value)
    return F.when((F.length(v) >= 2) & F.substring(v, 1, 1).isin("'", '"') & (F.substring(v, 1, 1) == F.substring(v, -1, 1)), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
