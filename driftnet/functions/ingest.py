"""Bytes to text: what a file is, whether it is binary, and its text, as Columns over binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First bytes of archive formats (ustar stands at 257).
MAGIC = (("zip", "504B0304"), ("zip", "504B0506"), ("zip", "504B0708"), ("gzip", "1F8B"), ("bzip2", "425A68"), ("xz", "FD377A585A00"), ("7z", "377ABCAF271C"), ("rar", "526172211A07"))
# Beginnings of texts that need no further look.
TEXT_START = ("<?xml", "<!DOC", "<html", "#!/", "{", "[", "-----BEGIN", "%YAML")
HEAD = 8192
# What the code page 1252 has at 0x80 to 0x9F where it has anything.
_C1 = "".join(map(chr, (0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E, 0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F)))
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def archive_kind(content: Column) -> Column:
    """zip, gzip, bzip2, xz, 7z, rar or tar by magic bytes, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, magic in MAGIC:
        out = out.when(F.startswith(content, F.unhex(F.lit(magic))), kind)
    return out.when(F.substring(content, 258, 5) == F.lit(b"ustar"), "tar")


def _latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def looks_binary(content: Column) -> Column:
    """A NUL without UTF-16 mark, or under three quarters printable, in the first 8 KB; empty is not."""
    head = F.substring(content, 1, HEAD)
    latin = _latin(head)
    starts = F.lit(False)
    for s in TEXT_START:
        starts = starts | F.startswith(latin, F.lit(s))
    marked = F.startswith(content, F.unhex(F.lit("FFFE"))) | F.startswith(content, F.unhex(F.lit("FEFF")))
    share = F.length(F.regexp_replace(latin, r"[^\x20-\x7e\t\n\r\x0c\x1b]", "")) / F.length(latin)
    return F.when(F.length(head) == 0, False).when(starts, False).when(F.contains(latin, F.lit("\0")), ~marked).otherwise(share < 0.75)


def text_of(content: Column) -> Column:
    """UTF-16 with mark, else UTF-8, else code page 1252 with Latin-1 for what that lacks; never fails."""
    utf16 = F.startswith(content, F.unhex(F.lit("FFFE"))) | F.startswith(content, F.unhex(F.lit("FEFF")))
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(utf16, F.decode(content, "UTF-16")).when(valid, F.decode(F.when(valid, content), "UTF-8")).otherwise(F.translate(_latin(content), _C1, _CP1252))


def strings_of(content: Column) -> Column:
    """Runs of six printable characters or more, ASCII first, then UTF-16LE, one a line."""
    latin = _latin(content)
    ascii_runs = F.regexp_extract_all(latin, F.lit(r"[\x20-\x7e\t]{6,}"), F.lit(0))
    wide = F.transform(F.regexp_extract_all(latin, F.lit(r"(?:[\x20-\x7e\t]\x00){6,}"), F.lit(0)), lambda s: F.replace(s, F.lit("\0"), F.lit("")))
    return F.array_join(F.concat(ascii_runs, wide), "\n")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
