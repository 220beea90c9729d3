"""Problem 1: text that was decoded with the wrong character encoding.

Method: round-trip repair.  A line is re-encoded under each candidate legacy
encoding and strictly decoded as the encoding it may have been written in; the
best result is kept while a *garbling cost* drops, and the step is repeated for
nested layers.  Lines that cannot be recovered (replacement characters, lossy
layers) are still reported because their cost stays high.

Everything is per line, so the operator is one narrow stage: the JVM keeps only
texts with a non-ASCII character, and Arrow batches carry those to Python.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.common import LINE_BREAK, one_text

# Single-byte and multi-byte code pages met in practice.
READ_AS = ("latin-1", "cp1252", "cp1251", "cp1250", "koi8-r", "cp866", "cp437", "cp850",
           "mac-roman", "gbk", "shift_jis", "cp1253", "cp1254", "iso8859-15", "cp874", "big5", "cp949")
# Fixed values: (intended encoding, encodings it is commonly mistaken for).
LEGACY_PAIRS = (
    ("cp1251", ("cp1252", "latin-1", "koi8-r", "cp866", "mac-roman", "cp1250", "cp437")),
    ("koi8-r", ("cp1251", "cp1252", "latin-1", "cp866")),
    ("cp866", ("cp1251", "cp1252", "latin-1", "koi8-r", "cp437")),
    ("euc-jp", ("latin-1", "cp1252", "gbk", "cp949")),
    ("shift_jis", ("cp1252", "latin-1", "gbk", "mac-roman")),
    ("gbk", ("latin-1", "cp1252", "big5", "shift_jis")),
    ("gb18030", ("latin-1", "cp1252")),
    ("big5", ("latin-1", "cp1252", "gbk")),
    ("cp949", ("latin-1", "cp1252")),
    ("cp1253", ("cp1252", "latin-1", "cp1251")),
    ("iso8859-7", ("cp1252", "latin-1")),
    ("cp1256", ("cp1252", "latin-1", "cp1251")),
    ("iso8859-6", ("cp1252", "latin-1")),
    ("cp874", ("cp1252", "latin-1")),
    ("cp1250", ("cp1252", "latin-1", "cp1251")),
    ("iso8859-2", ("cp1252", "latin-1")),
    ("cp1252", ("cp437", "cp850", "mac-roman", "cp1250", "cp1251")),
    ("mac-roman", ("cp1252", "latin-1")),
    ("cp437", ("cp1252", "latin-1")),
    ("cp850", ("cp1252", "latin-1")),
)
MAX_LAYERS = 4
# A line that nothing repairs is reported from this cost per non-ASCII character on.
LOST = 1.3

_NON_ASCII = re.compile(r"[^\x00-\x7f]")
# Some of the most frequent Han characters of Chinese and Japanese texts.
_FREQUENT = frozenset("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家事成方多经么去法如都同现当没动面起看定分还进好小部其些主理前开但因只从日者无它已工情明全三点外将两高间问最重先比条例入出本見前後時間分対為了古的件")
_OWN_COMMON_CYRILLIC = frozenset("оеаинтсрвлкмдпуя")
_RARE_CYRILLIC = frozenset("ъэфщцёюшжЪЭФЩЦЁЮШЖ")
# Punctuation that real text puts next to letters of many scripts.
_QUIET = frozenset("“”‘’„‚«»‹›–—―…‐‑·¿¡、。「」『』（）！？：；，．・《》〈〉【】〜～।॥،؛؟٪ـ ¶ﾠ")


@lru_cache(maxsize=1 << 16)
def _kind(ch: str) -> tuple[str, float]:
    """(class, own cost) of a character; classes decide the cost of neighbours."""
    o = ord(ch)
    if o < 0x80:
        return ("a" if ch.isalpha() else "0" if ch.isdigit() else " "), 0.0
    if o == 0xFFFD:
        return "x", 6.0
    if o < 0xA0:
        return "x", 5.0
    if ch in _QUIET:
        return "q", 0.0
    if o < 0xC0 or o in (0xD7, 0xF7):
        return "s", 1.0 if o == 0xAD else 0.2
    if o < 0x250:
        return "l", 0.3 if o < 0x100 else 0.35
    if 0x2B0 <= o < 0x370:
        return "m", 0.6
    if o < 0x400:
        return "g", 0.1
    if o < 0x530:
        plain = 0x410 <= o < 0x450 or o in (0x401, 0x451)
        return "c", 1.5 if not plain else 0.4 if ch in _RARE_CYRILLIC else 0.0 if ch in _OWN_COMMON_CYRILLIC else 0.15
    if o < 0x600:
        return "h", 0.3
    if o < 0x780:
        return "r", 0.1
    if 0x900 <= o < 0x980:
        return "d", 0.05
    if 0xE00 <= o < 0xE80:
        return "t", 0.05
    if 0x2000 <= o < 0x2C00:
        return ("b" if 0x2500 <= o < 0x25A0 else "y"), 0.3
    if 0x3040 <= o < 0x3100:
        return "k", 0.0
    if 0x3400 <= o < 0xA000:
        return "z", 0.0 if ch in _FREQUENT else 0.1 if _everyday(ch) else 1.2
    if 0xAC00 <= o < 0xD7B0:
        return "o", 0.1
    if 0xE000 <= o < 0xF900:
        return "x", 5.0
    if 0xFF61 <= o < 0xFFA0:
        return "w", 1.2
    return "u", 0.3


def _everyday(ch: str) -> bool:
    """Whether a Han character is in the first level of GB2312 or JIS X 0208."""
    for codec, low, high in (("gb2312", 0xB0, 0xD7), ("euc-jp", 0xB0, 0xCF)):
        try:
            if low <= ch.encode(codec)[0] <= high:
                return True
        except UnicodeEncodeError:
            pass
    return False


_LETTERS = frozenset("lgcrdt")
# Marks that stand at the edge of a word, never inside it.
_OUTER = frozenset("«»„“”‹›¿¡‚")


def garbling_cost(text: str) -> float:
    """How little a text looks like anything a person wrote; 0 for plain ASCII."""
    if text.isascii():
        return 0.0
    cost, before, was, apart = 0.0, " ", " ", " "
    run = opened = alone = 0  # characters of the foreign run so far; whether an ASCII letter or a blank came before it
    for ch in text:
        kind, own = _kind(ch)
        if ch == was and kind == before:
            own = 0.0 if kind == "b" else own + 0.5 * (kind in _LETTERS and apart == kind)
        cost += own
        if kind in "zkotrdcgw":
            if not run:
                opened, alone = before == "a", before == " " and kind in "zko"
            run += 1
        elif run:
            # One or two foreign letters inside a Latin word are never written so.
            if run <= 2 and (opened or run == 1 and alone and kind == "a"):
                cost += 2.5
            run = 0
        if before == "q" and kind in "al" and apart in "al" and was in _OUTER:
            cost += 2.0
        apart = before
        if kind in "a0 " and before in "a0 ":
            pass
        elif kind == "l":
            if before == "l":
                cost += 0.4 if apart != "l" and ch.islower() and was.islower() else 1.5
            elif before in "scgrmbywx":
                cost += 1.5
            if ch.isupper() and was.islower():
                cost += 2.0
        elif kind in "sm":
            if before in "slcgrmbyxzkd":
                cost += 1.3
            elif before == "a":
                cost += 0.5
        elif kind == "c" or kind == "g":
            if before in "lsarmbyxzkw" or (before in "cg" and before != kind):
                cost += 1.4
            if ch.isupper() and was.islower():
                cost += 2.0
        elif kind in "by":
            if before != kind and before in "alcgrsmzkdtbyx":
                cost += 1.3
        elif kind == "a":
            if before in "sbymu":
                cost += 0.7
            elif before in "cg":
                cost += 1.0
        elif kind == "t":
            if before != "t" and (ch == "\u0e31" or "\u0e34" <= ch <= "\u0e3a" or "\u0e47" <= ch <= "\u0e4e"):
                cost += 1.5
        elif kind == "r":
            if before in "lscgmbyxzk":
                cost += 1.4
        elif kind == "q":
            if before in "lsbyx" and ch not in "»›”’“…–—" and was not in "»":
                cost += 0.6
            elif before in "sbyx":
                cost += 0.6
        elif kind == "u":
            if before in "al":
                cost += 1.0
        elif kind in "zkow":
            if before in "lscgrbymx":
                cost += 1.0
        before, was = kind, ch
    if run and run <= 2 and opened:
        cost += 2.5
    return cost + abs(text.count("«") - text.count("»"))


def _to_bytes(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if codec not in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp874"):
            return None
    # Decoders that pass bytes the code page leaves undefined keep them as C1 controls.
    out = bytearray()
    for ch in text:
        if "\x80" <= ch < "\xa0":
            out.append(ord(ch))
        else:
            try:
                out += ch.encode(codec)
            except UnicodeEncodeError:
                return None
    return bytes(out)


def _strict(data: bytes | None, codec: str) -> str | None:
    try:
        return None if data is None else data.decode(codec)
    except (UnicodeDecodeError, ValueError):
        return None


def _one_layer(text: str, cost: float) -> tuple[str, float, str] | None:
    """The best candidate below the cost, as (text, cost, "intended<read as")."""
    best = _unflipped(text)
    if best:
        return best
    for codec in READ_AS:
        got = _strict(_to_bytes(text, codec), "utf-8")
        if got is not None and got != text:
            now = garbling_cost(got)
            if now < (best[1] if best else cost):
                best = (got, now, f"utf-8<{codec}")
    if best or cost < 0.95 * len(_NON_ASCII.findall(text)) ** 0.5:
        return best
    # Between two legacy encodings strict decoding proves little: demand a large drop.
    limit = cost * 0.5
    for intended, mistaken in LEGACY_PAIRS:
        for codec in mistaken:
            got = _strict(_to_bytes(text, codec), intended)
            if got is not None and got != text:
                now = garbling_cost(got)
                if now < (best[1] if best else limit):
                    best = (got, now, f"{intended}<{codec}")
    return best


_SPAN = re.compile(r"\S+")
# Lines made of these alone need no closer look: one script with its punctuation, cased as people
# write it.  What any misreading makes has other characters, case flips or runs of accents besides.
_ASCII = frozenset(map(chr, range(128)))
_MARKS = frozenset("«»„“”‘’–—…¿¡№")
_LATIN = _ASCII | _MARKS | frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß")
_RUSSIAN = _ASCII | _MARKS | frozenset(map(chr, range(0x410, 0x450))) | frozenset("Ёё")
_OTHERS = tuple(_ASCII | _MARKS | frozenset(map(chr, range(a, b))) for a, b in ((0x600, 0x700), (0x900, 0x980), (0xE00, 0xE80)))
_ACCENTS = re.compile("[à-ÿœ]{3}|[«„‘“][a-zà-ÿ]+[»“’”]?[a-zà-ÿ]|[a-zà-ÿ][«„¿¡№][a-zà-ÿ]|[«„¿¡№][^«»„“]*$|(?<![A-Za-z])[à-ÿœ]{2}(?![A-Za-z])")
_FLIPS = re.compile("[а-яё][А-ЯЁ]|(?<![А-яЁё])[а-яё]?[а-яё][А-ЯЁ]|[A-Za-z][А-яЁё]|[А-яЁё][A-Za-z]|[А-яЁё][«№][А-яЁё]")


_TOUCHING = re.compile("[A-Za-z][\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f]|[\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f][A-Za-z]")
_RUSSIAN_PAGES = ("cp1251", "koi8-r", "cp866")
_CAPITALISED = re.compile("[А-ЯЁ][а-яё]")


# Share of each letter in Russian text, in hundredths of a percent.
_RUSSIAN_SHARES = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъ", (
    1097, 845, 801, 735, 670, 626, 547, 473, 454, 440, 349, 321, 298, 281, 262, 201, 190, 174, 170, 165, 159, 144, 121, 97, 94, 73, 64, 48, 36, 32, 26, 20, 4), strict=True))
_RUSSIAN_LOGS = {ch: math.log(n / 10_000) for ch, n in _RUSSIAN_SHARES.items()}
_NO_WORD = re.compile(r"\b[ъыь]")
# How much likelier (natural logarithm) another reading of a line must be.
_LIKELIER = 6.0


def _russian(text: str) -> float:
    """Logarithm of how likely the Russian letters of a text are, whatever their case."""
    low = text.lower()
    return sum(_RUSSIAN_LOGS.get(ch, 0.0) for ch in low) - 5.0 * len(_NO_WORD.findall(low))


@lru_cache(maxsize=1 << 15)
def _other_page(line: str) -> tuple[str, float, str] | None:
    """A Russian line read in another Russian code page, where that reads far better.

    Such a misreading swaps the case of whole words, and the costs hardly tell cases apart."""
    letters = sum("\u0400" <= ch < "\u0460" or ch in "╦╗" for ch in line)
    # A letter of another alphabet counts as the rarest one.
    best, limit = None, _russian(line) + _LIKELIER + _RUSSIAN_LOGS["ъ"] * (letters - sum(ch in _RUSSIAN_LOGS for ch in line.lower()))
    for intended in _RUSSIAN_PAGES:
        for codec in _RUSSIAN_PAGES:
            got = _strict(_to_bytes(line, codec), intended) if codec != intended else None
            if got is not None and got != line and _RUSSIAN.issuperset(got) and _FLIPS.search(got) is None:
                now = _russian(got)
                if now > limit:
                    best, limit = (got, garbling_cost(got), f"{intended}<{codec}"), now
    return best


# What the letter io becomes.
_RUSSIAN_MISREAD = _RUSSIAN | frozenset("Јі╦╗")


def _unflipped(line: str) -> tuple[str, float, str] | None:
    # A capitalised word would come out of any of these misreadings with its case flipped inside.
    if not _RUSSIAN_MISREAD.issuperset(line) or _CAPITALISED.search(line):
        return None
    return _other_page(line)


def _plain(line: str) -> bool:
    chars = set(line)
    if chars <= _LATIN:
        return _ACCENTS.search(line) is None
    if chars <= _RUSSIAN:
        return _FLIPS.search(line) is None and _unflipped(line) is None
    if not any(chars <= other for other in _OTHERS) or _TOUCHING.search(line):
        return False
    # Of the code pages tried only cp874 has letters of these scripts.
    return all(w.isascii() or _strict(_to_bytes(w, "cp874"), "utf-8") is None for w in line.split())


# Shapes of lines that were found clean: ASCII words and numbers do not decide, so a line of a
# known shape is clean too.  Bounded, and emptied when full.
_SHAPE = re.compile(r"([a-z]+)|([A-Z]+)|([0-9]+)")
_clean_shapes: set[str] = set()


def _shape(line: str) -> str:
    return _SHAPE.sub(lambda m: "w" if m[1] else "W" if m[2] else "0", line)


def repair_line(line: str) -> tuple[str, str, str]:
    """(state, text, layers): state is clean, repaired, partly or lost.

    A clean line comes back unchanged.  ``partly``: only some words could be
    restored.  ``lost``: garbled, and nothing strict restores any of it.
    """
    if line.isascii() or _plain(line):
        return "clean", line, ""
    shape = _shape(line)
    if shape in _clean_shapes:
        return "clean", line, ""
    found = _repaired(line)
    if found[0] == "clean":
        if len(_clean_shapes) >= 1 << 16:
            _clean_shapes.clear()
        _clean_shapes.add(shape)
    return found


@lru_cache(maxsize=1 << 15)
def _repaired(line: str) -> tuple[str, str, str]:
    text, layers = line, []
    cost = garbling_cost(text)
    for _ in range(MAX_LAYERS):
        step = _one_layer(text, cost) if cost > 0 and not (layers and _plain(text)) else None
        if step is None:
            break
        text, cost, how = step
        layers.append(how)
    count = len(_NON_ASCII.findall(text)) or 1
    bad = "�" in text or cost / count >= LOST
    if layers:
        return ("partly" if bad else "repaired"), text, " ".join(layers)
    if not bad:
        return _by_words(line, False)
    return _by_words(line, True)


def _by_words(line: str, bad: bool) -> tuple[str, str, str]:
    """Repair word by word, for lines of which only a part was decoded wrongly.

    Single words prove little, so only UTF-8 layers count here."""
    layers: set[str] = set()

    def fix(m: re.Match) -> str:
        word = m.group()
        if word.isascii():
            return word
        cost = garbling_cost(word)
        for _ in range(MAX_LAYERS):
            best = None
            for codec in READ_AS:
                got = _strict(_to_bytes(word, codec), "utf-8")
                if got is None or got == word:
                    continue
                odd = _NON_ASCII.findall(got)
                now = garbling_cost(got)
                # A lone character of another script may be chance; Latin ones next to letters are not.
                if now + 0.5 < (best[1] if best else cost) and (len(odd) > 1 or odd and _kind(odd[0])[0] in "lsq"):
                    best = (got, now, codec)
            if best is None:
                break
            word, cost = best[:2]
            layers.add(f"utf-8<{best[2]}")
        return word

    text = _SPAN.sub(fix, line)
    if layers:
        left = garbling_cost(text) / (len(_NON_ASCII.findall(text)) or 1)
        return ("partly" if bad and ("�" in text or left >= LOST) else "repaired"), text, " ".join(sorted(layers))
    return ("lost" if bad else "clean"), line, ""


_OUT = pa.schema([("blob_id", pa.int64()), ("line_no", pa.int32()), ("state", pa.string()),
                  ("original", pa.string()), ("repaired", pa.string()), ("layers", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in _OUT]
        for blob_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for no, line in enumerate(LINE_BREAK.split(text), 1):
                if line.isascii():
                    continue
                state, fixed, layers = repair_line(line)
                if state != "clean":
                    for column, value in zip(rows, (blob_id, no, state, line, fixed, layers), strict=True):
                        column.append(value)
        yield pa.record_batch(rows, schema=_OUT)


def garbled_lines(blobs: DataFrame) -> DataFrame:
    """One row per wrongly decoded line of ``blobs(blob_id, text)``.

    Columns: blob_id, line_no (from 1), state (repaired, partly, lost),
    original, repaired, layers.  Rows with a null blob_id or text give nothing,
    an empty text gives nothing, repeated rows of a blob_id count once (of
    several texts the smallest with a character beyond ASCII), other columns are
    ignored whatever their names.
    """
    source = blobs.select(F.col("blob_id").cast("bigint").alias("blob_id"), F.col("text").cast("string").alias("text"))
    kept = source.where(F.col("blob_id").isNotNull() & (F.octet_length("text") > F.length("text")))
    schema = "blob_id bigint, line_no int, state string, original string, repaired string, layers string"
    return one_text(kept, "blob_id").mapInArrow(_scan, schema)


def repaired_texts(blobs: DataFrame) -> DataFrame:
    """``blobs`` (blob_id, text) with every recoverable line restored.

    Columns: blob_id, text, n_repaired, n_lost.  Line ends stay as they are.
    Null texts stay null with zero counts; a blob_id delivered twice comes once
    (its smallest text, a null text before all others).
    """
    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fixed, lost = [], [], []
            for text in batch.column(1).to_pylist():
                done = missed = 0
                parts = LINE_BREAK.split(text) if text else []
                if text is not None and not text.isascii():
                    ends = LINE_BREAK.findall(text)
                    for i, line in enumerate(parts):
                        state, parts[i], _ = repair_line(line)
                        done += state in ("repaired", "partly")
                        missed += state in ("lost", "partly")
                    text = "".join(a + b for a, b in zip(parts, [*ends, ""], strict=True))
                texts.append(text)
                fixed.append(done)
                lost.append(missed)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(fixed, pa.int32()), pa.array(lost, pa.int32())],
                                  names=["blob_id", "text", "n_repaired", "n_lost"])

    source = blobs.select(F.col("blob_id").cast("bigint").alias("blob_id"), F.col("text").cast("string").alias("text"))
    return one_text(source.where("blob_id is not null"), "blob_id").mapInArrow(fix, "blob_id bigint, text string, n_repaired int, n_lost int")
