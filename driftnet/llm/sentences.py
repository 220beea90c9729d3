"""Problem 8: sentence boundaries across languages and scripts.

Method: semi-Markov dynamic programming over whole sentence spans.  A regular
expression proposes boundary candidates; every span between two candidates is
scored by its length, its opening word, its closing word and whether it leaves
quotations and brackets balanced; the best chain of spans per paragraph wins.
A blank line always ends a sentence.

No training, no language column: scripts and words decide, so wrongly labelled
documents come out alike.  One narrow stage per document; only ids and offsets
leave Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.common import one_text

# Abbreviations that never end a sentence (titles, "for example", "that is").
_NEVER = frozenset(
    "mr mrs ms dr prof st fr hr sr sra srta dra m mme mlle mm me mgr rev hon gen col lt sgt capt gov sen rep pres "
    "e.g i.e π.χ δηλ z.b d.h u.a bzw vgl ggf evtl sog inkl cf vs viz resp р.х напр см т.е डॉ श्री د mt eng exmo exma ilmo dª dº".split())
# Abbreviations that go before a number and end a sentence otherwise.
_BEFORE_NUMBER = frozenset(
    "no nos nr nrn num núm art arts pág págs pag pp p fig figs sec sect ch chap vol ed ca approx aprox env abs kap bd tab abb zl st стр с гл рис п пп т г ч гг см № ver rev ex op line eq par s f".split())
# Abbreviations that can stand inside a sentence or end it; the next word decides.
_MAYBE = frozenset("etc usw ecc al inc ltd co corp llc gmbh bros jr sr a.m p.m u.s e.u u.k u.n d.c b.c a.d i.d т.д т.п др пр κ.λπ κλπ κ.ά u.ä o.ä usf ff".split())
# Months, which German writes after an ordinal number with a period.
_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner january february march may june july october december".split())
# Words that carry on after a quotation.
_GOES_ON = frozenset(
    "asked said wrote replied added and or but then when who which that because while so as if fragte sagte schrieb rief und oder aber "
    "demanda dit écrivit répondit et ou mais preguntó dijo escribió respondió y o pero perguntou disse escreveu e ou mas "
    "спросил спросила спросили сказал сказала написал и а но ρώτησε είπε και".split())

_OPEN = "([（【《「『“„«‘‚\"'¿¡<—–-"
_CANDIDATE = re.compile(
    r"""(?:
      (?P<dots>\.{2,}|…+)
      |(?P<hard>[!?。！？؟।॥‽｡]+)
      |(?P<dot>\.)(?![a-zß-öø-ÿа-яё0-9_/\\.,\-])
      |(?P<semi>(?<=[Ͱ-Ͽἀ-῿]);)
    )
    (?P<close>(?:["'”’»)\]」』）】》]|(?<![。！？｡])“|[   \n]»)*)
    |(?P<blank>\r?\n[^\S\n]*\n\s*)
    |(?<=[฀-๿])(?P<thai>[^\S\n]+)
    |(?P<thai2>[^\S\n]+)(?=[฀-๿])""", re.X)
_QUOTE = re.compile(r"[\"„“”«»「」『』（）()《》【】\[\]]")
_BEFORE = re.compile(r"[^\s(\[\"'“„«¿¡（「]+$")
_WORD = re.compile(r"[^\W\d_]+")
_GLUED = re.compile(r"[.!?;:,»”\"]")
_KNOWN = _NEVER | _BEFORE_NUMBER | _MAYBE
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯０-ￜ]")


def _states(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(position after the mark, state) at each quotation mark or bracket of a paragraph.

    The state is 0 when everything open has been closed."""
    out, straight, stack = [], 0, []
    for m in _QUOTE.finditer(text, a, b):
        ch = m.group()
        if ch == '"':
            straight ^= 1
        elif ch in "„«「『（(《【[":
            stack.append(ch)
        elif ch == "“":
            if stack and stack[-1] == "„":
                stack.pop()
            else:
                stack.append(ch)
        elif stack and (stack[-1], ch) in _PAIRS:
            stack.pop()
        elif ch == "”" and stack and stack[-1] == "„":
            stack.pop()
        else:
            continue  # a closing mark that closes nothing
        out.append((m.end(), straight + 2 * len(stack)))
    return out


_PAIRS = frozenset([("«", "»"), ("「", "」"), ("『", "』"), ("（", "）"), ("(", ")"), ("《", "》"), ("【", "】"), ("[", "]"), ("“", "”")])


def _boundary(text: str, m: re.Match, end: int, stop: int, start: int) -> float | None:
    """Local score of a boundary at ``end``: closing word before it, opening word after it.

    None: no candidate at all."""
    kind = m.lastgroup if m.lastgroup != "close" else "dots" if m["dots"] else "hard" if m["hard"] else "dot" if m["dot"] else "semi"
    nxt = end
    while nxt < stop and text[nxt].isspace():
        nxt += 1
    if nxt >= stop:
        return 6.0
    if kind in ("thai", "thai2"):
        return 3.5
    gap = nxt > end
    ch = text[nxt]
    close = m["close"]
    if ch in ",;:،、，；：»)”]—–」』）" and not (ch in "—–" and kind == "hard" and not close):
        return None
    word = _WORD.match(text, nxt + (ch in _OPEN))
    opening = word.group() if word else ""
    if kind in ("hard", "semi"):
        mark = m.group(kind)[0]
        wide = mark in "。！？｡"
        if wide:
            if close and close[-1] in "”」』’\"" and not gap:
                return -3.0 if ch not in "“「『（(" else 3.0
            return 5.0
        if not gap:
            # "…?Word": the blank was lost; inside a token it is no boundary.
            if ch.isupper() and opening[1:2].islower() and text[m.start() - 1].isalnum() or ch in _OPEN[:10] and ch not in "(\"'":
                return 3.0
            return 3.0 if _CJK.match(ch) else None
        if ch.islower():
            if close:
                return -6.0
            return -1.0 if opening.lower() in _GOES_ON else 2.5
        return 5.0
    if kind == "dots":
        if not gap and not close:
            return None
        return 2.0 if ch.isupper() and gap else -5.0
    # A full stop.
    dot = m.start("dot")
    before = _BEFORE.search(text, max(start, dot - 40), dot)
    token = before.group() if before else ""
    tail = _GLUED.split(token)[-1]
    if tail != token and len(tail) > 1 and tail[0].isupper() and tail.lower() in _KNOWN:
        token = tail  # the blank before an abbreviation was lost: "closed.Mr."
    low = token.lower()
    if not gap:
        if close and close[-1] in ")）]" and ch.isupper():
            return 2.0
        if close or not ch.isupper() and ch not in "¿¡«„“":
            return None
        # "word.Next": a lost blank between two sentences, not a name with dots.
        if len(token) < 2 or not token[-1].isalnum() or (ch.isupper() and not (opening[1:2].islower() or len(opening) == 1)) or low in _NEVER:
            return None
        after = text[nxt + len(opening):nxt + len(opening) + 1]
        return 1.5 if not after or after.isspace() or after in ",'’.-…!?" else None
    if low in _NEVER:
        return -8.0
    if len(token) == 1 and token.isalpha() and not _CJK.match(token):
        # An initial or a spaced abbreviation such as "z. B." and "т. д."
        head = text[max(start, dot - 4):dot]
        if re.search(r"т\. ?[дп]$", head) and (ch.isupper() or ch in _OPEN):
            return 2.5
        return -8.0 if not (token.islower() and ch.isupper() and dot - 2 >= start and text[dot - 2] in ")") else 1.0
    if low == "ex" and re.search(r"(?i)\bp\. ?ex$", text[max(start, dot - 6):dot]):
        return -8.0
    if ch.isdigit():
        if low in _BEFORE_NUMBER or low in _MAYBE:
            return -8.0
        return 0.5 if not token[-1:].isdigit() else -2.0
    if low in _BEFORE_NUMBER and not ch.isupper():
        return -6.0
    if low in _MAYBE or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token):
        return 1.2 if ch.isupper() or ch in _OPEN else -6.0
    if token.isdigit() and len(token) <= 2 and opening.lower() in _MONTHS:
        return -8.0
    if ch.islower():
        if close and close[-1] in ")]":
            return 2.0
        return -2.0 if opening.lower() in _GOES_ON or not token else 1.5
    if close and ch.islower():
        return 1.0
    return 4.0


def _paragraph(text: str, a: int, b: int, found: list[tuple[int, re.Match]], ends: list[int]) -> None:
    """Append the sentence ends of text[a:b], the best chain of spans."""
    while b > a and text[b - 1].isspace():
        b -= 1
    while a < b and text[a].isspace():
        a += 1
    if a >= b:
        return
    points = [(a, 0.0, "")]
    for end, m in found:
        if m.lastgroup in ("thai", "thai2"):
            end = m.start()
        if a < end < b:
            score = _boundary(text, m, end, b, a)
            if score is not None and score > -4.0:
                close = m["close"] or ""
                points.append((end, score, close[-1:]))
    points.append((b, 6.0, text[b - 1]))
    if len(points) == 2:
        ends.append(b)
        return
    marks = _states(text, a, b)
    state, k, current = [], 0, 0
    for at, _, _ in points:
        while k < len(marks) and marks[k][0] <= at:
            current = marks[k][1]
            k += 1
        state.append(current)
    n = len(points)
    best, back = [0.0] + [-1e18] * (n - 1), [0] * n
    for j in range(1, n):
        end, local, closed = points[j]
        low = -1e18
        for i in range(j - 1, -1, -1):
            begin = points[i][0]
            score = best[i] + local
            size = end - begin
            if size > 400:
                score -= 0.004 * (size - 400)
                if i < j - 24 and low > score:
                    break  # only longer, still worse spans follow
            elif size < 8:
                score -= 1.5 if not _CJK.search(text, begin, end) else 0.3
            if state[i] != state[j]:
                score -= 7.0
            if closed and closed in ")）】]" and j < n - 1:
                first = begin
                while first < end and text[first].isspace():
                    first += 1
                # A bracket ends a sentence only where it stands alone.
                score += 1.0 if text[first] in "(（【[" else -5.0
            if score > low:
                low, back[j] = score, i
        best[j] = low
    chain, j = [], n - 1
    while j > 0:
        chain.append(points[j][0])
        j = back[j]
    ends.extend(reversed(chain))


def sentence_ends(text: str) -> list[int]:
    """End offsets (code points, exclusive) of the sentences of a text, in order."""
    ends: list[int] = []
    begin, found = 0, []
    for m in _CANDIDATE.finditer(text):
        if m.lastgroup == "blank":
            _paragraph(text, begin, m.start(), found, ends)
            begin, found = m.end(), []
        else:
            found.append((m.end(), m))
    _paragraph(text, begin, len(text), found, ends)
    return ends


def line_ends(text: str) -> list[int]:
    """End offsets of the non-blank lines of a text without their trailing blanks."""
    return [m.end() for m in re.finditer(r"\S(?:[^\n]*\S)?", text)]


_OUT = pa.schema([("doc_id", pa.int64()), ("sentence_no", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, numbers, starts, stops = [], [], [], []
        for doc_id, text, by_line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            before = 0
            ends = line_ends(text) if by_line else sentence_ends(text)
            for no, end in enumerate(ends, 1):
                while text[before].isspace():
                    before += 1
                ids.append(doc_id)
                numbers.append(no)
                starts.append(before)
                stops.append(end)
                before = end
        yield pa.record_batch([ids, numbers, starts, stops], schema=_OUT)


def sentences(documents: DataFrame) -> DataFrame:
    """The sentences of ``documents(doc_id, text[, form])`` in order.

    Columns: doc_id, sentence_no (from 1), start_pos (code points before the
    first character), end_pos (code points through the last character, closing
    marks included).  Documents of form ``code`` or ``log`` give their lines,
    all others their sentences.  Null ids or texts and blank texts give
    nothing; a doc_id delivered twice counts once (its smallest text); a
    missing form column means prose; other columns are ignored.
    """
    form = F.col("form").cast("string") if "form" in documents.columns else F.lit("prose")
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                              F.coalesce(F.lower(F.trim(form)).isin("code", "log"), F.lit(False)).alias("by_line"))
    kept = source.where("doc_id is not null and text is not null and text <> ''")
    return one_text(kept, "doc_id").mapInArrow(_split, "doc_id bigint, sentence_no int, start_pos bigint, end_pos bigint")
