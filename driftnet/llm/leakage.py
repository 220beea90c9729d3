"""Problem 6: evaluation passages that leaked into training text.

Method: SimHash.  Every window of ``passage_words`` words of every evaluation
item gets a 64-bit fingerprint, and so does every window of every document.  A
multi-index over ``radius + 1`` bit blocks guarantees that every pair of windows
within the Hamming radius meets in at least one block.  The pairs that meet are
then verified exactly: same words in the same order for passages, weighted
shingle similarity for near passages.

The item side is small by nature.  It is indexed in blocks of bounded size and
each block is broadcast; documents are never shuffled, only the found pairs
are.  A document is processed whole, in vectorised numpy, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.storage import spread

# Words are runs of letters and digits, compared in lower case.
WORD = re.compile(r"[^\W_]+")
# Item windows per broadcast block: 24 bytes each, so a block stays near 25 MB.
BLOCK_WINDOWS = 1_000_000
# Words fingerprinted at once; bounds the bit matrix to about 40 MB.
_CHUNK = 60_000
# Meetings of windows in a block compared at once (about 100 MB), but for one row's at least.
_MEETINGS = 2_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Hashes(dict):
    """Word -> row of the table of word hashes; forgets when it grows too large."""

    def __init__(self) -> None:
        self.table = np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = row
        return row

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 2_000_000:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[rows]


def fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each run of ``width`` word hashes (one vote per word and bit)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _CHUNK):
        part = hashes[a:a + _CHUNK + width - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        total = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
        votes = total[width:] - total[:-width]
        out[a:a + len(votes)] = np.packbits(votes * 2 > width, axis=1).view(np.uint64).ravel()
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Index:
    """Multi-index over the bit blocks of a set of fingerprints."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            bits = min(int(high - low), 20)  # a wider block is looked up by its low 20 bits
            key = ((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(key, kind="stable").astype(np.int32)
            starts = np.searchsorted(key[order], np.arange((1 << bits) + 1)).astype(np.int32)
            self.blocks.append((np.uint64(low), np.uint64((1 << bits) - 1), order, starts))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row of prints, row of the index) within the radius."""
        left, right = [], []
        for low, mask, order, starts in self.blocks:
            key = ((prints >> low) & mask).astype(np.int64)
            count = starts[key + 1] - starts[key]
            hit = np.flatnonzero(count)
            # Cut where the meetings, not the rows, reach a bound: a block many windows share stays small in memory.
            met = np.cumsum(count[hit])
            cuts = np.searchsorted(met, np.arange(_MEETINGS, (met[-1] if len(met) else 0) + _MEETINGS, _MEETINGS))
            for rows in np.split(hit, np.unique(np.minimum(cuts + 1, len(hit)))):
                n = count[rows]
                who = np.repeat(rows, n)
                offset = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                item = order[np.repeat(starts[key[rows]], n) + offset]
                keep = _popcount(prints[who] ^ self.prints[item]) <= self.radius
                left.append(who[keep])
                right.append(item[keep])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def weighted_similarity(a: list[str], b: list[str], shingle: int = 5) -> float:
    """Weighted Jaccard of two texts' word shingles; a shingle weighs its number of letters."""
    def bag(words: list[str]) -> dict[tuple[str, ...], int]:
        out: dict[tuple[str, ...], int] = {}
        for i in range(max(1, len(words) - shingle + 1)):
            key = tuple(words[i:i + shingle])
            out[key] = out.get(key, 0) + sum(map(len, key))
        return out

    x, y = bag(a), bag(b)
    low = sum(min(w, y.get(k, 0)) for k, w in x.items())
    high = sum(x.values()) + sum(y.values()) - low
    return low / high if high else 0.0


def _item_blocks(items: DataFrame, width: int) -> Iterator[tuple[np.ndarray, list[list[str]], np.ndarray, np.ndarray]]:
    """(item ids, words per item, windows' item number, windows' offset), in blocks.

    Rows are streamed to the driver partition by partition and cut into blocks of
    at most BLOCK_WINDOWS windows, so memory is bounded however many items come."""
    ids: list[int] = []
    texts: list[list[str]] = []
    windows = 0

    def block() -> tuple[np.ndarray, list[list[str]], np.ndarray, np.ndarray]:
        sizes = np.array([max(0, len(w) - width + 1) for w in texts])
        number = np.repeat(np.arange(len(texts)), sizes)
        offset = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.array(ids, np.int64), texts, number, offset

    for row in items.toLocalIterator(prefetchPartitions=True):
        words = words_of(row["text"])
        if len(words) < width:
            continue
        ids.append(row["item_id"])
        texts.append(words)
        windows += len(words) - width + 1
        if windows >= BLOCK_WINDOWS:
            yield block()
            ids, texts, windows = [], [], 0
    if ids:
        yield block()


_SCHEMA = "doc_id bigint, item_id bigint, n_windows int, longest_run int, similarity double"
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int32()), ("longest_run", pa.int32()), ("similarity", pa.float64())])


def leaks(documents: DataFrame, items: DataFrame, passage_words: int = 13, radius: int = 3, near: float = 0.8) -> DataFrame:
    """Every (document, item) pair in which the document holds part of the item.

    Columns: doc_id, item_id, n_windows (windows of the document that equal one
    of the item's, word for word, in order), longest_run (most consecutive
    equal words, 0 if none reaches ``passage_words``), similarity (best weighted
    similarity of five-word shingles between two windows within the radius).  A
    pair is kept if longest_run is at least ``passage_words`` or similarity at
    least ``near``.

    All windows equal word for word have equal fingerprints, so none is missed.
    Near windows mostly lie outside the radius: a changed word flips about 7 bits.
    Items and documents with fewer words, null ids or null texts match nothing;
    repeated rows count once; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = spread(docs.where("doc_id is not null and text is not null and text <> ''"))
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    wanted = wanted.where("item_id is not null and text is not null").dropDuplicates()
    context = docs.sparkSession.sparkContext
    found = None
    for ids, texts, number, offset in _item_blocks(wanted, passage_words):
        prints = np.concatenate([fingerprints(_Hashes().of(words), passage_words) for words in texts])
        shared = context.broadcast((ids, texts, number, offset, prints))
        part = docs.mapInArrow(_scanner(shared, passage_words, radius, near), _SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("longest_run").alias("longest_run"), F.max("similarity").alias("similarity"))


def _scanner(shared, width: int, radius: int, near: float):  # noqa: ANN001, ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, number, offset, prints = shared.value
        index, hashes = Index(prints, radius), _Hashes()
        for batch in batches:
            doc_ids, words, begins = [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                words += words_of(text)
                begins.append(len(words))
            rows: list[tuple[int, int, int, int, float]] = []
            if len(words) >= width:
                at, window = index.near(fingerprints(hashes.of(words), width))
                edges = np.array(begins)
                doc = np.searchsorted(edges, at, side="right") - 1
                inside = at + width <= edges[doc + 1]  # windows over two documents are none
                frame = pd.DataFrame({"doc": doc[inside], "at": at[inside], "item": number[window[inside]], "off": offset[window[inside]]})
                for (d, i), group in frame.groupby(["doc", "item"], sort=False):
                    rows.append((doc_ids[d], int(ids[i]), *_verify(words, texts[i], group["at"].to_numpy(), group["off"].to_numpy(), width, near)))
            rows = [r for r in rows if r[3] >= width or r[4] >= near]
            yield pa.record_batch([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5, schema=_OUT)

    return scan


def _verify(words: list[str], item: list[str], at: np.ndarray, off: np.ndarray, width: int, near: float) -> tuple[int, int, float]:
    """(equal windows, longest run of equal words, best similarity) of candidate windows."""
    equal: dict[int, list[int]] = {}
    positions, best = set(), 0.0
    for a, o in zip(at.tolist(), off.tolist(), strict=True):
        x, y = words[a:a + width], item[o:o + width]
        if x == y:
            equal.setdefault(a - o, []).append(a)
            positions.add(a)
            best = 1.0
        elif best < 1.0:
            best = max(best, weighted_similarity(x, y))
    longest = 0
    for starts in equal.values():
        starts.sort()
        run = 1
        for before, now in zip([None, *starts[:-1]], starts, strict=True):
            run = run + 1 if before is not None and now == before + 1 else 1
            longest = max(longest, run + width - 1)
    return len(positions), longest, best
