"""Problem 7: mixing sources to target shares of the total size in tokens.

Method: tokens are counted per document with a public tokenizer and summed per
source; a source's rate is its target share of the total over what it has, at
most its cap; each document comes floor(rate) times, and once more when a hash
of its id and the seed falls below the fraction.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.llm.common import one_text
from driftnet.storage import stored

# Path of a public byte-level BPE vocabulary (ranks); a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The published split pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A targets table larger than this is no configuration.
MAX_SOURCES = 10_000


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text; null for null, 0 for an empty text."""
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(encoding.encode_ordinary(t))).astype("Int64")

    return count(text)


def source_key(column: Column) -> Column:
    """A source name without letter case and outer blanks."""
    return F.lower(F.trim(column))


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (normalised), n_tokens of each document, written once to
    the shared folder so that totals and drawing do not tokenize twice."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source").cast("string")).alias("source"), F.col("text").cast("string").alias("text"))
    once = one_text(source.where("doc_id is not null and source is not null and text is not null"), "doc_id")
    return stored(once.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n_tokens")), "token-counts")


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """Per source of ``targets``: its target, cap, documents, tokens and rate.

    The total is ``total_tokens`` or else the tokens of all documents of sources
    with a target.  A source with too little comes as often as its cap allows
    and so falls short; the others keep their share of the total.  Targets are
    summed over repeated source names (smallest cap), nulls and shares of 0 or
    less are left out, and shares are scaled to sum to 1.
    """
    wanted = targets.select(source_key(F.col("source").cast("string")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap")) \
        .where("source is not null and share > 0").dropDuplicates().groupBy("source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    rows = wanted.join(have, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    whole = sum(r["share"] for r in rows) or 1.0
    total = total_tokens if total_tokens is not None else sum(r["tokens"] or 0 for r in rows)
    out = []
    for r in sorted(rows, key=lambda r: r["source"]):
        tokens = r["tokens"] or 0
        cap = max(0, r["cap"] if r["cap"] is not None else 1)
        share = r["share"] / whole
        out.append({"source": r["source"], "target_share": share, "max_repeats": cap, "n_docs": r["n_docs"] or 0, "tokens": tokens,
                    "rate": min(cap, share * total / tokens) if tokens else 0.0, "total": total})
    return out


def _rate_table(sizes: DataFrame, rows: list[dict]) -> DataFrame:
    """source, rate: as many rows as the targets, of which there are MAX_SOURCES at most."""
    return sizes.sparkSession.createDataFrame([(r["source"], float(r["rate"])) for r in rows], "source string, rate double")


def _drawn(sizes: DataFrame, rows: list[dict], seed: int) -> DataFrame:
    """doc_id, source, n_tokens, copies of each document of a source with a target."""
    rate = F.col("rate")
    # 52 bits of a hash of id and seed as a number in [0, 1): the same on every run and machine.
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    rated = sizes.join(F.broadcast(_rate_table(sizes, rows)), "source")
    return rated.select("doc_id", "source", "n_tokens", (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int").alias("copies"))


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY, total_tokens: int | None = None) -> DataFrame:
    """The drawn mixture: doc_id, source, copy_no (from 1), n_tokens.

    A document never comes more often than its source's cap.  Documents with a
    null id, text or source or of a source without target are not drawn; a
    doc_id delivered twice counts once (smallest source, then text); join on
    doc_id for the texts.
    """
    sizes = sized(documents, vocabulary)
    drawn = _drawn(sizes, rates(sizes, targets, total_tokens), seed).where("copies > 0")
    return drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY, total_tokens: int | None = None) -> DataFrame:
    """Per source of the targets: what was asked for and what was drawn.

    Columns: source, target_share, max_repeats, n_docs, available_tokens, rate,
    drawn_docs (copies counted), drawn_tokens, share_of_total (of the total
    asked for), actual_share (of what was drawn).  A source without documents
    has zeros.
    """
    sizes = sized(documents, vocabulary)
    rows = rates(sizes, targets, total_tokens)
    got = _drawn(sizes, rows, seed).groupBy("source").agg(F.sum("copies").cast("bigint").alias("drawn_docs"), F.sum(F.col("copies") * F.col("n_tokens")).cast("bigint").alias("drawn_tokens"))
    spark = documents.sparkSession
    schema = "source string, target_share double, max_repeats int, n_docs bigint, available_tokens bigint, rate double, total double"
    asked = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["n_docs"], r["tokens"], float(r["rate"]), float(r["total"])) for r in rows], schema)
    joined = asked.join(got, "source", "left").na.fill(0, ["drawn_docs", "drawn_tokens"])
    # One row per source of a bounded table: a global sum over it is small.
    everything = joined.agg(F.sum("drawn_tokens").alias("all_tokens")).collect()[0]["all_tokens"] or 0
    share = F.lit(0.0) if not everything else F.col("drawn_tokens") / F.lit(float(everything))
    of_total = F.when(F.col("total") > 0, F.col("drawn_tokens") / F.col("total")).otherwise(0.0)
    return joined.select("source", "target_share", "max_repeats", "n_docs", "available_tokens", "rate", "drawn_docs", "drawn_tokens", of_total.alias("share_of_total"), share.alias("actual_share"))
