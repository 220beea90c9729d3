"""Problem 2: checking new batches for duplicates against all history.

Method: exact hashes of normalised content plus paragraph hashes, kept in
bucketed tables that batches append to.  A finding's content is the set of the
distinct tokens of its ``match_context`` under its rule.  A delivery (one batch
or several) is hashed once and meets the tables by joins on their bucket keys:

* ``exact``: fingerprints and blob hashes;
* ``contents``: one row per content hash, with its token hashes;
* ``paragraphs``: hashes of the first and of the last third of a context, which
  a rotated secret in unchanged surroundings leaves alone.

Full copies and shared paragraphs resolve nearly all repeats against one early
representative, so a hot group of near-copies never forms pairs with itself.
Paragraphs cannot prove that nothing was missed, so what is left is compared by
signature keys: two sets that share 0.7 of their tokens share at least two of
the ``n - ceil(0.7 n) + 2`` first ones in any fixed order, and so meet in at
least one key made of such a pair.  Tokens are ordered by how rare their shape
is (long ones with digits first), so keys of common words hardly arise.  Keys
of the history are derived from its stored token hashes; a Bloom filter of the
delivery's keys drops nearly all of them before anything is shuffled.  A 64-bit
parity sketch drops unlike rows inside the join (sets differing in d tokens
differ in at most d bits, so none is lost), and the rest is verified exactly.
Set hashes have 64 bits, token hashes 56.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.storage import fresh_path, stored

# The history comes before every batch, a batch without number after every other.
HISTORY = -1
LAST = 2**31 - 1
# From this many tokens on single tokens are keys; up to PAIRS pairs are.  Sets that can be alike
# are never on different sides: 65 tokens share 0.7 with 46 at least, and 46 have both kinds.
SINGLES, PAIRS = 45, 64
#: Shared over all distinct tokens, as a fraction of integers.
SHARE = (7, 10)
# Bits of the filter over a delivery's keys: 2 MB, however many keys there are.
FILTER_BITS = 1 << 24
# Tables of an index and the column each is bucketed by.
TABLES = {"exact": "key", "contents": "content", "paragraphs": "paragraph"}
_AT = "decimal(32,0)"


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _order(batch: Column, arrival: Column) -> Column:
    """(batch, arrival) as one number that sorts alike; a fixed-width value, so minima aggregate by hash."""
    return (batch.cast("decimal(10,0)") * _whole(1 << 64) + arrival.cast("decimal(20,0)") + _whole(1 << 63)).cast(_AT)


def _tokens(context: Column) -> Column:
    """Token codes in text order: eight bits for the shape, rarest lowest, then 56 of the token's hash."""
    def code(token: Column) -> Column:
        shape = F.lit(127) - F.least(F.length(token), F.lit(63)) - F.when(token.rlike("[0-9]"), 64).otherwise(0)
        return F.shiftleft(shape.cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lower(token)), 8))

    return F.transform(F.regexp_extract_all(context, F.lit("[A-Za-z0-9]+"), F.lit(0)), code)


def contents(rows: DataFrame) -> DataFrame:
    """Rows (rule_id, match_context, at, ...) with a content: its hash, rule hash, token set, paragraph hashes.

    Null rules or contexts and contexts without tokens have none."""
    seen = rows.where("rule_id is not null and match_context is not null").withColumn("_seq", F.explode(F.array(_tokens(F.col("match_context"))))).where("size(_seq) > 0")
    third = F.greatest(F.lit(1), F.expr("cast(size(_seq) / 3 as int)"))
    made = seen.withColumns({
        "tokens": F.array_sort(F.array_distinct("_seq")), "rule": F.xxhash64("rule_id"),
        "head": F.xxhash64("rule_id", F.slice("_seq", F.lit(1), third)), "tail": F.xxhash64(F.lit("tail"), "rule_id", F.slice("_seq", -third, third))})
    return made.withColumn("content", F.xxhash64("rule", "tokens")).drop("rule_id", "match_context", "_seq")


def classes(rows: DataFrame) -> DataFrame:
    """One row per distinct content: content, rule, tokens, first (earliest order), open_first
    (earliest order of an arrival still to decide), head and tail (of one of its contexts)."""
    return contents(rows).groupBy("content", "rule", "tokens").agg(
        F.min("at").alias("first"), F.min(F.when(F.col("open"), F.col("at"))).alias("open_first"), F.min("head").alias("head"), F.min("tail").alias("tail"))


def signature_keys(frame: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, sketch, n and one row per signature key of ``frame(rule, tokens)``."""
    num, den = SHARE
    sized = frame.withColumn("n", F.size("tokens")).withColumn("need", F.expr(f"cast((n * {num} + {den - 1}) div {den} as int)"))
    pairs = """flatten(transform(sequence(1, size(p) - 1), i ->
                 transform(slice(p, i + 1, size(p) - i), y -> xxhash64(rule, p[i - 1], y))))"""
    keys = F.expr(f"""concat(
        case when n between 2 and {PAIRS} then (transform(array(slice(tokens, 1, n - need + 2)), p -> {pairs}))[0] else array() end,
        case when n >= {SINGLES} then transform(slice(tokens, 1, n - need + 1), t -> xxhash64(rule, t)) else array() end)""")
    sketch = F.expr("aggregate(tokens, 0L, (bits, t) -> bits ^ shiftleft(1L, cast(t & 63 as int)))")
    return sized.select(*keep, sketch.alias("sketch"), "n", F.explode(keys).alias("key"))


def may_be_among(key: Column, among: DataFrame, bits: int = FILTER_BITS) -> Column:
    """Whether a bigint may be among the one column of ``among``: a Bloom filter of fixed size, made once.

    It never says no wrongly; with many more keys than bits it says yes to all."""
    jvm = among.sparkSession._jvm
    made, of = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.classic.ExpressionUtils
    column = F.col(among.columns[0])
    agg = made.aggregate.BloomFilterAggregate(of.expression(column._jc), of.expression(F.lit(bits // 8).cast("bigint")._jc), of.expression(F.lit(bits).cast("bigint")._jc))
    filled = among.agg(Column(of.column(agg.toAggregateExpression())).alias("bits")).scalar()
    # Of no keys at all there is no filter and nothing can match.
    return F.coalesce(Column(of.column(made.BloomFilterMightContain(of.expression(filled._jc), of.expression(key._jc)))), F.lit(False))


def _similar(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens is at least SHARE, in integers."""
    num, den = SHARE
    both = F.size(F.array_intersect(a, b))
    return both * den >= (F.size(a) + F.size(b) - both) * num


def _exact_keys(frame: DataFrame, at: Column, fingerprint: str | None, blob: str | None, *keep: str) -> DataFrame:
    """One row per exact key of each row: key (kind and value), first, kept columns."""
    kinds = [F.concat(F.lit("f"), F.col(fingerprint).cast("string"))] if fingerprint else []
    kinds += [F.concat(F.lit("b"), F.lower(F.col(blob).cast("string")))] if blob else []
    return frame.select(at.alias("first"), *keep, F.explode(F.array(*kinds)).alias("key")).where("key is not null")


def _arrivals(batches: DataFrame) -> DataFrame:
    number = F.coalesce(F.col("batch_no").cast("int"), F.lit(LAST))
    return batches.where("arrival_id is not null").select(
        F.col("arrival_id").cast("bigint").alias("arrival"), _order(number, F.col("arrival_id").cast("bigint")).alias("at"),
        (_order(number, F.lit(0))).alias("batch_at"), "fingerprint", "rule_id", "match_context", "blob_hash")


class HistoryIndex:
    """The keys of everything accepted, in bucketed tables that deliveries append to.

    Only a delivery is hashed and shuffled, to the tables' buckets; the history
    is read as stored keys and never read, tokenised or shuffled again.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64) -> None:
        self.spark, self.name, self.path, self.buckets = spark, name, path.rstrip("/"), buckets

    def _append(self, frame: DataFrame, kind: str) -> None:
        """Rows arrive partitioned by the bucket key, so a task writes few buckets."""
        frame.write.mode("append").bucketBy(self.buckets, TABLES[kind]).option("path", f"{self.path}/{kind}").format("parquet").saveAsTable(f"{self.name}_{kind}")

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def _add(self, exact: DataFrame, own: DataFrame) -> None:
        """Append exact keys (key, first) and classes."""
        self._append(exact.groupBy("key").agg(F.min("first").alias("first")), "exact")
        self._append(own.select("content", "rule", "tokens", "first"), "contents")
        self._append(own.select(F.explode(F.array("head", "tail")).alias("paragraph"), "first", "content").repartition(self.buckets, "paragraph"), "paragraphs")

    def add_history(self, findings: DataFrame, blobs: DataFrame) -> None:
        """What was accepted before the first batch: the only pass over it."""
        at = _order(F.lit(HISTORY), F.lit(0))
        exact = _exact_keys(findings, at, "fingerprint", None).unionByName(_exact_keys(blobs, at, None, "blob_hash"))
        rows = findings.select("rule_id", "match_context", at.alias("at"), F.lit(False).alias("open"))
        self._add(exact, stored(classes(rows), "history-contents"))

    def drop(self) -> None:
        """Remove the tables and their files."""
        for kind in TABLES:
            self.spark.sql(f"drop table if exists {self.name}_{kind}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # -- one delivery
    def _by_key(self, rows: DataFrame) -> DataFrame:
        """arrival, by_fingerprint, by_blob of arrivals whose exact keys came earlier."""
        own = _exact_keys(rows, F.col("at"), "fingerprint", "blob_hash", "arrival", "at", "batch_at")
        here = own.groupBy("key").agg(F.min("first").alias("here"))
        # The semi-join and the minimum stay inside the table's buckets.
        before = self.table("exact").join(here.select("key"), "key", "left_semi").groupBy("key").agg(F.min("first").alias("before"))
        first = here.join(before, "key", "left").select("key", F.least("here", "before").alias("known"))  # least passes over nulls
        is_blob = F.startswith("key", F.lit("b"))
        # An earlier batch lies below the batch's own zero by more than any arrival id.
        earlier = F.when(is_blob, F.col("known") < F.col("batch_at") - _whole(1 << 63)).otherwise(F.col("known") < F.col("at"))
        hits = own.join(first, "key").where(earlier)
        return hits.groupBy("arrival").agg(F.max(~is_blob).alias("by_fingerprint"), F.max(is_blob).alias("by_blob"))

    def _near(self, mine: DataFrame) -> DataFrame:
        """content, near: for classes with an open arrival that is the first of its content,
        the earliest class alike, as far as it decides the case."""
        undecided = mine.where("open_first is not null and not (first < open_first)")
        quick = stored(self._verified(self._paragraph_pairs(undecided, mine), undecided, mine), "by-paragraph")
        left = stored(undecided.join(quick, "content", "left").where("near is null or not (near < open_first)").select("content", "rule", "tokens"), "undecided")
        return quick.unionByName(self._verified(self._signature_pairs(left, mine), left, mine)).groupBy("content").agg(F.min("near").alias("near"))

    def _paragraph_pairs(self, left: DataFrame, mine: DataFrame) -> DataFrame:
        """Each class with the earliest class that shares its first or last paragraph."""
        def exploded(frame: DataFrame, *more: str) -> DataFrame:
            return frame.select(F.explode(F.array("head", "tail")).alias("paragraph"), "content", *more)

        asked = exploded(left)
        before = self.table("paragraphs").join(asked.select("paragraph").distinct(), "paragraph", "left_semi")
        # The earliest by two fixed-width minima: its order, then the content of that order.
        every = before.select("paragraph", "first", "content").unionByName(exploded(mine, "first"))
        pivot = every.groupBy("paragraph").agg(F.min(F.struct("first", "content")).alias("p"))
        return asked.join(pivot, "paragraph").select("content", F.col("p.content").alias("other")).where("content <> other").distinct()

    def _signature_pairs(self, left: DataFrame, mine: DataFrame) -> DataFrame:
        """Classes that meet in a signature key and whose sketches allow enough shared tokens."""
        asked = signature_keys(left, "content")
        every = self.table("contents").select("content", "rule", "tokens").unionByName(mine.select("content", "rule", "tokens"))
        keys = signature_keys(every, "content").where(may_be_among(F.col("key"), asked.select("key")))
        theirs = keys.select(F.col("content").alias("other"), F.col("sketch").alias("s2"), F.col("n").alias("n2"), "key")
        num, den = SHARE
        # |x ^ y| <= (n + n2)(den - num)/(den + num); equal rule hashes are part of the key.
        near = (F.bit_count(F.col("sketch").bitwiseXOR(F.col("s2"))) * (den + num) <= (F.col("n") + F.col("n2")) * (den - num)) & (F.col("content") != F.col("other"))
        return asked.join(theirs, "key").where(near).select("content", "other").distinct()

    def _verified(self, pairs: DataFrame, left: DataFrame, mine: DataFrame) -> DataFrame:
        """content, near (earliest order of a class alike) of candidate pairs (content, other).

        Pairs move to the buckets of ``contents``; the table itself stays where it is."""
        asked = pairs.join(left.select("content", "tokens"), "content")

        def met(table: DataFrame) -> DataFrame:
            other = table.select(F.col("content").alias("other"), F.col("tokens").alias("other_tokens"), F.col("first").alias("near"))
            return asked.join(other, "other").where(_similar(F.col("tokens"), F.col("other_tokens"))).select("content", "near")

        return met(self.table("contents")).unionByName(met(mine)).groupBy("content").agg(F.min("near").alias("near"))

    def check_and_add(self, batch: DataFrame) -> DataFrame:
        """The verdicts (as ``check``) of one delivery against all before it; then its keys are appended.

        A delivery is one batch or several; deliveries come in ascending batch_no.
        """
        rows = _arrivals(batch)
        keyed = stored(self._by_key(rows), "known-by-key")
        flagged = rows.select("arrival", "at", "rule_id", "match_context").join(keyed.select("arrival", F.lit(True).alias("_met")), "arrival", "left") \
            .select("rule_id", "match_context", "at", F.col("_met").isNull().alias("open"))
        own = stored(classes(flagged), "contents")
        before = self.table("contents").join(own.select("content"), "content", "left_semi").groupBy("content").agg(F.min("first").alias("before"))
        mine = stored(own.join(before, "content", "left").withColumn("first", F.least("first", "before")).drop("before"), "contents-known")
        known = mine.join(self._near(mine), "content", "left").select("content", F.least("first", "near").alias("known"))
        open_rows = contents(rows.join(keyed.select("arrival"), "arrival", "left_anti").select("rule_id", "match_context", "at", "arrival")).select("content", "at", "arrival")
        by_context = open_rows.join(known, "content").where(F.col("known") < F.col("at")).select("arrival").distinct()
        flags = keyed.unionByName(by_context.withColumn("by_context", F.lit(True)), allowMissingColumns=True)
        flags = flags.groupBy("arrival").agg(*(F.max(c).alias(c) for c in ("by_fingerprint", "by_blob", "by_context")))
        verdicts = rows.select("arrival").distinct().join(flags, "arrival", "left")
        out = verdicts.select(F.col("arrival").alias("arrival_id"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("by_fingerprint", "by_blob", "by_context"))) \
            .withColumn("is_new", ~(F.col("by_fingerprint") | F.col("by_blob") | F.col("by_context")))
        out = stored(out, "verdicts")
        self._add(_exact_keys(rows, F.col("at"), "fingerprint", "blob_hash"), own)
        return out


def check(arrivals: DataFrame, findings: DataFrame, blobs: DataFrame) -> DataFrame:
    """Every arrival of ``finding_batches`` with how it was met before.

    An index is made of the history, all batches are one delivery to it, and it
    is dropped again; a pipeline keeps its index and calls ``check_and_add``.
    Columns: arrival_id, by_fingerprint, by_blob, by_context (looked for only
    where the two others are false), is_new (none of them).  Earlier means
    smaller (batch_no, arrival_id), whether that arrival was itself a repeat or
    not; a null batch_no counts as the last batch; rows without arrival_id are
    left out; null keys match nothing; a row delivered twice comes once.
    """
    spark = arrivals.sparkSession
    index = HistoryIndex(spark, f"driftnet_history_{uuid.uuid4().hex}", fresh_path(spark, "history"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        index.add_history(findings, blobs)
        return index.check_and_add(arrivals)
    finally:
        index.drop()


def refreshed(findings: DataFrame, arrivals: DataFrame) -> DataFrame:
    """fingerprint, first_seen, last_seen of the history after the batches.

    A known fingerprint keeps its first_seen and gets the latest last_seen of
    history and arrivals; a new one enters with its earliest and latest
    observation.  Null fingerprints are left out; null times are ignored.  The
    history is reduced by map-side combine, so a hot fingerprint is one row per
    task before the shuffle.
    """
    old = findings.select("fingerprint", F.col("first_seen").alias("old_first"), F.lit(None).cast("timestamp").alias("seen_first"), F.col("last_seen").alias("seen"))
    new = arrivals.select("fingerprint", F.lit(None).cast("timestamp").alias("old_first"), F.col("observed_at").alias("seen_first"), F.col("observed_at").alias("seen"))
    both = old.unionByName(new).where("fingerprint is not null")
    return both.groupBy("fingerprint").agg(F.min("old_first").alias("o"), F.min("seen_first").alias("s"), F.max("seen").alias("last_seen")) \
        .select("fingerprint", F.coalesce("o", "s").alias("first_seen"), "last_seen")
