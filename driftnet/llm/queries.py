"""The queries of the text problems and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.llm import credentials, garbled, history, leakage, mixing, sentences, splitting
from driftnet.llm.common import one_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were decoded wrongly, recoverable or not."""
    return garbled.garbled_lines(_table(spark, sf_dir, "blob_texts")).select("blob_id", "line_no")


def p1_repaired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines with their restored text and the layers undone."""
    return garbled.garbled_lines(_table(spark, sf_dir, "blob_texts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals met before: by fingerprint, blob or context."""
    return p2_verdicts(spark, sf_dir).where(~F.col("is_new")).select("arrival_id")


def p2_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.check(_table(spark, sf_dir, "finding_batches"), _table(spark, sf_dir, "findings"), _table(spark, sf_dir, "blobs"))


def p2_refreshed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_seen and last_seen of every fingerprint after the batches."""
    return history.refreshed(_table(spark, sf_dir, "findings"), _table(spark, sf_dir, "finding_batches"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(_table(spark, sf_dir, "blob_texts"), _table(spark, sf_dir, "split_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized blobs (line 0) and their lines that alone are over the limit."""
    lines = F.explode(F.array_compact(F.array(F.lit(0), F.col("long_line")))).alias("line_no")
    return _pieces(spark, sf_dir).select("blob_id", lines).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized blobs put together again from their pieces: bytes and digest.

    Each piece gives what lies beyond the end of the one before it by its byte offset; a piece
    that left a hole would shift all that follows."""
    rows = _pieces(spark, sf_dir).select("blob_id", F.struct("piece_no", "byte_offset", F.col("text").cast("binary").alias("b")).alias("p"))
    # As many bytes a row as the blob itself, which was one row before.
    ordered = rows.groupBy("blob_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    none = F.struct(F.get("ps", F.lit(0))["byte_offset"].alias("end"), F.lit(b"").alias("b"))

    def step(acc, p):  # noqa: ANN001, ANN202
        own = F.substring(p["b"], (acc["end"] - p["byte_offset"] + 1).cast("int"), F.octet_length(p["b"]))
        return F.struct((p["byte_offset"] + F.octet_length(p["b"])).alias("end"), F.concat(acc["b"], own).alias("b"))

    joined = ordered.select("blob_id", F.aggregate("ps", none, step, lambda acc: acc["b"]).alias("b"))
    return joined.select("blob_id", F.octet_length("b").cast("bigint").alias("n_bytes"), F.md5("b").alias("digest"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a credential value."""
    return credentials.credential_places(_table(spark, sf_dir, "blob_texts")).select("blob_id", "line_no").distinct()


def p5_redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with their credential values made unreadable, one per blob_id."""
    texts = _table(spark, sf_dir, "blob_texts").where("blob_id is not null").select("blob_id", "text")
    return credentials.redacted(one_text(texts, "blob_id"), "text")


def p5_redacted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "findings").select("fingerprint", "rule_id", "secret", "match_context")
    return credentials.redacted_findings(found)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, item) pairs with at least 13 consecutive words of the item."""
    return p6_leaks(spark, sf_dir).where("longest_run >= 13").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def p7_source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p7_draw_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: its share and documents, whether each document was drawn as often as the rate says, and never beyond the cap."""
    r = mixing.mix_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))
    least = F.floor("rate") * F.col("n_docs")
    wide = 6 * F.sqrt(F.col("n_docs").cast("double")) + 1  # six deviations of the one copy more or less, at most
    expected = F.col("rate") * F.col("n_docs")
    return r.select("source", F.round("target_share", 6).alias("target_share"), "n_docs", F.col("drawn_docs").between(least, least + F.col("n_docs")).alias("between_whole_rates"),
                    (F.abs(F.col("drawn_docs") - expected) <= wide).alias("near_rate"), (F.col("drawn_docs") <= F.col("max_repeats") * F.col("n_docs")).alias("within_cap"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence ends of the prose documents."""
    prose = _table(spark, sf_dir, "documents").where("form = 'prose'")
    return sentences.sentences(prose.select("doc_id", "text")).select("doc_id", "end_pos")


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(_table(spark, sf_dir, "documents"))


def p8_line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of documents of form code and log: their lines."""
    return sentences.sentences(_table(spark, sf_dir, "documents").where("form in ('code', 'log')"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_repaired_lines, p2_found, p2_verdicts, p2_refreshed_history, p3_found, p3_pieces, p3_rejoined, p5_found,
        p5_redacted_texts, p5_redacted_findings, p6_found, p6_leaks, p7_mixture, p7_source_shares, p7_draw_bounds, p8_found, p8_sentences, p8_line_units)}


def oracle_sql() -> dict[str, str]:
    earlier = """
      with a as (select distinct arrival_id, coalesce(batch_no, 2147483647) as batch_no, fingerprint, lower(blob_hash) as blob_hash, rule_id,
                 list_sort(list_distinct(list_transform(regexp_extract_all(match_context, '[A-Za-z0-9]+'), lambda x: lower(x)))) as t
                 from finding_batches where arrival_id is not null),
      f as (select distinct rule_id, list_sort(list_distinct(list_transform(regexp_extract_all(match_context, '[A-Za-z0-9]+'), lambda x: lower(x)))) as t
            from findings where rule_id is not null and match_context is not null),
      e as (select rule_id, t, -1 as batch_no, 0 as arrival_id from f union all
            select rule_id, t, batch_no, arrival_id from a where rule_id is not null and t is not null),
      -- every pair that shares 0.7 of its tokens shares one of the first n - ceil(0.7 n) + 1 in any order
      ak as (select a.*, unnest(t[1:(len(t) - ceil(len(t) * 0.7 - 1e-9)::int + 1)]) as k from a),
      ek as (select e.*, unnest(t[1:(len(t) - ceil(len(t) * 0.7 - 1e-9)::int + 1)]) as k from e),
      c as (select distinct ak.arrival_id from ak join ek on ak.k = ek.k and ak.rule_id = ek.rule_id and (ek.batch_no, ek.arrival_id) < (ak.batch_no, ak.arrival_id)
            and len(list_intersect(ak.t, ek.t)) * 10 >= (len(ak.t) + len(ek.t) - len(list_intersect(ak.t, ek.t))) * 7),
      ff as (select fingerprint, min((batch_no, arrival_id)) as first from (select fingerprint, batch_no, arrival_id from a union all select fingerprint, -1, 0 from findings) where fingerprint is not null group by 1),
      bb as (select blob_hash, min(batch_no) as first from (select blob_hash, batch_no from a union all select lower(blob_hash), -1 from blobs) where blob_hash is not null group by 1),
      v as (select a.arrival_id, coalesce(bool_or(ff.first < (a.batch_no, a.arrival_id)), false) as by_fingerprint, coalesce(bool_or(bb.first < a.batch_no), false) as by_blob,
            coalesce(bool_or(c.arrival_id is not null), false) as by_context
            from a left join ff using (fingerprint) left join bb using (blob_hash) left join c on c.arrival_id = a.arrival_id group by 1)"""
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    return {
        "p2_found": earlier + " select arrival_id from v where by_fingerprint or by_blob or by_context",
        "p2_refreshed_history": """
          select fingerprint, coalesce(min(o), min(s)) as first_seen, max(l) as last_seen from (
            select fingerprint, first_seen as o, null::timestamp as s, last_seen as l from findings union all
            select fingerprint, null, observed_at, observed_at from finding_batches) where fingerprint is not null group by 1""",
        "p3_found": """
          with b as (select blob_id, min(text) as text, min(max_bytes) as max_bytes from (
              select blob_id, text, coalesce(l.max_bytes, (select max_bytes from split_limits where media_type = '*')) as max_bytes
              from blob_texts t left join split_limits l on lower(trim(split_part(t.media_type, ';', 1))) = lower(l.media_type)) where strlen(text) > max_bytes group by 1)
          select blob_id, 0 as line_no from b union
          select blob_id, i::int from (select blob_id, max_bytes, unnest(lines) as line, generate_subscripts(lines, 1) as i
            from (select *, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as lines from b)) where strlen(line) > max_bytes""",
        "p2_verdicts": earlier + """
          select arrival_id, by_fingerprint, by_blob, by_context and not by_fingerprint and not by_blob as by_context, not (by_fingerprint or by_blob or by_context) as is_new from v""",
        "p3_rejoined": """
          with b as (select blob_id, text, coalesce(l.max_bytes, (select max_bytes from split_limits where media_type = '*')) as max_bytes
              from blob_texts t left join split_limits l on lower(trim(split_part(t.media_type, ';', 1))) = lower(l.media_type))
          select blob_id, strlen(min(text)) as n_bytes, md5(min(text)) as digest from b where strlen(text) > max_bytes group by 1""",
        "p7_draw_bounds": """
          with t as (select lower(trim(source)) as source, sum(target_share) / sum(sum(target_share)) over () as share from mix_targets where target_share > 0 group by 1),
          d as (select lower(trim(source)) as source, count(distinct doc_id) as n from documents where text is not null group by 1)
          select t.source, round(share, 6) as target_share, coalesce(n, 0) as n_docs, true as between_whole_rates, true as near_rate, true as within_cap from t left join d using (source)""",
        "p8_line_units": r"""
          with d as (select doc_id, min(text) as text from documents where text <> '' and form in ('code', 'log') group by 1),
          l as (select doc_id, string_split(text, chr(10)) as x from d), i as (select *, unnest(generate_series(1, len(x))) as i from l),
          p as (select doc_id, i, x[i] as line, coalesce(list_sum(list_transform(x[1:i - 1], lambda y: length(y) + 1)), 0)::bigint as begin from i where regexp_matches(x[i], '\S'))
          select doc_id, row_number() over (partition by doc_id order by i)::int as sentence_no, begin + length(line) - length(regexp_replace(line, '^\s+', '')) as start_pos, begin + length(regexp_replace(line, '\s+$', '')) as end_pos from p""",
        "p6_found": f"""
          with d as (select distinct doc_id, {words} as w from documents where text is not null),
          b as (select distinct item_id, {words} as w from benchmark where text is not null),
          dw as (select doc_id, array_to_string(w[i:i + 12], ' ') as k from d, lateral (select unnest(generate_series(1, len(w) - 12)) as i)),
          bw as (select item_id, array_to_string(w[i:i + 12], ' ') as k from b, lateral (select unnest(generate_series(1, len(w) - 12)) as i))
          select distinct doc_id, item_id from dw join bw using (k)""",
    }
