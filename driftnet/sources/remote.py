"""Object stores and code hosts.

A bucket is a path Spark reads (s3a, gs); issue trackers are JSON files or a
data source whose pages a caller's function gives, so nothing here opens a
connection by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_OBJECT = 64 << 20


def parse_bucket(uri: str) -> tuple[str, str, str]:
    """(scheme Spark reads, bucket, prefix) of an s3, gs or gcs address."""
    scheme, _, rest = uri.partition("://")
    bucket, _, prefix = rest.partition("/")
    if scheme not in ("s3", "s3a", "gs", "gcs") or not bucket:
        raise ValueError(f"no bucket address: {uri}")
    return {"s3": "s3a", "s3a": "s3a", "gs": "gs", "gcs": "gs"}[scheme], bucket, prefix


def bucket_objects(spark: SparkSession, uri: str) -> tuple[DataFrame, DataFrame]:
    """(objects(path, content), errors(source_path, message)); large ones are errors and are not read."""
    scheme, bucket, prefix = parse_bucket(uri)
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{scheme}://{bucket}/{prefix}")
    return every.where(F.col("length") <= MAX_OBJECT), every.where(F.col("length") > MAX_OBJECT).select(F.col("path").alias("source_path"), F.lit("object too large").alias("message"))


def issue_blobs(raw: DataFrame) -> DataFrame:
    """Blobs of ``raw(repo, label, number, body)``: logical_path github://repo/label/number; empty bodies give none."""
    return raw.where("body is not null and trim(body) <> ''").select(F.concat_ws("/", F.lit("github:/"), "repo", "label", F.col("number").cast("string")).alias("logical_path"), F.col("body").alias("text"))


def paged_source(name: str, fetch: Callable[[str, int], list[tuple]], columns: str, pages: int = 50) -> type[DataSource]:
    """A data source over paged lists: ``fetch(endpoint, page)`` gives rows, an empty list ends.

    Register the class with ``spark.dataSource.register`` and load with option
    ``endpoints`` (comma separated); every endpoint is a partition."""
    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.endpoints = [e for e in options.get("endpoints", "").split(",") if e]

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(e) for e in self.endpoints]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for page in range(1, pages + 1):
                rows = fetch(partition.value, page)
                if not rows:
                    return
                yield from rows

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader(self.options)

    return Source
