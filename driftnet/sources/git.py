"""Git history and the index as blobs.

The driver lists commits and entries (text of bounded size per commit); contents
are fetched by the tasks, one ``cat-file --batch`` each, and every blob once.
The repository must be readable at the same path on all executors.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, text=True, errors="replace").stdout


def commits(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """commit, author, email, date, message, seq (0 newest) of all non-merge commits."""
    out = _git(root, "log", "--no-merges", "--format=%H%x1f%an%x1f%ae%x1f%aI%x1f%s", *([f"{since}..HEAD"] if since else ["--all"]))
    rows = [(*line.split("\x1f", 4), i) for i, line in enumerate(out.splitlines()) if line.count("\x1f") >= 4]
    return spark.createDataFrame(rows, "commit string, author string, email string, date string, message string, seq int")


def entries(of: DataFrame, root: str) -> DataFrame:
    """commit, path, sha of the files each commit added or modified; listed by the tasks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for commit in batch["commit"]:
                for line in _git(root, "diff-tree", "--root", "-r", "--no-commit-id", "--diff-filter=AM", commit).splitlines():
                    meta, path = line.split("\t", 1)
                    rows.append((commit, path, meta.split(" ")[3]))
            yield pd.DataFrame(rows, columns=["commit", "path", "sha"])

    return of.select("commit").mapInPandas(run, "commit string, path string, sha string")


def history_blobs(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """One blob per sha: logical_path ``root@commit12:path``, text, git struct of its newest commit, first_commit of the oldest."""
    listed = commits(spark, root, since)
    joined = entries(listed, root).join(listed, "commit")
    best = joined.groupBy("sha").agg(F.min_by(F.struct("commit", "author", "email", "date", "message", "path"), F.struct("seq", "path")).alias("g"), F.max_by("commit", "seq").alias("first_commit"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = "".join(f"{s}\n" for s in batch["sha"]).encode()
            out = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=asked, capture_output=True, check=True).stdout
            at, bodies = 0, []
            for _ in range(len(batch)):
                end = out.index(b"\n", at)
                size = int(out[at:end].split()[-1]) if b" missing" not in out[at:end] else 0
                bodies.append(out[end + 1:end + 1 + size])
                at = end + 1 + size + (1 if size or b" missing" not in out[at:end] else 0)
            yield pd.DataFrame({"sha": batch["sha"], "content": bodies})

    contents = best.select("sha").mapInPandas(fetch, "sha string, content binary")
    name = F.concat(F.lit(root), F.lit("@"), F.substring("g.commit", 1, 12), F.lit(":"), F.col("g.path"))
    from driftnet.functions.ingest import looks_binary, text_of

    rows = best.join(contents, "sha").where(~looks_binary(F.col("content")))
    age = F.datediff(F.current_date(), F.to_date(F.to_timestamp("g.date")))
    return rows.select(name.alias("logical_path"), F.col("g.path").alias("source_path"), text_of(F.col("content")).alias("text"), F.struct("g.commit", "g.author", "g.email", "g.date", "g.message").alias("git"), "first_commit", age.alias("age_days"))


def staged_blobs(spark: SparkSession, root: str) -> DataFrame:
    """Blobs of the index: files added, copied or modified against HEAD."""
    names = [n for n in _git(root, "diff", "--cached", "--name-only", "--diff-filter=ACM", "-z").split("\0") if n]

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"logical_path": batch["logical_path"], "text": [_git(root, "show", f":{p}") for p in batch["logical_path"]]})

    return spark.createDataFrame([(n,) for n in names], "logical_path string").mapInPandas(fetch, "logical_path string, text string")
