"""Command line: ``python -m driftnet scan PATH``, ``rules``, ``classify PATH...``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.functions import scope
from driftnet.functions import text as tx
from driftnet.operators import findings as found
from driftnet.operators import report
from driftnet.operators.runs import ScanState
from driftnet.operators.scan import ScanOptions, scan
from driftnet.plans import rules
from driftnet.sources import files, git
from driftnet.storage import stored


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="driftnet")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan", help="scan files, a bucket path, a saved image or a repository")
    one.add_argument("path")
    one.add_argument("--as", dest="kind", choices=("files", "image", "git-history", "staged"), default="files")
    one.add_argument("--since", help="commit after which history counts")
    one.add_argument("-f", "--format", choices=("table", "json", "sarif", "summary"), default="table")
    one.add_argument("-o", "--output", help="folder for json or sarif")
    one.add_argument("--max-rows", type=int, default=50)
    one.add_argument("--min-confidence", type=float, default=0.4)
    one.add_argument("--min-severity", choices=tuple(tx.SEVERITY_RANK), default="low")
    one.add_argument("--fail-on", choices=tuple(tx.SEVERITY_RANK), default="high")
    one.add_argument("--baseline")
    one.add_argument("--only-actionable", action="store_true")
    for name in ("rules", "exclude-rules", "include", "exclude", "category", "rule-pack"):
        one.add_argument(f"--{name}", action="append", default=[])
    for name in ("no-entropy", "no-decoders", "no-regex", "no-keyname", "scope-only", "all-dirs", "no-hidden"):
        one.add_argument(f"--{name}", action="store_true")
    one.add_argument("--words", help="file of words that mark a value as a name")
    one.add_argument("--max-file-size", type=int, default=files.Limits.file_bytes)
    one.add_argument("--archive-depth", type=int, default=files.Limits.depth)
    one.add_argument("--db", help="folder with the state of earlier scans: only new and changed files are scanned, the others' findings are carried")
    one.add_argument("--new-only", action="store_true", help="with --db: only findings no earlier scan has seen")
    one.add_argument("--errors", help="folder for what could not be read (JSON); by default it is shown")
    one.add_argument("--show-secrets", action="store_true", help="do not redact; never with --db")
    commands.add_parser("rules", help="list the built-in rules")
    commands.add_parser("classify", help="categories of paths").add_argument("paths", nargs="+")
    return parser


def _files(spark: SparkSession, args: argparse.Namespace, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(blobs, errors) of files under a path, or of those of them that ``paths`` names."""
    limits = files.Limits(file_bytes=args.max_file_size, depth=args.archive_depth)
    listed = _listed(spark, args)
    if paths is not None:
        listed = listed.join(paths, "path", "left_semi")
    small, large = files.readable(listed, limits)
    if args.kind == "image":
        return files.image_blobs(small, args.path.rsplit("/", 1)[-1].removesuffix(".tar"), limits), large
    leaves = files.unpacked(small, limits)
    errors = large.unionByName(leaves.where("message <> ''").select(F.col("logical_path").alias("source_path"), "message"))
    return files.pieces(files.texts(leaves), limits), errors


def _listed(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return files.walk(spark, args.path, args.include, args.exclude, args.category or None, args.scope_only, args.all_dirs, not args.no_hidden)


def _scanned(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame | None]:
    """(findings, errors) of what the arguments name."""
    options = _options(args)
    if args.kind == "git-history":
        return scan(git.history_blobs(spark, args.path, args.since), replace(options, keep=("git", "first_commit", "age_days"))), None
    if args.kind == "staged":
        return scan(git.staged_blobs(spark, args.path), options), None
    if not args.db:
        blobs, errors = _files(spark, args)
        return scan(blobs, options), errors
    listing = _listed(spark, args).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return ScanState(spark, args.db).run(listing, lambda paths: scan(_files(spark, args, paths)[0], options)), _files(spark, args)[1]


def _options(args: argparse.Namespace) -> ScanOptions:
    chosen = rules.select_rules(include=args.rules, exclude=args.exclude_rules)
    for path in args.rule_pack:
        chosen = rules.with_pack(chosen, rules.load_pack(path)[0])
    words: list[str] = []
    if args.words:
        with open(args.words, encoding="utf-8") as lines:
            words = [w.strip() for w in lines if w.strip()]
    return ScanOptions(tuple(chosen), args.min_confidence, args.min_severity, not args.no_regex, not args.no_entropy, not args.no_keyname, not args.no_decoders, words=tuple(words), redact=not args.show_secrets)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; 0 no finding as severe as --fail-on, 1 some, 2 wrong use."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("driftnet").getOrCreate()
    if args.command == "rules":
        print("\n".join(f"{r.severity:9}{r.confidence:5.2f}  {r.rule_id}" for r in rules.BUILT_IN))
        return 0
    if args.command == "classify":
        rows = spark.createDataFrame([(p,) for p in args.paths], "p string")
        kinds = scope.categories(F.col("p"))
        for r in rows.select("p", F.array_join(kinds, ",").alias("k"), scope.boost(kinds).alias("b"), scope.allowed(F.col("p")).alias("a")).collect():
            print(f"{r['p']}\t{r['k'] or '-'}\t{r['b']:.2f}\t{'scanned' if r['a'] else 'skipped'}")
        return 0
    if (args.new_only and not args.db) or (args.show_secrets and args.db):
        print("--new-only needs --db, and a --db never holds secrets", file=sys.stderr)
        return 2
    result, errors = _scanned(spark, args)
    if args.baseline:
        result = found.without_baseline(result, report.load_baseline(spark, args.baseline))
    if args.new_only:
        result = result.where("is_new")
    if args.only_actionable:
        result = result.where(tx.actionability_rank(F.col("actionability")) >= 2)
    result = stored(result, "scan")  # scanned once, however often it is read below
    if args.format == "table":
        print(report.table_text(result, args.max_rows, False))
    elif args.format == "summary":
        for r in report.summary(result).collect():
            print(f"{r['kind']}\t{r['name']}\t{r['n']}")
    elif args.output is None:
        print("json and sarif need --output", file=sys.stderr)
        return 2
    elif args.format == "json":
        report.json_rows(result, False).select("document").write.text(args.output)
    else:
        report.write_sarif(result, args.output)
    if errors is not None and args.errors:
        errors.write.mode("overwrite").json(args.errors)
    elif errors is not None:
        for r in errors.groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.min("source_path").alias("first")).orderBy("message").collect():
            print(f"not read: {r['message']} ({r['n']}, first {r['first']})", file=sys.stderr)
    return report.exit_code(result, args.fail_on)


if __name__ == "__main__":
    sys.exit(main())
