"""Commands: python -m spanloom <command> --help."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from spanloom.config import RankingConfig
from spanloom.functions.text import preview


def _session() -> SparkSession:
    """The cluster's session where one is configured, else a local one."""
    return SparkSession.builder.appName("spanloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _retriever(spark: SparkSession, args: argparse.Namespace):
    from spanloom.operators.index import open_index
    from spanloom.plans.retrieval import Retriever
    from spanloom.sources.corpus import read_corpus

    config = RankingConfig().for_repositories(args.repository)
    index = open_index(spark, args.index) if args.index else None
    return Retriever(spark, read_corpus(spark, args.corpus), config, index)


def _queries(spark: SparkSession, path: str):
    """JSON lines with query_id (any scalar, kept as text) and query; a malformed line stops the job."""
    return spark.read.schema("query_id string, query string").option("mode", "FAILFAST").json(path)


def retrieve(spark: SparkSession, args: argparse.Namespace) -> None:
    """Print the ranked results of a query, or write those of a query file."""
    from spanloom.operators.ranking import result_report

    retriever = _retriever(spark, args)
    if args.queries:
        queries = _queries(spark, args.queries)
        result_report(retriever.batch(queries, args.top_k)).write.mode("errorifexists").json(args.output)
        return
    one = spark.createDataFrame([(0, args.query)], "query_id long, query string")
    found = retriever.batch(one, args.top_k)
    shown = found.join(retriever.chunks.select("chunk_id", "content"), "chunk_id")
    for row in shown.withColumn("preview", preview(shown.content)).sort("rank").toLocalIterator():  # top_k rows
        print(f"#{row['rank']} score={row['score']:.6f} {row['repository']} {row['source_role']} {row['source_path']}")
        print(f"  {row['label']} lines {row['start_line']}-{row['end_line']}")
        print(f"  {row['preview']}")
        if args.debug:
            parts = ("lexical", "symbol_boost", "path_boost", "role_boost", "repository_boost")
            print("  " + ", ".join(f"{p}={row[p]:.6f}" for p in parts))


def prompts(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write grounded prompts with packed evidence for a query file."""
    queries = _queries(spark, args.queries)
    _retriever(spark, args).prompts(queries, args.top_k).write.mode("errorifexists").json(args.output)


def index(spark: SparkSession, args: argparse.Namespace) -> None:
    """Build an index that later searches open."""
    from spanloom.operators.index import build_index
    from spanloom.sources.corpus import read_corpus

    build_index(read_corpus(spark, args.corpus), args.output, RankingConfig())


def corpus(spark: SparkSession, args: argparse.Namespace) -> None:
    """Build a corpus from a source tree with its summary."""
    from spanloom.plans import corpus_build as B
    from spanloom.sources.corpus import read_corpus, write_corpus

    if args.package:
        chunks, problems = B.package_corpus(spark, args.root, args.repository, args.package, args.exclude)
    else:
        chunks, problems = B.library_corpus(spark, args.root, args.repository)
    write_corpus(chunks, args.output)
    B.write_report(spark, read_corpus(spark, args.output), problems, args.output)


def combine(spark: SparkSession, args: argparse.Namespace) -> None:
    """Join corpora into one after checking them."""
    from spanloom.plans import corpus_build as B

    B.write_summary(spark, B.combined_corpus(spark, args.inputs, args.output), f"{args.output}_summary.json")


def review(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write a review batch of a session log."""
    from spanloom.plans.review import aggregate

    suffix = args.timestamp_suffix or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    for path in aggregate(spark, args.root, suffix, args.only_unreviewed):
        print(path)


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write the reports of all exportable sessions."""
    from spanloom.plans.review import export as run

    run(spark, args.root, args.output)


def append(spark: SparkSession, args: argparse.Namespace) -> None:
    """Append interaction records, JSON lines of the log's fields, to the sessions of a log."""
    from spanloom.schemas import INTERACTION
    from spanloom.sources.sessions import append_interactions

    append_interactions(spark.read.schema(INTERACTION).option("mode", "FAILFAST").json(args.records), args.root)


def feedback(spark: SparkSession, args: argparse.Namespace) -> None:
    """Merge feedback, JSON lines, into a versioned table of interactions; print the new version."""
    from spanloom.plans.review import merge_version
    from spanloom.sources.versions import VersionedTable

    kind = "interaction_id string, sequence long, action string, category string, comment string, correction string"
    rows = spark.read.schema(kind).option("mode", "FAILFAST").json(args.feedback)
    print(merge_version(VersionedTable(spark, args.table), rows, args.base))


def check(spark: SparkSession, args: argparse.Namespace) -> None:
    """List session files with the reason they may not be submitted."""
    from spanloom.plans.review import submittable

    submittable(spark, args.root).sort("path").write.mode("errorifexists").json(args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(run, *options: tuple) -> argparse.ArgumentParser:
        sub = commands.add_parser(run.__name__, help=run.__doc__)
        for names, settings in options:
            sub.add_argument(*names.split(), **settings)
        sub.set_defaults(run=run)
        return sub

    need = {"required": True}
    searching = [("--corpus", need), ("--index", {}), ("--repository", {"action": "append", "default": []}),
                 ("--top-k", {"type": int, "default": 5}), ("--output", {})]
    command(retrieve, *searching, ("--query", {}), ("--queries", {}), ("--debug", {"action": "store_true"}))
    command(prompts, *searching, ("--queries", need))
    command(index, ("--corpus", need), ("--output", need))
    command(corpus, ("--root", need), ("--repository", need), ("--output", need), ("--package", {}),
            ("--exclude", {"action": "append", "default": []}))
    command(combine, ("--inputs", {"nargs": "+", "required": True}), ("--output", need))
    command(review, ("--root", need), ("--timestamp-suffix", {}), ("--only-unreviewed", {"action": "store_true"}))
    command(export, ("--root", need), ("--output", need))
    command(check, ("--root", need), ("--output", need))
    command(append, ("--root", need), ("--records", need))
    command(feedback, ("--table", need), ("--feedback", need), ("--base", {"type": int, "required": True}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "retrieve" and not args.query and not (args.queries and args.output):
        parser().error("give --query, or --queries with --output")
    try:
        args.run(_session(), args)
    except ValueError as error:
        print(f"{args.command} failed: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
