"""Command line: ``ingest`` work items into a graph folder, ``query`` one."""

from __future__ import annotations

import argparse
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators import graph
from scholium.plans.ingest import ingest_items
from scholium.sources import readers, sinks

#: The queries' names.
NAMES = ("industry_share_by_venue", "top_institutions_by_venue", "country_strategy_heatmap", "coauthor_neighborhood")


def open_parts(spark: SparkSession, folder: str):
    """(affiliated, authored, papers, institutions, coauthors, collaborations) of a graph folder, under common names."""
    g = readers.open_graph(spark, folder)
    papers = g["published_at"].select("paper_id", "venue_key", "year").distinct()
    institutions = g["institution"].select(
        F.col("ror_id").alias("inst_id"), F.col("canonical_name").alias("inst_name"), F.col("country_code").alias("country"), "org_type"
    )
    affiliated = g["affiliated_at"].select("author_id", F.col("ror_id").alias("inst_id"), "paper_id", "year")
    coauthors = g["coauthored_with"].select(F.col("src").alias("a"), F.col("dst").alias("b"), "paper_id", "year")
    collaborations = g["collaborated_with"].select(F.col("src").alias("a"), F.col("dst").alias("b"), "year", "papers_count")
    return affiliated, g["authored"], papers, institutions, coauthors, collaborations


def run_query(spark: SparkSession, folder: str, args: argparse.Namespace):
    affiliated, authored, papers, institutions, coauthors, collaborations = open_parts(spark, folder)
    if args.name == NAMES[0]:
        return graph.industry_share(affiliated, authored, papers, institutions, args.venue, args.year, args.mode).orderBy("venue_key", "year")
    if args.name == NAMES[1]:
        return graph.top_institutions(affiliated, authored, papers, institutions, args.venue or "", args.year, args.top_k, args.mode).orderBy("rank")
    if args.name == NAMES[2]:
        return graph.country_heatmap(collaborations, institutions, args.year, args.min_papers).orderBy(F.desc("papers"), "country_a", "country_b")
    center = args.author_id or author_of(spark, folder, args.author_name or "")
    return graph.neighborhood(coauthors, F.lit(center), hops=args.hops).orderBy("hop", "author_id")


def author_of(spark: SparkSession, folder: str, name: str) -> str | None:
    """Smallest id of the authors one of whose names holds ``name``, whatever its case."""
    authors = readers.open_graph(spark, folder)["author"]
    known = authors.filter(F.exists("name_variants", lambda x: F.contains(F.lower(x), F.lit(name.lower()))))
    return known.agg(F.min("canonical_id")).first()[0] if name else None


def shown(found: DataFrame, limit: int) -> Iterator[str]:
    """The first ``limit`` rows as a table, and how many more there are."""
    yield sinks.ascii_table(found.limit(limit), found.columns, limit)
    more = found.count() - limit
    if more > 0:
        yield f"{more} more rows: raise --limit, or write all with --output"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="scholium")
    commands = out.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="work items (JSON lines) into a graph folder")
    ingest.add_argument("items")
    ingest.add_argument("graph")
    query = commands.add_parser("query", help="run an analytic query on a graph folder")
    query.add_argument("name", choices=NAMES)
    query.add_argument("graph")
    query.add_argument("--venue")
    query.add_argument("--year", type=int)
    query.add_argument("--top-k", type=int, default=20)
    query.add_argument("--min-papers", type=int, default=1)
    query.add_argument("--author-id")
    query.add_argument("--author-name", help="used where no --author-id is given")
    query.add_argument("--hops", type=int, default=1, choices=(1, 2))
    query.add_argument("--limit", type=int, default=200, help="rows to print")
    query.add_argument("--output", help="a new folder for all rows as CSV, in place of printing")
    query.add_argument("--mode", default="per_paper", choices=("per_paper", "reference"))
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("scholium").getOrCreate()
    if args.command == "ingest":
        items, bad = readers.read_work_items(spark, args.items)
        ingest_items(items, args.graph)
        print(f"{items.count()} items, {bad.count()} bad lines")
        stored = readers.open_graph(spark, args.graph)
        print(", ".join(f"{stored[name].count()} {name}" for name in ("paper", "author", "institution", "venue")))
        return
    found = run_query(spark, args.graph, args)
    if args.output:
        found.write.mode("error").option("header", True).csv(args.output)
        return
    for line in shown(found, args.limit):
        print(line)


if __name__ == "__main__":
    main()
