"""Affiliation analytics: summaries, distributions, shares and their top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(flat: DataFrame) -> DataFrame:
    """Distinct papers, authors, organisations and countries, rows, and rows per paper (null without papers)."""
    n = flat.agg(
        F.countDistinct("paper_id").alias("papers"), F.countDistinct("name").alias("authors"),
        F.countDistinct("inst_name").alias("organisations"), F.countDistinct("country").alias("countries"),
        F.count("*").alias("n_rows"),
    )
    return n.withColumn("rows_per_paper", F.try_divide("n_rows", "papers"))


def approximate_summary(flat: DataFrame, error: float = 0.02) -> DataFrame:
    """Distinct counts by sketches: one pass, with memory that does not grow with the data."""
    return flat.agg(*(F.approx_count_distinct(c, error).alias(c) for c in ("paper_id", "name", "inst_name", "country")))


def top_organisations(flat: DataFrame, k: int) -> DataFrame:
    """Organisations by named authors; country and type are those of the smallest author id."""
    by = flat.filter("inst_name is not null").groupBy("inst_name").agg(
        F.count("name").alias("n"), F.min_by("country", F.when(F.col("country").isNotNull(), F.struct("author_id", "paper_id"))).alias("country"),
        F.min_by("org_type", F.when(F.col("org_type").isNotNull(), F.struct("author_id", "paper_id"))).alias("org_type"),
    )
    return by.orderBy(F.desc("n"), "inst_name").limit(k)


def country_distribution(flat: DataFrame) -> DataFrame:
    return flat.filter("country is not null").groupBy("country").agg(F.count("*").alias("n"), F.countDistinct("inst_name").alias("organisations"))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value without nulls, the most frequent first; equal counts by value."""
    by = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return by if k is None else by.orderBy(F.desc("n"), column).limit(k)


def percent_of_total(df: DataFrame, column: str) -> DataFrame:
    """Share of each value in all rows, those without a value included in the total."""
    by = df.groupBy(column).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).filter(F.col(column).isNotNull()).select(column, "n", (100 * F.col("n") / F.col("total")).alias("percent"))


def sector(org_type: Column) -> Column:
    """Company, university and research institute as industry and academia; all else, null too, is other."""
    kind = F.coalesce(org_type, F.lit("unknown"))
    return F.when(kind == "company", "industry").when(kind.isin("university", "research_institute", "education"), "academia").otherwise("other")


def sectors(flat: DataFrame) -> DataFrame:
    by = flat.groupBy(sector(F.col("org_type")).alias("sector")).agg(F.count("*").alias("n"))
    return by.select("sector", "n", (100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("percent"))


def with_other(counts: DataFrame, column: str, k: int, least: float = 0.02) -> DataFrame:
    """The k largest slices; those under ``least`` of these k together become Other."""
    top = counts.orderBy(F.desc("n"), column).limit(k)
    all_ = Window.partitionBy(F.lit(1))
    named = top.withColumn(column, F.when(F.col("n") < least * F.sum("n").over(all_), "Other").otherwise(F.col(column)))
    return named.groupBy(column).agg(F.sum("n").alias("n"))


def papers_by_date(papers: DataFrame) -> DataFrame:
    return papers.groupBy("published").agg(F.count("*").alias("papers"))


def dataset_stats(gold: DataFrame) -> DataFrame:
    n = gold.agg(F.countDistinct("paper_id").alias("papers"), F.count("*").alias("authors"), F.countDistinct("name").alias("names"), F.countDistinct("aff").alias("affiliations"))
    return n.withColumn("authors_per_paper", F.try_divide("authors", "papers"))


def confidence_stats(normalised: DataFrame, key: str) -> DataFrame:
    """Distinct keys by source of their result, and mean confidence of each."""
    return normalised.dropDuplicates([key, "source"]).groupBy("source").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


def flatten_papers(papers: DataFrame) -> DataFrame:
    """One row per paper and author of nested papers; categories are joined, a missing type is unknown."""
    rows = papers.select("paper_id", "title", F.array_join("categories", ",").alias("categories"), F.posexplode("authors").alias("pos", "author"))
    return rows.select("paper_id", "title", "categories", "pos", "author.name", F.coalesce("author.org_type", F.lit("unknown")).alias("org_type"))


def nest_rows(rows: DataFrame) -> DataFrame:
    """Flat rows back to papers, authors in order of ``pos``."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "name", "org_type")))
    return rows.groupBy("paper_id").agg(F.min_by("title", "pos").alias("title"), F.transform(listed, lambda x: F.struct(x["name"], x["org_type"])).alias("authors"))


def progress(events: DataFrame, total: int) -> DataFrame:
    """Per task the share done, at most 90, and the time left at the mean pace."""
    by = events.groupBy("task").agg(F.count("*").alias("done"), F.sum("millis").alias("millis"))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return by.select(
        "task", "done", F.least(F.lit(90.0), F.col("done") / total * 90).alias("percent"),
        (F.col("millis") / F.col("done") * left).alias("eta"),
    )


def requests(events: DataFrame) -> DataFrame:
    """Requests per source and over all, by a rollup."""
    return events.rollup("source").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), "n")


def page(tasks: DataFrame, status: str, offset: int, size: int) -> DataFrame:
    """Tasks of a status, the latest first; those not started come last."""
    return tasks.filter(F.col("status") == status).orderBy(F.desc_nulls_last("started_at"), "task_id").offset(offset).limit(size)
