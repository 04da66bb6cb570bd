"""The scholarly roles as played by the test tables, for DataFrames and, in ``CTES``, for SQL.

A paper is an order, its venue the order's priority, an author a supplier, an institution a nation, a country a
region. An author wrote the papers that the supplier has lines in, and is affiliated with the supplier's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions.text import venue_key
from scholium.sources.scratch import enough_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with those of one order in one partition, and as many partitions as their number asks for.

    What groups or joins lines by order next needs no other shuffle, and its tasks stay small however many lines there are.
    """
    line = table(spark, sf_dir, "lineitem")
    return line.repartition(enough_partitions(line), "l_orderkey")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("title"),
        venue_key("o_orderpriority").alias("venue_key"), F.col("o_custkey").alias("reader_id"),
        F.to_date("o_orderdate").alias("published"),
    )


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("inst_id")
    )


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("n_nationkey") % 3
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").alias("inst_id"), F.col("n_name").alias("inst_name"), F.col("r_name").alias("country"),
        F.when(kind == 0, "company").when(kind == 1, "education").otherwise("facility").alias("org_type"),
    )


def authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per author and paper; lines repeat, so they are grouped first."""
    return lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("author_id"), F.col("l_orderkey").alias("paper_id")).agg(
        F.min("l_linenumber").alias("position")
    )


def affiliated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(author_id, inst_id, paper_id, year), by paper.

    Where the authors are broadcast, the rows are still by paper and the second partitioning falls away.
    """
    partitions = enough_partitions(table(spark, sf_dir, "lineitem"))
    return (
        authored(spark, sf_dir).join(authors(spark, sf_dir).select("author_id", "inst_id"), "author_id")
        .repartition(partitions, "paper_id").join(papers(spark, sf_dir).select("paper_id", "year"), "paper_id")
        .select("author_id", "inst_id", "paper_id", "year")
    )


def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat affiliation table: one row per paper and author, with organisation, country and type."""
    return affiliated(spark, sf_dir).join(authors(spark, sf_dir).select("author_id", "name"), "author_id").join(
        institutions(spark, sf_dir), "inst_id"
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (paper_id, name, aff) that a line not returned names."""
    return lines(spark, sf_dir).filter("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("name"), (F.col("l_partkey") % 5).alias("aff")
    ).distinct()


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, name, aff, confidence) of open lines, the most confident of equal ones."""
    return lines(spark, sf_dir).filter("l_linestatus = 'O'").groupBy(
        F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("name"), (F.col("l_partkey") % 5).alias("aff")
    ).agg((1 - F.min("l_discount")).alias("confidence"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, system, a, b): quality and toxicity as one rater's score, length classes as the other's."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return both.select(
        F.col("doc_id").alias("unit"), F.col("lang").alias("system"),
        (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("a"),
        F.when(F.col("n_chars") < 1000, 0).when(F.col("n_chars") < 5000, 1).otherwise(2).alias("b"),
    )


def specialists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, specialist, name, aff, conf): events as what extractors say of an author."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts"), F.col("event_type").alias("specialist"), F.col("user_id").alias("name"),
        F.get_json_object("props", "$.k").alias("aff"), F.col("value"),
    )


VENUE_SQL = r"coalesce(nullif(regexp_replace(regexp_replace(lower(o_orderpriority), '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), ''), 'unknown')"
CTES = rf"""
paper AS (SELECT o_orderkey AS paper_id, year(o_orderdate)::INT AS year, o_orderstatus AS title, {VENUE_SQL} AS venue_key,
  o_custkey AS reader_id, o_orderdate::DATE AS published FROM orders),
author AS (SELECT s_suppkey AS author_id, s_name AS name, s_nationkey AS inst_id FROM supplier),
inst AS (SELECT n_nationkey AS inst_id, n_name AS inst_name, r_name AS country,
  CASE n_nationkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'education' ELSE 'facility' END AS org_type
  FROM nation JOIN region ON n_regionkey = r_regionkey),
authored AS (SELECT l_suppkey AS author_id, l_orderkey AS paper_id, min(l_linenumber) AS position FROM lineitem GROUP BY ALL),
affil AS (SELECT author_id, inst_id, paper_id, year FROM authored JOIN author USING (author_id) JOIN paper USING (paper_id)),
flat AS (SELECT affil.*, name, inst_name, country, org_type FROM affil JOIN author USING (author_id) JOIN inst ON inst.inst_id = affil.inst_id),
gold AS (SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS name, l_partkey % 5 AS aff FROM lineitem WHERE l_returnflag <> 'R'),
pred AS (SELECT l_orderkey AS paper_id, l_suppkey AS name, l_partkey % 5 AS aff, 1 - min(l_discount) AS confidence
  FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
rating AS (SELECT doc_id AS unit, lang AS system, (quality + 1 - toxic)::INT AS a,
  CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 5000 THEN 1 ELSE 2 END AS b FROM labels JOIN documents USING (doc_id)),
spec AS (SELECT event_id AS seq, ts, event_type AS specialist, user_id AS name, json_extract_string(props, '$.k') AS aff, value FROM events),
collab1 AS (SELECT a.inst_id AS a, b.inst_id AS b, a.year, count(DISTINCT a.paper_id)::BIGINT AS papers_count
  FROM (SELECT DISTINCT paper_id, inst_id, year FROM affil) a JOIN (SELECT DISTINCT paper_id, inst_id FROM affil) b
  ON a.paper_id = b.paper_id AND a.inst_id < b.inst_id GROUP BY ALL),
collab AS (SELECT a, b, year, papers_count FROM collab1 UNION ALL SELECT b, a, year, papers_count FROM collab1),
coauth1 AS (SELECT a.author_id AS a, b.author_id AS b, a.paper_id FROM authored a JOIN authored b
  ON a.paper_id = b.paper_id AND a.author_id < b.author_id),
coauth AS (SELECT u.a, u.b, u.paper_id, p.year FROM (SELECT a, b, paper_id FROM coauth1 UNION ALL SELECT b, a, paper_id FROM coauth1) u JOIN paper p USING (paper_id))
"""


def sql(body: str) -> str:
    """``body`` with the roles as common table expressions; further ones may follow a leading comma."""
    body = body.strip()
    return f"WITH {CTES.strip()}{body}" if body.startswith(",") else f"WITH {CTES.strip()}\n{body}"
