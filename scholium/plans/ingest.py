"""From work items to the property graph: one set-based plan for any number of items.

Ingestion is idempotent: items are keyed by their paper, the last item of a paper counts for its properties, and
collaborations are counted over distinct papers, so replaying items changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions.text import author_key, cut, first_ror, institution_key, org_type, paper_key, venue_key
from scholium.operators import graph
from scholium.sources.readers import GRAPH


def _typed(spark: SparkSession, name: str, df: DataFrame | None = None) -> DataFrame:
    empty = spark.createDataFrame([], GRAPH[name])
    if df is None:
        return empty
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields
    ]
    return df.select(*columns)


def graph_from_items(items: DataFrame) -> dict[str, DataFrame]:
    """All tables of the graph from work items ``(canonical_paper, merged_candidates, verdicts)``.

    Items without a paper are left out; verdicts count where they accept a known candidate. A candidate with a
    registry id gives that id to all its affiliations.
    """
    spark = items.sparkSession
    rows = items.filter("canonical_paper is not null").withColumn("seq", F.monotonically_increasing_id())
    paper = F.col("canonical_paper")
    keyed = rows.select(
        paper_key(paper["paper_id"]).alias("doi"), "seq", paper.alias("p"), "merged_candidates", "verdicts",
        venue_key(F.coalesce(paper["venue"], F.lit(""))).alias("venue_key"), F.coalesce(paper["year"], F.lit(0)).alias("year"),
    )
    last = keyed.groupBy("doi").agg(F.max_by(F.struct("p", "venue_key", "year"), "seq").alias("x")).select("doi", "x.*")
    source = F.col("p.paper_id")
    papers = last.select(
        "doi", F.when(source.startswith("arxiv:"), source).otherwise("").alias("arxiv_id"),
        F.when(source.startswith("openalex:"), source).otherwise("").alias("openalex_id"), F.col("p.title").alias("title"), "year",
        "venue_key", cut(F.col("p.abstract"), 2000).alias("abstract"), F.lit("").alias("primary_topic"),
    )
    venues = keyed.groupBy("venue_key").agg(F.max_by(F.coalesce("p.venue", F.lit("")), "seq").alias("full_name")).select(
        F.col("venue_key").alias("key"), "full_name", F.lit("conference").alias("kind")
    )
    published = keyed.select(F.col("doi").alias("paper_id"), "venue_key", "year").distinct()
    verdicts = keyed.select("doi", "seq", "year", F.posexplode("verdicts").alias("pos", "v"), "merged_candidates").filter("v.decision = 'accept'")
    found = F.filter("merged_candidates", lambda c: c["candidate_id"] == F.col("v.candidate_id"))
    accepted = verdicts.withColumn("c", F.element_at(F.concat(found, F.array(F.lit(None))), 1)).filter("c is not null")
    rors = F.transform(F.col("c.evidence_trail.items"), lambda e: F.coalesce(F.get_json_object(e["raw_response"], "$.ror_id"), F.lit("")))
    facts = accepted.select(
        "doi", "seq", "year", "pos", "c", "v.evidence_ids",
        author_key(F.col("c.s2_cluster_id"), F.col("c.s2_id"), F.coalesce("c.author_name", F.lit(""))).alias("author_id"),
        first_ror(F.coalesce(rors, F.array().cast("array<string>"))).alias("ror"),
    )
    authors = facts.groupBy("author_id").agg(
        F.max_by(F.coalesce("c.s2_id", F.lit("")), F.struct("seq", "pos")).alias("s2_id"),
        F.array_sort(F.collect_set("c.author_name")).alias("name_variants"),
    ).select(F.col("author_id").alias("canonical_id"), "s2_id", F.lit("").alias("orcid"), "name_variants")
    authored = facts.select("author_id", F.col("doi").alias("paper_id"), F.lit(0).alias("position")).distinct()
    affs = facts.select("doi", "seq", "pos", "year", "author_id", "ror", "evidence_ids", F.posexplode("c.affiliations").alias("at", "aff"))
    affs = affs.withColumn("ror_id", institution_key("ror", "aff"))
    institutions = affs.groupBy("ror_id").agg(F.max_by("aff", F.struct("seq", "pos", "at")).alias("canonical_name")).select(
        "ror_id", "canonical_name", F.lit("").alias("country_code"), org_type("canonical_name").alias("org_type")
    )
    affiliated = affs.select(
        "author_id", "ror_id", F.col("doi").alias("paper_id"), F.coalesce(F.get("evidence_ids", F.lit(0)), F.lit("")).alias("evidence_id"), "year"
    ).distinct()
    evidence = accepted.select("seq", F.explode("c.evidence_trail.items").alias("e")).groupBy("e.evidence_id").agg(
        F.max_by(F.struct("e.tool", F.substring("e.raw_response", 1, 1000).alias("raw"), F.col("e.retrieved_at").cast("string").alias("at")), "seq").alias("x")
    ).select("evidence_id", F.col("x.tool").alias("source"), F.col("x.raw").alias("raw_payload"), F.col("x.at").alias("retrieved_at"))
    coauthored = graph.coauthors(authored, published.select("paper_id", "year").distinct()).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), "paper_id", "year"
    )
    collaborated = graph.collaborations(affiliated.select("paper_id", F.col("ror_id").alias("inst_id"), "year")).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), "year", "papers_count"
    )
    built = {
        "author": authors, "paper": papers, "institution": institutions, "venue": venues, "evidence": evidence, "authored": authored,
        "affiliated_at": affiliated, "published_at": published, "coauthored_with": coauthored, "collaborated_with": collaborated,
    }
    return {name: _typed(spark, name, built.get(name)) for name in GRAPH}


#: Key of each node table.
NODE_KEYS = {"author": "canonical_id", "paper": "doi", "institution": "ror_id", "venue": "key", "evidence": "evidence_id"}
EDGES = ("authored", "affiliated_at", "published_at")


def merged(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A stored graph and a later one as one: the graph of all their items.

    Of a node the later properties count, and an author's name variants add up; edges are distinct. Co-author edges
    are made anew for the papers of the later graph only, whose authors may have grown; collaborations are counted
    again over distinct papers. Merging a graph into itself changes nothing.
    """
    out = dict(old)
    for name, key in NODE_KEYS.items():
        rows = graph.upsert_nodes(old[name].withColumn("_seq", F.lit(0)), new[name].withColumn("_seq", F.lit(1)), key, "_seq")
        if name == "author":
            names = old[name].union(new[name].select(old[name].columns)).groupBy(key).agg(
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("name_variants")))).alias("name_variants")
            )
            rows = rows.drop("name_variants").join(names, key)
        out[name] = rows.select(old[name].columns)
    for name in EDGES:
        out[name] = graph.upsert_edges(old[name], new[name])
    for name in ("topic", "about", "child_of"):
        if name in old:
            out[name] = old[name].union(new[name]).distinct()
    touched = new["authored"].select("paper_id").distinct()
    again = graph.coauthors(out["authored"].join(touched, "paper_id", "left_semi"), out["published_at"].select("paper_id", "year").distinct())
    again = again.select(F.col("a").alias("src"), F.col("b").alias("dst"), "paper_id", "year")
    out["coauthored_with"] = old["coauthored_with"].union(again.select(old["coauthored_with"].columns)).distinct()
    affiliated = out["affiliated_at"].select("paper_id", F.col("ror_id").alias("inst_id"), "year")
    counted = graph.collaborations(affiliated).select(F.col("a").alias("src"), F.col("b").alias("dst"), "year", "papers_count")
    out["collaborated_with"] = _typed(counted.sparkSession, "collaborated_with", counted)
    return out


def ingest_items(items: DataFrame, folder: str) -> None:
    """Merge work items into the graph in ``folder``, which may not exist yet, as its next generation."""
    from scholium.sources import generations, readers, sinks

    spark = items.sparkSession
    known = generations.children(spark, folder, "generation")
    tables = merged(readers.open_graph(spark, folder), graph_from_items(items))
    sinks.write_graph(tables, folder, known[-1] + 1 if known else 0)


def default_plan() -> dict:
    """The plan used where no planner answers."""
    return {"parsers": ["pymupdf"], "extractors": ["header", "email_domain"], "verification_depth": "light"}


def analyse(papers: DataFrame, variants: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """Batch analysis: flat rows with normalised organisations, and the report's tables."""
    from scholium.operators import analytics, resolve

    rows = papers.select("paper_id", "published_date", F.posexplode("authors").alias("pos", "a")).select(
        "paper_id", "published_date", "pos", F.col("a.name").alias("name"), F.col("a.raw_affiliation").alias("text"), F.col("a.confidence").alias("extracted")
    )
    normal = resolve.lookup_tiers(rows.filter("text is not null"), variants)
    flat = rows.join(normal, "text", "left").select(
        "paper_id", "published_date", "pos", "name", F.col("text").alias("raw_affiliation"), F.col("canonical").alias("inst_name"), "source",
        resolve.combined_confidence(F.coalesce("extracted", F.lit(0.85)), F.coalesce("confidence", F.lit(0.3))).alias("confidence"),
    )
    return {
        "flat": flat, "top_organizations": analytics.value_counts(flat, "inst_name", top),
        "papers_by_date": flat.groupBy("published_date").agg(F.countDistinct("paper_id").alias("papers")),
        "sources": flat.groupBy("source").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")),
    }


def first_places(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    turn = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_turn", F.row_number().over(turn)).filter("_turn = 1").drop("_turn")
