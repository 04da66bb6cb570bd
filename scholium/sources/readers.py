"""Readers of the domain's files; schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FLAT = "paper_id string, paper_title string, published_date string, categories string, author_name string, raw_affiliation string, normalized_affiliation string, country string, country_code string, org_type string, confidence double"
AUTHOR = "struct<name:string,raw_affiliation:string,normalized_affiliation:string,country:string,country_code:string,org_type:string>"
GOLD = f"papers array<struct<paper_id:string,title:string,authors:array<{AUTHOR}>,source:string,annotator:string,annotation_date:string,notes:string>>"
ANNOTATION = "paper_id string, doi string, title string, year int, venue string, annotator string, annotations array<struct<author_name:string,position:int,normalized_aff:string,ror_id:string,country_code:string,type:string,evidence_span:string,email:string>>"
EVIDENCE = "struct<evidence_id:string,tool:string,query:string,result_summary:string,confidence:double,raw_response:string,retrieved_at:timestamp>"
CANDIDATE = f"struct<candidate_id:string,author_name:string,affiliations:array<string>,emails:array<string>,s2_id:string,s2_cluster_id:string,source_specialist:string,evidence_trail:struct<items:array<{EVIDENCE}>>>"
VERDICT = "struct<candidate_id:string,decision:string,confidence:double,confidence_band:string,rationale:string,evidence_ids:array<string>,salvage:boolean>"
WORK_ITEM = f"canonical_paper struct<paper_id:string,title:string,venue:string,year:int,abstract:string>, merged_candidates array<{CANDIDATE}>, verdicts array<{VERDICT}>"
MANIFEST = "papers array<struct<doi:string,paper_id:string,title:string,year:int,venue:string,n_authors:int,arxiv_id:string>>, splits struct<train:array<string>,dev:array<string>,test:array<string>>"
JUDGMENT = "doi string, judge string, system string, scores array<struct<author_name:string,score:int,reason:string>>, overall_quality double, notes string"
PREDICTION = "doi string, system string, authors array<struct<author_name:string,affiliations:array<string>,confidence:double>>"

#: Columns of the property graph's tables; those never filled by ingestion stay empty but typed.
GRAPH = {
    "author": "canonical_id string, s2_id string, orcid string, name_variants array<string>",
    "paper": "doi string, arxiv_id string, openalex_id string, s2_id string, title string, year int, venue_key string, abstract string, primary_topic string",
    "institution": "ror_id string, openalex_id string, canonical_name string, country_code string, org_type string, parent_ror_id string",
    "venue": "key string, full_name string, kind string",
    "topic": "topic_id string, label string, source string",
    "evidence": "evidence_id string, source string, raw_payload string, retrieved_at string",
    "authored": "author_id string, paper_id string, position int",
    "affiliated_at": "author_id string, ror_id string, paper_id string, evidence_id string, year int",
    "published_at": "paper_id string, venue_key string, year int",
    "about": "paper_id string, topic_id string, weight float",
    "child_of": "ror_id string, parent_ror_id string",
    "coauthored_with": "src string, dst string, paper_id string, year int",
    "collaborated_with": "src string, dst string, year int, papers_count int",
}


def read_affiliations(spark: SparkSession, path: str) -> DataFrame:
    """The flat CSV; empty and NA are null."""
    rows = spark.read.schema(FLAT).option("header", True).option("nullValue", "").option("escape", '"').option("multiLine", True).csv(path)
    return rows.select(*(F.nullif(F.col(c), F.lit("NA")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """One row per gold author, with the paper's fields and the author's place."""
    papers = spark.read.schema(GOLD).option("multiLine", True).json(path).select(F.explode("papers").alias("p")).select("p.*")
    return papers.select("paper_id", "title", "source", F.posexplode("authors").alias("pos", "a")).select("paper_id", "title", "source", "pos", "a.*")


def read_work_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, corrupt lines); blank lines are skipped and a bad one does not stop the rest."""
    schema = StructType.fromDDL(WORK_ITEM).add("_bad", "string")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"), "value")
    good = F.col("x._bad").isNull() & F.col("x").isNotNull()
    return parsed.filter(good).select("x.*").drop("_bad"), parsed.filter(~good).select(F.col("value").alias("line"))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Papers of a split in file order; mini is the first ten of test, all is every paper."""
    whole = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    papers = whole.select(F.posexplode("papers").alias("pos", "p")).select("pos", "p.*")
    if split == "all":
        return papers.orderBy("pos")
    listed = whole.select(F.explode(f"splits.{'test' if split == 'mini' else split}").alias("doi")).distinct()
    chosen = papers.join(listed, "doi", "left_semi").orderBy("pos")
    return chosen.limit(10) if split == "mini" else chosen


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the merged file, else annotator a's; one row per annotation."""
    files = spark.read.schema(ANNOTATION).option("multiLine", True).json(f"{folder}/*.json").withColumn("file", F.col("_metadata.file_name"))
    files = files.filter(~F.col("file").endswith(".b.json"))
    rank = F.when(F.col("file").endswith(".a.json"), 1).otherwise(0)
    best = files.groupBy("doi").agg(F.min_by(F.struct("paper_id", "annotations"), rank).alias("x"))
    return best.select("doi", "x.paper_id", F.posexplode("x.annotations").alias("pos", "a")).select("doi", "paper_id", "pos", "a.*")


def paired_annotations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both annotators' rows of the documents that have both."""
    files = spark.read.schema(ANNOTATION).option("multiLine", True).json(f"{folder}/*.json").withColumn("file", F.col("_metadata.file_name"))
    rows = files.select("doi", F.col("file").endswith(".b.json").alias("second"), F.posexplode("annotations").alias("pos", "a")).select("doi", "second", "pos", "a.*")
    both = files.groupBy("doi").agg(F.countDistinct(F.col("file").endswith(".b.json")).alias("n")).filter("n = 2").select("doi")
    kept = rows.join(both, "doi", "left_semi")
    return kept.filter("not second").drop("second"), kept.filter("second").drop("second")


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The newest file of each document and system; of equal times the last name."""
    rows = spark.read.schema(PREDICTION).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    rows = rows.withColumn("at", F.struct("_metadata.file_modification_time", "_metadata.file_path"))
    return rows.groupBy("doi", "system").agg(F.max_by("authors", "at").alias("authors"))


def read_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """Cached judgments, one per document, judge and system."""
    rows = spark.read.schema(JUDGMENT).parquet(folder)
    return rows.dropDuplicates(["doi", "judge", "system"])


def open_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The graph's tables of the last complete generation, empty and typed where none is stored yet."""
    from pyspark.errors import AnalysisException

    from scholium.sources import generations

    whole = generations.complete(spark, folder)
    folder = f"{folder}/generation={whole[-1]}" if whole else folder
    out = {}
    for name, schema in GRAPH.items():
        try:
            out[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
            out[name].schema  # noqa: B018
        except AnalysisException:
            out[name] = spark.createDataFrame([], schema)
    return out


def parse_ror(payloads: DataFrame, hint: str | None = None) -> DataFrame:
    """(query, ror_id, name, country_code, score, place) of registry answers, hinted country first."""
    schema = "struct<items:array<struct<score:double,chosen:boolean,organization:struct<id:string,name:string,country:struct<country_code:string>>>>>"
    rows = payloads.select("query", F.explode(F.from_json("body", schema)["items"]).alias("i"))
    flat = rows.select(
        "query", F.col("i.organization.id").alias("ror_id"), F.col("i.organization.name").alias("name"),
        F.col("i.organization.country.country_code").alias("country_code"), F.col("i.score").alias("score"),
    )
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy(F.desc(F.col("country_code").eqNullSafe(F.lit(hint))), F.desc("score"), "ror_id")
    return flat.withColumn("place", F.row_number().over(order))


def parse_works(payloads: DataFrame) -> DataFrame:
    """(work_id, pos, name, inst, ror_id, confidence): first institution of each author of a work's answer."""
    schema = "struct<id:string,authorships:array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string,ror:string,country_code:string>>>>>"
    rows = payloads.select(F.from_json("body", schema).alias("w")).select("w.id", F.posexplode("w.authorships").alias("pos", "a"))
    inst = F.get("a.institutions", F.lit(0))
    return rows.select(
        F.col("id").alias("work_id"), "pos", F.col("a.author.display_name").alias("name"), inst["display_name"].alias("inst"),
        inst["ror"].alias("ror_id"), F.when(inst.isNotNull(), 0.92).otherwise(0.5).alias("confidence"),
    )


def parse_s2(payloads: DataFrame) -> DataFrame:
    """(paper_id, pos, name, aff, confidence): first affiliation of each author of a search answer."""
    schema = "struct<data:array<struct<paperId:string,authors:array<struct<name:string,affiliations:array<string>>>>>>"
    rows = payloads.select(F.explode(F.from_json("body", schema)["data"]).alias("p")).select(F.col("p.paperId").alias("paper_id"), F.posexplode("p.authors").alias("pos", "a"))
    aff = F.get("a.affiliations", F.lit(0))
    return rows.select("paper_id", "pos", "a.name", aff.alias("aff"), F.when(aff.isNotNull(), 0.9).otherwise(0.5).alias("confidence"))


def authors_matching(hits: DataFrame, paper_authors: DataFrame) -> DataFrame:
    """Author hits kept to the paper's own authors where any of a query's hits is one, else all."""
    marked = hits.join(paper_authors.select("s2_id", F.lit(True).alias("own")).distinct(), "s2_id", "left")
    any_ = marked.groupBy("query").agg(F.coalesce(F.max("own"), F.lit(False)).alias("any_own"))
    return marked.join(any_, "query").filter(F.col("own") | ~F.col("any_own")).select("query", "s2_id")


def cascade(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source in the list that answers a key."""
    out = None
    for place, source in enumerate(sources):
        one = source.withColumn("_place", F.lit(place))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy(key).agg(F.min("_place").alias("_best"))
    return out.join(best, key).filter("_place = _best").drop("_place", "_best")


def search(papers: DataFrame, categories: list[str] | None = None, first: str | None = None, last: str | None = None, limit: int | None = None) -> DataFrame:
    """Papers of any of the categories; dates bind only where both are given; the latest first."""
    if categories:
        papers = papers.filter(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    if first and last:
        papers = papers.filter(F.col("published").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    papers = papers.orderBy(F.desc("published"), "paper_id")
    return papers if limit is None else papers.limit(limit)


def point_lookup(ids: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Registry rows for ids, nulls and ``found`` false where there is none."""
    known = registry.withColumn("found", F.lit(True))
    return ids.join(known, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
