"""Entity resolution: lookups in tiers, fuzzy matches, merging what several extractors found."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions.fuzzy import jaro_winkler, token_sort, token_sort_ratio
from scholium.functions.text import norm_name
from scholium.operators.forecast import row_numbers
from scholium.operators.graph import components
from scholium.operators.similar import containing, similar
from scholium.sources.scratch import cut


def union_specialists(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, part in parts.items():
        one = part.withColumn("specialist", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def ordered_distinct(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Each value at its first position, numbered in that order."""
    first = df.groupBy(value).agg(F.min(pos).alias("first"))
    return row_numbers(first, "first", value, "place").select(value, "place")


def hinted_order(rows: DataFrame, country: object, key: str, query: str) -> DataFrame:
    """Place of each answer to its ``query``: by score, those of the hinted country first."""
    order = Window.partitionBy(query).orderBy(F.desc(F.col("country").eqNullSafe(F.lit(country))), F.desc("score"), key)
    return rows.withColumn("place", F.row_number().over(order))


def merge_candidates(rows: DataFrame) -> DataFrame:
    """Candidates of one normalised name as one: longest name, ordered union of affiliations, agreeing specialists.

    ``rows`` is (name, aff, specialist, pos); confidence is high where two specialists or more agree. Per name
    and affiliation only the first position is kept before values are listed, so a group holds distinct values.
    """
    named = rows.withColumn("key", norm_name("name")).filter(F.length("key") >= 2)
    affs = named.groupBy("key", "aff").agg(F.min("pos").alias("pos"))
    listed = affs.groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("aff").isNotNull(), F.struct("pos", "aff")))), lambda x: x["aff"]).alias("affiliations")
    )
    names = named.groupBy("key").agg(
        F.max_by("name", F.struct(F.length("name"), -F.col("pos"))).alias("name"),
        F.array_sort(F.collect_set("specialist")).alias("specialists"),
    )
    several = F.size("specialists") >= 2
    return names.join(listed, "key").select(
        "key", "name", "affiliations", "specialists", F.when(several, "high").otherwise("medium").alias("confidence"),
        F.concat(F.lit("Agreed by: "), F.array_join("specialists", ", ")).alias("evidence"),
    )


def enrich(rows: DataFrame, extra: DataFrame, columns: list[str]) -> DataFrame:
    """Fill empty ``columns`` by name from ``extra``; of equal names there the last ``pos`` counts."""
    last = extra.groupBy(F.lower("name").alias("_key")).agg(*(F.max_by(c, "pos").alias(f"_{c}") for c in columns))
    joined = rows.join(last, F.lower("name") == F.col("_key"), "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in columns}
    return joined.withColumns(filled).select(rows.columns)


def _alike(texts: DataFrame, variants: DataFrame, threshold: float) -> DataFrame:
    """(text, key, pos, canonical, score) of keys and variants whose token sort ratio reaches the threshold."""
    if threshold > 100:
        return texts.select("text", "key", F.lit(0).alias("pos"), F.lit("").alias("canonical"), F.lit(0.0).alias("score")).limit(0)
    near = similar(texts, variants, "key", "variant", threshold)
    return texts.join(near, "key").join(variants, "variant").select("text", "key", "pos", "canonical", "score")


def lookup_tiers(texts: DataFrame, variants: DataFrame, threshold: float = 80.0, whole_words: bool = False) -> DataFrame:
    """Normalise distinct texts through tiers: exact, contained either way, fuzzy, passed through.

    ``texts`` is (text), ``variants`` (pos, variant, canonical) in lower case. Each tier sees what the one before
    missed, and pairs texts and variants by equality of something that a match must share: the rarest part of what is
    contained, and q-grams. Within a tier the first variant counts, or in the fuzzy tier the best and then first.
    """
    own = cut(texts.select("text").distinct().withColumn("key", F.lower(F.trim("text"))), "lookup-texts")
    variants = cut(variants.select("pos", "variant", "canonical"), "lookup-variants")
    exact = own.join(variants, own["key"] == variants["variant"]).groupBy("text", "key").agg(F.min_by("canonical", "pos").alias("canonical"))
    rest = cut(own.join(exact, "text", "left_anti"), "lookup-rest")
    inside = containing(rest, variants, "key", "variant", whole_words=whole_words).select("text", "key", "pos", "canonical")
    if not whole_words:
        inside = inside.union(containing(variants, rest, "variant", "key").select("text", "key", "pos", "canonical"))
    part = cut(inside.groupBy("text", "key").agg(F.min_by("canonical", "pos").alias("canonical")), "lookup-inside")
    rest = cut(rest.join(part, "text", "left_anti"), "lookup-rest")
    near = _alike(rest, variants, threshold).groupBy("text", "key").agg(
        F.max_by("canonical", F.struct("score", -F.col("pos"))).alias("canonical"), F.max("score").alias("score")
    )
    near = cut(near, "lookup-near")
    rest = rest.join(near, "text", "left_anti")
    tiers = [
        exact.select("text", "canonical", F.lit(0.95).alias("confidence"), F.lit("kb").alias("source")),
        part.select("text", "canonical", F.lit(0.95).alias("confidence"), F.lit("kb").alias("source")),
        near.select("text", "canonical", (0.9 * F.col("score") / 100).alias("confidence"), F.lit("fuzzy").alias("source")),
        rest.select("text", F.col("text").alias("canonical"), F.lit(0.3).alias("confidence"), F.lit("none").alias("source")),
    ]
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.union(tier)
    return out


def combined_confidence(extracted: Column, normalised: Column, routed: bool = False) -> Column:
    """The lower of the two; the routed search takes the higher."""
    return F.greatest(extracted, normalised) if routed else F.least(extracted, normalised)


def best_fuzzy(queries: DataFrame, names: DataFrame, least: float = 60.0) -> DataFrame:
    """(query, name, score) of the best of the listed names of each block; below ``least`` none."""
    pairs = queries.select("block", "query").distinct().join(names.select("block", "name").distinct(), "block")
    scored = pairs.withColumn("score", token_sort_ratio(F.lower("query"), F.lower("name")))
    best = scored.groupBy("block", "query").agg(F.max(F.struct("score", "name")).alias("x"))
    return best.filter(F.col("x.score") >= least).select("block", "query", "x.name", "x.score")


def greedy_pairs(pred: DataFrame, gold: DataFrame, threshold: float = 85.0, best: bool = False) -> DataFrame:
    """(paper_id, pred, gold, score): each gold name at most once, both sides in order of name, whatever their case.

    Each prediction takes the first free gold name at or over the threshold, or with ``best`` the most similar one.
    The distinct names of one paper meet in one row; papers are the block, so the lists stay small.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for paper, preds, golds in zip(batch["paper_id"], batch["preds"], batch["golds"]):
                free = list(golds)
                for one in preds:
                    scores = ((token_sort(one.lower().strip(), n.lower().strip()), n) for n in free if one and n)
                    fits = (x for x in scores if x[0] >= threshold)
                    taken = max(fits, key=lambda x: x[0], default=None) if best else next(fits, None)
                    if taken:
                        free.remove(taken[1])
                        rows.append((paper, one, taken[1], taken[0]))
            yield pd.DataFrame(rows, columns=["paper_id", "pred", "gold", "score"])

    left = pred.groupBy("paper_id").agg(F.array_sort(F.collect_set("name")).alias("preds"))
    right = gold.groupBy("paper_id").agg(F.array_sort(F.collect_set("name")).alias("golds"))
    kind = pred.schema["paper_id"].dataType.simpleString()
    return left.join(right, "paper_id").select("paper_id", "preds", "golds").mapInPandas(match, f"paper_id {kind}, pred string, gold string, score double")


def first_fuzzy(pred: DataFrame, gold: DataFrame, threshold: float = 85.0) -> DataFrame:
    """(paper_id, pred, gold): for each prediction the first gold name in order at or over the threshold."""
    pairs = pred.select("paper_id", F.col("name").alias("pred")).join(gold.select("paper_id", F.col("name").alias("gold"), "pos"), "paper_id")
    near = pairs.filter(token_sort_ratio("pred", "gold") >= threshold)
    return near.groupBy("paper_id", "pred").agg(F.min_by("gold", "pos").alias("gold"))


def differing_spans(spans: DataFrame, a: str, b: str, agree: float = 0.92) -> DataFrame:
    """(doc_id, region, text, other, similarity): spans of parser ``a`` that none of ``b`` matches, and the reverse.

    Equal texts agree without a comparison, so only the others of a region are paired.
    """
    clean = spans.select("doc_id", "region", "parser", "text", norm_name("text").alias("key"))
    left, right = clean.filter(F.col("parser") == a), clean.filter(F.col("parser") == b)
    out = None
    for one, two in ((left, right), (right, left)):
        open_ = one.join(two.select("doc_id", "region", "key").distinct(), ["doc_id", "region", "key"], "left_anti").select("doc_id", "region", "parser", "text", "key")
        pairs = open_.join(two.select("doc_id", "region", F.col("text").alias("other"), F.col("key").alias("other_key")), ["doc_id", "region"], "left")
        scored = pairs.withColumn("similarity", F.coalesce(jaro_winkler("key", "other_key"), F.lit(0.0)))
        best = scored.groupBy("doc_id", "region", "parser", "text").agg(F.max(F.struct("similarity", "other")).alias("x"))
        part = best.filter(F.col("x.similarity") < agree).select("doc_id", "region", "parser", "text", "x.other", "x.similarity")
        out = part if out is None else out.union(part)
    return out


def name_overlap(a: Column, b: Column) -> Column:
    """Any word in common."""
    return F.arrays_overlap(F.split(norm_name(a), " "), F.split(norm_name(b), " "))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def clusters(records: DataFrame, threshold: float = 90.0) -> DataFrame:
    """(record_id, cluster_id): records of a block linked by similar names, closed under links.

    Equal names of a block are one node first; what their links connect, however long the chain, is one cluster. Names
    are compared by the q-grams they share, not by all pairs of a block.
    """
    nodes = records.groupBy("block", norm_name("name").alias("key")).agg(F.min("record_id").alias("node"))
    nodes, names = cut(nodes, "cluster-nodes"), nodes.select("key").distinct()
    near = similar(names, names.withColumnRenamed("key", "other"), "key", "other", threshold).filter("key < other").select("key", "other")
    other = nodes.select("block", F.col("key").alias("other"), F.col("node").alias("v"))
    links = nodes.join(near, "key").join(other, ["block", "other"]).select(F.col("node").alias("u"), "v")
    labels = nodes.select("node").distinct().join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("label"))
    keyed = records.withColumn("key", norm_name("name"))
    return keyed.join(nodes, ["block", "key"]).join(labels, "node").select("record_id", F.col("label").alias("cluster_id"))


def merge_annotations(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Two annotators' rows by place: equal or single values stand, of two different ones the first's, and is noted."""
    right = b.select("paper_id", "pos", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_has"))
    both = a.withColumn("_mine", F.lit(True)).join(right, ["paper_id", "pos"], "full_outer")
    chosen, notes = [], []
    for c in fields:
        mine, other = F.coalesce(c, F.lit("")), F.coalesce(f"_{c}", F.lit(""))
        chosen.append(F.when(mine != "", mine).otherwise(other).alias(c))
        differ = F.col("_mine").isNotNull() & F.col("_has").isNotNull() & (mine != "") & (other != "") & (mine != other)
        notes.append(F.when(differ, F.lit(c)))
    return both.select("paper_id", "pos", *chosen, F.array_compact(F.array(*notes)).alias("conflicts"))


def first_source(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """Whole rows of the source with the least priority that has the key."""
    best = rows.groupBy(key).agg(F.min(priority).alias("_best"))
    return rows.join(best, key).filter(F.col(priority) == F.col("_best")).drop("_best")


def link_mentions(mentions: DataFrame, names: DataFrame, limit: int = 3) -> DataFrame:
    """(mention, kind, id): up to ``limit`` known names per mention and kind that contain it, in order of id.

    Of equal names only the first ``limit`` can be among them, so no more are brought to the mentions.
    """
    wanted = mentions.select("mention", "kind").distinct().withColumn("_inner", F.lower("mention"))
    known = names.select("kind", "id", F.lower("name").alias("_name"))
    known = known.withColumn("_turn", F.row_number().over(Window.partitionBy("kind", "_name").orderBy("id"))).filter(F.col("_turn") <= limit).drop("_turn")
    hits = containing(known, wanted, "_name", "_inner", by=["kind"]).select("mention", "kind", "id")
    turn = Window.partitionBy("mention", "kind").orderBy("id")
    return hits.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= limit).select("mention", "kind", "id")
