"""Verdicts on candidates as column rules, evidence, and routing of retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import confidence_band


def judge(rows: DataFrame) -> DataFrame:
    """One verdict per candidate row.

    ``rows`` has candidate_id, n_specialists, evidence (array of struct<id, tool> in order) and the judgment's
    decision (null where none came), confidence, evidence_ids, retry_hint. An accept without evidence takes the
    first three items found, or becomes a reject; a reject on which two specialists agree becomes an accept of at
    most .55. Without a judgment, two specialists give an accept of .45 in the low band, fewer a reject of .20.
    """
    found = F.transform("evidence", lambda x: x["id"])
    merged = F.transform(F.filter("evidence", lambda x: x["tool"] == "merge"), lambda x: x["id"])
    none = F.array().cast("array<string>")
    ids = F.coalesce("evidence_ids", none)
    bare = (F.col("decision") == "accept") & (F.size(ids) == 0)
    first = rows.select(
        "*",
        F.when(bare & (F.size("evidence") == 0), "reject").otherwise(F.col("decision")).alias("_decision"),
        F.when(bare, F.slice(found, 1, 3)).otherwise(ids).alias("_ids"),
        F.coalesce(F.col("n_specialists") >= 2, F.lit(False)).alias("_agreed"),
        merged.alias("_merged"), found.alias("_found"),
    )
    judged = F.col("decision").isNotNull()
    saved = (judged & (F.col("_decision") == "reject") & F.col("_agreed")) | (~judged & F.col("_agreed"))
    decision = F.when(saved, "accept").when(judged, F.col("_decision")).otherwise("reject")
    confidence = (
        F.when(judged & saved, F.least(F.col("confidence") + 0.10, F.lit(0.55))).when(judged, F.col("confidence"))
        .when(saved, 0.45).otherwise(0.20)
    )
    evidence = (
        F.when(judged & saved & (F.size("_ids") == 0), F.slice("_merged", 1, 1)).when(judged, F.col("_ids"))
        .when(saved, F.when(F.size("_merged") > 0, F.col("_merged")).otherwise(F.slice("_found", 1, 1))).otherwise(none)
    )
    return first.select(
        "candidate_id", decision.alias("decision"), confidence.alias("confidence"),
        F.when(judged, confidence_band(confidence)).otherwise("low").alias("confidence_band"),
        evidence.alias("evidence_ids"), saved.alias("salvage"),
        F.when(judged, F.col("retry_hint")).alias("retry_hint"),
    )


def accepted(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with an accept; verdicts on unknown candidates are skipped."""
    return verdicts.filter("decision = 'accept'").join(candidates, "candidate_id")


def projected_confidence(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Accepted candidates with the confidence of their first verdict, .5 where it has none."""
    first = verdicts.groupBy("candidate_id").agg(F.min_by("decision", "pos").alias("decision"), F.min_by(F.struct("confidence"), "pos").alias("c"))
    return candidates.join(first.filter("decision = 'accept'"), "candidate_id").select("candidate_id", F.coalesce("c.confidence", F.lit(0.5)).alias("confidence"))


def collect_evidence(agreement: DataFrame, registry: DataFrame, mail: DataFrame, authorship: DataFrame) -> DataFrame:
    """Evidence of each candidate in order: agreement, registry matches (.80 or more), e-mail domains (.70), authorship.

    Each frame has (candidate_id, result, score); authorship counts as .90.
    """
    parts = [
        (0, "merge", agreement.withColumn("score", F.col("score"))), (1, "registry", registry.filter("score >= 0.80")),
        (2, "email", mail.filter("score >= 0.70")), (3, "authorship", authorship.withColumn("score", F.lit(0.90))),
    ]
    out = None
    for order, tool, part in parts:
        one = part.select("candidate_id", F.lit(order).alias("ord"), F.lit(tool).alias("tool"), "result", F.col("score").cast("double").alias("score"))
        out = one if out is None else out.union(one)
    return out


def trail(evidence: DataFrame) -> DataFrame:
    """Per candidate the tools in order of use, and the highest confidence (0 without any)."""
    tools = F.array_sort(F.collect_set(F.struct("ord", "tool")))
    return evidence.groupBy("candidate_id").agg(F.transform(tools, lambda x: x["tool"]).alias("sources"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_confidence"))


def to_retry(verdicts: DataFrame, candidates: DataFrame, round_: int, limit: int = 2) -> DataFrame:
    """(candidate_id, specialist, hint) of retries, one per contributing specialist; none after ``limit`` rounds."""
    hinted = verdicts.filter((F.col("decision") == "retry") & F.col("retry_hint").isNotNull() & F.lit(round_ < limit))
    return hinted.join(candidates.select("candidate_id", F.explode("specialists").alias("specialist")), "candidate_id").select(
        "candidate_id", "specialist", F.col("retry_hint").alias("hint")
    )


def after_retry(old: DataFrame, new: DataFrame, rerun: DataFrame) -> DataFrame:
    """Candidates after a retry: the new ones of specialists that ran again, the old ones of the others."""
    return old.join(rerun.select("specialist").distinct(), "specialist", "left_anti").unionByName(new)


def from_email(mails: DataFrame, domains: DataFrame) -> DataFrame:
    """(doc_id, email, inst_id): institutions whose domain the address has, the longest domain first."""
    host = F.lower(F.element_at(F.split("email", "@"), -1))
    parts = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tried = mails.select("doc_id", "email", F.posexplode(tails).alias("at", "domain"))
    return tried.join(domains, "domain").groupBy("doc_id", "email").agg(F.min_by("inst_id", "at").alias("inst_id"))


def valid_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a name of two characters or more and a confidence, bounded to [0, 1]; and the rejected others."""
    good = (F.length(F.trim("name")) >= 2) & F.col("confidence").isNotNull()
    good = F.coalesce(good, F.lit(False))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    return rows.filter(good).withColumn("confidence", bounded), rows.filter(~good)


def gold_problems(doi: Column, names: Column, kinds: Column, rors: Column) -> Column:
    """Messages on an annotation: missing doi or name, unknown type, registry id without its prefix."""
    known = F.array(*map(F.lit, ("education", "company", "facility", "government", "nonprofit", "other", "")))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(doi, F.lit("")) == "", "missing doi"),
            F.when(F.exists(names, lambda n: F.coalesce(n, F.lit("")) == ""), "missing author_name"),
            F.when(F.exists(kinds, lambda k: ~F.array_contains(known, F.coalesce(k, F.lit("")))), "unknown type"),
            F.when(F.exists(rors, lambda r: (F.coalesce(r, F.lit("")) != "") & ~r.startswith("https://ror.org/")), "bad ror_id"),
        )
    )
