"""Keyed state in batch form: caches with expiry, memories, latest values; the streaming forms share the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days that entries of each namespace live.
TTL_DAYS = {"ror": 7, "openalex": 3, "s2": 2}


def upsert(entries: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key; null keys are one key like any other."""
    rest = [c for c in entries.columns if c not in keys]
    last = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_x"))
    return last.select(*keys, "_x.*")


def live(cache: DataFrame, now) -> DataFrame:
    """Entries that have not expired at ``now``."""
    return cache.filter(F.col("expires_at") > F.lit(now))


def read_through(wanted: DataFrame, cache: DataFrame, now, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of wanted keys; a stored 'not found' is a hit with a null value."""
    kept = live(cache, now)
    return wanted.join(kept, keys), wanted.join(kept, keys, "left_anti")


def fold_memory(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the distinct papers seen and the summary of the last new one; replays change nothing."""
    once = facts.groupBy(*keys, "paper_id").agg(F.min_by(F.struct("seq", "summary"), "seq").alias("x"))
    return once.groupBy(*keys).agg(F.count("*").alias("papers"), F.max_by("x.summary", "x.seq").alias("summary"), F.max("x.seq").alias("updated"))


def recall(memory: DataFrame, wanted: DataFrame) -> DataFrame:
    """The latest memory of each wanted (venue, year); an entry without a year fits every year."""
    hit = wanted.alias("w").join(memory.alias("m"), (F.col("w.venue") == F.col("m.venue")) & (F.col("m.year").isNull() | (F.col("m.year") == F.col("w.year"))))
    return hit.groupBy("w.venue", "w.year").agg(F.max_by("m.summary", F.struct("m.updated", F.coalesce("m.year", F.lit(0)))).alias("summary"))


def memory_text(rows: DataFrame) -> DataFrame:
    """Rule-based text of a run: how many and which of the first five candidates were rejected."""
    gone = F.filter("baseline", lambda n: ~F.array_contains("accepted", n))
    head = F.concat(F.lit("["), "venue", F.lit(" "), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("] "))
    rejected = F.when(
        F.size(gone) > 0,
        F.concat(F.lit("Critic rejected "), F.size(gone).cast("string"), F.lit(" candidate(s): "), F.array_join(F.slice(gone, 1, 5), ", "), F.lit(". ")),
    ).otherwise("")
    advice = F.when(F.size("accepted") < F.size("baseline"), "Prefer multi-specialist agreement for confidence.").otherwise("")
    return rows.select("venue", "year", F.substring(F.concat(head, rejected, advice), 1, 2000).alias("summary"))


def terminal_status(events: DataFrame, final: list[str]) -> DataFrame:
    """Status of each task: the first final one stands, else the latest."""
    is_final = F.col("status").isin(final)
    return events.groupBy("task").agg(
        F.coalesce(F.min_by("status", F.when(is_final, F.col("seq"))), F.max_by("status", "seq")).alias("status")
    )


def reduce_state(updates: DataFrame) -> DataFrame:
    """Per task the last non-empty list of papers, and all log lines in order."""
    last = F.max_by("papers", F.when(F.size("papers") > 0, F.col("seq")))
    logs = F.transform(F.array_sort(F.collect_list(F.when(F.col("log").isNotNull(), F.struct("seq", "log")))), lambda x: x["log"])
    return updates.groupBy("task").agg(last.alias("papers"), logs.alias("logs"))


def merge_maps(updates: DataFrame) -> DataFrame:
    """(task, name, value): entries of maps, the last value of each name."""
    return updates.select("task", "seq", F.explode("entries").alias("name", "value")).groupBy("task", "name").agg(F.max_by("value", "seq").alias("value"))
