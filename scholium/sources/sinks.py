"""Writers of results: reports, the graph, predictions, caches, rendered tables."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.operators.state import upsert
from scholium.sources import generations


#: Rows of a CSV file; values may hold line ends, so that one task reads a whole file.
FILE_ROWS = 1 << 20


def write_report(flat: DataFrame, summary: DataFrame, folder: str, stamp: str, rows: int = FILE_ROWS) -> None:
    """The flat rows as CSV, ``rows`` at most in a file, and the report as JSON."""
    flat.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows).csv(f"{folder}/affiliations_{stamp}.csv")
    summary.write.mode("overwrite").json(f"{folder}/report_{stamp}.json")


def write_graph(tables: dict[str, DataFrame], folder: str, generation: int) -> None:
    """Every table of the graph as one generation; readers take the last complete one, so a failed write is unseen."""
    spark = None
    for name, table in tables.items():
        spark = table.sparkSession
        table.write.mode("overwrite").parquet(f"{folder}/generation={generation}/{name}")
    if spark:
        generations.commit(spark, folder, generation)


def write_predictions(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").partitionBy("run_id", "system").parquet(folder)


def upsert_table(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Both tables as one by key, the latest row of each; for caches (expiry as ``seq``) and memories."""
    return upsert(old.unionByName(new), keys, seq)


def checkpoint_totals(charges: DataFrame) -> DataFrame:
    """Totals of spending, one row per budget."""
    return charges.groupBy("budget").agg(F.sum("cost").alias("total"), F.count("*").alias("calls"))


def write_checkpoint(charges: DataFrame, folder: str) -> None:
    """Totals as JSON, and beside them the records behind them, one row each."""
    checkpoint_totals(charges).write.mode("overwrite").json(f"{folder}/totals")
    charges.select("budget", "seq", "model", "cost").write.mode("overwrite").json(f"{folder}/records")


def few(rows: DataFrame, columns: Sequence[str], limit: int) -> list:
    """The rows of a table of ``limit`` rows at most; a larger one is an error, as nothing is left out unsaid."""
    listed = rows.select(*columns).limit(limit + 1).collect()
    if len(listed) > limit:
        raise ValueError(f"the table has more than {limit} rows: take those to be shown, or raise the limit")
    return listed


def svg_bars(rows: DataFrame, label: str, value: str, limit: int = 40, width: int = 480) -> str:
    """A bar chart of a small table, in its order; one over ``limit`` rows is an error."""
    listed = [(escape(str(r[0])), float(r[1] or 0)) for r in few(rows, [label, value], limit)]
    scale = width / max([v for _, v in listed if v > 0], default=1.0)
    bars = [
        f'<text x="196" y="{20 * n + 15}" text-anchor="end">{name}</text><rect x="200" y="{20 * n + 3}" width="{max(0.0, v * scale):.1f}" height="15"/>'
        f'<text x="{205 + max(0.0, v * scale):.1f}" y="{20 * n + 15}">{v:g}</text>'
        for n, (name, v) in enumerate(listed)
    ]
    size = f'width="{width + 300}" height="{20 * len(listed) + 6}"'
    return f'<svg xmlns="http://www.w3.org/2000/svg" {size} font-size="12">{"".join(bars)}</svg>'


def ascii_table(rows: DataFrame, columns: Sequence[str], limit: int = 50) -> str:
    """A small table as text; one over ``limit`` rows is an error."""
    listed = [[str(v) for v in r] for r in few(rows, columns, limit)]
    widths = [max(len(c), *(len(r[i]) for r in listed)) if listed else len(c) for i, c in enumerate(columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * w for w in widths), *map(line, listed)])


def markdown_table(rows: DataFrame, columns: Sequence[str], limit: int = 50) -> str:
    listed = [[str(v) for v in r] for r in few(rows, columns, limit)]
    form = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([form(columns), form(["---"] * len(columns)), *map(form, listed)])


def latex_table(rows: DataFrame, columns: Sequence[str], limit: int = 50) -> str:
    listed = [[str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&") for v in r] for r in few(rows, columns, limit)]
    body = [" & ".join(r) + r" \\" for r in listed]
    head = " & ".join(c.replace("_", r"\_") for c in columns) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
