"""Regions of parsed papers: headers, footnotes, acknowledgements, e-mails, over lines or placed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions.fuzzy import jaro_winkler_from
from scholium.functions.text import emails

#: Headings and marks of the regions.
BODY = r"(?i)^#+\s+(abstract|introduction|background|related\s+work)\s*$"
ACKNOWLEDGEMENT = r"(?i)^(?:#+\s*)?(acknowledgements?|acknowledgments?)\s*$"
STOP = r"(?i)^(references?|bibliography|appendix\b.*|conclusions?)\s*$"
FOOTNOTE = r"^\s*[*†‡§¶\d¹²³⁴⁵⁶⁷⁸⁹⁰]+[.\s].+"
#: Fixed values, by parser: where the body begins, and the confidences of header lines with and without #.
HEADERS = {
    "marker": (r"(?i)^#+\s+(abstract|introduction|background|related\s+work)\s*$", 0.90, 0.78),
    "nougat": (r"^(\\section\{|#\s*\d+[\.\s])", 0.80, 0.80),
}
#: Fixed values, by parser: the heading of the acknowledgements, what ends them, and the confidence.
ACKNOWLEDGEMENTS = {
    "marker": (r"(?i)^#+\s*(acknowledgements?|acknowledgments?)\s*$", r"^#+\s", 0.82),
    "nougat": (r"(?i)^#+\s*(acknowledgements?|acknowledgments?)\s*$", r"^#+\s", 0.80),
    "pymupdf": (r"(?i)^(acknowledgements?|acknowledgments?)\s*$", r"(?i)^(references?|bibliography|appendix\b|conclusions?)\s*$", 0.75),
}
#: docling's heading of the acknowledgements, and the confidences of its regions.
DOCLING_HEADING = r"(?i)\backnowledgements?\b|\backnowledgments?\b"
DOCLING = {"acknowledgements": 0.88, "footnotes": 0.92, "title": 0.97, "header": 0.82}
#: Fixed value: confidence of marker's footnotes.
FOOTNOTE_CONFIDENCE = 0.65


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def header_lines(docs: DataFrame, body: str = BODY) -> DataFrame:
    """(doc_id, pos, text, confidence) of the non-blank lines before the first body heading, # stripped.

    The lines stay in their row as an array until those before the heading are known, so nothing is shuffled.
    """
    parts = docs.select("doc_id", F.split("text", "\n").alias("l"))
    first = F.array_position(F.transform("l", lambda x: x.rlike(body)), F.lit(True))
    head = F.when(first > 0, F.slice("l", 1, (first - 1).cast("int"))).otherwise(F.col("l"))
    each = parts.select("doc_id", F.posexplode(head).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    each = each.filter((F.col("line") != "") & ~F.col("line").isin("---", "===", "***"))
    text = F.regexp_replace(F.regexp_replace("line", "^#+", ""), r"^\s+|\s+$", "")
    return each.select("doc_id", "pos", text.alias("text"), F.when(F.col("line").startswith("#"), 0.90).otherwise(0.78).alias("confidence"))


def footnote_lines(docs: DataFrame) -> DataFrame:
    """Lines that begin with a mark or number and are under 200 characters."""
    each = lines(docs)
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    return each.filter(F.col("line").rlike(FOOTNOTE) & (F.length(text) < 200)).select("doc_id", "pos", text.alias("text"))


def acknowledgement_lines(docs: DataFrame, stop: str = STOP) -> DataFrame:
    """(doc_id, pos, text) from after an acknowledgement heading to the next heading."""
    each = lines(docs)
    mark = F.when(F.col("line").rlike(ACKNOWLEDGEMENT), "ack").when(F.col("line").rlike(stop) | F.col("line").rlike(r"^#+\s"), "stop")
    order = Window.partitionBy("doc_id").orderBy("pos")
    inside = each.withColumn("mark", mark).withColumn("last", F.last("mark", ignorenulls=True).over(order))
    return inside.filter((F.col("last") == "ack") & F.col("mark").isNull() & (F.trim("line") != "")).select("doc_id", "pos", F.col("line").alias("text"))


def placed_regions(blocks: DataFrame) -> DataFrame:
    """Region of placed blocks: header in the top 35 % of the first page, footnote in the bottom 18 % at 9 pt or less."""
    top = F.col("top") / F.col("height")
    region = F.when((F.col("page") == 0) & (top < 0.35), "header").when((top > 0.82) & (F.col("font") <= 9), "footnotes")
    return blocks.withColumn("region", region).filter("region is not null").withColumn("confidence", F.least(F.lit(1.0), F.col("font") / 12))


def first_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, email, page): the first page on which an address stands."""
    each = pages.select("doc_id", "page", F.explode(emails("text")).alias("email"))
    return each.groupBy("doc_id", "email").agg(F.min("page").alias("page"))


def parser_consensus(spans: DataFrame, priority: list[str]) -> DataFrame:
    """All spans of the first parser that gave any for a document."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("parser"))
    ranked = spans.withColumn("place", place).filter("place > 0")
    best = ranked.groupBy("doc_id").agg(F.min("place").alias("best"))
    return ranked.join(best, "doc_id").filter("place = best").drop("place", "best")


def aligned(slots: list[list[tuple[str, str]]], texts: list[str], parser: str, alike: float) -> list[list[tuple[str, str]]]:
    """The slots, lists of (parser, text), with one more parser's texts in order: those that match a slot join it, the
    others stand between. Of all orderly matchings the one of the highest total similarity; earlier slots first."""
    n, m = len(slots), len(texts)
    near = [[0.0] * m for _ in range(n)]
    for i, slot in enumerate(slots):
        written = {t for _, t in slot}
        for j, text in enumerate(texts):
            best = 1.0 if text in written else max(jaro_winkler_from(t, text, alike) for t in written)
            near[i][j] = best if best >= alike else 0.0
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            met = best[i + 1][j + 1] + near[i][j] if near[i][j] else 0.0
            best[i][j] = max(met, best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and near[i][j] and best[i][j] == best[i + 1][j + 1] + near[i][j]:
            out.append([*slots[i], (parser, texts[j])])
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i][j] == best[i + 1][j]):
            out.append(slots[i])
            i += 1
        else:
            out.append([(parser, texts[j])])
            j += 1
    return out


def consensus_by_vote(spans: DataFrame, priority: list[str], alike: float = 0.92) -> DataFrame:
    """(doc_id, region, slot, text, votes) of what more than half of a document's parsers give, region by region.

    ``spans`` is (doc_id, region, parser, pos, text). The parsers' spans of a region are aligned one parser after
    another, by ``priority``; a slot's text is the one most parsers wrote so, of equal numbers the first parser's.
    One row holds a region of one document.
    """
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("parser"))
    known = spans.withColumn("place", place).filter("place > 0 and text is not null")
    present = known.groupBy("doc_id").agg(F.count_distinct("parser").alias("present"))
    listed = known.groupBy("doc_id", "region").agg(F.array_sort(F.collect_list(F.struct("place", "pos", "parser", "text"))).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, region, many, parsers, written in zip(*(batch[c] for c in batch.columns)):
                by: dict[str, list[str]] = {}
                for parser, text in zip(parsers, written):
                    by.setdefault(parser, []).append(text)
                slots: list[list[tuple[str, str]]] = []
                for parser, texts in by.items():
                    slots = aligned(slots, texts, parser, alike)
                for n, slot in enumerate(s for s in slots if 2 * len(s) > many):
                    texts = [t for _, t in slot]
                    out.append((doc, region, n, max(texts, key=texts.count), len(slot)))
            yield pd.DataFrame(out, columns=["doc_id", "region", "slot", "text", "votes"])

    kind = spans.schema["doc_id"].dataType.simpleString()
    # lists of plain values, which reach pandas many times faster than lists of structs
    plain = listed.join(present, "doc_id").select("doc_id", "region", "present", F.col("rows.parser").alias("parsers"), F.col("rows.text").alias("texts"))
    return plain.mapInPandas(run, f"doc_id {kind}, region string, slot int, text string, votes int")


def disagreements(spans: DataFrame, region: str) -> DataFrame:
    return spans.filter(F.col("region") == region)


def headers_by(docs: DataFrame, parser: str) -> DataFrame:
    """(doc_id, pos, text, confidence) of the header lines as a parser of marked-up text takes them."""
    body, marked, plain = HEADERS[parser]
    if parser == "marker":
        return header_lines(docs, body)
    parts = docs.select("doc_id", F.split("text", "\n").alias("l"))
    first = F.array_position(F.transform("l", lambda x: F.concat(x, F.lit("\n")).rlike(body)), F.lit(True))
    head = F.when(first > 0, F.slice("l", 1, (first - 1).cast("int"))).otherwise(F.col("l"))
    each = parts.select("doc_id", F.posexplode(head).alias("pos", "line")).withColumn("text", F.regexp_replace("line", r"^\s+|\s+$", ""))
    return each.filter("text <> ''").select("doc_id", "pos", "text", F.when(F.col("text").startswith("#"), marked).otherwise(plain).alias("confidence"))


def footnotes(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text, confidence) of marker's footnotes."""
    return footnote_lines(docs).withColumn("confidence", F.lit(FOOTNOTE_CONFIDENCE))


def acknowledgements_by(units: DataFrame, parser: str) -> DataFrame:
    """(doc_id, pos, text, confidence) of the first acknowledgements in ``units(doc_id, pos, text)``.

    Units are lines for marker and nougat, whose section is one text, and blocks for pymupdf, which stay apart. The
    section runs from its heading to the first unit that ends it, or to the end.
    """
    heading, stop, confidence = ACKNOWLEDGEMENTS[parser]
    whole = Window.partitionBy("doc_id")
    core = F.regexp_replace("text", r"^\s+|\s+$", "") if parser == "pymupdf" else F.col("text")
    marked = units.select("doc_id", "pos", "text", core.rlike(heading).alias("_ack"), core.rlike(stop).alias("_stop"))
    marked = marked.withColumn("_from", F.min(F.when(F.col("_ack"), F.col("pos"))).over(whole)).filter("pos > _from")
    marked = marked.withColumn("_to", F.min(F.when(F.col("_stop"), F.col("pos"))).over(whole)).filter("_to is null or pos < _to")
    if parser == "pymupdf":
        return marked.filter("not _ack and trim(text) <> ''").select("doc_id", "pos", "text", F.lit(confidence).alias("confidence"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    text = marked.groupBy("doc_id").agg(F.min("pos").alias("pos"), F.regexp_replace(joined, r"^\s+|\s+$", "").alias("text"))
    return text.filter("text <> ''").withColumn("confidence", F.lit(confidence))


def docling_regions(items: DataFrame) -> DataFrame:
    """(doc_id, pos, region, text, confidence) of ``items(doc_id, pos, page, label, text)`` as docling labels them.

    After a section header of acknowledgements all belongs to these until the next section header. Else footnotes and
    the title go by their label, and the first page's headers and text are header.
    """
    header = F.col("label") == "section_header"
    ack = header & F.col("text").rlike(DOCLING_HEADING)
    mark = F.when(ack, "ack").when(header, "end")
    inside = F.last(mark, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos"))
    first_page = (F.col("page") == 0) & F.col("label").isin("section_header", "text", "paragraph")
    kind = (
        F.when(ack, None).when(F.coalesce(F.col("_in") == "ack", F.lit(False)), "acknowledgements").when(F.col("label") == "footnote", "footnotes")
        .when(F.col("label") == "title", "title").when(first_page, "header")
    )
    found = items.withColumn("_in", inside).withColumn("kind", kind).filter("kind is not null")
    confidence = F.create_map(*(F.lit(x) for k, v in DOCLING.items() for x in (k, v)))
    region = F.when(F.col("kind") == "title", "header").otherwise(F.col("kind"))
    return found.select("doc_id", "pos", region.alias("region"), "text", F.element_at(confidence, F.col("kind")).alias("confidence"))
