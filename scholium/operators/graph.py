"""Property-graph operators: idempotent upserts, derived edges, analytic queries, bounded traversal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.sources.scratch import cut, scratch


def upsert_nodes(old: DataFrame, new: DataFrame, key: str, seq: str = "ingest_seq") -> DataFrame:
    """Per key the last value that is set of each property; unset ones survive. Repeating an upsert changes nothing."""
    both = old.unionByName(new, allowMissingColumns=True)
    props = [c for c in both.columns if c not in (key, seq)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in props]
    return both.groupBy(key).agg(*last, F.max(seq).alias(seq))


def upsert_edges(old: DataFrame, new: DataFrame, ends: Sequence[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """Distinct edges whose end points exist; ``ends`` lists (edge column, node table, node key)."""
    edges = old.unionByName(new).distinct()
    for column, nodes, key in ends:
        edges = edges.join(nodes.select(F.col(key).alias(column)).distinct(), column, "left_semi")
    return edges


def mirrored(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.union(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


#: Members of a group whose pairs one task makes; larger groups are cut in blocks.
BLOCK = 1 << 10


def block_cells(rows: DataFrame, group: str, item: str, sizes: DataFrame, block: int) -> DataFrame:
    """``rows`` of large groups with ``_own``, their block, once for each pair of blocks (``_i`` <= ``_j``) it is in.

    ``sizes`` is (group, n). A cell holds the items of two blocks at most, some 2 * ``block``.
    """
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = rows.join(sizes.select(group, F.col("n").alias("_n")), group).withColumn("_own", F.pmod(F.xxhash64(item), blocks).cast("int"))
    spread = own.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_n", "_other")


def pairs_within(rows: DataFrame, group: str, item: str, block: int = BLOCK) -> DataFrame:
    """The columns of ``rows`` with ``item`` as a, and b: pairs a < b of one group.

    Items of a group meet by an equality join. Groups over ``block`` items are cut, and each pair of their blocks
    meets by itself, so that no task makes more than the pairs of two blocks, however large a group is.
    """
    rest = [c for c in rows.columns if c != item]
    large = cut(rows.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > block), "large-groups")
    left, right = rows.withColumnRenamed(item, "a"), rows.select(group, F.col(item).alias("b"))
    if large.isEmpty():
        return left.join(right, group).filter("a < b").select(*rest, "a", "b")
    small = left.join(large, group, "left_anti").join(right.join(large, group, "left_anti"), group).filter("a < b").select(*rest, "a", "b")
    cells = block_cells(rows, group, item, large, block)
    other = cells.select(group, "_i", "_j", F.col("_own").alias("_with"), F.col(item).alias("b"))
    met = cells.withColumnRenamed(item, "a").join(other, [group, "_i", "_j"]).filter("a < b and (_i = _j or _own <> _with)")
    return small.unionByName(met.select(*rest, "a", "b"))


def coauthors(authored: DataFrame, papers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, paper_id, year), both directions, for authors of one paper; pairs are made within a paper only."""
    pairs = pairs_within(authored.select("paper_id", "author_id"), "paper_id", "author_id", block)
    return mirrored(pairs.join(papers.select("paper_id", "year"), "paper_id").select("a", "b", "paper_id", "year"))


def collaborations(affiliated: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, year, papers_count), both directions: papers with authors of both institutions, each counted once."""
    one = affiliated.select("paper_id", "inst_id", "year").distinct()
    pairs = pairs_within(one, "paper_id", "inst_id", block)
    return mirrored(pairs.groupBy("a", "b", "year").agg(F.count("*").alias("papers_count")))


def _paired(affiliated: DataFrame, authored: DataFrame, papers: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """Affiliation edges against papers at their venues, counted by ``keys`` of both, as column n.

    ``per_paper`` joins an edge to its own paper. ``reference`` joins it to every paper of its author; since only
    counts are needed, both sides are counted per author first, which avoids the author's product of rows.
    """
    edge_keys = [k for k in keys if k in affiliated.columns and k != "year"]
    paper_keys = [k for k in keys if k in papers.columns]
    if mode == "per_paper":
        return (
            affiliated.select("paper_id", *edge_keys).join(papers.select("paper_id", *paper_keys), "paper_id")
            .groupBy(*keys).agg(F.count("*").alias("n"))
        )
    edges = affiliated.groupBy("author_id", *edge_keys).agg(F.count("*").alias("e"))
    written = authored.select("author_id", "paper_id").join(papers.select("paper_id", *paper_keys), "paper_id")
    written = written.groupBy("author_id", *paper_keys).agg(F.count("*").alias("m"))
    return edges.join(written, "author_id").groupBy(*keys).agg(F.sum(F.col("e") * F.col("m")).alias("n"))


def _chosen(papers: DataFrame, venue: str | None, year: int | None) -> DataFrame:
    if venue is not None:
        papers = papers.filter(F.contains(F.lower("venue_key"), F.lower(F.lit(venue))))
    return papers if year is None else papers.filter(F.col("year") == year)


def industry_share(
    affiliated: DataFrame, authored: DataFrame, papers: DataFrame, institutions: DataFrame,
    venue: str | None = None, year: int | None = None, mode: str = "per_paper",
) -> DataFrame:
    """Per venue and year the affiliations, those of companies, and their share (0 for none)."""
    n = _paired(affiliated, authored, _chosen(papers, venue, year), ["inst_id", "venue_key", "year"], mode)
    kinds = n.join(institutions.select("inst_id", "org_type"), "inst_id")
    company = F.sum(F.when(F.col("org_type") == "company", F.col("n")).otherwise(0))
    out = kinds.groupBy("venue_key", "year").agg(F.sum("n").alias("total"), company.alias("industry"))
    return out.withColumn("share", F.coalesce(F.try_divide("industry", "total"), F.lit(0.0)))


def top_institutions(
    affiliated: DataFrame, authored: DataFrame, papers: DataFrame, institutions: DataFrame,
    venue: str, year: int | None = None, top_k: int = 20, mode: str = "per_paper",
) -> DataFrame:
    """Ranked institutions of a venue; equal counts rank by id."""
    n = _paired(affiliated, authored, _chosen(papers, venue, year), ["inst_id"], mode)
    best = n.orderBy(F.desc("n"), "inst_id").limit(top_k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "inst_id")))
    return ranked.join(institutions, "inst_id").select("rank", "inst_id", "inst_name", "country", "org_type", F.col("n").alias("papers"))


def country_heatmap(
    collaborations: DataFrame, institutions: DataFrame, year: int | None = None, min_papers: int = 1
) -> DataFrame:
    """(a, b, year, papers) of pairs of countries in order; edges below ``min_papers`` go before they are summed."""
    edges = collaborations.filter(F.col("papers_count") >= min_papers)
    edges = edges if year is None else edges.filter(F.col("year") == year)
    at = institutions.select("inst_id", "country")
    both = edges.join(at.select(F.col("inst_id").alias("a"), F.col("country").alias("country_a")), "a").join(
        at.select(F.col("inst_id").alias("b"), F.col("country").alias("country_b")), "b"
    )
    kept = both.filter("country_a <> '' and country_b <> '' and country_a < country_b")
    return kept.groupBy("country_a", "country_b", "year").agg(F.sum("papers_count").alias("papers"))


def country_papers(affiliated: DataFrame, institutions: DataFrame) -> DataFrame:
    """(country_a, country_b, year, papers): distinct papers with an author from each."""
    one = affiliated.join(institutions.select("inst_id", "country"), "inst_id").select("paper_id", "year", "country").distinct()
    pairs = one.select("paper_id", "year", F.col("country").alias("country_a")).join(
        one.select("paper_id", F.col("country").alias("country_b")), "paper_id"
    )
    return pairs.filter("country_a < country_b").groupBy("country_a", "country_b", "year").agg(F.count("*").alias("papers"))


def neighborhood(coauthored: DataFrame, center: Column, max_nodes: int = 50, expand: int = 10, hops: int = 2) -> DataFrame:
    """(hop, author_id, via): the centre, its latest co-authors, and new co-authors of the first ``expand`` of them.

    The order is explicit: latest year, then id. Each expanded neighbour has an equal quota of what is left.
    """
    kind = coauthored.schema["a"].dataType
    root = coauthored.sparkSession.range(1).select(center.cast(kind).alias("c"))
    last = coauthored.groupBy("a", "b").agg(F.max("year").alias("year"))
    first = last.join(root, F.col("a") == F.col("c"), "left_semi").select(F.col("b").alias("author_id"), "year", F.col("a").alias("via"))
    first = first.orderBy(F.desc("year"), "author_id").limit(max_nodes)
    first = first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("year"), "author_id")))
    known = first.select("author_id").union(root.select(F.col("c").alias("author_id")))
    left = first.agg(F.count("*").alias("n")).select(
        F.greatest(F.lit(1), F.floor((F.lit(max_nodes) - F.col("n")) / F.greatest(F.least("n", F.lit(expand)), F.lit(1)))).alias("quota")
    )
    grown = first.filter(F.col("place") <= expand).select(F.col("author_id").alias("via"), "place")
    second = last.select(F.col("a").alias("via"), F.col("b").alias("author_id"), "year").join(grown, "via").join(known, "author_id", "left_anti")
    turn = Window.partitionBy("via").orderBy(F.desc("year"), "author_id")
    second = second.withColumn("turn", F.row_number().over(turn)).join(F.broadcast(left)).filter("turn <= quota")
    second = second.groupBy("author_id").agg(F.min_by("via", "place").alias("via"))
    out = root.select(F.lit(0).alias("hop"), F.col("c").alias("author_id"), F.lit(None).cast(kind).alias("via"))
    out = out.union(first.select(F.lit(1), "author_id", "via"))
    return out.union(second.select(F.lit(2), "author_id", "via")) if hops > 1 else out


def subgraph(edges: DataFrame, seeds: DataFrame, quotas: dict[tuple[str, str], int], hops: int = 2, max_nodes: int = 80) -> DataFrame:
    """(hop, kind, id) reached from ``seeds`` (kind, id) over ``edges`` (src_kind, src, dst_kind, dst, ord).

    From each node the first ``quotas[src_kind, dst_kind]`` neighbours in ``ord`` follow; other kinds of edges
    are not walked. Breadth first: the nearer nodes fill the cap.
    """
    allowed = F.create_map(*(F.lit(x) for (a, b), q in quotas.items() for x in (f"{a}>{b}", q)))
    turn = Window.partitionBy("src_kind", "src", "dst_kind").orderBy("ord", "dst")
    quota = F.coalesce(F.try_element_at(allowed, F.concat("src_kind", F.lit(">"), "dst_kind")), F.lit(0))
    seen = seeds.select(F.lit(0).alias("hop"), "kind", "id")
    front = seeds
    for hop in range(1, hops + 1):
        # only the edges of the frontier are ranked
        near = edges.filter(quota > 0).join(front.select(F.col("kind").alias("src_kind"), F.col("id").alias("src")), ["src_kind", "src"], "left_semi")
        near = near.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= quota)
        front = near.select(F.col("dst_kind").alias("kind"), F.col("dst").alias("id")).distinct().join(seen, ["kind", "id"], "left_anti")
        seen = seen.union(front.select(F.lit(hop).alias("hop"), "kind", "id"))
    return seen.orderBy("hop", "kind", "id").limit(max_nodes)


def describe(kind: str) -> Column:
    """One line of text for a node of a kind, from that kind's columns."""
    forms = {
        "Author": F.format_string("Author | names=%s", "name"),
        "Institution": F.format_string("Institution | name=%s type=%s country=%s", "inst_name", "org_type", "country"),
        "Paper": F.format_string("Paper | title=%s year=%d venue=%s", "title", "year", "venue_key"),
        "Venue": F.format_string("Venue | key=%s", "venue_key"),
    }
    return forms[kind]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node reachable.

    Large and small stars alternate: each node's larger neighbours, then the node and its smaller ones, are linked
    to the smallest of them. The rounds end when they change no edge; their number grows with the logarithm of the
    longest path.
    """

    def kept(df: DataFrame) -> DataFrame:
        path = scratch(df.sparkSession, "components")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    now, before = kept(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()), None
    while True:
        state = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if state == before or not state[0]:
            break
        before = state
        both = mirrored(now, "u", "v")
        large = both.join(both.groupBy("u").agg(F.least("u", F.min("v")).alias("least")), "u").filter("v > u and least <> v")
        large = kept(large.select(F.col("least").alias("u"), "v").distinct())
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("least"))
        small = down.join(lowest, "u").select(F.col("least").alias("u"), "v").union(lowest.select(F.col("least").alias("u"), F.col("u").alias("v")))
        now = kept(small.filter("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("u").alias("component")).union(now.select(F.col("v").alias("node"), F.col("u").alias("component"))).distinct()
