"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholium.functions import text as x
from scholium.functions.fuzzy import jaro_winkler, token_sort_ratio
from scholium.plans.catalog import query
from scholium.plans.fuzzy_sql import scored
from scholium.sources import testdata as t


def _docs(spark, d):
    return t.table(spark, d, "documents")


@query("c01_norm_name", r"SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS name FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", x.norm_name("text").alias("name"))


@query("c02_norm_aff", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS aff FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", x.norm_aff("text").alias("aff"))


@query("c03_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::INT AS n, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1] AS first FROM documents")
def _(spark, d):
    words = x.tokens("text")
    return _docs(spark, d).select("doc_id", F.size(words).alias("n"), F.get(words, F.lit(0)).alias("first"))


@query("c04_venue_key", f"SELECT DISTINCT o_orderpriority, {t.VENUE_SQL} AS venue_key FROM orders")
def _(spark, d):
    return t.table(spark, d, "orders").select("o_orderpriority", x.venue_key("o_orderpriority").alias("venue_key")).distinct()


_ID = "CASE WHEN o_orderkey % 2 = 0 THEN 'doi:10.1/' || o_orderkey ELSE 'arxiv:' || o_orderkey END"


def _ids(spark, d):
    key = F.col("o_orderkey").cast("string")
    return t.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("doi:10.1/"), key)).otherwise(F.concat(F.lit("arxiv:"), key)).alias("id"))


@query("c05_paper_key", f"SELECT o_orderkey, CASE WHEN starts_with(id, 'doi:') THEN substr(id, 5) ELSE 'synthetic:' || left(sha1(id), 12) END AS k FROM (SELECT o_orderkey, {_ID} AS id FROM orders)")
def _(spark, d):
    return _ids(spark, d).select("o_orderkey", x.paper_key("id").alias("k"))


@query("c06_author_key", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 's2:c' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 's2:' || s_suppkey ELSE 'name:' || regexp_replace(lower(s_name), '\\s+', '_', 'g') END AS k FROM supplier""".replace("\\\\", "\\"))
def _(spark, d):
    key, m = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    cluster = F.when(m == 0, F.concat(F.lit("c"), key)).otherwise("")
    return t.table(spark, d, "supplier").select("s_suppkey", x.author_key(cluster, F.when(m == 1, key), "s_name").alias("k"))


@query("c07_institution_key", r"SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'https://ror.org/' || n_nationkey ELSE 'name:' || left(regexp_replace(lower(n_name), '\s+', '_', 'g'), 80) END AS k FROM nation")
def _(spark, d):
    ror = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("https://ror.org/"), F.col("n_nationkey").cast("string")))
    return t.table(spark, d, "nation").select("n_nationkey", x.institution_key(ror, "n_name").alias("k"))


@query("c08_first_ror", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'https://ror.org/b' ELSE 'https://ror.org/a' END AS ror FROM supplier")
def _(spark, d):
    items = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("x"), F.lit("https://ror.org/b"))).otherwise(F.array(F.lit("https://ror.org/a"), F.lit("https://ror.org/b")))
    return t.table(spark, d, "supplier").select("s_suppkey", x.first_ror(items).alias("ror"))


_KINDS = " ".join(f"WHEN regexp_matches(lower(p_name), '{'|'.join(words)}') THEN '{kind}'" for kind, words in x.ORG_TYPES)


@query("c09_org_type", f"SELECT p_partkey, CASE {_KINDS} ELSE 'other' END AS org_type FROM part")
def _(spark, d):
    return t.table(spark, d, "part").select("p_partkey", x.org_type("p_name").alias("org_type"))


@query("c10_safe_name", f"SELECT o_orderkey, translate({_ID}, '/.', '__') AS name FROM orders")
def _(spark, d):
    return _ids(spark, d).select("o_orderkey", x.safe_name("id").alias("name"))


@query("c11_run_id", "SELECT n_nationkey, left(sha256(n_name || '|' || md5('m') || '|' || 'rev' || '|' || n_regionkey), 16) AS run_id FROM nation")
def _(spark, d):
    return t.table(spark, d, "nation").select("n_nationkey", x.run_id("n_name", F.lit("m"), F.lit("rev"), F.col("n_regionkey").cast("string")).alias("run_id"))


@query("c12_span_id", "SELECT doc_id, 'span_' || left(sha1(source || '|' || 0 || '|' || text), 10) AS span_id FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", x.span_id("source", F.lit(0), "text").alias("span_id"))


@query("c13_layout_hash", """SELECT lang, left(sha1('{"a":' || n || ',"b":' || m || '}'), 8) AS layout FROM (SELECT lang, count(*) AS n, max(doc_id) AS m FROM documents GROUP BY 1)""")
def _(spark, d):
    counts = _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.max("doc_id").alias("m"))
    return counts.select("lang", x.layout_hash(F.create_map(F.lit("b"), "m", F.lit("a"), "n")).alias("layout"))


@query("c14_token_sort_ratio", f"""WITH pairs AS (SELECT x.p_partkey, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON x.p_partkey + 1 = y.p_partkey),
{scored("pairs", "p_partkey")} SELECT p_partkey, score AS ratio FROM scored""")
def _(spark, d):
    p = t.table(spark, d, "part").select("p_partkey", "p_name")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey").select("p_partkey", token_sort_ratio("p_name", "other").alias("ratio"))


@query("c15_jaro_winkler", "SELECT a.p_partkey, round(jaro_winkler_similarity(a.p_name, b.p_name), 9) AS similarity FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey")
def _(spark, d):
    p = t.table(spark, d, "part").select("p_partkey", "p_name")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey").select("p_partkey", F.round(jaro_winkler("p_name", "other"), 9).alias("similarity"))


_MAIL = r"list_distinct(list_transform(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b'), lambda m: lower(m)))"


@query("c16_emails", f"SELECT doc_id, e AS email FROM (SELECT doc_id, unnest({_MAIL}) AS e FROM documents)")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(x.emails("text")).alias("email"))


@query("c17_email_domain", f"SELECT domain, count(*)::BIGINT AS n FROM (SELECT split_part(unnest({_MAIL}), '@', -1) AS domain FROM documents) GROUP BY 1")
def _(spark, d):
    return _docs(spark, d).select(F.explode(x.emails("text")).alias("e")).groupBy(x.email_domain("e").alias("domain")).agg(F.count("*").alias("n"))


@query("c18_name_from_email", r"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Ann Lee' || c_custkey ELSE '' END AS name FROM customer""")
def _(spark, d):
    mail = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ann.LEE"), F.col("c_custkey").cast("string"), F.lit("@x.org"))).otherwise("alee@x.org")
    return t.table(spark, d, "customer").select("c_custkey", x.name_from_email(mail).alias("name"))


_AX = "CASE o_orderkey % 4 WHEN 0 THEN '2401.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || 'v2' WHEN 1 THEN 'hep-th/9901001' WHEN 2 THEN '10.1/x.' || o_orderkey ELSE 'W' || o_orderkey END"


def _mixed(spark, d):
    k = F.col("o_orderkey")
    s = k.cast("string")
    m = k % 4
    return t.table(spark, d, "orders").select("o_orderkey", F.when(m == 0, F.concat(F.lit("2401."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v2"))).when(m == 1, "hep-th/9901001").when(m == 2, F.concat(F.lit("10.1/x."), s)).otherwise(F.concat(F.lit("W"), s)).alias("id"))


@query("c19_arxiv_id", f"SELECT o_orderkey, o_orderkey % 4 < 2 AS arxiv FROM orders")
def _(spark, d):
    return _mixed(spark, d).select("o_orderkey", x.is_arxiv_id("id").alias("arxiv"))


@query("c20_strip_version", f"SELECT o_orderkey, split_part({_AX}, 'v', 1) AS id FROM orders")
def _(spark, d):
    return _mixed(spark, d).select("o_orderkey", x.strip_version("id").alias("id"))


@query("c21_inverted_abstract", "SELECT o_orderkey, string_agg('w' || p, ' ' ORDER BY l_linenumber) AS abstract FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, max('' || (l_partkey % 10)) AS p FROM lineitem GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    words = t.table(spark, d, "lineitem").groupBy("l_orderkey", F.concat(F.lit("w"), (F.col("l_partkey") % 10).cast("string")).alias("w")).agg(F.collect_set("l_linenumber").alias("places"))
    index = words.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.map_from_entries(F.collect_list(F.struct("w", "places"))).alias("index"))
    return index.select("o_orderkey", x.inverted_abstract("index").alias("abstract"))


@query("c22_work_id", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 'doi:' || {_AX} ELSE {_AX} END AS a, 'W' || o_orderkey AS b, 'doi:10.1/' || o_orderkey AS c FROM orders")
def _(spark, d):
    s = F.col("o_orderkey").cast("string")
    return _mixed(spark, d).select("o_orderkey", x.work_id("id").alias("a"), x.work_id(F.concat(F.lit("https://openalex.org/W"), s)).alias("b"), x.work_id(F.concat(F.lit("https://doi.org/10.1/"), s)).alias("c"))


@query("c23_ror_url", "SELECT n_nationkey, 'https://ror.org/' || n_nationkey AS ror FROM nation")
def _(spark, d):
    s = F.col("n_nationkey").cast("string")
    return t.table(spark, d, "nation").select("n_nationkey", x.ror_url(F.when(F.col("n_nationkey") % 2 == 0, s).otherwise(F.concat(F.lit("https://ror.org/"), s))).alias("ror"))


@query("c24_confidence_band", "SELECT band, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l_discount * 10 >= 0.70 THEN 'high' WHEN l_discount * 10 >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM lineitem) GROUP BY 1")
def _(spark, d):
    return t.table(spark, d, "lineitem").groupBy(x.confidence_band(F.col("l_discount") * 10).alias("band")).agg(F.count("*").alias("n"))


@query("c25_agreed_specialists", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END::INT AS n FROM nation")
def _(spark, d):
    text = F.when(F.col("n_nationkey") % 2 == 0, "Agreed by: header, footnote, header").otherwise("nothing")
    return t.table(spark, d, "nation").select("n_nationkey", F.size(x.agreed_specialists(text)).alias("n"))


@query("c26_json_block", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props END AS block FROM events")
def _(spark, d):
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n"), "props", F.lit("\nDone."))).otherwise("no {json here}")
    return t.table(spark, d, "events").select("event_id", x.json_block(said).alias("block"))


@query("c27_citations", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a,b' ELSE 'b' END AS cited FROM nation")
def _(spark, d):
    known = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    return t.table(spark, d, "nation").select("n_nationkey", F.array_join(x.cited(F.lit("x [a] y [b] z [c]"), known), ",").alias("cited"))


@query("c28_node_type", f"SELECT o_orderkey, CASE WHEN contains({_AX}, '/') THEN 'Paper' ELSE 'Venue' END AS kind FROM orders")
def _(spark, d):
    return _mixed(spark, d).select("o_orderkey", x.node_type("id").alias("kind"))


@query("c29_mentions", r"""SELECT n_nationkey, 'Ann Lee' AS names, 'neurips' AS venues, 'mit,eth' AS institutions, (2000 + n_nationkey)::INT AS year FROM nation""")
def _(spark, d):
    q = F.concat(F.lit("did Ann Lee of MIT and eth publish at NeurIPS in "), (F.col("n_nationkey") + 2000).cast("string"), F.lit("?"))
    m = x.mentions(q)
    return t.table(spark, d, "nation").select("n_nationkey", *(F.array_join(m[k], ",").alias(k) for k in ("names", "venues", "institutions")), m["year"].alias("year"))


@query("c30_year_of", "SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders")
def _(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", x.year_of(F.date_format("o_orderdate", "yyyyMMdd")).alias("year"))


@query("c31_concept", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'machine learning' WHEN 1 THEN 'database' ELSE 'q-bio' END AS concept FROM nation")
def _(spark, d):
    m = F.col("n_nationkey") % 3
    return t.table(spark, d, "nation").select("n_nationkey", x.concept(F.when(m == 0, "cs.LG").when(m == 1, "cs.DB").otherwise("q-bio")).alias("concept"))


@query("c32_payload", """SELECT n_nationkey, '{"k":' || n_nationkey || ',"name":"' || n_name || '"}' AS payload FROM nation""")
def _(spark, d):
    return t.table(spark, d, "nation").select("n_nationkey", x.payload(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("payload"))


@query("c33_half_even", "SELECT l_linenumber, count(*)::BIGINT AS n, round_even(l_linenumber / 8, 2) AS rounded FROM lineitem GROUP BY 1")
def _(spark, d):
    return t.table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n")).select("l_linenumber", "n", F.bround(F.col("l_linenumber") / 8, 2).alias("rounded"))


@query("c34_token_estimate", "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", x.token_estimate("text").alias("tokens"))


@query("c35_country_fallback", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Unknown' END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'XX' ELSE 'AB' END AS code FROM nation")
def _(spark, d):
    k = F.col("n_nationkey")
    name, code = x.country_or_unknown(F.when(k % 2 == 0, F.col("n_name")).otherwise(""), F.when(k % 3 != 0, "AB"))
    return t.table(spark, d, "nation").select("n_nationkey", name.alias("name"), code.alias("code"))


@query("c38_one_hot", "SELECT n_nationkey, (n_nationkey % 3)::INT AS place, 1.0::DOUBLE AS total FROM nation")
def _(spark, d):
    hot = x.one_hot(F.when(F.col("n_nationkey") % 3 == 0, "education").when(F.col("n_nationkey") % 3 == 1, "company").otherwise("facility"))
    return t.table(spark, d, "nation").select("n_nationkey", (F.array_position(hot, F.lit(1.0)) - 1).cast("int").alias("place"), F.aggregate(hot, F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("c41_expand_abbreviation", "SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 'Asia Institute' ELSE r_name END AS name FROM region")
def _(spark, d):
    return t.table(spark, d, "region").select("r_regionkey", x.expand_abbreviation("r_name", {"asia": "Asia Institute"}).alias("name"))


@query("c42_arxiv_prefix", f"SELECT o_orderkey, CASE WHEN contains({_AX}, '.') THEN 'ARXIV:' || {_AX} ELSE {_AX} END AS loose, CASE WHEN contains({_AX}, '.') AND NOT starts_with({_AX}, '10.') THEN 'ARXIV:' || {_AX} ELSE {_AX} END AS strict FROM orders")
def _(spark, d):
    return _mixed(spark, d).select("o_orderkey", x.arxiv_prefixed("id").alias("loose"), x.arxiv_prefixed("id", True).alias("strict"))


@query("s19_source_of", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'doi' ELSE 'openalex' END AS source FROM orders")
def _(spark, d):
    return _mixed(spark, d).select("o_orderkey", x.source_of("id").alias("source"))
