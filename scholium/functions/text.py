"""Normalisation, keys and patterns as column expressions; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def norm_name(c: ColumnOrName) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.regexp_replace(F.lower(strip(c)), r"\s+", " ")


def norm_aff(c: ColumnOrName) -> Column:
    """Lower case, all but letters, digits, underscores and spaces blanked, collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(c: ColumnOrName) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def venue_key(c: ColumnOrName) -> Column:
    key = F.regexp_replace(F.lower(strip(c)), r"\s+", "_")
    return F.coalesce(F.when(key != "", key), F.lit("unknown"))


def paper_key(c: ColumnOrName) -> Column:
    """A DOI without its prefix, else a stable synthetic key."""
    c = _col(c)
    return F.when(c.startswith("doi:"), F.substring(c, 5, 1 << 20)).otherwise(
        F.concat(F.lit("synthetic:"), F.substring(F.sha1(c), 1, 12))
    )


def author_key(cluster: ColumnOrName, s2: ColumnOrName, name: ColumnOrName) -> Column:
    known = F.coalesce(F.nullif(_col(cluster), F.lit("")), F.nullif(_col(s2), F.lit("")))
    slug = F.regexp_replace(F.lower(strip(name)), r"\s+", "_")
    return F.when(known.isNotNull(), F.concat(F.lit("s2:"), known)).otherwise(F.concat(F.lit("name:"), slug))


def institution_key(ror: ColumnOrName, aff: ColumnOrName) -> Column:
    slug = F.substring(F.regexp_replace(F.lower(strip(aff)), r"\s+", "_"), 1, 80)
    return F.coalesce(F.nullif(_col(ror), F.lit("")), F.concat(F.lit("name:"), slug))


def first_ror(items: ColumnOrName) -> Column:
    """First payload that is a registry id, of an array of ids in trail order."""
    return F.get(F.filter(_col(items), lambda x: x.startswith("https://ror.org/")), F.lit(0))


#: Keywords of each type, tried in this order.
ORG_TYPES = (
    ("education", ("university", "college", "institute", "school", "academia", "eth", "mit", "caltech")),
    ("company", ("google", "microsoft", "amazon", "meta", "apple", "deepmind", "openai", "anthropic")),
    ("facility", ("lab", "research", "centre", "center")),
)


def org_type(c: ColumnOrName, whole_words: bool = False) -> Column:
    """The first type with a keyword in the name; by default any substring counts, as in the original rule."""
    name, out = F.lower(_col(c)), None
    for kind, words in ORG_TYPES:
        pattern = "|".join(words)
        hit = name.rlike(rf"\b(?:{pattern})\b" if whole_words else pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def safe_name(c: ColumnOrName) -> Column:
    return F.translate(_col(c), "/.", "__")


def run_id(system: ColumnOrName, manifest: ColumnOrName, revision: ColumnOrName, extra: ColumnOrName) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", _col(system), F.md5(_col(manifest)), _col(revision), _col(extra)), 256), 1, 16)


def span_id(specialist: ColumnOrName, page: ColumnOrName, text: ColumnOrName) -> Column:
    joined = F.concat_ws("|", _col(specialist), _col(page).cast("string"), _col(text))
    return F.concat(F.lit("span_"), F.substring(F.sha1(joined), 1, 10))


def layout_hash(counts: ColumnOrName) -> Column:
    """Of a map of counts as JSON with sorted keys."""
    entries = F.array_sort(F.map_entries(_col(counts)))
    return F.substring(F.sha1(F.to_json(F.map_from_entries(entries))), 1, 8)


#: Fixed value: what counts as an address.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"


def emails(c: ColumnOrName) -> Column:
    """Distinct addresses in order, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(c), F.lit(EMAIL), F.lit(0)), F.lower))


def email_domain(c: ColumnOrName) -> Column:
    return F.lower(F.element_at(F.split(_col(c), "@"), -1))


def name_from_email(c: ColumnOrName) -> Column:
    """Name parts of the local part, if there are two or more; else empty."""
    parts = F.filter(F.split(F.get(F.split(_col(c), "@"), F.lit(0)), "[._-]"), lambda p: F.length(p) >= 2)
    shown = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20))))
    return F.when(F.contains(_col(c), F.lit("@")) & (F.size(parts) >= 2), F.array_join(shown, " ")).otherwise("")


def is_arxiv_id(c: ColumnOrName) -> Column:
    return _col(c).rlike(r"^\d{4}\.\d{4,5}(v\d+)?$") | _col(c).rlike(r"^[a-z-]+/\d{7}(v\d+)?$")


def strip_version(c: ColumnOrName) -> Column:
    return F.get(F.split(_col(c), "v"), F.lit(0))


def inverted_abstract(index: ColumnOrName) -> Column:
    """Text of a word -> places map; of words at one place the last in word order stays."""
    pairs = F.flatten(
        F.transform(F.array_sort(F.map_entries(_col(index))), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    )
    placed = F.array_sort(pairs)
    last = F.filter(placed, lambda x, i: F.coalesce(F.get(placed, i + 1)["p"] != x["p"], F.lit(True)))
    return F.array_join(F.transform(last, lambda x: x["w"]), " ")


def work_id(c: ColumnOrName) -> Column:
    c = _col(c)
    return (
        F.when(c.startswith("https://openalex.org/"), F.substring(c, 22, 1 << 20))
        .when(c.startswith("https://doi.org/"), F.concat(F.lit("doi:"), F.substring(c, 17, 1 << 20)))
        .when(c.startswith("10."), F.concat(F.lit("doi:"), c))
        .otherwise(c)
    )


def ror_url(c: ColumnOrName) -> Column:
    c = _col(c)
    return F.when(c.startswith("https://ror.org/"), c).otherwise(F.concat(F.lit("https://ror.org/"), c))


def confidence_band(c: ColumnOrName) -> Column:
    c = _col(c)
    return F.when(c >= 0.70, "high").when(c >= 0.45, "medium").otherwise("low")


def agreed_specialists(c: ColumnOrName) -> Column:
    """Distinct names after ``Agreed by:``."""
    listed = F.regexp_extract(_col(c), r"Agreed by:\s*(.*)", 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(listed, ","), strip), lambda x: x != "")))


def json_block(c: ColumnOrName) -> Column:
    """The outermost braces of a text, or null where they are not JSON."""
    block = F.regexp_extract(_col(c), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(block).isNotNull(), block)


def cited(c: ColumnOrName, known: ColumnOrName) -> Column:
    """Ids in square brackets that are known."""
    return F.array_intersect(F.regexp_extract_all(_col(c), F.lit(r"\[([^\]]+)\]"), F.lit(1)), _col(known))


def node_type(c: ColumnOrName) -> Column:
    c = _col(c)
    return (
        F.when(c.startswith("s2:") | c.startswith("name:"), "Author")
        .when(c.startswith("https://ror.org/") | c.startswith("ror:"), "Institution")
        .when(F.contains(c, F.lit("/")) | c.startswith("10.") | c.startswith("synthetic:"), "Paper")
        .otherwise("Venue")
    )


#: Venues and institutions that questions are searched for.
VENUES = "NeurIPS|ICML|ICLR|CVPR|ECCV|ICCV|ACL|EMNLP|NAACL|AAAI|IJCAI|KDD|WWW|SIGIR"
INSTITUTIONS = (
    "MIT|Stanford|Harvard|Berkeley|CMU|Oxford|Cambridge|Google|Microsoft|Amazon|Meta|DeepMind|OpenAI|Anthropic|ETH|"
    "Tsinghua|Peking|Toronto|NYU"
)


def mentions(c: ColumnOrName) -> dict[str, Column]:
    """Names, venues, institutions and the year that a question mentions."""
    c = _col(c)
    return {
        "names": F.concat(
            F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1)),
            F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"), F.lit(1)),
        ),
        "venues": F.transform(F.regexp_extract_all(c, F.lit(rf"(?i)\b({VENUES})\b"), F.lit(1)), F.lower),
        "institutions": F.transform(F.regexp_extract_all(c, F.lit(rf"(?i)\b({INSTITUTIONS})\b"), F.lit(1)), F.lower),
        "year": F.try_to_number(F.nullif(F.regexp_extract(c, r"\b(20\d{2})\b", 1), F.lit("")), F.lit("9999")).cast("int"),
    }


#: Subject categories and the concepts they are searched as.
CONCEPTS = {
    "cs.AI": "artificial intelligence", "cs.LG": "machine learning", "cs.CV": "computer vision",
    "cs.CL": "natural language processing", "cs.NE": "neural network", "cs.RO": "robotics", "stat.ML": "machine learning",
    "cs.IR": "information retrieval", "cs.SE": "software engineering", "cs.DB": "database",
    "cs.DC": "distributed computing", "cs.CR": "cryptography", "cs.PL": "programming languages",
}


def lookup(c: ColumnOrName, mapping: dict[str, str]) -> Column:
    """A literal map: the mapped value, else the value itself."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, _col(c)), _col(c))


def concept(c: ColumnOrName) -> Column:
    return lookup(c, CONCEPTS)


def expand_abbreviation(c: ColumnOrName, abbreviations: dict[str, str]) -> Column:
    key = F.lower(strip(c))
    pairs = F.create_map(*(F.lit(x) for kv in abbreviations.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), _col(c))


def year_of(c: ColumnOrName) -> Column:
    return F.substring(_col(c), 1, 4).try_cast("int")


def token_estimate(c: ColumnOrName) -> Column:
    return F.floor(F.length(_col(c)) / 4).cast("long")


def country_or_unknown(name: ColumnOrName, code: ColumnOrName) -> tuple[Column, Column]:
    return F.coalesce(F.nullif(_col(name), F.lit("")), F.lit("Unknown")), F.coalesce(F.nullif(_col(code), F.lit("")), F.lit("XX"))


def arxiv_prefixed(c: ColumnOrName, strict: bool = False) -> Column:
    """Any id with a dot gets the prefix; ``strict`` leaves DOIs alone."""
    dotted = F.contains(_col(c), F.lit("."))
    if strict:
        dotted = dotted & ~_col(c).startswith("10.")
    return F.when(dotted, F.concat(F.lit("ARXIV:"), _col(c))).otherwise(_col(c))


def one_hot(c: ColumnOrName) -> Column:
    """Six places: education, company, facility, government, nonprofit, other."""
    kinds = F.array(*map(F.lit, ("education", "company", "facility", "government", "nonprofit", "other")))
    place = F.when(F.array_contains(kinds, _col(c)), F.array_position(kinds, _col(c)) - 1).otherwise(5)
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (i == place).cast("double"))


def cut(c: ColumnOrName, n: int, mark: str = "") -> Column:
    """The first ``n`` characters, marked where some were cut."""
    c = _col(c)
    short = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(short, F.lit(mark))).otherwise(short) if mark else short


def payload(c: ColumnOrName) -> Column:
    return F.substring(F.to_json(_col(c)), 1, 1000)


def source_of(c: ColumnOrName) -> Column:
    """The source that an id or query names by its form."""
    c = _col(c)
    return (
        F.when(c.startswith("arxiv:") | is_arxiv_id(c), "arxiv")
        .when(c.startswith("https://openalex.org/") | c.rlike(r"^W\d+$"), "openalex")
        .when(c.startswith("10.") | c.startswith("doi:") | c.startswith("https://doi.org/"), "doi")
        .when(c.rlike("^[0-9a-f]{40}$"), "semantic_scholar")
        .otherwise("title")
    )
