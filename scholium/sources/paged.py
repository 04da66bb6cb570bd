"""Searches of three paper services as a Spark data source: planned pages, pushed filters, and a stream of new results.

    spark.dataSource.register(PagedSearch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # for filters in the request
    spark.read.format("paper_search").options(service="openalex", url=..., query="graphs").load().filter("year >= 2020")

Comparisons of ``year`` go into the request, as far as the service has words for them, and are checked again by
Spark. The plan asks once for the number of results and cuts them into pages, ``pages`` of which one task reads; a task that
is lost asks for its pages again. ``limit`` bounds the results, the latest first. A stream takes results in order
of their date, oldest first, and its offset is their number, so a restart goes on where the last batch ended.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan,
    LessThanOrEqual,
)

from scholium.sources.fetch import Busy, retried

SCHEMA = (
    "paper_id string, title string, abstract string, year int, published string, categories array<string>, "
    "authors array<struct<name: string, aff: string, confidence: double>>, place long"
)
#: The services' largest pages, and the length abstracts are cut to.
PAGE = {"semantic_scholar": 100, "openalex": 200, "arxiv": 100}
ABSTRACT = 500
_ATOM = {"a": "http://www.w3.org/2005/Atom", "o": "http://a9.com/-/spec/opensearch/1.1/", "x": "http://arxiv.org/schemas/atom"}


@dataclass
class Years:
    """Bounds of the year, both included; None is open."""

    low: int | None = None
    high: int | None = None

    def narrow(self, low: int | None = None, high: int | None = None) -> None:
        self.low = low if self.low is None else self.low if low is None else max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)

    def empty(self) -> bool:
        return self.low is not None and self.high is not None and self.low > self.high

    def take(self, given: Filter) -> bool:
        """Narrow the bounds by a comparison of the year; whether it was one."""
        if getattr(given, "attribute", None) != ("year",) or not isinstance(getattr(given, "value", None), int):
            return False
        if isinstance(given, EqualTo):
            self.narrow(given.value, given.value)
        elif isinstance(given, GreaterThanOrEqual):
            self.narrow(low=given.value)
        elif isinstance(given, GreaterThan):
            self.narrow(low=given.value + 1)
        elif isinstance(given, LessThanOrEqual):
            self.narrow(high=given.value)
        elif isinstance(given, LessThan):
            self.narrow(high=given.value - 1)
        else:
            return False
        return True


def request(options: dict[str, str], years: Years, start: int, size: int, oldest_first: bool = False) -> str:
    """The address of results ``start`` to ``start + size`` (a whole page, of ``size`` results)."""
    service, query = options["service"], options.get("query", "")
    categories = [c for c in options.get("categories", "").split(",") if c]
    if service == "semantic_scholar":
        path, asked = "/paper/search", {"query": query, "offset": start, "limit": size, "fields": "paperId,title,abstract,year,publicationDate,fieldsOfStudy,authors.name,authors.affiliations"}
        if years.low is not None or years.high is not None:
            asked["year"] = f"{'' if years.low is None else years.low}-{'' if years.high is None else years.high}"
        if categories:
            asked["fieldsOfStudy"] = ",".join(categories)
        if oldest_first:
            asked["sort"] = "publicationDate:asc"
    elif service == "openalex":
        path, asked = "/works", {"search": query, "per_page": size, "page": start // size + 1, "select": "id,title,publication_year,publication_date,concepts,authorships"}
        kept = [f"publication_year:>{years.low - 1}"] if years.low is not None else []
        kept += [f"publication_year:<{years.high + 1}"] if years.high is not None else []
        kept += [f"concepts.display_name.search:{'|'.join(categories)}"] if categories else []
        if kept:
            asked["filter"] = ",".join(kept)
        asked["sort"] = "publication_date:asc" if oldest_first else "publication_date:desc"
    elif service == "arxiv":
        if years.low is not None and years.high is not None:  # the service has no open range
            query = f"{query} AND submittedDate:[{years.low}01010000 TO {years.high}12312359]"
        if categories:
            query = f"({query}) AND ({' OR '.join(f'cat:{c}' for c in categories)})"
        path, asked = "/query", {"search_query": query, "start": start, "max_results": size, "sortBy": "submittedDate", "sortOrder": "ascending" if oldest_first else "descending"}
    else:
        raise ValueError(f"unknown service: {service}")
    return f"{options['url'].rstrip('/')}{path}?{urllib.parse.urlencode(asked)}"


def fetch(address: str, options: dict[str, str]) -> bytes:
    """The answer's body; busy servers and broken connections are asked again, other errors end the task."""

    def call(_attempt: int) -> bytes:
        try:
            with urllib.request.urlopen(address, timeout=float(options.get("timeout", 60))) as answer:
                return answer.read()
        except urllib.error.HTTPError as problem:
            if problem.code in (429, 500, 502, 503, 504):
                after = problem.headers.get("Retry-After")
                raise Busy(float(after) if after and after.isdigit() else None) from problem
            raise
        except urllib.error.URLError as problem:
            raise ConnectionError(str(problem.reason)) from problem

    body, attempts, error = retried(call, int(options.get("attempts", 4)), float(options.get("base", 1)), 60.0)
    if body is None:
        raise OSError(f"{error} after {attempts} attempts: {address}")
    return body


def _cut(text: str | None) -> str | None:
    return None if text is None else text[:ABSTRACT]


def parsed(service: str, body: bytes) -> tuple[int, list[tuple]]:
    """(number of all results, rows without their place) of an answer."""
    if service == "arxiv":
        root = ElementTree.fromstring(body)
        rows = []
        for entry in root.findall("a:entry", _ATOM):
            text = lambda name, e=entry: (e.findtext(f"a:{name}", None, _ATOM) or "").strip() or None
            day = (text("published") or "")[:10] or None
            authors = [(a.findtext("a:name", "", _ATOM), "", 0.5) for a in entry.findall("a:author", _ATOM)]
            kinds = [c.get("term") for c in entry.findall("a:category", _ATOM)]
            rows.append(((text("id") or "").rsplit("/abs/", 1)[-1], text("title"), _cut(text("summary")), int(day[:4]) if day else None, day, kinds, authors))
        return int(root.findtext("o:totalResults", "0", _ATOM)), rows
    found = json.loads(body)
    rows = []
    if service == "semantic_scholar":
        for item in found.get("data") or []:
            authors = [(a.get("name"), (a.get("affiliations") or [None])[0], 0.9 if a.get("affiliations") else 0.5) for a in item.get("authors") or []]
            rows.append((item.get("paperId"), item.get("title"), _cut(item.get("abstract")), item.get("year"), item.get("publicationDate"), item.get("fieldsOfStudy") or [], authors))
        return int(found.get("total") or 0), rows
    for item in found.get("results") or []:
        authors = []
        for a in item.get("authorships") or []:
            first = (a.get("institutions") or [{}])[0].get("display_name")
            authors.append(((a.get("author") or {}).get("display_name"), first, 0.92 if first else 0.5))
        kinds = [c.get("display_name") for c in item.get("concepts") or []]
        rows.append((item.get("id"), item.get("title"), None, item.get("publication_year"), item.get("publication_date"), kinds, authors))
    return int((found.get("meta") or {}).get("count") or 0), rows


@dataclass
class Pages(InputPartition):
    """Pages ``first`` to ``last`` (not included), and which of their results count."""

    first: int
    last: int
    start: int
    end: int


class _Search:
    def __init__(self, options: dict[str, str]):
        self.options, self.years = dict(options), Years()
        self.size = min(int(options.get("page_size", PAGE[options["service"]])), PAGE[options["service"]])

    def total(self, oldest_first: bool = False) -> int:
        """The number of results, by a page of one."""
        if self.years.empty():
            return 0
        return parsed(self.options["service"], fetch(request(self.options, self.years, 0, 1, oldest_first), self.options))[0]

    def planned(self, start: int, end: int) -> list[Pages]:
        first, last, each = start // self.size, -(-end // self.size), int(self.options.get("pages", 1))
        return [Pages(at, min(last, at + each), start, end) for at in range(first, last, each)] if end > start else []

    def rows(self, part: Pages, oldest_first: bool = False) -> Iterator[tuple]:
        pause = float(self.options.get("pause", 0))
        for page in range(part.first, part.last):
            time.sleep(pause if page > part.first else 0)
            _, found = parsed(self.options["service"], fetch(request(self.options, self.years, page * self.size, self.size, oldest_first), self.options))
            for n, row in enumerate(found, page * self.size):
                if part.start <= n < part.end:
                    yield (*row, n)


class SearchReader(_Search, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Years go into the request. All are returned, so that Spark checks what services answer."""
        for one in filters:
            self.years.take(one)
            yield one

    def partitions(self) -> list[Pages]:
        limit = self.options.get("limit")
        total = self.total()
        return self.planned(0, total if limit is None else min(total, int(limit))) or [Pages(0, 0, 0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from self.rows(partition)


class SearchStream(_Search, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if "from_year" in options:
            self.years.narrow(low=int(options["from_year"]))

    def initialOffset(self) -> dict:
        return {"results": 0}

    def latestOffset(self) -> dict:
        return {"results": self.total(True)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.planned(start["results"], end["results"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from self.rows(partition, True)


class PagedSearch(DataSource):
    """``paper_search``: options service, url, query, and optionally categories, limit, page_size, pages, pause, attempts."""

    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)

    def streamReader(self, schema) -> SearchStream:
        return SearchStream(self.options)
