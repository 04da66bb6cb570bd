"""The search source against a local server: paging, filters in the request, retries, and a stream that restarts."""

from __future__ import annotations

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from scholium.sources.paged import PagedSearch, Years, parsed


class Server(ThreadingHTTPServer):
    """Papers 0 to n - 1, of years 2000 + i % 20; the latest first unless asked otherwise."""

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.n, self.asked, self.fail = 0, [], 0


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        path, _, query = self.path.partition("?")
        asked = dict(urllib.parse.parse_qsl(query))
        self.server.asked.append((path, asked))
        if self.server.fail:
            self.server.fail -= 1
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        papers = list(range(self.server.n))
        if path == "/works":
            for bound in asked.get("filter", "").split(","):
                if bound.startswith("publication_year:>"):
                    papers = [i for i in papers if 2000 + i % 20 > int(bound[18:])]
                if bound.startswith("publication_year:<"):
                    papers = [i for i in papers if 2000 + i % 20 < int(bound[18:])]
            size, start = int(asked["per_page"]), (int(asked["page"]) - 1) * int(asked["per_page"])
        elif path == "/paper/search":
            size, start = int(asked["limit"]), int(asked["offset"])
        else:
            size, start = int(asked["max_results"]), int(asked["start"])
        if "asc" not in asked.get("sort", "") + asked.get("sortOrder", "x")[:3]:
            papers = papers[::-1]
        total, page = len(papers), papers[start : start + size]
        if path == "/works":
            body = json.dumps({"meta": {"count": total}, "results": [
                {"id": f"W{i}", "title": f"T{i}", "publication_year": 2000 + i % 20, "authorships": [{"author": {"display_name": "Ann"}, "institutions": [{"display_name": "Lund"}, {"display_name": "Jena"}]}, {"author": None, "institutions": []}]}
                for i in page]})
        elif path == "/paper/search":
            body = json.dumps({"total": total, "data": [{"paperId": f"S{i}", "title": None, "abstract": "x" * 900, "year": 2000 + i % 20, "authors": [{"name": "Bo", "affiliations": ["Jena"]}, {"name": "Cy"}]} for i in page]})
        else:
            entries = "".join(f"<entry><id>http://arxiv.org/abs/{i}v1</id><title>T{i}</title><published>{2000 + i % 20}-02-03T00:00:00Z</published><author><name>Di</name></author><category term='cs.AI'/></entry>" for i in page)
            body = f"<feed xmlns='http://www.w3.org/2005/Atom' xmlns:o='http://a9.com/-/spec/opensearch/1.1/'><o:totalResults>{total}</o:totalResults>{entries}</feed>"
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())


@pytest.fixture
def server(spark):
    with Server() as one:
        threading.Thread(target=one.serve_forever, daemon=True).start()
        spark.dataSource.register(PagedSearch)
        before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        yield one
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
        one.shutdown()


def reader(spark, server, service, **more):
    return spark.read.format("paper_search").options(service=service, url=f"http://127.0.0.1:{server.server_port}", query="graphs", base="0.01", **more)


@pytest.mark.parametrize(("service", "prefix"), [("openalex", "W"), ("semantic_scholar", "S"), ("arxiv", "")])
def test_pages_until_the_total(spark, server, service, prefix):
    server.n = 53
    rows = reader(spark, server, service, page_size=10, pages=2).load()
    got = rows.collect()
    assert sorted(r["paper_id"].removesuffix("v1") for r in got) == sorted(f"{prefix}{i}" for i in range(53))
    assert sorted(r["place"] for r in got) == list(range(53)) and rows.rdd.getNumPartitions() == 3
    limited = reader(spark, server, service, page_size=10, limit=12).load().collect()
    assert {r["paper_id"].removesuffix("v1") for r in limited} == {f"{prefix}{i}" for i in range(41, 53)}
    server.n = 0
    assert reader(spark, server, service).load().count() == 0


def test_rows(spark, server):
    server.n = 1
    work = reader(spark, server, "openalex").load().first()
    assert [tuple(a) for a in work["authors"]] == [("Ann", "Lund", 0.92), (None, None, 0.5)] and work["year"] == 2000
    paper = reader(spark, server, "semantic_scholar").load().first()
    assert [tuple(a) for a in paper["authors"]] == [("Bo", "Jena", 0.9), ("Cy", None, 0.5)] and len(paper["abstract"]) == 500
    entry = reader(spark, server, "arxiv").load().first()
    assert (entry["published"], entry["categories"], [tuple(a) for a in entry["authors"]]) == ("2000-02-03", ["cs.AI"], [("Di", "", 0.5)])


def test_filters_are_seen_in_the_request(spark, server):
    server.n = 100
    found = reader(spark, server, "openalex", categories="Physics,Biology").load().filter("year >= 2010 and year < 2013 and title like 'T%'")
    assert {r["year"] for r in found.collect()} == {2010, 2011, 2012} and found.count() == 15
    asked = {a.get("filter") for _, a in server.asked}
    assert asked == {"publication_year:>2009,publication_year:<2013,concepts.display_name.search:Physics|Biology"}
    server.asked.clear()
    assert reader(spark, server, "semantic_scholar").load().filter("year > 2017").count() == 10  # the server ignores it, Spark does not
    assert {a.get("year") for _, a in server.asked} == {"2018-"}
    server.asked.clear()
    one = reader(spark, server, "arxiv", categories="cs.AI,cs.CL").load()
    assert one.filter("year = 2005").count() == 5 and one.filter("year <= 2005").count() == 30
    queries = {a["search_query"] for _, a in server.asked}
    assert queries == {"(graphs AND submittedDate:[200501010000 TO 200512312359]) AND (cat:cs.AI OR cat:cs.CL)", "(graphs) AND (cat:cs.AI OR cat:cs.CL)"}
    server.asked.clear()
    assert reader(spark, server, "openalex").load().filter("year > 2012 and year < 2010").count() == 0 and not server.asked


def test_busy_servers_are_asked_again(spark, server):
    server.n, server.fail = 5, 2
    assert reader(spark, server, "openalex").load().count() == 5
    server.fail = 50
    with pytest.raises(Exception, match="Busy after 2 attempts"):
        reader(spark, server, "openalex", attempts=2).load().count()


def test_a_stream_goes_on_from_its_committed_offset(spark, server, tmp_path):
    server.n = 23

    def run():
        rows = spark.readStream.format("paper_search").options(service="openalex", url=f"http://127.0.0.1:{server.server_port}", query="graphs", page_size="10").load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start(str(tmp_path / "rows"))
        query.awaitTermination(60)

    run()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 23
    server.n = 41
    server.asked.clear()
    run()
    got = spark.read.parquet(str(tmp_path / "rows"))
    assert sorted(int(r["paper_id"][1:]) for r in got.collect()) == list(range(41))
    assert {a["page"] for _, a in server.asked if a["per_page"] == "10"} == {"3", "4", "5"}  # pages 1 and 2 are not read again


def test_years_and_unknown_services():
    years = Years()
    years.narrow(low=2001)
    years.narrow(low=1999, high=2005)
    assert (years.low, years.high, years.empty()) == (2001, 2005, False)
    assert parsed("semantic_scholar", b"{}") == (0, []) and parsed("openalex", b"{}") == (0, [])
