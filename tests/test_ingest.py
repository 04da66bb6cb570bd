"""Work items to graph, twice; the command line; link features and their model; streams with late rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scholium import __main__ as cli
from scholium.operators import forecast
from scholium.plans import ingest
from scholium.sources import generations, readers, sinks
from scholium.streaming import progress


HOUSES = ("Lund University", "Helmholtz Centre Jena", "Amazon Web Services", "Town Hall of Bergen", "Kyoto College of Arts")
PEOPLE = ("Ines Roca", "Tove Lind", "Kofi Mensah", "Yuki Mori", "Olga Petrova", "Sam Field", "Ana Cruz")


def item(n: int) -> dict:
    """Work item n: one to three of seven people, whose houses move on by a step each third item."""
    crew = [PEOPLE[(n * 2 + k) % 7] for k in range(1 + n % 3)]
    found = [
        {"candidate_id": f"w{n}/{who}", "author_name": who, "affiliations": [HOUSES[(PEOPLE.index(who) + n // 3) % 5]], "emails": []} for who in crew
    ]
    return {
        "canonical_paper": {"paper_id": f"arxiv:24{n:02d}.7", "title": f"On rivers, part {n}", "venue": ("SIGIR", "KDD", "VLDB")[n // 4 % 3], "year": 2015 + n // 9},
        "merged_candidates": found,
        "verdicts": [{"candidate_id": c["candidate_id"], "decision": "reject" if c["author_name"] == "Sam Field" else "accept", "confidence": 0.8, "evidence_ids": []} for c in found],
    }


def expected(items: list[dict]) -> dict[str, int]:
    """Sizes of the graph's tables, counted one by one."""
    authored, affiliated, pairs, houses = set(), set(), set(), {}
    for one in items:
        paper = one["canonical_paper"]["paper_id"]
        taken = {v["candidate_id"] for v in one["verdicts"] if v["decision"] == "accept"}
        for c in one["merged_candidates"]:
            if c["candidate_id"] in taken:
                authored.add((c["author_name"], paper))
                affiliated.add((c["author_name"], c["affiliations"][0], paper))
                houses.setdefault((paper, one["canonical_paper"]["year"]), set()).add(c["affiliations"][0])
        crew = [a for a, p in authored if p == paper]
        pairs |= {(a, b, paper) for a in crew for b in crew if a != b}
    met = {(a, b, year) for (_, year), those in houses.items() for a in those for b in those if a != b}
    return {
        "paper": len({i["canonical_paper"]["paper_id"] for i in items}), "venue": len({i["canonical_paper"]["venue"] for i in items}),
        "author": len({a for a, _ in authored}), "institution": len({h for _, h, _ in affiliated}), "authored": len(authored),
        "affiliated_at": len(affiliated), "coauthored_with": len(pairs), "collaborated_with": len(met), "topic": 0, "about": 0, "child_of": 0,
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("items")
    lines = [json.dumps(item(n)) for n in range(36)]
    (path / "items.jsonl").write_text("\n".join([*lines[:20], "", "{broken", *lines[5:9]]) + "\n")
    (path / "later.jsonl").write_text("\n".join(lines[15:]) + "\n")
    return path


def sizes(tables) -> dict[str, int]:
    return {n: tables[n].count() for n in expected([])}


def test_counts_of_the_generated_items(spark, folder):
    items, bad = readers.read_work_items(spark, str(folder / "items.jsonl"))
    tables = ingest.graph_from_items(items)
    assert bad.count() == 1 and sizes(tables) == expected([item(n) for n in range(20)])
    types = {r["canonical_name"]: r["org_type"] for r in tables["institution"].collect()}
    assert types == dict(zip(HOUSES, ("education", "facility", "company", "other", "education")))


def test_command_line_merges_into_the_graph(spark, folder, capsys):
    out = str(folder / "graph")
    cli.main(["ingest", str(folder / "items.jsonl"), out])
    shown = capsys.readouterr().out
    assert "24 items, 1 bad lines" in shown and "20 paper, 6 author, 5 institution, 3 venue" in shown
    cli.main(["ingest", str(folder / "later.jsonl"), out])
    whole = expected([item(n) for n in range(36)])
    assert f"{whole['paper']} paper, {whole['author']} author" in capsys.readouterr().out
    assert sizes(readers.open_graph(spark, out)) == whole
    before = {n: sorted(map(str, t.collect())) for n, t in readers.open_graph(spark, out).items()}
    cli.main(["ingest", str(folder / "items.jsonl"), out])  # what is known changes nothing
    assert {n: sorted(map(str, t.collect())) for n, t in readers.open_graph(spark, out).items()} == before
    assert generations.complete(spark, out) == [1, 2]
    # a generation that was not written to the end is not seen
    readers.open_graph(spark, out)["paper"].limit(0).write.parquet(f"{out}/generation=3/paper")
    assert sizes(readers.open_graph(spark, out)) == whole
    capsys.readouterr()
    cli.main(["query", "industry_share_by_venue", out, "--venue", "kdd", "--year", "2015"])
    assert "kdd" in capsys.readouterr().out
    cli.main(["query", "top_institutions_by_venue", out, "--venue", "sigir", "--top-k", "5"])
    assert "Lund University" in capsys.readouterr().out
    cli.main(["query", "country_strategy_heatmap", out])
    cli.main(["query", "coauthor_neighborhood", out, "--author-id", "name:tove_lind"])
    by_id = capsys.readouterr().out
    cli.main(["query", "coauthor_neighborhood", out, "--author-name", "TOVE"])
    assert "name:kofi_mensah" in by_id and capsys.readouterr().out in by_id


def test_merged_properties(spark):
    one, two = item(1), item(1)
    two["canonical_paper"]["title"] = "On rivers, revised"
    two["merged_candidates"] = [{**two["merged_candidates"][0], "author_name": "Kofi  Mensah"}, {"candidate_id": "x", "author_name": "New Person", "affiliations": [], "emails": []}]
    two["verdicts"] = [{"candidate_id": c["candidate_id"], "decision": "accept", "confidence": 1.0, "evidence_ids": []} for c in two["merged_candidates"]]
    read = lambda x: spark.read.schema(readers.WORK_ITEM).json(spark.createDataFrame([(json.dumps(x),)], "value string").rdd.map(lambda r: r[0]))
    got = ingest.merged(ingest.graph_from_items(read(one)), ingest.graph_from_items(read(two)))
    assert [r["title"] for r in got["paper"].collect()] == ["On rivers, revised"]
    names = {r["canonical_id"]: r["name_variants"] for r in got["author"].collect()}
    assert names == {"name:kofi_mensah": ["Kofi  Mensah", "Kofi Mensah"], "name:yuki_mori": ["Yuki Mori"], "name:new_person": ["New Person"]}
    assert got["coauthored_with"].count() == 6  # a new author is paired with those already known


def test_registry_id_of_a_candidate_covers_its_affiliations(spark):
    raw = item(1)
    raw["merged_candidates"][0]["affiliations"] = ["X Lab", "Y Lab"]
    raw["merged_candidates"][0]["evidence_trail"] = {"items": [{"evidence_id": "e1", "tool": "ror", "raw_response": '{"ror_id": "https://ror.org/abc"}'}]}
    items = spark.read.schema(readers.WORK_ITEM).json(spark.createDataFrame([(json.dumps(raw),)], "value string").rdd.map(lambda r: r[0]))
    tables = ingest.graph_from_items(items)
    assert {r["ror_id"]: r["canonical_name"] for r in tables["institution"].collect()}["https://ror.org/abc"] == "Y Lab"
    assert tables["evidence"].count() == 1


def test_analysis(spark):
    author = "array<struct<name:string,raw_affiliation:string,confidence:double>>"
    papers = spark.createDataFrame([("p", "2024-01-01", [("Ann", "MIT", 0.9), ("Bo", "Nowhere", 0.9), ("Cy", None, None)])], f"paper_id string, published_date string, authors {author}")
    kb = spark.createDataFrame([(0, "mit", "Massachusetts Institute of Technology")], "pos int, variant string, canonical string")
    report = ingest.analyse(papers, kb)
    flat = {r["name"]: (r["inst_name"], r["confidence"]) for r in report["flat"].collect()}
    assert flat["Ann"] == ("Massachusetts Institute of Technology", 0.9) and flat["Bo"] == ("Nowhere", 0.3) and flat["Cy"] == (None, 0.3)
    assert report["top_organizations"].count() == 2


def test_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(1).alias("n"))
    got = forecast.running_sums(df, "k", ["n"], ranges=8).collect()
    assert all(r["n_before"] == r["k"] and r["n_total"] == 1000 for r in got)


def test_link_model_learns(spark):
    df = spark.createDataFrame([(float(i % 2) * 3 + i / 100, i % 2) for i in range(100)], "common double, label int")
    model = forecast.train_link_model(df, ["common"])
    assert model.summary.areaUnderROC > 0.95


def test_tables_as_text(spark):
    df = spark.createDataFrame([(1, "a_b")], "rank int, name string")
    assert sinks.markdown_table(df, ["rank", "name"]).splitlines()[2] == "| 1 | a_b |"
    assert r"a\_b" in sinks.latex_table(df, ["rank", "name"])
    assert sinks.ascii_table(df, ["rank", "name"]).splitlines()[0] == "rank | name"


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    write = progress.upsert_sink(path, ["k"], "seq", buckets=4)
    schema = "k string, seq int, v int"
    one = spark.createDataFrame([(f"k{i}", 1, 10 * i) for i in range(40)], schema)
    two = spark.createDataFrame([("k7", 2, 11)], schema)
    three = spark.createDataFrame([("k7", 3, 12), ("new", 3, 1)], schema)
    for batch, epoch in ((one, 0), (two, 1), (two, 1), (three, 2), (three, 2)):
        write(batch, epoch)
    want = {f"k{i}": (1, 10 * i) for i in range(40)} | {"k7": (3, 12), "new": (3, 1)}
    got = progress.read_generation(spark, path)
    assert got.columns == ["k", "seq", "v"] and {r["k"]: (r["seq"], r["v"]) for r in got.collect()} == want
    states = progress._states(spark, path)
    assert states[min(states)] and all(len(epochs) <= 3 for epochs in states.values())
    untouched = [b for b, epochs in states.items() if epochs == [0]]
    assert untouched  # a batch rewrites its own buckets only


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """A second run with the same checkpoint takes what is new and counts nothing twice."""
    source, table = tmp_path / "in", str(tmp_path / "table")
    for n in range(2):
        rows = [(k, n, 1) for k in range(5 * (n + 1))]
        spark.createDataFrame(rows, "k long, seq long, n long").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k long, seq long, n long").parquet(str(source))
        run = stream.writeStream.foreachBatch(progress.upsert_sink(table, ["k"], "seq")).option("checkpointLocation", str(tmp_path / "state"))
        query = run.trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["numInputRows"] == 5 * (n + 1)
    got = {r["k"]: r["seq"] for r in progress.read_generation(spark, table).collect()}
    assert got == {k: 1 for k in range(10)}


def test_late_rows_are_left_out(spark, tmp_path):
    source = tmp_path / "in"
    for n, day in enumerate(("2024-01-05", "2024-01-06", "2024-01-01", "2024-01-09", "2024-01-10")):
        spark.createDataFrame([(n, day)], "event_id long, d string").select("event_id", F.to_timestamp("d").alias("ts"), F.lit("x").alias("event_type")).coalesce(1).write.mode("append").parquet(str(source))
        import time

        time.sleep(1.1)  # files are taken in order of time
    rows = progress.windowed_progress(progress.read_events(spark, str(source)))
    run = rows.writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    days = {str(r["window"]["start"])[:10] for r in spark.sql("select * from late").collect()}
    assert "2024-01-01" not in days and {"2024-01-05", "2024-01-06"} <= days
