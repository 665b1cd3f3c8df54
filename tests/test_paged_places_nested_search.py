"""Paged interfaces, places of rows, nested documents and the search index, against plain versions."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from polislake.functions.terms import DEL, TRIPLE_SCHEMA, TYPE
from polislake.operators import analytics as A
from polislake.operators import nested as N
from polislake.operators import search_index as S
from polislake.sources.adapters import paginate
from polislake.sources.paged import Interface, read_pages
from polislake.sources.places import with_places


@pytest.fixture
def server():
    state = {"items": [{"id": i, "text": f"é {i}"} for i in range(23)], "asked": [], "refuse": set(), "shape": "plain"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            first = q.get("offset", q.get("page", 0) * q["limit"])
            state["asked"].append(first)
            if first in state["refuse"]:
                state["refuse"].discard(first)
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            items = state["items"][first : first + q["limit"]]
            if not items and state["shape"] == "plain":
                self.send_response(204)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(items if state["shape"] == "plain" else {"page": {"content": items, "all": len(state["items"])}}).encode())

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{s.server_port}/"
    yield state
    s.shutdown()


def test_paged_source(spark, server):
    server["refuse"] = {0, 10, 20}
    df = read_pages(spark, server["url"] + "?offset={offset}&limit={limit}", size=5, pages=2, pause=0)
    got = [(r["place"], json.loads(r["item"])) for r in df.orderBy("place").collect()]
    state = Interface({"url": server["url"] + "?offset={offset}&limit={limit}", "size": "5"})
    plain = list(paginate(lambda p: (200, state.page(p["page"]), {}), {}, size=5))
    assert [x for _, x in got] == plain == server["items"] and [p for p, _ in got] == list(range(23))
    server["asked"].clear()
    df.collect()
    assert sorted(server["asked"]) == [0, 5, 10, 15, 20]  # tasks ask for each page once
    server["asked"].clear()
    assert Interface({"url": server["url"] + "?offset={offset}&limit={limit}", "size": "1"}).count() == 23
    assert len(server["asked"]) <= 2 * 6 and max(server["asked"]) <= 32


def test_paged_source_with_a_total(spark, server):
    server["shape"] = "nested"
    options = {"size": 4, "pages": 3, "items": "page/content", "total": "page/all"}
    df = read_pages(spark, server["url"] + "?page={page}&limit={limit}", **options)
    assert [json.loads(r["item"])["id"] for r in df.orderBy("place").collect()] == list(range(23))
    server["asked"].clear()
    assert df.count() == 23 and sorted(server["asked"]) == list(range(0, 24, 4))  # tasks ask for each page once
    assert read_pages(spark, server["url"] + "?page={page}&limit={limit}", most=2, **options).count() == 8
    server["items"].clear()
    assert df.count() == 0
    server["shape"] = "plain"
    assert read_pages(spark, server["url"] + "?page={page}&limit={limit}", size=4).count() == 0


def test_refusals_end(server):
    server["refuse"] = {0}
    with pytest.raises(TimeoutError):
        Interface({"url": server["url"] + "?page={page}&limit={limit}", "tries": "1", "pause": "0"}).page(0)
    with pytest.raises(Exception, match="404|refused|Error"):
        Interface({"url": "http://127.0.0.1:1/{page}"}).page(0)


@pytest.mark.parametrize("split", [60, 1000, 10**8])
def test_places(spark, tmp_path, split):
    for name, n in (("a", 57), ("b", 1), ("c", 0), ("d", 200)):
        (tmp_path / f"{name}.csv").write_text("k,place\n" + "".join(f"{name}{i},{'x' * (i % 13)}\n" for i in range(n)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        scan = spark.read.option("header", True).csv(str(tmp_path))
        got = {r["k"]: r["at"] for r in with_places(scan, "at").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {f"{name}{i}": i for name, n in (("a", 57), ("b", 1), ("d", 200)) for i in range(n)}


ROWS = [("P" if i % 3 else 'Q "x"', f"d{i % 5}" if i % 7 else None, f"2024-01-{i % 28 + 1:02}" if i % 4 else None, f"c{i:03}", f"text {i}\n") for i in range(60)] + [(None, "d1", None, "z", None)]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:8], []])
def test_nested_documents(spark, tmp_path, rows):
    schema = "platform string, process string, timestamp string, contribution string, text string"
    df = spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)
    N.write_nested(df, f"{tmp_path}/out", [("platform", "processes"), ("process", "contributions")], ["timestamp", "contribution"], F.struct("timestamp", "contribution", "text"))
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    low = lambda x: (x is not None, x or "")  # noqa: E731  nulls come first
    want = []
    for platform in sorted({r[0] for r in rows}, key=low):
        processes = sorted({r[1] for r in rows if r[0] == platform}, key=low)
        inner = [{"process": p, "contributions": [dict(zip(("timestamp", "contribution", "text"), r[2:])) for r in sorted((r for r in rows if r[:2] == (platform, p)), key=lambda r: (low(r[2]), r[3]))]} for p in processes]
        want.append({"platform": platform, "processes": inner})
    assert doc == want


def test_nested_report(spark, tmp_path):
    c = spark.createDataFrame([("c1", "d1", "p", "t1"), ("c2", "d1", "q", "t2"), ("c3", "d2", "p", "t3")], "id string, process string, participant string, text string")
    f = spark.createDataFrame([("c1", "b", "s", 0.5), ("c1", "a", "s", 0.7), ("c3", "a", "u", 1.0)], "contribution string, type string, segment string, confidence double")
    N.write_fallacy_report(c, f, f"{tmp_path}/r")
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))))
    nested = {r["process"]: r["fallacies_by_contribution"] for r in A.fallacy_report(c, f).collect() if r["fallacies_by_contribution"]}
    assert {d["process"]: [(x["id"], [(y["type"], y["segment"], y["confidence"]) for y in x["fallacies"]]) for x in d["contributions"]] for d in doc} == {
        k: [(x["id"], [tuple(y) for y in x["fallacies"]]) for x in v] for k, v in nested.items()
    }


def test_search_by_index(spark, tmp_path):
    names = ["Climate action", "climate", "ÉCOLE", "école élémentaire", "ab", "a_b%", "x" * 300 + "climax"]
    rows = []
    for i, n in enumerate(names):
        rows += [(f"t{i}", "uri", TYPE, DEL + "Topic", "uri", None, None, "x"), (f"t{i}", "uri", DEL + "name", n, "literal", None, None, "x")]
        rows += [(f"c{i}", "uri", TYPE, DEL + "Contribution", "uri", None, None, "x"), (f"c{i}", "uri", DEL + "text", n[::-1], "literal", None, None, "x")]
    g = spark.createDataFrame(rows, TRIPLE_SCHEMA).persist()
    S.write_index(g, f"{tmp_path}/i", buckets=4)
    for words in ("climate", "CLIM", "école", "ab", "b", "_b%", "etamilc", "none such", "x" * 299 + "xcli", "ate act"):
        assert [tuple(r) for r in S.search(spark, f"{tmp_path}/i", words).collect()] == [tuple(r) for r in A.search(g, words).collect()], words
    assert S.candidates(spark, f"{tmp_path}/i", "ab") is None and {r["id"] for r in S.candidates(spark, f"{tmp_path}/i", "clima").collect()} == {"t0", "t1", "t6"}
    plan = S.search(spark, f"{tmp_path}/i", "clima")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan[plan.index("PartitionFilters") :]
    with pytest.raises(ValueError):
        S.search(spark, f"{tmp_path}/i", " ")
