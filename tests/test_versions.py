"""Versions of tables and the state of ingest: shared files, replays, restarts, interrupted batches."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polislake.functions.terms import DEL, TRIPLE_COLUMNS, TRIPLE_SCHEMA
from polislake.operators import versions as V
from polislake.streaming import ingest as I


def triples(spark, *facts):
    return spark.createDataFrame([(s, "uri", p if ":" in p else DEL + p, o, "literal", None, None, "x") for s, p, o in facts], TRIPLE_SCHEMA)


def facts(df):
    return Counter((r["s"], r["p"].removeprefix(DEL), r["o"]) for r in df.collect())


def test_versions_share_files(spark, tmp_path):
    t = V.Versions(spark, f"{tmp_path}/t", buckets=2)
    assert t.read().count() == 0 and t.numbers() == []
    first = [("a", "name", "x"), ("b", "name", "y"), ("a", "text/é {}", "z")]
    assert t.add(triples(spark, *first, first[0]))["rows"] == 3
    one = t.manifest()
    before = {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    two = t.add(triples(spark, first[1], ("c", "name", "w")))  # one of them is there
    assert two["version"] == 2 and two["added"] == 1 and set(one["folders"]) < set(two["folders"])
    assert all(p in before and p_time == before[p] for p, p_time in ((str(p), p.stat().st_mtime_ns) for p in tmp_path.rglob("*.parquet") if str(p) in before)) and len(before) == sum(str(p) in before for p in tmp_path.rglob("*.parquet"))
    assert t.add(triples(spark, *first))["version"] == 2 and t.numbers() == [1, 2]  # nothing new, no version
    assert facts(t.read(1)) == Counter(first) and facts(t.read()) == Counter([*first, ("c", "name", "w")])
    named = t.read(parts=[DEL + "name"])
    assert facts(named) == Counter([f for f in [*first, ("c", "name", "w")] if f[1] == "name"])
    other = [c for c in two["cells"] if c.split("/")[0] not in {f.split("/pk=")[1].split("/")[0] and "pk=" + f.split("/pk=")[1].split("/")[0] for f in named.inputFiles()}]
    assert len(other) == 1  # the file of the other predicate is not read
    assert t.read(parts=["no:such"]).count() == 0


def test_cells_are_merged_and_forgotten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "MOST_FOLDERS", 2)
    t = V.Versions(spark, f"{tmp_path}/t", V.IDS, buckets=1)
    for i in range(4):
        t.add(spark.createDataFrame([(f"n{i}",), ("n0",)], "id string"))
    m = t.manifest()
    assert all(len(f) <= 2 for f in m["cells"].values()) and set(m["folders"]) == {f for c in m["cells"].values() for f in c}
    assert sorted(r["id"] for r in t.read().collect()) == ["n0", "n1", "n2", "n3"] and sorted(r["id"] for r in t.read(2).collect()) == ["n0", "n1"]
    t.vacuum(keep=1)
    assert t.numbers() == [4] and sorted(r["id"] for r in t.read().collect()) == ["n0", "n1", "n2", "n3"]
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == {f"u={f}" for f in m["folders"]}


def test_writers_and_broken_manifests(spark, tmp_path, monkeypatch):
    t = V.Versions(spark, f"{tmp_path}/t", V.IDS, buckets=1)
    t.add(spark.createDataFrame([("a",)], "id string"))
    monkeypatch.setattr(V.Versions, "numbers", lambda self: [])  # this writer does not see the version of the other
    with pytest.raises(Exception, match="exists"):
        t._commit({"version": 0})
    monkeypatch.undo()
    (tmp_path / "t" / "versions" / "v0000000002.json").write_text('{"version": 2, "ro')  # a writer that ended within it
    assert t.manifest()["version"] == 1 and [r["id"] for r in t.read().collect()] == ["a"]
    assert t.add(spark.createDataFrame([("b",)], "id string"))["version"] == 3 and t.read().count() == 2


EVENTS = [
    {"contribution_id": "c1", "text": "one", "timestamp": "2024-01-01T00:00:00", "user_id": 1, "post_id": 5, "value": 1, "fallacies": [{"type": "ad hominem", "score": 0.9, "rationale": "r"}]},
    {"contribution_id": "c2", "text": "two", "group_id": 7, "group_name": "G"},
    {"text": "no id"},
    {"contribution_id": "c1", "text": "one, changed", "user_id": 1},
]


def told(spark, root):
    rows = spark.read.parquet(f"{root}/counters").collect()
    return {r["batch"]: (r["events"], r["new"], r["repeated"], r["fallacies_added"], r["participants_linked"], r["topics_linked"], r["processes_created"]) for r in rows}


def test_stream_restarts_and_late_replays(spark, tmp_path):
    root, came = f"{tmp_path}/g", tmp_path / "in"
    came.mkdir()

    def run():
        lines = I.parse_events(spark.readStream.option("maxFilesPerTrigger", 1).text(str(came)))
        I.start_versions(lines, root, f"{tmp_path}/cp", available_now=True, buckets=2).awaitTermination()

    (came / "0.json").write_text("\n".join(map(json.dumps, [*EVENTS[:2], EVENTS[0]])))
    run()
    assert told(spark, root) == {0: (3, 2, 1, 1, 1, 1, 1)}
    graph = V.Versions(spark, f"{root}/graph")
    held = graph.manifest()
    run()  # nothing came: no version
    assert graph.manifest() == held
    (came / "1.json").write_text("\n".join(map(json.dumps, [EVENTS[0], EVENTS[1]])))  # a replay in a later run of the query, after any delay
    run()
    assert told(spark, root)[1] == (2, 0, 2, 0, 0, 0, 0) and graph.manifest()["folders"] == held["folders"]
    (came / "2.json").write_text("\n".join(map(json.dumps, [EVENTS[2], EVENTS[3], EVENTS[0]])))
    run()
    assert told(spark, root)[2] == (3, 2, 1, 0, 1, 0, 0)
    whole = {tuple(r[c] for c in TRIPLE_COLUMNS) for r in I.ingest(I.parse_events(spark.read.text(str(came)))).collect()}
    stored = [tuple(r[c] for c in TRIPLE_COLUMNS) for r in graph.read().collect()]
    assert len(stored) == len(whole) and set(stored) == whole
    counts = spark.read.parquet(f"{root}/counters").orderBy("batch").collect()
    assert [r["total_triples"] for r in counts][-1] == len(whole) == sum(r["triples_added"] for r in counts)


def test_interrupted_batches_run_again(spark, tmp_path, monkeypatch):
    events = spark.createDataFrame([(json.dumps(e),) for e in EVENTS], "value string")
    root = f"{tmp_path}/g"
    real = V.Versions.add

    def ends(self, rows, applied=None):
        if self.layout is V.IDS:
            raise RuntimeError("lost")
        return real(self, rows, applied)

    monkeypatch.setattr(V.Versions, "add", ends)
    with pytest.raises(RuntimeError):
        I.ingest_batch(I.parse_events(events), root, "s", 0, buckets=2)
    monkeypatch.undo()
    for _ in range(2):
        I.ingest_batch(I.parse_events(events), root, "s", 0, buckets=2)
        assert told(spark, root) == {0: (4, 4, 0, 1, 2, 1, 1)}
    graph = V.Versions(spark, f"{root}/graph")
    assert graph.numbers() == [1] and graph.manifest()["rows"] == graph.read().count() == spark.read.parquet(f"{root}/counters").first()["triples_added"]
    I.ingest_batch(I.parse_events(events.limit(0)), root, "s", 1, buckets=2)
    assert told(spark, root)[1] == (0, 0, 0, 0, 0, 0, 0)
    assert graph.read().where(F.col("p") == DEL + "text").count() == 4
