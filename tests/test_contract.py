"""Answers of unindexed roots, context with files, rows that are checked, and the watch of a tree."""

import os
import time

import pytest
from conftest import edge, node
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from skeinworks import api
from skeinworks.functions import text
from skeinworks.model import GraphError
from skeinworks.operators import compose, extract
from skeinworks.plans import registry
from skeinworks.sources import changes, gitignore, snapshot
from skeinworks.streaming import debounce


def test_status_of_an_unindexed_root(spark, make, tmp_path):
    store = str(tmp_path / "none")
    assert api.status(spark, store) == {"operation": "status", "indexed": False}
    assert api.render(api.status(spark, store)) == "not indexed"
    with pytest.raises(GraphError, match="UNAVAILABLE"):
        snapshot.Pool(spark).get(store)
    files = make("files", [("r/a.ts", "h", "typescript", 1, 1, 5, 2, None)])
    snapshot.write(store, {"nodes": make("nodes", [node("A"), node("A", "g", updated=9)]), "edges": make("edges", [edge(1, "A", "A")] * 2), "files": files})
    got = api.status(spark, store)
    assert (got["indexed"], got["node_count"], got["edge_count"], got["file_count"]) == (True, 1, 1, 1)
    assert api.Graph.of(snapshot.read(spark, store)).callers("g")["total"] == 1


def test_rows_are_checked_when_they_are_written(spark, make, tmp_path):
    with pytest.raises(Exception, match="MALFORMED_INDEX: name is missing"):
        snapshot.write(str(tmp_path / "a"), {"nodes": make("nodes", [node("A").__class__((*node("A")[:2], None, *node("A")[3:]))])})
    with pytest.raises(GraphError, match="MALFORMED_INDEX.*start_line is string"):
        snapshot.write(str(tmp_path / "b"), {"nodes": make("nodes", [node("A")]).withColumn("start_line", F.col("start_line").cast("string"))})
    with pytest.raises(GraphError, match="MALFORMED_INDEX.*missing"):
        snapshot.write(str(tmp_path / "c"), {"edges": make("edges", []).drop("target")})
    assert api.status(spark, str(tmp_path / "a"))["indexed"] is False


def test_context_with_relations_and_files(spark, make):
    body = "function sendPacket() {}\nfunction caller() { sendPacket() }\n"
    nodes = make("nodes", [node("A", "sendPacket", line=1, end=1), node("B", "caller", line=2, end=2), node("C", "far", path="r/c.ts")])
    edges = make("edges", [edge(1, "B", "A", line=2), edge(2, "B", "A", line=3), edge(3, "A", "C", line=1), edge(4, "gone", "A"), edge(5, None, "A")])
    got = api.Graph(nodes, edges, make("files", []), make("texts", [("r/a.ts", body)])).context("why does sendPacket fail")
    assert [e["name"] for e in got["entry_points"]] == ["sendPacket"]
    assert [(r["symbol"]["name"], r["site_count"], r.get("site_line")) for r in got["related"]] == [("caller", 2, 2), ("far", 1, 1)]
    assert [(f["path"], f["symbols"], f["code"]) for f in got["files"]] == [("r/a.ts", ["sendPacket"], "function sendPacket() {}")]
    assert "far" in api.render(got)
    assert api.Graph(nodes, edges, make("files", [])).context("nothing known")["files"] == []


def test_related_keeps_the_first_of_equal_relations(spark, make):
    nodes = make("nodes", [node("A"), node("B"), node("X", "x")])
    edges = make("edges", [edge(1, "X", "A", line=1), edge(2, "X", "B", line=2), edge(3, "A", "B", line=3)])
    entries = spark.createDataFrame([("A", 1), ("B", 2)], "id string, rank int")
    got = compose.related(entries, edges, nodes, 5, 9).orderBy("seen").collect()
    assert [(r["far"], r["line"]) for r in got] == [("X", 1), ("B", 3)]  # A and B look alike, as name, path and line are equal
    assert compose.related(entries, edges, nodes, 5, 1).count() == 1


def test_a_failed_batch_comes_again_and_a_degraded_watch_stops(spark, tmp_path):
    src, checkpoint, seen = tmp_path / "in", str(tmp_path / "ck"), []
    src.mkdir()
    for i, ts in enumerate(("2024-01-01 00:00:00", "2024-01-01 02:00:00")):
        (src / f"{i}.json").write_text('{"root": "r", "path": "p%d", "event_type": "change", "ts": "%s"}\n' % (i, ts))
    health, fails = debounce.Health(), [True]

    def sync(df):
        if fails[0]:
            raise ValueError("no room")
        seen.extend(df.collect())

    def run():
        stream = spark.readStream.schema(debounce.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
        q = debounce.watch(stream, "2 seconds", "10 seconds", checkpoint, sync, health)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for _ in range(3):
        with pytest.raises(StreamingQueryException):
            run()
    assert health.degraded and not seen
    fails[0] = False
    with pytest.raises(StreamingQueryException):
        run()  # degraded: nothing is taken, nothing is lost
    health = debounce.Health()
    run()
    assert [tuple(r["paths"]) for r in seen] == [("p0",)]


def test_scope_of_events(spark):
    rows = [("r", p, "change", None) for p in ("src/a.ts", "node_modules/x.ts", "gen/deep/y.ts", "keep/gen.ts", None)]
    events = spark.createDataFrame(rows, debounce.EVENT_SCHEMA)
    assert sorted(r["path"] for r in debounce.in_scope(events, gitignore.parse("gen/\n")).collect()) == ["keep/gen.ts", "src/a.ts"]


def test_changes_of_a_tree(spark, tmp_path):
    root = tmp_path / "w"
    os.makedirs(root / "src")
    os.makedirs(root / "node_modules")
    (root / "src/a.ts").write_text("1")
    (root / "src/b.ts").write_text("1")
    assert changes.compare({"a": 1, "b": 1}, {"a": 2, "c": 1}) == [("a", "change"), ("b", "delete"), ("c", "create")]
    reader = changes.ChangeReader(str(root))
    assert reader.read({"number": 0})[1] == {"number": 0}
    (root / "src/c.ts").write_text("2")
    (root / "node_modules/x.ts").write_text("2")
    os.remove(root / "src/b.ts")
    rows, end = reader.read({"number": 0})
    assert [r[1:3] for r in rows] == [("src/b.ts", "delete"), ("src/c.ts", "create")] and end == {"number": 1}
    assert [r[1] for r in reader.readBetweenOffsets({"number": 0}, end)] == ["src/b.ts", "src/c.ts"]
    reader.commit(end)
    assert list(reader.readBetweenOffsets({"number": 0}, end)) == []
    q = changes.changes(spark, str(root)).writeStream.format("memory").queryName("tree_changes_seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for _ in range(100):
            if q.lastProgress or q.exception():
                break
            time.sleep(0.1)
        (root / "src/d.ts").write_text("3")
        for _ in range(100):
            if spark.table("tree_changes_seen").count() or q.exception():
                break
            time.sleep(0.1)
        assert q.exception() is None
        assert ("src/d.ts", "create") in [(r["path"], r["event_type"]) for r in spark.table("tree_changes_seen").collect()]
    finally:
        q.stop()


def test_own_extractors_reach_the_workers(spark, make):
    def own_extractor(text):
        e = extract.Extraction()
        for number, line in enumerate(text.split("\n"), 1):
            if line.startswith("rule "):
                e.define("function", line[5:], (number, 0), (number, len(line)), [])
        return e

    texts = make("texts", [("a.rules", "rule one\nrule two\n"), ("b.py", "def f(): pass\n"), ("c.none", "x"), ("d.rules", None)])
    found = extract.extracted(texts, {"rules": own_extractor, "python": lambda text: extract.Extraction()}, {".rules": "rules"})
    got = {r["path"]: (r["language"], [d["name"] for d in r["definitions"]]) for r in found.collect()}
    assert got == {"a.rules": ("rules", ["one", "two"]), "b.py": ("python", []), "d.rules": ("rules", [])}


def test_marks_of_latin_letters_are_folded(spark):
    df = spark.createDataFrame([("Łódź ŐŰ ệ ñ Ø",)], "t string")
    assert df.select(text.norm(F.col("t"))).first()[0] == " łodz ou e n ø "


def test_every_registered_core_query_has_a_builder():
    assert {"context_related", "merge_hits", "relation_view", "hop_view", "stored_imports_edges", "stored_heritage", "stored_report", "status_stale_count"} <= set(registry.queries())
