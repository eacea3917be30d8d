"""Queries and stages that do the whole job where an older one is bounded."""

import datetime

from conftest import edge, node
from pyspark.sql import functions as F

from skeinworks import api
from skeinworks.operators import orphans
from skeinworks.plans import registry
from skeinworks.sources import snapshot, tree


def test_terms_of_documents_in_every_language(spark, tmp_path):
    rows = [(1, "The beacon drains", "en"), (2, "Маяк теряет окно", "ru"), (3, "beacon harbor", "EN"), (4, "harbor window", None), (5, None, "de"), (6, "  ", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["term"], r["ord"]) for r in registry.queries()["context_terms_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, "beacon", 1), (1, "drains", 2), (2, "теряет", 1), (2, "Маяк", 2), (2, "окно", 3), (3, "beacon", 1), (3, "harbor", 2), (4, "harbor", 1), (4, "window", 2)}


def test_whole_declarations(spark, make, tmp_path):
    body = "".join(f"line {i} " + "x" * 50 + "\n" for i in range(1, 401))
    nodes = [node("a", line=3, end=398), node("b", line=400, end=999), node("c", line=1, end=1, path="r/none.ts"), node("f", kind="file", line=1, end=400)]
    make("nodes", nodes).write.parquet(str(tmp_path / "nodes.parquet"))
    make("texts", [("r/a.ts", body)]).write.parquet(str(tmp_path / "source_texts.parquet"))
    got = {r["id"]: (r["code"], r["code_start_line"]) for r in registry.queries()["source_whole"](spark, str(tmp_path)).collect()}
    lines = body.split("\n")
    assert got == {"a": ("\n".join(lines[2:398]), 3), "b": (lines[399] + "\n", 400), "c": (None, 1)}


def test_walk_keeps_every_file(spark):
    listed = spark.range(50_001).select(F.format_string("f%d.py", "id").alias("path"), F.lit(3_000_000).cast("long").alias("size"), F.lit(1).cast("long").alias("modified_at"), F.lit(b"x = 1").alias("content"))
    found, overflow = tree.discover(listed, [])
    read, skipped = tree.read_files(found)
    assert read.count() == 50_001 and overflow.first()[0] == 0 and skipped.first()[0] == 0


def test_index_of_a_file_beyond_two_megabytes(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    (root / "big.py").write_text("# " + "x" * 2_000_100 + "\ndef tail():\n    pass\n")
    (root / "small.py").write_text("def tail():\n    pass\n\ndef main():\n    pass\n")
    report = api.index(spark, str(root), str(tmp_path / "graph"))
    assert (report["files_indexed"], report["files_skipped"]) == (2, 0)
    assert snapshot.read(spark, str(tmp_path / "graph"))["nodes"].where("name = 'tail'").count() == 2
    bounded = api.index(spark, str(root), str(tmp_path / "bounded"), max_bytes=2_000_000)
    assert (bounded["files_indexed"], bounded["files_skipped"]) == (1, 1)


def test_references_to_nodes_of_a_later_run(make):
    run, day = 1704067200000, 86_400_000  # 2024-01-01
    at = lambda n: datetime.datetime(2024, 1, n)
    nodes = make("nodes", [node("n", updated=run), node("late", updated=run + 10 * day), node("both", updated=run + 10 * day), node("both", updated=run - day), node("free", path="nowhere", updated=run + 10 * day)])
    files = make("files", [("r/a.ts", "h", "typescript", 1, 1, run, 0, None), ("r/a.ts", "g", "typescript", 1, 1, 1, 0, None)])
    edges = make("edges", [edge(1, "n", "late", at=at(2)), edge(1, "n", "late", at=at(2)), edge(2, "late", "gone", at=at(2)), edge(3, "both", "free", at=at(2)), edge(4, "n", "late", at=at(20)), edge(5, "n", "late"), edge(6, "gone", " ", at=at(3))])
    refs = make("refs", [(7, "late", "r/a.ts", "f", 1, 1), (8, "gone", "r/a.ts", "f", 1, 1), (9, "n", "r/a.ts", "f", 1, 1)])
    got = {(r["ref_table"], r["period"]): tuple(r)[2:] for r in orphans.dangling_periods(edges, refs, nodes, files).collect()}
    assert got == {("edges", "2024-01"): (2, 1, 3, 1), ("edges", None): (0, 0, 1, 1), ("unresolved_refs", "2024-01"): (1, 1, 1, 1)}


def test_stale_files_and_subtree_from_the_data(spark, make, tmp_path):
    row = lambda path, modified, indexed: (path, "h", "python", 1, modified, indexed, 0, None)
    make("files", [row("r/x/newer.py", 5, 50), row("r/x/newer.py", 4, 40), row("r/x/same.py", 5, 50), row("r/x/same.py", 5, 40), row("q/y/gone.py", 5, 50), row("q/y/1234567.py", 5, 50)]).write.parquet(str(tmp_path / "files.parquet"))
    make("texts", [(p, "") for p in ("r/x/newer.py", "r/x/same.py", "q/y/1234567.py")]).write.parquet(str(tmp_path / "source_texts.parquet"))
    run = lambda name: sorted(r["path"] for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert run("status_stale_runs") == ["q/y/gone.py", "r/x/newer.py"]
    assert run("files_subtree_largest") == ["q/y/1234567.py", "q/y/gone.py"]
