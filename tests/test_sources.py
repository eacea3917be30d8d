import os
import sqlite3

import pytest
from conftest import node

from skeinworks import api
from skeinworks.model import GraphError
from skeinworks.operators import extract
from skeinworks.sources import snapshot, sqlite, tree
from skeinworks.streaming import debounce

SNIPPETS = {
    "typescript": ("export class A extends B { private x: number = 1\n  static async go(y: string): Promise<void> { send(y) } }\nexport const f = (a) => { a.run() }\ninterface I { z: string }\ntype T = string\nenum E { One, Two = 2 }\n", {("class", "A"), ("field", "x"), ("method", "go"), ("function", "f"), ("interface", "I"), ("type_alias", "T"), ("enum", "E"), ("enum_member", "One"), ("enum_member", "Two")}, {"send", "run"}),
    "python": ("import os\nfrom . import q as r\nX = 1\nclass A(B):\n    y = 2\n    @dec.x(1)\n    async def m(self):\n        return os.path(g())\n", {("variable", "X"), ("class", "A"), ("field", "y"), ("method", "m")}, {"path", "g", "x"}),
    "go": ("package p\nimport \"a/b\"\ntype S struct {\n\tn int\n}\nfunc (s *S) Run(x int) error {\n\treturn b.Do(x)\n}\nfunc free() {}\n", {("type_alias", "S"), ("field", "n"), ("method", "Run"), ("function", "free")}, {"Do"}),
    "java": ("import a.b.C;\npublic class A extends B implements D {\n  private int x = 1;\n  @Override\n  public int go(String y) { return this.run(y); }\n}\n", {("class", "A"), ("field", "x"), ("method", "go")}, {"run"}),
    "rust": ("use a::{b, c as d};\npub struct S { x: usize }\nimpl S {\n  pub fn go(&self) -> usize { helper(self.x) }\n}\nfn free() {}\n", {("struct", "S"), ("field", "x"), ("method", "go"), ("function", "free")}, {"helper"}),
    "c": ("#include <stdio.h>\nstatic int limit = 3;\nstruct S {\n  int x;\n};\nint go(const char *s) {\n  return puts(s);\n}\n", {("variable", "limit"), ("struct", "S"), ("field", "x"), ("function", "go")}, {"puts"}),
    "ruby": ("require_relative 'x'\nclass A < B\n  def go(a)\n    run(a) if a\n  end\nend\n", {("class", "A"), ("method", "go")}, {"run"}),
}


@pytest.mark.parametrize("language", SNIPPETS)
def test_extraction(language):
    source, definitions, calls = SNIPPETS[language]
    e = extract.EXTRACTORS[language](source)
    assert definitions <= {(d["kind"], d["name"]) for d in e.definitions}
    assert calls <= {c["callee_name"] for c in e.calls}
    if language not in ("typescript",):
        assert e.imports


def test_extraction_of_broken_and_empty_texts():
    for language in set(extract.EXTENSIONS.values()):
        for source in ("", "\n", "(((", "}}}", "\"unterminated", "class {", "def (", "/* open"):
            extract.EXTRACTORS[language](source)
    assert {d["name"] for d in extract.python_any("def f(:\n    g(1)\n\nclass K:\n    def m(self)\n        pass\n").definitions} == {"f", "K", "m"}


def test_columns_of_python_count_characters():
    e = extract.python_ast("x = 'é'; y = g('é')\n")
    assert [c["col"] for c in e.calls] == [13]


@pytest.fixture
def workspace(tmp_path):
    root = tmp_path / "w"
    for path, body in {"src/a.ts": "import { go } from './lib'\nexport function main() {\n  go()\n  lost()\n}\n", "src/lib.ts": "export function go() {\n  return 1\n}\n", "node_modules/x.ts": "function no() {}\n", "skip/y.py": "def n():\n    pass\n", "big.py": "x = 1\n" * 50, "note.txt": "text"}.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(body)
    (root / ".gitignore").write_text("skip/\n")
    return str(root)


def test_index_and_answers(spark, workspace, tmp_path):
    store = str(tmp_path / "graph")
    report = api.index(spark, workspace, store)
    assert report["files_indexed"] == 3 and report["unresolved_count"] == 1 and report["unresolved_likely_internal_count"] == 1
    pool = snapshot.Pool(spark, 1)
    g = pool.get(store)
    graph = api.Graph(g["nodes"], g["edges"], g["files"], spark.read.text(workspace + "/src/a.ts", wholetext=True).selectExpr("'src/a.ts' AS path", "value AS text"))
    callers = graph.callers("go")
    assert [r["symbol"]["name"] for r in callers["relations"]] == ["main"] and callers["relations"][0]["site_line"] == 3
    assert graph.callees("main")["total"] == 1
    assert [e["distance"] for e in graph.impact("go")["entries"]][:1] == [1]
    assert [[h["symbol"]["name"] for h in p] for p in graph.trace("main", "go")["paths"]] == [["main", "go"]]
    assert graph.node("main", include_code=True)["code"].startswith("export function main")
    assert graph.list_files("src")["total"] == 2
    assert graph.status()["file_count"] == 3
    assert graph.search("go")["total"] >= 1
    assert graph.explore("main")["files"][0]["code"].startswith("export function main")
    assert graph.context("call main go twice")["entry_points"]
    for answer in (callers, graph.search("go"), graph.impact("go"), graph.trace("main", "go"), graph.status(), graph.list_files(), graph.node("main"), graph.explore("main"), report):
        assert api.render(answer)
    with pytest.raises(GraphError):
        graph.search("  ")
    assert graph.callers("nobody") == {"operation": "callers", "relations": [], "total": 0, "truncated": False}
    version = g.version
    api.index(spark, workspace, store)
    assert pool.get(store).version != version
    pool.close()
    with pytest.raises(GraphError, match="DISPOSED"):
        pool.get(store)


def test_walk_limits(spark, workspace):
    found, overflow = tree.discover(tree.listing(spark, workspace), [], languages=["python"], max_files=1)
    assert [r["path"] for r in found.select("path").collect()] == ["big.py"] and overflow.first()[0] == 1
    read, skipped = tree.read_files(found, max_bytes=10)
    assert read.count() == 0 and skipped.first()[0] == 1
    assert not tree.available(workspace + "/nothing")


def test_snapshot_refuses_other_formats(spark, make, tmp_path):
    root = str(tmp_path / "s")
    with pytest.raises(GraphError, match="UNAVAILABLE"):
        snapshot.read(spark, root)
    versions = spark.createDataFrame([(3, 1, None)], "version int, applied_at long, description string")
    snapshot.write(root, {"nodes": make("nodes", [node("a")]), "schema_versions": versions})
    with pytest.raises(GraphError, match="UNSUPPORTED_FORMAT"):
        snapshot.read(spark, root)


def test_sqlite_graph(spark, tmp_path):
    path = str(tmp_path / "g.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE edges (id INTEGER PRIMARY KEY, source TEXT, target TEXT, kind TEXT, metadata TEXT, line INTEGER, col INTEGER, provenance TEXT)")
        c.executemany("INSERT INTO edges VALUES (?,?,?,?,?,?,?,?)", [(i, "a", "b", "calls", None, i, None, None) for i in range(1, 6)])
    df = sqlite.read_table(spark, path, "edges")
    assert df.count() == 5 and df.agg({"line": "max"}).first()[0] == 5


def test_debounce_merges_bursts(spark):
    rows = [("r", "a", "2024-01-01 00:00:00"), ("r", "b", "2024-01-01 00:00:02"), ("r", "a", "2024-01-01 00:00:09"), ("q", "a", "2024-01-01 00:00:01"), ("r", "a", None)]
    e = spark.createDataFrame(rows, "root string, path string, ts string").selectExpr("root", "path", "to_timestamp(ts) AS ts")
    got = sorted((r["root"], r["n_events"], tuple(r["paths"])) for r in debounce.sessions(e, "2 seconds").collect())
    assert got == [("q", 1, ("a",)), ("r", 1, ("a",)), ("r", 2, ("a", "b"))]


def test_watch_streams_batches_and_degrades(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    seen, health = [], debounce.Health()
    for i, ts in enumerate(("2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 01:00:00")):
        (src / f"{i}.json").write_text('{"root": "r", "path": "p%d", "event_type": "change", "ts": "%s"}\n' % (i, ts))
    stream = spark.readStream.schema(debounce.EVENT_SCHEMA).json(str(src))
    q = debounce.watch(stream, "2 seconds", "10 seconds", str(tmp_path / "ck"), lambda df: seen.extend(df.collect()), health)
    q.processAllAvailable()
    (src / "9.json").write_text('{"root": "r", "path": "p9", "event_type": "change", "ts": "2024-01-01 02:00:00"}\n')
    q.processAllAvailable()
    q.stop()
    assert ("p0", "p1") in [tuple(r["paths"]) for r in seen]
    assert [health.failed("x") for _ in range(4)] == [False, False, True, False]
    assert debounce.watch_allowed({}, True, False) and not debounce.watch_allowed({"SKEINWORKS_NO_WATCH": "1", "SKEINWORKS_FORCE_WATCH": "1"}, True, False)


def test_providers():
    class P:
        def __init__(self, roots):
            self.roots = roots

        def claims(self, root):
            return root in self.roots

    p = api.Providers()
    drop = p.register("a", P({"x"}))
    p.register("b", P({"x", "y"}))
    with pytest.raises(GraphError, match="CONFLICT.*a, b"):
        p.select("x")
    with pytest.raises(GraphError, match="UNAVAILABLE"):
        p.select("z")
    with pytest.raises(GraphError, match="INVALID_PROVIDER"):
        p.register(" ", P(set()))
    drop()
    assert p.select("x") is p.known["b"] and p.available("y") and not p.available("z")
