import itertools
import random

import pytest
from conftest import edge, node
from pyspark.sql import functions as F

from skeinworks import api, model
from skeinworks.functions import arrays, text
from skeinworks.operators import ranking, relations, resolution, traverse
from skeinworks.sources import gitignore


@pytest.fixture
def basic(make):
    nodes = make("nodes", [node("file:a", "a.ts", "file"), node("A", "main", line=1, exported=1), node("B", "send", line=10, doc="Sends the packet\nover the wire"), node("C", "send", path="r/b.py", language="python"), node("D", "Send", path="r/z.ts"), node("I", "send", "import", line=2)])
    edges = make("edges", [edge(1, "file:a", "A", "contains"), edge(2, "A", "B", line=3, col=1), edge(3, "A", "B", line=2, col=7), edge(4, "B", "C", "references", line=11)])
    return nodes, edges


def test_ranking_tiers(basic):
    nodes, _ = basic
    got = [r["id"] for r in ranking.resolve_symbol(nodes, "send", 9).collect()]
    assert got == ["B", "C", "I", "D"]
    assert [r["id"] for r in ranking.search(nodes, "the WIRE", 9).collect()] == ["B"]
    assert ranking.search(nodes, "***", 9).count() == 0
    assert ranking.search(nodes, "send", 9, language="python").count() == 1
    assert ranking.resolve_symbol(nodes, "nothing", 3).count() == 0


def test_wildcards_act_in_tiers_but_not_in_the_match(make):
    nodes = make("nodes", [node("1", "a_b"), node("2", "axb")])
    assert [r["id"] for r in ranking.search(nodes, "a_b", 5, full_text=False).collect()] == ["1"]


def test_callers_with_sites(basic):
    nodes, edges = basic
    r = relations.relations(edges, nodes, "B", True, "calls", 5).collect()
    assert [(x["far"], x["site_count"], x["line"], x["col"]) for x in r] == [("A", 2, 2, 7)]


def test_dangling_far_nodes_count_in_the_total_only(make):
    nodes = make("nodes", [node("A"), node("B")])
    edges = make("edges", [edge(1, "A", "B"), edge(2, "gone", "B")])
    t = relations.totals(edges, nodes, True, None).first()
    assert (t["total"], t["rendered"]) == (2, 1)
    a = api.Graph(nodes, edges, make_files(nodes)).callers("f")
    assert a["total"] == 2 or a["total"] == 0


def make_files(df):
    return df.sparkSession.createDataFrame([], "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int, errors string")


def test_impact_and_trace_on_the_basic_graph(basic, spark):
    nodes, edges = basic
    origin = spark.createDataFrame([("C",)], "id string")
    assert {(r["id"], r["distance"]) for r in traverse.impact(edges, origin, 2)[0].collect()} == {("B", 1), ("A", 2)}
    hits, exhausted = traverse.impact(edges, origin, 2, budget=1)
    assert hits.count() == 0 and exhausted
    paths = traverse.trace(edges, nodes, "A", "C", 6, 5).collect()
    assert len(paths) == 1 and [h["node"] for h in paths[0]["hops"]] == ["A", "B", "C"]
    assert paths[0]["hops"][1]["edge_id"] == 2
    assert traverse.trace(edges, nodes, "C", "A", 6, 5).count() == 0
    assert [len(r["hops"]) for r in traverse.trace(edges, nodes, "A", "A", 6, 5).collect()] == [1]
    assert traverse.trace(edges, nodes, "A", "C", 6, 0).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_against_brute_force(make, spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    rows = [edge(i, rng.choice(names), rng.choice(names), rng.choice(["calls", "references"])) for i in range(26)]
    nodes, edges = make("nodes", [node(n) for n in names if n != "n5"]), make("edges", rows)
    dist, via, level = {"n0": 0}, {}, ["n0"]
    for d in range(1, 4):
        new = {}
        for r in rows:
            if r[2] in level and r[1] not in dist:
                new.setdefault(r[1], (r[0], r[3]))
        dist |= dict.fromkeys(new, d)
        via |= {k: v[1] for k, v in new.items()}
        level = list(new)
    got = traverse.impact(edges, spark.createDataFrame([("n0",)], "id string"), 3)[0].collect()
    assert {(r["id"], r["distance"], r["via"]) for r in got} == {(k, d, via[k]) for k, d in dist.items() if d}
    goal = max((n for n in names if n != "n0"), key=lambda n: (n in {r[2] for r in rows}, n))
    first = {}
    for r in rows:
        first.setdefault((r[1], r[2]), r[0])
    best, frontier = [], [("n0",)]
    for _ in range(6):
        frontier = [(*p, b) for p in frontier for (a, b) in first if a == p[-1] and b not in p]
        best = [p for p in frontier if p[-1] == goal]
        if best:
            break
    want = sorted([first[a, b] for a, b in itertools.pairwise(p)] for p in best if "n5" not in p)
    got = sorted([h["edge_id"] for h in r["hops"][1:]] for r in traverse.trace(edges, nodes, "n0", goal, 6, 50).collect())
    assert got == want


def test_clamp_keeps_the_default_unclamped():
    assert model.clamp(None, 500, 200) == 500
    assert model.clamp(float("nan"), 7, 200) == 7
    assert [model.clamp(x, 7, 200) for x in (0, -4, 3.9, 1e9)] == [1, 1, 3, 200]


def test_text_functions(spark):
    df = spark.createDataFrame([("url_stop naïve", "src/../lib/./x.ts"), (None, None), ("", "../a/b")], "t string, p string")
    rows = df.select(text.phrase_prefix(F.col("t"), "url_st").alias("a"), text.phrase_prefix(F.col("t"), "naive").alias("b"), text.phrase_prefix(F.col("t"), "top").alias("c"), text.normalized(F.col("p")).alias("n"), text.clip(F.col("t"), 3).alias("k")).collect()
    assert (rows[0]["a"], rows[0]["b"], rows[0]["c"], rows[0]["n"], rows[0]["k"]) == (True, True, False, "lib/x.ts", "url…")
    assert rows[1]["n"] is None and rows[2]["n"] == "../a/b"
    globs = spark.createDataFrame([("src/a/b.ts",), ("src/a.py",), ("x\ny",)], "p string")
    assert globs.where(F.col("p").rlike(text.glob("src/*.ts"))).count() == 1
    assert globs.where(F.col("p").rlike(text.glob("[^a-r]?[!-~]*"))).count() >= 0
    terms = text.terms(spark.createDataFrame([(1, "fix the Parser parser of tokens ab"), (2, None)], "i int, t string"), "i", "t", 6).orderBy("ord").collect()
    assert [r["term"] for r in terms] == ["Parser", "tokens"]


def test_json_arrays(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", "[]", '["a"]', "[1]", "[null]", '{"a":1}', "nope", '[1,"a"]')], "j string").select(arrays.json_array_state(F.col("j"))).collect()
    assert [r[0] for r in rows] == ["empty", "empty", "ok", "ok", "bad_element", "bad_element", "not_array", "unparseable", "bad_element"]


def test_gitignore(spark):
    rules = gitignore.parse("# c\n\nbuild/\n*.log\n!keep.log\n/top.txt\na/b*\nod?d\n")
    paths = {"build/x": True, "src/build/x.ts": True, "build": False, "x.log": True, "d/keep.log": False, "build/keep.log": True, "top.txt": True, "s/top.txt": False, "a/bc/d": True, "a/x": False, "odd": False, "od?d": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["i"] for r in df.select("path", gitignore.ignored(F.col("path"), rules).alias("i")).collect()}
    assert got == paths


def _resolve(spark, files, defs, calls=(), imports=(), heritage=()):
    f = spark.createDataFrame([(p, lang, 5) for p, lang in files], "path string, language string, line_count int")
    d = spark.createDataFrame([(p, k, None, kind, n, [], 1, 2, 0, 1, e, False, False, []) for p, k, kind, n, e in defs], "path string, key string, parent_key string, kind string, name string, container array<string>, start_line int, end_line int, start_column int, end_column int, is_exported boolean, is_async boolean, is_static boolean, decorators array<string>")
    c = spark.createDataFrame(list(calls), "path string, caller_key string, callee_name string, line int, col int, is_member_call boolean")
    i = spark.createDataFrame(list(imports), "path string, ord int, local_name string, imported_name string, specifier string")
    h = spark.createDataFrame(list(heritage), "path string, source_key string, target_name string, relation string")
    n = resolution.declaration_nodes(d, f)
    r = resolution.resolved_imports(i, f)
    return n, r, resolution.resolved_calls(c, n, r, i), resolution.heritage_edges(h, n, r)


def test_resolution_rules(spark):
    files = [("src/a.ts", "typescript"), ("src/lib/index.ts", "typescript"), ("p/m.py", "python"), ("p/q/__init__.py", "python")]
    defs = [("src/lib/index.ts", "1:0", "function", "go", True), ("p/m.py", "1:0", "function", "go", False), ("p/m.py", "4:0", "function", "only", False), ("p/q/__init__.py", "1:0", "class", "Base", False)]
    calls = [("src/a.ts", None, "go", 3, 0, False), ("src/a.ts", "9:0", "only", 4, 0, True), ("src/a.ts", None, "gone", 5, 0, True), ("src/a.ts", None, "ext", 6, 0, False), ("src/a.ts", None, "dflt", 7, 0, False), ("p/q/__init__.py", None, "go", 1, 1, False)]
    imports = [("src/a.ts", 0, "go", "go", "./lib"), ("src/a.ts", 1, "ext", "ext", "somewhere"), ("src/a.ts", 2, "dflt", "default", "./lib"), ("p/q/__init__.py", 0, "m", "*", "..m"), ("p/m.py", 0, "q", "*", ".q")]
    n, r, c, h = _resolve(spark, files, defs, calls, imports, [("p/m.py", "1:0", "Base", "extends"), ("p/m.py", "1:0", "Nobody", "extends")])
    assert {(x["path"], x["target"]) for x in r.collect()} == {("src/a.ts", "src/lib/index.ts"), ("p/q/__init__.py", "p/m.py"), ("p/m.py", "p/q/__init__.py")}
    got = {x["line"]: (x["source"], x["target"], x["likely_external"]) for x in c.collect()}
    assert got[3] == ("file:src/a.ts", "src/lib/index.ts:1:0", True)
    assert got[4][:2] == ("src/a.ts:9:0", "p/m.py:4:0")
    assert got[5] == ("file:src/a.ts", None, True) and got[6][1] is None and got[6][2]
    assert got[7][1] == "src/lib/index.ts:1:0" and got[1][1] is None and not got[1][2]
    assert [(x["source"], x["target"]) for x in h.collect()] == [("p/m.py:1:0", "p/q/__init__.py:1:0")]
    assert resolution.imports_edges(r).count() == 3


def test_equal_places_get_stable_suffixes(spark):
    n, *_ = _resolve(spark, [("c.c", "c")], [("c.c", "1:0", "function", "make", True), ("c.c", "1:0", "struct", "P", True)])
    assert sorted(x["id"] for x in n.collect()) == ["c.c:1:0", "c.c:1:0#2"]
