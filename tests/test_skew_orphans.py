import datetime
import random

import numpy as np
from conftest import edge, node
from pyspark.sql import functions as F

from skeinworks.operators import orphans, skew

DAY = datetime.datetime(2024, 3, 5)


def test_key_profile_counts_and_earliest_site(make):
    rows = [edge(1, "a", "t", line=9), edge(2, "a", "t", line=3, col=5), edge(3, None, "t"), edge(3, None, "t"), edge(4, "b", None, line=1), edge(5, "b", "", "extends")]
    got = {(r["target"], r["kind"]): r for r in skew.key_profile(make("edges", rows)).collect()}
    t = got["t", "calls"]
    assert (t["n_sites"], t["n_sources"], t["first_line"], t["first_col"], t["first_edge"]) == (4, 1, 3, 5, 2)
    assert got[None, "calls"]["n_sites"] == 1
    assert got["", "extends"]["first_line"] is None


def test_key_profile_against_brute_force_with_a_hot_key(make):
    rng = random.Random(5)
    rows = [edge(i, f"s{rng.randrange(40)}", "hot" if rng.random() < 0.4 else f"t{rng.randrange(9)}", rng.choice(["calls", "extends"]), rng.choice([None, rng.randrange(50)])) for i in range(2000)]
    want = {}
    for r in rows:
        want.setdefault((r[2], r[3]), []).append(r)
    got = skew.key_profile(make("edges", rows)).collect()
    assert len(got) == len(want)
    for g in got:
        mine = want[g["target"], g["kind"]]
        assert g["n_sites"] == len(mine) and g["n_sources"] == len({m[1] for m in mine})
        assert g["first_line"] == min((m[5] for m in mine if m[5] is not None), default=None)


def test_hot_keys_leave_out_blank_targets_and_empty_tables(make):
    rows = [edge(i, "s", "  ") for i in range(50)] + [edge(i, "s", "x") for i in range(50)] + [edge(999, "s", "rare")] * 0
    assert [tuple(r) for r in skew.hot_keys(make("edges", rows)).select("target", "kind").collect()] == [("x", "calls")]
    assert skew.hot_keys(make("edges", [])).count() == 0


def test_bitmaps_and_not_in_every_mix_of_containers():
    rng = np.random.default_rng(3)
    for a_size in (0, 10, 5000, 60000):
        for b_size in (0, 10, 5000, 60000):
            a = np.unique(rng.integers(0, 200_000, a_size))
            b = np.unique(rng.integers(0, 200_000, b_size))
            got = orphans.and_not(orphans.compress(a), orphans.compress(b))
            assert np.array_equal(got, np.setdiff1d(a, b))


def test_dangling_references(make):
    nodes = make("nodes", [node("n1"), node("n2", updated=10**15), node(None)])
    edges = make("edges", [edge(1, "n1", "gone", at=DAY), edge(1, "n1", "gone", at=DAY), edge(2, "gone", "gone2"), edge(3, None, " "), edge(4, "N1", "n2", at=DAY)])
    refs = make("refs", [(7, "lost", "r/a.ts", "f", 1, 1), (7, "lost", "r/a.ts", "f", 1, 1), (8, "n1", "r/a.ts", "f", 1, 1), (9, "lost", "nowhere", "f", 1, 1)])
    files = make("files", [("r/a.ts", "h", "typescript", 1, 1, 1704067200000, 0, None), ("r/a.ts", "g", "typescript", 1, 1, 1, 0, None)])
    got = {(r["ref_table"], r["row_id"], r["field"], r["period"]) for r in orphans.dangling_references(edges, refs, nodes, files).collect()}
    assert got == {("edges", 1, "target", "2024-03"), ("edges", 2, "source", None), ("edges", 2, "target", None), ("edges", 4, "source", "2024-03"), ("unresolved_refs", 7, "source", "2024-01"), ("unresolved_refs", 9, "source", None)}
    report = {(r["ref_table"], r["period"]): (r["n_references"], r["n_keys"]) for r in orphans.dangling_report(edges, refs, nodes, files).collect()}
    assert report["edges", "2024-03"] == (3, 2) and report["unresolved_refs", "2024-01"] == (2, 1)


def test_dangling_references_of_empty_tables_and_with_clashing_columns(make):
    nodes, edges, refs, files = make("nodes", []), make("edges", []), make("refs", []), make("files", [])
    assert orphans.dangling_references(edges, refs, nodes, files).count() == 0
    extra = make("edges", [edge(1, "x", "y")]).withColumn("key", F.lit(1)).withColumn("range", F.lit(2)).withColumn("period", F.lit("z"))
    assert orphans.dangling_references(extra, refs, nodes, files).count() == 2


def test_many_ranges_give_the_same_orphans(make, monkeypatch):
    monkeypatch.setattr(orphans, "RANGE_ROWS", 7)
    nodes = make("nodes", [node(f"n{i}") for i in range(0, 90, 2)])
    edges = make("edges", [edge(i, f"n{i}", f"n{(i * 7) % 90}") for i in range(90)])
    got = {(r["row_id"], r["field"]) for r in orphans.dangling_references(edges, make("refs", []), nodes, make("files", [])).collect()}
    assert got == {(i, "source") for i in range(90) if i % 2} | {(i, "target") for i in range(90) if (i * 7) % 90 % 2}


def test_a_hot_orphan_key_is_split_over_tasks(spark, make):
    rows = spark.range(60_000).selectExpr("id", "CASE WHEN id % 10 < 9 THEN 'gone' ELSE concat('n', id) END AS source", "concat('n', id) AS target", "'calls' AS kind", "CAST(NULL AS STRING) AS metadata", "CAST(NULL AS INT) AS line", "CAST(NULL AS INT) AS col", "'x' AS provenance", "CAST(NULL AS TIMESTAMP) AS recorded_at")
    nodes = make("nodes", [node("n")]).selectExpr("explode(sequence(0, 59999)) AS k", "*").selectExpr("concat('n', k) AS id", "updated_at", "file_path")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40KB", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = orphans.dangling_references(rows.repartition(16), make("refs", []), nodes, make("files", []))
        spread = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sum(r["count"] for r in spread) == 54_000 and max(r["count"] for r in spread) < 2 * 54_000 / 16
