"""Exact token counts, list levels, dealt-out groups, and costs that grow with the length of a text."""

import random
import time

import pytest

from skeinworks.llm import funcdoc, mixing, sentences, tokens
from skeinworks.model import GraphError


def test_token_counts_equal_those_of_the_whole_text(monkeypatch):
    whole = lambda t: len(tokens._encoder(tokens.VOCABULARY).encode_ordinary(t))
    rng = random.Random(7)
    words = ["word", "x", "Ünïcode", "不知道", "12345", "don't", "...", "\r\n", " ", "　", " ", "  ", "\t"]
    with_blanks = "".join(rng.choice(words) + " " * rng.choice([0, 1, 1, 2]) for _ in range(80_000))
    without = "".join(rng.choice("abcdefg好不.") for _ in range(210_000))
    for text in (with_blanks, without, "ab" + " " * 30_000 + "cd" + "\n" * 20_000 + " x", "\n" * 15_000):
        assert tokens.count(text) == whole(text)
    monkeypatch.setattr(tokens, "LONG_RUN", 2)
    for _ in range(300):
        text = "".join(rng.choice(words + ["   ", "\n\n\n", " \n", " "]) for _ in range(rng.randint(0, 60)))
        assert tokens.count(text) == (whole(text) if text else 0), text
    assert tokens.count(" " * 2_000_000 + "a") > 0  # too long a run for the split pattern's engine


def test_list_levels():
    text = "Intro.\n- one. More.\n  - two\n    wrapped\n\n    Still two.\n  - three\n- four\n\n  Still four.\n\nOutside.\n1. five\n# Head\n   text\n"
    got = [(text[:end].split("\n")[-1].strip(" -"), unit, level) for end, unit, level in sentences.leveled_ends(text)]
    assert got == [("Intro.", "text", 0), ("one.", "item", 1), ("one. More.", "item", 1), ("wrapped", "item", 2), ("Still two.", "item", 2), ("three", "item", 2), ("four", "item", 1), ("Still four.", "item", 1), ("Outside.", "text", 0), ("1. five", "item", 1), ("# Head", "heading", 0), ("text", "text", 0)]


def _seconds(work, size):
    best = 9e9
    for _ in range(3):
        begin = time.perf_counter()
        work(size)
        best = min(best, time.perf_counter() - begin)
    return best


def _documented(n):
    seen = funcdoc.SourceLines("".join(f"/** Doc {i}. */\nfunction f{i}() {{\n  return g(\n}}\n" for i in range(n)), "javascript")
    for i in range(n):
        seen.block_end(4 * i + 2)
        seen.comment_above(4 * i + 2)


def _docstrings(n):
    seen = funcdoc.SourceLines("".join(f"def f{i}(:\n    '''doc'''\n    return {i}\n" for i in range(n)), "python")
    for i in range(n):
        seen.docstring(3 * i + 1, 3 * i + 3)


@pytest.mark.parametrize("work", [_documented, _docstrings, lambda n: sentences.sentence_ends("([“„" * n), lambda n: sentences.sentence_ends("a ( " * n + "5 s. A. … b " * n)])
def test_costs_grow_with_the_length(work):
    assert _seconds(work, 16_000) < 10 * _seconds(work, 4_000)  # in proportion: 4 times


def test_crowded_paths_and_rows_without_a_path(make, monkeypatch):
    from conftest import node

    monkeypatch.setattr(funcdoc, "FILE_FUNCTIONS", 3)
    doc = "Keeps the order and drops repeats."
    text = "".join(f"// Reads all the open files again.\nfunction f{i}() {{}}\n" for i in range(20))
    rows = [node(str(i), f"f{i}", path="r/a.ts", line=2 * i + 2, end=2 * i + 2) for i in range(20)] + [node(f"n{i}", path=None, doc=doc) for i in range(20)] + [node("late", path="r/a.ts", line=900, end=901), node("dup", path="r/a.ts", line=2, end=2)] * 2
    got = [r["id"] for r in funcdoc.documented_functions(make("nodes", rows), make("texts", [("r/a.ts", text)])).collect()]
    assert sorted(got) == sorted([str(i) for i in range(20)] + [f"n{i}" for i in range(20)] + ["dup"])


def test_small_weights_keep_their_slots():
    w = mixing.whole_weights({"a": 0.99997, "b": 0.00003})
    assert w["b"] / sum(w.values()) == 0.00003
    many = mixing.whole_weights({str(i): 1 / 12_000 for i in range(12_000)})
    assert min(many.values()) >= 8 and sum(many.values()) == 100_000
    with pytest.raises(GraphError):
        mixing.whole_weights({"a": 1.0, "b": 1e-9})


def test_a_rule_of_most_files_is_split_over_tasks(spark, monkeypatch):
    from skeinworks import session
    from skeinworks.llm import provenance

    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    features = spark.range(40_000).selectExpr("concat('r', id % 50, '/f', id, '.js') AS path", "array(named_struct('rule', CASE WHEN id % 10 < 9 THEN 7L ELSE id END, 'tokens', 20L), named_struct('rule', -id, 'tokens', 30L)) AS rules").repartition(16)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = provenance.foreign_tokens(features)
        rows = found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(rows) == 36_000 and {r["foreign"] for r in rows} == {20}
