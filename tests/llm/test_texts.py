import random

import pytest
from pyspark.sql import functions as F

from skeinworks.llm import mixing, packing, sentences, tokens

CASES = [
    ("Dr. Tessaly wrote: \"It is done.\" By now it works, etc. This is new.", ['Dr. Tessaly wrote: "It is done."', "By now it works, etc.", "This is new."]),
    ("It asks \"why?\" before it writes... Well... the end. See No. 5, e.g. at 9.30 p.m. sharp!", ['It asks "why?" before it writes...', "Well... the end.", "See No. 5, e.g. at 9.30 p.m. sharp!"]),
    ("(It is optional.) Use a.b or c.d; both work (see Fig. 2). J. K. Orvane et al. agree?! walkFile returns.", ["(It is optional.)", "Use a.b or c.d; both work (see Fig. 2).", "J. K. Orvane et al. agree?!", "walkFile returns."]),
    ("# Head. Two.\n- one. two\n- three\nwrapped\n\n1. four\n```sh\na. b\n\nc\n```\nlast", ["Head.", "Two.", "one.", "two", "three\nwrapped", "four", "```sh\na. b\n\nc\n```", "last"]),
    ("Am 3. März kam es, z. B. hier. „Ist es alt?“, fragte Fr. Brenndorf. Es dauert 5 s. Ende usw. Neu.", ["Am 3. März kam es, z. B. hier.", "„Ist es alt?“, fragte Fr. Brenndorf.", "Es dauert 5 s.", "Ende usw.", "Neu."]),
    ("M. Tour a écrit : « C'est prêt. » Il dit « fini. » trop tôt ! Quoi ?", ["M. Tour a écrit : « C'est prêt. »", "Il dit « fini. » trop tôt !", "Quoi ?"]),
    ("В 2024 г. вышел файл, т. е. всё. «Почему?» — спросил К. Луговин. Мы убрали и т. д. Новый.", ["В 2024 г. вышел файл, т. е. всё.", "«Почему?» — спросил К. Луговин.", "Мы убрали и т. д.", "Новый."]),
    ("他写道：“先关闭。再打开。”路径显示“完成。”，对吗？“过期了吗？”小岚问道。（可选。）结束……", ["他写道：“先关闭。再打开。”", "路径显示“完成。”，对吗？", "“过期了吗？”小岚问道。", "（可选。）", "结束……"]),
    ("「完了。」と表示します。えっと……まだです。（任意です。）v1.2以降です！", ["「完了。」と表示します。", "えっと……まだです。", "（任意です。）", "v1.2以降です！"]),
    ("«أين الرمز؟» سأل أ. مرجانة. كتب د. سنديان: «جاهز.» نعم.", ["«أين الرمز؟» سأل أ. مرجانة.", "كتب د. سنديان: «جاهز.»", "نعم."]),
    ("\"कहाँ है?\" डॉ. वन ने पूछा। उदा. यह। नया!", ['"कहाँ है?" डॉ. वन ने पूछा।', "उदा. यह।", "नया!"]),
    ("ระบบอ่านไฟล์ รุ่น 4.1 ทำให้เล็กลง เราลบ", ["ระบบอ่านไฟล์", "รุ่น 4.1 ทำให้เล็กลง", "เราลบ"]),
    ("", []), (None, []), (" \n\t", []), ("(never closed. But goes on.", ["(never closed.", "But goes on."]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_sentences(text, want):
    for eol in ("\n", "\r\n"):
        t = text.replace("\n", eol) if text else text
        last, got = 0, []
        for end, unit in sentences.sentence_ends(t):
            piece = t[last:end].strip()
            last = end
            assert not t[end - 1].isspace()
            got.append(piece.lstrip("#").strip() if unit == "heading" else piece)
        strip = [g.lstrip("-0123456789").removeprefix(". ").strip() if not w.startswith(g[:3]) else g for g, w in zip(got, want, strict=True)]
        assert [s.replace("\r", "") for s in strip] == want


def test_sentences_of_long_and_odd_texts(spark):
    long = "One two. " * 20_000
    assert len(sentences.sentence_ends(long)) == 20_000
    for odd in ("((((" * 3000, "\"" * 3001, "." * 5000, "「" * 500 + "。" * 500, "```\n" * 99):
        ends = [e for e, _ in sentences.sentence_ends(odd)]
        assert ends == sorted(set(ends)) and ends[-1] <= len(odd)
    df = spark.createDataFrame([(1, "A. B c."), (2, None), (3, " ")], "doc_id long, text string").withColumn("end_char", F.lit(1))
    assert [(r["sentence_no"], r["start_char"], r["end_char"]) for r in sentences.sentences(df).collect()] == [(1, 0, 7)]
    assert sentences.sentences(df.where("false")).count() == 0


def _bins(sizes, capacity):
    """Exact minimum by search, for a few items."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_packing_is_feasible_and_near_the_optimum():
    rng = random.Random(2)
    extra = 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        plan = packing.pack_histogram(counts, capacity)
        placed = {}
        for n, content in plan:
            assert sum(s * k for s, k in content.items()) <= capacity
            for s, k in content.items():
                placed[s] = placed.get(s, 0) + n * k
        assert placed == counts
        extra += sum(n for n, _ in plan) - _bins(sizes, capacity)
    assert extra <= 8  # best fit is a heuristic


def test_reduction_alone_never_costs_a_container():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 20])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        plan = []
        left = packing._reduce(packing.Histogram({s: sizes.count(s) for s in sizes}), capacity, plan)
        rest = [s for s, n in left.count.items() for _ in range(n)]
        assert sum(n for n, _ in plan) + _bins(sorted(rest, reverse=True), capacity) == _bins(sizes, capacity), sizes


def test_packed_documents(make, spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 5)
    rows = [(i, "word " * (i % 7 + 1) if i % 10 else "x y " * 40, "s", "en") for i in range(60)] + [(100, None, "s", "en"), (101, "", "s", "en"), (102, "word word", "s", "en")]
    kinds = spark.createDataFrame([("a", 8), ("b", 64), (None, 5), ("zero", 0)], "container string, capacity_tokens int")
    got = packing.packed(make("documents", rows).withColumn("salt", F.lit(1)), kinds).collect()
    sizes = {i: tokens.count(t) for i, t, *_ in rows}
    for container, capacity in (("a", 8), ("b", 64)):
        mine = [r for r in got if r["container"] == container]
        fill = {}
        for r in mine:
            fill[r["container_no"]] = fill.get(r["container_no"], 0) + r["n_tokens"]
        assert max(fill.values()) <= capacity and fill.pop(0) == 0
        assert sorted(fill) == list(range(1, len(fill) + 1))
        by = {}
        for r in mine:
            by.setdefault(r["doc_id"], []).append(r["n_tokens"])
        assert {k: sum(v) for k, v in by.items()} == {k: v for k, v in sizes.items() if k != 100}
        assert all(len(v) == 1 for k, v in by.items() if sizes[k] <= capacity)
        assert len(fill) <= 1.1 * sum(fill.values()) / capacity + 1
    assert packing.packed(make("documents", []), kinds).count() == 0
    assert {r["container"] for r in packing.container_report(make("documents", rows), kinds).collect()} == {"a", "b"}


def test_pfair_deviates_less_than_a_block():
    for weights in ({"a": 50, "b": 30, "c": 20}, {"a": 97, "b": 1, "c": 2}, {"x": 15, "y": 10, "z": 22, "p": 20, "q": 8, "r": 5, "s": 15, "t": 5}):
        period, done = sum(weights.values()), dict.fromkeys(weights, 0)
        order = sorted(mixing.pfair_period(weights), key=lambda x: x[2])
        assert [x[2] for x in order] == list(range(period))
        for t, (s, k, _) in enumerate(order, 1):
            assert k == done[s]
            done[s] += 1
            assert all(abs(done[x] - t * w / period) < 1 for x, w in weights.items())
        assert done == weights
    assert sum(mixing.whole_weights({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}).values()) == mixing.PERIOD


def test_mix_reaches_the_shares(make, spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 20)
    rng = random.Random(1)
    rows = [(i, " ".join(str(rng.randrange(999)) for _ in range(20)), rng.choice(["big", "big", "big", " Small "]), "en") for i in range(400)]
    rows += [(1000, rows[0][1], "big", "en"), (1001, None, "big", "en"), (1002, "", "big", "en"), (1003, "a b", None, "en"), (1004, "a c", "other", "en")]
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.5, 2), ("none", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(make("documents", rows), targets, block_tokens=100)
    got = mix.orderBy("slot", "tokens_before").collect()
    total = sum(r["n_tokens"] for r in got)
    share = {s: sum(r["n_tokens"] for r in got if r["source"] == s) / total for s in ("big", "small")}
    assert abs(share["big"] - 0.5) < 0.02 and set(r["source"] for r in got) == {"big", "small"}
    uses = {}
    for r in got:
        uses.setdefault((r["source"], r["text_id"]), []).append(r["copy"])
    assert all(len(v) <= (1 if s == "big" else 2) and sorted(v) == list(range(len(v))) for (s, _), v in uses.items())
    run = {"big": 0, "small": 0}
    for r in got:
        run[r["source"]] += r["n_tokens"]
        assert abs(run["big"] - run["small"]) / 2 < 100 + 60
    report = {r["source"]: r for r in mixing.share_report(mix, targets).collect()}
    assert report["none"]["share"] == 0 and abs(report["small"]["share"] - share["small"]) < 1e-9 and report["small"]["most_copies"] <= 2
    assert mixing.mixed(make("documents", []), targets).count() == 0


def test_token_counts():
    assert tokens.count(None) == tokens.count("") == 0
    assert tokens.count("hello world") >= 2
    long = "word " * 100_000
    assert 100_000 <= tokens.count(long) <= 200_010
