import random

from skeinworks.llm import mixing

BLOCK = 100


def test_a_mix_of_texts_longer_than_a_block(make, spark):
    rng = random.Random(2)
    share = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = [(i, " ".join(str(rng.randrange(999)) for _ in range(rng.choice([5, 20, 400]))), rng.choice("abc"), "en") for i in range(300)]
    targets = spark.createDataFrame([(s, w, 1) for s, w in share.items()], "source string, target_share double, max_repeats int")
    got = mixing.mixed(make("documents", rows), targets, block_tokens=BLOCK).collect()
    longest = max(r["n_tokens"] for r in got)
    total = sum(r["n_tokens"] for r in got)
    deviations = []
    for slots in range(1, total // BLOCK):
        run = dict.fromkeys(share, 0)
        for r in got:
            if r["slot"] < slots:
                run[r["source"]] += r["n_tokens"]
        deviations += [run[s] - slots * BLOCK * w for s, w in share.items()]
    assert longest > 3 * BLOCK
    assert -BLOCK < min(deviations) and max(deviations) < BLOCK + longest
    assert max(deviations) > BLOCK  # a block alone is no bound
