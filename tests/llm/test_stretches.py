import random

from skeinworks.llm import packing


def test_each_rank_is_in_one_slot_of_its_stretch():
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.choice([10, 60])
        counts = {s: rng.choice([1, 2, 900]) for s in rng.sample(range(1, capacity + 1), rng.randint(1, 10))}
        rows = packing.slots(packing.pack_histogram(counts, capacity))
        steps, listed = packing.stretches(rows)
        step = dict(steps)
        assert set(step) == set(counts) and len(listed) <= 2 * len(rows)
        for size, n in counts.items():
            for rank in range(n):
                hits = [x for x in listed if x[0] == size and x[1] == rank // step[size] and x[2] <= rank < x[3]]
                assert len(hits) == 1
    assert packing.stretches([]) == ([], [])


def test_a_histogram_of_a_large_capacity_is_planned_in_time():
    import time

    rng = random.Random(1)
    counts = {s: rng.randint(1, 50) for s in range(1, 30_000)}
    begin = time.perf_counter()
    plan = packing.pack_histogram(counts, 30_000)
    assert time.perf_counter() - begin < 20
    assert sum(n * k for n, c in plan for k in c.values()) == sum(counts.values())
