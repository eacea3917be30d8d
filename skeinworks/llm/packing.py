"""Problem 6: filling containers of fixed capacity with whole texts.

How well a set of sizes packs depends on the sizes alone, so the plan is made
on their histogram: at most as many entries as the largest capacity, whatever
the number of texts.  Martello and Toth's dominance reduction fixes sets that
provably dominate every other choice for their largest member (whole classes of
equal sets at once), shrinks the instance, and repeats; best fit by decreasing
size packs the remainder.  The plan is a table of slots -- so many containers
of this content -- and every text finds its container by its rank among the
texts of its size, counted in salted groups so that a common size is no hot key.

A text larger than the capacity is cut into full containers and a rest that is
packed like a text.  Empty texts have no tokens and go to container 0 as piece
0; NULL texts are no items.  Texts repeated under a new id are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded_batches, cut_lineage, spread
from . import tokens
from .sources import small_table

#: Rows of one rank group at most, on average.
GROUP_ROWS = 50_000


@dataclass
class Histogram:
    """Sizes with how many items of each are left."""

    count: dict[int, int]
    sizes: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.count = {s: c for s, c in self.count.items() if c > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def largest(self, room: int, *used: int) -> int:
        """The largest size left that fits beside one item of each of the used sizes, 0 if none."""
        i = bisect_right(self.sizes, room)
        while i and self.count[self.sizes[i - 1]] <= used.count(self.sizes[i - 1]):
            i -= 1
        return self.sizes[i - 1] if i else 0

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.count[s])
            if len(out) >= n:
                break
        return out


def _reduce(h: Histogram, capacity: int, plan: list[tuple[int, dict[int, int]]]) -> Histogram:
    """Fixes dominating sets; returns what is left.

    For the largest size ``s`` of an item with room ``r`` beside it:
    no other item fits -- {s} dominates;
    one fills the room exactly -- {s, r} dominates;
    only one more item ever fits, or every feasible set of others weighs no more
    than the largest single one -- {s, largest} dominates;
    at most two more fit, and the pair of the two largest choices bounds both
    members of every feasible pair -- {s, largest, second} dominates.
    """
    for s in list(reversed(h.sizes)):
        while s in h.count:
            c, r = h.count[s], capacity - s
            h.take(s, 1)  # the item itself is no choice beside it
            k = h.largest(r)
            low = h.smallest(3)
            h.count[s] = h.count.get(s, 0) + 1
            if h.count[s] == 1:
                insort(h.sizes, s)
            if not k:
                plan.append((c, {s: 1}))
                h.take(s, c)
                continue
            single = k == r or len(low) < 2 or low[0] + low[1] > r
            content = None
            if single:
                content = {s: 1}
                content[k] = content.get(k, 0) + 1
            elif len(low) < 3 or sum(low) > r:
                # only pairs: is (k, b) at least as large in both members as any feasible pair?
                b = h.largest(r - k, s, k)
                # the smaller member of any pair is at most half of the room
                half = h.largest(r // 2, s)
                if b and half and b >= half:
                    content = {s: 1}
                    for x in (k, b):
                        content[x] = content.get(x, 0) + 1
            if content is None:
                break  # it stays a choice beside others
            times = min(h.count[x] // n for x, n in content.items())
            plan.append((times, content))
            for x, n in content.items():
                h.take(x, times * n)
    return h


def _best_fit(h: Histogram, capacity: int, plan: list[tuple[int, dict[int, int]]]) -> None:
    """Best fit by decreasing size, equal containers together."""
    open_bins: dict[int, list[list]] = {}  # room -> [number of containers, content]
    rooms: list[int] = []

    def put(room: int, number: int, content: dict[int, int]) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([number, content])

    for s in sorted(h.count, reverse=True):
        left = h.count[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                if left >= each:
                    put(capacity - each * s, left // each, {s: each})
                if left % each:
                    put(capacity - left % each * s, 1, {s: left % each})
                break
            room = rooms[i]
            group = open_bins[room][-1]
            each = room // s
            full = min(group[0], left // each)
            use, per = (full, each) if full else (1, left)
            group[0] -= use
            if not group[0]:
                open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    del rooms[i]
            content = dict(group[1])
            content[s] = content.get(s, 0) + per
            put(room - per * s, use, content)
            left -= use * per
    for groups in open_bins.values():
        plan += [(n, c) for n, c in groups]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(number of containers, {size: items in each})`` for a histogram of sizes from 1 to the capacity."""
    plan: list[tuple[int, dict[int, int]]] = []
    left = Histogram(dict(counts))
    fixed = -1
    while fixed != len(plan):  # shrink until no set dominates any more
        fixed = len(plan)
        left = _reduce(left, capacity, plan)
    _best_fit(left, capacity, plan)
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """``(size, first rank, last rank + 1, first container, items in each)`` rows; ranks count from 0 within a size."""
    rows, used, base = [], {}, 0
    for number, content in plan:
        for size, each in content.items():
            begin = used.get(size, 0)
            used[size] = begin + number * each
            rows.append((size, begin, used[size], base, each))
        base += number
    return rows


def stretches(rows: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int, int]]]:
    """``(size, step)`` and ``(size, stretch, first rank, last rank + 1, first container, items in each)``: the slots by stretches
    of ``step`` ranks.  A size has about as many stretches as slots, so both a stretch's slots and a slot's stretches are few."""
    by: dict[int, list[tuple]] = {}
    for size, *slot in rows:
        by.setdefault(size, []).append(tuple(slot))
    steps, out = [], []
    for size, mine in by.items():
        step = -(-max(last for _, last, *_ in mine) // len(mine))
        steps.append((size, step))
        out += [(size, k, first, last, base, each) for first, last, base, each in mine for k in range(first // step, (last - 1) // step + 1)]
    return steps, out


def sized_items(documents: DataFrame, container_sizes: DataFrame, vocabulary: str) -> DataFrame:
    """``container, capacity_tokens, doc_id, piece, n_tokens``: every text, or its pieces, for each container."""
    texts = bounded_batches(spread(documents.where("text IS NOT NULL").select("doc_id", "text")))
    sized = tokens.with_token_count(texts, vocabulary).select("doc_id", "n_tokens")
    kinds = container_sizes.where("container IS NOT NULL AND capacity_tokens > 0").groupBy("container").agg(F.min("capacity_tokens").cast("long").alias("capacity_tokens"))
    # the few kinds of container become an array literal: each text is repeated per kind without a join
    rows = [(r["container"], r["capacity_tokens"]) for r in kinds.orderBy("container").collect()]
    if not rows:
        return sized.selectExpr("'' AS container", "0L AS capacity_tokens", "doc_id", "0L AS piece", "n_tokens").where("false")
    array = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(k).cast("long").alias("capacity_tokens")) for c, k in rows])
    each = sized.select("doc_id", F.col("n_tokens").alias("total"), F.explode(array).alias("k")).select("k.*", "doc_id", "total")
    pieces = F.greatest(F.ceil(F.col("total") / F.col("capacity_tokens")), F.lit(1))
    cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    size = F.least(F.col("capacity_tokens"), F.col("total") - F.col("piece") * F.col("capacity_tokens"))
    return cut.select("container", "capacity_tokens", "doc_id", "piece", size.alias("n_tokens"))


def packed(documents: DataFrame, container_sizes: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``container, container_no, doc_id, piece, n_tokens``: the container of every text, or of every piece of a text that
    exceeds the capacity; containers are numbered from 1."""
    spark: SparkSession = documents.sparkSession
    items = cut_lineage(sized_items(documents, container_sizes, vocabulary))
    total = items.count()
    salts = max(1, total // GROUP_ROWS)
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counted = items.where("n_tokens > 0").groupBy("container", "capacity_tokens", "n_tokens", "salt").agg(F.count("*").alias("n"))
    # the histogram: one row per container and size, so never more rows than the capacities add up to
    histogram = counted.groupBy("container", "capacity_tokens", "n_tokens").agg(F.sum("n").alias("n")).collect()
    steps, rows = [], []
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in histogram:
        by.setdefault((r["container"], r["capacity_tokens"]), {})[r["n_tokens"]] = r["n"]
    for (container, capacity), counts in sorted(by.items()):
        for all_, mine in zip((steps, rows), stretches(slots(pack_histogram(counts, capacity))), strict=True):
            all_ += [(container, *x) for x in mine]
    step = small_table(spark, steps, "container string, n_tokens long, step long")
    plan = small_table(spark, rows, "container string, n_tokens long, stretch long, first long, last long, base long, each long")
    # rank of an item among those of its size: its rank in its salt group and what the groups before it hold
    size = ["container", "n_tokens"]
    offsets = counted.withColumn("before", F.sum("n").over(Window.partitionBy(*size).orderBy("salt")) - F.col("n")).select(*size, "salt", "before")
    inner = F.row_number().over(Window.partitionBy(*size, "salt").orderBy("doc_id", "piece")) - 1
    ranked = items.where("n_tokens > 0").withColumn("inner", inner).join(offsets, [*size, "salt"]).withColumn("rank", F.col("before") + F.col("inner"))
    # a rank finds the few slots of its stretch by a join on (size, stretch), and one of them holds it
    found = ranked.join(step, size).withColumn("stretch", F.floor(F.col("rank") / F.col("step"))).join(plan, [*size, "stretch"]).where("first <= rank AND rank < last")
    number = F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("each")) + 1
    placed = found.select("container", number.cast("long").alias("container_no"), "doc_id", "piece", "n_tokens")
    empty = items.where("n_tokens = 0").select("container", F.lit(0).cast("long").alias("container_no"), "doc_id", "piece", "n_tokens")
    return placed.unionByName(empty)


def container_report(documents: DataFrame, container_sizes: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Containers used, tokens placed and unused share per kind of container."""
    placed = packed(documents, container_sizes, vocabulary).where("container_no > 0")
    kinds = container_sizes.groupBy("container").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    used = placed.groupBy("container").agg(F.max("container_no").alias("containers"), F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return kinds.join(used, "container").select("container", "capacity_tokens", "containers", "items", "tokens", (1 - F.col("tokens") / room).alias("unused_share"))
