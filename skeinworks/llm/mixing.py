"""Problem 7: mixing sources to target weights.

The mix holds as many tokens as the scarcest source allows when each of its
texts is used ``max_repeats`` times.  Within a source the texts stand in a
random but reproducible order; running sums of their tokens cut each source
into blocks of equal size.  Blocks are scheduled by Pfair: the k-th block of a
source of weight w is released at floor((k-1)/w) and due at ceil(k/w), and
earliest deadline first runs the released block that is due next, so that in no
prefix the blocks of a source deviate from its target by a whole one.  With
weights as multiples of 1/D every deviation is zero again after D slots; the
schedule of one such period therefore places every block, and blocks find their
slot by a join instead of a scan.

A text stands in the block where it begins and is never cut.  In tokens a source
therefore lags behind its schedule by less than a block, and is ahead of it by
less than a block and the longest text together.  No order of whole texts does
better than half the longest text on both sides.

Source names are compared without case and surrounding space.  A text counts
once however many ids it has: for the source that wants it with the smallest
id.  Texts without tokens, and of sources without a target, take no part.
Targets without any text are reported with a share of 0; the others share the
mix in proportion to their targets.
"""

from __future__ import annotations

import heapq
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import GraphError
from ..session import bounded_batches, cut_lineage, spread
from . import tokens
from .sources import small_table

#: Denominator of the weights: one period of the schedule has so many slots, or ten or a hundred times as many where a weight
#: would have none of them.
PERIOD, MOST_PERIOD = 10_000, 1_000_000
#: Tokens of a block.
BLOCK_TOKENS = 4096
#: Rows of one group of running sums at most, on average.
GROUP_ROWS = 50_000


def whole_weights(shares: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Shares as whole numbers that add up to the period (largest remainders first); each at least 1.

    They order the blocks only; how many tokens a source gives follows from its exact share.  A share below one of
    ``MOST_PERIOD`` slots is refused.
    """
    total = sum(shares.values())
    while period < MOST_PERIOD and min(shares.values()) / total * period < 1:
        period *= 10
    if min(shares.values()) / total * period < 1:
        raise GraphError("INVALID_REQUEST", f"a share is below {1 / MOST_PERIOD}")
    exact = {s: w / total * period for s, w in shares.items()}
    out = {s: max(1, floor(x + 1e-9)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    i = 0
    while sum(out.values()) < period:
        out[by_rest[i % len(by_rest)]] += 1
        i += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def pfair_period(weights: dict[str, int]) -> list[tuple[str, int, int]]:
    """``(source, block, slot)`` for one period: earliest deadline first among the released blocks."""
    period = sum(weights.values())
    release = sorted((floor(k * period / w), s, k) for s, w in weights.items() for k in range(w))
    out: list[tuple[str, int, int]] = []
    due: list[tuple[int, str, int]] = []
    at = 0
    for slot in range(period):
        while at < len(release) and release[at][0] <= slot:
            _, s, k = release[at]
            heapq.heappush(due, (ceil((k + 1) * period / weights[s]), s, k))
            at += 1
        _, s, k = heapq.heappop(due)
        out.append((s, k, slot))
    return out


def _ordered(documents: DataFrame, targets: DataFrame, vocabulary: str, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """Each wanted text once, with the tokens of its source before it; and the tokens of each source."""
    name = F.lower(F.trim("source"))
    wanted = targets.select(F.col("source").alias("wanted"))
    small = bounded_batches(spread(documents.where("text IS NOT NULL AND text <> ''").select(name.alias("source"), "doc_id", "text")))
    mine = small.join(wanted, small["source"] == wanted["wanted"], "left_semi")
    digest = F.sha2("text", 256)
    sized = tokens.with_token_count(mine, vocabulary).select("source", "doc_id", digest.alias("text_id"), "n_tokens")
    # a repeated text is one text: its copies meet as one partial aggregate per task
    once = sized.groupBy("text_id").agg(F.min_by(F.struct("source", "doc_id", "n_tokens"), F.struct("doc_id", "source")).alias("d")).select("text_id", "d.*")
    once = cut_lineage(once.where("n_tokens > 0"))
    sums = {r["source"]: (r["n"], r["t"]) for r in once.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    groups = max(1, max((n for n, _ in sums.values()), default=0) // GROUP_ROWS)
    key = F.xxhash64("text_id", F.lit(seed))
    placed = once.withColumn("key", key).withColumn("part", F.floor((F.col("key").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * groups))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "part").orderBy("key", "text_id").rowsBetween(Window.unboundedPreceding, -1))
    per_part = placed.groupBy("source", "part").agg(F.sum("n_tokens").alias("t"))
    offset = per_part.select("source", "part", (F.sum("t").over(Window.partitionBy("source").orderBy("part")) - F.col("t")).alias("offset"))
    ordered = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offset, ["source", "part"])
    return ordered.withColumn("before", F.col("offset") + F.col("inside")).select("source", "doc_id", "text_id", "n_tokens", "before"), {s: t for s, (_, t) in sums.items()}


def _targets(source_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and repeats by source name, a bounded parameter table: names without a positive share are left out."""
    rows = source_targets.where("source IS NOT NULL AND target_share > 0").select(F.lower(F.trim("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("r"))
    return {r["source"]: (r["s"], r["r"]) for r in rows.groupBy("source").agg(F.sum("target_share").alias("s"), F.min("r").alias("r")).collect()}


def mixed(documents: DataFrame, source_targets: DataFrame, vocabulary: str = tokens.VOCABULARY, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """``slot, tokens_before, source, doc_id, text_id, copy, n_tokens``: the mix.  Its order is ``slot, tokens_before``: slots
    are blocks in the order of the schedule, and within a block the source's texts follow each other."""
    spark: SparkSession = documents.sparkSession
    wanted = _targets(source_targets)
    names = small_table(spark, [(s,) for s in sorted(wanted)], "source string")
    ordered, available = _ordered(documents, names, vocabulary, seed)
    able = {s: w for s, (w, _) in wanted.items() if available.get(s)}
    schema = "source string, total long, quota double, repeats int"
    total = min((available[s] * wanted[s][1] / (w / sum(able.values())) for s, w in able.items()), default=0.0)
    quotas = [(s, available[s], w / sum(able.values()) * total, wanted[s][1]) for s, w in sorted(able.items())]
    if not able:
        return ordered.where("false").selectExpr("0L AS slot", "0L AS tokens_before", "source", "doc_id", "text_id", "0 AS copy", "n_tokens")
    # one row per target
    use = ordered.join(small_table(spark, quotas, schema), "source")
    copies = use.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1))).withColumn("tokens_before", F.col("before") + F.col("copy") * F.col("total"))
    chosen = copies.where("tokens_before < quota")
    weights = whole_weights(able)
    period = sum(weights.values())
    schedule = small_table(spark, pfair_period(weights), "source string, k int, slot int")
    per = small_table(spark, sorted(weights.items()), "source string, w int")
    block = chosen.withColumn("block", F.floor(F.col("tokens_before") / F.lit(block_tokens))).join(per, "source")
    block = block.withColumn("k", (F.col("block") % F.col("w")).cast("int")).withColumn("round", F.floor(F.col("block") / F.col("w")))
    # the schedule has as many rows as slots, whatever the data
    slotted = block.join(schedule, ["source", "k"])
    slot = (F.col("round") * F.lit(period) + F.col("slot")).cast("long")
    return slotted.select(slot.alias("slot"), F.col("tokens_before").cast("long").alias("tokens_before"), "source", "doc_id", "text_id", "copy", "n_tokens")


def share_report(mix: DataFrame, source_targets: DataFrame) -> DataFrame:
    """Per target: share asked for, tokens and share reached, texts used and most copies of one text."""
    copies = mix.groupBy("source", "text_id").agg(F.count("*").alias("copies"), F.sum("n_tokens").alias("t"))
    used = copies.groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    asked = source_targets.where("source IS NOT NULL").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    joined = asked.join(used, "source", "left")
    whole = F.sum("tokens").over(Window.partitionBy())
    return joined.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("share"))
