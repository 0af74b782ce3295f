"""Problem 7: filling containers of fixed capacity.

Items are shards of rows; what is planned is not items but *lengths*: the histogram of a shard has
at most ``capacity`` entries however many rows stand behind it.  A plan is a list of patterns, each
a multiset of lengths with a number of copies.  Patterns are found by exact-complement hashing:
from the longest length on, the gap that is left is looked up among the single lengths, the sums of
pairs and the sums of triples that the availability counts allow; only combinations that fill it
exactly are consumed.  What no exact combination takes is pooled over all shards (again a
histogram) and planned the same way, with best fit for the rest.

Physical plan: tokens are counted in one narrow stage and checkpointed; histograms are aggregated
map-side; each shard is planned in its own task; items meet their pattern in a join on
(shard, length) by their rank within it.  Only histograms ever reach one task.

Defined cases: a null or empty text has no tokens and goes into container 0, where it takes no
room; an item longer than the capacity is cut into full pieces and a rest, any other stays whole;
equal items are told apart by id; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokenize import token_count
from tidemark.session import cut

CAPACITY = 2048
SHARD_ITEMS = 250_000
_PLAN = "shard int, length int, lo long, hi long, copies long, base long"


class _Stock:
    """Availability counts by length with an index of the sums of one, two and three lengths."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # index: length
        self.capacity = len(counts) - 1
        self._refresh()

    def _refresh(self) -> None:
        here = (self.counts > 0).astype(float)
        size = 4 * len(here)
        f = np.fft.rfft(here, size)
        pairs, triples = (np.rint(np.fft.irfft(f**k, size))[: len(here)] for k in (2, 3))
        # what would take more of a length than there are: two of a lone one, three of one or two
        lone = np.flatnonzero(self.counts == 1)
        twice = np.zeros(len(here))
        twice[2 * lone[2 * lone < len(here)]] = 1
        pairs -= twice
        beside = np.rint(np.fft.irfft(np.fft.rfft(twice, size) * f, size))[: len(here)]
        thrice = 3 * lone[3 * lone < len(here)]
        beside[thrice] -= 1
        triples -= 3 * beside
        few = np.flatnonzero((self.counts > 0) & (self.counts < 3))
        triples[3 * few[3 * few < len(here)]] -= 1
        self.single, self.pair, self.triple = here > 0, pairs > 0, triples > 0

    def take(self, lengths: list[int], copies: int) -> None:
        for n in lengths:
            self.counts[n] -= copies
        if any(self.counts[n] <= 1 for n in lengths):
            self._refresh()

    def copies(self, lengths: list[int]) -> int:
        uses = {n: lengths.count(n) for n in set(lengths)}
        return min(int(self.counts[n]) // k for n, k in uses.items())

    def fits(self, lengths: list[int]) -> bool:
        return self.copies(lengths) > 0

    def complement(self, gap: int, base: list[int]) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly beside ``base``; longest first. None only
        if no such lengths are in stock."""
        if self.single[gap] and self.fits(base + [gap]):
            return [gap]
        first = np.flatnonzero(self.single[:gap])
        if self.pair[gap]:
            for a in first[self.single[gap - first] & (first >= gap - first)][::-1]:
                if self.fits(base + [int(a), gap - int(a)]):
                    return [int(a), gap - int(a)]
        if not self.triple[gap]:
            return None
        for a in first[self.pair[gap - first] & (3 * first >= gap)][::-1]:
            rest = gap - int(a)
            second = first[(first < rest) & (first <= a)]
            for b in second[self.single[rest - second] & (second >= rest - second)][::-1]:
                if self.fits(base + [int(a), int(b), rest - int(b)]):
                    return [int(a), int(b), rest - int(b)]
        return None

    def longest(self, gap: int, base: list[int]) -> int | None:
        for n in np.flatnonzero(self.single[: gap + 1])[::-1]:
            if self.fits(base + [int(n)]):
                return int(n)
        return None


def plan_histogram(counts: np.ndarray, finish: bool) -> list[tuple[list[int], int]]:
    """Patterns (lengths, copies) for a histogram (index: length, 0 unused).

    Without ``finish`` only exactly full containers are planned and the rest of the stock is left.
    """
    stock = _Stock(counts.astype(np.int64).copy())
    stock.counts[0] = 0
    stock._refresh()
    out: list[tuple[list[int], int]] = []
    for top in range(stock.capacity, 0, -1):
        while stock.counts[top] > 0:
            chosen, gap = [top], stock.capacity - top
            while gap:
                filled = stock.complement(gap, chosen)
                if filled:
                    chosen, gap = chosen + filled, 0
                    break
                nxt = stock.longest(gap, chosen)
                if nxt is None:
                    break
                chosen, gap = chosen + [nxt], gap - nxt
            if gap and not finish:
                break
            copies = stock.copies(chosen)
            out.append((chosen, copies))
            stock.take(chosen, copies)
    return out


def _plan_rows(patterns: list[tuple[list[int], int]], shard: int) -> pd.DataFrame:
    """Rank intervals of each length, in the order of the patterns."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, copies in patterns:
        for n in sorted(set(lengths)):
            lo = used.get(n, 0)
            hi = lo + lengths.count(n) * copies
            rows.append((shard, n, lo, hi, copies, base))
            used[n] = hi
        base += copies
    return pd.DataFrame(rows, columns=["shard", "length", "lo", "hi", "copies", "base"]).astype(
        {"shard": "int32", "length": "int32", "lo": "int64", "hi": "int64", "copies": "int64", "base": "int64"}
    )


def _planner(capacity: int, finish: bool):
    def plan(h: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(capacity + 1, dtype=np.int64)
        np.add.at(counts, h["length"].to_numpy(), h["n"].to_numpy())
        return _plan_rows(plan_histogram(counts, finish), int(h["shard"].iloc[0]))

    return plan


def pack_items(items: DataFrame, id_col: str, length_col: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_id, id, piece_no, start, length): every piece of every item in its container.

    Container ids are unique, not dense: the shard is in their upper bits.
    """
    base = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("total"))
    pieces = base.withColumn(
        "piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("int")))
    )
    pieces = pieces.withColumn("start", F.col("piece_no").cast("long") * capacity).withColumn(
        "length", F.least(F.col("total") - F.col("start"), F.lit(capacity)).cast("int")
    )
    shards = max(1, -(-pieces.count() // shard_items))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece_no"), F.lit(shards)).cast("int")).drop("total")
    filled = pieces.where("length > 0")
    ranked = filled.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "length").orderBy("id", "piece_no")) - 1)
    histogram = cut(filled.groupBy("shard", "length").agg(F.count("*").alias("n")))
    exact = cut(histogram.groupBy("shard").applyInPandas(_planner(capacity, finish=False), _PLAN))
    taken = exact.groupBy("shard", "length").agg(F.max("hi").alias("taken"))
    left = histogram.join(taken, ["shard", "length"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    left = cut(left.withColumn("offset", F.coalesce(F.sum(F.col("n") - F.col("taken")).over(before), F.lit(0))))
    # the pooled rest is a histogram again: at most ``capacity`` rows, whatever the data's size
    pooled = left.groupBy("length").agg(F.sum(F.col("n") - F.col("taken")).alias("n")).where("n > 0").withColumn("shard", F.lit(shards))
    rest = cut(pooled.groupBy("shard").applyInPandas(_planner(capacity, finish=True), _PLAN))
    placed = ranked.join(left.select("shard", "length", "taken", "offset"), ["shard", "length"])
    loose = F.col("rank") >= F.col("taken")
    placed = placed.select(
        "id",
        "piece_no",
        "start",
        "length",
        F.when(loose, F.lit(shards)).otherwise(F.col("shard")).alias("shard"),
        F.when(loose, F.col("rank") - F.col("taken") + F.col("offset")).otherwise(F.col("rank")).alias("rank"),
    )
    plan = exact.unionByName(rest)
    packed = (
        placed.join(plan, ["shard", "length"])
        .where("rank >= lo and rank < hi")
        .withColumn("container_id", F.shiftleft(F.col("shard").cast("long"), 40) + F.col("base") + F.pmod(F.col("rank") - F.col("lo"), F.col("copies")))
        .select("container_id", "id", "piece_no", "start", "length")
    )
    empty = pieces.where("length <= 0").select(F.lit(0).cast("long").alias("container_id"), "id", "piece_no", "start", F.lit(0).alias("length"))
    return packed.unionByName(empty)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_id, doc_id, piece_no, start_token, n_tokens) of all documents."""
    sized = cut(documents.select(F.col("doc_id").alias("id"), token_count(F.col("text"), path).alias("n")))
    return pack_items(sized, "id", "n", capacity, shard_items).select(
        "container_id", F.col("id").alias("doc_id"), "piece_no", F.col("start").alias("start_token"), F.col("length").alias("n_tokens")
    )
