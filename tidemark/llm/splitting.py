"""Problem 4: cutting oversized stretches at natural boundaries.

A stretch longer than the limit becomes consecutive pieces of at most the limit; each piece begins
a fixed overlap before the cut that ended the one before, and cuts lie at natural boundaries
wherever one can be reached.  All positions are whole metres.

Every usable boundary is joined to its farthest legal successor (a range window: the farthest
boundary at most limit - overlap ahead; a forced cut exactly there where none lies in reach).  The
successor table is then squared again and again (pointer doubling): after k rounds the cuts that a
greedy walk makes within 2**k steps are all known, so a track with n cuts needs log2(n) joins and
no walk.  Each round is a shuffle join on (id, position), its result cut into the shared
checkpoint folder; no item is ever gathered into one task.

Defined cases: items with an unknown (null, NaN, infinite) end, and items not longer than the
limit, are no cases; ends in metres (larger than any track in km, a parameter) and ends in reverse
order are put right; items longer than any track are left out, and counted by ``stretch_report``; breaks that are null, outside or exactly at an end do not count; a break without swath
applies to both; repeated items and breaks count once; empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

LONGEST_TRACK_KM = 20_100.0
_BIN_M = 500_000


def _ok(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e300)


def measured_stretches(segments: DataFrame, longest_km: float = LONGEST_TRACK_KM, metres_above: float = LONGEST_TRACK_KM) -> DataFrame:
    """(id, granule, swath, s, e, in_metres, too_long): every stretch with both ends known, in metres
    and in order. Ends of which one is beyond ``metres_above`` are read as metres, others as km; a
    stretch longer than ``longest_km`` is too long for any track."""
    x = segments.select(
        F.col("segment_id").alias("id"),
        "granule",
        F.lower(F.trim("swath")).alias("swath"),
        F.col("along_track_distance_start_km").cast("double").alias("a"),
        F.col("along_track_distance_end_km").cast("double").alias("b"),
    ).where(F.col("id").isNotNull() & _ok("a") & _ok("b"))
    x = x.withColumn("in_metres", F.greatest(F.abs("a"), F.abs("b")) > metres_above)
    m = [F.round(F.when(F.col("in_metres"), F.col(c)).otherwise(F.col(c) * 1000.0)).cast("long") for c in ("a", "b")]
    x = x.withColumn("s", F.least(*m)).withColumn("e", F.greatest(*m))
    return x.withColumn("too_long", F.col("e") - F.col("s") > int(longest_km * 1000)).drop("a", "b")


def stretch_report(segments: DataFrame, limit_km: float = 500.0, **rules) -> DataFrame:
    """(in_metres, too_long, over_limit, n): how the ends were read and what was left out as too long."""
    x = measured_stretches(segments, **rules).withColumn("over_limit", F.col("e") - F.col("s") > int(limit_km * 1000))
    return x.groupBy("in_metres", "too_long", "over_limit").agg(F.countDistinct("id").alias("n"))


def long_stretches(segments: DataFrame, limit_km: float = 500.0, **rules) -> DataFrame:
    """(id, granule, swath, s, e): stretches longer than the limit, ends in metres and in order; those
    too long for any track are left out (``stretch_report`` counts them)."""
    return (
        measured_stretches(segments, **rules)
        .where((F.col("e") - F.col("s") > int(limit_km * 1000)) & ~F.col("too_long"))
        .groupBy("id")
        .agg(F.min(F.struct("granule", "swath", "s", "e")).alias("x"))
        .select("id", "x.*")
    )


def inner_breaks(stretches: DataFrame, breaks: DataFrame) -> DataFrame:
    """(id, pos): distinct breaks strictly inside each stretch.

    The range join runs over bins of 500 km, so a granule with very many breaks or stretches is
    spread over its track.
    """
    b = (
        breaks.select("granule", F.lower(F.trim("swath")).alias("swath"), F.col("break_km").cast("double").alias("km"))
        .where(F.col("granule").isNotNull() & _ok("km"))
        .withColumn("swath", F.explode(F.when(F.col("swath").isNull(), F.array(F.lit("left"), F.lit("right"))).otherwise(F.array("swath"))))
        .select("granule", "swath", F.round(F.col("km") * 1000.0).cast("long").alias("pos"))
        .distinct()
        .withColumn("bin", F.floor(F.col("pos") / _BIN_M))
    )
    s = stretches.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / _BIN_M), F.floor(F.col("e") / _BIN_M))))
    return s.join(b, ["granule", "swath", "bin"]).where("pos > s and pos < e").select("id", "pos")


def boundaries(stretches: DataFrame, breaks: DataFrame, limit_km: float = 500.0, overlap_km: float = 50.0) -> DataFrame:
    """(id, pos, natural, s, e, widest, gap): every place a greedy walk may stand on.

    gap is the distance of a natural point from the natural one before it, usable or not; widest is
    the largest gap of the item.  The walk starts as if a cut lay one overlap behind the start; breaks it can never use
    lie before that.  Where natural points are farther apart than the reach, forced points follow
    each other at the reach.
    """
    limit, overlap = int(limit_km * 1000), int(overlap_km * 1000)
    reach = limit - overlap
    ends = stretches.select("id", F.explode(F.array("s", "e")).alias("pos"))
    natural = stretches.select("id", "s", "e").join(ends.unionByName(inner_breaks(stretches, breaks)), "id")
    w = Window.partitionBy("id").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(w)
    known = natural.withColumn("gap", gap).withColumn("widest", F.max("gap").over(Window.partitionBy("id")))
    usable = known.withColumn("pos", F.when(F.col("pos") == F.col("s"), F.col("s") + overlap).otherwise(F.col("pos"))).where(
        (F.col("pos") > F.col("s") + overlap) | F.col("gap").isNull()
    )
    ahead = usable.withColumn("next", F.lead("pos").over(w))
    steps = F.when(F.col("next") - F.col("pos") > reach, F.sequence(F.col("pos") + reach, F.col("next") - 1, F.lit(reach))).otherwise(F.array().cast("array<bigint>"))
    return ahead.select(
        "id",
        "s",
        "e",
        "widest",
        F.explode(
            F.concat(
                F.array(F.struct("pos", F.lit(True).alias("natural"), "gap")),
                F.transform(steps, lambda p: F.struct(p.alias("pos"), F.lit(False).alias("natural"), F.lit(None).cast("long").alias("gap"))),
            )
        ).alias("b"),
    ).select("id", "s", "e", "widest", "b.pos", "b.natural", "b.gap")


def successors(places: DataFrame, reach: int) -> DataFrame:
    """(id, pos, succ): the farthest natural boundary in reach, else the forced one; null at the end."""
    w = Window.partitionBy("id").orderBy("pos").rangeBetween(1, reach)
    far = F.coalesce(F.max(F.when(F.col("natural"), F.col("pos"))).over(w), F.max("pos").over(w))
    return places.withColumn("succ", F.when(F.col("pos") < F.col("e"), far))


def _pieces(segments: DataFrame, breaks: DataFrame, limit_km: float, overlap_km: float, **rules) -> DataFrame:
    """Pieces with, of each piece's end, the largest gap between natural points up to there."""
    limit, overlap = int(limit_km * 1000), int(overlap_km * 1000)
    reach = limit - overlap
    if overlap < 0 or reach <= 0:
        raise ValueError("the overlap must be shorter than the limit")
    stretches = long_stretches(segments, limit_km, **rules)
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    places = boundaries(stretches, breaks, limit_km, overlap_km).withColumn("gap_so_far", F.max("gap").over(so_far))
    nodes = cut(successors(places, reach))
    jump = nodes.where("succ is not null").select("id", "pos", "succ")
    start = nodes.where(F.col("pos") == F.col("s") + overlap).select("id", "pos")
    # two cuts advance by more than the reach, which bounds the steps of a walk
    longest = nodes.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 0
    rounds = max(1, math.ceil(math.log2(2 * (longest / reach + 1) + 2)))
    reached = start
    for k in range(rounds):
        on = reached.join(jump, ["id", "pos"]).select("id", F.col("succ").alias("pos"))
        reached = cut(reached.unionByName(on))
        if k + 1 < rounds:
            second = jump.select("id", F.col("pos").alias("succ"), F.col("succ").alias("succ2"))
            jump = cut(jump.join(second, ["id", "succ"]).select("id", "pos", F.col("succ2").alias("succ")))
            if jump.isEmpty():
                break
    w = Window.partitionBy("id").orderBy("pos")
    cuts = reached.join(nodes, ["id", "pos"])
    return (
        cuts.withColumn("prev", F.lag("pos").over(w))
        .withColumn("piece_no", F.row_number().over(w) - 2)
        .where("prev is not null")
        .select(
            F.col("id").cast("long").alias("segment_id"),
            F.col("piece_no").cast("int").alias("piece_no"),
            ((F.col("prev") - overlap) / 1000.0).alias("start_km"),
            (F.col("pos") / 1000.0).alias("end_km"),
            F.when(F.col("pos") == F.col("e"), "end").when(F.col("natural"), "boundary").otherwise("forced").alias("cut_kind"),
            (F.col("widest") / 1000.0).alias("widest_gap_km"),
            "gap_so_far",
        )
    )


def split_stretches(segments: DataFrame, breaks: DataFrame, limit_km: float = 500.0, overlap_km: float = 50.0, **rules) -> DataFrame:
    """(segment_id, piece_no, start_km, end_km, cut_kind, widest_gap_km): all pieces of all long
    stretches; cut_kind says how the piece ends: boundary, forced or end."""
    return _pieces(segments, breaks, limit_km, overlap_km, **rules).drop("gap_so_far")


def cut_kinds(segments: DataFrame, breaks: DataFrame, limit_km: float = 500.0, overlap_km: float = 50.0, **rules) -> DataFrame:
    """(segment_id, cut_kind), one row per stretch that was split: 'forced' where the pieces hold a
    forced cut, else 'boundary'.

    A gap wider than limit - overlap forces a cut wherever the walk meets it, but for one case that
    counts as forced all the same: it lies within the first piece, which has no overlap before it.
    """
    early = (F.col("piece_no") == 0) & (F.coalesce("gap_so_far", F.lit(0)) > int((limit_km - overlap_km) * 1000))
    pieces = _pieces(segments, breaks, limit_km, overlap_km, **rules)
    return pieces.groupBy("segment_id").agg(F.when(F.max((F.col("cut_kind") == "forced") | early), "forced").otherwise("boundary").alias("cut_kind"))
