"""Problem 3: percentiles of very large numeric columns from mergeable sketches.

A sketch is a stack of relative-rank compactors.  Level i holds values that each stand for 2**i
values.  When a level is full its values are sorted, the protected tail stays, and of the rest
every second value moves up; so the rank error at a quantile is a fraction of the number of values
beyond it in the protected tail.  Two sketches of a group, one per tail, answer the quantiles on
their own side.  Sketches of partitions, days or months merge level by level.

Physical plan: repeated rows are found by their ids and only these collapse in a shuffle, all others
are sketched where they are read; each partition sketches its groups in numpy
over whole Arrow batches (map-side combine); only sketches are shuffled and merged, in two rounds
with salted keys, so no task receives more than about ``FAN_IN`` sketches of a group.  What a task
holds is bounded: it emits and forgets its sketches beyond ``HELD_VALUES`` retained values.

Defined cases: null arrays, null, NaN, infinite and negative values do not count; a repeated row
counts once (the latest); a group without values has no row; null group columns form a group of
their own where the caller lets them; ties are fine; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.repeats import latest
from tidemark.session import cut

SECTION = 128  # values per section; the error is about half of 1 / SECTION of the tail
FAN_IN = 64
HELD_VALUES = 2_000_000
_SKETCH = "key string, tail string, sketch binary"


class TailSketch:
    """Compactors that protect one tail, ``high`` or ``low``."""

    def __init__(self, tail: str, section: int = SECTION):
        self.sign = 1.0 if tail == "high" else -1.0
        self.section = section
        self.n = 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.turns: list[int] = [0]

    @property
    def retained(self) -> int:
        return sum(map(len, self.levels))

    def _capacity(self, level: int) -> int:
        # sections grow with the number of compactions, as the analysis of the compactor needs
        sections = 3 + max(0, self.turns[level].bit_length() - 2)
        return 2 * self.section * sections

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values * self.sign])
        self._shrink()

    def merge(self, other: TailSketch) -> None:
        self.n += other.n
        for i, (items, turns) in enumerate(zip(other.levels, other.turns)):
            if i == len(self.levels):
                self.levels.append(np.empty(0))
                self.turns.append(0)
            self.levels[i] = np.concatenate([self.levels[i], items])
            self.turns[i] |= turns
        self._shrink()

    def _shrink(self) -> None:
        i = 0
        while i < len(self.levels):
            cap = self._capacity(i)
            if len(self.levels[i]) > cap:
                turn = self.turns[i]
                trailing = ((turn ^ (turn + 1)).bit_length()) - 1
                keep = max(cap // 2, cap - (trailing + 1) * self.section)
                items = np.sort(self.levels[i])
                move = (len(items) - keep) & ~1
                if i + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.turns.append(0)
                self.levels[i + 1] = np.concatenate([self.levels[i + 1], items[(turn + i) % 2 : move : 2]])
                self.levels[i] = items[move:]
                self.turns[i] = turn + 1
            i += 1

    def quantiles(self, qs: list[float]) -> list[float]:
        """The value whose rank is the first to reach q * n."""
        x = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(v), 2**i, dtype=np.int64) for i, v in enumerate(self.levels)])
        x = x * self.sign
        order = np.argsort(x, kind="stable")
        x, rank = x[order], np.cumsum(w[order])
        # what compaction left odd keeps the weights' sum equal to n
        at = np.searchsorted(rank, np.maximum(1, np.ceil(np.array(qs) * rank[-1] - 1e-9)))
        return [float(v) + 0.0 for v in x[np.minimum(at, len(x) - 1)]]

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.section, int(self.sign), len(self.levels)] + [v for p in zip(self.turns, map(len, self.levels)) for v in p], dtype=np.int64)
        return head.tobytes() + np.concatenate(self.levels).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> TailSketch:
        n, section, sign, levels = (int(v) for v in np.frombuffer(data, np.int64, 4))
        pairs = np.frombuffer(data, np.int64, 2 * levels, 32).reshape(levels, 2)
        out = cls("high" if sign > 0 else "low", section)
        out.n, out.turns = n, [int(t) for t in pairs[:, 0]]
        items = np.frombuffer(data, np.float64, offset=32 + 16 * levels)
        out.levels = [v.copy() for v in np.split(items, np.cumsum(pairs[:-1, 1]))]
        return out


def _partial(section: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[str, tuple[TailSketch, TailSketch]] = {}
        pending: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def settle() -> None:
            for key, parts in pending.items():
                pair = sketches.get(key) or sketches.setdefault(key, (TailSketch("high", section), TailSketch("low", section)))
                values = np.concatenate(parts)
                for s in pair:
                    s.update(values)
            pending.clear()

        def emit() -> pa.RecordBatch:
            rows = [(k, t, s.to_bytes()) for k, pair in sketches.items() for t, s in zip(("high", "low"), pair)]
            sketches.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())],
                names=["key", "tail", "sketch"],
            )

        for b in batches:
            lists = b.column(b.schema.get_field_index("values"))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.nan_to_num(np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
            keys = b.column(b.schema.get_field_index("key")).dictionary_encode()
            code = np.repeat(keys.indices.to_numpy(), size)
            good = np.isfinite(flat) & (flat >= 0)
            flat, code = flat[good], code[good]
            order = np.argsort(code, kind="stable")
            flat, code = flat[order], code[order]
            edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
            for part, c in zip(np.split(flat, edge[1:]), code[edge]):
                pending.setdefault(keys.dictionary[int(c)].as_py(), []).append(part)
            waiting += len(flat)
            if waiting >= HELD_VALUES:
                settle()
                waiting = 0
                if sum(s.retained for p in sketches.values() for s in p) > HELD_VALUES:
                    yield emit()
        settle()
        if sketches:
            yield emit()

    return run


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for data in group["sketch"]:
        s = TailSketch.from_bytes(data)
        if whole is None:
            whole = s
        else:
            whole.merge(s)
    return pd.DataFrame({"key": group["key"].iloc[:1].values, "tail": group["tail"].iloc[:1].values, "sketch": [whole.to_bytes()]})


def merge_sketches(sketches: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One sketch per (key, tail). Where a shuffle has more than ``fan_in`` partitions, each of which
    may hold a sketch of every key, a round over salted keys comes first."""
    salts = max(1, int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")) // fan_in)
    if salts > 1:
        sketches = (
            sketches.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(salts)))
            .groupBy("key", "tail", "salt")
            .applyInPandas(_merge, _SKETCH)
        )
    return sketches.groupBy("key", "tail").applyInPandas(_merge, _SKETCH)


def build_sketches(df: DataFrame, groups: list[str], values: str, section: int = SECTION) -> DataFrame:
    """(key, tail, sketch) per group of ``groups``; key is the JSON text of the group columns."""
    narrow = df.select(
        F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}).alias("key"), F.col(values).cast("array<double>").alias("values")
    ).where("values is not null")
    return merge_sketches(narrow.mapInArrow(_partial(section), _SKETCH))


def regroup(sketches: DataFrame, schema: str, groups: list[str]) -> DataFrame:
    """Merge sketches to coarser groups without reading any value again."""
    coarse = sketches.withColumn("g", F.from_json("key", schema)).withColumn(
        "key", F.to_json(F.struct(*[F.col(f"g.{c}").alias(c) for c in groups]), {"ignoreNullFields": "false"})
    )
    return merge_sketches(coarse.select("key", "tail", "sketch"))


def read_quantiles(sketches: DataFrame, schema: str, qs: list[float]) -> DataFrame:
    """(group columns, q, value, n): quantiles of each group, each from the sketch of its tail."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, tail, data in zip(b["key"], b["tail"], b["sketch"]):
                s = TailSketch.from_bytes(data)
                mine = [q for q in qs if (q >= 0.5) == (tail == "high")]
                if s.n and mine:
                    rows += [(key, q, v, s.n) for q, v in zip(mine, s.quantiles(mine))]
            yield pd.DataFrame(rows, columns=["key", "q", "value", "n"])

    return (
        sketches.mapInPandas(answer, "key string, q double, value double, n long")
        .withColumn("g", F.from_json("key", schema))
        .select("g.*", "q", "value", "n")
    )


_GROUPS = "swath string, lat_band int, month int"


def spectrum_groups(segments: DataFrame) -> DataFrame:
    """(swath, lat_band, month, psd): each segment once, spellings of swath unified.

    Segments without id, recognisable swath or finite lat_mean belong to no group; a latitude of
    90 degrees belongs to the band of 80; a null month is a group of its own.
    """
    once = segments.select(
        "segment_id", "processed_at", "psd", F.lower(F.trim("swath")).alias("swath"), F.col("lat_mean").cast("double").alias("lat"), F.col("month").cast("int").alias("month")
    ).where("segment_id is not null")
    return latest(once.select("segment_id", "processed_at", "month", "lat", "swath", "psd"), "segment_id", "processed_at").where("swath in ('left', 'right') and lat between -90 and 90").select(
        "swath", F.least(F.floor(F.col("lat") / 10) * 10, F.lit(80)).cast("int").alias("lat_band"), "month", "psd"
    )


def spectrum_percentiles(segments: DataFrame, qs: tuple[float, ...] = (0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """(scope, swath, lat_band, month, q, value, n): scope 'month' for each month, 'all' for all
    months together, the latter merged from the sketches of the months."""
    months = cut(build_sketches(spectrum_groups(segments), ["swath", "lat_band", "month"], "psd"))
    every = regroup(months, _GROUPS, ["swath", "lat_band"])
    by_month = read_quantiles(months, _GROUPS, list(qs)).select(F.lit("month").alias("scope"), "*")
    total = read_quantiles(every, "swath string, lat_band int", list(qs)).select(
        F.lit("all").alias("scope"), "swath", "lat_band", F.lit(None).cast("int").alias("month"), "q", "value", "n"
    )
    return by_month.unionByName(total)
