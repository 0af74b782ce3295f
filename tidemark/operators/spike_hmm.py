"""Problem 2: implausible readings in series of measurements.

A series is one pixel column of one granule in order of line.  Each series is judged against its
own behaviour: a hidden Markov model with the states normal, spike, stuck and out-of-range runs
over it, its emissions scaled by the scatter of that very series; forward-backward gives the
probability of each state at each reading.  Hard bounds (physical range, length of equal runs,
width of a spike) then confirm or reject what the model proposes.

Physical plan: repeats are found by id and only they are shuffled for it; one more shuffle brings the
series together, sorted; ``mapInArrow`` then walks whole partitions, with many series side by side
in one numpy matrix, so Python costs a few vector operations per line and not per series.  A series
of more than ``BLOCK`` readings is cut into blocks of lines that are worked on apart (``_long_series``)
with the same result: blocks hand each other the readings beside their edges, the scatter is that of
the whole series, and the messages of forward-backward pass from block to block as products of
transition matrices.

Defined cases: null and NaN readings are missing and never cases; null keys (granule, pixel_no,
line_no, obs_id) drop the reading from the series but not from the quality check; infinite readings
are out of range; repeated rows count once; short series are judged like long ones (a series of one or two
readings has no level to be off); empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.repeats import split_repeats
from tidemark.operators.spectral_stats import percentiles
from tidemark.session import cut

BLOCK = 65_536
RANGE_M = 20.0
STUCK_RUN = 8
SPIKE_WIDTH = 3
SPIKE_SCATTERS = 7.0
LEVEL_HALF_WIDTH = 5

NORMAL, SPIKE, STUCK, OUT = range(4)
STATES = ("normal", "spike", "stuck", "out_of_range")
# Chance of leaving each state per reading; spikes last up to three lines, stuck runs eight or more.
_TRANSITION = np.array(
    [
        [0.9970, 0.0010, 0.0010, 0.0010],
        [0.6000, 0.3980, 0.0010, 0.0010],
        [0.0400, 0.0010, 0.9580, 0.0010],
        [0.6000, 0.0010, 0.0010, 0.3980],
    ]
)
_START = np.array([0.990, 0.004, 0.003, 0.003])


def _pad(x: np.ndarray, start: np.ndarray, length: np.ndarray, fill: float) -> np.ndarray:
    """Rows of the flat array as a matrix, one series a row."""
    width = int(length.max())
    at = np.arange(width)
    out = np.full((len(start), width), fill)
    inside = at < length[:, None]
    out[inside] = x[(start[:, None] + at)[inside]]
    return out


def _off_level(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distance of the first ``n`` readings of each row from their local level, the median of
    2 * LEVEL_HALF_WIDTH + 1 readings around.

    Near an end the window either stops at the end whole, so that three spikes there cannot become
    the level, or is cut short, so that a slope there is no spike; the smaller distance counts.  A
    row shorter than the window has one level, its median.
    """
    k = LEVEL_HALF_WIDTH
    w = 2 * k + 1
    out = np.repeat(np.nan_to_num(_row_median(m))[:, None], m.shape[1], axis=1)
    if m.shape[1] < w:
        return np.abs(m - out)
    windows = np.lib.stride_tricks.sliding_window_view(m, w, axis=1)
    step = max(1, 2_000_000 // max(1, m.shape[1] * w))
    for i in range(0, len(m), step):
        mid = np.partition(windows[i : i + step], k, axis=2)[..., k]  # NaN sorts last
        rows = n[i : i + step]
        at = np.minimum(np.maximum(np.arange(m.shape[1]) - k, 0), np.maximum(rows - w, 0)[:, None])
        full = np.take_along_axis(mid, at, 1)
        out[i : i + step] = np.where((rows >= w)[:, None], full, out[i : i + step])
    off = np.abs(m - out)
    long = np.flatnonzero(n >= w)
    for j in range(k):
        for cols in (np.arange(j + k + 1), n[long, None] - 1 - np.arange(j + k + 1)):
            at = np.full(len(long), j) if cols.ndim == 1 else n[long] - 1 - j
            level = np.median(m[long[:, None], cols], axis=1)
            off[long, at] = np.minimum(off[long, at], np.abs(m[long, at] - level))
    return off


def _row_median(m: np.ndarray) -> np.ndarray:
    s = np.sort(m, axis=1)
    n = (~np.isnan(s)).sum(axis=1)
    lo = s[np.arange(len(s)), np.maximum((n - 1) // 2, 0)]
    hi = s[np.arange(len(s)), np.minimum(n // 2, np.maximum(n - 1, 0))]
    return (lo + hi) / 2


def _posterior(log_emit: np.ndarray, inside: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Scaled forward-backward over all series at once: (series, reading, state) probabilities.

    ``before`` is the forward message of what lies before the first reading, ``after`` the backward one
    of what lies beyond the last; without them the series begins and ends here.
    """
    emit = np.exp(log_emit - log_emit.max(axis=2, keepdims=True))
    emit[~inside] = 1.0
    s, t, k = emit.shape
    forward = np.empty_like(emit)
    f = (_START if before is None else before @ _TRANSITION) * emit[:, 0]
    forward[:, 0] = f / f.sum(axis=1, keepdims=True)
    for i in range(1, t):
        f = (forward[:, i - 1] @ _TRANSITION) * emit[:, i]
        forward[:, i] = f / f.sum(axis=1, keepdims=True)
    b = np.full((s, k), 1.0) if after is None else after
    post = np.empty_like(emit)
    p = forward[:, t - 1] * b
    post[:, t - 1] = p / p.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (emit[:, i + 1] * b) @ _TRANSITION.T
        # a reading past the end of its series carries no news
        b = np.where(inside[:, i + 1, None], b, 1.0)
        b /= b.sum(axis=1, keepdims=True)
        p = forward[:, i] * b
        post[:, i] = p / p.sum(axis=1, keepdims=True)
    return post


def _run_lengths(same_as_before: np.ndarray) -> np.ndarray:
    """Length of the run each element is in; a run begins wherever the mark is False."""
    run = np.cumsum(~same_as_before) - 1
    return np.bincount(run)[run] if len(run) else run


def _emissions(off: np.ndarray, scatter: np.ndarray, run: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each state, distance from the level in scatters)."""
    z = np.nan_to_num(off / np.maximum(np.nan_to_num(scatter), 1e-6))
    wide = 4.0 * SPIKE_SCATTERS
    emit = np.empty((*off.shape, 4))
    # normal: a Gaussian core with a broad shoulder; both end where spikes begin to be likelier
    emit[..., NORMAL] = np.logaddexp(-0.5 * z**2 - 0.92, np.log(2e-3) - 0.5 * (z / 2.2) ** 2 - 0.92 - np.log(2.2))
    emit[..., SPIKE] = -np.log(wide) - np.log1p((z / wide) ** 2) - 1.0 / np.maximum(z / SPIKE_SCATTERS, 1e-3) ** 4
    emit[..., STUCK] = np.where(run >= STUCK_RUN, 8.0, -6.0 - 2.0 * np.maximum(0, STUCK_RUN - run))
    emit[..., OUT] = -40.0
    emit[out] = (-60.0, -60.0, -60.0, 0.0)
    return emit, z


def classify(series: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State of each reading (series ids ascending in runs, readings in line order) and the
    posterior probability of that state."""
    state = np.zeros(len(value), dtype=np.int8)
    prob = np.ones(len(value))
    if not len(value):
        return state, prob
    out = ~(np.abs(value) <= RANGE_M)
    first = np.r_[True, series[1:] != series[:-1]]
    run = _run_lengths(np.r_[False, (series[1:] == series[:-1]) & (value[1:] == value[:-1])])
    stuck = run >= STUCK_RUN
    # level and scatter come from the readings that can be true at all
    usable = np.where(out | stuck, np.nan, value)
    start = np.flatnonzero(first)
    length = np.diff(np.r_[start, len(value)])
    order = np.argsort(length, kind="stable")
    for part in np.array_split(order, max(1, int(length.sum() // 400_000))):
        if not len(part):
            continue
        st, ln = start[part], length[part]
        m = _pad(usable, st, ln, np.nan)
        inside = np.arange(m.shape[1]) < ln[:, None]
        r = _pad(run.astype(float), st, ln, 1.0)
        o = _pad(out.astype(float), st, ln, 0.0) > 0
        # missing and impossible readings are left out of the window, not filled
        packed_at = np.argsort(np.isnan(m), axis=1, kind="stable")
        packed = np.take_along_axis(m, packed_at, 1)
        off = np.empty_like(m)
        np.put_along_axis(off, packed_at, _off_level(packed, (~np.isnan(packed)).sum(axis=1)), 1)
        emit, z = _emissions(off, 1.4826 * _row_median(off)[:, None], r, o)
        post = _posterior(emit, inside)
        best = post.argmax(axis=2)
        p = np.take_along_axis(post, best[..., None], 2)[..., 0]
        spike = (post[..., SPIKE] > 0.5) & (z > SPIKE_SCATTERS)
        at = (st[:, None] + np.arange(m.shape[1]))[inside]
        state[at] = np.where(spike, SPIKE, np.where(best == SPIKE, NORMAL, best))[inside]
        prob[at] = p[inside]
    # hard bounds: what the model calls stuck or out of range must be so, and all of it
    state = np.where(out, OUT, np.where(stuck, STUCK, np.where(state == SPIKE, SPIKE, NORMAL))).astype(np.int8)
    width = _run_lengths(np.r_[False, (series[1:] == series[:-1]) & (state[1:] == SPIKE) & (state[:-1] == SPIKE)])
    state[(state == SPIKE) & (width > SPIKE_WIDTH)] = NORMAL
    return state, prob


def _flag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None

    def judged(t: pa.Table) -> pa.RecordBatch:
        new = np.zeros(t.num_rows, dtype=bool)
        if t.num_rows:
            new[0] = True
            for name in ("granule", "pixel_no"):
                c = t.column(name).combine_chunks()
                if isinstance(c, pa.ChunkedArray):
                    c = pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
                new[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]))
        state, prob = classify(np.cumsum(new), t.column("value").to_numpy())
        hit = np.flatnonzero(state != NORMAL)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(t.column("obs_id").to_numpy()[hit], pa.int64()),
                pa.array([STATES[s] for s in state[hit]], pa.string()),
                pa.array(prob[hit], pa.float64()),
            ],
            names=["obs_id", "state", "probability"],
        )

    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < 100_000:
            continue
        held = held.combine_chunks()
        last = [held.column(c)[held.num_rows - 1].as_py() for c in ("granule", "pixel_no")]
        tail = np.ones(held.num_rows, dtype=bool)
        for c, v in zip(("granule", "pixel_no"), last):
            tail &= np.asarray(pc.equal(held.column(c), v))
        n = held.num_rows - int(tail.sum())
        if n:
            yield judged(held.slice(0, n).combine_chunks())
            held = held.slice(n)
    if held is not None and held.num_rows:
        yield judged(held.combine_chunks())


# --- series too long for one task -----------------------------------------------------------------

_KEYS = ["granule", "pixel_no"]
_READING = "granule string, pixel_no int, block long, line_no long, obs_id long, value double"


def _beside(blocks: DataFrame, n: int, name: str) -> DataFrame:
    """(keys, block, before, after): the last ``n`` values of ``name`` in earlier blocks and the first in
    later ones, in order. ``blocks`` has head and tail, up to ``n`` values of each block that has any."""
    w = Window.partitionBy(*_KEYS).orderBy("block")
    tails, heads = (F.flatten(F.collect_list(c).over(w.rowsBetween(*r))) for c, r in (("tail", (-n, -1)), ("head", (1, n))))
    x = blocks.withColumn("before", tails).withColumn("after", heads)
    size = F.least(F.size("before"), F.lit(n))
    return x.select(*_KEYS, "block", F.slice("before", F.size("before") - size + 1, size).alias("before"), F.slice("after", 1, n).alias("after"))


def _edges(rows: DataFrame, n: int, value: str) -> DataFrame:
    """(keys, block, head, tail) of the blocks that hold any ``value``."""
    g = rows.where(F.col(value).isNotNull()).withColumn("_v", F.struct("line_no", "obs_id", F.col(value).cast("double").alias("v")))
    up, down = (F.row_number().over(Window.partitionBy(*_KEYS, "block").orderBy(*o)) for o in (("line_no", "obs_id"), (F.desc("line_no"), F.desc("obs_id"))))
    g = g.withColumn("_up", up).withColumn("_down", down).where((F.col("_up") <= n) | (F.col("_down") <= n))
    ends = [F.sort_array(F.collect_list(F.when(F.col(c) <= n, F.col("_v")))).getField("v").alias(name) for c, name in (("_up", "head"), ("_down", "tail"))]
    return g.groupBy(*_KEYS, "block").agg(*ends)


def _per_block(rows: DataFrame, context: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of each block's readings in order and its row of the context (None if it has none)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        left = left.astype({"granule": object}).sort_values(["line_no", "obs_id"], kind="stable")
        return f(left, right.iloc[0] if len(right) else None)

    keys = [*_KEYS, "block"]
    context = context.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in context.columns if c not in keys])
    return rows.groupBy(*keys).cogroup(context.groupBy(*[f"_{k}" for k in keys])).applyInPandas(run, schema)


def _list(context, name: str) -> np.ndarray:
    return np.empty(0) if context is None or context[name] is None else np.asarray(context[name], dtype=float)


def _mark_runs(rows: pd.DataFrame, context) -> pd.DataFrame:
    before, after = _list(context, "before"), _list(context, "after")
    v = np.r_[before, rows["value"].to_numpy(), after]
    run = _run_lengths(np.r_[False, v[1:] == v[:-1]])[len(before) : len(before) + len(rows)]
    out = ~(np.abs(rows["value"].to_numpy()) <= RANGE_M)
    return rows.assign(run=run.astype(float), out=out, usable=np.where(out | (run >= STUCK_RUN), np.nan, rows["value"]))


def _mark_level(rows: pd.DataFrame, context) -> pd.DataFrame:
    before, after = _list(context, "before"), _list(context, "after")
    v = rows["usable"].to_numpy(dtype=float)
    good = ~np.isnan(v)
    off = np.full(len(v), np.nan)
    if good.any():
        packed = np.r_[before, v[good], after][None]
        off[good] = _off_level(packed, np.array([packed.shape[1]]))[0, len(before) : len(before) + good.sum()]
    return rows.drop(columns="usable").assign(off=off)


def _block_emissions(rows: pd.DataFrame, scatter: float) -> tuple[np.ndarray, np.ndarray]:
    return _emissions(rows["off"].to_numpy(dtype=float), np.array(scatter, dtype=float), rows["run"].to_numpy(), rows["out"].to_numpy())


def _transfer(rows: pd.DataFrame, context) -> pd.DataFrame:
    """Product of the steps of a block, and of those of a series that begins with it."""
    emit, _ = _block_emissions(rows, context["scatter"])
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    m, v = _TRANSITION * e[0], _START * e[0]
    for x in e[1:]:
        m, v = (m @ _TRANSITION) * x, (v @ _TRANSITION) * x
        m, v = m / m.sum(), v / v.sum()
    head = rows.iloc[:1][[*_KEYS, "block"]]
    return head.assign(m=[m.ravel().tolist()], v=[v.tolist()])


def _messages(blocks: pd.DataFrame) -> pd.DataFrame:
    """Messages into every block of a series, from products that stand for up to BLOCK lines each."""
    blocks = blocks.astype({"granule": object}).sort_values("block")
    m = [np.asarray(x, dtype=float).reshape(4, 4) for x in blocks["m"]]
    before, f = [], None
    for i, x in enumerate(m):
        before.append(None if f is None else f.tolist())
        f = np.asarray(blocks["v"].iloc[0], dtype=float) if f is None else f @ x
        f = f / f.sum()
    after, b = [], np.ones(4)
    for x in m[::-1]:
        after.append(b.tolist())
        b = x @ b
        b = b / b.sum()
    return blocks[[*_KEYS, "block"]].assign(before=before, after=after[::-1])


def _mark_states(rows: pd.DataFrame, context) -> pd.DataFrame:
    emit, z = _block_emissions(rows, context["scatter"])
    inside = np.ones((1, len(rows)), dtype=bool)
    before, after = (None if context[c] is None else np.asarray(context[c], dtype=float)[None] for c in ("before", "after"))
    post = _posterior(emit[None], inside, before, after)[0]
    spike = (post[:, SPIKE] > 0.5) & (z > SPIKE_SCATTERS)
    stuck, out = rows["run"].to_numpy() >= STUCK_RUN, rows["out"].to_numpy()
    state = np.where(out, OUT, np.where(stuck, STUCK, np.where(spike, SPIKE, NORMAL)))
    return rows[[*_KEYS, "block", "line_no", "obs_id"]].assign(state=state.astype(float), probability=post.max(axis=1))


def _narrow_spikes(rows: pd.DataFrame, context) -> pd.DataFrame:
    before, after = _list(context, "before"), _list(context, "after")
    s = np.r_[before, rows["state"].to_numpy(), after]
    width = _run_lengths(np.r_[False, (s[1:] == SPIKE) & (s[:-1] == SPIKE)])
    s = np.where((s == SPIKE) & (width > SPIKE_WIDTH), NORMAL, s)[len(before) : len(before) + len(rows)].astype(int)
    hit = s != NORMAL
    names = np.array(STATES, dtype=object)[s[hit]]
    return pd.DataFrame({"obs_id": rows["obs_id"].to_numpy()[hit], "state": pd.Series(names, dtype=object), "probability": rows["probability"].to_numpy()[hit]})


def _long_series(rows: DataFrame, block: int) -> DataFrame:
    """(obs_id, state, probability) as ``classify`` gives them, series by series, in blocks of lines.

    What passes between blocks is, per block, a few readings at its edges and one matrix of 4 x 4.
    """
    rows = rows.withColumn("block", F.floor(F.col("line_no") / block)).select(*[c.split()[0] for c in _READING.split(", ")])
    k = 2 * LEVEL_HALF_WIDTH
    runs = cut(_per_block(rows, _beside(_edges(rows, STUCK_RUN - 1, "value"), STUCK_RUN - 1, "value"), _mark_runs, _READING + ", run double, out boolean, usable double"))
    runs = runs.withColumn("usable", F.when(~F.isnan("usable"), F.col("usable")))
    level = cut(_per_block(runs, _beside(_edges(runs, k, "usable"), k, "usable"), _mark_level, _READING + ", run double, out boolean, off double"))
    scatter = percentiles(level, _KEYS, [0.5], "off").select(*_KEYS, (1.4826 * F.col("value")).alias("scatter"))
    blocks = level.select(*_KEYS, "block").distinct().join(scatter, _KEYS, "left").withColumn("scatter", F.coalesce("scatter", F.lit(0.0)))
    blocks = cut(blocks)
    steps = _per_block(level, blocks, _transfer, "granule string, pixel_no int, block long, m array<double>, v array<double>")
    messages = steps.groupBy(*_KEYS).applyInPandas(_messages, "granule string, pixel_no int, block long, before array<double>, after array<double>")
    states = cut(_per_block(level, blocks.join(messages, [*_KEYS, "block"]), _mark_states, "granule string, pixel_no int, block long, line_no long, obs_id long, state double, probability double"))
    edges = _beside(_edges(states, SPIKE_WIDTH + 1, "state"), SPIKE_WIDTH + 1, "state")
    return _per_block(states, edges, _narrow_spikes, "obs_id long, state string, probability double")


def flag_readings(pixels: DataFrame, value: str = "ssha_karin_2", block: int | None = None) -> DataFrame:
    """(obs_id, state, probability): the readings of ``value`` that cannot be true.

    state is spike, stuck or out_of_range; probability is the posterior of the model's own choice.
    Series of more than ``block`` readings (BLOCK by default) are worked on in blocks, the result is the same.
    """
    block = block or BLOCK
    x = F.col(value).cast("double")
    rows = (
        pixels.select("obs_id", "granule", F.col("pixel_no").cast("int").alias("pixel_no"), F.col("line_no").cast("long").alias("line_no"), x.alias("value"))
        .where("obs_id is not null and granule is not null and pixel_no is not null and line_no is not null")
        .where("value is not null and not isnan(value)")
    )
    once, again = split_repeats(rows, "obs_id")
    rows = once.unionByName(again.dropDuplicates(["obs_id"]))
    # series that are long by their rows, repeats among them: at most one in ``block`` rows
    long = cut(pixels.groupBy("granule", F.col("pixel_no").cast("int").alias("pixel_no")).agg(F.count(value).alias("n")).where(F.col("n") > block).select(*_KEYS))
    any_long = not long.isEmpty()
    short = rows.join(long, _KEYS, "left_anti") if any_long else rows
    sorted_ = short.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "line_no", "obs_id").select("obs_id", *_KEYS, "value")
    found = sorted_.mapInArrow(_flag_batches, "obs_id long, state string, probability double")
    return found.unionByName(_long_series(rows.join(long, _KEYS, "left_semi"), block)) if any_long else found


def invalid_flags(pixels: DataFrame, flags: DataFrame, field: str = "ssha_karin_2_qual") -> DataFrame:
    """(obs_id): non-null flag words that are no sum of distinct known bits.

    The known bits come down to one number by aggregation; it is joined as a one-row table.
    """
    known = flags.where("bit_value is not null").agg(
        F.coalesce(F.expr("bit_or(cast(bit_value as bigint))"), F.lit(0).cast("long")).alias("known_bits")
    )
    word = F.col(field).cast("long")
    return (
        pixels.where(F.col(field).isNotNull() & (word != 0) & F.col("obs_id").isNotNull())
        .select("obs_id", word.alias("word"))
        .join(F.broadcast(known))  # always one row
        .where("word < 0 or (word & ~known_bits) != 0")
        .select("obs_id")
        .distinct()
    )


def implausible(pixels: DataFrame, flags: DataFrame) -> DataFrame:
    """(obs_id, field_name): all implausible readings and flag words."""

    def named(df: DataFrame, name: Column) -> DataFrame:
        return df.select(F.col("obs_id").cast("long").alias("obs_id"), name.alias("field_name"))

    return named(flag_readings(pixels), F.lit("ssha_karin_2")).unionByName(
        named(invalid_flags(pixels, flags), F.lit("ssha_karin_2_qual"))
    )
