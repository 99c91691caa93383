"""Ordered streams: sliding windows, faded counters, and detectors with state.

Two shapes of work:

* look-back of a bounded number of rows: the order is cut into blocks and the last rows of
  a block are copied to the next one (``halo_blocks``). Blocks are independent, so a key
  that holds a third of all rows is spread like the rest;
* detectors that reset themselves on an alarm: sequential per key by nature. They run as a
  fold over key-sorted Arrow batches, holding only the detector's state, never the key's
  rows. A key too long for one task is cut into segments that are walked in parallel from
  assumed states and corrected until the states meet.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.columns import literal_array, plain_zero
from driftloom.functions.names import q
from driftloom.functions.stats import rank_sum_z, z_critical
from driftloom.operators import ranks
from driftloom.operators.panes import Setting, pane_tests
from driftloom.operators.ranks import default_buckets, hot_groups, prefixed, ranked, running, same_group
from driftloom.session import settle

BLOCK = 4096


def halo_blocks(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), back: int = 0, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """Cut each group's order into blocks of ``size`` rows, with neighbour rows copied in.

    Adds ``_rn`` (position), ``_block`` and ``_own`` (false on copies).
    """
    size = max(size, back, ahead)
    pos = F.col("_rn") - 1
    block = F.floor(pos / size)
    inside = pos - block * size
    copies = F.array(
        F.struct(block.alias("b"), F.lit(True).alias("own")),
        F.when(inside >= size - back, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))),
        F.when((inside < ahead) & (block > 0), F.struct((block - 1).alias("b"), F.lit(False).alias("own"))),
    )
    r = ranked(df, order, by, "_rn").drop("_rn_total")
    spread = r.withColumn("_c", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    return spread.withColumns({"_block": F.col("_c.b"), "_own": F.col("_c.own")}).drop("_c")


def moving(
    df: DataFrame, order: Sequence[str], exprs: dict[str, Callable[[Window], Column]], by: Sequence[str] = (), back: int = 0, ahead: int = 0, size: int = BLOCK
) -> DataFrame:
    """Row-window expressions over [-back, +ahead] rows of each group's order.

    ``exprs`` maps an output to a function of the window, e.g. ``lambda w: F.avg("x").over(w)``.
    """
    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*[q(c) for c in by]).orderBy(*[q(c) for c in order]).rowsBetween(-back, ahead)
        return rows.withColumns({o: f(w) for o, f in exprs.items()})

    def in_blocks(rows: DataFrame) -> DataFrame:
        blocks = halo_blocks(rows, order, by, back, ahead, size)
        w = Window.partitionBy(*[q(c) for c in by], "_block").orderBy("_rn").rowsBetween(-back, ahead)
        return blocks.withColumns({o: f(w) for o, f in exprs.items()}).where("_own").drop("_rn", "_block", "_own")

    if not by:
        return in_blocks(df)
    hot = hot_groups(df, by)
    if hot is None:
        return plain(df)
    # Hot groups go through blocks, all others through one window per group.
    side = F.broadcast(prefixed(hot, by, "_h_"))
    cold = df.join(side, same_group(by, "_h_"), "left_anti")
    return plain(cold).unionByName(in_blocks(df.join(side, same_group(by, "_h_"), "left_semi")))


def sliding_windows(df: DataFrame, cols: Sequence[str], size: int, cell: str = "CELL", time: str = "DATETIME", tie: Sequence[str] = ()) -> DataFrame:
    """All full windows of ``size`` consecutive rows per cell, step 1.

    One row per window: cell, END_TIME (last row's second), ``win`` as size x features.
    """
    rows = df.select(q(cell), q(time), *[q(c) for c in tie], F.array(*[q(c).cast("double") for c in cols]).alias("_x"))
    full = moving(rows, [time, *tie], {"win": lambda w: F.collect_list("_x").over(w)}, [cell], back=size - 1)
    return full.where(F.size("win") == size).select(q(cell), F.date_trunc("second", q(time)).alias("END_TIME"), "win", *[q(c) for c in tie])


def trailing_mean(df: DataFrame, col: str, order: Sequence[str], by: Sequence[str] = (), n: int = 500, out: str = "trailing_mean") -> DataFrame:
    """Mean over the last ``n`` rows (fewer at the start)."""
    return moving(df, order, {out: lambda w: F.avg(q(col)).over(w)}, by, back=n - 1)


def centred_mean(df: DataFrame, col: str, order: Sequence[str], by: Sequence[str] = (), n: int = 300, out: str = "centred_mean") -> DataFrame:
    """Zero-padded centred moving average: the sum is always divided by ``n``."""
    back = n // 2
    return moving(df, order, {out: lambda w: F.sum(q(col)).over(w) / float(n)}, by, back=back, ahead=n - 1 - back)


# ---------------------------------------------------------------- faded counters


def _carry(blocks: DataFrame, by: list[str], fade: float, chunk: int) -> DataFrame:
    """Counter values at the start of every block.

    Passing a block multiplies a counter by fade^(rows of its class) and adds the block's own
    value. Runs of ``chunk`` blocks are composed first, then the run totals (one row per
    ``chunk`` blocks), then each run is replayed from its true start.
    """
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*by).schema.fields)
    state = ("tp", "fn", "tn", "fp")
    lead = f"{keys}, _run long, _block long, " + ", ".join(f"s_{c} double" for c in state) + ", s_kp double, s_kn double"

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """State before each block and, as block -1, after the run; from a zero start."""
        pdf = pdf.sort_values("_block")
        cur, kp, kn, rows = np.zeros(4), 0.0, 0.0, []
        own = pdf[list(state)].to_numpy(dtype=float)
        for i, (p, n) in enumerate(zip(pdf["kp"], pdf["kn"])):
            rows.append((pdf["_block"].iloc[i], *cur, kp, kn))
            decay = np.array([fade**p, fade**p, fade**n, fade**n])
            cur, kp, kn = decay * cur + own[i], kp + p, kn + n
        rows.append((-1, *cur, kp, kn))
        out = pd.DataFrame(rows, columns=["_block", *[f"s_{c}" for c in state], "s_kp", "s_kn"])
        for c in [*by, "_run"]:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "_run", *[c for c in out.columns if c not in by and c != "_run"]]]

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_run")
        cur, rows = np.zeros(4), []
        own = pdf[[f"s_{c}" for c in state]].to_numpy(dtype=float)
        for i, (p, n) in enumerate(zip(pdf["s_kp"], pdf["s_kn"])):
            rows.append((pdf["_run"].iloc[i], *cur))
            cur = np.array([fade**p, fade**p, fade**n, fade**n]) * cur + own[i]
        out = pd.DataFrame(rows, columns=["_run", *[f"r_{c}" for c in state]])
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "_run", *[f"r_{c}" for c in state]]]

    runs = blocks.withColumn("_run", F.floor(F.col("_block") / chunk))
    inside = runs.groupBy(*by, "_run").applyInPandas(compose, lead)
    ends = inside.where(F.col("_block") == -1)
    starts = ends.groupBy(*by).applyInPandas(replay, f"{keys}, _run long, " + ", ".join(f"r_{c} double" for c in state))
    side = prefixed(starts, [*by, "_run"], "_h_")
    joined = inside.where(F.col("_block") >= 0).join(side, same_group([*by, "_run"], "_h_")).drop(*[f"_h_{c}" for c in [*by, "_run"]])

    def start(c: str, k: str) -> Column:
        return F.col(f"s_{c}") + F.pow(F.lit(fade), F.col(k)) * F.col(f"r_{c}")

    return joined.select(
        *[q(c) for c in by], "_block",
        start("tp", "s_kp").alias("c_tp"), start("fn", "s_kp").alias("c_fn"),
        start("tn", "s_kn").alias("c_tn"), start("fp", "s_kn").alias("c_fp"),
    )


def prequential(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), fade: float = 0.99, label: str = "label", pred: str = "pred", size: int = BLOCK, chunk: int = BLOCK,
    before: DataFrame | None = None, counters: bool = False,
) -> DataFrame:
    """Faded recall, specificity and G-mean after every row.

    A positive row fades TP and FN and adds itself to one of them, a negative row does so
    with TN and FP. Inside a block the counters are prefix sums weighted by fade^-k; the
    blocks are then linked by ``_carry``.

    ``before`` gives the counters with which groups start (``by``, ``tp``, ``fn``, ``tn``, ``fp``; a group has one row at
    most); with ``counters`` those after every row are columns too.
    """
    keys = list(by) or ["_all"]
    first = 0 if before is None else 1  # block 0 is then what was there before
    base = df if by else df.withColumn("_all", F.lit(0))
    if fade < 1:
        size = max(1, min(size, int(600 / -math.log(fade))))
    y = F.coalesce((q(label) == 1).cast("int"), F.lit(0))
    p = F.coalesce((q(pred) == 1).cast("int"), F.lit(0))
    rows = ranked(base, order, list(by), "_rn").drop("_rn_total")
    rows = rows.withColumns({"_block": F.floor((F.col("_rn") - 1) / size) + first, "_y": y, "_p": p})
    w = Window.partitionBy(*[q(c) for c in keys], "_block").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_kp": F.sum("_y").over(w), "_kn": F.sum(1 - F.col("_y")).over(w)})

    def local(cls: int, hit: int) -> Column:
        k = F.col("_kp" if cls else "_kn")
        mine = (F.col("_y") == cls) & (F.col("_p") == hit)
        grown = F.sum(F.when(mine, F.pow(F.lit(fade), -k)).otherwise(0.0)).over(w)
        return F.pow(F.lit(fade), k) * grown

    rows = rows.withColumns({"_tp": local(1, 1), "_fn": local(1, 0), "_tn": local(0, 0), "_fp": local(0, 1)})
    last = F.col("_rn")
    blocks = rows.groupBy(*[q(c) for c in keys], "_block").agg(
        F.max("_kp").cast("double").alias("kp"), F.max("_kn").cast("double").alias("kn"),
        *[F.max_by(f"_{c}", last).alias(c) for c in ("tp", "fn", "tn", "fp")],
    )
    if before is not None:
        earlier = before if by else before.withColumn("_all", F.lit(0))
        nothing = [F.lit(0).cast("long").alias("_block"), F.lit(0.0).alias("kp"), F.lit(0.0).alias("kn")]
        blocks = blocks.unionByName(earlier.select(*[q(c) for c in keys], *nothing, "tp", "fn", "tn", "fp"))
    if by:
        # A group of one block starts from zero; only longer ones need their blocks linked.
        linked = blocks.where(F.col("_block").isin(0, 2) if first else F.col("_block") == 1)
        longer = linked.select(*[q(c).alias(f"_h_{c}") for c in keys])
        blocks = blocks.join(longer, same_group(keys, "_h_"), "left_semi")
    start = _carry(blocks, keys, fade, chunk)
    side = prefixed(start, [*keys, "_block"], "_h_")
    joined = rows.join(side, same_group([*keys, "_block"], "_h_"), "left").drop(*[f"_h_{c}" for c in [*keys, "_block"]])

    def total(c: str, k: str) -> Column:
        return F.col(f"_{c}") + F.pow(F.lit(fade), F.col(k)) * F.coalesce(F.col(f"c_{c}"), F.lit(0.0))

    tp, fn, tn, fp = total("tp", "_kp"), total("fn", "_kp"), total("tn", "_kn"), total("fp", "_kn")
    recall, spec = tp / (tp + fn + 1e-9), tn / (tn + fp + 1e-9)
    out = joined.withColumns({"recall": recall, "specificity": spec, "gmean": F.sqrt(recall * spec)})
    if counters:
        out = out.withColumns({"tp": tp, "fn": fn, "tn": tn, "fp": fp})
    extra = [c for c in out.columns if c.startswith(("_", "c_tp", "c_fn", "c_tn", "c_fp")) and c not in df.columns]
    return out.drop(*extra)


def _windowed_auc(score: np.ndarray, y: np.ndarray, n: int, first: int) -> np.ndarray:
    """Tie-aware AUC of the last ``n`` rows for every row from ``first`` on; 0.5 for one class.

    Won pairs are kept up to date: a row entering or leaving adds or removes its wins against
    the other class, found by binary search in the two sorted score lists.
    """
    lists: tuple[list, list] = ([], [])
    wins, out = 0.0, np.full(len(score), 0.5)

    def pairs_of(s: float, cls: int) -> float:
        other = lists[1 - cls]
        lo, hi = bisect_left(other, s), bisect_right(other, s)
        below, ties = lo, hi - lo
        return below + 0.5 * ties if cls == 1 else len(other) - hi + 0.5 * ties

    for i, (s, cls) in enumerate(zip(score.tolist(), y.tolist())):
        if i >= n:
            old, old_cls = float(score[i - n]), int(y[i - n])
            mine = lists[old_cls]
            del mine[bisect_left(mine, old)]
            wins -= pairs_of(old, old_cls)
        wins += pairs_of(s, cls)
        insort(lists[cls], s)
        if i >= first and lists[0] and lists[1]:
            out[i] = wins / (len(lists[0]) * len(lists[1]))
    return out


def prequential_auc(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), n: int = 1000, score: str = "score", label: str = "label", size: int = 4 * BLOCK, out: str = "pauc") -> DataFrame:
    """AUC over the last ``n`` rows after every row; each block brings its own look-back.

    A missing score ranks below all others.
    """
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    blocks = halo_blocks(base, order, keys if by else [], back=n - 1, size=size)
    schema = df.select("*").schema.add(out, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn", kind="stable")
        own = pdf["_own"].to_numpy()
        first = int(np.argmax(own)) if own.any() else len(pdf)
        y = (pdf[label].to_numpy() == 1).astype(int)
        values = pdf[score].to_numpy(dtype=float)
        pdf[out] = _windowed_auc(np.where(np.isnan(values), -np.inf, values), y, n, first)
        return pdf[own][schema.names]

    return blocks.groupBy(*[q(c) for c in keys], "_block").applyInPandas(run, schema)


# ---------------------------------------------------------------- detectors without reset


def against_reference(df: DataFrame, value: str, ref: Sequence[float], le: str = "_le", lt: str = "_lt") -> DataFrame:
    """How many reference values are <= and < the row's value.

    ``ref`` is a sample of bounded size. Its distinct values are the split points of a
    bucketizer (a binary search in the JVM), the counts are looked up by bucket.
    """
    values, counts = np.unique(np.asarray(ref, dtype=float) + 0.0, return_counts=True)
    upto = literal_array([0, *np.cumsum(counts).tolist()], "long")
    at = literal_array([values[0] - 1.0, *values.tolist()])
    splits = [-math.inf, *values.tolist(), math.inf]
    cut = Bucketizer(splits=splits, inputCol="_val", outputCol="_pos", handleInvalid="keep").transform(
        df.withColumn("_val", plain_zero(q(value).cast("double")))
    )
    pos = F.col("_pos").cast("int")
    same = (pos > 0) & (F.get(at, pos) == F.col("_val"))
    counted = cut.withColumns({le: F.get(upto, pos), lt: F.when(same, F.get(upto, pos - 1)).otherwise(F.get(upto, pos))})
    return counted.drop("_val", "_pos")


def rolling_mann_whitney(
    df: DataFrame, order: Sequence[str], ref: Sequence[float], by: Sequence[str] = (), score: str = "score", p_warn: float = 0.01, p_alarm: float = 0.001
) -> DataFrame:
    """Mann-Whitney test of the last len(ref) rows against a fixed reference, at every row.

    The reference does not move, so U is a moving sum of each row's own placement in it. Adds
    u, z and verdict; null and 'normal' until the window is full.
    """
    w_len = len(ref)
    if not w_len:
        raise ValueError("the reference window is empty")
    # A row's placement: reference values below it, ties half.
    placed = against_reference(df, score, ref).withColumn("_pl", (F.col("_le") + F.col("_lt")) / 2.0).drop("_le", "_lt")
    full = moving(
        placed, order, {"_s": lambda w: F.sum("_pl").over(w), "_n": lambda w: F.count("_pl").over(w)}, by, back=w_len - 1
    )
    pairs = float(w_len * w_len)
    u = F.when(F.col("_n") == w_len, F.least(F.col("_s"), pairs - F.col("_s")))
    out = full.withColumn("u", u).withColumn("z", rank_sum_z(F.col("u"), F.lit(w_len), F.lit(w_len)))
    verdict = F.when(F.col("z") < z_critical(p_alarm), "alarm").when(F.col("z") < z_critical(p_warn), "warn").otherwise("normal")
    return out.withColumn("verdict", verdict).drop("_pl", "_s", "_n")


def positions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``_rn`` and ``_rn_total``; a frame that has them already is taken as it is."""
    return df if "_rn" in df.columns else ranked(df, order, out="_rn")


def rolling_ks(
    df: DataFrame, order: Sequence[str], ref: Sequence[float], window: int = 400, every: int = 120, score: str = "score"
) -> DataFrame:
    """KS statistic of the last ``window`` rows against a reference sample, every ``every`` rows.

    Row i (from 0) is a checkpoint when i is a multiple of ``every`` and the window is full. Returns
    checkpoint, row, ks, mean, std (population). A missing score is below all others, and not in mean and std.
    """
    setting = Setting((1.0,), window, every, tuple(float(v) for v in ref))
    tests = pane_tests(positions(df, order).select("_rn", q(score)), [score], {0: setting})
    return tests.drop("trial").withColumn("row", F.col("checkpoint") * every)


# ---------------------------------------------------------------- detectors with reset


State = TypeVar("State")


def _walk(
    frames: Iterator[pd.DataFrame], group: list[str], begin: Callable[[pd.DataFrame], State]
) -> Iterator[tuple[State, pd.DataFrame]]:
    """The state and the next rows, for every piece of every group of a sorted partition."""
    current, state = None, None
    for pdf in frames:
        for k, rows in pdf.groupby(group, sort=False, dropna=False):
            # A null key comes as NaN, which is not equal to itself.
            if current is None or not all(a == b or (a != a and b != b) for a, b in zip(k, current)):
                current, state = k, begin(rows)
            yield state, rows


def keyed_fold(
    df: DataFrame, key: Sequence[str], order: Sequence[str], start: Callable[[int], State], step: Callable[[State, pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Walk every key's rows in order, carrying a state object between Arrow batches.

    ``start(i)`` is the state in front of a key's row number i (from 0) if nothing is known of
    the rows before it; ``step(state, rows)`` returns output rows and changes the state. Rows
    of a key are never gathered: a task streams its sorted partition and holds one state at a
    time. Keys with more rows than a task's share go through ``_segmented``.
    """
    key = list(key)

    def whole(rows: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for state, part in _walk(frames, key, lambda _: start(0)):
                yield step(state, part)

        lined = rows.repartition(*[q(c) for c in key]).sortWithinPartitions(*[q(c) for c in key], *[q(c) for c in order])
        return lined.mapInPandas(run, schema)

    rows = settle(df)  # counted and walked
    hot = hot_groups(rows, key)
    if hot is None:
        return whole(rows)
    side = F.broadcast(prefixed(hot, key, "_h_"))
    cold, big = (rows.join(side, same_group(key, "_h_"), how) for how in ("left_anti", "left_semi"))
    return whole(cold).unionByName(_segmented(big, key, order, start, step, schema, ranks.HOT_ROWS))


def _segmented(
    df: DataFrame, key: list[str], order: Sequence[str], start: Callable[[int], State], step: Callable[[State, pd.DataFrame], pd.DataFrame], schema: str, size: int
) -> DataFrame:
    """The fold over long keys, cut into segments of ``size`` rows; exact.

    All segments are walked at once, each from ``start``. Then every segment is compared with
    the state its predecessor ended in, and walked again from there if it began differently,
    until nothing differs. Segment i is settled after i rounds at the latest, so this ends;
    detectors that forget (they reset, or look back a bounded number of rows) agree after a
    few rounds. What never forgets is walked segment after segment: no faster than one task,
    but no task ever sees more than a segment, and a lost one costs a segment.
    """
    group = [*key, "_seg"]
    seg, before = F.col("_seg"), F.col("_before")
    cut = ranked(df, order, key, "_rn").drop("_rn_total").withColumn("_seg", F.floor((F.col("_rn") - 1) / size))
    cut = settle(cut, ["_seg"])  # a folder per segment number: a round reads only what it walks again
    opens = F.col("_rn") == seg * size + 1
    kinds = dict(cut.dtypes)
    ends_schema = ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", _before binary, _after binary"

    def begin(rows: pd.DataFrame) -> State:
        held = rows["_before"].iloc[0]
        return start(int(rows["_rn"].iloc[0]) - 1) if held is None else pickle.loads(held)

    def outputs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for state, rows in _walk(frames, group, begin):
            yield step(state, rows)

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, held = None, None
        for state, rows in _walk(frames, group, begin):
            if state is not held:
                if held is not None:
                    yield head.assign(_after=[pickle.dumps(held)])
                head, held = rows[[*group, "_before"]].iloc[:1], state
            step(state, rows)
        if held is not None:
            yield head.assign(_after=[pickle.dumps(held)])

    def fed(rows: DataFrame, seeds: DataFrame) -> DataFrame:
        """Rows of the listed segments; the first row of each brings the state to start from."""
        firsts = rows.where(opens).join(prefixed(seeds.select(*[q(c) for c in group], "_before"), group, "_h_"), same_group(group, "_h_"))
        # One short row per segment; there are about as many segments as tasks.
        listed = F.broadcast(prefixed(seeds.select(*[q(c) for c in group]), group, "_h_"))
        others = rows.where(~opens).join(listed, same_group(group, "_h_"), "left_semi").withColumn("_before", F.lit(None).cast("binary"))
        both = firsts.drop(*[f"_h_{c}" for c in group]).unionByName(others)
        return both.repartition(*[q(c) for c in group]).sortWithinPartitions(*[q(c) for c in group], "_rn")

    seeds = cut.where(opens).select(*[q(c) for c in group], F.lit(None).cast("binary").alias("_before"))
    table = settle(fed(cut, seeds).mapInPandas(ends, ends_schema))
    while True:
        given = table.select(*[q(c) for c in key], (seg + 1).alias("_seg"), F.col("_after").alias("_given"))
        linked = table.join(prefixed(given, group, "_h_"), same_group(group, "_h_"))
        stale = linked.where(~before.eqNullSafe(F.col("_given"))).select(*[q(c) for c in group], F.col("_given").alias("_before"))
        stale = settle(stale)
        numbers = [r[0] for r in stale.select("_seg").distinct().collect()]
        if not numbers:
            return fed(cut, table).mapInPandas(outputs, schema)
        redone = fed(cut.where(seg.isin(numbers)), stale).mapInPandas(ends, ends_schema)
        listed = F.broadcast(prefixed(stale.select(*[q(c) for c in group]), group, "_h_"))
        table = settle(table.join(listed, same_group(group, "_h_"), "left_anti").unionByName(redone))


class Adwin:
    """Adaptive window over a stream of block sums (Bifet and Gavalda, SDM 2007).

    Buckets hold (rows, sum, sum of squares) and double in size, at most ``per_level`` of a
    size; the window is cut where two parts differ by more than the bound
    sqrt(2/m * var * ln(2/d')) + 2/(3m) * ln(2/d'), d' = delta / ln(n), 1/m = 1/n0 + 1/n1.
    """

    def __init__(self, delta: float = 0.002, per_level: int = 5, min_side: int = 5, grace: int = 10):
        self.delta, self.per_level, self.min_side, self.grace = delta, per_level, min_side, grace
        self.buckets: list[tuple[int, float, float, float]] = []  # oldest first: level, n, s, ss

    def update(self, n: float, s: float, ss: float) -> bool:
        """Add one block; True when old buckets had to go."""
        self.buckets.append((0, n, s, ss))
        self._merge()
        found = False
        while self._cut():
            found = True
        return found

    def _merge(self) -> None:
        level = 0
        while True:
            at = [i for i, b in enumerate(self.buckets) if b[0] == level]
            if len(at) <= self.per_level:
                return
            a, b = self.buckets[at[0]], self.buckets[at[1]]
            self.buckets[at[0]] = (level + 1, a[1] + b[1], a[2] + b[2], a[3] + b[3])
            del self.buckets[at[1]]
            level += 1

    def _cut(self) -> bool:
        n = sum(b[1] for b in self.buckets)
        if n <= self.grace or len(self.buckets) < 2:
            return False
        s, ss = sum(b[2] for b in self.buckets), sum(b[3] for b in self.buckets)
        var = max(0.0, ss / n - (s / n) ** 2)
        log_term = math.log(2.0 * math.log(n) / self.delta)
        n0 = s0 = 0.0
        for _, bn, bs, _ in self.buckets[:-1]:
            n0, s0 = n0 + bn, s0 + bs
            n1 = n - n0
            if n0 < self.min_side or n1 < self.min_side:
                continue
            m = 1.0 / (1.0 / n0 + 1.0 / n1)
            bound = math.sqrt(2.0 / m * var * log_term) + 2.0 / (3.0 * m) * log_term
            if abs(s0 / n0 - (s - s0) / n1) > bound:
                del self.buckets[0]
                return True
        return False


def block_sums(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = (), clock: int = 32) -> DataFrame:
    """n, sum and sum of squares of every ``clock`` consecutive rows."""
    v = q(value).cast("double")
    r = ranked(df, order, by, "_rn")
    return r.groupBy(*[q(c) for c in by], F.floor((F.col("_rn") - 1) / clock).alias("block")).agg(
        F.count("*").cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")
    )


def adwin(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str], clock: int = 32, delta: float = 0.002, restart: bool = False) -> DataFrame:
    """ADWIN per key: (key, block, end row, window length, drift) for every block of rows.

    The cut test runs every ``clock`` rows, so the rows are summed to blocks in parallel and
    only the block sums are walked in order. ``restart`` drops the whole window on a drift.
    """
    by = list(by)
    sums = block_sums(df, order, value, by, clock)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by).schema.fields)

    def step(box: dict, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, n, s, ss in zip(rows["block"], rows["n"], rows["s"], rows["ss"]):
            hit = box["w"].update(n, s, ss)
            if hit and restart:
                box["w"] = Adwin(delta)
            out.append((int(block * clock + n), float(sum(b[1] for b in box["w"].buckets)), int(hit)))
        res = rows[[*by, "block"]].reset_index(drop=True)
        res[["end_row", "width", "drift"]] = pd.DataFrame(out)
        return res

    return keyed_fold(
        sums, by, ["block"], lambda _: {"w": Adwin(delta)}, step,
        f"{keys}, block long, end_row long, width double, drift int",
    )


def adwin_resume(df: DataFrame, order: Sequence[str], value: str, buckets: Sequence[tuple] = (), clock: int = 32, delta: float = 0.002) -> tuple[bool, list[tuple]]:
    """Walk one batch of a stream from the window the last batch left behind.

    Stops at the first drift. Returns whether there was one, and the window to go on with
    (empty after a drift). The window is a few dozen buckets, whatever the stream's length.
    """
    held = [tuple(b) for b in buckets]

    def start(_: int) -> dict:
        w = Adwin(delta)
        w.buckets = list(held)
        return {"w": w, "hit": False}

    def step(box: dict, rows: pd.DataFrame) -> pd.DataFrame:
        for n, s, ss in zip(rows["n"], rows["s"], rows["ss"]):
            box["hit"] = box["hit"] or box["w"].update(n, s, ss)
        parts = [list(c) for c in zip(*box["w"].buckets)]
        return pd.DataFrame({"block": [rows["block"].max()], "hit": [int(box["hit"])], "level": [parts[0]], "n": [parts[1]], "s": [parts[2]], "ss": [parts[3]]})

    sums = block_sums(df, order, value, clock=clock).withColumn("_stream", F.lit(0))
    walked = keyed_fold(
        sums, ["_stream"], ["block"], start, step,
        "block long, hit int, level array<int>, n array<double>, s array<double>, ss array<double>",
    )
    end = walked.agg(F.max_by(F.struct("hit", "level", "n", "s", "ss"), "block").alias("e")).first()["e"]
    if end is None:
        return False, held
    if end["hit"]:
        return True, []
    return False, list(zip(end["level"], end["n"], end["s"], end["ss"]))


class DetectorEnsemble:
    """Several rank-sum detectors and thresholds that vote, warn, and reset together."""

    def __init__(self, refs: Sequence[Sequence[float]], sizes: Sequence[int], votes_anomaly: int = 1, votes_drift: int = 10,
                 p_warn: float = 0.01, p_alarm: float = 0.001, expiry: int = 100, refit_min: int = 64,
                 train_sizes: Sequence[int] = (), train_max: int = 3000, position: int = 0):
        self.sizes, self.members = list(sizes), len(sizes)
        self.votes_anomaly, self.votes_drift = votes_anomaly, votes_drift
        self.z_warn, self.z_alarm = z_critical(p_warn), z_critical(p_alarm)
        self.expiry, self.refit_min = expiry, refit_min
        self.train_sizes = list(train_sizes) or [0] * self.members
        self.train = [deque(maxlen=train_max) for _ in range(self.members)]
        self.t, self.warned_at = position, 0
        self.held: deque = deque(maxlen=max(self.sizes))
        self.refs: list[list[float]] = [[] for _ in self.sizes]
        self.moving: list[deque] = [deque() for _ in self.sizes]
        self.sums = [0.0] * self.members
        self.theta: list[float | None] = [None] * self.members
        for i, r in enumerate(refs):
            self._refit(i, r)

    def _refit(self, i: int, scores: Sequence[float]) -> None:
        self.theta[i] = float(np.mean(scores) + np.std(scores))
        self.refs[i] = sorted(scores[-self.sizes[i]:])

    def _z(self, i: int, score: float) -> float:
        """z of member i after taking in one score; 0 while its window is not full.

        Against a fixed reference U is the sum of the placements of the window's scores.
        """
        ref, win = self.refs[i], self.moving[i]
        if not ref:
            return 0.0
        lo, hi = bisect_left(ref, score), bisect_right(ref, score)
        place = lo + 0.5 * (hi - lo)
        win.append(place)
        self.sums[i] += place
        if len(win) > self.sizes[i]:
            self.sums[i] -= win.popleft()
        if len(win) < self.sizes[i]:
            return 0.0
        n_r, n_m = len(ref), len(win)
        u = min(self.sums[i], n_r * n_m - self.sums[i])
        sd = math.sqrt(n_r * n_m * (n_r + n_m + 1) / 12.0)
        return (u - n_r * n_m / 2.0) / sd if sd else 0.0

    def step(self, scores: Sequence[float]) -> tuple[int, float, int, int]:
        """One row: (anomaly, mean score, any warning, drift alarm)."""
        self.t += 1
        zs, hits = [], 0
        for i, s in enumerate(scores):
            hits += self.theta[i] is not None and s > self.theta[i]
            self.train[i].append(s)
            zs.append(self._z(i, s))
            if self.train_sizes[i] and self.t % self.train_sizes[i] == 0:
                self.theta[i] = float(np.mean(self.train[i]) + np.std(self.train[i]))
        warn = any(z < self.z_warn for z in zs)
        if warn and not self.warned_at:
            self.warned_at = self.t
        if self.warned_at:
            self.held.append(tuple(scores))
            if self.t - self.warned_at > self.expiry:
                self.warned_at = 0
                self.held.clear()
        alarm = sum(z < self.z_alarm for z in zs) >= self.votes_drift
        if alarm:
            self._reset()
        return int(hits >= self.votes_anomaly), float(np.mean(scores)), int(warn), int(alarm)

    def _reset(self) -> None:
        """After an alarm all members start again, from the rows held since the warning if enough."""
        enough = len(self.held) >= self.refit_min
        for i in range(self.members):
            self.theta[i] = None
            self.moving[i].clear()
            self.train[i].clear()
            self.sums[i] = 0.0
            if enough:
                self._refit(i, [row[i] for row in self.held])
        self.held.clear()
        self.warned_at = 0


def detector_ensemble(
    df: DataFrame, key: str, order: Sequence[str], scores: str, refs: Sequence[Sequence[float]], sizes: Sequence[int], **settings
) -> DataFrame:
    """Ensemble verdict after every row of every key's stream (``scores`` is an array column)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keep = [key, *[c for c in order if c != key]]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", pred int, score double, warn int, alarm int"
    refs, sizes = [list(map(float, r)) for r in refs], list(sizes)

    def step(state: DetectorEnsemble, rows: pd.DataFrame) -> pd.DataFrame:
        got = [state.step([float(v) for v in s]) for s in rows[scores]]
        out = rows[keep].reset_index(drop=True)
        out[["pred", "score", "warn", "alarm"]] = pd.DataFrame(got)
        return out

    return keyed_fold(
        df.select(*[q(c) for c in keep], q(scores)), [key], order, lambda i: DetectorEnsemble(refs, sizes, position=i, **settings), step, schema
    )


def forward_threshold(df: DataFrame, order: Sequence[str], changes: DataFrame, start: float, every: int) -> DataFrame:
    """Apply, to every row, the threshold of the last change before it.

    ``changes`` has (checkpoint, threshold). The last changed checkpoint up to a row is a
    running maximum along the order; the threshold itself is then one equi-join. The row a
    change happens at still sees the old threshold.
    """
    r = positions(df, order)
    # The row after a checkpoint is the first to see its change.
    after = F.col("_rn") - 2
    at = r.withColumn("_cp", F.when((after >= 0) & (after % every == 0), (after / every).cast("long")))
    marks = changes.select(F.col("checkpoint").cast("long").alias("_cp"), F.col("checkpoint").cast("long").alias("_hit"))
    marked = at.join(marks, "_cp", "left").drop("_cp")
    # Positions are known, so equal slices of them are the buckets; no sketch is needed.
    slices = F.floor((F.col("_rn") - 1) * default_buckets(df) / F.col("_rn_total"))
    last = running(marked, ["_rn"], {"_seen": ("max", F.col("_hit"))}, bucket=slices)
    thr = changes.select(F.col("checkpoint").cast("long").alias("_seen"), F.col("threshold").alias("_t"))
    out = last.join(thr, "_seen", "left")
    extra = [c for c in ("_seen", "_t", "_hit", "_rn", "_rn_total") if c not in df.columns]
    return out.withColumn("threshold", F.coalesce(F.col("_t"), F.lit(float(start)))).drop(*extra)
