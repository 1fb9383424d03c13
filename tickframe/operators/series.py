"""Per-symbol ordered series on Spark: the layout every window operator uses.

The reference works on one pandas frame per symbol.  Here a "series" is a long
DataFrame keyed by (symbol, ts), and every window operator runs over

    Window.partitionBy(symbol, _blk).orderBy(_sub, _rn)

where ``_rn`` is the 0-based position of the row inside its symbol, ``_sub``
numbers runs of ``SUB_ROWS`` rows (for ``ewm``; one sort serves all windows) and
``_blk`` splits a symbol into blocks of about ``block_rows`` rows.  A symbol that
holds a third of all rows is therefore spread over many tasks instead of one.
There is one layout, built without any driver action: a symbol of at most
``block_rows`` rows is block 0 and needs one exchange; larger ones are counted
per (symbol, period), and their blocks 1, 2, ... are runs of whole periods.

Bounded frames stay exact across block edges because each block also receives
*halo* rows (flagged ``_core = false``): the periods that hold the ``halo_back``
rows before it and the ``halo_fwd`` rows after it.
``finish`` drops them again.  Operators report the rows they look back and
ahead (``rows``, ``lag``, ``lead``, ``ewm``): on a raw frame the halo is
exactly what the operator reports; a pipeline on one prepared frame adds the
reports up and stops with ``HaloTooSmall`` before a value could be lost.

Running aggregates over the whole history (OBV, running max for drawdowns,
compounded returns) add a per-block carry computed from block totals; see
``running``.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BY = "symbol"
TS = "ts"
RN = "_rn"     # 0-based row position inside the symbol
N = "_n"       # rows in the symbol
BLK = "_blk"   # block id inside the symbol
CORE = "_core"  # false for halo copies
SUB = "_sub"   # run of SUB_ROWS rows inside the symbol

HELPERS = (RN, N, BLK, CORE, SUB)

SUB_ROWS = 1024

DEFAULT_BLOCK_ROWS = 1 << 18
DEFAULT_HALO_BACK = 32768
DEFAULT_HALO_FWD = 4096

_LAYOUT_KEY = "tickframe_layout"
_SUB = "_sub_"  # sub-block columns of ewm where SUB does not fit


class HaloTooSmall(ValueError):
    """The operators of a pipeline look further than the frame's halo."""


class _Needs:
    """Rows that the operators under construction look back and ahead."""

    def __init__(self):
        self.open: list[list[int]] = []
        self.probing = 0

    def note(self, back: int, fwd: int) -> None:
        if self.open:
            self.open[-1][0] += max(back, 0)
            self.open[-1][1] += max(fwd, 0)

    def measure(self, build):
        """(result of ``build``, rows back, rows ahead)."""
        self.open.append([0, 0])
        try:
            out = build()
        finally:
            back, fwd = self.open.pop()
        self.note(back, fwd)
        return out, back, fwd


_needs = _Needs()


def is_prepared(df: DataFrame) -> bool:
    return RN in df.columns and BLK in df.columns


def layout_of(df: DataFrame) -> dict:
    return dict((df.schema[BLK].metadata or {})[_LAYOUT_KEY])


def _order_cols(ts) -> list[str]:
    return [ts] if isinstance(ts, str) else list(ts)


def _spans(keyed: DataFrame, by: str, block_rows: int, halo_back: int, halo_fwd: int) -> DataFrame:
    """One row per block of each symbol of more than ``block_rows`` rows: its own
    periods, its periods with halo, the first row and the rows of the symbol.
    At most two blocks per ``block_rows`` rows of input."""
    sizes = keyed.groupBy(F.col(by).alias("_sby")).agg(F.count(F.lit(1)).alias("_all"))
    large = F.broadcast(sizes.filter(F.col("_all") > block_rows).select("_sby"))
    counts = (keyed.select(by, "_chunk").join(large, F.col(by).eqNullSafe(F.col("_sby")), "left_semi")
              .groupBy(F.col(by).alias("_sby"), "_chunk").agg(F.count(F.lit(1)).alias("_cn")))
    wc = Window.partitionBy("_sby").orderBy("_chunk")
    upto = F.sum("_cn").over(wc.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    total = F.sum("_cn").over(wc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("long")
    counts = counts.select("_sby", "_chunk", (upto - F.col("_cn")).alias("_off"), upto.alias("_end"), total.alias("_all"))
    number = (F.floor(F.col("_off") / F.lit(block_rows)) + 1).cast("long")
    blocks = counts.groupBy("_sby", number.alias("_sblk")).agg(
        F.min("_chunk").alias("_own_lo"), F.max("_chunk").alias("_own_hi"), F.min("_off").alias("_from"), F.max("_end").alias("_to"))
    near = counts.withColumnRenamed("_sby", "_cby")
    reach = (F.col("_sby").eqNullSafe(F.col("_cby")) & (F.col("_end") > F.col("_from") - halo_back)
             & (F.col("_off") < F.col("_to") + halo_fwd))
    return blocks.join(near, reach).groupBy("_sby", "_sblk", "_own_lo", "_own_hi").agg(
        F.min("_chunk").alias("_lo"), F.max("_chunk").alias("_hi"), F.min("_off").alias("_base"), F.max("_all").alias("_all"))


def prepare(df: DataFrame, by: str = BY, ts=TS, *, block_rows: int = DEFAULT_BLOCK_ROWS,
            halo_back: int = DEFAULT_HALO_BACK, halo_fwd: int = DEFAULT_HALO_FWD) -> DataFrame:
    """Add ``_rn``, ``_n``, ``_blk``, ``_core`` and ``_sub``, and the halo rows.

    ``ts`` may be a list of ordering columns (time first, then tie-breakers).
    Counting periods are months for dates and hours for timestamps, so a busy
    intraday symbol is ranked in many tasks.
    """
    if is_prepared(df):
        return df
    order = _order_cols(ts)
    period = "month" if isinstance(df.schema[order[0]].dataType, T.DateType) else "hour"
    chunk = F.coalesce(F.date_trunc(period, F.col(order[0])).cast("timestamp").cast("long"), F.lit(-(1 << 63)))  # nulls come first
    keyed = df.withColumn("_chunk", chunk)
    spans = F.broadcast(_spans(keyed, by, block_rows, halo_back, halo_fwd))
    mine = F.col(by).eqNullSafe(F.col("_sby")) & (F.col("_chunk") >= F.col("_lo")) & (F.col("_chunk") <= F.col("_hi"))
    meta = {_LAYOUT_KEY: {"block_rows": block_rows, "halo_back": halo_back, "halo_fwd": halo_fwd, "used_back": 0, "used_fwd": 0}}
    out = keyed.join(spans, mine, "left").select(
        *df.columns, F.col("_base"), F.col("_all"), F.coalesce("_sblk", F.lit(0).cast("long")).alias(BLK, metadata=meta),
        F.coalesce((F.col("_chunk") >= F.col("_own_lo")) & (F.col("_chunk") <= F.col("_own_hi")), F.lit(True)).alias(CORE))
    out = out.repartition(by, BLK)  # also where the input lies by symbol: a hot one must not stay in one task
    block = Window.partitionBy(by, BLK).orderBy(*order)
    whole = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.select(*df.columns, BLK, CORE, F.coalesce("_all", F.count(F.lit(1)).over(whole)).alias(N),
                     (F.coalesce("_base", F.lit(0).cast("long")) + F.row_number().over(block) - 1).alias(RN))
    return out.withColumn(SUB, F.floor(F.col(RN) / F.lit(SUB_ROWS)).cast("long"))


def _used(df: DataFrame, back: int, fwd: int) -> DataFrame:
    """Book an operator's look back and ahead on a prepared frame."""
    if not is_prepared(df) or not (back or fwd):
        return df
    lay = layout_of(df)
    lay["used_back"], lay["used_fwd"] = lay["used_back"] + back, lay["used_fwd"] + fwd
    if not _needs.probing and (lay["used_back"] > lay["halo_back"] or lay["used_fwd"] > lay["halo_fwd"]):
        raise HaloTooSmall(f"the operators look {lay['used_back']} rows back and {lay['used_fwd']} ahead; "
                           f"prepare(..., halo_back={lay['used_back']}, halo_fwd={lay['used_fwd']}) holds them")
    return df.withMetadata(BLK, {_LAYOUT_KEY: lay})


def finish(df: DataFrame, keep_index: bool = False) -> DataFrame:
    """Drop halo rows and (unless ``keep_index``) the helper columns."""
    out = df.filter(F.col(CORE)).drop(*[c for c in df.columns if c.startswith(_SUB)])
    if keep_index:
        return out.drop(BLK, CORE, SUB)
    return out.drop(*HELPERS)


def win(by: str = BY) -> Window:
    return Window.partitionBy(by, BLK).orderBy(SUB, RN)


def rows(lo: int, hi: int, by: str = BY) -> Window:
    _needs.note(-lo, hi)
    return win(by).rowsBetween(lo, hi)


def lag(x, k: int = 1, by: str = BY) -> Column:
    _needs.note(k, 0)
    return F.lag(x, k).over(win(by))


def lead(x, k: int = 1, by: str = BY) -> Column:
    _needs.note(0, k)
    return F.lead(x, k).over(win(by))


def full_rows(n: int, agg_col: Column, x: Column, by: str = BY) -> Column:
    """pandas ``rolling(n)`` semantics: value only once the frame holds n non-null rows."""
    w = rows(-(n - 1), 0, by)
    return F.when(F.count(x).over(w) == n, agg_col.over(w))


#: Frames of up to this many rows are read anew for every row.
SHORT_ROWS = 32


def rolling_std(df: DataFrame, x: str, names: dict[int, str], by: str = BY) -> DataFrame:
    """``full_rows(n, stddev_samp(x), x)`` for every n of ``names`` (n -> column).

    Spark reads a sliding frame anew for every row.  Here mean and squared
    deviations of the last 2, 4, 8, ... rows are merged from two halves, and a
    frame from the powers of two that add up to n: some log2(n) lags a row.
    Merging subtracts no running totals, so nothing cancels.
    """
    if max(names) <= SHORT_ROWS:
        return df.withColumns({name: full_rows(n, F.stddev_samp(x), F.col(x), by) for n, name in names.items()})
    _needs.note(max(names) - 1, 0)
    w, out, k, made = win(by), df, 1, []
    mean, dev = (lambda k: x if k == 1 else f"{_SUB}mean{k}"), (lambda k: f"{_SUB}dev{k}")
    while 2 * k <= max(names):
        old = {f"{_SUB}m": F.lag(mean(k), k).over(w)} | ({f"{_SUB}d": F.lag(dev(k), k).over(w)} if k > 1 else {})
        step = F.col(f"{_SUB}m") - F.col(mean(k))
        both = F.col(dev(k)) + F.col(f"{_SUB}d") if k > 1 else F.lit(0.0)
        out = out.withColumns(old).withColumns({mean(2 * k): F.col(mean(k)) + step / 2.0, dev(2 * k): both + step * step * (k / 2.0)})
        k *= 2
        made += [mean(k), dev(k)]
    parts, lags = {}, {}
    for n in names:
        sizes = [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]
        parts[n] = [(size, sum(sizes[:i])) for i, size in enumerate(sizes)]
        for size, back in parts[n]:
            lags |= {f"{c(size)}_{back}": F.lag(c(size), back).over(w) for c in (mean, dev) if c is mean or size > 1}
    out = out.withColumns(lags)
    total, std = {}, {}
    for n, name in names.items():
        means = [(size, F.col(f"{mean(size)}_{back}")) for size, back in parts[n]]
        first, whole = means[0][1], F.col(f"{_SUB}all{n}")
        total[f"{_SUB}all{n}"] = functools.reduce(lambda a, b: a + b, [(m - first) * (size / n) for size, m in means[1:]], first)
        devs = [F.col(f"{dev(size)}_{back}") for size, back in parts[n] if size > 1] + [(m - whole) * (m - whole) * float(size) for size, m in means]
        std[name] = F.sqrt(functools.reduce(lambda a, b: a + b, devs) / float(n - 1))
    return out.withColumns(total).withColumns(std).drop(*made, *lags, *total, f"{_SUB}m", f"{_SUB}d")


def series_op(fn):
    """Decorator: run ``fn`` on a prepared frame and book the rows it looks
    back and ahead.  A raw frame is prepared with just that halo and finished."""

    @functools.wraps(fn)
    def wrapper(df: DataFrame, *args, by: str = BY, ts=TS, **kw):
        if is_prepared(df):
            out, back, fwd = _needs.measure(lambda: fn(df, *args, by=by, **kw))
            return _used(out, back, fwd) if is_prepared(out) else out
        _needs.probing += 1
        try:
            _, back, fwd = _needs.measure(lambda: fn(prepare(df, by, ts), *args, by=by, **kw))
        finally:
            _needs.probing -= 1
        return finish(fn(prepare(df, by, ts, halo_back=back, halo_fwd=fwd), *args, by=by, **kw))

    return wrapper


# ------------------------------------------------------------------ running aggregates
_RUNNING = {
    "sum": (F.sum, lambda a, b: a + b, F.sum),
    "max": (F.max, F.greatest, F.max),
    "min": (F.min, F.least, F.min),
}


def running(df: DataFrame, x: Column, how: str, name: str, by: str = BY) -> DataFrame:
    """Running ``sum|max|min`` of ``x`` from the symbol's first row to each row."""
    return running_all(df, [(x, how, name)], by)


def running_all(df: DataFrame, what: list[tuple[Column, str, str]], by: str = BY) -> DataFrame:
    """Several running aggregates (x, how, name) with one carry join.

    Inside a block this is an O(n) unbounded-preceding frame over core rows;
    across blocks the carry is the aggregate of all earlier blocks, computed
    from a block-total table (one row per block of a symbol with several: at most
    two per ``block_rows`` rows) and joined back on (symbol, _blk), which keeps
    the existing partitioning.  Only such symbols' rows are read again for it.
    """
    core = df.filter(F.col(CORE) & (F.col(BLK) > 0)).groupBy(F.col(by).alias("_by"), F.col(BLK).alias("_tb"))
    totals = core.agg(*[_RUNNING[how][2](x).alias(f"_tot_{name}") for x, how, name in what])
    wb = Window.partitionBy("_by").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_by", "_tb", *[_RUNNING[how][2](f"_tot_{name}").over(wb).alias(f"_carry_{name}") for _, how, name in what])
    layout = df.schema[BLK].metadata
    out = df.join(F.broadcast(carry), F.col(by).eqNullSafe(F.col("_by")) & (F.col(BLK) == F.col("_tb")), "left").drop("_by", "_tb")
    for x, how, name in what:
        agg, combine, _ = _RUNNING[how]
        local = agg(F.when(F.col(CORE), x)).over(win(by).rowsBetween(Window.unboundedPreceding, 0))
        before, here = F.col(f"_carry_{name}"), F.col(f"_local_{name}")
        val = F.when(before.isNull(), here).otherwise(F.when(here.isNull(), before).otherwise(combine(before, here)))
        out = out.withColumn(f"_local_{name}", local).withColumn(name, val).drop(f"_carry_{name}", f"_local_{name}")
    return out.withMetadata(BLK, layout)


# ------------------------------------------------------------------ exponential weighting
#: q^-p of a sub-block stays below e to this.
_MAX_EXPONENT = 500.0
#: Shared length of sub-blocks where q is too near 1 for SUB_ROWS.
_LONG_SUB_ROWS = 4096


def ewm_block_rows(q: float) -> int:
    """Sub-block length for the block-rescaled EWM: q^-p stays below e^40 and
    the carry older than one sub-block is below e^-40 of the total."""
    return max(1, int(40.0 / -math.log(q)))


def ewm(df: DataFrame, x: Column, *, alpha: float, adjust: bool, name: str,
        start: Column | int = 0, min_periods: int = 0, by: str = BY) -> DataFrame:
    """Exponentially weighted mean of ``x`` from row ``start`` on (pandas ``ewm``).

    adjust=True:  y_r = sum q^(r-j) x_j / sum q^(r-j)
    adjust=False: y_start = x_start, y_r = q y_(r-1) + alpha x_r
    with q = 1 - alpha and j, r counted from ``start``.  Rows before ``start``
    (and rows before ``start + min_periods - 1``) give null.

    Without a UDF: rows are cut into sub-blocks (the layout's ``_sub`` where
    its length suits q, else runs of ``ewm_block_rows``); inside a sub-block the
    weighted sum is a running sum of x * q^-p rescaled by q^p, and the previous
    sub-block's final sum is carried with weight q^(p+1).  Older terms weigh
    below e^-40, less than half a unit in the last place of the result as long
    as values differ by less than 1e17.  Null values weigh nothing; the result is
    null where all values since the last multiple of ``ewm_block_rows`` are null.
    """
    return ewm_all(df, [(x, alpha, name)], adjust=adjust, start=start, min_periods=min_periods, by=by)


def ewm_all(df: DataFrame, what: list[tuple[Column, float, str]], *, adjust: bool, start: Column | int = 0,
            min_periods: int | list[int] = 0, by: str = BY) -> DataFrame:
    """Several weighted means (x, alpha, name) in shared windows; see ``ewm``."""
    least = min_periods if isinstance(min_periods, list) else [min_periods] * len(what)
    i = F.col(RN) - (start if isinstance(start, Column) else F.lit(start))
    valid = i >= 0
    out, extra, local, before, final = df, {}, {}, {}, {}
    for (x, alpha, name), m in zip(what, least):
        q = 1.0 - alpha
        back = ewm_block_rows(q)
        _needs.note(2 * back, 0)
        B = next((k for k in (SUB_ROWS, _LONG_SUB_ROWS) if back <= k <= -_MAX_EXPONENT / math.log(q)), back)
        sub = SUB if B == SUB_ROWS else f"{_SUB}{B}"
        if sub not in out.columns:
            extra[sub] = F.floor(F.col(RN) / F.lit(B)).cast("long")
        p = F.col(RN) - F.col(sub) * F.lit(B)
        xv = x if adjust else F.when(i == 0, x / F.lit(alpha)).otherwise(x)
        xv = F.when(valid, xv).otherwise(F.lit(0.0))
        inside = Window.partitionBy(by, BLK, sub).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
        sofar = Window.partitionBy(by, BLK).orderBy(sub, RN)
        lo, pr, seen = f"_ewm_{name}_l", f"_ewm_{name}_prev", f"_ewm_{name}_seen"
        local[lo] = F.sum(xv * F.pow(F.lit(q), -p)).over(inside) * F.pow(F.lit(q), p)
        before[pr] = F.last(F.when(p == B - 1, F.coalesce(F.col(lo), F.lit(0.0))), ignorenulls=True).over(
            sofar.rowsBetween(Window.unboundedPreceding, -1))
        before[seen] = F.last(F.when(xv.isNotNull(), F.col(RN)), ignorenulls=True).over(sofar.rowsBetween(Window.unboundedPreceding, 0))
        num = F.col(lo) + F.coalesce(F.col(pr), F.lit(0.0)) * F.pow(F.lit(q), p + 1)
        y = num / ((1.0 - F.pow(F.lit(q), i + 1)) / F.lit(1.0 - q)) if adjust else num * F.lit(alpha)
        known = F.col(seen) >= F.col(RN) - F.pmod(i, F.lit(back))
        final[name] = F.when(valid & known & (i >= F.lit(max(m, 1) - 1)), y)
    for columns in (extra, local, before, final):
        out = out.withColumns(columns) if columns else out
    return out.drop(*local, *before)
