"""Rolling features over the last N rows of a series, N up to a year of trading days.

A sliding frame costs N updates per row in Spark, so a family of a dozen windows up to 360 rows costs
over a thousand. Here only frames of up to ``UNIT`` rows slide. Longer windows are put together in two
steps from shorter ones ending earlier, fetched by ``lag``:

    30 rows  = 6 units of 5 ending 0, 5, 10, 15, 20, 25 rows back
    160 rows = 5 tiles of 30 ending 0, 30, 60, 90, 120 rows back + 1 piece of 10 ending 150 back

Counts, sums and products add up, minima and maxima nest, and the spread follows from the pieces' means
by the pooled-variance identity, so a constant window has no spread. All families asked for share the
same (series, order) sort: one shuffle and at most four window nodes, however many features.

Hundreds of features make rows of hundreds of intermediate columns, of which a window node copies each row.
``build_in_arrow`` computes the same windows on Arrow batches instead (``windows.py``).

Frames are partial at the start of a series and NULL values are skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.functions import vocabulary as V
from pitscore.operators.series import amplitude
from pitscore.operators.windows import TILE, UNIT, window_step
from pitscore.sources.io import share_package


def tile_plan(n: int, tile: int = TILE) -> list[tuple[int, int]]:
    """``[(length, rows back)]``: how a window of ``n`` rows is covered by pieces of ``tile`` rows."""
    whole, rest = divmod(n, tile)
    plan = [(tile, i * tile) for i in range(whole)]
    return plan + ([(rest, whole * tile)] if rest else [])


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _double(name: str) -> str:
    return f"CAST({_q(name)} AS DOUBLE)"


def _sum0(parts: Iterable[str]) -> str:
    return "(" + " + ".join(f"coalesce({p}, 0)" for p in parts) + ")"


def _least(parts: Sequence[str]) -> str:
    return f"least({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _greatest(parts: Sequence[str]) -> str:
    return f"greatest({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _pooled(counts: Sequence[str], sums: Sequence[str], squares: Sequence[str], mean: str) -> str:
    """Squared deviations of a window from its pieces' counts, sums and squared deviations."""
    return _sum0(
        f"{q} + {n} * pow(try_divide({s}, {n}) - {mean}, 2)"
        for n, s, q in zip(counts, sums, squares, strict=True)
    )


class RollingFeatures:
    """Collects feature families over one panel, then builds them in shared window nodes.

    Expressions are kept as SQL text: hundreds of them are parsed in one call per stage, where as many
    Column objects would take seconds to put together.
    """

    def __init__(self, df: DataFrame, series: Sequence[str], order: Sequence[str]):
        self.df = df
        self.w = f"PARTITION BY {', '.join(map(_q, series))} ORDER BY {', '.join(map(_q, order))}"
        # stages in order; a stage reads the columns of the stages before it
        self._first: dict[str, str] = {}
        self._units: dict[str, str] = {}
        self._unit_lags: dict[str, str] = {}
        self._pieces: dict[str, str] = {}
        self._spreads: dict[str, str] = {}
        self._tile_lags: dict[str, str] = {}
        self._means: dict[str, str] = {}
        self._out: dict[str, str] = {}
        self._families: list[tuple] = []

    def build(self, keep: Sequence[str] | None = None) -> DataFrame:
        """``keep`` (default: all input columns) followed by the features."""
        out = self.df
        for stage in (
            self._first,
            self._units,
            self._unit_lags,
            self._pieces,
            self._spreads,
            self._tile_lags,
            self._means,
        ):
            if stage:
                out = out.selectExpr("*", *[f"{e} AS {_q(n)}" for n, e in stage.items()])
        base = self.df.columns if keep is None else keep
        return out.selectExpr(*map(_q, base), *[f"{e} AS {_q(n)}" for n, e in self._out.items()])

    def build_in_arrow(self) -> DataFrame:
        """As :meth:`build`, for many features: one sort, one narrow window node and one Arrow step, named in
        the plan by the pieces it puts windows together from. Values are taken as doubles.

        Spark takes what follows an Arrow step for unsorted rows: compute other windows before it.
        """
        share_package(self.df.sparkSession)
        names = list(dict.fromkeys(value for _, value, *_ in self._families))
        step = window_step(names, self._families, list(self._out))
        step.__name__ = f"rolling: {', '.join([*self._units, *self._pieces])}"
        fields = ", ".join(f"{_q(n)} {'int' if n.startswith('cat_') else 'double'}" for n in self._out)
        # it depends on the rows before: not to be moved or repeated
        found = F.arrow_udf(step, fields).asNondeterministic()("_t", *[F.expr(_double(n)) for n in names])
        out = self.df.selectExpr("*", f"row_number() OVER ({self.w}) AS _t").withColumn("_found", found)
        return out.selectExpr(*map(_q, self.df.columns), *[f"_found.{_q(n)}" for n in self._out])

    # -- pieces -----------------------------------------------------------------------------------

    def _lag(self, stage: dict[str, str], column: str, rows: int) -> str:
        if rows == 0:
            return _q(column)
        key = f"{column}_b{rows}"
        stage[key] = f"lag({_q(column)}, {rows}) OVER ({self.w})"
        return _q(key)

    def _piece(self, name: str, length: int, agg: str, join) -> str:
        """Column holding the aggregate of the last ``length`` (at most ``TILE``) rows."""
        key = f"_{name}_{length}"
        if length <= UNIT:
            frame = f"({self.w} ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
            self._units[key] = agg.format(over=f"OVER {frame}")
        elif key not in self._pieces:
            parts = [(self._piece(name, k, agg, join), b) for k, b in tile_plan(length, UNIT)]
            self._pieces[key] = join([self._lag(self._unit_lags, c, b) for c, b in parts])
        return key

    def _tiles(self, name: str, n: int, agg: str, join, skip: int = 0) -> list[str]:
        return [
            self._lag(self._tile_lags, self._piece(name, k, agg, join), b + skip) for k, b in tile_plan(n)
        ]

    def _total(self, name: str, n: int, value: str, agg: str = "sum") -> str:
        return _sum0(self._tiles(name, n, f"{agg}({value}) {{over}}", _sum0))

    def _extreme(self, value: str, n: int, high: bool, skip: int = 0) -> str:
        x = _double(value)
        if high:
            return _greatest(self._tiles(f"hi_{value}", n, f"max({x}) {{over}}", _greatest, skip))
        return _least(self._tiles(f"lo_{value}", n, f"min({x}) {{over}}", _least, skip))

    def _squares(self, value: str, length: int) -> str:
        """Column holding the squared deviations of the last ``length`` rows from their mean."""
        x, key = _double(value), f"_q_{value}_{length}"
        if length <= UNIT:
            return self._piece(f"q_{value}", length, f"var_pop({x}) {{over}} * count({x}) {{over}}", _sum0)
        if key not in self._spreads:
            n = self._piece(f"n_{value}", length, f"count({x}) {{over}}", _sum0)
            s = self._piece(f"s_{value}", length, f"sum({x}) {{over}}", _sum0)
            units = tile_plan(length, UNIT)
            self._spreads[key] = _pooled(
                [self._lag(self._unit_lags, f"_n_{value}_{k}", b) for k, b in units],
                [self._lag(self._unit_lags, f"_s_{value}_{k}", b) for k, b in units],
                [self._lag(self._unit_lags, self._squares(value, k), b) for k, b in units],
                f"try_divide({_q(s)}, {_q(n)})",
            )
        return key

    # -- families ---------------------------------------------------------------------------------

    def stats(self, value: str, windows: Iterable[int], label: str | None = None) -> RollingFeatures:
        """``amt_avg_/std_/min_/max_<label>_<N>``: mean, sample deviation, minimum, maximum."""
        label, x, windows = label or value, _double(value), list(windows)
        self._families.append(("stats", value, windows, label))
        for n in windows:
            counts = self._tiles(f"n_{value}", n, f"count({x}) {{over}}", _sum0)
            sums = self._tiles(f"s_{value}", n, f"sum({x}) {{over}}", _sum0)
            squares = [self._lag(self._tile_lags, self._squares(value, k), b) for k, b in tile_plan(n)]
            size, mean = f"_size_{value}_{n}", f"_mean_{value}_{n}"
            self._means[size] = _sum0(counts)
            self._means[mean] = f"try_divide({_sum0(sums)}, {_sum0(counts)})"
            total = squares[0] if len(squares) == 1 else _pooled(counts, sums, squares, _q(mean))
            self._out[f"amt_avg_{label}_{n}"] = _q(mean)
            self._out[f"amt_std_{label}_{n}"] = f"sqrt(try_divide({total}, greatest({_q(size)} - 1, 0)))"
            self._out[f"amt_min_{label}_{n}"] = self._extreme(value, n, high=False)
            self._out[f"amt_max_{label}_{n}"] = self._extreme(value, n, high=True)
        return self

    def changes(self, value: str, windows: Iterable[int], label: str | None = None) -> RollingFeatures:
        """``pct_tx_<label>_<N>d``: change over N rows; NULL when the older value is 0 or missing."""
        label, windows = label or value, list(windows)
        self._families.append(("changes", value, windows, label))
        for n in windows:
            base = f"_c_{value}_{n}"
            self._first[base] = f"lag({_q(value)}, {n}) OVER ({self.w})"
            self._out[f"pct_tx_{label}_{n}d"] = (
                f"try_divide({_q(value)} - {_q(base)}, abs({_q(base)}))"
            )
        return self

    def slopes(self, value: str, windows: Iterable[int], label: str | None = None) -> RollingFeatures:
        """``amt_beta_<label>_<N>``: least-squares slope of the value on the row number."""
        self._first["_t"] = f"CAST(row_number() OVER ({self.w}) AS DOUBLE)"
        x = _double(value)
        t = f"CASE WHEN {x} IS NOT NULL THEN _t END"
        label, windows = label or value, list(windows)
        self._families.append(("slopes", value, windows, label))
        for n in windows:
            size = self._total(f"n_{value}", n, x, "count")
            st = self._total(f"t_{value}", n, t)
            sx = self._total(f"s_{value}", n, x)
            stt = self._total(f"tt_{value}", n, f"({t}) * _t")
            stx = self._total(f"tx_{value}", n, f"_t * {x}")
            self._out[f"amt_beta_{label}_{n}"] = (
                f"try_divide({size} * {stx} - {st} * {sx}, {size} * {stt} - {st} * {st})"
            )
        return self

    def breakouts(
        self, value: str, windows: Iterable[int], high: bool, label: str | None = None
    ) -> RollingFeatures:
        """``cat_<label>_broke_high_<N>`` / ``_low_``: 1 when beyond all of the previous N rows."""
        x, label, windows = _double(value), label or value, list(windows)
        self._families.append(("breakouts", value, windows, label, high))
        for n in windows:
            side, op = ("high", ">") if high else ("low", "<")
            edge = self._extreme(value, n, high, skip=1)
            self._out[f"cat_{label}_broke_{side}_{n}"] = f"CAST({x} {op} {edge} AS INT)"
        return self

    def strength(self, value: str, windows: Iterable[int], label: str | None = None) -> RollingFeatures:
        """``amt_IFR_<label>_<N>``: 100 - 100 / (1 + gains / losses); 100 without losses."""
        move = f"_d_{value}"
        self._first[move] = f"{_double(value)} - lag({_double(value)}, 1) OVER ({self.w})"
        d, label, windows = _q(move), label or value, list(windows)
        self._families.append(("strength", value, windows, label))
        for n in windows:
            moves = self._total(f"m_{value}", n, d, "count")
            gains = self._total(f"g_{value}", n, f"CASE WHEN {d} > 0 THEN {d} WHEN {d} <= 0 THEN 0D END")
            losses = self._total(f"l_{value}", n, f"CASE WHEN {d} < 0 THEN -{d} WHEN {d} >= 0 THEN 0D END")
            self._out[f"amt_IFR_{label}_{n}"] = (
                f"CASE WHEN {moves} > 0 THEN CASE WHEN {losses} = 0 THEN 100D "
                f"ELSE 100 - 100D / (1 + {gains} / {losses}) END END"
            )
        return self


def rolling_stats(df, series, order, value, windows=tuple(V.ROLLING_WINDOWS), label=None):
    return RollingFeatures(df, series, order).stats(value, windows, label).build()


def rolling_slope(df, series, order, value, windows=tuple(V.SLOPE_WINDOWS), label=None):
    return RollingFeatures(df, series, order).slopes(value, windows, label).build()


def breakouts(df, series, order, high_columns, low_columns, windows=tuple(V.BREAK_WINDOWS)):
    p = RollingFeatures(df, series, order)
    for c in high_columns:
        p.breakouts(c, windows, high=True)
    for c in low_columns:
        p.breakouts(c, windows, high=False)
    return p.build()


def relative_strength(df, series, order, value, windows=tuple(V.STRENGTH_WINDOWS), label=None):
    return RollingFeatures(df, series, order).strength(value, windows, label).build()


def price_features(df: DataFrame, series: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All price features of the model table, from adj_close, close, high_price and low_price."""
    df = df.withColumn(V.AMPLITUDE, amplitude())
    p = RollingFeatures(df, series, order).stats("adj_close", V.ROLLING_WINDOWS)
    for c in V.CHANGE_COLUMNS:
        p.changes(c, V.ROLLING_WINDOWS)
    p.slopes("adj_close", V.SLOPE_WINDOWS)
    for c in V.BREAK_HIGH_COLUMNS:
        p.breakouts(c, V.BREAK_WINDOWS, high=True)
    for c in V.BREAK_LOW_COLUMNS:
        p.breakouts(c, V.BREAK_WINDOWS, high=False)
    return p.strength("adj_close", V.STRENGTH_WINDOWS).build_in_arrow()
