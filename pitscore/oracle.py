"""The same queries as plain SQL, written independently of the Spark plans (as-of joins, brute-force
theta joins, full-length frames, quadratic-free running sums)."""

from __future__ import annotations

from pitscore.functions import vocabulary as V

RAW_PRICES = """
raw_prices AS (
  SELECT CAST(l_shipdate AS DATE) AS date, lpad(CAST(l_suppkey AS VARCHAR), 14, '0') AS id_cnpj,
         l_returnflag AS ticker,
         CAST(floor(l_extendedprice) AS DOUBLE) AS adj_close,
         CAST(floor(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS close,
         CAST(floor(l_extendedprice * (1 + l_tax)) AS DOUBLE) AS high_price,
         CAST(floor(l_extendedprice * (1 - l_discount - l_tax)) AS DOUBLE) AS low_price,
         l_quantity AS volume
  FROM lineitem)"""

PRICES = (
    RAW_PRICES
    + """,
prices AS (
  SELECT date, id_cnpj, ticker, max(adj_close) AS adj_close, max(close) AS close,
         max(high_price) AS high_price, min(low_price) AS low_price, sum(volume) AS volume,
         'BR' || id_cnpj || ticker AS id_isin
  FROM raw_prices GROUP BY date, id_cnpj, ticker)"""
)

STATEMENTS = """
statements AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 14, '0') AS id_cnpj, s_name AS txt_company_name,
         CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS dt_refer,
         CAST(year(q) AS INTEGER) AS dt_year,
         CAST(floor(max(l_extendedprice)) AS DOUBLE) AS amt_sales_revenue,
         CAST(floor(min(l_extendedprice * l_tax)) - 50 AS DOUBLE) AS amt_financial_results,
         CAST(floor(min(l_extendedprice)) - 2000 AS DOUBLE) AS amt_net_profit
  FROM (SELECT *, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q FROM lineitem)
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY l_suppkey, s_name, q)"""

CLEAN = (
    PRICES
    + ","
    + STATEMENTS
    + """,
p AS (
  SELECT *, CAST(year(date) AS INTEGER) AS dt_year, CAST(month(date) AS INTEGER) AS dt_month,
         CAST(year(date - 90) * 100 + month(date - 90) AS INTEGER) AS dt_safra_dre
  FROM prices WHERE id_cnpj <> '00000000000000' AND date > DATE '{since}'),
s AS (SELECT *, CAST(dt_year * 100 + month(dt_refer) AS INTEGER) AS safra FROM statements)"""
)


def clean(since: str) -> str:
    return CLEAN.replace("{since}", since)


def scored(score: str = "l_extendedprice") -> str:
    cut = {"l_extendedprice": "52500.0", "l_discount": "0.05"}[score]
    return f"""
scored AS (
  SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date,
         CAST(year(l_shipdate) AS INTEGER) AS dt_year, CAST(month(l_shipdate) AS INTEGER) AS dt_month,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS cat_target, {score} AS prob,
         CASE WHEN {score} > {cut} THEN 1 ELSE 0 END AS prediction
  FROM lineitem)"""


HASH = """CASE WHEN CAST('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR),
  CAST(l_linenumber AS VARCHAR), '7')), 1, 8) AS BIGINT) % 1000 < 700 THEN 'train' ELSE 'test' END"""


def split_scores(score: str = "l_extendedprice") -> str:
    return (
        scored(score)
        + f""",
split_scores AS (
  SELECT *, CASE WHEN dt_month IN (2,4,6,8,12) THEN {HASH}
                 WHEN dt_month IN (1,3,5,7,9,11) THEN 'out' ELSE 'unused' END AS split
  FROM scored)"""
    )


def running(source: str, groups: str = "") -> str:
    """Running class counts per distinct score."""
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""
    return f"""
counts AS (
  SELECT {g}prob AS score, CAST(sum(cat_target) AS BIGINT) AS n1,
         CAST(sum(1 - cat_target) AS BIGINT) AS n0
  FROM {source} WHERE prob IS NOT NULL GROUP BY {g}prob),
run AS (
  SELECT *, CAST(sum(n1) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c1,
         CAST(sum(n0) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c0,
         CAST(sum(n1) OVER ({part}) AS BIGINT) AS t1, CAST(sum(n0) OVER ({part}) AS BIGINT) AS t0
  FROM counts WINDOW w AS ({part} ORDER BY score))"""


def bins(groups: str = "", min_bins: int = 1) -> str:
    """Brute force over every merge of neighbouring prebins, from ``run``."""
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""
    same = f"a.{groups} = b.{groups} AND " if groups else ""
    return f"""
slots AS (
  SELECT {g}CAST(floor((c1 + c0 - n1 - n0) * 10 / (t1 + t0)) AS INTEGER) AS slot, min(score) AS lo,
         max(score) AS hi, sum(n1) AS n1, sum(n0) AS n0
  FROM run GROUP BY ALL),
pre AS (
  SELECT *, row_number() OVER ({part} ORDER BY slot) AS prebin, count(*) OVER ({part}) AS k,
         sum(n1) OVER ({part}) AS t1, sum(n0) OVER ({part}) AS t0
  FROM slots),
masked AS (SELECT *, unnest(range(0, CAST(1 << (k - 1) AS BIGINT))) AS mask FROM pre),
merged AS (
  SELECT {g}mask, CAST(1 + bit_count(mask & ((CAST(1 AS BIGINT) << (prebin - 1)) - 1)) AS INTEGER) AS bin,
         min(lo) AS lo, max(hi) AS hi, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n0) AS BIGINT) AS n0,
         CAST(max(t1) AS DOUBLE) AS t1, CAST(max(t0) AS DOUBLE) AS t0
  FROM masked GROUP BY ALL),
stepped AS (
  SELECT *, sign(n1 / (n1 + n0) - lag(n1 / (n1 + n0)) OVER ({part}{', ' if part else 'PARTITION BY '}mask
         ORDER BY bin)) AS step FROM merged),
turned AS (
  SELECT *, lag(step) OVER ({part}{', ' if part else 'PARTITION BY '}mask ORDER BY bin) AS before
  FROM stepped WHERE step <> 0),
turns AS (
  SELECT {g}mask, count(*) FILTER (before IS NOT NULL AND before <> step) AS turns FROM turned GROUP BY ALL),
judged AS (
  SELECT {g}mask, count(*) AS n_bins, min((n1 + n0) / (t1 + t0)) AS smallest, min(least(n1, n0)) AS rarest,
         round(sum(CASE WHEN n1 > 0 AND n0 > 0 THEN (n0/t0 - n1/t1) * ln((n0/t0) / (n1/t1)) ELSE 0 END), 9)
           AS iv
  FROM merged GROUP BY ALL),
flagged AS (
  SELECT a.*, a.n_bins >= {min_bins} AND a.smallest >= 0.1 AND a.rarest > 0 AND coalesce(b.turns, 0) <= 1
         AS ok
  FROM judged a LEFT JOIN turns b ON {same}a.mask = b.mask),
best AS (
  SELECT * FROM flagged WHERE ok OR mask = 0
  QUALIFY row_number() OVER ({part} ORDER BY ok DESC, iv DESC, mask) = 1),
bins AS (
  SELECT a.* FROM merged a JOIN best b ON {same}a.mask = b.mask)"""


IV_SOURCE = (
    """
long AS (
"""
    + "\n  UNION ALL ".join(
        f"SELECT '{name}' AS variable, CAST({expr} AS DOUBLE) AS prob, l_linestatus = 'F' AS f FROM lineitem"
        for name, expr in [
            ("l_quantity", "l_quantity"),
            ("l_extendedprice", "l_extendedprice"),
            ("l_discount", "l_discount"),
            ("l_tax", "l_tax"),
            ("l_linenumber", "l_linenumber"),
            ("discount_gap", "nullif(l_discount, 0)"),
            ("status_leak", "l_linenumber + CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END"),
        ]
    )
    + """),
long_scores AS (SELECT variable, prob, CAST(f AS INTEGER) AS cat_target FROM long)"""
)

IV_TABLE = (
    "WITH "
    + IV_SOURCE
    + ","
    + running("long_scores", "variable")
    + ","
    + bins("variable")
    + """,
all_bins AS (
  SELECT variable, bin, n1, n0 FROM bins
  UNION ALL
  SELECT variable, 0, sum(cat_target), sum(1 - cat_target) FROM long_scores
  WHERE prob IS NULL GROUP BY variable),
shares AS (
  SELECT *, n1 / sum(n1) OVER (PARTITION BY variable) AS e, n0 / sum(n0) OVER (PARTITION BY variable) AS ne
  FROM all_bins),
iv_table AS (
  SELECT variable AS name, sum(CASE WHEN e > 0 AND ne > 0 THEN (ne - e) * ln(ne / e) ELSE 0 END) AS iv,
         count(*) FILTER (bin > 0) AS n_bins
  FROM shares GROUP BY variable)
"""
)

TARGET_FROM = """
j AS (SELECT p.*, s.dt_refer, s.txt_company_name, s.amt_sales_revenue, s.amt_net_profit
      FROM p ASOF LEFT JOIN s ON p.id_cnpj = s.id_cnpj AND p.dt_safra_dre >= s.safra),
l AS (SELECT *, lag(adj_close, 1) OVER w AS p1, lag(adj_close, 2) OVER w AS p2 FROM j
      WINDOW w AS (PARTITION BY id_cnpj, ticker ORDER BY date)),
t AS (SELECT *, (p1 - p2) / nullif(abs(p2), 0) AS var_target FROM l)"""

TARGET_SELECT = """
SELECT CAST(date AS VARCHAR) AS date, id_cnpj, ticker, dt_year, dt_month, dt_safra_dre,
       CAST(dt_refer AS VARCHAR) AS dt_refer, txt_company_name, amt_sales_revenue, amt_net_profit, adj_close,
       var_target, CASE WHEN var_target >= 0 THEN 1 ELSE 0 END AS cat_target
FROM t WHERE var_target IS NOT NULL"""

SINCE = "1995-03-31"
KEY = "CAST(date AS VARCHAR) AS date, id_cnpj, ticker"
BY_SERIES = "PARTITION BY id_cnpj, ticker ORDER BY date"

SHIFTED = """
sm AS (SELECT *, CAST(month(dt_refer) AS INTEGER) AS dt_month FROM statements),
lagged AS (SELECT id_cnpj, CAST(dt_refer - 180 AS DATE) AS dt_refer_lag FROM sm),
shifted AS (
  SELECT a.id_cnpj, b.dt_refer, a.dt_refer_lag, b.amt_sales_revenue, b.dt_year AS s_year, b.dt_month AS s_month
  FROM lagged a LEFT JOIN sm b ON a.id_cnpj = b.id_cnpj AND year(a.dt_refer_lag) = b.dt_year
       AND month(a.dt_refer_lag) = b.dt_month
  QUALIFY row_number() OVER (PARTITION BY a.id_cnpj, b.dt_refer ORDER BY a.dt_refer_lag DESC) = 1)"""


def _theta(rows: str, records: str, extra: str = "") -> str:
    return f"""
theta AS (
  SELECT r.*, s.dt_refer, s.amt_sales_revenue{extra}
  FROM {rows} r LEFT JOIN {records} s
    ON r.id_cnpj = s.id_cnpj AND r.dt_year >= s.s_year AND r.dt_month >= s.s_month
  QUALIFY row_number() OVER (PARTITION BY r.id_cnpj, r.ticker, r.date
                             ORDER BY s.s_year * 100 + s.s_month DESC NULLS LAST,
                                      s.dt_refer DESC NULLS LAST) = 1)"""


def _frames(template: str, windows) -> str:
    return ",\n  ".join(template.format(n=n, b=n - 1) for n in windows)


def _slope(value: str, label: str, windows, name: str = "f") -> str:
    def one(n):
        f = f"OVER ({name} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return (
            f"(count({value}) {f} * sum(t * {value}) {f} - sum(t) {f} * sum({value}) {f}) / "
            f"nullif(count({value}) {f} * sum(t * t) {f} - sum(t) {f} * sum(t) {f}, 0) "
            f"AS amt_beta_{label}_{n}"
        )

    return ",\n  ".join(one(n) for n in windows)


def _stats(value: str, label: str, windows) -> str:
    return _frames(
        f"avg({value}) OVER (f ROWS BETWEEN {{b}} PRECEDING AND CURRENT ROW) AS amt_avg_{label}_{{n}},\n"
        f"  round(stddev_samp({value}) OVER (f ROWS BETWEEN {{b}} PRECEDING AND CURRENT ROW), 2) "
        f"AS amt_std_{label}_{{n}}",
        windows,
    )


def _broke(value: str, side: str) -> str:
    op, agg = (">", "max") if side == "high" else ("<", "min")
    return _frames(
        f"CAST({value} {op} {agg}({value}) OVER (f ROWS BETWEEN {{n}} PRECEDING AND 1 PRECEDING) AS INTEGER) "
        f"AS cat_{value}_broke_{side}_{{n}}",
        V.BREAK_WINDOWS,
    )


BREAKS = ",\n  ".join(
    [_broke(c, "high") for c in V.BREAK_HIGH_COLUMNS] + [_broke(c, "low") for c in V.BREAK_LOW_COLUMNS]
)
BREAK_NAMES = [f"cat_{c}_broke_high_{n}" for c in V.BREAK_HIGH_COLUMNS for n in V.BREAK_WINDOWS] + [
    f"cat_{c}_broke_low_{n}" for c in V.BREAK_LOW_COLUMNS for n in V.BREAK_WINDOWS
]

LINE_TYPES = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
    ("discount_gap", "double"), ("flag_gap", "string"),
]

DESCRIBE = """WITH lines AS (
  SELECT *, nullif(l_discount, 0) AS discount_gap,
         CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag_gap FROM lineitem)
""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) - count({c}) AS n_missing, "
    f"(count(*) - count({c})) / count(*) * 100 AS pct_missing, count(DISTINCT {c}) AS n_distinct FROM lines"
    for c, t in LINE_TYPES
)


def _cells(source: str) -> str:
    cells = ", ".join(
        f"count(*) FILTER (cat_target = {a} AND prediction = {p}) AS n{a}{p}" for a in (0, 1) for p in (0, 1)
    )
    return f"cells AS (SELECT split, {cells} FROM {source} GROUP BY split)"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0.0)"


REPORT = f"""WITH {split_scores()}, {_cells("split_scores")},
pr AS (
  SELECT *, {_ratio("n00", "n00 + n10")} AS p0, {_ratio("n00", "n00 + n01")} AS r0,
         {_ratio("n11", "n11 + n01")} AS p1, {_ratio("n11", "n11 + n10")} AS r1,
         n00 + n01 AS s0, n10 + n11 AS s1, n00 + n01 + n10 + n11 AS total
  FROM cells),
f AS (SELECT *, {_ratio("2 * p0 * r0", "p0 + r0")} AS f0, {_ratio("2 * p1 * r1", "p1 + r1")} AS f1 FROM pr)
SELECT split, '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
UNION ALL SELECT split, '1', p1, r1, f1, s1 FROM f
UNION ALL SELECT split, 'accuracy', NULL, NULL, (n00 + n11) / total, total FROM f
UNION ALL SELECT split, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total FROM f
UNION ALL SELECT split, 'weighted avg', (p0 * s0 + p1 * s1) / total, (r0 * s0 + r1 * s1) / total,
                 (f0 * s0 + f1 * s1) / total, total FROM f"""

KS = "round(max(abs(c1 / nullif(t1, 0) - c0 / nullif(t0, 0))), 4)"
AUC = "sum(n1 * (c0 - n0 + n0 / 2)) / nullif(max(CAST(t1 AS DOUBLE)) * max(t0), 0)"
GH = (
    "CASE WHEN prob <= -1 THEN NULL WHEN prob <= 0.01 THEN 1 WHEN prob <= 0.03 THEN 2 WHEN prob <= 0.05 THEN 3 "
    "WHEN prob <= 0.06 THEN 4 WHEN prob <= 0.08 THEN 5 WHEN prob <= 0.09 THEN 6 WHEN prob <= 1000 THEN 7 END"
)
SHARE = f"""WITH {scored()},
c AS (SELECT dt_year, dt_month, cat_target, count(cat_target) AS qty FROM scored GROUP BY ALL),
t AS (SELECT dt_year, dt_month, count(cat_target) AS total FROM scored GROUP BY ALL)
SELECT c.*, t.total, round(qty / nullif(total, 0) * 100, 2) AS pct FROM c LEFT JOIN t USING (dt_year, dt_month)"""


def _change(n: int) -> str:
    return f"""WITH {PRICES}
SELECT {KEY}, adj_close, (adj_close - lag(adj_close, {n}) OVER w) / nullif(abs(lag(adj_close, {n}) OVER w), 0)
       AS change FROM prices WINDOW w AS ({BY_SERIES})"""


def _strength(n: int) -> str:
    f = f"OVER (f ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN count(d) {f} > 0 THEN CASE WHEN sum(greatest(-d, 0.0)) {f} = 0 THEN 100.0 ELSE "
        f"100 - 100.0 / (1 + sum(greatest(d, 0.0)) {f} / sum(greatest(-d, 0.0)) {f}) END END "
        f"AS amt_IFR_adj_close_{n}"
    )


STATEMENT_SHOWN = ["amt_sales_revenue", "amt_financial_results", "amt_net_profit"]


def _statement_lags() -> str:
    cols = [
        f"{lag}.{a} AS amt_tot_{a}_{lag[1:]}_lag, (c.{a} - {lag}.{a}) / nullif(abs({lag}.{a}), 0) "
        f"AS pct_tx_{a}_{lag[1:]}"
        for a in STATEMENT_SHOWN
        for lag in ("l1q", "l1y")
    ]
    m = "year({0}.dt_refer) * 12 + month({0}.dt_refer)"
    return f"""WITH {STATEMENTS}
SELECT c.id_cnpj, CAST(c.dt_refer AS VARCHAR) AS dt_refer, {", ".join(f"c.{a}" for a in STATEMENT_SHOWN)},
       {", ".join(cols)}
FROM statements c
LEFT JOIN statements l1q ON c.id_cnpj = l1q.id_cnpj AND {m.format("c")} - 3 = {m.format("l1q")}
LEFT JOIN statements l1y ON c.id_cnpj = l1y.id_cnpj AND {m.format("c")} - 12 = {m.format("l1y")}"""


_CHANGES = ",\n  ".join(
    f"({c} - lag({c}, {n}) OVER w) / nullif(abs(lag({c}, {n}) OVER w), 0) AS pct_tx_{c}_{n}d"
    for c in V.CHANGE_COLUMNS
    for n in V.ROLLING_WINDOWS
)

def _plain_stats(value: str, label: str, windows, name: str = "f") -> str:
    return _frames(
        f"avg({value}) OVER ({name} ROWS BETWEEN {{b}} PRECEDING AND CURRENT ROW) AS amt_avg_{label}_{{n}},\n"
        f"  stddev_samp({value}) OVER ({name} ROWS BETWEEN {{b}} PRECEDING AND CURRENT ROW) AS amt_std_{label}_{{n}}",
        windows,
    )


def price_features(source: str) -> str:
    """Every price feature over the rows of ``source``, as ``pf``."""
    return f"""
pa AS (SELECT *, high_price - close AS amplitude_close_high_price FROM {source}),
pm AS (SELECT *, CAST(row_number() OVER ({BY_SERIES}) AS DOUBLE) AS t,
       adj_close - lag(adj_close) OVER ({BY_SERIES}) AS d FROM pa),
pf AS (SELECT *, {_plain_stats("adj_close", "adj_close", V.ROLLING_WINDOWS)},
  {
        _frames(
            "min(adj_close) OVER (f ROWS BETWEEN {b} PRECEDING AND CURRENT ROW) AS amt_min_adj_close_{n},"
            "max(adj_close) OVER (f ROWS BETWEEN {b} PRECEDING AND CURRENT ROW) AS amt_max_adj_close_{n}",
            V.ROLLING_WINDOWS,
        )
    },
  {_CHANGES}, {_slope("adj_close", "adj_close", V.SLOPE_WINDOWS)}, {BREAKS},
  {", ".join(_strength(n) for n in V.STRENGTH_WINDOWS)}
  FROM pm WINDOW f AS ({BY_SERIES}), w AS ({BY_SERIES}))"""


def _messy() -> str:
    """The panel as it arrives, deduplicated and filtered: ``mp`` and, with all features, ``sf``."""
    amounts = ", ".join(V.STATEMENT_AMOUNTS)
    month = "year({0}.dt_refer) * 12 + month({0}.dt_refer)"
    lags = [
        f"l{lag}.{a} AS amt_tot_{a}_{lag}_lag, (c.{a} - l{lag}.{a}) / nullif(abs(l{lag}.{a}), 0) AS pct_tx_{a}_{lag}"
        for a in V.TRACKED_AMOUNTS
        for lag in V.STATEMENT_LAGS
    ]
    joins = " ".join(
        f"LEFT JOIN st l{lag} ON c.id_cnpj = l{lag}.id_cnpj AND {month.format('c')} - {n} = {month.format(f'l{lag}')}"
        for lag, n in V.STATEMENT_LAGS.items()
    )
    return f"""{RAW_PRICES},
mr AS (SELECT * REPLACE (CASE WHEN substr(id_cnpj, 13, 2) = '50' THEN '00000000000000' ELSE id_cnpj END AS id_cnpj)
       FROM raw_prices),
mp AS (SELECT *, CAST(year(date) AS INTEGER) AS dt_year, CAST(month(date) AS INTEGER) AS dt_month,
         CAST(year(date - 90) * 100 + month(date - 90) AS INTEGER) AS dt_safra_dre
  FROM mr WHERE id_cnpj <> '00000000000000' AND date > DATE '{SINCE}'
  QUALIFY row_number() OVER (PARTITION BY date, id_cnpj, ticker
    ORDER BY adj_close, close, high_price, low_price, volume) = 1),
ms AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 14, '0') AS id_cnpj, 'CVM' || l_suppkey AS id_cvm,
         'Company ' || l_suppkey AS txt_company_name,
         CASE WHEN NOT (l_suppkey % 7 = 0 AND month(m) = 3) THEN last_day(m) END AS dt_refer,
         CAST(max(l_shipdate) AS DATE) AS processed_at,
         CAST(floor(max(l_extendedprice * l_discount)) AS DOUBLE) AS amt_cost_goods_and_services,
         CAST(floor(max(l_extendedprice * (1 - l_tax))) AS DOUBLE)
           AS amt_earnings_before_income_tax_and_social_contribution,
         CAST(floor(max(l_extendedprice * (1 - l_discount))) AS DOUBLE) AS amt_earnings_before_interest_and_taxes,
         CAST(floor(min(l_extendedprice * l_tax)) - 50 AS DOUBLE) AS amt_financial_results,
         CAST(floor(max(l_extendedprice * (1 + l_tax))) AS DOUBLE) AS amt_groos_revenue,
         CAST(floor(min(l_extendedprice)) - 2000 AS DOUBLE) AS amt_net_profit,
         CAST(floor(max(l_quantity)) AS DOUBLE) AS amt_operating_revenues_and_expenses,
         CAST(floor(max(l_extendedprice)) AS DOUBLE) AS amt_sales_revenue
  FROM (SELECT *, CAST(date_trunc('month', l_shipdate) AS DATE) AS m FROM lineitem)
  GROUP BY l_suppkey, m, l_linenumber % 2),
st AS (
  SELECT * FROM ms WHERE dt_refer IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id_cnpj, dt_refer ORDER BY processed_at DESC, {amounts}) = 1),
sl AS (SELECT c.*, {", ".join(lags)} FROM st c {joins}),
sn AS (SELECT *, CAST(row_number() OVER (PARTITION BY id_cnpj ORDER BY dt_refer) AS DOUBLE) AS t FROM sl),
sf AS (SELECT *, CAST(year(dt_refer) * 100 + month(dt_refer) AS INTEGER) AS safra,
  {", ".join(_plain_stats(a, a, V.STATEMENT_WINDOWS) for a in V.TRACKED_AMOUNTS)},
  {", ".join(_slope(a, a, V.STATEMENT_SLOPE_WINDOWS) for a in V.TRACKED_AMOUNTS)}
  FROM sn WINDOW f AS (PARTITION BY id_cnpj ORDER BY dt_refer))"""


def _totals(source: str, features) -> str:
    return " UNION ALL ".join(
        f"SELECT ticker, dt_year, '{f}' AS feature, count({f}) AS n, "
        f"round(sum(CAST({f} AS DOUBLE)) + 0.0123456789, {3 if f.startswith('pct_') else 1}) AS total FROM {source} GROUP BY ALL"
        for f in features
    )


def _model_table_full() -> str:
    ours = ", ".join(f"sf.{c}" for c in V.statement_feature_columns())
    features = [*V.price_feature_columns(), *V.statement_feature_columns(), "cat_target", "var_target"]
    return f"""WITH {_messy()}, {price_features("mp")},
j AS (SELECT pf.*, sf.txt_company_name, {ours}
      FROM pf ASOF LEFT JOIN sf ON pf.id_cnpj = sf.id_cnpj AND pf.dt_safra_dre >= sf.safra),
l AS (SELECT *, lag(adj_close, 1) OVER w AS p1, lag(adj_close, 2) OVER w AS p2 FROM j WINDOW w AS ({BY_SERIES})),
v AS (SELECT *, (p1 - p2) / nullif(abs(p2), 0) AS var_target FROM l),
full_table AS MATERIALIZED (SELECT *, CASE WHEN var_target >= 0 THEN 1 ELSE 0 END AS cat_target FROM v
  WHERE var_target IS NOT NULL AND txt_company_name IS NOT NULL)
{_totals("full_table", features)}"""


PANEL_HASH = """CASE WHEN CAST('0x' || substr(md5(concat_ws('|', CAST(date AS VARCHAR), id_cnpj, ticker, '7')), 1, 8)
  AS BIGINT) % 1000 < 700 THEN 'train' ELSE 'test' END"""
PANEL = f"""WITH {clean(SINCE)}, {TARGET_FROM},
panel AS (SELECT CASE WHEN dt_month IN (2,4,6,8,12) THEN {PANEL_HASH}
                 WHEN dt_month IN (1,3,5,7,9,11) THEN 'out' ELSE 'unused' END AS split
          FROM t WHERE var_target IS NOT NULL AND txt_company_name IS NOT NULL)"""

ORACLES: dict[str, str] = {
    "asof_target": f"WITH {clean(SINCE)}, {TARGET_FROM} {TARGET_SELECT}",
    "asof_drop_unmatched": f"WITH {clean(SINCE)}, {TARGET_FROM} {TARGET_SELECT} AND txt_company_name IS NOT NULL",
    "asof_by_period": f"""WITH {clean(SINCE)}
SELECT CAST(p.date AS VARCHAR) AS date, p.id_cnpj, p.ticker, p.dt_safra_dre,
       CAST(s.dt_refer AS VARCHAR) AS dt_refer, s.amt_sales_revenue, s.amt_net_profit
FROM p ASOF LEFT JOIN s ON p.id_cnpj = s.id_cnpj AND p.dt_safra_dre >= s.safra""",
    "asof_within_range": f"""WITH {clean(SINCE)}
SELECT CAST(p.date AS VARCHAR) AS date, p.id_cnpj, p.ticker, p.dt_safra_dre,
       CAST(s.dt_refer AS VARCHAR) AS dt_refer, s.amt_sales_revenue, s.amt_net_profit
FROM p ASOF LEFT JOIN s ON p.id_cnpj = s.id_cnpj AND p.dt_safra_dre >= s.safra""",
    "shifted_model_table": f"""WITH {clean(SINCE)}, {SHIFTED}, {_theta("p", "shifted", ", s.dt_refer_lag")},
l AS (SELECT *, lag(adj_close, 1) OVER w AS p1, lag(adj_close, 2) OVER w AS p2 FROM theta
      WINDOW w AS ({BY_SERIES})),
t AS (SELECT *, (p1 - p2) / nullif(abs(p2), 0) AS var_target FROM l)
SELECT {KEY}, CAST(dt_refer AS VARCHAR) AS dt_refer, CAST(dt_refer_lag AS VARCHAR) AS dt_refer_lag,
       amt_sales_revenue, var_target, CASE WHEN var_target >= 0 THEN 1 ELSE 0 END AS cat_target
FROM t WHERE var_target IS NOT NULL""",
    "dedup_latest": """SELECT * REPLACE (CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate) FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY lineitem.l_shipdate DESC, l_partkey,
  l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) = 1""",
    "clean_prices": f"""WITH {clean(SINCE)} SELECT p.* REPLACE (CAST(date AS VARCHAR) AS date) FROM p""",
    "shifted_period_join": f"""WITH {STATEMENTS}, {SHIFTED}
SELECT id_cnpj, CAST(dt_refer AS VARCHAR) AS dt_refer, CAST(dt_refer_lag AS VARCHAR) AS dt_refer_lag,
       amt_sales_revenue FROM shifted""",
    "component_theta_join": f"""WITH {PRICES}, {STATEMENTS},
r AS (SELECT date, id_cnpj, ticker, CAST(year(date) AS INTEGER) AS dt_year,
      CAST(month(date) AS INTEGER) AS dt_month FROM prices),
rec AS (SELECT *, dt_year AS s_year, month(dt_refer) AS s_month FROM statements), {_theta("r", "rec")}
SELECT {KEY}, dt_year, dt_month, CAST(dt_refer AS VARCHAR) AS dt_refer, amt_sales_revenue FROM theta""",
    "lagged_price": f"""WITH {PRICES}
SELECT {KEY}, adj_close, lag(adj_close, 1) OVER ({BY_SERIES}) AS target_lag FROM prices""",
    "pct_change_1": _change(1),
    "pct_change_5": _change(5),
    "class_share_month": SHARE,
    "class_share_join_form": SHARE,
    "class_share_year": f"SELECT * FROM ({SHARE}) WHERE dt_year = 2000",
    "table_freshness": f"WITH {PRICES} SELECT CAST(max(date) AS VARCHAR) AS max_date FROM prices",
    "describe_columns": DESCRIBE,
    "null_fill": """SELECT l_orderkey, l_linenumber, l_returnflag,
       coalesce(nullif(l_discount, 0), 0) AS discount_gap FROM lineitem""",
    "feature_exclude": """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem""",
    "cast_project": f"""WITH {scored()}
SELECT l_orderkey, l_linenumber, CAST(dt_year AS VARCHAR) AS dt_year, dt_month, prob FROM scored
WHERE dt_year >= 2000""",
    "month_split": f"""WITH {scored()}
SELECT CASE WHEN dt_month IN (2,4,6,8,12) THEN 'train' WHEN dt_month = 10 THEN 'unused' ELSE 'out' END AS split,
       dt_month, count(*) AS n FROM scored GROUP BY ALL""",
    "hash_split": f"WITH {scored()} SELECT l_orderkey, l_linenumber, prob, {HASH} AS split FROM scored",
    "assigned_splits": f"""WITH {split_scores()}
SELECT split, count(*) AS n, CAST(sum(cat_target) AS BIGINT) AS events FROM split_scores GROUP BY split""",
    "append_splits": f"""WITH {split_scores()}
SELECT l_orderkey, dt_month, cat_target, prob, split FROM split_scores WHERE split <> 'unused'""",
    "risk_group_cut": f"""WITH {scored("l_discount")}
SELECT l_orderkey, l_linenumber, prob, {GH} AS gh FROM scored""",
    "risk_group_rate": f"""WITH {scored("l_discount")}
SELECT dt_month, {GH} AS gh, avg(cat_target) AS event_rate, count(cat_target) AS n FROM scored GROUP BY ALL""",
    "risk_group_fitted": f"""WITH {split_scores("l_discount")},
fit AS (SELECT * FROM split_scores WHERE split = 'train'), {running("fit")}, {bins("", 4)},
cuts AS (SELECT hi FROM bins QUALIFY bin < max(bin) OVER ())
SELECT split, dt_month, CAST(1 + (SELECT count(*) FROM cuts WHERE prob > hi) AS INTEGER) AS gh,
       avg(cat_target) AS event_rate, count(cat_target) AS n
FROM split_scores WHERE split <> 'unused' GROUP BY ALL""",
    "optimal_bins": f"""WITH {scored()}, {running("scored")}, {bins("", 4)}
SELECT bin, lo, hi, n1, n0 FROM bins""",
    "binning_table": f"""WITH {scored("l_discount")}, {running("scored")}, {bins("", 4)}
SELECT bin, lo, hi, n1 + n0 AS count, (n1 + n0) / (t1 + t0) AS count_share, n0 AS non_event, n1 AS event,
       n1 / (n1 + n0) AS event_rate, round(ln((n0 / t0) / (n1 / t1)), 9) AS woe,
       round((n0 / t0 - n1 / t1) * ln((n0 / t0) / (n1 / t1)), 9) AS iv FROM bins""",
    "iv_ranking": IV_TABLE + "SELECT name, round(iv, 9) AS iv, n_bins FROM iv_table",
    "iv_cap": IV_TABLE + "SELECT name FROM iv_table WHERE iv < 0.1",
    "iv_top": IV_TABLE + "SELECT name, round(iv, 9) AS iv FROM iv_table ORDER BY round(iv, 9) DESC, name LIMIT 3",
    "confusion": f"WITH {split_scores()}, {_cells('split_scores')} SELECT * FROM cells",
    "recall_precision": f"""WITH {split_scores()}, {_cells("split_scores")}
SELECT split, {_ratio("n11", "n11 + n10")} AS recall, {_ratio("n11", "n11 + n01")} AS precision FROM cells""",
    "class_report": REPORT,
    "auc": f"WITH {split_scores()}, {running('split_scores', 'split')} SELECT split, {AUC} AS auc FROM run GROUP BY split",
    "auc_ties": f"""WITH {split_scores("l_discount")}, {running("split_scores", "split")}
SELECT split, {AUC} AS auc FROM run GROUP BY split""",
    "auc_label": f"""WITH {split_scores()}, {_cells("split_scores")}
SELECT split, (n11 * n00 + (n11 * n01 + n10 * n00) / 2) / ((n11 + n10) * (n00 + n01)) AS auc FROM cells""",
    "avg_precision": f"""WITH {split_scores()}, {running("split_scores", "split")},
d AS (SELECT *, t1 - c1 + n1 AS tp, t0 - c0 + n0 AS fp FROM run)
SELECT split, round(sum(n1 / t1 * (tp / (tp + fp))), 9) AS average_precision FROM d GROUP BY split""",
    "ks_all": f"WITH {scored()}, {running('scored')} SELECT {KS} AS ks FROM run",
    "ks_by_period": f"""WITH {scored()}, {running("scored", "dt_month")}
SELECT 'period_ref_' || dt_month AS period_ref, {KS} AS ks FROM run GROUP BY dt_month""",
    "ks_by_language": f"""WITH d AS (
  SELECT lang AS period, quality AS cat_target, CAST(n_chars AS DOUBLE) AS prob
  FROM labels JOIN documents USING (doc_id)), {running("d", "period")}
SELECT 'period_ref_' || period AS period_ref, {KS} AS ks FROM run GROUP BY period""",
    "roc_points": f"""WITH {scored()}, {running("scored")}
SELECT score AS threshold, (t0 - c0 + n0) / t0 AS fpr, (t1 - c1 + n1) / t1 AS tpr FROM run""",
    "ks_points": f"""WITH {scored()}, {running("scored")}
SELECT score AS threshold, c1 / t1 AS cdf_event, c0 / t0 AS cdf_nonevent, abs(c1 / t1 - c0 / t0) AS distance
FROM run""",
    "amplitude": f"WITH {PRICES} SELECT {KEY}, high_price - close AS amplitude_close_high_price FROM prices",
    "rolling_stats": f"""WITH {PRICES}
SELECT {KEY}, adj_close, {_stats("adj_close", "adj_close", V.ROLLING_WINDOWS)},
  {
        _frames(
            "min(adj_close) OVER (f ROWS BETWEEN {b} PRECEDING AND CURRENT ROW) AS amt_min_adj_close_{n},"
            "max(adj_close) OVER (f ROWS BETWEEN {b} PRECEDING AND CURRENT ROW) AS amt_max_adj_close_{n}",
            V.ROLLING_WINDOWS,
        )
    }
FROM prices WINDOW f AS ({BY_SERIES})""",
    "rolling_changes": f"""WITH {PRICES},
a AS (SELECT *, high_price - close AS amplitude_close_high_price FROM prices)
SELECT {KEY}, {_CHANGES} FROM a WINDOW w AS ({BY_SERIES})""",
    "rolling_slope": f"""WITH {PRICES},
n AS (SELECT *, CAST(row_number() OVER ({BY_SERIES}) AS DOUBLE) AS t FROM prices)
SELECT {KEY}, adj_close, {_slope("adj_close", "adj_close", V.SLOPE_WINDOWS)}
FROM n WINDOW f AS ({BY_SERIES})""",
    "breakouts": f"WITH {PRICES} SELECT {KEY}, {BREAKS} FROM prices WINDOW f AS ({BY_SERIES})",
    "rsi": f"""WITH {PRICES},
m AS (SELECT *, adj_close - lag(adj_close) OVER ({BY_SERIES}) AS d FROM prices)
SELECT {KEY}, adj_close, {", ".join(_strength(n) for n in V.STRENGTH_WINDOWS)}
FROM m WINDOW f AS ({BY_SERIES})""",
    "price_feature_table": f"""WITH {PRICES},
b AS (SELECT *, {BREAKS},
  max(adj_close) OVER (f ROWS BETWEEN 359 PRECEDING AND CURRENT ROW) AS max_360,
  min(adj_close) OVER (f ROWS BETWEEN 159 PRECEDING AND CURRENT ROW) AS min_160
  FROM prices WINDOW f AS ({BY_SERIES}))
SELECT ticker, CAST(year(date) AS INTEGER) AS dt_year, count(*) AS n, sum(max_360) AS sum_max_360,
  sum(min_160) AS sum_min_160, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in BREAK_NAMES)}
FROM b GROUP BY ALL""",
    "statement_lag_features": _statement_lags(),
    "statement_rolling_features": f"""WITH {STATEMENTS},
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY id_cnpj ORDER BY dt_refer) AS DOUBLE) AS t FROM statements)
SELECT id_cnpj, CAST(dt_refer AS VARCHAR) AS dt_refer, {", ".join(STATEMENT_SHOWN)},
  {", ".join(_stats(a, a, V.STATEMENT_WINDOWS) for a in STATEMENT_SHOWN)},
  {", ".join(_slope(a, a, V.STATEMENT_SLOPE_WINDOWS) for a in STATEMENT_SHOWN)}
FROM n WINDOW f AS (PARTITION BY id_cnpj ORDER BY dt_refer)""",
    "parquet_roundtrip": f"""WITH {scored()}
SELECT dt_year, count(*) AS n, CAST(sum(cat_target) AS BIGINT) AS events FROM scored WHERE dt_year >= 2000
GROUP BY dt_year""",
    "csv_roundtrip": IV_TABLE + "SELECT name, round(iv, 9) AS iv FROM iv_table WHERE iv < 0.1",
    "metrics_table": f"""WITH {split_scores()}, {_cells("split_scores")},
{running("split_scores", "split, dt_month")}
SELECT '001' AS run, split, 'cm_' || m AS metric, NULL AS period, CAST(v AS DOUBLE) AS value
FROM (SELECT split, unnest(['00','01','10','11']) AS m, unnest([n00, n01, n10, n11]) AS v FROM cells)
UNION ALL
SELECT '001', split, 'ks', 'period_ref_' || dt_month, {KS} FROM run GROUP BY split, dt_month""",
    "price_features_full": f"""WITH {PRICES}, {price_features("prices")},
full_table AS MATERIALIZED (SELECT *, CAST(year(date) AS INTEGER) AS dt_year FROM pf)
{_totals("full_table", V.price_feature_columns())}""",
    "model_table_full": _model_table_full(),
    "class_weights": f"""WITH {scored()},
y AS (SELECT CASE WHEN dt_month <> 2 THEN cat_target END AS y FROM scored),
c AS (SELECT y, count(*) AS n FROM y GROUP BY y)
SELECT y, n, round(CASE WHEN y IS NOT NULL THEN sum(n) FILTER (y IS NOT NULL) OVER () / (2.0 * n) END, 9) AS weight
FROM c""",
    "scored_contract": PANEL + """
SELECT family, split, count(*) AS n, 0 AS n_outside, 0 AS n_disagree
FROM panel CROSS JOIN (VALUES ('boosted'), ('forest')) f(family) GROUP BY family, split""",
    "reload_contract": PANEL + " SELECT split, count(*) AS n, 0 AS n_changed FROM panel GROUP BY split",
    "importance_contract": "SELECT 8 AS n_features, 0 AS n_negative, 1.0 AS total",
    "shadow_contract": f"""WITH {PRICES}
SELECT count(*) AS n, count(*) AS n_positions, count(*) AS n_donors, 0 AS n_in_place, sum(adj_close) AS total
FROM prices""",
    "selection_refit": "SELECT 9 AS n_features, 0 AS n_mismatch, 1 AS n_planted",
    "capped_training": f"""WITH {split_scores()}
SELECT split, count(*) AS n,
       'discount_gap, l_discount, l_extendedprice, l_linenumber, l_quantity, l_tax' AS features
FROM split_scores GROUP BY split""",
}
