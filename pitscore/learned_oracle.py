"""The fits of :mod:`pitscore.learned` as plain SQL: every cut tried, every trial scored, every tail summed."""

from __future__ import annotations

from pitscore.learned import CELLS, SKETCHED
from pitscore.learned import ALPHA, LAM, LEAST_ROWS, LEAVES, RATE_CANDIDATES, RATE_FRACTIONS, TREE_FEATURES, VERDICT_ROUNDS
from pitscore.oracle import HASH, running, scored, split_scores

LINES = """
lines AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_quantity, nullif(l_discount, 0) AS discount_gap, l_tax,
         l_linenumber + CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END AS status_leak,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y
  FROM lineitem)"""
#: Stands for a missing value, below all others.
GONE = "-1e300"


def _level(k: int, gain: str, rows: str) -> str:
    """``best_k``: of the nodes in ``rows`` (rid, node) the best cut, if any raises the gain."""
    return f"""
h{k} AS (SELECT node, f, v, sum(s0) AS s0, sum(s1) AS s1, count(*) AS n FROM {rows} JOIN long USING (rid) GROUP BY ALL),
c{k} AS (SELECT node, f, v, sum(s0) OVER w AS l0, sum(s1) OVER w AS l1, sum(n) OVER w AS ln,
                sum(s0) OVER a AS t0, sum(s1) OVER a AS t1, sum(n) OVER a AS tn
         FROM h{k} WINDOW a AS (PARTITION BY node, f), w AS (PARTITION BY node, f ORDER BY v)),
g{k} AS (SELECT *, {gain} AS gain FROM c{k} WHERE ln >= {LEAST_ROWS} AND tn - ln >= {LEAST_ROWS}),
best{k} AS MATERIALIZED (SELECT * FROM g{k} WHERE gain > 0
         QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, v) = 1),
r{k} AS MATERIALIZED (SELECT p.rid, 2 * p.node + 1 + CASE WHEN long.v > b.v THEN 1 ELSE 0 END AS node
         FROM {rows} p JOIN best{k} b USING (node) JOIN long ON long.rid = p.rid AND long.f = b.f)"""


def _tree(stats: str, gain: str, value: str, kept: str) -> str:
    names = ", ".join(f"({i}, '{f}')" for i, f in enumerate(TREE_FEATURES))
    columns = " UNION ALL ".join(f"SELECT rid, {i} AS f, coalesce({f}, {GONE}) AS v, s0, s1 FROM s" for i, f in enumerate(TREE_FEATURES))
    return f"""WITH {LINES},
w AS (SELECT count(*) / (2.0 * sum(y)) AS w1, count(*) / (2.0 * sum(1 - y)) AS w0 FROM lines),
s AS MATERIALIZED (SELECT lines.*, {stats} FROM lines, w), long AS MATERIALIZED ({columns}),
names(f, name) AS (VALUES {names}), start AS (SELECT rid, 0 AS node FROM s),
{_level(0, gain, "start")}, {_level(1, gain, "r0")},
splits AS (SELECT * FROM best0 UNION ALL SELECT * FROM best1 WHERE {kept}),
nodes AS (SELECT node, rid FROM start UNION ALL SELECT node, rid FROM r0
          UNION ALL SELECT r1.node, rid FROM r1 WHERE (r1.node - 1) // 2 IN (SELECT node FROM splits)),
t AS (SELECT node, sum(s0) AS s0, sum(s1) AS s1, count(*) AS n FROM nodes JOIN s USING (rid) GROUP BY node)
SELECT CAST(t.node AS INTEGER) AS node, names.name AS feature, CASE WHEN splits.v > {GONE} THEN splits.v END AS threshold,
       round(coalesce(splits.gain, 0), 6) AS gain, t.n, CASE WHEN splits.node IS NULL THEN round({value}, 6) END AS value
FROM t LEFT JOIN splits ON splits.node = t.node LEFT JOIN names ON names.f = splits.f, w"""


def _soft(g: str) -> str:
    return f"greatest(abs({g}) - {ALPHA}, 0)"


def _quality(g: str, h: str) -> str:
    return f"{_soft(g)} * {_soft(g)} / ({h} + {LAM})"


BOOSTED = _tree(
    "CASE WHEN y = 1 THEN w1 * -0.5 ELSE w0 * 0.5 END AS s0, CASE WHEN y = 1 THEN w1 * 0.25 ELSE w0 * 0.25 END AS s1",
    f"0.5 * ({_quality('l0', 'l1')} + {_quality('(t0 - l0)', '(t1 - l1)')} - {_quality('t0', 't1')})",
    f"-sign(t.s0) * {_soft('t.s0')} / (t.s1 + {LAM})",
    "true",
)


def _impurity(a: str, b: str) -> str:
    """Of classes weighted alike in all, times the weight."""
    return f"(CASE WHEN {a} + {b} > 0 THEN 2 * ({a}) * ({b}) / ({a} + {b}) ELSE 0 END)"


BUDGETED = _tree(
    "CASE WHEN y = 0 THEN w0 ELSE 0 END AS s0, CASE WHEN y = 1 THEN w1 ELSE 0 END AS s1",
    f"({_impurity('t0', 't1')} - {_impurity('l0', 'l1')} - {_impurity('(t0 - l0)', '(t1 - l1)')}) / (SELECT count(*) FROM lines)",
    "t.s1 / (t.s0 + t.s1)",
    f"node IN (SELECT node FROM best1 ORDER BY gain DESC, node LIMIT {LEAVES - 2})",
)

TRIALS = ", ".join(f"({i}, '{p['column']}', {p['prior_rows']})" for i, (_, p) in enumerate(RATE_CANDIDATES))
SHARE = "CAST('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), '11')), 1, 8) AS BIGINT) % 1000"
VALUES = " UNION ALL ".join(f"SELECT rid, y, split, share, '{c}' AS c, coalesce(CAST({c} AS DOUBLE), -1) AS v FROM x" for c in TREE_FEATURES)


def _rung(k: int, fraction: float, alive: str) -> str:
    last = k == len(RATE_FRACTIONS) - 1
    return f"""
rate{k} AS (SELECT c, v, sum(y) AS s, count(*) AS n FROM vals WHERE split = 'train' AND share < {round(1000 * fraction)} GROUP BY c, v),
prior{k} AS (SELECT sum(y) / count(*) AS p FROM x WHERE split = 'train' AND share < {round(1000 * fraction)}),
score{k} AS (SELECT a.trial, o.y, coalesce((r.s + a.m * p) / (r.n + a.m), p) AS score
       FROM {alive} a JOIN vals o ON o.c = a.c AND o.split = 'test' LEFT JOIN rate{k} r ON r.c = o.c AND r.v = o.v, prior{k}),
count{k} AS (SELECT trial, score, sum(y) AS n1, sum(1 - y) AS n0 FROM score{k} GROUP BY trial, score),
run{k} AS (SELECT *, sum(n0) OVER (PARTITION BY trial ORDER BY score) AS c0 FROM count{k}),
auc{k} AS (SELECT trial, sum(n1 * (c0 - n0 / 2)) / (sum(n1) * sum(n0)) AS value FROM run{k} GROUP BY trial),
done{k} AS MATERIALIZED (SELECT trial, value, row_number() OVER (ORDER BY value DESC, trial)
       <= {"1" if last else "ceil(count(*) OVER () / 3)"} AS promoted FROM auc{k}),
alive{k} AS (SELECT t.* FROM trials t JOIN done{k} USING (trial) WHERE promoted)"""


def _halving() -> str:
    rungs, alive = [], "trials"
    for k, f in enumerate(RATE_FRACTIONS):
        rungs.append(_rung(k, f, alive))
        alive = f"alive{k}"
    rows = " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS rung, CAST(trial AS INTEGER) AS trial, CAST({f} AS DOUBLE) AS fraction, round(value, 9) AS value, promoted FROM done{k}"
        for k, f in enumerate(RATE_FRACTIONS)
    )
    return f"""WITH {LINES}, trials(trial, c, m) AS (VALUES {TRIALS}),
x AS MATERIALIZED (SELECT *, {HASH} AS split, {SHARE} AS share FROM lines), vals AS MATERIALIZED ({VALUES}),
{", ".join(rungs)} {rows}"""


VERDICTS = f"""WITH h AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS features, round(avg(l_quantity), 6) AS importance,
         CAST((CAST(sum(l_quantity) AS BIGINT) + count(*)) % {VERDICT_ROUNDS + 1} AS INTEGER) AS hits FROM lineitem GROUP BY l_suppkey),
tails AS (SELECT k, sum(factorial({VERDICT_ROUNDS}) / (factorial(CAST(i AS INTEGER)) * factorial(CAST({VERDICT_ROUNDS} - i AS INTEGER))))
                 / power(2, {VERDICT_ROUNDS}) AS p FROM range({VERDICT_ROUNDS + 1}) a(k), range({VERDICT_ROUNDS + 1}) b(i) WHERE i >= k GROUP BY k),
p AS (SELECT h.*, u.p AS up, d.p AS down FROM h JOIN tails u ON u.k = hits JOIN tails d ON d.k = {VERDICT_ROUNDS} - hits),
k AS (SELECT *, row_number() OVER (ORDER BY up, features) AS ku, row_number() OVER (ORDER BY down, features) AS kd, count(*) OVER () AS m FROM p),
l AS (SELECT coalesce(max(ku) FILTER (up <= ku / m * 0.1), 0) AS lu, coalesce(max(kd) FILTER (down <= kd / m * 0.1), 0) AS ld FROM k),
v AS (SELECT k.*, CASE WHEN ku <= lu AND up <= 0.1 / {VERDICT_ROUNDS} THEN 'confirmed'
                       WHEN kd <= ld AND down <= 0.1 / {VERDICT_ROUNDS} THEN 'rejected' ELSE 'tentative' END AS decision FROM k, l)
SELECT features, CAST(CASE decision WHEN 'confirmed' THEN 1 WHEN 'tentative' THEN 2
         ELSE 2 + row_number() OVER (PARTITION BY decision ORDER BY importance DESC, features) END AS INTEGER) AS rank,
       decision = 'confirmed' AS support, decision, hits, importance FROM v"""

def _curve(by: str, columns: str) -> str:
    group = f"{by}, " if by else ""
    return f"""d AS (SELECT *, floor((c1 + c0) * {CELLS} / (t1 + t0)) AS cell, round(abs(c1 / t1 - c0 / t0), 12) AS apart FROM run),
k AS (SELECT *, row_number() OVER (PARTITION BY {group}cell ORDER BY score DESC) AS a,
             row_number() OVER (PARTITION BY {group}cell ORDER BY score) AS f,
             row_number() OVER (PARTITION BY {group}cell ORDER BY apart DESC, score) AS b FROM d)
SELECT {group}score AS threshold, {columns} FROM k WHERE 1 IN (a, b, f)"""


def _supervised(depth: int) -> str:
    """Segments cut level by level after the score of the largest fall."""
    levels, rows = [], "z"
    for k in range(depth):
        levels.append(f"""
e{k} AS (SELECT *, min(c1 - n1) OVER w AS b1, min(c0 - n0) OVER w AS b0, max(c1) OVER w AS e1, max(c0) OVER w AS e0
         FROM {rows} WINDOW w AS (PARTITION BY node)),
f{k} AS (SELECT *, round({_impurity('e1 - b1', 'e0 - b0')} - {_impurity('c1 - b1', 'c0 - b0')} - {_impurity('e1 - c1', 'e0 - c0')}, 9) AS fall
         FROM e{k} WHERE c1 - b1 + c0 - b0 >= (t1 + t0) * 0.05 AND e1 - c1 + e0 - c0 >= (t1 + t0) * 0.05),
x{k} AS (SELECT node, score AS cut FROM f{k} WHERE fall > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY fall DESC, score) = 1),
z{k} AS MATERIALIZED (SELECT z.* REPLACE (z.node * 2 + CASE WHEN score > cut THEN 1 ELSE 0 END AS node) FROM {rows} z LEFT JOIN x{k} USING (node))""")
        rows = f"z{k}"
    return f"""WITH {scored()}, {running('scored')}, z AS MATERIALIZED (SELECT 0 AS node, score, n1, n0, c1, c0, t1, t0 FROM run),
{", ".join(levels)}
SELECT CAST(row_number() OVER (ORDER BY node) AS INTEGER) AS prebin, min(score) AS lo, max(score) AS hi,
       CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n0) AS BIGINT) AS n0 FROM {rows} GROUP BY node"""


SKETCH_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({e}) AS n_missing, round((count(*) - count({e})) / count(*) * 100, 9) AS pct_missing, true AS distinct_close FROM lineitem"
    for c, e in ((c, "nullif(l_discount, 0)" if c == "discount_gap" else c) for c in SKETCHED)
)

ORACLES: dict[str, str] = {
    "boosted_nodes": BOOSTED,
    "budgeted_nodes": BUDGETED,
    "halving_log": _halving(),
    "selection_verdicts": VERDICTS,
    "planted_contract": """SELECT family, 9 AS n_features, 'planted' AS first, true AS auc_above, true AS falls, true AS two_digits
FROM (VALUES ('boosted'), ('budgeted'), ('forest'), ('penalised')) f(family)""",
    "supervised_bins": _supervised(3),
    "roc_curve": f"WITH {split_scores()}, {running('split_scores', 'split')}, "
    + _curve("split", "(t0 - c0 + n0) / t0 AS fpr, (t1 - c1 + n1) / t1 AS tpr"),
    "ks_curve": f"WITH {scored()}, {running('scored')}, "
    + _curve("", "c1 / t1 AS cdf_event, c0 / t0 AS cdf_nonevent, abs(c1 / t1 - c0 / t0) AS distance"),
    "sketched_description": SKETCH_ROWS,
    "iv_from_sketches": f"WITH {LINES} SELECT unnest([{', '.join(repr(f) for f in TREE_FEATURES)}]) AS name, count(*) AS n_rows,"
    " unnest([f = 'status_leak' FOR f IN [" + ", ".join(repr(f) for f in TREE_FEATURES) + "]]) AS knows FROM lines",
    "search_contract": "SELECT 4 AS n_trials, true AS kept_best, true AS same_auc, true AS all_learned",
    "relevant_features": "SELECT 9 AS n_features, 1 AS n_planted, 0 AS n_odd",
}
