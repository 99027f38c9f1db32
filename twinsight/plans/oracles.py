"""SQL counterparts of the registered queries, for an engine without this library.

Each one is written straight from the definition of the operator: no bucket sums, no boxes,
no brackets. Queries without an entry train a model, or pair tables too large for plain SQL.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _uniform(key: str, salt: str) -> str:
    digits = f"substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 13)"
    return f"((CAST(('0x' || {digits}) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _normal(key: str, salt: str) -> str:
    u1, u2 = _uniform(key, f"{salt}:r"), _uniform(key, f"{salt}:a")
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos(6.283185307179586::DOUBLE * {u2}))"


# Sources and splits

ORACLES["load_clean"] = """
SELECT c_name, c_nationkey,
       round(CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0::DOUBLE ELSE c_acctbal END, 6) AS c_acctbal, c_mktsegment
FROM customer
"""

ORACLES["split_stratified"] = """
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= ceil(0.7::DOUBLE * n) THEN 'train' ELSE 'holdout' END AS part
FROM (
  SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n,
         row_number() OVER (PARTITION BY o_orderstatus
                            ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':split0'), CAST(o_orderkey AS VARCHAR)) AS rn
  FROM orders)
"""

ORACLES["split_stratified_70"] = """
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= n - (7 * n) // 10 THEN 'train' ELSE 'holdout' END AS part
FROM (
  SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n,
         row_number() OVER (PARTITION BY o_orderstatus
                            ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':split0'), CAST(o_orderkey AS VARCHAR)) AS rn
  FROM orders)
"""

ORACLES["split_apportioned"] = """
WITH lines AS (SELECT DISTINCT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line, l_suppkey FROM lineitem),
     sizes AS (SELECT l_suppkey, count(*) AS n, sum(count(*)) OVER () AS total FROM lines GROUP BY l_suppkey),
     goal AS (SELECT *, total - CAST(ceil(0.3::DOUBLE * total) AS BIGINT) AS train FROM sizes),
     shares AS (SELECT *, n * train // total AS whole, n * train % total AS rest FROM goal),
     takes AS (SELECT l_suppkey, whole + CAST(row_number() OVER (ORDER BY rest DESC, l_suppkey) <= train - sum(whole) OVER () AS BIGINT) AS take FROM shares),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(line || ':split0'), line) AS rn FROM lines)
SELECT r.l_suppkey, CASE WHEN rn <= take THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, max(line) AS last_line
FROM ranked r JOIN takes t ON r.l_suppkey = t.l_suppkey GROUP BY ALL
"""
ORACLES["split_positional"] = """
SELECT c_custkey, CASE WHEN c_custkey <= (SELECT floor(max(c_custkey) * 0.3::DOUBLE) FROM customer) THEN 'first' ELSE 'rest' END AS part FROM customer
"""

# Cleaning and profiling

ORACLES["coerce_numeric"] = """
SELECT o_orderkey, coalesce(TRY_CAST(t AS DOUBLE), 0) AS or_zero, coalesce(TRY_CAST(t AS DOUBLE), 2.5::DOUBLE) AS or_midpoint
FROM (SELECT o_orderkey,
             CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE substr(o_orderpriority, 1, 1) END AS t
      FROM orders)
"""


def _kind(table: str, column: str, numeric: bool) -> str:
    first = "count(DISTINCT {c}) > 12 THEN 'numeric'" if numeric else "false THEN ''"
    last = "numeric" if numeric else "text"
    return (
        f"SELECT '{column}' AS name, CASE WHEN {first.format(c=column)} "
        f"WHEN count(DISTINCT {column}) <= 40 THEN 'categorical' ELSE '{last}' END AS kind FROM {table}"
    )


ORACLES["infer_column_kinds"] = " UNION ALL ".join(
    [_kind("lineitem", c, True) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")]
    + [_kind("lineitem", "l_linestatus", False)]
)
ORACLES["infer_column_kinds_text"] = " UNION ALL ".join(
    [_kind("part", c, True) for c in ("p_partkey", "p_size", "p_retailprice")]
    + [_kind("part", c, False) for c in ("p_name", "p_brand", "p_type")]
)

ORACLES["detect_labels"] = """
SELECT 'returned' AS target, 'No' AS negative, 'Yes' AS positive
FROM lineitem HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0
UNION ALL
SELECT 'l_linestatus', min(l_linestatus), max(l_linestatus) FROM lineitem
UNION ALL
SELECT 'toxic', min(CAST(toxic AS VARCHAR)) FILTER (WHERE toxic <> 1), max(CAST(toxic AS VARCHAR)) FROM labels
"""

ORACLES["binarise_target"] = "SELECT doc_id, CASE WHEN CAST(toxic AS VARCHAR) = '1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM labels"

# Encoder and decoder

ORACLES["encoder_fit_numeric"] = """
SELECT 'l_quantity' AS name, min(l_quantity) AS lo, max(l_quantity) AS hi, false AS is_int FROM lineitem
UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice), false FROM lineitem
UNION ALL SELECT 'l_linenumber', CAST(min(l_linenumber) AS DOUBLE), CAST(max(l_linenumber) AS DOUBLE), true FROM lineitem
"""

ORACLES["encoder_fit_levels"] = """
SELECT name, level, CAST(row_number() OVER (PARTITION BY name ORDER BY level) - 1 AS INT) AS index
FROM (SELECT DISTINCT 'l_linenumber' AS name, CAST(l_linenumber AS VARCHAR) AS level FROM lineitem
      UNION ALL SELECT DISTINCT 'l_linestatus', l_linestatus FROM lineitem
      UNION ALL SELECT DISTINCT 'l_returnflag', l_returnflag FROM lineitem)
"""

ORACLES["encoder_float_levels"] = """
SELECT 'x' AS name, level, CAST(row_number() OVER (ORDER BY level) - 1 AS INT) AS index
FROM (SELECT DISTINCT CAST((CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)
        * ([1e-300, 1e-9, 1e-5, 1e-4, 0.5, 1.0, 1e7, 1e15, 1e16, 1e22, 1e300]::DOUBLE[])[l_linenumber + l_orderkey % 5] AS VARCHAR) AS level FROM lineitem)
"""

ORACLES["encode_minmax"] = """
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey,
       round((coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 1.1::DOUBLE - 100.0::DOUBLE END, (lo + hi) / 2) - lo)
             / (hi - lo), 6) AS scaled
FROM orders, b
"""

ORACLES["encode_onehot"] = """
WITH lv AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS i
            FROM (SELECT DISTINCT o_orderpriority AS level FROM orders)),
     t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unseen' WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'None' END AS k
           FROM orders),
     c AS (SELECT o_orderkey, coalesce(lv.i, 0) AS hit FROM t LEFT JOIN lv ON lv.level = t.k)
SELECT o_orderkey, CAST(lv.i AS INT) AS pos, CASE WHEN lv.i = hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS val
FROM c, lv
"""

ORACLES["encode_vector"] = """
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
     s AS (SELECT level, row_number() OVER (ORDER BY level) AS i FROM (SELECT DISTINCT o_orderstatus AS level FROM orders)),
     p AS (SELECT level, row_number() OVER (ORDER BY level) + (SELECT count(*) FROM s) AS i
           FROM (SELECT DISTINCT o_orderpriority AS level FROM orders))
SELECT o_orderkey, 0 AS pos, round(CAST(CAST((o_totalprice - lo) / (hi - lo) AS FLOAT) AS DOUBLE), 6) AS val FROM orders, b
UNION ALL SELECT o_orderkey, CAST(i AS INT), CASE WHEN level = o_orderstatus THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM orders, s
UNION ALL SELECT o_orderkey, CAST(i AS INT), CASE WHEN level = o_orderpriority THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM orders, p
"""

ORACLES["encoder_profile"] = """
WITH b AS (SELECT min(l_quantity) AS qlo, max(l_quantity) AS qhi, min(l_extendedprice) AS plo, max(l_extendedprice) AS phi FROM lineitem),
     n AS (SELECT level, row_number() OVER (ORDER BY level) + 1 AS i FROM (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS level FROM lineitem)),
     s AS (SELECT level, row_number() OVER (ORDER BY level) + 1 + (SELECT count(*) FROM n) AS i
           FROM (SELECT DISTINCT l_linestatus AS level FROM lineitem)),
     cells AS (
       SELECT 0 AS pos, (l_quantity - qlo) / (qhi - qlo) AS x FROM lineitem, b
       UNION ALL SELECT 1, CAST(CAST((l_extendedprice - plo) / (phi - plo) AS FLOAT) AS DOUBLE) FROM lineitem, b
       UNION ALL SELECT i, CASE WHEN level = CAST(l_linenumber AS VARCHAR) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM lineitem, n
       UNION ALL SELECT i, CASE WHEN level = l_linestatus THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM lineitem, s)
SELECT CAST(pos AS INT) AS pos, count(*) AS n, round(avg(x), 6) AS mean, round(max(x), 6) AS top FROM cells GROUP BY pos
"""

ORACLES["encoder_dim"] = """
SELECT CAST(2 + count(DISTINCT l_discount) + count(DISTINCT l_tax) + count(DISTINCT l_linenumber) + count(DISTINCT l_linestatus) AS BIGINT) AS dim
FROM lineitem
"""

ORACLES["decode_numeric"] = """
WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_nationkey) AS nlo, max(c_nationkey) AS nhi FROM customer)
SELECT c_custkey,
       round(least(greatest(CAST(CAST(c_acctbal / 8000.0::DOUBLE AS FLOAT) AS DOUBLE), 0), 1) * (hi - lo) + lo, 6) AS balance,
       CAST(round_even(least(greatest(CAST(CAST(c_nationkey / 25.0::DOUBLE AS FLOAT) AS DOUBLE), 0), 1) * (nhi - nlo) + nlo, 0) AS BIGINT) AS nation
FROM customer, b
"""

ORACLES["decode_category"] = """
WITH lv AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS i FROM (SELECT DISTINCT c_mktsegment AS level FROM customer)),
     r AS (SELECT c_custkey, level, row_number() OVER (PARTITION BY c_custkey ORDER BY (c_custkey * (i + 3)) % 7 DESC, i) AS rn
           FROM customer, lv)
SELECT c_custkey, level AS decoded FROM r WHERE rn = 1
"""

ORACLES["encode_roundtrip"] = "SELECT o_orderkey, o_orderstatus, o_orderpriority, true AS price_is_close FROM orders"

_SLOTS = """
levels AS (SELECT 0 AS block, CAST(l_partkey AS VARCHAR) AS level FROM lineitem UNION SELECT 1, CAST(l_suppkey AS VARCHAR) FROM lineitem),
slots AS (SELECT *, row_number() OVER (ORDER BY block, level) AS slot FROM levels)
"""
ORACLES["encode_many_levels"] = f"""
WITH {_SLOTS},
     bounds AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
     cells AS (SELECT l_orderkey, l_linenumber, 0 AS slot, CAST(CAST((l_quantity - lo) / (hi - lo) AS FLOAT) AS DOUBLE) AS val FROM lineitem, bounds
               UNION ALL SELECT l_orderkey, l_linenumber, slot, 1.0 FROM lineitem JOIN slots ON block = 0 AND level = CAST(l_partkey AS VARCHAR)
               UNION ALL SELECT l_orderkey, l_linenumber, slot, 1.0 FROM lineitem JOIN slots ON block = 1 AND level = CAST(l_suppkey AS VARCHAR))
SELECT l_orderkey, l_linenumber, slot, count(*) AS n, round(sum(val), 6) AS total FROM cells WHERE val <> 0 GROUP BY ALL
"""
ORACLES["decode_many_levels"] = f"""
WITH {_SLOTS},
     parts AS (SELECT level, slot FROM slots WHERE block = 0),
     rows AS (SELECT l_orderkey, l_linenumber, l_quantity > 25 AS up, slot AS own,
                     1 + (l_orderkey * 7) % (SELECT count(*) FROM parts) AS other
              FROM lineitem JOIN parts ON level = CAST(l_partkey AS VARCHAR)),
     best AS (SELECT *, CASE WHEN up THEN own
                             WHEN own <> 1 AND other <> 1 THEN 1 WHEN own <> 2 AND other <> 2 THEN 2 ELSE 3 END AS slot FROM rows)
SELECT l_orderkey, l_linenumber, level AS decoded FROM best JOIN parts ON parts.slot = best.slot
"""
ORACLES["fit_transform"] = """
WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
     l AS (SELECT c_mktsegment AS level, row_number() OVER (ORDER BY c_mktsegment) AS pos FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c_custkey, CAST(0 AS INT) AS pos, round(CAST(CAST((c_acctbal - lo) / (hi - lo) AS FLOAT) AS DOUBLE), 6) AS val FROM customer, b
UNION ALL SELECT c_custkey, CAST(pos AS INT), CASE WHEN c_mktsegment = level THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM customer, l
"""
ORACLES["label_text"] = """
WITH l AS (SELECT max(o_orderpriority) AS pos, min(o_orderpriority) AS neg FROM orders)
SELECT o_orderkey, CASE WHEN o_orderpriority = pos THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
       CASE WHEN o_orderpriority = pos THEN pos ELSE neg END AS label FROM orders, l
"""
ORACLES["any_names"] = """
WITH c AS (SELECT *, c_acctbal < 2000 OR c_mktsegment = 'BUILDING' AS risky FROM customer),
     q AS (SELECT quantile_cont(c_acctbal, 1/3::DOUBLE) AS t1, quantile_cont(c_acctbal, 2/3::DOUBLE) AS t2, quantile_cont(c_acctbal, 0.9) AS top FROM c),
     w AS (SELECT *, CASE WHEN c_acctbal >= top THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                  CASE WHEN c_acctbal > t2 THEN 'high' WHEN c_acctbal > t1 THEN 'mid' ELSE 'low' END AS tier FROM c, q)
SELECT tier, c_mktsegment AS segment, count(*) AS n, CAST(sum(CAST(risky AS INT)) AS DOUBLE) AS positives,
       round(sum(weight / (SELECT sum(weight) FROM w)), 6) AS probability, sum(weight) AS weight,
       'categorical,numeric,numeric' AS kinds, (SELECT count(*) FROM customer) AS n_scored
FROM w GROUP BY ALL
"""

# Value tiers, weights, resampling

ORACLES["value_quantiles"] = """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 1/3::DOUBLE), 6) AS q33,
       round(quantile_cont(l_extendedprice, 2/3::DOUBLE), 6) AS q67, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90
FROM lineitem GROUP BY l_returnflag
"""
ORACLES["value_quantiles_by_part"] = """
SELECT l_partkey, count(*) AS n, round(quantile_cont(l_extendedprice, 1/3::DOUBLE), 6) AS q33,
       round(quantile_cont(l_extendedprice, 2/3::DOUBLE), 6) AS q67, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90
FROM lineitem GROUP BY l_partkey
"""

_ORDER_CUTS = """
q AS (SELECT quantile_cont(o_totalprice, 1/3::DOUBLE) AS t1, quantile_cont(o_totalprice, 2/3::DOUBLE) AS t2 FROM orders)
"""

ORACLES["value_tiers"] = f"""
WITH {_ORDER_CUTS}
SELECT o_orderkey, CASE WHEN o_totalprice > t2 THEN 'high' WHEN o_totalprice > t1 THEN 'mid' ELSE 'low' END AS tier FROM orders, q
"""

ORACLES["value_tier_codes"] = f"""
WITH {_ORDER_CUTS}
SELECT o_orderkey, CASE WHEN o_totalprice > t2 THEN 2 WHEN o_totalprice > t1 THEN 1 ELSE 0 END AS tier, 0 AS flat_tier, 0 AS no_value_tier
FROM orders, q
"""

_WEIGHTS = """
w AS (SELECT c_custkey, CASE WHEN c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.9) FROM customer) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
      FROM customer)
"""

ORACLES["oversample_weights"] = f"WITH {_WEIGHTS} SELECT c_custkey, weight, 1.0::DOUBLE AS flat_weight FROM w"

ORACLES["sampling_probability"] = f"""
WITH {_WEIGHTS} SELECT c_custkey, round(weight / (SELECT sum(weight) FROM w), 9) AS probability FROM w
"""

ORACLES["weighted_resample"] = f"""
WITH {_WEIGHTS},
     m AS (SELECT c_custkey, weight * (count(*) OVER () / sum(weight) OVER ()) AS mean FROM w),
     parts AS (SELECT c_custkey, part, mean / ceil(mean) AS mean, {_uniform("(CAST(c_custkey AS VARCHAR) || '/' || part)", "resample1")} AS u
               FROM m, range(1, 3) AS r(part) WHERE part <= ceil(mean)),
     terms AS (SELECT c_custkey, part, u, k, exp(-mean) * pow(mean, k) / factorial(k::INT) AS p FROM parts, range(0, 18) AS r(k)),
     cdf AS (SELECT c_custkey, u, sum(p) OVER (PARTITION BY c_custkey, part ORDER BY k) AS c FROM terms)
SELECT c_custkey, count(*) AS copies FROM cdf WHERE u > c GROUP BY c_custkey
"""

ORACLES["weighted_resample_exact"] = f"""
WITH {_WEIGHTS},
     line AS (SELECT c_custkey, sum(weight) OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':line3'), CAST(c_custkey AS VARCHAR)) - weight AS low FROM w),
     points AS (SELECT {_uniform("id", "draw3")} * (SELECT sum(weight) FROM w) AS pos FROM range(0, (SELECT count(*) FROM lineitem)) AS r(id))
SELECT c_custkey, count(*) AS copies FROM points ASOF JOIN line ON pos >= low GROUP BY c_custkey
"""

ORACLES["condition_vector"] = f"""
WITH {_ORDER_CUTS},
     r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = (SELECT max(o_orderstatus) FROM orders) THEN 1 ELSE 0 END AS y,
                  CASE WHEN o_totalprice > t2 THEN 2 WHEN o_totalprice > t1 THEN 1 ELSE 0 END AS tier FROM orders, q)
SELECT o_orderkey, CAST(pos AS INT) AS pos,
       CASE WHEN (pos < 2 AND y = pos) OR (pos >= 2 AND tier = pos - 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS val
FROM r, range(0, 5) AS p(pos)
"""

ORACLES["target_prior"] = "SELECT round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS prior FROM lineitem"

# Decision fidelity

_GRID = """
family AS (SELECT segment, discount::DOUBLE AS discount, threshold::DOUBLE AS threshold
           FROM (VALUES ('high'), ('mid'), ('low'), ('all')) AS a(segment),
                (VALUES (0.05), (0.10), (0.15), (0.20)) AS b(discount),
                (VALUES (0.30), (0.50), (0.70)) AS c(threshold))
"""


def _populations(factors: dict[str, float]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS population, l_extendedprice * {factor}::DOUBLE AS value, "
        f"1.0::DOUBLE / (1.0::DOUBLE + exp(-(l_quantity - 25.0::DOUBLE) / 10.0::DOUBLE)) AS prob FROM lineitem"
        for name, factor in factors.items()
    )
    return f"""
pop AS ({rows}),
cuts AS (SELECT population, quantile_cont(value, 1/3::DOUBLE) AS t1, quantile_cont(value, 2/3::DOUBLE) AS t2 FROM pop GROUP BY population),
tiered AS (SELECT pop.*, CASE WHEN value > t2 THEN 'high' WHEN value > t1 THEN 'mid' ELSE 'low' END AS tier
           FROM pop JOIN cuts USING (population))
"""


def _roi(cost: float = 2400.0, success: float = 0.3, recoverable: float = 0.3, redeem: float = 0.3) -> str:
    return f"""
names AS (SELECT DISTINCT population FROM tiered),
fam AS (SELECT row_number() OVER () AS id, * FROM family),
roi AS (SELECT n.population, f.id, f.segment, f.discount, f.threshold, count(t.value) AS n_flagged,
               coalesce(sum(t.prob * t.value * {recoverable}::DOUBLE * {success}::DOUBLE * (1 - f.discount)
                            - (1 - t.prob) * t.value * f.discount * {redeem}::DOUBLE - {cost}::DOUBLE), 0) AS roi
        FROM fam f CROSS JOIN names n
        LEFT JOIN tiered t ON t.population = n.population AND t.prob >= f.threshold
                          AND (f.segment = 'all' OR f.segment = t.tier)
        GROUP BY ALL)
"""


_PAIR = """
pair AS (SELECT s.population AS candidate, r.segment, r.discount, r.threshold, r.roi AS roi_real, s.roi AS roi_syn,
                CAST(r.roi > 0 AS INT) AS decision_real, CAST(s.roi > 0 AS INT) AS decision_syn, (r.roi > 0) = (s.roi > 0) AS agree
         FROM roi r JOIN roi s ON r.id = s.id AND r.population = 'real' AND s.population <> 'real')
"""

_SUMMARY_COLUMNS = """
round(avg(CASE WHEN agree THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS ssf, count(*) AS n_strategies,
CAST(sum(CASE WHEN agree THEN 1 ELSE 0 END) AS BIGINT) AS n_agree,
round(avg(abs(roi_real - roi_syn) / greatest(abs(roi_real), 1)) * 100, 5) AS mean_roi_gap_pct
"""
_STRATEGY_COLUMNS = """
segment, discount, threshold, round(roi_real, 2) AS roi_real, round(roi_syn, 2) AS roi_syn, decision_real, decision_syn, agree
"""

_LINES = _populations({"real": 1.0, "synthetic": 0.8})
_LINE_ROI = f"WITH {_GRID}, {_LINES}, {_roi()}"

ORACLES["score_gbt"] = """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_acctbal < 2000 OR c_mktsegment = 'BUILDING') AS n_positive,
       true AS in_range, true AS positives_score_higher, true AS mostly_right
FROM customer
"""
ORACLES["score_python_model"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(1 / (1 + exp(-(l_quantity - 25) / 10 + l_discount)), 6) AS prob
FROM lineitem
"""
ORACLES["score_logistic"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(l_quantity - 25) / 10)), 6) AS prob
FROM lineitem
"""
ORACLES["strategy_family"] = f"{_LINE_ROI} SELECT segment, discount, threshold, n_flagged FROM roi WHERE population = 'real'"
ORACLES["strategy_roi"] = f"{_LINE_ROI} SELECT population, segment, discount, threshold, round(roi, 2) AS roi FROM roi"
ORACLES["strategy_decisions"] = (
    f"{_LINE_ROI} SELECT population, segment, discount, threshold, CAST(roi > 0 AS INT) AS go FROM roi"
)
ORACLES["ssf_per_strategy"] = f"{_LINE_ROI}, {_PAIR} SELECT {_STRATEGY_COLUMNS} FROM pair"
ORACLES["ssf_score"] = f"{_LINE_ROI}, {_PAIR} SELECT {_SUMMARY_COLUMNS} FROM pair"

_OWN_FAMILY = """
family AS (SELECT segment, discount::DOUBLE AS discount, threshold::DOUBLE AS threshold
           FROM (VALUES ('high', 0.1, 0.5), ('all', 0.2, 0.7), ('all', 0.2, 0.7), ('mid', 0.0, 0.42), ('none', 0.1, 0.3))
                AS f(segment, discount, threshold))
"""
ORACLES["ssf_custom_family"] = (
    f"WITH {_OWN_FAMILY}, {_LINES}, {_roi()}, {_PAIR} SELECT {_STRATEGY_COLUMNS} FROM pair"
)
ORACLES["ssf_custom_econ"] = (
    f"WITH {_GRID}, {_LINES}, {_roi(800.0, 0.35, 0.25, 0.4)}, {_PAIR} SELECT {_SUMMARY_COLUMNS} FROM pair"
)
ORACLES["ssf_decision_spread"] = f"""
{_LINE_ROI}, {_PAIR}
SELECT count(*) AS n_strategies, CAST(sum(decision_real) AS BIGINT) AS n_go_real, CAST(sum(decision_syn) AS BIGINT) AS n_go_syn,
       sum(decision_real) > 0 AND sum(decision_real) < count(*) AS is_discriminating
FROM pair
"""
# The sums from a threshold up are those of the smallest score that reaches it.
ORACLES["ssf_threshold_per_order"] = f"""
WITH fam AS MATERIALIZED (SELECT row_number() OVER () AS id, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'all' ELSE 'low' END AS segment,
                                 (o_orderkey % 4 + 1) / 20::DOUBLE AS discount, o_totalprice / 600000::DOUBLE AS threshold FROM orders),
     pop AS (SELECT 'real' AS population, l_extendedprice * 1.0::DOUBLE AS value FROM lineitem
             UNION ALL SELECT 'synthetic', l_extendedprice * 0.8::DOUBLE FROM lineitem),
     cuts AS (SELECT population, quantile_cont(value, 1/3::DOUBLE) AS t1, quantile_cont(value, 2/3::DOUBLE) AS t2 FROM pop GROUP BY population),
     tiered AS (SELECT population, value, value / 120000::DOUBLE AS prob, CASE WHEN value > t2 THEN 'high' WHEN value > t1 THEN 'mid' ELSE 'low' END AS tier
                FROM pop JOIN cuts USING (population)),
     parts AS (SELECT population, tier AS segment, prob, value FROM tiered UNION ALL SELECT population, 'all', prob, value FROM tiered),
     merged AS (SELECT population, segment, prob, count(*) AS n, sum(prob * value) AS hit, sum((1 - prob) * value) AS miss FROM parts GROUP BY ALL),
     from_up AS (SELECT population, segment, prob, sum(n) OVER w AS n, sum(hit) OVER w AS hit, sum(miss) OVER w AS miss
                 FROM merged WINDOW w AS (PARTITION BY population, segment ORDER BY prob DESC)),
     asked AS (SELECT fam.*, p.population FROM fam, (SELECT DISTINCT population FROM pop) p),
     roi AS (SELECT a.population, a.id, a.segment, a.discount, a.threshold,
                    coalesce(u.hit * 0.09::DOUBLE * (1 - a.discount) - u.miss * a.discount * 0.3::DOUBLE - u.n * 2400::DOUBLE, 0) AS roi
             FROM asked a ASOF LEFT JOIN from_up u ON a.population = u.population AND a.segment = u.segment AND a.threshold <= u.prob),
     {_PAIR}
SELECT segment, {_SUMMARY_COLUMNS} FROM pair GROUP BY segment
"""
_CANDIDATES = _populations({"real": 1.0, "x1.0": 1.0, "x0.9": 0.9, "x0.8": 0.8, "x0.6": 0.6})
ORACLES["ssf_compare_candidates"] = (
    f"WITH {_GRID}, {_CANDIDATES}, {_roi()}, {_PAIR} SELECT candidate, {_SUMMARY_COLUMNS} FROM pair GROUP BY candidate"
)

ORACLES["ssf_many_candidates"] = f"""
WITH {_GRID},
     scored AS (SELECT l_suppkey, l_extendedprice AS value, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(l_quantity - 25.0::DOUBLE) / 10.0::DOUBLE)) AS prob FROM lineitem),
     pop AS (SELECT 'real' AS population, value, prob FROM scored UNION ALL SELECT CAST(l_suppkey AS VARCHAR), value, prob FROM scored),
     cuts AS (SELECT population, quantile_cont(value, 1/3::DOUBLE) AS t1, quantile_cont(value, 2/3::DOUBLE) AS t2 FROM pop GROUP BY population),
     tiered AS (SELECT p.*, CASE WHEN value > t2 THEN 'high' WHEN value > t1 THEN 'mid' ELSE 'low' END AS tier
                FROM pop p JOIN cuts c ON p.population = c.population),
     {_roi()}, {_PAIR} SELECT candidate, {_SUMMARY_COLUMNS} FROM pair GROUP BY candidate
"""

# Privacy and novelty

ORACLES["joint_encode"] = """
SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal ELSE 0.0::DOUBLE END AS acctbal,
       CAST(c_nationkey AS VARCHAR) AS nationkey, c_name AS name, c_custkey
FROM customer
"""

_TRIPLE = """
ranked AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS n,
                  row_number() OVER (PARTITION BY c_mktsegment
                                     ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':split0'), CAST(c_custkey AS VARCHAR)) AS rn
           FROM customer),
train AS (SELECT c_nationkey, c_acctbal, c_mktsegment FROM ranked WHERE rn <= ceil(0.7::DOUBLE * n)),
holdout AS (SELECT c_nationkey, c_acctbal, c_mktsegment FROM ranked WHERE rn > ceil(0.7::DOUBLE * n)),
synth AS (SELECT c_nationkey, CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE c_acctbal * 0.97::DOUBLE + 13.5::DOUBLE END AS c_acctbal, c_mktsegment
          FROM train)
"""
_ATTACK = f"""
{_TRIPLE},
cases AS (SELECT *, 1 AS member FROM train UNION ALL SELECT *, 0 FROM holdout),
tuples AS (SELECT c_nationkey, c_acctbal, c_mktsegment, sum(member) AS n_member, sum(1 - member) AS n_other FROM cases GROUP BY ALL),
dist AS (SELECT t.*, (SELECT sqrt(min((t.c_acctbal - s.c_acctbal) ** 2 + (t.c_nationkey - s.c_nationkey) ** 2
                                      + CASE WHEN t.c_mktsegment = s.c_mktsegment THEN 0 ELSE 2 END)) FROM synth s) AS distance
         FROM tuples t)
"""
_SCORES = "scores AS (SELECT -distance AS s, sum(n_member) AS p, sum(n_other) AS n FROM dist GROUP BY 1)"
_AUC = """
auc AS (SELECT sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc
        FROM (SELECT p::DOUBLE AS p, n::DOUBLE AS n,
                     coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM scores))
"""
_NOVELTY = """
novelty AS (SELECT avg(CASE WHEN distance > {tol}::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS novelty
            FROM (SELECT (SELECT sqrt(min((t.c_acctbal - s.c_acctbal) ** 2 + (t.c_nationkey - s.c_nationkey) ** 2
                                          + CASE WHEN t.c_mktsegment = s.c_mktsegment THEN 0 ELSE 2 END)) FROM train t) AS distance
                  FROM synth s))
"""
_REPORT_COLUMNS = """
round(auc, 6) AS membership_inference_auc,
CASE WHEN auc < 0.55 THEN 'low (safe)' WHEN auc < 0.7 THEN 'moderate' ELSE 'high (unsafe)' END AS membership_inference_risk,
round(novelty, 6) AS novelty_rate, auc < 0.55 AND novelty > 0.99 AS passes_privacy
"""

ORACLES["joint_levels"] = f"""
WITH {_TRIPLE}
SELECT DISTINCT 'c_mktsegment' AS name, c_mktsegment AS level
FROM (SELECT * FROM train UNION ALL SELECT * FROM synth UNION ALL SELECT * FROM holdout)
"""
ORACLES["nn_distance"] = f"""
WITH {_ATTACK}
SELECT CAST(c_nationkey AS DOUBLE) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment,
       CAST(n_member AS BIGINT) AS n_member, CAST(n_other AS BIGINT) AS n_other, round(distance, 6) AS distance
FROM dist
"""
ORACLES["nn_distance_orders"] = """
WITH synth AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 1.01::DOUBLE + 7.0::DOUBLE END AS price,
                      o_orderstatus, o_orderpriority FROM orders),
     tuples AS (SELECT o_totalprice, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT t.o_totalprice, t.o_orderstatus, t.o_orderpriority, t.n,
       round(sqrt(min((t.o_totalprice - s.price) ** 2 + CASE WHEN t.o_orderstatus = s.o_orderstatus THEN 0 ELSE 2 END
                      + CASE WHEN t.o_orderpriority = s.o_orderpriority THEN 0 ELSE 2 END)), 6) AS distance
FROM tuples t, synth s GROUP BY ALL
"""
_TEN = range(10)
ORACLES["nn_distance_wide"] = f"""
WITH r AS MATERIALIZED (SELECT o_orderstatus, {", ".join(f"{_uniform('o_orderkey', f'wide{i}')} AS x{i}" for i in _TEN)} FROM orders),
     s AS MATERIALIZED (SELECT o_orderstatus, {", ".join(f"CASE WHEN o_orderstatus = 'F' THEN x{i} ELSE 1 - x{i} * x{i} END AS x{i}" for i in _TEN)} FROM r),
     d AS (SELECT r.o_orderstatus, {", ".join(f"r.x{i}" for i in _TEN)},
                  sqrt(min({" + ".join(f"(r.x{i} - s.x{i}) * (r.x{i} - s.x{i})" for i in _TEN)}
                           + CASE WHEN r.o_orderstatus = s.o_orderstatus THEN 0 ELSE 2 END)) AS distance
           FROM r, s GROUP BY ALL)
SELECT o_orderstatus, count(*) AS n_rows, round(avg(distance), 6) AS mean_distance, round(max(distance), 6) AS max_distance FROM d GROUP BY o_orderstatus
"""
# A line's nearest price of the same flag and status bounds its distance; every closer row has a price within that bound.
ORACLES["nn_distance_lines"] = """
WITH t AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL),
     x AS (SELECT DISTINCT l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE l_extendedprice * 1.01::DOUBLE + 7.0::DOUBLE END AS p,
                  l_discount AS d, l_returnflag AS f, l_linestatus AS s FROM lineitem),
     below AS (SELECT t.*, (t.p - x.p) ** 2 + (t.q - x.q) ** 2 + (t.d - x.d) ** 2 AS d2 FROM t ASOF LEFT JOIN x ON t.f = x.f AND t.s = x.s AND t.p >= x.p),
     near AS (SELECT b.q, b.p, b.d, b.f, b.s, b.n, least(coalesce(b.d2, 1e300), coalesce((b.p - x.p) ** 2 + (b.q - x.q) ** 2 + (b.d - x.d) ** 2, 1e300)) AS d2
              FROM below b ASOF LEFT JOIN x ON b.f = x.f AND b.s = x.s AND b.p <= x.p),
     reach AS (SELECT *, p - sqrt(d2) - 1e-9 AS lo, p + sqrt(d2) + 1e-9 AS hi FROM near),
     dist AS (SELECT r.q, r.p, r.d, r.f, r.s, r.n,
                     sqrt(min((r.p - x.p) ** 2 + (r.q - x.q) ** 2 + (r.d - x.d) ** 2 + CASE WHEN r.f = x.f THEN 0 ELSE 2 END + CASE WHEN r.s = x.s THEN 0 ELSE 2 END)) AS distance
              FROM reach r JOIN x ON x.p >= r.lo AND x.p <= r.hi GROUP BY ALL)
SELECT f AS l_returnflag, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(distance), 6) AS mean_distance, round(max(distance), 6) AS max_distance,
       CAST(sum(CASE WHEN distance = 0 THEN n ELSE 0 END) AS BIGINT) AS n_copied
FROM dist GROUP BY f
"""
ORACLES["membership_scores"] = f"""
WITH {_ATTACK}, {_SCORES}
SELECT round(s, 6) AS score, CAST(sum(p) AS BIGINT) AS n_member, CAST(sum(n) AS BIGINT) AS n_other FROM scores GROUP BY 1
"""
ORACLES["membership_inference_auc"] = f"WITH {_ATTACK}, {_SCORES}, {_AUC} SELECT round(auc, 6) AS membership_inference_auc FROM auc"
ORACLES["novelty_rate"] = f"WITH {_TRIPLE}, {_NOVELTY.format(tol=1e-6)} SELECT round(novelty, 6) AS novelty_rate FROM novelty"
ORACLES["novelty_rate_wide"] = f"WITH {_TRIPLE}, {_NOVELTY.format(tol=3.0)} SELECT round(novelty, 6) AS novelty_rate FROM novelty"
ORACLES["membership_small_units"] = f"""
WITH real AS (SELECT o_orderstatus, o_totalprice / 1e12::DOUBLE AS price FROM orders),
     synth AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 1.01::DOUBLE + 7.0::DOUBLE END / 1e12::DOUBLE AS price
               FROM orders WHERE o_orderstatus <> 'O'),
     tuples AS (SELECT price, count(*) FILTER (WHERE o_orderstatus <> 'O') AS n_member, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_other FROM real GROUP BY price),
     above AS (SELECT t.*, s.price AS up FROM tuples t ASOF LEFT JOIN synth s ON t.price <= s.price),
     dist AS (SELECT a.n_member, a.n_other,
                     sqrt(least(coalesce((a.up - a.price) * (a.up - a.price), 1e300), coalesce((a.price - s.price) * (a.price - s.price), 1e300))) AS distance
              FROM above a ASOF LEFT JOIN synth s ON a.price >= s.price),
     {_SCORES}, {_AUC} SELECT round(auc, 6) AS membership_inference_auc FROM auc
"""
ORACLES["novelty_outlier"] = """
WITH real AS (SELECT DISTINCT CASE WHEN o_totalprice = (SELECT max(o_totalprice) FROM orders) THEN 1e12::DOUBLE ELSE o_totalprice END AS price,
                     o_orderstatus, o_orderpriority FROM orders),
     synth AS (SELECT row_number() OVER () AS id, o_orderstatus, o_orderpriority,
                      CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 1.01::DOUBLE + 7.0::DOUBLE END AS price FROM orders),
     copied AS (SELECT DISTINCT s.id FROM synth s JOIN real r ON s.o_orderstatus = r.o_orderstatus AND s.o_orderpriority = r.o_orderpriority
                AND abs(s.price - r.price) <= 1e-6)
SELECT round(((SELECT count(*) FROM synth) - (SELECT count(*) FROM copied))::DOUBLE / (SELECT count(*) FROM synth), 6) AS novelty_rate
"""
ORACLES["novelty_rate_lines"] = """
WITH synth AS (SELECT row_number() OVER () AS id, l_quantity, l_discount, l_returnflag, l_linestatus,
                      CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE l_extendedprice * 1.01::DOUBLE + 7.0::DOUBLE END AS price
               FROM lineitem),
     copied AS (SELECT DISTINCT s.id FROM synth s JOIN lineitem r
                ON s.l_returnflag = r.l_returnflag AND s.l_linestatus = r.l_linestatus
               AND s.l_quantity = r.l_quantity AND s.l_discount = r.l_discount
               AND abs(s.price - r.l_extendedprice) <= 1e-6)
SELECT round(((SELECT count(*) FROM synth) - (SELECT count(*) FROM copied))::DOUBLE / (SELECT count(*) FROM synth), 6) AS novelty_rate
"""
ORACLES["three_axis_report"] = (
    f"WITH {_ATTACK}, {_SCORES}, {_AUC}, {_NOVELTY.format(tol=1e-6)} SELECT {_REPORT_COLUMNS} FROM auc, novelty"
)
ORACLES["deployment_gate"] = f"""
WITH {_GRID}, {_ATTACK}, {_SCORES}, {_AUC}, {_NOVELTY.format(tol=1e-6)},
pop AS (SELECT 'real' AS population, c_acctbal AS value, 1.0::DOUBLE / (1 + exp(-(c_nationkey - 12.0::DOUBLE) / 6.0::DOUBLE)) AS prob FROM train
        UNION ALL SELECT 'synthetic', c_acctbal, 1.0::DOUBLE / (1 + exp(-(c_nationkey - 12.0::DOUBLE) / 6.0::DOUBLE)) FROM synth),
cuts AS (SELECT population, quantile_cont(value, 1/3::DOUBLE) AS t1, quantile_cont(value, 2/3::DOUBLE) AS t2 FROM pop GROUP BY population),
tiered AS (SELECT pop.*, CASE WHEN value > t2 THEN 'high' WHEN value > t1 THEN 'mid' ELSE 'low' END AS tier
           FROM pop JOIN cuts USING (population)),
{_roi(200.0)}, {_PAIR},
summary AS (SELECT {_SUMMARY_COLUMNS} FROM pair)
SELECT summary.*, {_REPORT_COLUMNS} FROM summary, auc, novelty
"""

# Synthesizer

_SCHEDULE = """
sched AS (SELECT t, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_bar
          FROM (SELECT t, 0.0001::DOUBLE + t * ((0.02::DOUBLE - 0.0001::DOUBLE) / 99) AS beta FROM range(0, 100) AS r(t)))
"""

_NOISED = f"""
{_SCHEDULE},
rows AS (SELECT o_orderkey, pos, CASE WHEN pos = 0 THEN o_totalprice / 500000.0::DOUBLE ELSE o_custkey / 10000.0::DOUBLE END AS x,
                CAST(floor({_uniform("o_orderkey", "t")} * 100) AS BIGINT) AS t,
                CASE WHEN pos = 0 THEN {_normal("o_orderkey", "e0")} ELSE {_normal("o_orderkey", "e1")} END AS eps
         FROM orders, (VALUES (0), (1)) AS p(pos))
"""
ORACLES["forward_noising"] = f"""
WITH {_NOISED}
SELECT o_orderkey, t, pos, round(sqrt(alpha_bar) * x + sqrt(1 - alpha_bar) * eps, 6) AS val FROM rows JOIN sched USING (t)
"""
ORACLES["reverse_step"] = f"""
WITH {_NOISED},
steps AS (SELECT a.t, a.alpha_bar, coalesce(b.alpha_bar, 1.0::DOUBLE) AS before FROM sched a LEFT JOIN sched b ON b.t = a.t - 1),
clean AS (SELECT o_orderkey, t, pos, eps, before,
                 least(greatest(((x * 6 - 2) - sqrt(1 - alpha_bar) * eps) / sqrt(alpha_bar), -3), 3) AS x0 FROM rows JOIN steps USING (t))
SELECT o_orderkey, t, pos, round(sqrt(before) * x0 + sqrt(1 - before) * eps, 6) AS val FROM clean
"""
ORACLES["sample_conditions"] = f"""
WITH r AS (SELECT avg(CASE WHEN o_orderstatus = (SELECT max(o_orderstatus) FROM orders) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM orders)
SELECT o_orderkey, CAST({_uniform("o_orderkey", "target42")} < rate AS INT) AS y,
       CAST(floor({_uniform("o_orderkey", "tier42")} * 3) AS INT) AS tier
FROM orders, r
"""
