"""DuckDB twins of the queries, written against the raw tables.

Each text inlines the role view it needs as a common table expression.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

GAPS = """
gaps AS (
  SELECT o_orderkey, o_custkey,
    CAST(datesub('day', o_orderdate, coalesce(next_date, newest)) AS INTEGER) AS duration,
    CASE WHEN next_date IS NULL THEN 0 ELSE 1 END AS event,
    o_orderpriority AS priority, o_orderstatus AS status, c_mktsegment AS segment
  FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_date,
               (SELECT max(o_orderdate) FROM orders) AS newest FROM orders) o
  JOIN customer ON o_custkey = c_custkey)"""

CUSTOMERS = """
people AS (
  SELECT o_custkey,
    CAST(floor(datesub('day', first_order, last_order) / 30) AS INTEGER) AS duration,
    CASE WHEN last_order < (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY THEN 1 ELSE 0 END AS event,
    c_mktsegment AS segment, n_name AS nation, r_name AS region, c_acctbal AS acctbal, total_spend
  FROM (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total_spend FROM orders GROUP BY o_custkey) o
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

EVENT_GAPS = """
egaps AS (
  SELECT event_id, user_id, event_type AS kind,
    datesub('microsecond', ts, coalesce(next_ts, newest)) / 1e6 AS duration,
    CASE WHEN next_ts IS NULL THEN 0 ELSE 1 END AS event
  FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts,
               (SELECT max(ts) FROM events) AS newest FROM events) e)"""


def event_steps(view: str, groups: str = "") -> str:
    """Steps (groups, t, removed, observed, at_risk) of a role view."""
    lead = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    return f"""
steps AS (
  SELECT {lead}t, removed, observed,
    CAST(sum(removed) OVER ({part}ORDER BY t DESC) AS BIGINT) AS at_risk
  FROM (SELECT {lead}duration AS t, count(*) AS removed, CAST(sum(event) AS BIGINT) AS observed
        FROM {view} GROUP BY {lead}duration) c)"""


def curve(view: str, groups: str = "") -> str:
    """event_steps plus curve (groups, t, at_risk, observed, censored, survival, v) with its origin row."""
    lead = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    by = f"GROUP BY {groups} " if groups else ""
    return (
        event_steps(view, groups)
        + f""",
raw_curve AS (
  SELECT {lead}t, at_risk, observed, removed - observed AS censored,
    CASE WHEN observed = at_risk THEN 0.0
         ELSE exp(sum(CASE WHEN observed = at_risk THEN 0.0 ELSE ln(1 - observed / at_risk) END)
                  OVER ({part}ORDER BY t)) END AS survival,
    sum(CASE WHEN observed = at_risk THEN 0.0
             ELSE observed / (at_risk * CAST(at_risk - observed AS DOUBLE)) END)
        OVER ({part}ORDER BY t) AS v
  FROM steps),
curve AS (
  SELECT * FROM raw_curve
  UNION ALL
  SELECT {lead}0 AS t, max(at_risk) AS at_risk, 0 AS observed, 0 AS censored, 1.0 AS survival, 0.0 AS v
  FROM raw_curve {by}HAVING min(t) > 0)"""
    )


def r(expression: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0"


# erfc by its all-positive series, good to about 1e-15 absolute.
def erfc(x: str) -> str:
    return f"""(CASE WHEN {x} <= 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda k:
      exp(-({x}) * ({x}) + 2 * k * ln(2) + (2 * k + 1) * ln({x}) + lgamma(k + 1) - lgamma(2 * k + 2)))) END)"""


SQL["event_table"] = f"""
WITH {GAPS}, {event_steps('gaps')}
SELECT t, removed, observed, removed - observed AS censored, at_risk FROM steps"""

SQL["km_curve"] = f"""
WITH {GAPS}, {curve('gaps')}
SELECT t, at_risk, observed, {r('survival')} AS survival FROM curve"""

_BAND = "1.959963984540054 * sqrt(v) / ln(survival)"
SQL["km_confidence"] = f"""
WITH {EVENT_GAPS}, {curve('egaps')}
SELECT t, {r('survival')} AS survival,
  {r(f'CASE WHEN survival >= 1 THEN 1.0 WHEN survival <= 0 THEN 0.0 ELSE exp(-exp(ln(-ln(survival)) - {_BAND})) END')} AS lower,
  {r(f'CASE WHEN survival >= 1 THEN 1.0 WHEN survival <= 0 THEN 0.0 ELSE exp(-exp(ln(-ln(survival)) + {_BAND})) END')} AS upper
FROM curve"""

SQL["km_median"] = f"""
WITH {GAPS}, {curve('gaps', 'priority')},
bands AS (SELECT *,
  CASE WHEN survival >= 1 THEN 1.0 WHEN survival <= 0 THEN 0.0 ELSE exp(-exp(ln(-ln(survival)) - {_BAND})) END AS lower,
  CASE WHEN survival >= 1 THEN 1.0 WHEN survival <= 0 THEN 0.0 ELSE exp(-exp(ln(-ln(survival)) + {_BAND})) END AS upper
  FROM curve)
SELECT priority, min(t) FILTER (survival <= 0.5) AS median, min(t) FILTER (lower <= 0.5) AS earliest,
  min(t) FILTER (upper <= 0.5) AS latest
FROM bands GROUP BY priority"""

SQL["km_by_group"] = f"""
WITH {GAPS}, {curve('gaps', 'segment')}
SELECT segment, t, at_risk, observed, censored, {r('survival')} AS survival FROM curve"""

SQL["km_at_times"] = f"""
WITH {GAPS}, {curve('gaps', 'segment')}
SELECT 'BUILDING' AS segment, CAST(x AS DOUBLE) AS time,
  {r("coalesce((SELECT arg_max(survival, t) FROM curve WHERE segment = 'BUILDING' AND t <= x), 1.0)")} AS survival
FROM range(0, 10) g(x)"""

SQL["km_loglog"] = f"""
WITH {GAPS}, {curve('gaps', 'status')}
SELECT status, t, {r('ln(t)')} AS log_time, {r('ln(-ln(survival))')} AS log_log_survival
FROM curve WHERE t > 0 AND survival > 0 AND survival < 1"""

SQL["km_log_odds"] = f"""
WITH {CUSTOMERS}, {curve('people', 'region')}
SELECT region, t, {r('ln(t)')} AS log_time, {r('ln(1 - survival) / survival')} AS failure_odds_ref,
  {r('ln((1 - survival) / survival)')} AS log_odds
FROM curve WHERE t > 0 AND survival > 0 AND survival < 1"""


def logrank(arms: str) -> str:
    return f"""
c AS (SELECT variable, level, t, sum(e) AS d, count(*) AS removed FROM ({arms}) a GROUP BY ALL),
grid AS (
  SELECT g.variable, l.level, g.t, coalesce(c.d, 0) AS d, coalesce(c.removed, 0) AS removed
  FROM (SELECT DISTINCT variable, t FROM c) g
  JOIN (SELECT DISTINCT variable, level FROM c) l ON g.variable = l.variable
  LEFT JOIN c ON c.variable = g.variable AND c.level = l.level AND c.t = g.t),
risk AS (SELECT *, sum(removed) OVER (PARTITION BY variable, level ORDER BY t DESC) AS n FROM grid),
pairs AS (
  SELECT a.variable, a.level AS level_a, b.level AS level_b, CAST(a.d AS DOUBLE) AS da, CAST(a.n AS DOUBLE) AS na,
    CAST(b.n AS DOUBLE) AS nb, CAST(a.d + b.d AS DOUBLE) AS d, CAST(a.n + b.n AS DOUBLE) AS n
  FROM risk a JOIN risk b ON a.variable = b.variable AND a.t = b.t AND a.level < b.level
  WHERE a.d + b.d > 0),
every AS (
  SELECT a.variable, a.level AS level_a, b.level AS level_b
  FROM (SELECT DISTINCT variable, level FROM c) a JOIN (SELECT DISTINCT variable, level FROM c) b
    ON a.variable = b.variable AND a.level < b.level),
tests AS (
  SELECT variable, level_a, level_b,
    pow(sum(da - na * d / n), 2) / sum(CASE WHEN n > 1 THEN na * nb * d * (n - d) / (n * n * (n - 1)) ELSE 0 END) AS statistic
  FROM every LEFT JOIN pairs USING (variable, level_a, level_b) GROUP BY ALL)"""


SQL["logrank_pairwise"] = f"""
WITH {GAPS}, {logrank("SELECT 'priority' AS variable, priority AS level, duration AS t, event AS e FROM gaps")},
p AS (SELECT *, {erfc('sqrt(statistic / 2)')} AS p FROM tests)
SELECT variable, level_a, level_b, {r('statistic')} AS statistic, {r('p')} AS p, {r('-log2(p)', 4)} AS neg_log2_p FROM p"""

SQL["logrank_sweep"] = f"""
WITH {CUSTOMERS}, {logrank('''
  SELECT 'segment' AS variable, segment AS level, duration AS t, event AS e FROM people
  UNION ALL SELECT 'region', region, duration, event FROM people
  UNION ALL SELECT 'nation', nation, duration, event FROM people''')}
SELECT variable, level_a, level_b, {r('statistic')} AS statistic FROM tests"""


# --- sources, projections and filters --------------------------------------------

LINES = """
lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS CustomerID, o_orderkey AS InvoiceNo, o_orderdate AS InvoiceDate,
    l_quantity AS Quantity, l_extendedprice / l_quantity AS UnitPrice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

FEATURES = f"""{CUSTOMERS},
features AS (
  SELECT o_custkey AS CustomerID, duration AS Tenure, total_spend AS TotalSpend,
    total_spend / greatest(duration, 1) AS MonthlySpend, segment AS Segment, region AS Region,
    acctbal AS Balance, event AS ChurnBool
  FROM people)"""

SQL["scan_parquet"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
SQL["select_all"] = "SELECT * FROM orders"
SQL["schema_listing"] = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count({c}) AS filled FROM lineitem"
    for i, (c, t) in enumerate(
        [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
         ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
         ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
    )
)
SQL["preview"] = "SELECT * FROM customer ORDER BY c_custkey LIMIT 5"
SQL["clean_transactions"] = f"""
WITH {LINES}
SELECT CustomerID, count(*) AS lines, min(InvoiceDate) AS first, max(InvoiceDate) AS last FROM lines GROUP BY CustomerID"""
SQL["clean_raw_transactions"] = f"""
WITH {LINES},
raw AS (SELECT CAST(CAST(CustomerID AS DOUBLE) AS VARCHAR) AS CustomerID,
    CASE WHEN InvoiceNo % 5 <> 0 THEN strftime(InvoiceDate, '%Y-%m-%d') END AS day
  FROM lines WHERE CAST(CustomerID AS BIGINT) % 10 NOT IN (3, 7))
SELECT CustomerID, count(*) AS lines, count(day) AS dated, min(day) AS first, max(day) AS last FROM raw GROUP BY CustomerID"""
SQL["distinct_customers"] = f"WITH {LINES} SELECT DISTINCT CustomerID FROM lines"
SQL["churn_flag"] = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ChurnBool FROM lineitem"""
SQL["select_supported"] = f"""
WITH {FEATURES} SELECT Tenure, TotalSpend, MonthlySpend FROM features"""
SQL["one_hot"] = "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\""
    for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " FROM customer"
SQL["coerce_numeric"] = """
SELECT o_orderkey, TRY_CAST(CAST(o_orderkey AS VARCHAR) AS DOUBLE) AS good, TRY_CAST(o_orderpriority AS DOUBLE) AS bad FROM orders"""
SQL["fill_mode"] = """
WITH o AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
    CASE WHEN o_totalprice >= 20000 THEN CAST(floor(o_totalprice / 50000) AS BIGINT) END AS price_band FROM orders)
SELECT o_orderkey,
  coalesce(status, (SELECT status FROM o WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status,
  coalesce(price_band, (SELECT price_band FROM o WHERE price_band IS NOT NULL GROUP BY price_band
                        ORDER BY count(*) DESC, price_band LIMIT 1)) AS price_band
FROM o"""
SQL["sample_n"] = """
SELECT c_custkey, c_acctbal FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':460409061'), c_custkey LIMIT 100"""


def bucket(key: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % 100)"


SPLIT = f"""{FEATURES},
split_features AS (
  SELECT *, CASE WHEN {bucket('CustomerID')} < 60 THEN 'train' WHEN {bucket('CustomerID')} < 80 THEN 'val' ELSE 'test' END AS split
  FROM features)"""
SQL["stratified_split"] = f"""
WITH {FEATURES},
placed AS (SELECT CustomerID, ChurnBool, count(*) OVER (PARTITION BY ChurnBool) AS n, row_number() OVER (
  PARTITION BY ChurnBool ORDER BY CAST('0x' || substr(md5(CAST(CustomerID AS VARCHAR)), 1, 15) AS BIGINT)) AS place FROM features)
SELECT CustomerID, ChurnBool, CASE WHEN place <= (n * 60 + 50) // 100 THEN 'train' WHEN place <= (n * 80 + 50) // 100 THEN 'val' ELSE 'test' END AS split
FROM placed"""
SQL["hash_split"] = f"WITH {SPLIT} SELECT CustomerID, ChurnBool, split FROM split_features"


# --- recency, frequency, revenue ---------------------------------------------------

RFM = f"""{LINES},
rfm AS (
  SELECT CustomerID, datesub('day', max(InvoiceDate), (SELECT max(InvoiceDate) FROM lines)) AS Recency,
    count(InvoiceDate) AS Frequency, sum(UnitPrice * Quantity) AS Revenue
  FROM lines GROUP BY CustomerID)"""

LONG = """
long AS (
  SELECT 'Recency' AS measure, CustomerID, CAST(Recency AS DOUBLE) AS x FROM rfm
  UNION ALL SELECT 'Frequency', CustomerID, Frequency FROM rfm
  UNION ALL SELECT 'Revenue', CustomerID, Revenue FROM rfm)"""

CUTS = "list_transform(range(1, len(c)), lambda i: (c[i] + c[i + 1]) / 2)"


def lloyd(ks: str, max_iter: int) -> str:
    """fits (measure, k, c): converged centroids of every measure for k in `ks`."""
    return f"""{LONG},
hist AS MATERIALIZED (SELECT measure, x, count(*) AS n FROM long GROUP BY ALL),
spread AS MATERIALIZED (SELECT measure, sum(pow(x - m, 2) * n) / sum(n) AS v
  FROM (SELECT *, sum(x * n) OVER w / sum(n) OVER w AS m FROM hist WINDOW w AS (PARTITION BY measure)) GROUP BY measure),
lloyd AS (
  WITH RECURSIVE step(measure, k, it, c, moving) AS (
    SELECT measure, k, 0, list_sort(list_distinct(list_transform(range(0, k), lambda i:
        xs[1 + CAST(floor((len(xs) - 1) * ((2 * i + 1) / (2 * k))) AS BIGINT)]))), true
    FROM (SELECT measure, list(x ORDER BY x) AS xs FROM long GROUP BY measure), {ks} g(k)
    UNION ALL
    SELECT m.measure, k, it + 1, moved,
      list_sum(list_transform(range(1, len(c) + 1), lambda i: pow(moved[i] - c[i], 2))) > 1e-4 * v
    FROM (
      SELECT measure, k, it, c,
        list_transform(range(0, len(c)), lambda j: coalesce(list_extract(map_extract(means, j), 1), c[j + 1])) AS moved
      FROM (
        SELECT measure, k, it, c, map_from_entries(list((cluster, mean))) AS means
        FROM (
          SELECT s.measure, k, it, c, len(list_filter({CUTS}, lambda b: b < x)) AS cluster,
            sum(x * n) / sum(n) AS mean
          FROM step s JOIN hist h ON s.measure = h.measure
          WHERE moving AND it < {max_iter} GROUP BY ALL) a
        GROUP BY ALL) b) m
    JOIN spread ON m.measure = spread.measure)
  SELECT * FROM step),
fits AS MATERIALIZED (SELECT measure, k, arg_max(c, it) AS c FROM lloyd GROUP BY measure, k)"""


CLUSTERED = f"""{RFM}, {lloyd('(SELECT 4)', 300)},
member AS (
  SELECT CustomerID, measure, x,
    CAST(dense_rank() OVER (PARTITION BY measure ORDER BY cluster) - 1 AS INTEGER) AS up,
    CAST(dense_rank() OVER (PARTITION BY measure ORDER BY cluster DESC) - 1 AS INTEGER) AS down
  FROM (SELECT CustomerID, long.measure, x, len(list_filter({CUTS}, lambda b: b < x)) AS cluster
        FROM long JOIN fits ON long.measure = fits.measure) a)"""

SEGMENTED = f"""{CLUSTERED},
seg AS (
  SELECT *, CASE WHEN OverallScore > 4 THEN 'High-Value' WHEN OverallScore > 2 THEN 'Mid-Value' ELSE 'Low-Value' END AS Segment
  FROM (SELECT rfm.CustomerID, Recency, Frequency, Revenue, a.down AS RecencyCluster, b.up AS FrequencyCluster,
          c.up AS RevenueCluster, CAST(a.down + b.up + c.up AS INTEGER) AS OverallScore
        FROM rfm JOIN member a ON a.CustomerID = rfm.CustomerID AND a.measure = 'Recency'
        JOIN member b ON b.CustomerID = rfm.CustomerID AND b.measure = 'Frequency'
        JOIN member c ON c.CustomerID = rfm.CustomerID AND c.measure = 'Revenue') s)"""

SQL["last_purchase"] = f"""
WITH {LINES} SELECT CustomerID, max(InvoiceDate) AS MaxPurchaseDate, (SELECT max(InvoiceDate) FROM lines) AS Newest
FROM lines GROUP BY CustomerID"""
SQL["recency"] = f"WITH {RFM} SELECT CustomerID, Recency FROM rfm"
SQL["frequency"] = f"""
WITH {LINES} SELECT CustomerID, count(InvoiceDate) AS Frequency, count(DISTINCT InvoiceNo) AS Invoices FROM lines GROUP BY CustomerID"""
SQL["revenue"] = f"WITH {RFM} SELECT CustomerID, {r('Revenue', 2)} AS Revenue FROM rfm"
SQL["rfm_join"] = f"WITH {RFM} SELECT CustomerID, Recency, Frequency, {r('Revenue', 2)} AS Revenue FROM rfm"
SQL["top_customers"] = f"""
WITH {RFM} SELECT CustomerID, Recency, Frequency, {r('Revenue', 2)} AS Revenue FROM rfm
ORDER BY rfm.Revenue DESC, CustomerID LIMIT 5000"""

NICE_STEP = "CASE WHEN hi - lo <= 0 THEN 1.0 " + " ".join(
    f"WHEN floor(hi / ({m}.0 * p) + 1e-9) - floor(lo / ({m}.0 * p) + 1e-9) < 10 THEN {m}.0 * p" for m in (1, 2, 5, 10)
) + " ELSE 20.0 * p END"

SQL["histogram"] = f"""
WITH {RFM}, {LONG},
grid AS (SELECT measure, {NICE_STEP} AS step FROM (
  SELECT measure, min(x) AS lo, max(x) AS hi, pow(10, floor(log10((max(x) - min(x)) / 10))) AS p FROM long GROUP BY measure) g)
SELECT measure, floor(x / step + 1e-9) * step AS bin_start, (floor(x / step + 1e-9) + 1) * step AS bin_end, count(*) AS count
FROM long JOIN grid USING (measure) GROUP BY ALL"""

SQL["elbow"] = f"""
WITH {RFM}, {lloyd('range(1, 10)', 1000)}
SELECT f.measure, CAST(k AS INTEGER) AS k,
  printf('%.8e', sum(pow(x - c[1 + len(list_filter({CUTS}, lambda b: b < x))], 2) * n)) AS inertia
FROM fits f JOIN hist h ON f.measure = h.measure GROUP BY f.measure, k"""

SQL["kmeans_1d"] = f"WITH {CLUSTERED} SELECT CustomerID, up AS RevenueCluster FROM member WHERE measure = 'Revenue'"

SQL["order_cluster"] = f"""
WITH {CUSTOMERS},
ranks AS (SELECT nation, row_number() OVER (ORDER BY avg(acctbal) DESC, nation) - 1 AS nation_rank FROM people GROUP BY nation)
SELECT o_custkey, nation_rank FROM people JOIN ranks USING (nation)"""

SQL["describe_by_cluster"] = f"""
WITH {CLUSTERED}
SELECT measure, up AS cluster, count(*) AS count, {r('avg(x)', 4)} AS mean, {r('stddev_samp(x)', 4)} AS std, {r('min(x)', 4)} AS min,
  {r('quantile_cont(x, 0.25)', 4)} AS p25, {r('quantile_cont(x, 0.5)', 4)} AS p50, {r('quantile_cont(x, 0.75)', 4)} AS p75,
  {r('max(x)', 4)} AS max
FROM member GROUP BY measure, up"""

SQL["score_means"] = f"""
WITH {SEGMENTED} SELECT OverallScore, {r('avg(Recency)', 4)} AS Recency, {r('avg(Frequency)', 4)} AS Frequency,
  {r('avg(Revenue)', 4)} AS Revenue FROM seg GROUP BY OverallScore"""
SQL["segment_label"] = f"WITH {SEGMENTED} SELECT OverallScore, Segment, count(*) AS customers FROM seg GROUP BY ALL"
SQL["outlier_filter"] = f"""
WITH {RFM} SELECT CustomerID, Recency, Frequency, {r('Revenue', 2)} AS Revenue FROM rfm WHERE rfm.Revenue < 1800000 AND Frequency < 50"""
SQL["rfm_segments"] = f"WITH {SEGMENTED} SELECT * REPLACE ({r('Revenue', 2)} AS Revenue) FROM seg"
SQL["segment_scatter"] = f"""
WITH {SEGMENTED}, kept AS (SELECT * FROM seg WHERE Revenue < 1800000 AND Frequency < 50)
SELECT CustomerID, Segment, 'Frequency/Revenue' AS pair, CAST(Frequency AS DOUBLE) AS x, {r('Revenue', 2)} AS y FROM kept
UNION ALL SELECT CustomerID, Segment, 'Recency/Revenue', CAST(Recency AS DOUBLE), {r('Revenue', 2)} FROM kept
UNION ALL SELECT CustomerID, Segment, 'Recency/Frequency', CAST(Recency AS DOUBLE), CAST(Frequency AS DOUBLE) FROM kept"""
SQL["segment_scatter_binned"] = f"""
WITH {SEGMENTED},
points AS (
  SELECT Segment, 'Frequency/Revenue' AS pair, CAST(Frequency AS DOUBLE) AS x, Revenue AS y FROM seg
  UNION ALL SELECT Segment, 'Recency/Revenue', Recency, Revenue FROM seg
  UNION ALL SELECT Segment, 'Recency/Frequency', Recency, Frequency FROM seg),
box AS (SELECT pair, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY pair)
SELECT pair, Segment, CAST(least(floor((x - x0) / (x1 - x0) * 20), 19) AS INTEGER) AS x_bin,
  CAST(least(floor((y - y0) / (y1 - y0) * 20), 19) AS INTEGER) AS y_bin, count(*) AS customers
FROM points JOIN box USING (pair) GROUP BY ALL"""


# --- survival: Cox -------------------------------------------------------------------

GAP_ROWS = f"""{GAPS},
base AS (
  SELECT duration AS t, event AS e, segment,
    CASE WHEN priority = '1-URGENT' THEN 1.0 ELSE 0.0 END AS urgent,
    CASE WHEN segment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS building
  FROM gaps)"""

LAPSE_ROWS = f"""{CUSTOMERS},
base AS (
  SELECT o_custkey, duration AS t, event AS e,
    CASE WHEN segment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS building,
    CASE WHEN region = 'ASIA' THEN 1.0 ELSE 0.0 END AS asia
  FROM people)"""


def risk_sets(coef: dict[str, float]) -> str:
    """rs: per time d, s0, e0 and, per covariate, s1_<x>, e1_<x>, s2_<x>, e2_<x> (centred)."""
    centre = {x: f"({x} - (SELECT avg({x}) FROM base))" for x in coef}
    w = "exp(" + " + ".join(f"{b} * {centre[x]}" for x, b in coef.items()) + ")"
    own = ["sum(w) AS w0", "sum(e * w) AS e0"]
    cumulated = ["sum(w0) OVER (ORDER BY t DESC) AS s0", "e0"]
    for x in coef:
        own += [f"sum(w * z_{x}) AS w1_{x}", f"sum(e * w * z_{x}) AS e1_{x}",
                f"sum(w * z_{x} * z_{x}) AS w2_{x}", f"sum(e * w * z_{x} * z_{x}) AS e2_{x}"]
        cumulated += [f"sum(w1_{x}) OVER (ORDER BY t DESC) AS s1_{x}", f"e1_{x}",
                      f"sum(w2_{x}) OVER (ORDER BY t DESC) AS s2_{x}", f"e2_{x}"]
    return f"""
weighted AS (SELECT t, e, {', '.join(f'{x}, {z} AS z_{x}' for x, z in centre.items())}, {w} AS w FROM base),
own AS (SELECT t, sum(e) AS d, count(*) AS n, {', '.join(own)} FROM weighted GROUP BY t),
rs AS MATERIALIZED (SELECT t, CAST(d AS BIGINT) AS d, n, {', '.join(cumulated)} FROM own)"""


def hazard(coef: dict[str, float]) -> str:
    return risk_sets(coef) + """,
hz AS MATERIALIZED (SELECT t, sum(d / s0) OVER (ORDER BY t) AS h FROM rs)"""


def newton(strata: str = "'all'", weight: str = "1") -> str:
    """One 0/1 covariate `urgent` with Efron ties: fitted (beta, information) by recursion. `weight` is -1 for
    the rows of `base` that enter and 1 for those that leave."""
    return f"""
counts AS (SELECT {strata} AS s, t, sum(e) AS d, sum(e * urgent) AS d1, sum(urgent * {weight}) AS n1, sum({weight}) AS n FROM base GROUP BY ALL),
risk AS MATERIALIZED (
  SELECT s, t, CAST(d AS BIGINT) AS d, CAST(d1 AS DOUBLE) AS d1, d - d1 AS d0,
    CAST(sum(n1) OVER (PARTITION BY s ORDER BY t DESC) AS DOUBLE) AS r1,
    CAST(sum(n - n1) OVER (PARTITION BY s ORDER BY t DESC) AS DOUBLE) AS r0
  FROM counts),
tied AS MATERIALIZED (SELECT d, d1, d0, r1, r0, l FROM (SELECT *, unnest(range(d)) AS l FROM risk WHERE d > 0)),
fit AS (
  WITH RECURSIVE step(it, beta, info) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT it + 1, beta + (SELECT sum(d1) FROM risk) / i - g / i, i FROM (
      SELECT it, beta, sum(m) AS g, sum(m * (1 - m)) AS i FROM (
        SELECT it, beta, (r1 - l / d * d1) * exp(beta) / ((r0 - l / d * d0) + (r1 - l / d * d1) * exp(beta)) AS m
        FROM step, tied WHERE it < 12) a
      GROUP BY it, beta) b)
  SELECT * FROM step WHERE it = 12)"""


SQL["cox_fit"] = f"""
WITH {GAP_ROWS}, {newton()}
SELECT 'urgent' AS covariate, {r('beta', 5)} AS coef, {r('exp(beta)', 5)} AS exp_coef, {r('1 / sqrt(info)', 5)} AS se,
  {r('beta * sqrt(info)', 5)} AS z FROM fit"""
SQL["cox_stratified"] = f"""
WITH {GAP_ROWS}, {newton('segment')}
SELECT 'urgent' AS covariate, {r('beta', 5)} AS coef, {r('1 / sqrt(info)', 5)} AS se FROM fit"""

EPISODES = """
dated AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderpriority = '1-URGENT' AS urgent, o_totalprice / 100000 AS price
  FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL),
spans AS (SELECT id, min(day) AS first, max(day) AS last, (SELECT max(day) FROM dated) - max(day) AS quiet FROM dated GROUP BY id),
ends AS (SELECT id, first, (last - first) + least(quiet, 180) AS stop, CAST(quiet > 180 AS INTEGER) AS event FROM spans),
marks AS (SELECT id, day - first AS since, max(CAST(urgent AS INTEGER)) AS urgent, max(price) AS price, any_value(stop) AS stop, any_value(event) AS event
  FROM dated JOIN ends USING (id) GROUP BY ALL),
cut AS (SELECT *, lead(since) OVER (PARTITION BY id ORDER BY since) AS next FROM marks),
episodes AS (SELECT id, since AS start, coalesce(next, stop) AS stop, CASE WHEN next IS NULL THEN event ELSE 0 END AS event, urgent, price
  FROM cut WHERE since < stop)"""

SQL["order_episodes"] = f"""
WITH {EPISODES} SELECT id, CAST(start AS DOUBLE) AS start, CAST(stop AS DOUBLE) AS stop, event, urgent, price FROM episodes"""
SQL["cox_time_varying"] = f"""
WITH {EPISODES},
base AS (SELECT stop AS t, event AS e, urgent, 1 AS k FROM episodes UNION ALL SELECT start, 0, urgent, -1 FROM episodes), {newton(weight='k')}
SELECT 'urgent' AS covariate, {r('beta', 5)} AS coef, {r('exp(beta)', 5)} AS exp_coef, {r('1 / sqrt(info)', 5)} AS se,
  {r('beta * sqrt(info)', 5)} AS z FROM fit"""

PIECES = f"""{EPISODES},
knots(k, low, high) AS (VALUES (0, 0, 90), (1, 90, 180), (2, 180, 365), (3, 365, 730), (4, 730, 1460), (5, 1460, NULL)),
parts AS MATERIALIZED (
  SELECT k, low, high, CAST(sum(d) AS DOUBLE) AS d, CAST(sum(d * urgent) AS DOUBLE) AS d1,
    CAST(sum(s * urgent) AS DOUBLE) AS t1, CAST(sum(s * (1 - urgent)) AS DOUBLE) AS t0
  FROM (SELECT k, low, high, urgent, greatest(least(stop, coalesce(high, stop)) - greatest(start, low), 0) AS s,
          CASE WHEN stop > low AND stop <= coalesce(high, stop) THEN event ELSE 0 END AS d FROM episodes, knots) x
  GROUP BY ALL),
mean AS (SELECT sum(t1) / sum(t0 + t1) AS m FROM parts),
fit AS (
  WITH RECURSIVE step(it, beta, info) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT it + 1, beta + g / i, i FROM (
      SELECT it, beta, sum(d1 - d * m) AS g, sum(d * m * (1 - m)) AS i FROM (
        SELECT it, beta, d, d1, t1 * exp(beta) / (t0 + t1 * exp(beta)) AS m FROM step, parts WHERE it < 15 AND d > 0) a
      GROUP BY it, beta) b)
  SELECT * FROM step WHERE it = 15)"""
SQL["piecewise_coefficients"] = f"""
WITH {PIECES} SELECT 'urgent' AS covariate, {r('beta', 5)} AS coef, {r('exp(beta)', 5)} AS exp_coef, {r('1 / sqrt(info)', 5)} AS se,
  {r('beta * sqrt(info)', 5)} AS z FROM fit"""
SQL["piecewise_hazards"] = f"""
WITH {PIECES} SELECT CAST(low AS DOUBLE) AS lower, CAST(high AS DOUBLE) AS upper, t0 + t1 AS exposure, CAST(d AS BIGINT) AS events,
  {r('d / (t0 * exp(-beta * m) + t1 * exp(beta * (1 - m)))', 9)} AS hazard FROM parts, fit, mean"""
def above(u: str, power: int) -> str:
    """The one term of a restricted cubic spline with an inner knot `q`, or a third of its derivative."""
    return f"(greatest({u} - q, 0) ** {power} - (1 - q) * greatest({u}, 0) ** {power} - q * greatest({u} - 1, 0) ** {power})"


def spline(steps: int = 25) -> str:
    """Newton steps in (log time, knot, urgent); the constant is solved out, so the twin sums other terms than the fit."""
    names = ("1", "2", "3")
    moved = "c1 * {0}1 + c2 * {0}2 + c3 * {0}3"
    sums = [f"sum(n * (w * b{i} - w0 * a{i})) AS r{i}, sum(n * e * (b{i} + d{i} / sd)) AS g{i}" for i in names]
    sums += [f"sum(n * (w * b{i} * b{j} - w0 * a{i} * a{j})) AS r{i}{j}, sum(n * e * d{i} * d{j} / sd ** 2) AS s{i}{j}"
             for i in names for j in names if i <= j]
    solved = [f"g{i} - dead * r{i} / r AS h{i}" for i in names]
    solved += [f"s{i}{j} + dead * (r{i}{j} / r - r{i} * r{j} / r ** 2) AS m{i}{j}" for i in names for j in names if i <= j]
    cofactors = """m22 * m33 - m23 * m23 AS k11, m13 * m23 - m12 * m33 AS k12, m12 * m23 - m13 * m22 AS k13,
      m11 * m33 - m13 * m13 AS k22, m12 * m13 - m11 * m23 AS k23, m11 * m22 - m12 * m12 AS k33"""
    return f"""{EPISODES},
died AS (SELECT t, sum(n) OVER (ORDER BY t) AS c, sum(n) OVER () AS dead
  FROM (SELECT stop AS t, count(*) AS n FROM episodes WHERE event = 1 GROUP BY stop) x),
places AS (SELECT low, width, (mid - low) / width AS q FROM (
  SELECT ln(min(t)) AS low, ln(max(t)) - ln(min(t)) AS width, ln(min(CASE WHEN c >= ceil(0.5 * dead) THEN t END)) AS mid FROM died) x),
mean AS (SELECT avg(urgent) AS m FROM episodes),
scaled AS (SELECT start > 0 AS late, event AS e, (ln(stop) - low) / width AS u, (ln(CASE WHEN start > 0 THEN start ELSE 1 END) - low) / width AS v,
  urgent - m AS x, q, width FROM episodes, places, mean),
terms AS MATERIALIZED (SELECT late, e, u AS b1, {above('u', 3)} AS b2, x AS b3, v AS a1, {above('v', 3)} AS a2, x AS a3,
  1 / width AS d1, 3 / width * {above('u', 2)} AS d2, 0 AS d3, count(*) AS n FROM scaled GROUP BY ALL),
fit AS (
  WITH RECURSIVE step(it, c1, c2, c3, c0, e1, e2, e3) AS (
    SELECT 0, (SELECT width FROM places), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
    UNION ALL
    SELECT it + 1, c1 + (k11 * h1 + k12 * h2 + k13 * h3) / det, c2 + (k12 * h1 + k22 * h2 + k23 * h3) / det,
      c3 + (k13 * h1 + k23 * h2 + k33 * h3) / det, c0, k11 / det, k22 / det, k33 / det
    FROM (SELECT *, m11 * k11 + m12 * k12 + m13 * k13 AS det FROM (SELECT *, {cofactors} FROM (
      SELECT it, c1, c2, c3, ln(dead / r) AS c0, {', '.join(solved)} FROM (
        SELECT it, c1, c2, c3, sum(n * e) AS dead, sum(n * (w - w0)) AS r, {', '.join(sums)} FROM (
          SELECT *, exp({moved.format('b')}) AS w, CASE WHEN late THEN exp({moved.format('a')}) ELSE 0 END AS w0, c1 * d1 + c2 * d2 AS sd
          FROM step, terms WHERE it < {steps}) a
        GROUP BY it, c1, c2, c3) b) c) d) f)
  SELECT * FROM step WHERE it = {steps})"""


SQL["spline_coefficients"] = f"""
WITH {spline()}
SELECT 'log_time' AS covariate, {r('c1', 5)} AS coef, {r('sqrt(e1)', 5)} AS se FROM fit
UNION ALL SELECT 'knot_1', {r('c2', 5)}, {r('sqrt(e2)', 5)} FROM fit UNION ALL SELECT 'urgent', {r('c3', 5)}, {r('sqrt(e3)', 5)} FROM fit"""
SQL["spline_hazards"] = f"""
WITH {spline()},
placed AS (SELECT id, stop, urgent, (ln(stop) - low) / width AS u, q, width, c0, c1, c2, c3, urgent - m AS x FROM episodes, places, mean, fit),
risen AS (SELECT *, exp(c0 + c1 * u + c2 * {above('u', 3)} + c3 * x) AS h, (c1 + 3 * c2 * {above('u', 2)}) / width AS rise FROM placed)
SELECT id, CAST(stop AS DOUBLE) AS stop, urgent, {r('h', 6)} AS cumulative_hazard, {r('exp(-h)', 6)} AS survival, {r('rise * h / stop', 9)} AS hazard FROM risen"""
SQL["km_at_rows"] = f"""
WITH {CUSTOMERS}, {curve('people', 'segment')},
asked AS (SELECT o_custkey, segment, duration + o_custkey % 7 - 3 AS time FROM people)
SELECT a.o_custkey, a.segment, a.time, {r('coalesce(c.survival, 1.0)', 6)} AS survival
FROM asked a ASOF LEFT JOIN curve c ON a.segment = c.segment AND a.time >= c.t"""


def inverted(source: str, p: int, keep: str = "") -> str:
    """Select with a00.. of a p by p matrix in one row replaced by its inverse (Gauss-Jordan in place)."""
    for k in range(p):
        cells = []
        for i in range(p):
            for j in range(p):
                if i == k:
                    cell = f"1 / a{k}{k}" if j == k else f"a{k}{j} / a{k}{k}"
                else:
                    cell = f"-a{i}{k} / a{k}{k}" if j == k else f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k}"
                cells.append(f"{cell} AS a{i}{j}")
        source = f"(SELECT {keep}{', '.join(cells)} FROM {source})"
    return source


def newton_binary(base: str, names: tuple[str, ...], steps: int = 12) -> str:
    """Efron fit of up to three 0/1 covariates: final(b0.., i00.., ll) after `steps` Newton steps.

    Risk sets are counts per covariate pattern, so they do not depend on beta.
    """
    p, patterns = len(names), range(2 ** len(names))
    on = [[j for j in range(p) if m >> j & 1] for m in patterns]
    code = " + ".join(f"{1 << j} * CAST({x} AS INTEGER)" for j, x in enumerate(names))
    theta = [("exp(" + " + ".join(f"b{j}" for j in on[m]) + ")") if on[m] else "1.0" for m in patterns]
    at_risk = [f"(r{m} - l / d * d{m}) * {theta[m]}" for m in patterns]

    def total(*needed):
        return "(" + " + ".join(at_risk[m] for m in patterns if set(needed) <= set(on[m])) + ")"

    cells = [(j, k) for j in range(p) for k in range(j, p)]
    i = lambda j, k: f"i{min(j, k)}{max(j, k)}"
    if p == 1:
        inverse = {(0, 0): "1 / i00"}
    elif p == 2:
        det = "(i00 * i11 - i01 * i01)"
        inverse = {(0, 0): f"i11 / {det}", (0, 1): f"-i01 / {det}", (1, 1): f"i00 / {det}"}
    else:
        det = "(i00 * (i11 * i22 - i12 * i12) - i01 * (i01 * i22 - i12 * i02) + i02 * (i01 * i12 - i11 * i02))"
        inverse = {
            (0, 0): f"(i11 * i22 - i12 * i12) / {det}", (0, 1): f"(i02 * i12 - i01 * i22) / {det}",
            (0, 2): f"(i01 * i12 - i02 * i11) / {det}", (1, 1): f"(i00 * i22 - i02 * i02) / {det}",
            (1, 2): f"(i01 * i02 - i00 * i12) / {det}", (2, 2): f"(i00 * i11 - i01 * i01) / {det}",
        }
    inv = lambda j, k: f"({inverse[min(j, k), max(j, k)]})"
    moved = ", ".join(f"b{j} + " + " + ".join(f"{inv(j, k)} * g{k}" for k in range(p)) + f" AS b{j}" for j in range(p))
    bs, is_ = ", ".join(f"b{j}" for j in range(p)), ", ".join(i(j, k) for j, k in cells)
    zero = ", ".join(["0"] + ["CAST(0 AS DOUBLE)"] * (p + len(cells) + 1))
    return f"""
pattern AS (SELECT t, e, {code} AS m FROM {base}),
counted AS (SELECT t, sum(e) AS d, {', '.join(f'count(*) FILTER (m = {m}) AS n{m}, count(*) FILTER (m = {m} AND e = 1) AS d{m}' for m in patterns)} FROM pattern GROUP BY t),
sets AS MATERIALIZED (
  SELECT t, CAST(d AS BIGINT) AS d, {', '.join(f'CAST(d{m} AS DOUBLE) AS d{m}, CAST(sum(n{m}) OVER (ORDER BY t DESC) AS DOUBLE) AS r{m}' for m in patterns)} FROM counted),
ties AS MATERIALIZED (SELECT *, unnest(range(d)) AS l FROM sets WHERE d > 0),
deaths AS MATERIALIZED (SELECT {', '.join(f"sum({' + '.join(f'd{m}' for m in patterns if j in on[m])}) AS x{j}" for j in range(p))} FROM sets),
newton AS (
  WITH RECURSIVE step(it, {bs}, {is_}, ll) AS (
    SELECT {zero}
    UNION ALL
    SELECT it + 1, {moved}, {is_}, ll FROM (
      SELECT it, {bs}, {', '.join(f'any_value(x{j}) - sum(m{j}) AS g{j}' for j in range(p))},
        {', '.join(f'sum(q{j}{k} - m{j} * m{k}) AS {i(j, k)}' for j, k in cells)},
        {' + '.join(f'b{j} * any_value(x{j})' for j in range(p))} - sum(ln(s0)) AS ll
      FROM (
        SELECT it, {bs}, s0, {', '.join(f'{total(j)} / s0 AS m{j}' for j in range(p))},
          {', '.join(f'{total(j, k)} / s0 AS q{j}{k}' for j, k in cells)}
        FROM (SELECT *, {total()} AS s0 FROM step, ties WHERE it < {steps}) a) b, deaths
      GROUP BY it, {bs}) c)
  SELECT * FROM step),
final AS (SELECT *, {', '.join(f'sqrt({inv(j, j)}) AS se{j}' for j in range(p))} FROM newton WHERE it = {steps})"""


def coefficients(names: tuple[str, ...]) -> str:
    return "coefs AS (" + " UNION ALL ".join(
        f"SELECT '{x}' AS covariate, b{j} AS coef, se{j} AS se FROM final" for j, x in enumerate(names)
    ) + ")"


Z95 = "1.959963984540054"
GAP_FLAGS = f"""{GAPS},
base AS (
  SELECT duration AS t, event AS e, priority = '1-URGENT' AS urgent, segment = 'BUILDING' AS building, status = 'F' AS filled FROM gaps)"""
_FLAGS = ("urgent", "building", "filled")
SQL["cox_summary"] = f"""
WITH {GAP_FLAGS}, {newton_binary('base', _FLAGS)}, {coefficients(_FLAGS)},
tested AS (SELECT *, {erfc('abs(coef / se) / sqrt(2)')} AS p FROM coefs)
SELECT covariate, {r('coef', 5)} AS coef, {r('exp(coef)', 5)} AS exp_coef, {r('se', 5)} AS se,
  {r(f'coef - {Z95} * se', 5)} AS lower, {r(f'coef + {Z95} * se', 5)} AS upper,
  {r(f'exp(coef - {Z95} * se)', 5)} AS exp_lower, {r(f'exp(coef + {Z95} * se)', 5)} AS exp_upper,
  {r('coef / se', 5)} AS z, {r('p', 5)} AS p, {r('-log2(p)', 4)} AS neg_log2_p FROM tested"""

_TWO = ("building", "asia")
SQL["cox_metrics"] = f"""
WITH {CUSTOMERS},
base AS (SELECT duration AS t, event AS e, segment = 'BUILDING' AS building, region = 'ASIA' AS asia FROM people),
{newton_binary('base', _TWO)},
risks AS (SELECT t, e, -(b0 * building::INT + b1 * asia::INT) AS s, building, asia FROM base, final),
c AS (
  SELECT count(*) AS pairs, count(*) FILTER (NOT (a.building = b.building AND a.asia = b.asia) AND a.s < b.s) AS up,
    count(*) FILTER (a.building = b.building AND a.asia = b.asia) AS tied
  FROM risks a JOIN risks b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0))),
fits AS (SELECT (SELECT ll FROM newton WHERE it = 1) AS ll0, ll FROM final)
SELECT (SELECT count(*) FROM base) AS observations, (SELECT sum(e)::BIGINT FROM base) AS events, {r('ll', 5)} AS partial_log_likelihood,
  {r('(SELECT (up + tied / 2) / pairs FROM c)')} AS concordance, {r('4 - 2 * ll', 5)} AS partial_aic,
  {r('2 * (ll - ll0)', 5)} AS lr_statistic, 2 AS lr_df, {r('exp(ll0 - ll)', 5)} AS lr_p, {r('(ll - ll0) / ln(2)', 5)} AS lr_neg_log2_p
FROM fits"""

SQL["concordance"] = f"""
WITH {CUSTOMERS},
c AS (
  SELECT count(*) AS pairs, count(*) FILTER (a.acctbal < b.acctbal) AS concordant, count(*) FILTER (a.acctbal = b.acctbal) AS tied
  FROM people a JOIN people b ON a.event = 1 AND (b.duration > a.duration OR (b.duration = a.duration AND b.event = 0)))
SELECT *, {r('(concordant + tied / 2) / pairs', 9)} AS concordance FROM c"""

_GAP = {"urgent": 0.15, "building": -0.25}
_LAPSE = {"building": -0.3, "asia": 0.4}
_PROFILES = "(VALUES (0, 0, 0, 0.10), (1, 1, 0, 0.10), (2, 0, 1, 0.05), (3, 1, 1, 0.20)) p(row, building, asia, rate)"
_RISK = "exp(-0.3 * ({p}building - (SELECT avg(building) FROM base)) + 0.4 * ({p}asia - (SELECT avg(asia) FROM base)))"

SQL["baseline_hazard"] = f"""
WITH {GAP_ROWS}, {hazard(_GAP)} SELECT t, {r('h')} AS cumulative_hazard, {r('exp(-h)')} AS survival FROM hz"""
SQL["cox_predict"] = f"""
WITH {LAPSE_ROWS}, {hazard(_LAPSE)}
SELECT row, t, {r('exp(-h * ' + _RISK.format(p='p.') + ')')} AS survival FROM hz, {_PROFILES}"""
SQL["schoenfeld"] = f"""
WITH {GAP_ROWS}, {risk_sets(_GAP)},
centre AS (
  SELECT t, avg((s1_urgent - l / d * e1_urgent) / (s0 - l / d * e0)) AS urgent,
    avg((s1_building - l / d * e1_building) / (s0 - l / d * e0)) AS building
  FROM (SELECT *, unnest(range(d)) AS l FROM rs WHERE d > 0) GROUP BY t)
SELECT w.t, 'urgent' AS covariate, CAST(w.urgent AS DOUBLE) AS x, count(*) AS n, {r('avg(w.z_urgent - c.urgent)')} AS residual
FROM weighted w JOIN centre c ON w.t = c.t WHERE e = 1 GROUP BY ALL
UNION ALL
SELECT w.t, 'building', CAST(w.building AS DOUBLE), count(*), {r('avg(w.z_building - c.building)')}
FROM weighted w JOIN centre c ON w.t = c.t WHERE e = 1 GROUP BY ALL"""
SQL["ph_test"] = f"""
WITH {GAP_ROWS}, {risk_sets({'urgent': 0.15})},
terms AS (SELECT t, (s1_urgent - l / d * e1_urgent) / (s0 - l / d * e0) AS m,
    (s2_urgent - l / d * e2_urgent) / (s0 - l / d * e0) AS q
  FROM (SELECT *, unnest(range(d)) AS l FROM rs WHERE d > 0)),
centre AS (SELECT t, avg(m) AS m FROM terms GROUP BY t),
var AS (SELECT 1 / sum(q - m * m) AS v FROM terms),
times AS (
  SELECT t, sum(n) OVER (ORDER BY t) - (n - 1) / 2 AS rank,
    1 - exp(sum(CASE WHEN d = at_risk THEN -1e300 ELSE ln(1 - d / at_risk) END) OVER (ORDER BY t)) AS km
  FROM (SELECT t, d, n, sum(n) OVER (ORDER BY t DESC) AS at_risk FROM rs)),
res AS (
  SELECT g.transform, CASE WHEN g.transform = 'km' THEN km ELSE rank END AS g, z_urgent - centre.m AS r
  FROM weighted w JOIN centre ON w.t = centre.t JOIN times ON w.t = times.t, (VALUES ('km'), ('rank')) g(transform) WHERE e = 1),
tests AS (
  SELECT transform, pow(sum(g * r) - sum(g) / count(*) * sum(r), 2) * count(*) * any_value(v)
    / (sum(g * g) - pow(sum(g), 2) / count(*)) AS statistic
  FROM res, var GROUP BY transform)
SELECT 'urgent' AS covariate, transform, {r('statistic', 5)} AS statistic, {r(erfc('sqrt(statistic / 2)'), 5)} AS p FROM tests"""


def flag_tests(names: tuple[str, ...]) -> str:
    """tests(covariate, transform, statistic) of a fit of 0/1 covariates (see `newton_binary`)."""
    p, patterns = len(names), range(2 ** len(names))
    on = [[j for j in range(p) if m >> j & 1] for m in patterns]
    theta = [("exp(" + " + ".join(f"b{j}" for j in on[m]) + ")") if on[m] else "1.0" for m in patterns]
    left = [f"(r{m} - l / d * d{m}) * {theta[m]}" for m in patterns]
    means = ", ".join(
        f"avg(({' + '.join(left[m] for m in patterns if j in on[m])}) / ({' + '.join(left)})) AS m{j}" for j in range(p)
    )
    full = ", ".join(f"i{min(j, k)}{max(j, k)} AS a{j}{k}" for j in range(p) for k in range(p))
    patterns_ = " UNION ALL ".join(
        f"SELECT t, d{m} AS n, {', '.join(f'{int(j in on[m])} - m{j} AS r{j}' for j in range(p))} FROM sets JOIN centre USING (t) WHERE d{m} > 0"
        for m in patterns
    )
    scaled = " UNION ALL ".join(
        f"SELECT '{x}' AS covariate, t, n, {' + '.join(f'a{j}{k} * r{k}' for k in range(p))} AS v, a{j}{j} AS variance FROM residuals, inverse"
        for j, x in enumerate(names)
    )
    return f"""
centre AS (SELECT t, {means} FROM ties, final GROUP BY t),
inverse AS (SELECT * FROM {inverted(f'(SELECT {full} FROM final)', p)}),
residuals AS ({patterns_}),
scaled AS ({scaled}),
times AS (
  SELECT t, sum(n) OVER (ORDER BY t) - (n - 1) / 2 AS rank,
    1 - exp(sum(CASE WHEN d = at_risk THEN -1e300 ELSE ln(1 - d / at_risk) END) OVER (ORDER BY t)) AS km
  FROM (SELECT *, sum(n) OVER (ORDER BY t DESC) AS at_risk FROM (SELECT t, sum(e) AS d, count(*) AS n FROM base GROUP BY t))),
tests AS (
  SELECT covariate, transform, pow(sum(n * g * v) - sum(n * g) / sum(n) * sum(n * v), 2) * sum(n) / any_value(variance)
    / (sum(n * g * g) - pow(sum(n * g), 2) / sum(n)) AS statistic
  FROM (SELECT s.*, transform, CASE transform WHEN 'km' THEN km ELSE rank END AS g
        FROM scaled s JOIN times USING (t), (VALUES ('km'), ('rank')) f(transform))
  GROUP BY covariate, transform)"""


SQL["ph_report"] = f"""
WITH {GAP_FLAGS}, {newton_binary('base', _FLAGS)}, {flag_tests(_FLAGS)},
least AS (SELECT covariate, min({erfc('sqrt(statistic / 2)')}) AS p FROM tests GROUP BY covariate)
SELECT covariate, {r('p', 5)} AS p, p < 0.05 AS violates,
  CASE WHEN p < 0.05 THEN 'stratify on it, bin it, or let its effect vary with time' ELSE 'keep' END AS advice FROM least"""


SQL["smoothed_residuals"] = f"""
WITH {GAP_FLAGS}, {newton_binary('base', _FLAGS)}, {flag_tests(_FLAGS)}, {coefficients(_FLAGS)},
plot AS (SELECT covariate, n, v * (SELECT sum(e) FROM base) AS r, rank AS g FROM scaled JOIN times USING (t)),
ends AS MATERIALIZED (SELECT min(g) AS lo, max(g) - min(g) AS span FROM plot),
units AS (SELECT covariate, n, r, (g - lo) / span AS u, least(49, floor((g - lo) / span * 50)) AS bin FROM plot, ends),
near AS (
  SELECT covariate, n, r, point, u - (point + 0.5) / 50 AS u, pow(1 - pow(abs(bin - point) / 10.0::DOUBLE, 3), 3) AS w
  FROM units, range(50) p(point) WHERE abs(bin - point) < 10),
sums AS (
  SELECT covariate, point, sum(w * n) AS a0, sum(w * n * u) AS a1, sum(w * n * u * u) AS a2, sum(w * n * r) AS b0, sum(w * n * u * r) AS b1
  FROM near GROUP BY covariate, point)
SELECT covariate, {r('lo + span * (point + 0.5) / 50', 4)} AS g, {r('(a2 * b0 - a1 * b1) / (a0 * a2 - a1 * a1)', 4)} AS residual,
  {r('(a2 * b0 - a1 * b1) / (a0 * a2 - a1 * a1) + coef', 4)} AS effect FROM sums JOIN coefs USING (covariate), ends"""
SQL["hazard_ratios_flags"] = f"""
WITH {GAP_FLAGS}, {newton_binary('base', _FLAGS)}, {coefficients(_FLAGS)}
SELECT covariate, {r('exp(coef)', 5)} AS exp_coef, {r(f'exp(coef - {Z95} * se)', 5)} AS exp_lower,
  {r(f'exp(coef + {Z95} * se)', 5)} AS exp_upper FROM coefs"""

AFT_ROWS = f"""{CUSTOMERS},
cells AS MATERIALIZED (
  SELECT ln(duration + 0.5) AS y, event AS e, (segment = 'BUILDING')::INT AS x1, (region = 'ASIA')::INT AS x2,
    count(*) AS n FROM people GROUP BY ALL)"""
# first and second derivative of the log likelihood of one subject in the standard error z
AFT_TERMS = {
    "loglogistic": ("e - (1 + e) / (1 + exp(-z))", "-(1 + e) / (1 + exp(-z)) / (1 + exp(z))"),
    "weibull": ("e - exp(z)", "-exp(z)"),
    "lognormal": ("CASE WHEN e = 1 THEN -z ELSE -h END", "CASE WHEN e = 1 THEN -1 ELSE -h * (h - z) END"),
}
# log likelihood of one subject, but for e * (c - y)
AFT_VALUES = {
    "loglogistic": "e * z - (1 + e) * ln(1 + exp(z))",
    "weibull": "e * z - exp(z)",
    "lognormal": "CASE WHEN e = 1 THEN -z * z / 2 - ln(2 * pi()) / 2 ELSE -z * z / 2 - ln(2 * pi()) / 2 - ln(h) END",
}
# survival of the standard normal, by the sign of z, and its hazard h (of censored subjects only)
_SIDE = erfc("least(abs(z), 8) / sqrt(2)").replace("range(0, 200)", "range(0, 100)")
AFT_HAZARDS = {
    "loglogistic": "0.0", "weibull": "0.0",
    "lognormal": f"CASE WHEN e = 1 THEN 0.0 ELSE exp(-z * z / 2) / sqrt(2 * pi()) / (CASE WHEN z > 0 THEN {_SIDE} / 2 ELSE 1 - {_SIDE} / 2 END) END",
}


def aft_fit(family: str, steps: int = 400, name: str = "", free: tuple[int, ...] = (0, 1, 2, 3)) -> str:
    """<name>(b0, b1, b2, c): Newton steps in one parameter after the other, from the mean log time on."""
    u, w = AFT_TERMS[family]
    turn = f"list_extract({list(free)}, it % {len(free)} + 1)"
    return f"""
{name or family} AS MATERIALIZED (
  WITH RECURSIVE step(it, b0, b1, b2, c) AS (
    SELECT 0, (SELECT sum(n * y) / sum(n) FROM cells), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
    UNION ALL
    SELECT it + 1, b0 + CASE {turn} WHEN 0 THEN move ELSE 0 END, b1 + CASE {turn} WHEN 1 THEN move ELSE 0 END,
      b2 + CASE {turn} WHEN 2 THEN move ELSE 0 END, c + CASE {turn} WHEN 3 THEN move ELSE 0 END
    FROM (
      SELECT it, b0, b1, b2, c, greatest(-1, least(1, CASE {turn}
        WHEN 0 THEN sum(-n * u) / exp(c) / -sum(n * w) WHEN 1 THEN sum(-n * u * x1) / exp(c) / -sum(n * w * x1 * x1)
        WHEN 2 THEN sum(-n * u * x2) / exp(c) / -sum(n * w * x2 * x2)
        ELSE sum(n * (e + u * z)) / abs(sum(n * (w * z * z + u * z))) END)) AS move
      FROM (SELECT *, {u} AS u, {w} AS w FROM (SELECT *, {AFT_HAZARDS[family]} AS h FROM (
        SELECT step.*, cells.*, (y - (b0 + b1 * x1 + b2 * x2)) * exp(c) AS z FROM step, cells WHERE it < {steps})))
      GROUP BY it, b0, b1, b2, c))
  SELECT * FROM step WHERE it = {steps})"""


SQL["aft_coefficients"] = f"""
WITH {AFT_ROWS}, {aft_fit('loglogistic')}, {aft_fit('weibull')},
fits AS (SELECT 'loglogistic' AS family, * FROM loglogistic UNION ALL SELECT 'weibull', * FROM weibull)
SELECT family, unnest(['building', 'asia', 'Intercept', 'ln shape']) AS term,
  unnest([{r('b1', 4)}, {r('b2', 4)}, {r('b0', 4)}, {r('c', 4)}]) AS coef FROM fits"""
SQL["aft_median"] = f"""
WITH {AFT_ROWS}, {aft_fit('loglogistic')},
m AS (SELECT exp(any_value(b0) + any_value(b1) * sum(n * x1) / sum(n) + any_value(b2) * sum(n * x2) / sum(n)) AS median
      FROM cells, loglogistic)
SELECT 'loglogistic' AS family, {r('median', 3)} AS median, printf('%.2e', exp(median)) AS exp_median_ref FROM m"""


def aft_at(family: str, fit: str) -> str:
    """The rows with z and the terms of the likelihood at a fit."""
    u, w = AFT_TERMS[family]
    return f"""(SELECT *, {u} AS u, {w} AS w, {AFT_VALUES[family]} AS l FROM (SELECT *, {AFT_HAZARDS[family]} AS h FROM (
  SELECT cells.*, b0, b1, b2, c, (y - (b0 + b1 * x1 + b2 * x2)) * exp(c) AS z FROM {fit}, cells)))"""


def aft_table(rows: str, family: str, names: tuple[str, str], location: str, shape: str, columns: str) -> str:
    """Coefficients with their errors from the information at the maximum."""
    xs = ("1", "x1", "x2")
    cells = [f"sum(-n * w * {xs[i]} * {xs[j]} * exp(2 * c)) AS a{i}{j}" for i in range(3) for j in range(3)]
    cells += [f"sum(n * {xs[j]} * (w * z + u) * exp(c)) AS a{a}{b}" for j in range(3) for a, b in ((j, 3), (3, j))]
    cells += ["sum(-n * (w * z * z + u * z)) AS a33"]
    sign = "-" if family == "lognormal" else ""
    return f"""
WITH {rows}, {aft_fit(family)},
information AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, any_value(c) AS c, {', '.join(cells)} FROM {aft_at(family, family)}),
covariance AS (SELECT * FROM {inverted('information', 4, 'b0, b1, b2, c, ')}),
coefs AS (
  SELECT '{location}' AS parameter, '{names[0]}' AS covariate, b1 AS coef, sqrt(a11) AS se FROM covariance
  UNION ALL SELECT '{location}', '{names[1]}', b2, sqrt(a22) FROM covariance
  UNION ALL SELECT '{location}', 'Intercept', b0, sqrt(a00) FROM covariance
  UNION ALL SELECT '{shape}', 'Intercept', {sign}c, sqrt(a33) FROM covariance),
tested AS (SELECT *, CASE WHEN abs(coef / se) > 8 THEN 0 ELSE {erfc('abs(coef / se) / sqrt(2)')} END AS p FROM coefs)
SELECT {columns} FROM tested"""


_AFT_COLUMNS = f"""parameter, covariate, {r('coef', 4)} AS coef, {r('exp(coef)', 3)} AS exp_coef, {r('se', 4)} AS se,
  {r(f'coef - {Z95} * se', 4)} AS lower, {r(f'coef + {Z95} * se', 4)} AS upper"""
_AFT_TESTS = f"""{_AFT_COLUMNS}, {r(f'exp(coef - {Z95} * se)', 3)} AS exp_lower, {r(f'exp(coef + {Z95} * se)', 3)} AS exp_upper,
  {r('coef / se', 3)} AS z, {r('p', 4)} AS p"""
AFT_GAPS = f"""{GAPS},
cells AS MATERIALIZED (
  SELECT ln(duration + 0.5) AS y, event AS e, (priority = '1-URGENT')::INT AS x1, (segment = 'BUILDING')::INT AS x2,
    count(*) AS n FROM gaps GROUP BY ALL)"""
AFT_BALANCES = f"""{CUSTOMERS},
cells AS MATERIALIZED (
  SELECT ln(duration + 0.5) AS y, event AS e, (segment = 'BUILDING')::INT AS x1, (acctbal - mean) / std AS x2, count(*) AS n
  FROM people, (SELECT avg(acctbal) AS mean, stddev_pop(acctbal) AS std FROM people) GROUP BY ALL)"""
SQL["aft_loglogistic"] = aft_table(AFT_GAPS, "loglogistic", ("urgent", "building"), "alpha_", "beta_", _AFT_TESTS)
SQL["aft_lognormal"] = aft_table(AFT_ROWS, "lognormal", ("building", "asia"), "mu_", "sigma_", _AFT_TESTS)
SQL["aft_intervals"] = aft_table(
    AFT_ROWS, "weibull", ("building", "asia"), "lambda_", "rho_",
    f"parameter, covariate, {r('coef', 4)} AS coef, {r(f'coef - {Z95} * se', 4)} AS lower, {r(f'coef + {Z95} * se', 4)} AS upper",
)
SQL["aft_weibull"] = f"""
WITH {AFT_ROWS}, {aft_fit('weibull')}
SELECT unnest(['lambda_', 'lambda_', 'lambda_', 'rho_']) AS parameter, unnest(['building', 'asia', 'Intercept', 'Intercept']) AS covariate,
  unnest([{r('b1', 3)}, {r('b2', 3)}, {r('b0', 3)}, {r('c', 3)}]) AS coef FROM weibull"""


def aft_metrics(family: str) -> str:
    value = f"SELECT sum(n * (e * (c - y) + l)) FROM {{}}"
    return f"""
SELECT '{family}' AS family, (SELECT sum(n)::BIGINT FROM cells) AS observations, (SELECT sum(n * e)::BIGINT FROM cells) AS events,
  ({value.format(aft_at(family, family))}) AS ll, ({value.format(aft_at(family, family + '_null'))}) AS ll0,
  (SELECT (sum(a.n * b.n) FILTER (a.s < b.s) + coalesce(sum(a.n * b.n) FILTER (a.s = b.s), 0) / 2) / sum(a.n * b.n)
   FROM (SELECT *, b1 * x1 + b2 * x2 AS s FROM cells, {family}) a JOIN (SELECT *, b1 * x1 + b2 * x2 AS s FROM cells, {family}) b
     ON a.e = 1 AND (b.y > a.y OR (b.y = a.y AND b.e = 0))) AS concordance"""


SQL["aft_summary"] = f"""
WITH {AFT_BALANCES}, {', '.join(aft_fit(f, 160) + ', ' + aft_fit(f, 80, f + '_null', (0, 3)) for f in AFT_TERMS)},
found AS ({' UNION ALL '.join(aft_metrics(f) for f in AFT_TERMS)})
SELECT family, observations, events, {r('ll', 4)} AS log_likelihood, {r('concordance')} AS concordance, {r('8 - 2 * ll', 4)} AS aic,
  {r('2 * (ll - ll0)', 4)} AS lr_statistic, 2 AS lr_df, {r('exp(ll0 - ll)', 4)} AS lr_p, {r('(ll - ll0) / ln(2)', 4)} AS lr_neg_log2_p
FROM found"""


# --- lifetime value -----------------------------------------------------------------


def payback(horizon: int) -> str:
    return f"""{LAPSE_ROWS}, {hazard(_LAPSE)},
months AS (SELECT m, coalesce((SELECT max(h) FROM hz WHERE t <= m), 0) AS h FROM range(1, {horizon}) g(m)),
curves AS (
  SELECT row, rate, 0 AS m, CAST(1 AS DOUBLE) AS survival FROM {_PROFILES}
  UNION ALL SELECT row, rate, m, round_even(exp(-h * {_RISK.format(p='p.')}), 2) FROM months, {_PROFILES}),
priced AS (SELECT *, round_even(survival * 30, 2) AS expected FROM curves),
valued AS (SELECT *, round_even(expected / pow(1 + CAST(rate AS DOUBLE) / 12, m), 2) AS npv FROM priced),
pay AS (
  SELECT CAST(row AS INTEGER) AS scenario, CAST(m + 1 AS INTEGER) AS contract_month, survival, CAST(30 AS DOUBLE) AS monthly_profit,
    expected AS expected_profit, npv, sum(npv) OVER (PARTITION BY row ORDER BY m) AS cumulative_npv
  FROM valued)"""


SQL["clv_payback"] = f"""
WITH {payback(60)}
SELECT * REPLACE ({r('expected_profit', 2)} AS expected_profit, {r('npv', 2)} AS npv, {r('cumulative_npv', 2)} AS cumulative_npv) FROM pay"""
SQL["npv_milestones"] = f"""
WITH {payback(60)} SELECT scenario, contract_month, {r('cumulative_npv', 2)} AS cumulative_npv FROM pay WHERE contract_month IN (12, 24, 36)"""
SQL["clv_survival"] = f"WITH {payback(60)} SELECT scenario, contract_month, survival FROM pay"
SQL["payback_period"] = f"""
WITH {payback(60)} SELECT scenario, min(contract_month) FILTER (cumulative_npv >= 600) AS payback_month FROM pay GROUP BY scenario"""
SQL["customer_ltv"] = f"""
WITH {LAPSE_ROWS}, {hazard(_LAPSE)},
months AS (SELECT m, coalesce((SELECT max(h) FROM hz WHERE t <= m), 0) AS h FROM range(1, 36) g(m)),
risks AS (SELECT o_custkey, {_RISK.format(p='')} AS rr FROM base)
SELECT o_custkey, {r('any_value(rr)')} AS relative_risk,
  {r('30 + sum(round_even(round_even(round_even(exp(-h * rr), 2) * 30, 2) / pow(1 + 0.1::DOUBLE / 12, m), 2))', 2)} AS lifetime_value
FROM risks, months GROUP BY o_custkey"""


STRATA_HAZARD = f"""{CUSTOMERS},
base AS (SELECT o_custkey, region, duration AS t, event AS e, (segment = 'BUILDING')::INT AS building FROM people),
centre AS (SELECT avg(building) AS c FROM base),
own AS (SELECT region, t, CAST(sum(e) AS BIGINT) AS d, sum(exp(-0.3 * (building - c))) AS w FROM base, centre GROUP BY region, t),
hz AS MATERIALIZED (
  SELECT region, t, sum(d / s0) OVER (PARTITION BY region ORDER BY t) AS h
  FROM (SELECT region, t, d, sum(w) OVER (PARTITION BY region ORDER BY t DESC) AS s0 FROM own))"""


def strata_months(horizon: int) -> str:
    return f"""
months AS (
  SELECT r.region, m, coalesce((SELECT max(h) FROM hz WHERE hz.region = r.region AND t <= m), 0) AS h
  FROM (SELECT DISTINCT region FROM hz) r, range(1, {horizon}) g(m))"""


SQL["clv_payback_stratified"] = f"""
WITH {STRATA_HAZARD}, {strata_months(60)},
profiles AS (SELECT * FROM (VALUES (0, 0, 0.10), (1, 1, 0.05)) p(row, building, rate)),
curves AS (
  SELECT region, row, rate, 0 AS m, CAST(1 AS DOUBLE) AS survival FROM (SELECT DISTINCT region FROM hz), profiles
  UNION ALL SELECT region, row, rate, m, round_even(exp(-h * exp(-0.3 * (building - c))), 2) FROM months, profiles, centre),
priced AS (SELECT *, round_even(survival * 30, 2) AS expected FROM curves),
valued AS (SELECT *, round_even(expected / pow(1 + CAST(rate AS DOUBLE) / 12, m), 2) AS npv FROM priced)
SELECT region, CAST(row AS INTEGER) AS scenario, CAST(m + 1 AS INTEGER) AS contract_month, survival,
  CAST(30 AS DOUBLE) AS monthly_profit, {r('expected', 2)} AS expected_profit, {r('npv', 2)} AS npv,
  {r('sum(npv) OVER (PARTITION BY region, row ORDER BY m)', 2)} AS cumulative_npv FROM valued"""
SQL["customer_ltv_stratified"] = f"""
WITH {STRATA_HAZARD}, {strata_months(36)},
risks AS (SELECT o_custkey, region, exp(-0.3 * (building - c)) AS rr FROM base, centre)
SELECT o_custkey, {r('any_value(rr)')} AS relative_risk,
  {r('30 + sum(round_even(round_even(round_even(exp(-h * rr), 2) * 30, 2) / pow(1 + 0.1::DOUBLE / 12, m), 2))', 2)} AS lifetime_value
FROM risks JOIN months USING (region) GROUP BY o_custkey"""


# --- dataset profile ----------------------------------------------------------------

HOLES = """
holes AS (
  SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority, o_orderstatus AS status, 1 AS "constant" FROM orders)"""

NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
)
LONG_LINES = "lines AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM lineitem" for c in NUMBERS
) + ")"


def pairs(names) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


SQL["profile_overview"] = f"""
WITH {HOLES}
SELECT count(*) AS rows, 4 AS columns, CAST(sum((price IS NULL)::INT + (priority IS NULL)::INT) AS BIGINT) AS missing_cells,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT price, priority, status, "constant" FROM holes)) AS duplicate_rows,
  2 AS numeric_columns, 2 AS categorical_columns, 0 AS other_columns FROM holes"""
SQL["profile_numeric"] = f"""
WITH {LONG_LINES}
SELECT "column", count(*) AS count, 0::BIGINT AS missing, count(DISTINCT x) AS "distinct", {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS std,
  printf('%.8e', var_samp(x)) AS variance, {r('min(x)', 2)} AS min, {r('max(x)', 2)} AS max, {r('max(x) - min(x)', 2)} AS range,
  {r('sum(x)', 2)} AS sum, count(*) FILTER (x = 0) AS zeros, count(*) FILTER (x < 0) AS negatives, 0::BIGINT AS infinite,
  {r('stddev_samp(x) / avg(x)')} AS cv, {r('mad(x)')} AS mad, {r('skewness(x)')} AS skewness, {r('kurtosis(x)')} AS kurtosis
FROM lines GROUP BY "column" """
SQL["profile_quantiles"] = f"""
WITH {LONG_LINES}
SELECT "column", {', '.join(f"{r(f'quantile_cont(x, {p / 100})', 4)} AS p{p}" for p in (5, 25, 50, 75, 95))},
  {r('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 4)} AS iqr FROM lines GROUP BY "column" """
SQL["profile_categorical"] = f"""
WITH {HOLES}, v AS (SELECT 'priority' AS "column", priority AS x FROM holes UNION ALL SELECT 'status', status FROM holes),
top AS (SELECT "column", x, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY "column", x
        QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, x) = 1)
SELECT v."column", count(v.x) AS count, count(*) - count(v.x) AS missing, count(DISTINCT v.x) AS "distinct", any_value(top.x) AS mode,
  any_value(top.n) AS mode_count, CAST(min(length(v.x)) AS INTEGER) AS min_length, {r('avg(length(v.x))')} AS mean_length,
  CAST(max(length(v.x)) AS INTEGER) AS max_length
FROM v JOIN top ON v."column" = top."column" GROUP BY v."column" """
SQL["profile_common_values"] = """
WITH v AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS x FROM customer
  UNION ALL SELECT 'c_nationkey', CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR) FROM customer
  UNION ALL SELECT 'c_name', c_name FROM customer)
SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, x) AS INTEGER) AS rank, x AS value, count(*) AS count
FROM v GROUP BY "column", x QUALIFY rank <= 3"""
SQL["profile_extremes"] = f"""
WITH {LONG_LINES}, c AS (SELECT "column", x, count(*) AS n FROM lines GROUP BY ALL)
SELECT "column", 'smallest' AS "end", CAST(row_number() OVER (PARTITION BY "column" ORDER BY x) AS INTEGER) AS rank, x AS value, n AS count FROM c QUALIFY rank <= 5
UNION ALL
SELECT "column", 'largest', CAST(row_number() OVER (PARTITION BY "column" ORDER BY x DESC) AS INTEGER) AS rank, x, n FROM c QUALIFY rank <= 5"""
SQL["profile_histogram"] = f"""
WITH {LONG_LINES},
grid AS (SELECT "column", {NICE_STEP} AS step FROM (
  SELECT "column", min(x) AS lo, max(x) AS hi, pow(10, floor(log10((max(x) - min(x)) / 10))) AS p FROM lines GROUP BY "column") g)
SELECT "column", floor(x / step + 1e-9) * step AS bin_start, (floor(x / step + 1e-9) + 1) * step AS bin_end, count(*) AS count
FROM lines JOIN grid USING ("column") GROUP BY ALL"""
SQL["profile_dates"] = """
SELECT 'l_shipdate' AS "column", count(l_shipdate) AS count, count(*) - count(l_shipdate) AS missing,
  count(DISTINCT l_shipdate) AS "distinct", min(l_shipdate) AS first, max(l_shipdate) AS last,
  datesub('day', min(l_shipdate), max(l_shipdate)) AS range_days FROM lineitem"""
SKETCHED = {"o_orderkey": "number", "o_custkey": "number", "o_totalprice": "number", "price": "number", "o_orderpriority": "text"}
SQL["profile_sketch"] = "WITH o AS (SELECT *, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price FROM orders)" + " UNION ALL ".join(
    f"""
SELECT '{c}' AS "column", '{kind}' AS kind, count(*) AS rows, count({c}) AS count, count(*) - count({c}) AS missing, """
    + (
        f"""{r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})', 2)} AS min, {r(f'max({c})', 2)} AS max,
  CAST(NULL AS BIGINT) AS mode_count FROM o"""
        if kind == "number"
        else f"""CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
  (SELECT max(n) FROM (SELECT count(*) AS n FROM o GROUP BY {c})) FROM o"""
    )
    for c, kind in SKETCHED.items()
)
SQL["profile_missing"] = f"""
WITH {HOLES}""" + " UNION ALL ".join(
    f"""
SELECT '{c}' AS "column", count(*) - count("{c}") AS missing, {r(f'(count(*) - count("{c}")) / count(*)')} AS share FROM holes"""
    for c in ("o_orderkey", "price", "priority", "status", "constant")
)
SQL["profile_missing_correlation"] = f"""
WITH {HOLES}""" + " UNION ALL ".join(
    f"""
SELECT '{a}' AS a, '{b}' AS b, {r(f'corr(("{a}" IS NULL)::INT, ("{b}" IS NULL)::INT)')} AS value FROM holes"""
    if {a, b} == {"price", "priority"}
    else f"""
SELECT '{a}' AS a, '{b}' AS b, CAST(NULL AS DOUBLE) AS value"""
    for a, b in pairs(("o_orderkey", "price", "priority", "status", "constant"))
)
SQL["profile_correlation"] = (
    "WITH ranked AS (SELECT "
    + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in NUMBERS
    )
    + " FROM lineitem), cells AS (SELECT l_returnflag AS u, l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY ALL), "
    "margins AS (SELECT n, sum(n) OVER (PARTITION BY u) AS nu, sum(n) OVER (PARTITION BY v) AS nv FROM cells) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, 'pearson' AS method, {r(f'corr({a}, {b})')} AS value FROM lineitem "
        f"UNION ALL SELECT '{a}', '{b}', 'spearman', {r(f'corr({a}, {b})')} FROM ranked"
        for a, b in pairs(NUMBERS)
    )
    + f" UNION ALL SELECT 'l_returnflag', 'l_linestatus', 'cramers_v', "
    f"{r('sqrt((sum(n * n / (CAST(nu AS DOUBLE) * nv)) - 1) / (SELECT least(count(DISTINCT u), count(DISTINCT v)) - 1 FROM cells))')} FROM margins"
)
SQL["profile_correlation_holes"] = """
WITH h AS (
  SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN round(o_totalprice, -3) END AS price,
    CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 50 END AS bucket FROM orders)""" + " UNION ALL ".join(
    f"""
SELECT '{a}' AS a, '{b}' AS b, '{method}' AS method, {r('corr(x, y)')} AS value FROM (
  SELECT {x} AS x, {y} AS y FROM h WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
    for a, b in pairs(("o_orderkey", "price", "bucket"))
    for method, x, y in (
        ("pearson", a, b),
        ("spearman", *(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2" for c in (a, b))),
    )
)
SQL["profile_interactions"] = (
    "WITH box AS (SELECT "
    + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMBERS)
    + " FROM lineitem), placed AS (SELECT "
    + ", ".join(
        f"CAST(least(floor((CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c}) * 20), 19) AS INTEGER) AS {c}" for c in NUMBERS
    )
    + " FROM lineitem, box) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {a} AS a_bin, {b} AS b_bin, count(*) AS n FROM placed GROUP BY ALL"
        for a, b in pairs(NUMBERS)
    )
)
SQL["profile_alerts"] = f"""
WITH {HOLES},
s AS (
  SELECT 'o_orderkey' AS "column", count(o_orderkey) AS c, count(DISTINCT o_orderkey) AS d, count(*) AS n,
    count(*) FILTER (o_orderkey = 0) AS z, skewness(o_orderkey) AS k, false AS text FROM holes
  UNION ALL SELECT 'price', count(price), count(DISTINCT price), count(*), count(*) FILTER (price = 0), skewness(price), false FROM holes
  UNION ALL SELECT 'constant', count("constant"), count(DISTINCT "constant"), count(*), 0, NULL, false FROM holes
  UNION ALL SELECT 'priority', count(priority), count(DISTINCT priority), count(*), 0, NULL, true FROM holes
  UNION ALL SELECT 'status', count(status), count(DISTINCT status), count(*), 0, NULL, true FROM holes)
SELECT "column", 'constant' AS alert FROM s WHERE d = 1
UNION ALL SELECT "column", 'unique' FROM s WHERE d = c AND c > 1
UNION ALL SELECT "column", 'high cardinality' FROM s WHERE text AND d > 50
UNION ALL SELECT "column", 'mostly zero' FROM s WHERE z > 0.5 * c
UNION ALL SELECT "column", 'mostly missing' FROM s WHERE n - c > 0.5 * n
UNION ALL SELECT "column", 'skewed' FROM s WHERE abs(k) > 20
UNION ALL SELECT 'o_orderkey, price', 'highly correlated' FROM holes HAVING abs(corr(o_orderkey, price)) > 0.9
UNION ALL SELECT '(rows)', 'duplicates' FROM holes HAVING count(*) > count(DISTINCT o_orderkey)"""
SQL["profile_sample"] = """
SELECT * FROM (SELECT *, 'head' AS part FROM customer ORDER BY c_custkey LIMIT 10)
UNION ALL SELECT * FROM (SELECT *, 'tail' AS part FROM customer ORDER BY c_custkey DESC LIMIT 10)"""


# --- churn classifier ---------------------------------------------------------------

SCORED = f"""{SPLIT},
scored AS (
  SELECT *, 1 / (1 + exp(0.8 + 0.02 * Tenure - 0.00002 * MonthlySpend - 0.0000001 * TotalSpend)) AS probability FROM split_features),
labelled AS (SELECT *, CASE WHEN probability >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM scored)"""

SQL["impute_mean"] = f"""
WITH {SPLIT}
SELECT CustomerID, {r("CASE WHEN Balance > 0 THEN Balance ELSE (SELECT avg(Balance) FROM split_features WHERE split = 'train' AND Balance > 0) END", 4)} AS Balance
FROM split_features"""
SQL["standardize"] = f"""
WITH {SPLIT}, m AS (SELECT avg(Tenure) AS mt, stddev_pop(Tenure) AS st, avg(Balance) AS mb, stddev_pop(Balance) AS sb FROM split_features WHERE split = 'train')
SELECT CustomerID, {r('(Tenure - mt) / st')} AS Tenure, {r('(Balance - mb) / sb')} AS Balance FROM split_features, m"""
SQL["batch_score"] = f"""
WITH {SCORED} SELECT CustomerID, prediction, {r('probability', 8)} AS probability, prediction AS Churn FROM labelled"""



def stumps(rounds: int) -> str:
    steps = [f"""{SPLIT},
f0 AS (SELECT CustomerID, split, CAST(Tenure AS DOUBLE) AS x, 2 * ChurnBool - 1 AS y, CAST(0 AS DOUBLE) AS f FROM split_features)"""]
    for m in range(rounds):
        steps.append(f"""
g{m} AS (SELECT x, count(*) AS n, sum({'4 * y / (1 + exp(2 * y * f))' if m else 'y'}) AS s FROM f{m} WHERE split = 'train' GROUP BY x),
c{m} AS (SELECT x, lead(x) OVER up AS nx, sum(n) OVER up AS nl, sum(s) OVER up AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s
  FROM g{m} WINDOW up AS (ORDER BY x)),
b{m} AS MATERIALIZED (SELECT (x + nx) / 2 AS cut, sl / nl AS lo, (s - sl) / (n - nl) AS hi FROM c{m} WHERE nx IS NOT NULL
  ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, x LIMIT 1),
f{m + 1} AS MATERIALIZED (SELECT f{m}.* REPLACE (f + {0.1 if m else 1.0} * CASE WHEN x <= cut THEN lo ELSE hi END AS f) FROM f{m}, b{m})""")
    grown = " UNION ALL ".join(f"SELECT {m} AS m, * FROM f{m}" for m in range(1, rounds + 1))
    return ",".join(steps) + f""",
grown AS ({grown}),
best AS (SELECT m FROM grown WHERE split = 'val' GROUP BY m ORDER BY avg(ln(1 + exp(-2 * y * f))), m LIMIT 1)"""


SQL["boosted_stumps"] = f"""
WITH {stumps(6)}
SELECT CustomerID, split, CASE WHEN f > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction, {r('1 / (1 + exp(-2 * f))')} AS probability
FROM grown JOIN best USING (m)"""
_BAYES = ("MonthlySpend", "Tenure", "TotalSpend")
SQL["score_bayes"] = f"""
WITH {SPLIT},
holes AS (SELECT * REPLACE (CASE WHEN Balance > 0 THEN TotalSpend END AS TotalSpend) FROM split_features),
means AS (SELECT {', '.join(f"avg({c}) AS {c}" for c in _BAYES)} FROM holes WHERE split = 'train'),
filled AS (SELECT h.CustomerID, h.split, h.ChurnBool AS y, {', '.join(f'CAST(coalesce(h.{c}, m.{c}) AS DOUBLE) AS {c}' for c in _BAYES)} FROM holes h, means m),
scale AS (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _BAYES)} FROM filled WHERE split = 'train'),
ready AS (SELECT CustomerID, split, y, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in _BAYES)} FROM filled, scale),
total AS (SELECT count(*) AS n, 1e-9 * greatest({', '.join(f'var_pop({c})' for c in _BAYES)}) AS eps FROM ready WHERE split = 'train'),
classes AS MATERIALIZED (SELECT y, count(*) AS k, {', '.join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _BAYES)} FROM ready WHERE split = 'train' GROUP BY y),
logs AS (
  SELECT CustomerID, ln(k / n) - {' - '.join(f'(ln(2 * pi() * (v_{c} + eps)) + pow({c} - m_{c}, 2) / (v_{c} + eps)) / 2' for c in _BAYES)} AS l, c.y
  FROM ready, classes c, total),
odds AS (SELECT CustomerID, max(l) FILTER (y = 1) - max(l) FILTER (y = 0) AS d FROM logs GROUP BY CustomerID)
SELECT CustomerID, (d > 0)::INT::DOUBLE AS prediction, {r('1 / (1 + exp(-d))', 5)} AS probability, (d > 0)::INT::DOUBLE AS Churn FROM odds"""

METRICS = f"""{SCORED},
m AS (
  SELECT split, count(*) AS n,
    {r('avg((prediction = ChurnBool)::INT)')} AS accuracy,
    {r('coalesce(sum(prediction * ChurnBool) / nullif(sum(prediction), 0), 0)')} AS precision,
    {r('sum(prediction * ChurnBool) / sum(ChurnBool)')} AS recall,
    {r('2 * sum(prediction * ChurnBool) / (sum(prediction) + sum(ChurnBool))')} AS f1,
    {r('avg(-CASE WHEN ChurnBool = 1 THEN ln(probability) ELSE ln(1 - probability) END)')} AS log_loss
  FROM labelled GROUP BY split),
auc AS (
  SELECT a.split, {r('avg(CASE WHEN a.probability > b.probability THEN 1 WHEN a.probability = b.probability THEN 0.5::DOUBLE ELSE 0 END)')} AS roc_auc
  FROM labelled a JOIN labelled b ON a.split = b.split AND a.ChurnBool = 1 AND b.ChurnBool = 0 GROUP BY a.split)"""
SQL["binary_metrics"] = f"WITH {METRICS} SELECT m.*, roc_auc FROM m JOIN auc USING (split)"
SQL["metrics_table"] = f"""
WITH {METRICS},
long AS (UNPIVOT (SELECT m.* EXCLUDE (n), roc_auc FROM m JOIN auc USING (split)) ON accuracy, precision, recall, f1, log_loss, roc_auc INTO NAME metric VALUE v)
SELECT metric, max(v) FILTER (split = 'val') AS validation, max(v) FILTER (split = 'test') AS test FROM long GROUP BY metric"""
SQL["confusion_matrix"] = f"""
WITH {SCORED}
SELECT CAST(a AS INTEGER) AS label, CAST(b AS INTEGER) AS prediction,
  (SELECT count(*) FROM labelled WHERE split = 'val' AND ChurnBool = a AND labelled.prediction = b) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b)"""

DOC_SCORES = """
docs AS (SELECT quality AS label, n_chars / (n_chars + 1000) AS score FROM labels JOIN documents USING (doc_id)),
points AS (
  SELECT score AS threshold, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS flagged,
    sum(p) OVER () AS all_p, sum(n) OVER () AS all_n
  FROM (SELECT score, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM docs GROUP BY score))"""
SQL["roc_curve"] = f"""
WITH {DOC_SCORES}
SELECT {r('threshold')} AS threshold, {r('(flagged - tp) / (all_n - all_p)')} AS fpr, {r('tp / all_p')} AS tpr FROM points
UNION ALL SELECT 'infinity'::DOUBLE, 0, 0"""
SQL["pr_curve"] = f"""
WITH {DOC_SCORES}
SELECT {r('threshold')} AS threshold, {r('tp / flagged')} AS precision, {r('tp / all_p')} AS recall FROM points
UNION ALL SELECT NULL, 1, 0"""


SHAPLEY = f"""{SPLIT},
hashed AS (SELECT *, md5(CAST(CustomerID AS VARCHAR) || ':460409061') AS h FROM split_features),
e AS (SELECT * FROM hashed WHERE split = 'val' ORDER BY h, CustomerID LIMIT 100),
b AS (SELECT * FROM hashed WHERE split = 'train' ORDER BY h, CustomerID LIMIT 100),
mixed AS (""" + " UNION ALL ".join(
    f"""
  SELECT e.CustomerID, {mask} AS mask, {', '.join(f"{'e' if mask >> j & 1 else 'b'}.{n} AS {n}" for j, n in enumerate(('MonthlySpend', 'Tenure', 'TotalSpend')))} FROM e, b"""
    for mask in range(8)
) + """),
v AS (
  SELECT CustomerID, mask, avg(CASE WHEN 1 / (1 + exp(0.8 + 0.02 * Tenure - 0.00002 * MonthlySpend - 0.0000001 * TotalSpend)) >= 0.5
    THEN 1.0::DOUBLE ELSE 0 END) AS v
  FROM mixed GROUP BY ALL),
w AS (SELECT CustomerID, max(v) FILTER (mask = 0) AS v0, max(v) FILTER (mask = 1) AS v1, max(v) FILTER (mask = 2) AS v2, max(v) FILTER (mask = 3) AS v3,
    max(v) FILTER (mask = 4) AS v4, max(v) FILTER (mask = 5) AS v5, max(v) FILTER (mask = 6) AS v6, max(v) FILTER (mask = 7) AS v7 FROM v GROUP BY CustomerID),
shap AS (
  SELECT e.CustomerID, 'MonthlySpend' AS feature, e.MonthlySpend AS value, (v1 - v0) / 3 + (v3 - v2) / 6 + (v5 - v4) / 6 + (v7 - v6) / 3 AS shapley FROM w JOIN e USING (CustomerID)
  UNION ALL SELECT e.CustomerID, 'Tenure', e.Tenure, (v2 - v0) / 3 + (v3 - v1) / 6 + (v6 - v4) / 6 + (v7 - v5) / 3 FROM w JOIN e USING (CustomerID)
  UNION ALL SELECT e.CustomerID, 'TotalSpend', e.TotalSpend, (v4 - v0) / 3 + (v5 - v1) / 6 + (v6 - v2) / 6 + (v7 - v3) / 3 FROM w JOIN e USING (CustomerID))"""
SQL["shapley_values"] = f"WITH {SHAPLEY} SELECT CustomerID, feature, {r('value')} AS value, {r('shapley')} AS shapley FROM shap"
SQL["shapley_summary"] = f"WITH {SHAPLEY} SELECT feature, {r('avg(abs(shapley))')} AS mean_abs_shapley FROM shap GROUP BY feature"


def wide_shapley() -> str:
    """Values of a model of linear terms and two products: a linear term's is its distance from the background's mean, a
    product's is shared by its two features."""
    numbers = {
        "Tenure": "Tenure", "TotalSpend": "TotalSpend", "MonthlySpend": "MonthlySpend", "Balance": "Balance",
        "Tenure_2": "Tenure * Tenure / 100", "Spend_3": "CustomerID % 3", "Balance_2": "Balance * 2 - Tenure",
    }
    levels = {"Segment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), "Region": ("AFRICA", "AMERICA", "ASIA", "EUROPE")}
    numbers |= {f"{c}_{v}": f"CAST({c} = '{v}' AS INTEGER)" for c, values in levels.items() for v in values}
    pairs = {"Tenure": ("Spend_3", 0.002), "Spend_3": ("Tenure", 0.002), "Segment_BUILDING": ("Balance", 0.0001), "Balance": ("Segment_BUILDING", 0.0001)}
    rows = []
    for j, name in enumerate(numbers):
        scale = 1e6 if name in ("TotalSpend", "MonthlySpend") else 1e3
        term = f"{(j + 1) / 10} / {scale} * (e.{name} - b.{name})"
        if name in pairs:
            other, c = pairs[name]
            term += f" + {c} / 2 * (e.{name} - b.{name}) * (e.{other} + b.{other})"
        rows.append(f"SELECT e.CustomerID, '{name}' AS feature, CAST(any_value(e.{name}) AS DOUBLE) AS value, avg(CAST({term} AS DOUBLE)) AS shapley FROM e, b GROUP BY e.CustomerID")
    columns = ", ".join(f"{x} AS {name}" for name, x in numbers.items())
    return f"""{SPLIT},
wide AS (SELECT CustomerID, split, md5(CAST(CustomerID AS VARCHAR) || ':460409061') AS h, {columns} FROM split_features),
e AS (SELECT * FROM wide WHERE split = 'val' ORDER BY h, CustomerID LIMIT 100),
b AS (SELECT * FROM wide WHERE split = 'train' ORDER BY h, CustomerID LIMIT 100),
shap AS ({' UNION ALL '.join(rows)})"""


SQL["kernel_shapley"] = f"WITH {wide_shapley()} SELECT CustomerID, feature, {r('value', 9)} AS value, {r('shapley', 9)} AS shapley FROM shap"
