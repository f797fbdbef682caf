"""Shared CTEs of the DuckDB oracle statements."""

BRAND = """
cells AS (
  SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS dt,
         0.2e0 * (CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (1e2 * count(l_discount)) - 0.05e0) AS r
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
prices AS (
  SELECT asset, dt, r, 1e2 * product(1e0 + r) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS px FROM cells),
uni AS (SELECT asset, row_number() OVER (ORDER BY asset) AS ord FROM (SELECT DISTINCT p_brand AS asset FROM part)),
cal AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS t, count(*) OVER () AS n_dates FROM (SELECT DISTINCT dt FROM cells)),
grid AS (
  SELECT uni.asset, uni.ord, cal.t, cal.dt, cal.n_dates, px, coalesce(r, 0e0) AS r,
         last_value(px IGNORE NULLS) OVER (PARTITION BY uni.asset ORDER BY cal.t ROWS UNBOUNDED PRECEDING) AS px_ff
  FROM cal CROSS JOIN uni LEFT JOIN prices ON prices.asset = uni.asset AND prices.dt = cal.dt)"""

RETS = BRAND + """,
rets AS (
  SELECT *, px_ff / lag(px_ff) OVER (PARTITION BY asset ORDER BY t) - 1 AS ret FROM grid)"""

RAWFEAT = RETS + """,
rf0 AS (
  SELECT *,
    CASE WHEN count(ret) OVER w21 = count(*) OVER w21 AND count(ret) OVER w21 >= 5 THEN product(1e0 + ret) OVER w21 - 1 END AS r1m,
    CASE WHEN count(ret) OVER w63 = count(*) OVER w63 AND count(ret) OVER w63 >= 21 THEN product(1e0 + ret) OVER w63 - 1 END AS r3m,
    CASE WHEN count(ret) OVER w252 = count(*) OVER w252 AND count(ret) OVER w252 >= 63 THEN product(1e0 + ret) OVER w252 - 1 END AS r12m,
    CASE WHEN count(ret) OVER w63 >= 21 THEN stddev_samp(ret) OVER w63 * sqrt(252e0) END AS vol3m,
    px / max(px) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS mdd
  FROM rets WINDOW
    w21 AS (PARTITION BY asset ORDER BY t ROWS 20 PRECEDING),
    w63 AS (PARTITION BY asset ORDER BY t ROWS 62 PRECEDING),
    w252 AS (PARTITION BY asset ORDER BY t ROWS 251 PRECEDING)),
rf AS (SELECT *, avg(vol3m) OVER (PARTITION BY t) AS cross_vol FROM rf0)"""

FEAT = RAWFEAT + """,
feats AS (
  SELECT asset, ord, t, dt, n_dates, px, px_ff, r, ret,
    coalesce(last_value(r1m IGNORE NULLS) OVER w, 0) AS r1m, coalesce(last_value(r3m IGNORE NULLS) OVER w, 0) AS r3m,
    coalesce(last_value(r12m IGNORE NULLS) OVER w, 0) AS r12m, coalesce(last_value(vol3m IGNORE NULLS) OVER w, 0) AS vol3m,
    coalesce(last_value(mdd IGNORE NULLS) OVER w, 0) AS mdd, coalesce(last_value(cross_vol IGNORE NULLS) OVER w, 0) AS cross_vol
  FROM rf WINDOW w AS (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING))"""

DECIDE = """,
decisions AS (SELECT dt, t, n_dates, (t - 252) // 42 AS decision FROM cal WHERE t >= 252 AND (t - 252) % 42 = 0)"""
DFEAT = FEAT + DECIDE + """,
df AS (SELECT feats.* FROM feats JOIN decisions USING (t))"""

FOLDS = """,
folds AS (
  SELECT k + 1 AS fold, 0 AS train_start, 504 + 378 * k AS train_end, 504 + 378 * k AS test_start,
         least(n, 504 + 378 * (k + 1)) AS test_end
  FROM (SELECT max(n_dates) AS n FROM cal), range(0, 100) r(k)
  WHERE 504 + 378 * k <= n - 2 AND least(n, 504 + 378 * (k + 1)) - (504 + 378 * k) >= 2)"""


def R(expr: str, name: str | None = None) -> str:
    """round to 6 digits under its own name."""
    return f"round({expr}, 6) AS {name or expr}"


def Rs(*names: str) -> str:
    return ", ".join(R(n) for n in names)


def proj_sql(src: str, v: str, out: str, cap: str) -> str:
    """Nested selects adding ``out`` = projection of list column ``v``."""
    clip = lambda u: f"list_transform({v}, lambda x: least(greatest(x + {u}, 0e0), {cap}))"
    s1 = f"SELECT *, list_concat(list_transform({v}, lambda x: -x), list_transform({v}, lambda x: {cap} - x)) AS kk_ FROM ({src})"
    s2 = f"SELECT *, list_transform(kk_, lambda u: list_sum({clip('u')})) AS gg_ FROM ({s1})"
    s3 = (f"SELECT *, list_max(list_filter(kk_, lambda u, i: gg_[i] <= 1e0)) AS lo_, "
          f"coalesce(list_min(list_filter(kk_, lambda u, i: gg_[i] >= 1e0)), list_max(kk_)) AS hi_ FROM ({s2})")
    s4 = f"SELECT *, list_sum({clip('lo_')}) AS gl_, list_sum({clip('hi_')}) AS gh_ FROM ({s3})"
    s5 = f"SELECT *, CASE WHEN gh_ - gl_ < 1e-14 THEN lo_ ELSE lo_ + (1e0 - gl_) * (hi_ - lo_) / (gh_ - gl_) END AS u_ FROM ({s4})"
    s6 = f"SELECT *, {clip('u_')} AS c_ FROM ({s5})"
    return (f"SELECT * EXCLUDE (kk_, gg_, lo_, hi_, gl_, gh_, u_, c_), "
            f"list_transform(c_, lambda x: x / list_sum(c_)) AS {out} FROM ({s6})")
