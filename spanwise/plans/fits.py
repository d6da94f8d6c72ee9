"""Fits that are chosen on held-out intervals, over the given tables: a supplier's
months of lines are its meter intervals, price the volume, tax the weather and
discount the hot water."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.operators import fits
from spanwise.plans.consumption import _BINS, _features
from spanwise.session import load

_TERMS = ("hours", "degree_hours", "dhw_hours")


def gs5(spark, sf):
    """Rates by bins of load of each series, as many groups as unseen intervals support."""
    g = fits.binned_fit(_features(spark, sf), "series", _BINS)
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "loo_error", "validation_error", "validation_relative")]
    return g.select("series", "usable", "selected", "heldout", "rank", "identifiable", F.array_join(F.transform("rates", lambda r: F.round(r, 6)), ",").alias("rates"), F.array_join("extrapolated", ",").alias("extrapolated"), *rounded)


def _months(spark, sf):
    month = F.trunc("l_shipdate", "month")
    g = load(spark, sf, "lineitem").groupBy("l_suppkey", month.alias("start")).agg(
        (F.sum("l_extendedprice").cast("double") / 997).alias("volume"), (F.sum("l_tax").cast("double") * 100).alias("degree_hours"), (F.sum("l_discount").cast("double") * 100).alias("dhw_hours"), F.count("*").alias("lines"))
    end = F.add_months("start", 1)
    back = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("start")))
    return g.select("l_suppkey", F.col("start").cast("timestamp").alias("start"), end.cast("timestamp").alias("end"), "volume", (F.datediff(end, "start") * 24.0).alias("hours"), "degree_hours", "dhw_hours",
                    F.least(F.lit(100.0), F.lit(50.0) + 10 * F.col("lines")).alias("weather_pct"), F.lit(True).alias("complete"), back.alias("back"))


def _told(df, *names):
    return df.withColumns({c: F.round(c, 4) for c in names})


def gs9(spark, sf):
    """The baseline of each supplier's months but the last two."""
    b = fits.weather_baseline(_months(spark, sf).where("back > 2"), "l_suppkey")
    return _told(b.select("l_suppkey", "reason", "uses_dhw", "hour_rate", "degree_rate", "dhw_rate", "intervals", "validation_intervals", "residual_rmse", "validation_rmse", "validation_max_error"), "hour_rate", "degree_rate", "dhw_rate", "residual_rmse", "validation_rmse", "validation_max_error")


def gs10(spark, sf):
    """The last month of each supplier against the baseline, beside the month before."""
    m = _months(spark, sf)
    names = ("start", "end", "volume", "hours", "degree_hours", "dhw_hours", "weather_pct", "complete")
    extra = lambda side: [F.lit(8.0).alias(f"{side}_schedule_hours"), F.lit(None).cast("double").alias(f"{side}_occupancy"), F.lit(True).alias(f"{side}_independent"), F.lit(0.5).alias(f"{side}_uncertainty")]
    of = lambda k, side: m.where(F.col("back") == k).select("l_suppkey", *[F.col(c).alias(f"{side}_{c}") for c in names], *extra(side))
    r = fits.compare(fits.weather_baseline(m.where("back > 2"), "l_suppkey"), of(2, "before").join(of(1, "after"), "l_suppkey"), "l_suppkey")
    figures = ("expected", "raw_savings", "savings", "savings_pct", "uncertainty", "lower", "upper")
    return _told(r.select("l_suppkey", *figures, "extrapolated", "confounded", "status", "weather_note"), *figures)


def _sets_sql() -> str:
    """A row for each set of terms: coefficients by Cramer's rule and what it explains."""
    out = []
    for terms in (2, 3):
        for size in range(1, terms + 1):
            for some in combinations(range(terms), size):
                g = lambda i, j: f"s{min(i, j)}{max(i, j)}"
                y = lambda i: f"s{i}3"
                if size == 1:
                    det, tops = g(some[0], some[0]), [y(some[0])]
                elif size == 2:
                    a, b = some
                    det = f"({g(a, a)} * {g(b, b)} - {g(a, b)} * {g(a, b)})"
                    tops = [f"({y(a)} * {g(b, b)} - {y(b)} * {g(a, b)})", f"({y(b)} * {g(a, a)} - {y(a)} * {g(a, b)})"]
                else:
                    three = lambda c: f"({c[0][0]} * ({c[1][1]} * {c[2][2]} - {c[1][2]} * {c[2][1]}) - {c[0][1]} * ({c[1][0]} * {c[2][2]} - {c[1][2]} * {c[2][0]}) + {c[0][2]} * ({c[1][0]} * {c[2][1]} - {c[1][1]} * {c[2][0]}))"
                    full = [[g(i, j) for j in some] for i in some]
                    det, tops = three(full), [three([[y(i) if j == k else full[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
                found = {t: f"{top} / {det}" for t, top in zip(some, tops)}
                fine = " AND ".join(f"{x} >= 0" for x in found.values())
                out.append(f"SELECT l_suppkey, {terms} AS terms, {', '.join(f'{found[t]} AS c{t}' if t in found else f'0.0 AS c{t}' for t in range(3))}, {' + '.join(f'{x} * {y(t)}' for t, x in found.items())} AS gain FROM g WHERE {fine}")
    return " UNION ALL ".join(out)


_MONTHS = """WITH m AS (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS start, sum(l_extendedprice)::DOUBLE / 997 AS volume, sum(l_tax)::DOUBLE * 100 AS x1, sum(l_discount)::DOUBLE * 100 AS x2, least(100.0, 50.0 + 10 * count(*)) AS pct FROM lineitem GROUP BY 1, 2),
d AS (SELECT *, (start + INTERVAL 1 MONTH)::DATE AS "end", date_diff('day', start, (start + INTERVAL 1 MONTH)::DATE) * 24.0::DOUBLE AS x0, row_number() OVER (PARTITION BY l_suppkey ORDER BY start DESC) AS back FROM m),
u AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY start) AS pos FROM d WHERE back > 2 AND pct >= 70 WINDOW w AS (PARTITION BY l_suppkey)),
f AS (SELECT *, CASE WHEN n >= 5 THEN ceil(n / 5.0) ELSE 0 END::BIGINT AS held, pos <= n - CASE WHEN n >= 5 THEN ceil(n / 5.0) ELSE 0 END AS fit FROM u),
g AS (SELECT l_suppkey, max(n) AS n, max(held) AS held, max("end") AS trained, """ + ", ".join(
    f"sum({a} * {b}) FILTER (fit) AS s{i}{j}" for i, a in enumerate(("x0", "x1", "x2", "volume")) for j, b in enumerate(("x0", "x1", "x2", "volume")) if i <= j
) + ", " + ", ".join(f"min({e}) FILTER (fit) AS lo{i}, max({e}) FILTER (fit) AS hi{i}" for i, e in enumerate(("x0", "x1", "x1 / x0", "x2"))) + f""" FROM f GROUP BY 1),
sets AS ({_sets_sql()}),
best AS (SELECT l_suppkey, terms, arg_max(struct_pack(c0, c1, c2), gain) AS c FROM sets GROUP BY 1, 2),
two AS (SELECT l_suppkey, c FROM best WHERE terms = 2), three AS (SELECT l_suppkey, c FROM best JOIN g USING (l_suppkey) WHERE terms = 3 AND n >= 8),
e AS (SELECT f.*, volume - two.c.c0 * x0 - two.c.c1 * x1 AS e2, volume - three.c.c0 * x0 - three.c.c1 * x1 - three.c.c2 * x2 AS e3 FROM f JOIN two USING (l_suppkey) LEFT JOIN three USING (l_suppkey)),
v AS (SELECT l_suppkey, sqrt(avg(e2 * e2) FILTER (NOT fit)) AS v2, sqrt(avg(e3 * e3) FILTER (NOT fit)) AS v3, max(abs(e2)) FILTER (NOT fit) AS m2, max(abs(e3)) FILTER (NOT fit) AS m3, sqrt(avg(e2 * e2) FILTER (fit)) AS t2, sqrt(avg(e3 * e3) FILTER (fit)) AS t3, avg(volume) FILTER (NOT fit) AS level FROM e GROUP BY 1),
b AS (SELECT g.*, CASE WHEN n - held < 3 THEN 'few_intervals' END AS reason, n - held >= 3 AND coalesce(v3 <= 0.9 * v2 AND v2 - v3 >= greatest(0.01, 0.01 * level), false) AS dhw, two.c AS c2, three.c AS c3, v2, v3, m2, m3, t2, t3 FROM g LEFT JOIN two USING (l_suppkey) LEFT JOIN three USING (l_suppkey) LEFT JOIN v USING (l_suppkey)),
base AS (SELECT *, CASE WHEN dhw THEN c3.c0 ELSE c2.c0 END AS r0, CASE WHEN dhw THEN c3.c1 ELSE c2.c1 END AS r1, CASE WHEN dhw THEN c3.c2 ELSE 0.0 END AS r2, CASE WHEN dhw THEN t3 ELSE t2 END AS residual, CASE WHEN dhw THEN v3 ELSE v2 END AS rmse, CASE WHEN dhw THEN m3 ELSE m2 END AS worst FROM b)"""
_r = lambda x, name: f"round(CASE WHEN reason IS NULL THEN {x} END, 4) AS {name}"

QUERIES = {
    "GS5_binned_fit": (gs5, None),  # 200 bounded sweeps for each left-out interval: tests/test_fits.py holds it against plain loops
    "GS9_holdout_baseline": (gs9, _MONTHS + f""" SELECT l_suppkey, reason, dhw AS uses_dhw, {_r('r0', 'hour_rate')}, {_r('r1', 'degree_rate')}, {_r('r2', 'dhw_rate')}, n AS intervals, held AS validation_intervals, {_r('residual', 'residual_rmse')}, {_r('rmse', 'validation_rmse')}, {_r('worst', 'validation_max_error')} FROM base"""),
    "GS10_holdout_range": (gs10, _MONTHS + """, p AS (SELECT a.l_suppkey, base.*, a.volume AS av, p.volume AS bv, a.x0 AS a0, a.x1 AS a1, a.x2 AS a2, p.x1 AS b1, p.x2 AS b2, r0 * a.x0 + r1 * a.x1 + r2 * a.x2 AS expected
FROM d a JOIN d p ON p.l_suppkey = a.l_suppkey AND a.back = 1 AND p.back = 2 JOIN base ON base.l_suppkey = a.l_suppkey WHERE reason IS NULL AND a.pct >= 70 AND p.pct >= 70 AND a.start >= trained),
q AS (SELECT *, bv - av AS raw, expected - av AS saved, coalesce(worst, greatest(residual, 0.1 * expected)) + 1.0 AS unsure, NOT (a1 BETWEEN lo1 AND hi1) OR NOT (a0 BETWEEN lo0 AND hi0) OR NOT (a1 / a0 BETWEEN lo2 AND hi2) OR (dhw AND NOT (a2 BETWEEN lo3 AND hi3)) AS beyond, NOT dhw AND abs(b2 - a2) > 1e-9 AS mixed FROM p)
SELECT l_suppkey, round(expected, 4) AS expected, round(raw, 4) AS raw_savings, round(saved, 4) AS savings, round(100 * saved / expected, 4) AS savings_pct, round(unsure, 4) AS uncertainty, round(saved - unsure, 4) AS lower, round(saved + unsure, 4) AS upper, beyond AS extrapolated, mixed AS confounded,
CASE WHEN mixed THEN 'confounded' WHEN beyond THEN 'extrapolated' WHEN saved - unsure <= 0 AND saved + unsure >= 0 OR abs(100 * saved / expected) <= 2 THEN 'effect_indistinguishable' ELSE 'estimated' END AS status, CASE WHEN raw > 0 AND saved <= 0 THEN 'explained_by_weather' WHEN raw > saved AND a1 < b1 THEN 'partly_weather' END AS weather_note FROM q""".replace("SELECT a.l_suppkey, base.*,", "SELECT base.*,")),
}
