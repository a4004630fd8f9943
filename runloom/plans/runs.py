"""Queries over runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import report, stats
from runloom.operators import runs as R
from runloom.plans.tables import RUNS_SQL, runs

_W = f"WITH {RUNS_SQL}"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _side_sql(p: str, kind: str) -> str:
    mean = lambda c, cond="": f"coalesce(avg({c}){' FILTER (' + cond + ')' if cond else ''}, 0.0)"
    cols = [f"count(*) AS {p}_n", *(f"count(*) FILTER (status = '{s}') AS {p}_{s}" for s in ("resolved", "unresolved", "empty", "error"))]
    cols.append(f"100.0 * avg(CASE WHEN status = 'resolved' THEN 1 ELSE 0 END) AS {p}_rate")
    for c in ("steps", "cost", "files"):
        cols += [f"{mean(c)} AS {p}_{c}_mean", f"coalesce(stddev_samp({c}), 0.0) AS {p}_{c}_sd"]
    for c in ("steps", "cost"):
        ok, bad = "status = 'resolved'", "status != 'resolved'"
        cols += [f"{mean(c, ok)} AS {p}_{c}_ok", f"{mean(c, bad)} AS {p}_{c}_failed"]
    cols += [f"CASE WHEN sum(steps) > 0 THEN sum({c}) / sum(steps) ELSE 0.0 END AS {p}_{c}_per_step" for c in ("cost", "files")]
    return f"{p} AS (SELECT instance_id, {', '.join(cols)} FROM runs WHERE run_type = '{kind}' GROUP BY 1)"


_NAMES = [f"{p}_{x}" for p in ("bl", "mt") for x in ("n", "resolved", "unresolved", "empty", "error", "rate", "steps_mean", "steps_sd", "cost_mean", "cost_sd", "files_mean", "files_sd", "steps_ok", "steps_failed", "cost_ok", "cost_failed", "cost_per_step", "files_per_step")]
_REPORT = f"""{_W}, {_side_sql('bl', 'baseline')}, {_side_sql('mt', 'mutant')}, r AS (
SELECT instance_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _NAMES)},
  CASE WHEN bl_n >= 1 AND mt_n >= 1 THEN bl_rate - mt_rate END AS degradation FROM bl FULL JOIN mt USING (instance_id))"""
_add("q_runs_instance_report", lambda s, d: R.instance_report(runs(s, d)), _REPORT + " SELECT *, " + ", ".join(f"CASE WHEN bl_{c}_mean > 0 THEN (mt_{c}_mean - bl_{c}_mean) / bl_{c}_mean * 100.0 ELSE 0.0 END AS {c}_increase" for c in ("steps", "cost", "files")) + " FROM r")

_M = _W + ", m AS (SELECT *, CASE WHEN status != 'resolved' THEN 1 ELSE 0 END AS failed FROM runs WHERE run_type = 'mutant')"
_add("q_runs_spt_report", lambda s, d: R.spt_report(runs(s, d)), _M + """, g AS (
SELECT spt, count(*) AS n, CAST(sum(failed) AS BIGINT) AS n_failed, avg(c) AS entries_mean, coalesce(avg(steps) FILTER (failed = 1), 0.0) AS steps_failed,
  coalesce(avg(steps) FILTER (failed = 0), 0.0) AS steps_ok, avg(cost) AS cost_mean FROM m JOIN s ON s.l_orderkey = m.sample_id GROUP BY spt),
t AS (SELECT count(*) AS tn, sum(failed) AS tf FROM m)
SELECT g.*, 100.0 * n_failed / n AS failure_with, CASE WHEN tn > n THEN 100.0 * (tf - n_failed) / (tn - n) ELSE 0.0 END AS failure_without,
  100.0 * n_failed / n - CASE WHEN tn > n THEN 100.0 * (tf - n_failed) / (tn - n) ELSE 0.0 END AS lift FROM g, t""")
_add("q_runs_combination_report", lambda s, d: R.combination_report(runs(s, d)), _M + """
SELECT combo AS combination, count(*) AS n, CAST(sum(failed) AS BIGINT) AS n_failed, min(sample_id) AS first_seen, 100.0 * sum(failed) / count(*) AS failure_rate FROM m WHERE combo IS NOT NULL GROUP BY combo""")
_add("q_runs_usage", lambda s, d: R.usage(runs(s, d)), _M + """, g AS (
SELECT instance_id, spt, sum(c) AS c, min(sample_id) AS o FROM m JOIN s ON s.l_orderkey = m.sample_id GROUP BY 1, 2)
SELECT instance_id, string_agg(spt || '(' || CAST(c AS BIGINT) || ')', ',' ORDER BY c DESC, o, spt) AS usage FROM g GROUP BY 1""")
_add("q_runs_outcome_rollup", lambda s, d: R.outcome_rollup(runs(s, d)), _W + """
SELECT CASE WHEN grouping(instance_id) = 1 THEN 'TOTAL' ELSE CAST(instance_id AS VARCHAR) END AS instance_id, count(*) AS n, count(*) FILTER (status = 'resolved') AS n_resolved,
  count(*) FILTER (status = 'unresolved') AS n_unresolved, count(*) FILTER (status = 'error') AS n_error FROM runs GROUP BY ROLLUP (instance_id)""")
_add("q_runs_excluded", lambda s, d: R.one_sided(runs(s, d), 3), _W + """, c AS (
SELECT instance_id, count(*) FILTER (run_type = 'baseline') AS b, count(*) FILTER (run_type = 'mutant') AS m FROM runs GROUP BY 1)
SELECT * FROM (SELECT instance_id, CASE WHEN m = 0 THEN 'baseline only' WHEN b = 0 THEN 'mutant only' WHEN b < 3 THEN 'low baseline' END AS reason, b, m FROM c) WHERE reason IS NOT NULL""")
_add("q_runs_sample_mode", lambda s, d: R.sample_count_mode(runs(s, d)), _W + """, c AS (SELECT run_type, instance_id, count(*) AS n FROM runs GROUP BY 1, 2),
f AS (SELECT run_type, n, count(*) AS k FROM c GROUP BY 1, 2)
SELECT run_type, (SELECT n FROM f g WHERE g.run_type = f.run_type ORDER BY k DESC, n LIMIT 1) AS mode_n, CAST(sum(k) AS BIGINT) AS instances FROM f GROUP BY 1""")
_add("q_runs_pooled_degradation", lambda s, d: R.pooled(runs(s, d)), _REPORT + """, b AS (
SELECT 100.0 * avg(CASE WHEN status = 'resolved' THEN 1 ELSE 0 END) AS bl_rate, count(*) AS bl_n FROM runs WHERE run_type = 'baseline' AND instance_id IN (SELECT instance_id FROM runs WHERE run_type = 'mutant')),
x AS (SELECT 100.0 * avg(CASE WHEN status = 'resolved' THEN 1 ELSE 0 END) AS mt_rate, count(*) AS mt_n FROM runs WHERE run_type = 'mutant'),
y AS (SELECT avg(degradation) AS mean_degradation, count(degradation) AS instances FROM r)
SELECT *, bl_rate - mt_rate AS pooled_degradation FROM b, x, y""")
_SAMPLE = ["instance_id", "sample_id", "run_type", "status", "steps", "cost", "files"]


def _per_sample(s, d):
    r = runs(s, d)
    return r.where("run_type = 'baseline'").select(*_SAMPLE).unionByName(R.noop_split(r.where("run_type = 'mutant'"))[0].select(*_SAMPLE))


_add("q_runs_per_sample", _per_sample, _W + f" SELECT {', '.join(_SAMPLE)} FROM runs WHERE run_type = 'baseline' OR combo IS NOT NULL")
_add("q_runs_noop_mutants", lambda s, d: R.noop_split(runs(s, d).where("run_type = 'mutant'"))[1].select(*_SAMPLE), _W + f" SELECT {', '.join(_SAMPLE)} FROM runs WHERE run_type = 'mutant' AND combo IS NULL")


def _capped(s, d):
    r = runs(s, d).select(*_SAMPLE, "scan_order")
    return R.capped(R.first_seen(r.unionByName(r.withColumn("scan_order", F.col("scan_order") + 1_000_000_000)), ["instance_id", "sample_id"]), 4).drop("scan_order")


_add("q_runs_dedup_and_cap", _capped, _W + f" SELECT {', '.join(_SAMPLE)} FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY sample_id) AS k FROM runs) WHERE k <= 4")
_add("q_runs_stratified_sample", lambda s, d: R.stratified(runs(s, d), 5).select(*_SAMPLE), _W + f""", x AS (SELECT *, CASE WHEN status = 'resolved' THEN 'resolved' ELSE 'other' END AS st FROM runs),
z AS (SELECT instance_id, st, count(*) AS k FROM x GROUP BY 1, 2),
a AS (SELECT *, sum(k) OVER w AS t, k * 5 / CAST(sum(k) OVER w AS DOUBLE) AS e FROM z WINDOW w AS (PARTITION BY instance_id)),
b AS (SELECT *, floor(e) AS f, 5 - sum(floor(e)) OVER (PARTITION BY instance_id) AS rest, row_number() OVER (PARTITION BY instance_id ORDER BY e - floor(e) DESC, st) AS r FROM a),
c AS (SELECT instance_id, st, CASE WHEN t <= 5 THEN k ELSE least(k, f + CASE WHEN r <= rest THEN 1 ELSE 0 END) END AS take FROM b),
p AS (SELECT x.*, take, row_number() OVER (PARTITION BY x.instance_id, x.st ORDER BY CAST('0x' || substr(md5('s|' || x.instance_id || '|' || x.sample_id), 1, 8) AS BIGINT), x.sample_id) AS q FROM x JOIN c USING (instance_id, st))
SELECT {', '.join(_SAMPLE)} FROM p WHERE q <= take""")


def _newcombe(s, d):
    j = R.instance_report(runs(s, d)).where("bl_n > 0 AND mt_n > 0")
    lo, hi = stats.newcombe(F.col("bl_resolved"), F.col("bl_n"), F.col("mt_resolved"), F.col("mt_n"))
    return j.select("instance_id", "bl_n", "mt_n", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


_z = stats.Z95
_wil = lambda i, sgn: f"((x{i} / n{i} + {_z * _z} / (2 * n{i})) {sgn} {_z} * sqrt(x{i} / n{i} * (1 - x{i} / n{i}) / n{i} + {_z * _z} / (4 * n{i} * n{i}))) / (1 + {_z * _z} / n{i})"
_add("q_stats_newcombe", _newcombe, _REPORT + f""", v AS (SELECT instance_id, bl_n, mt_n, CAST(bl_resolved AS DOUBLE) AS x1, CAST(bl_n AS DOUBLE) AS n1, CAST(mt_resolved AS DOUBLE) AS x2, CAST(mt_n AS DOUBLE) AS n2 FROM r WHERE bl_n > 0 AND mt_n > 0),
w AS (SELECT *, {_wil(1, '-')} AS l1, {_wil(1, '+')} AS u1, {_wil(2, '-')} AS l2, {_wil(2, '+')} AS u2 FROM v)
SELECT instance_id, bl_n, mt_n, round(x1 / n1 - x2 / n2 - sqrt((x1 / n1 - l1) ** 2 + (u2 - x2 / n2) ** 2), 9) AS lo, round(x1 / n1 - x2 / n2 + sqrt((u1 - x1 / n1) ** 2 + (x2 / n2 - l2) ** 2), 9) AS hi FROM w""")


def _bootstrap(s, d):
    b = stats.bootstrap_mean(R.instance_report(runs(s, d)), "degradation")
    return b.select(*[F.round(c, 8).alias(c) for c in ("lo", "hi", "mean")], "n")


def _sign_flip_exact(s, d):
    """Groups of ten instances, so all signs are tried; differences in whole hundredths."""
    r = R.instance_report(runs(s, d)).where("degradation IS NOT NULL").select("instance_id", F.floor(F.col("instance_id") / 10).alias("side"), F.floor(F.col("degradation") + F.lit(0.5)).alias("degradation"))
    return stats.sign_flip_test(r, "degradation", "side")


def _sign_flip(s, d):
    """Two large groups, so signs are drawn."""
    r = R.instance_report(runs(s, d)).withColumn("side", F.when(F.col("instance_id") % 2 == 0, "even").otherwise("odd"))
    return stats.sign_flip_test(r, "degradation", "side")


def _binomial(s, d):
    """Trials are the modes of each side's sample counts over the instances that have both sides."""
    r = R.instance_report(runs(s, d)).where("degradation IS NOT NULL")
    n = r.agg(F.mode("bl_n", deterministic=True).alias("n1"), F.mode("mt_n", deterministic=True).alias("n2"))
    p = r.select("instance_id", (F.col("bl_rate") / 100).alias("p1"), (F.col("mt_rate") / 100).alias("p2"))
    return stats.binomial_redraw(p.join(F.broadcast(n)))


_add("q_stats_bootstrap_mean", _bootstrap, _REPORT + f""", v AS (SELECT degradation AS v, row_number() OVER (ORDER BY instance_id) - 1 AS i FROM r WHERE degradation IS NOT NULL),
c AS (SELECT count(*) AS n, avg(v) AS mean FROM v), u1 AS (SELECT b, (b * 1000003 + i * 7919 + 12345) % {stats.PRIME} AS u FROM v, range(20000) t(b)),
u2 AS (SELECT b, ((u * u % {stats.PRIME}) * (u * u % {stats.PRIME}) % {stats.PRIME} * u % {stats.PRIME} + 31 * b) % {stats.PRIME} AS u FROM u1),
p AS (SELECT b, ((u * u % {stats.PRIME}) * (u * u % {stats.PRIME}) % {stats.PRIME} * u % {stats.PRIME}) % n AS i FROM u2, c),
m AS (SELECT b, avg(v) AS m FROM p JOIN v USING (i) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 8) AS lo, round(quantile_cont(m, 0.975), 8) AS hi, round(any_value(mean), 8) AS mean, any_value(n) AS n FROM m, c""")
_add("q_stats_sign_flip_exact", _sign_flip_exact, _REPORT + """, d AS (SELECT instance_id // 10 AS side, CAST(floor(degradation + 0.5) AS BIGINT) AS v FROM r WHERE degradation IS NOT NULL),
z AS (SELECT side, v, row_number() OVER (PARTITION BY side ORDER BY v) - 1 AS i FROM d WHERE v != 0),
zn AS (SELECT side, count(*) AS k, sum(v) AS t FROM z GROUP BY 1), sg AS (SELECT zn.side, k, t, g, sum(CASE WHEN (g >> i) & 1 = 1 THEN -v ELSE v END) AS x FROM zn, range(1024) u(g), z WHERE g < (1 << k) AND z.side = zn.side GROUP BY ALL),
p AS (SELECT side, count(*) FILTER (abs(x) >= abs(t)) / CAST(count(*) AS DOUBLE) AS p FROM sg GROUP BY side)
SELECT side, n, coalesce(p, 1.0) AS p FROM (SELECT side, count(*) AS n FROM d GROUP BY 1) LEFT JOIN p USING (side)""")
_add("q_stats_sign_flip", _sign_flip, _REPORT + f""", d AS (SELECT CASE WHEN instance_id % 2 = 0 THEN 'even' ELSE 'odd' END AS side, degradation AS v, CAST('0x' || substr(md5('flip|' || instance_id), 1, 8) AS BIGINT) % {stats.PRIME} AS h FROM r WHERE degradation IS NOT NULL),
g AS (SELECT side, count(*) AS n, abs(sum(v)) - 1e-9 * sum(abs(v)) AS least FROM d GROUP BY 1), u1 AS (SELECT side, v, w, (w * 1000003 + h * 7919 + 12345) % {stats.PRIME} AS u FROM d, range(3334) t(w) WHERE v != 0),
u2 AS (SELECT side, v, w, ((u * u % {stats.PRIME}) * (u * u % {stats.PRIME}) % {stats.PRIME} * u % {stats.PRIME} + 31 * w) % {stats.PRIME} AS u FROM u1),
u3 AS (SELECT side, v, w, (u * u % {stats.PRIME}) * (u * u % {stats.PRIME}) % {stats.PRIME} * u % {stats.PRIME} AS u FROM u2),
f AS (SELECT side, w * 30 + b AS b, sum(CASE WHEN (u >> b) & 1 = 1 THEN -v ELSE v END) AS s FROM u3, range(30) t(b) WHERE w * 30 + b < 100000 GROUP BY 1, 2)
SELECT side, any_value(n) AS n, (count(*) FILTER (abs(s) >= least) + 1) / 100001.0 AS p FROM f JOIN g USING (side) GROUP BY side""")
_add("q_stats_degradation_intervals", lambda s, d: report.degradation_intervals(runs(s, d)).select("instance_id", F.round("p1", 9).alias("p1"), F.round("p2", 9).alias("p2"), "n_baseline", "n_mutant"), _REPORT + """
SELECT instance_id, round(bl_resolved / CAST(bl_n AS DOUBLE), 9) AS p1, round(mt_resolved / CAST(mt_n AS DOUBLE), 9) AS p2, bl_n AS n_baseline, mt_n AS n_mutant FROM r WHERE bl_n > 0 AND mt_n > 0""")
_add("q_runs_errors", lambda s, d: report.errors(runs(s, d), 3), _W + """, c AS (
SELECT instance_id, count(*) FILTER (run_type = 'baseline') AS b, count(*) FILTER (run_type = 'mutant') AS m FROM runs GROUP BY 1)
SELECT 'no-op mutant' AS kind, CAST(instance_id AS VARCHAR) AS instance_id, CAST(sample_id AS VARCHAR) AS sample_id, CAST(NULL AS BIGINT) AS n_baseline, CAST(NULL AS BIGINT) AS n_mutant FROM runs WHERE run_type = 'mutant' AND combo IS NULL
UNION ALL SELECT CASE WHEN m = 0 THEN 'baseline only' ELSE 'low baseline' END, CAST(instance_id AS VARCHAR), NULL, b, m FROM c WHERE b > 0 AND (m = 0 OR b < 3)""")
_add("q_runs_summary", lambda s, d: report.summary(runs(s, d)), _REPORT + """, o AS (SELECT count(*) FILTER (status = 'resolved' AND run_type = 'baseline') AS baseline_resolved, count(*) FILTER (run_type = 'baseline') AS baseline_runs,
  count(*) FILTER (status = 'resolved' AND run_type = 'mutant') AS mutant_resolved, count(*) FILTER (run_type = 'mutant') AS mutant_runs FROM runs),
sc AS (SELECT count(*) FILTER (status = 'resolved') AS x, count(*) AS scoped_baseline_runs FROM runs WHERE run_type = 'baseline' AND instance_id IN (SELECT instance_id FROM runs WHERE run_type = 'mutant')),
ex AS (SELECT count(*) FILTER (bl_n > 0 AND mt_n = 0) AS excluded_instances, avg(degradation) AS mean_degradation FROM r)
SELECT baseline_resolved, baseline_runs, 100.0 * baseline_resolved / baseline_runs AS baseline_rate, mutant_resolved, mutant_runs, 100.0 * mutant_resolved / mutant_runs AS mutant_rate, excluded_instances,
  100.0 * x / scoped_baseline_runs AS scoped_baseline_rate, scoped_baseline_runs, 100.0 * x / scoped_baseline_runs - 100.0 * mutant_resolved / mutant_runs AS pooled_degradation, mean_degradation FROM o, sc, ex""")
_add("q_stats_report", lambda s, d: report.statistics(runs(s, d)))
_add("q_stats_relative_change", lambda s, d: stats.relative_change_bootstrap(runs(s, d), "steps"))
_add("q_stats_binomial_redraw", _binomial)
