import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import runs as R
from runloom.operators import stats

SCHEMA = "instance_id string, sample_id string, run_type string, status string, steps long, cost double, files long, spt map<string,int>, scan_order long"


def _runs(spark, rows):
    return spark.createDataFrame([(i, str(k), t, s, 2, 1.0, 1, m, k) for k, (i, t, s, m) in enumerate(rows)], SCHEMA)


def test_report_has_one_sided_instances_and_zero_means(spark):
    r = _runs(spark, [("a", "baseline", "resolved", {}), ("a", "mutant", "unresolved", {"x": 1}), ("b", "mutant", "resolved", {"x": 2}), ("c", "baseline", "error", {})])
    out = {x.instance_id: x for x in R.instance_report(r).collect()}
    assert out["a"].degradation == 100.0 and out["b"].degradation is None and out["c"].degradation is None
    assert out["a"].bl_steps_sd == 0.0 and out["b"].bl_n == 0 and out["b"].steps_increase == 0.0
    assert R.instance_report(r, min_baseline=2).where("degradation IS NOT NULL").count() == 0


def test_spt_lift_and_usage_ties(spark):
    r = _runs(spark, [("a", "mutant", "resolved", {"y": 1}), ("a", "mutant", "unresolved", {"x": 1}), ("a", "mutant", "error", {"x": 1, "y": 1}), ("a", "mutant", "resolved", {})])
    x = R.spt_report(r).where("spt = 'x'").first()
    assert (x.n, x.failure_with, x.failure_without, x.lift) == (2, 100.0, 0.0, 100.0)
    assert R.usage(r).first().usage == "y(2),x(2)"
    kept, dropped = R.noop_split(r)
    assert (kept.count(), dropped.count()) == (3, 1)


def test_dedup_is_idempotent_and_groups_at_the_cap_stay(spark):
    r = _runs(spark, [("a", "mutant", "resolved", {})] * 4)
    one = R.first_seen(r.withColumn("sample_id", F.lit("s")), ["instance_id", "sample_id"])
    assert [x.scan_order for x in one.collect()] == [0] and R.first_seen(one, ["instance_id", "sample_id"]).count() == 1
    assert R.capped(r, 4).count() == 4 and R.capped(r, 3).count() == 3


def test_stratified_keeps_proportions(spark):
    r = _runs(spark, [("a", "baseline", "resolved", {})] * 6 + [("a", "baseline", "error", {})] * 3)
    got = {x["status"]: x["count"] for x in R.stratified(r, 4).groupBy("status").count().collect()}
    assert got == {"resolved": 3, "error": 1}
    assert R.stratified(r, 20).count() == 9


def test_newcombe_against_published_example(spark):
    # Newcombe 1998, table II (a): 56/70 - 48/80 has the interval 0.0524 to 0.3339
    lo, hi = stats.newcombe(F.lit(56), F.lit(70), F.lit(48), F.lit(80))
    x = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert math.isclose(x.lo, 0.0524, abs_tol=1e-4) and math.isclose(x.hi, 0.3339, abs_tol=1e-4)
    lo, _ = stats.newcombe(F.lit(0), F.lit(0), F.lit(1), F.lit(2))
    assert spark.range(1).select(lo.alias("lo")).first().lo is None


def test_sign_flip_exact_and_sampled():
    assert stats.sign_flip([0, 0]) == 1.0
    assert stats.sign_flip([1, 2, 3]) == 0.25
    assert stats.sign_flip([1.0] * 20) == 2 / 2**20
    d = np.random.default_rng(1).normal(0.3, 1, 16)
    assert abs(stats.sign_flip(d) - stats.sign_flip(d, draws=50_000, exact=0)) < 0.01


def test_bootstraps_hold_the_estimate(spark):
    r = spark.createDataFrame([(i, t, float(5 + (i * k) % 7 + (t == "mutant"))) for i in range(20) for t in ("baseline", "mutant") for k in range(8)], "instance_id long, run_type string, steps double")
    x = stats.relative_change_bootstrap(r, "steps", draws=300).first()
    assert x.lo <= x.change <= x.hi and x.instances == 20
    v = spark.range(30).select(F.col("id").alias("instance_id"), (F.col("id") % 5).cast("double").alias("d"))
    y = stats.bootstrap_mean(v, "d").first()
    assert y.lo < y["mean"] < y.hi
    p = spark.createDataFrame([(i, 0.8, 0.4, 10, 10) for i in range(9)], "instance_id long, p1 double, p2 double, n1 int, n2 int")
    z = stats.binomial_redraw(p, draws=400).first()
    assert z.lo < 40 < z.hi


def test_empty_tables(spark):
    r = _runs(spark, [])
    for out in (R.instance_report(r), R.spt_report(r), R.combination_report(r), R.usage(r), R.stratified(r, 3)):
        assert out.count() == 0


def test_bootstraps_make_the_reference_number_of_draws(spark):
    import inspect

    for f in (stats.bootstrap_mean, stats.relative_change_bootstrap, stats.binomial_redraw):
        assert inspect.signature(f).parameters["draws"].default == 20_000


def test_bootstrap_of_the_mean_against_plain_draws(spark, monkeypatch):
    v = spark.createDataFrame([(i, float(i % 3) ** 2) for i in range(40)], "instance_id long, d double")
    x = np.array([float(i % 3) ** 2 for i in range(40)])
    m = [np.mean([x[int(stats.picks(np.array([b]), np.array([i]), 40)[0])] for i in range(40)]) for b in range(300)]
    few = stats.bootstrap_mean(v, "d", draws=300).first()
    assert np.allclose((few.lo, few.hi), np.quantile(m, [0.025, 0.975])) and few.n == 40
    rng = np.random.default_rng(0)
    want = np.quantile(x[rng.integers(0, 40, (50_000, 40))].mean(axis=1), [0.025, 0.975])
    all_ = stats.bootstrap_mean(v, "d").first()
    assert np.allclose((all_.lo, all_.hi), want, atol=0.05)
    monkeypatch.setattr(stats, "MOST_VALUES", 10)  # the way beyond the broadcast
    wide = stats.bootstrap_mean(v, "d", draws=4000).first()
    assert np.allclose((wide.lo, wide.hi), want, atol=0.08) and (wide["mean"], wide.n) == (all_["mean"], 40)
    monkeypatch.setattr(stats, "MOST_VALUES", 1 << 20)
    same = stats.bootstrap_mean(v, "d", draws=4000).first()
    assert np.allclose((wide.lo, wide.hi), (same.lo, same.hi), rtol=1e-12)  # one definition, whatever the way
    one = stats.bootstrap_mean(v.where("instance_id = 2"), "d").first()
    none = stats.bootstrap_mean(v.limit(0), "d").first()
    assert (one.lo, one.hi, one.n) == (4.0, 4.0, 1) and (none.lo, none["mean"], none.n) == (0.0, 0.0, 0)


def test_picks_are_even():
    n, b = 97, 2000
    k = np.bincount(stats.picks(np.arange(b)[:, None], np.arange(n)[None, :], n).reshape(-1), minlength=n)
    assert ((k - b) ** 2 / b).sum() < 160  # chi square of 96 degrees
    own = stats.picks(np.arange(b)[:, None], np.arange(n)[None, :], n)
    distinct = np.mean([len(set(r)) for r in own.tolist()]) / n
    assert abs(distinct - (1 - np.exp(-1))) < 0.01  # as with independent picks


def test_instances_are_resampled_apart(spark):
    """Instances whose ids end alike draw apart, so their errors average out."""
    one = lambda i: [(i, t, float(x)) for t, xs in (("baseline", (5, 15)), ("mutant", (8, 12))) for x in xs]
    make = lambda ids: spark.createDataFrame([r for i in ids for r in one(i)], "instance_id string, run_type string, steps double")
    a = stats.relative_change_bootstrap(make(["aa__django-11099"]), "steps", draws=4000).first()
    b = stats.relative_change_bootstrap(make([f"{x}{x}__django-11099" for x in "abcdefgh"]), "steps", draws=4000).first()
    assert b.hi - b.lo < 0.6 * (a.hi - a.lo)
    p = lambda ids: spark.createDataFrame([(i, 0.5, 0.5, 9, 9) for i in ids], "instance_id string, p1 double, p2 double, n1 int, n2 int")
    x, y = (stats.binomial_redraw(p(ids), draws=4000).first() for ids in (["aa__django-11099"], [f"{x}{x}__django-11099" for x in "abcdefgh"]))
    assert y.hi - y.lo < 0.6 * (x.hi - x.lo) and (y["mean"], y.n) == (0.0, 8)


def test_sign_flips_by_rows_that_never_meet(spark):
    rng = np.random.default_rng(8)
    d = {g: rng.normal(0.35, 1, n).round(2).tolist() for g, n in (("small", 9), ("twenty", 20), ("large", 400))} | {"zeros": [0.0] * 5, None: [1.0, -2.0, 0.0]}
    rows = [(g, f"{g}-{i}", x) for g, xs in d.items() for i, x in enumerate(xs)] + [("small", "null", None)]
    df = spark.createDataFrame(rows, "side string, instance_id string, v double").repartition(7)
    exact = {r["side"]: (r["n"], r["p"]) for r in stats.sign_flip_test(df, "v", "side").collect()}
    assert {g: x[0] for g, x in exact.items()} == {g: len(xs) for g, xs in d.items()} and exact["zeros"] == (5, 1.0)
    assert all(exact[g][1] == stats.sign_flip(d[g]) for g in ("small", "twenty", None))
    drawn = {r["side"]: r["p"] for r in stats.sign_flip_test(df, "v", "side", exact=0).collect()}
    assert all(abs(drawn[g] - exact[g][1]) < 0.006 for g in ("small", "twenty")) and drawn["large"] == exact["large"][1]
    assert abs(drawn["large"] - stats.sign_flip(d["large"], draws=50_000)) < 0.006
    one = {r["side"]: r["p"] for r in stats.sign_flip_test(df.coalesce(1), "v", "side", exact=0).collect()}
    assert one == drawn  # however rows are dealt


def test_relative_changes_by_counted_values(spark):
    rng = np.random.default_rng(2)
    rows = [(f"i{k}", t, float(x)) for k in range(6) for t, m in (("baseline", 20), ("mutant", 26)) for x in rng.poisson(m, 30)] + [("none", "mutant", 3.0), ("zero", "baseline", 0.0), ("zero", "mutant", 2.0)]
    x = stats.relative_change_bootstrap(spark.createDataFrame(rows, "instance_id string, run_type string, steps double"), "steps", draws=5000).first()
    side = lambda k, t: np.array([v for i, tt, v in rows if i == f"i{k}" and tt == t])
    plain = np.mean([(lambda b, m: (m - b) / b * 100)(*(s[rng.integers(0, 30, (5000, 30))].mean(axis=1) for s in (side(k, "baseline"), side(k, "mutant")))) for k in range(6)], axis=0)
    want = np.mean([(side(k, "mutant").mean() / side(k, "baseline").mean() - 1) * 100 for k in range(6)])
    assert x.instances == 6 and abs(x.change - want) < 1e-9
    assert np.allclose((x.lo, x.hi), np.quantile(plain, [0.025, 0.975]), atol=0.5)


def test_statistics_report_and_files(spark, tmp_path):
    from runloom.operators import report

    rng = np.random.default_rng(3)
    rows = [(i, t, "resolved" if rng.random() < (0.7 if t == "baseline" else 0.4) else "unresolved", {"x": 1} if t == "mutant" and k else {}) for i in "abcdef" for t in ("baseline", "mutant") for k in range(5)]
    r = _runs(spark, [*rows, ("g", "baseline", "resolved", {})])
    x = report.statistics(r, draws=500).first()
    per = report.degradation_intervals(r).collect()
    assert len(per) == 6 and x.degradation_ci.n_instances == 6 and abs(x.degradation_ci.mean_pp - 100 * np.mean([p.degradation for p in per])) < 1e-4  # four digits
    assert x.degradation_ci.ci_lower_pp <= x.degradation_ci.mean_pp <= x.degradation_ci.ci_upper_pp
    assert (x.degradation_binomial_ci.n_baseline_per_instance, x.degradation_binomial_ci.n_mutant_per_instance) == (5, 5)
    assert x.sign_flip_pvalue == round(stats.sign_flip([p.p1 - p.p2 for p in per]), 6)
    assert x.step_delta_ci.mean_pct == 0.0 and x.step_delta_resolved_ci.n_instances <= 6
    none = report.statistics(r.limit(0), draws=50).first()
    assert none.degradation_ci is None and none.degradation_binomial_ci is None and none.sign_flip_pvalue is None and none.cost_delta_ci is None
    report.write_all(r, str(tmp_path / "out"), min_baseline=2, draws=50)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["degradation_ci", "detailed", "errors", "instances", "spt_combinations", "spt_correlation", "statistics"]
    kinds = {z.kind for z in report.errors(r, 2).collect()}
    assert kinds == {"no-op mutant", "baseline only"}
    s = report.summary(r).first()
    assert (s.baseline_runs, s.mutant_runs, s.excluded_instances, s.scoped_baseline_runs) == (31, 30, 1, 30)


def test_binomial_query_takes_the_modes(spark, monkeypatch):
    from runloom.plans import runs as plans

    one = [(i, 10 * i + k, k % 2, "resolved") for i in range(3) for k in range(6)]
    rows = [(i, s, "baseline" if b else "mutant", st, 1, 1, 1, s, {}) for i, s, b, st in one]
    own = spark.createDataFrame(rows, "instance_id long, sample_id long, run_type string, status string, steps int, cost long, files long, scan_order long, spt map<string,int>")
    seen = []
    monkeypatch.setattr(plans, "runs", lambda s, d: own)
    monkeypatch.setattr(plans.stats, "binomial_redraw", lambda rates, **kw: seen.append((rates.select("n1", "n2").distinct().collect(), kw)))
    plans.QUERIES["q_stats_binomial_redraw"](spark, "")
    assert [tuple(r) for r in seen[0][0]] == [(3, 3)] and seen[0][1] == {}


def test_few_runs_are_drawn_from_all_ordered_picks():
    class All:
        def integers(self, low, high, size, dtype):
            assert (low, high) == (0, 27)
            return np.arange(27, dtype=dtype)

    got = stats._means(All(), np.array([1.0, 4.0]), np.array([2, 1]), 27)
    assert sorted(got) == sorted((a + b + c) / 3 for a in (1, 1, 4) for b in (1, 1, 4) for c in (1, 1, 4))
    for n in (5, 12, 32):
        m = stats._means(np.random.default_rng(1), np.arange(float(n)), np.ones(n, dtype=int), 20_000)
        assert abs(m.mean() - (n - 1) / 2) < 0.05 * n and abs(m.std() / np.sqrt((n * n - 1) / 12 / n) - 1) < 0.03


def test_few_runs_of_two_values_are_all_ordered_picks():
    from itertools import product

    class All(stats._Picks):
        def below(self, n):
            assert n in seen
            return np.arange(self.draws) // seen[n] % n

    b, m = np.array([[1.0, 8.0], [2.0, 5.0]]), np.array([[3.0, 1.0], [4.0, 0.0], [9.0, 7.0]])
    means = lambda x: np.array([np.mean(p, axis=0) for p in product(x, repeat=len(x))])
    want = (means(m)[:, None] * 3 / (means(b)[None] * 2)).reshape(-1, 2)
    seen = {108: 1}
    assert np.allclose(sorted(stats._ratios(All(None, 108), b, m).tolist()), sorted(want.tolist()))
    seen = {27: 4, 4: 1}
    table, stats.TABLE = stats.TABLE, 32
    try:
        apart = stats._ratios(All(None, 108), b, m)
    finally:
        stats.TABLE = table
    assert np.allclose(sorted(apart.tolist()), sorted(want.tolist()))
    n = stats._Picks(np.random.default_rng(1), 200_000).below(5)
    assert abs(np.bincount(n, minlength=5) / 40_000 - 1).max() < 0.03


def test_relative_changes_of_values_together(spark):
    rng = np.random.default_rng(4)
    side = {(i, t): [(float(rng.integers(3, 12)), float(rng.uniform(1, 9)), bool(rng.integers(0, 2))) for _ in range(n)] for i, n in (("a", 3), ("b", 7), ("c", 40), ("d", 2)) for t in ("baseline", "mutant")}
    side["e", "baseline"], side["e", "mutant"] = [(0.0, None, True), (2.0, 3.0, True)], [(1.0, 4.0, True)] * 2
    side["f", "mutant"] = [(1.0, 1.0, True)]
    df = spark.createDataFrame([(i, t, *x) for (i, t), xs in side.items() for x in xs], "instance_id string, run_type string, steps double, cost double, ok boolean")
    got = stats.relative_changes(df, ["steps", "cost"], F.col("ok"), draws=5000).first()
    for q, v in enumerate(("steps", "cost")):
        for name, some in ((v, False), (f"{v}_some", True)):
            sums, point, n = np.zeros(5000), 0.0, 0
            k = np.zeros(5000)
            for i in "abcde":
                b, m = (np.array([x[q] for x in side[i, t] if x[q] is not None and (x[2] or not some)]) for t in ("baseline", "mutant"))
                if not len(b) or not len(m) or not b.sum():
                    continue
                bm, mm = (x[rng.integers(0, len(x), (5000, len(x)))].mean(axis=1) for x in (b, m))
                good = bm > 0
                sums += np.where(good, (mm / np.where(good, bm, 1) - 1) * 100, 0)
                k += good
                point, n = point + (m.mean() / b.mean() - 1) * 100, n + 1
            want = np.quantile(sums / k, [0.025, 0.975])
            assert got[f"{name}_instances"] == n and abs(got[f"{name}_change"] - point / n) < 1e-9
            assert np.allclose((got[f"{name}_lo"], got[f"{name}_hi"]), want, rtol=0.08, atol=4), (name, want)


def test_equal_values_are_drawn_together(spark, monkeypatch):
    v = spark.createDataFrame([(i, float(i % 7) - 2.9) for i in range(600)] + [(None, None)], "instance_id long, d double")
    x = np.array([float(i % 7) - 2.9 for i in range(600)])
    few, plain = stats.bootstrap_counted(v, "d").first(), stats.bootstrap_mean(v, "d").first()
    assert np.allclose((few.lo, few.hi), (plain.lo, plain.hi), atol=0.01) and few.n == 600 and abs(few["mean"] - x.mean()) < 1e-12
    assert stats.bootstrap_counted(v.repartition(5), "d").first() == few
    monkeypatch.setattr(stats, "MOST_DIFFERENT", 3)
    many = stats.bootstrap_counted(v, "d").first()
    assert (many.lo, many.hi, many.n) == (plain.lo, plain.hi, 600)
    assert stats.bootstrap_counted(v.limit(0), "d").first().n == 0
    flip = stats.sign_flip_counted(v, "d").first()
    assert flip.n == 600 and abs(flip.p - stats.sign_flip(x)) < 0.01
    apart = v.withColumn("d", F.col("d") + F.col("instance_id") * 1e-4)  # each value once
    assert abs(stats.sign_flip_counted(apart, "d").first().p - stats.sign_flip(x + np.arange(600) * 1e-4)) < 0.01
    some = v.where("instance_id < 20")
    assert stats.sign_flip_counted(some, "d").first().p == stats.sign_flip(np.sort(x[:20])) and stats.sign_flip_counted(v.limit(0), "d").count() == 0


def test_the_report_has_no_pass_for_each_value(spark, monkeypatch):
    from runloom.operators import report

    r = _runs(spark, [(f"i{i}", t, "resolved" if (i * k) % 3 else "unresolved", {}) for i in range(40) for t in ("baseline", "mutant") for k in range(5)])
    for name in ("bootstrap_mean", "sign_flip_test", "relative_change_bootstrap"):
        monkeypatch.setattr(stats, name, lambda *a, **k: pytest.fail("a pass of its own for each value or instance"))
    plan = report.statistics(r, draws=100)
    assert plan.first().degradation_ci.n_instances == 40
