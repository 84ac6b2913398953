"""Operators against brute force on small fixtures and statistical properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchcohort.operators import cohort as co
from benchcohort.operators import effects, intervals, metrics, stats, tableone


def test_exact_quantiles_type7(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 7.0)] + [("b", float(v)) for v in range(101)],
                               "g string, v double")
    got = {(r.g, r.p): r.q for r in stats.exact_quantiles(df.repartition(3), "g", "v", [0.025, 0.5, 0.975]).collect()}
    assert got[("a", 0.025)] == pytest.approx(1.075)
    assert got[("a", 0.5)] == pytest.approx(3.0)
    assert got[("a", 0.975)] == pytest.approx(6.775)
    for p in (0.025, 0.5, 0.975):
        assert got[("b", p)] == pytest.approx(np.quantile(np.arange(101.0), p))


def test_exact_quantiles_hot_group_spread(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=3000)
    rows = [("hot", float(v)) for v in vals] + [("cold", float(v)) for v in vals[:10]]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.p): r.q for r in stats.exact_quantiles(df, "g", "v", [0.1, 0.9]).collect()}
    assert got[("hot", 0.1)] == pytest.approx(np.quantile(vals, 0.1))
    assert got[("cold", 0.9)] == pytest.approx(np.quantile(vals[:10], 0.9))


def test_ethnicity_normalisation(spark):
    vals = ["HISPANIC OR LATINO", "NOT HISPANIC OR LATINO", "DECLINED", None, "Not HISPANIC", "NOT STATED"]
    df = spark.createDataFrame([(v,) for v in vals], "e string")
    got = [r[0] for r in df.select(co.normalise_ethnicity(F.col("e"))).collect()]
    assert got == ["Hispanic or Latino", "Not Hispanic or Latino", "Unknown", "Unknown", "Not HISPANIC", "Unknown"]


def test_composite_or_is_three_valued(spark):
    df = spark.createDataFrame([(1, None), (0, None), (0, 0), (None, 1)], "a int, b int")
    got = [r[0] for r in df.select(co.composite_or(F.col("a"), F.col("b"))).collect()]
    assert got == [1, None, 0, 1]


def test_smd_binary_matches_closed_form(spark):
    rows = [("A", str(int(i < 30))) for i in range(100)] + [("B", str(int(i < 50))) for i in range(100)]
    df = spark.createDataFrame(rows, "s string, v string")
    cat = tableone.categorical(df, "s", ["v"])
    smd = tableone.smd_categorical(cat).first().smd
    p, q = 0.3, 0.5
    assert smd == pytest.approx(abs(p - q) / np.sqrt((p * (1 - p) + q * (1 - q)) / 2))


def test_smd_continuous_symmetric(spark):
    rows = [("A", float(x)) for x in range(10)] + [("B", float(x) * 2) for x in range(10)]
    df = spark.createDataFrame(rows, "s string, x double")
    a = tableone.smd_continuous(tableone.continuous(df, "s", ["x"])).first().smd
    flipped = df.withColumn("s", F.when(F.col("s") == "A", "Z").otherwise("A"))
    b = tableone.smd_continuous(tableone.continuous(flipped, "s", ["x"])).first().smd
    assert a == pytest.approx(b)


def test_table_one_unchanged_by_repartition(spark):
    rows = [("A" if i % 3 else "B", float(i) * 1.37, None if i % 7 == 0 else float(i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    a = sorted(tableone.continuous(df, "s", ["x", "y"]).collect())
    b = sorted(tableone.continuous(df.repartition(7), "s", ["x", "y"]).collect())
    assert a == b


def test_auc_perfect_and_constant(spark):
    rows = [(i, "g", "k", int(i < 50), float(i < 50)) for i in range(100)]
    rows += [(i, "g", "c", int(i < 50), 0.5) for i in range(100)]
    long = spark.createDataFrame(rows, "id long, grp string, target string, truth int, score double")
    got = {r.target: r.auc for r in metrics.auroc(long).collect()}
    assert got["k"] == pytest.approx(1.0)
    assert got["c"] == pytest.approx(0.5)


def test_ols_factor_matches_numpy(spark):
    rng = np.random.default_rng(3)
    w = rng.choice(["a", "b", "c"], size=300)
    y = rng.normal(size=300) + (w == "b") * 1.5
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(w, y)], "w string, y double")
    got = {r.term: r for r in effects.ols_factor(df, "y", "w").collect()}
    X = np.column_stack([np.ones(300), w == "b", w == "c"]).astype(float)
    beta, res, *_ = np.linalg.lstsq(X, y, rcond=None)
    sigma = np.sqrt(res[0] / (300 - 3))
    se = sigma * np.sqrt(np.diag(np.linalg.inv(X.T @ X)))
    assert got["(Intercept)"].estimate == pytest.approx(beta[0], abs=1e-5)
    assert got["Wb"].estimate == pytest.approx(beta[1], abs=1e-5)
    assert got["Wc"].std_error == pytest.approx(se[2], abs=1e-5)


def test_aipw_closed_form_matches_row_level(spark):
    rng = np.random.default_rng(5)
    n = 2000
    x = rng.choice(["s1", "s2"], size=n)
    w = np.where(rng.random(n) < np.where(x == "s1", 0.3, 0.6), "t", "c")
    y = (rng.random(n) < 0.3 + 0.2 * (w == "t") + 0.1 * (x == "s2")).astype(int)
    df = spark.createDataFrame([(a, b, int(c)) for a, b, c in zip(x, w, y)], "x string, w string, y int")
    got = effects.aipw_stratified(df, "y", "w", ["x"]).first()
    mu = {(s, a): y[(x == s) & (w == a)].mean() for s in ("s1", "s2") for a in ("c", "t")}
    e = {(s, a): ((x == s) & (w == a)).sum() / (x == s).sum() for s in ("s1", "s2") for a in ("c", "t")}
    d = np.array([mu[(s, "t")] - mu[(s, "c")] + (a == "t") * (yy - mu[(s, "t")]) / e[(s, "t")]
                  - (a == "c") * (yy - mu[(s, "c")]) / e[(s, "c")] for s, a, yy in zip(x, w, y)])
    assert got.estimate == pytest.approx(d.mean(), abs=1e-9)
    assert got.std_err == pytest.approx(d.std(ddof=1) / np.sqrt(n), abs=1e-9)


def test_aipw_keeps_strata_that_lack_another_arm(spark):
    rows = [(x, w, y) for x, w, y, times in (
        ("full", "c", 0, 6), ("full", "c", 1, 2), ("full", "t", 1, 6), ("full", "t", 0, 2), ("full", "u", 1, 4),
        ("no_u", "c", 0, 5), ("no_u", "c", 1, 5), ("no_u", "t", 1, 8), ("no_u", "t", 0, 2),
        ("no_c", "t", 1, 3), ("no_c", "z", 0, 4)) for _ in range(times)]
    got = {r.arm: r for r in effects.aipw_stratified(
        spark.createDataFrame(rows, "x string, w string, y int"), "y", "w", ["x"]).collect()}
    # t against c: 20 rows of both strata with a difference of 0.5 and 0.3
    assert got["t"].estimate == pytest.approx((20 * 0.5 + 20 * 0.3) / 40)
    kept = {k: (r.n, r.n_dropped, r.n_strata, r.strata_dropped) for k, r in got.items()}
    assert kept == {"t": (40, 7, 2, 1), "u": (20, 27, 1, 2), "z": (0, 47, 0, 3)}
    assert got["z"].estimate is None and got["z"].std_err is None


def test_bootstrap_variants_agree(spark):
    rng = np.random.default_rng(7)
    rows = [("g", i, int(v)) for i, v in enumerate(rng.random(400) < 0.3)]
    df = spark.createDataFrame(rows, "g string, k long, v int")
    b1 = intervals.bootstrap_distribution(df, ["g"], "k", "v", 200, 46664).first()
    reps = intervals.poisson_replicates(df, ["g"], [F.col("k")], F.col("v"), 200, 46664)
    b2 = intervals._replicate_quantiles(reps, ["g"], "rep_mean").first()
    assert b1.L95 <= 0.3 <= b1.U95 or abs(b1.Center - 0.3) < 0.05
    assert b2.Median == pytest.approx(b1.Center, abs=0.02)
    assert (b2.U95 - b2.L95) == pytest.approx(b1.U95 - b1.L95, rel=0.25)


def test_bootstrap_method_is_named(spark, monkeypatch):
    rows = [("g", i, float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    out = intervals.bootstrap_mean_ci(df, ["g"], "k", "v", 200, 1, method="poisson").first()
    assert out.lcl < out.mean < out.ucl
    whole = intervals.bootstrap_mean_ci(df, ["g"], "k", "v", 50, 1, form="rows").first()
    monkeypatch.setattr(intervals, "DRAW_BLOCK", 7)  # blocks change nothing
    assert intervals.bootstrap_mean_ci(df, ["g"], "k", "v", 50, 1, form="rows").first() == whole
    whole = intervals.bootstrap_mean_ci(df, ["g"], "k", "v", 60, 1).first()
    monkeypatch.setattr(intervals, "REPLICATE_BLOCK", 7)
    assert intervals.bootstrap_mean_ci(df, ["g"], "k", "v", 60, 1).first() == whole
    with pytest.raises(ValueError):
        intervals.bootstrap_mean_ci(df, ["g"], "k", "v", 50, 1, method="auto")


@pytest.mark.parametrize("bins,few", [(stats.BINS, stats.FEW), (4, 3), (64, 0)])
def test_exact_quantiles_with_ties_outliers_and_odd_values(spark, monkeypatch, bins, few):
    """Refinement ends at the exact order statistics whatever the spread of the values."""
    monkeypatch.setattr(stats, "BINS", bins)
    monkeypatch.setattr(stats, "FEW", few)
    rng = np.random.default_rng(5)
    groups = {"ties": [3.5] * 900 + rng.normal(size=100).tolist(), "huge": [1e300, -1e300, 5e-324, 1e-323, -0.0, 0.0, 1.0, 1.0 + 2**-52],
              "normal": rng.normal(1e6, 1e-3, 300).tolist(), "one": [7.0], "lognormal": np.exp(rng.normal(0, 30, 200)).tolist(), None: [2.0, 1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.3, 0.5, 0.987, 1.0]
    got = {(r.g, r.p): r for r in stats.exact_quantiles(df, "g", "v", probs).collect()}
    assert set(got) == {(g, p) for g in groups for p in probs}
    for g, vs in groups.items():
        for p in probs:
            x, h = sorted(vs), (len(vs) - 1) * p
            low, high = x[int(np.floor(h))], x[int(np.ceil(h))]
            assert got[g, p].q == (low if low == high else low + (high - low) * (h - np.floor(h))), (g, p)
            assert got[g, p].n == len(vs)


def test_tied_values_cost_one_count(spark):
    """No shuffle of the plans that count carries a row for each of the tied rows."""
    df = spark.range(0, 300_000, numPartitions=6).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).cast("double").alias("v"))
    ends = stats.exact_quantiles(df, "g", "v", [0.25, 0.99]).collect()
    x = np.sort(np.where(np.arange(300_000) % 10 == 0, np.arange(300_000), 5).astype(float))
    assert [r.q for r in sorted(ends, key=lambda r: r.p)] == np.quantile(x, [0.25, 0.99]).tolist()
    counted = df.groupBy("g", stats._first_bins(F.col("v"))).count()
    assert counted.count() < 1000


@pytest.mark.parametrize("seeds", [[7], [3, 1, 2], list(range(1, 101))])
def test_seed_search_counts_every_seed(spark, seeds):
    """Packed counters against the split applied seed by seed."""
    from benchcohort.operators import split
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.random() < 0.3), int(rng.random() < 0.6), float(i % 3)) for i in range(500)] + [(900, None, 1, 1.0)]
    df = spark.createDataFrame(rows, "k long, a int, `b.c` int, d double").repartition(3)
    weights = {"a": 1.0, "b.c": 0.25, "d": 2.0}
    got = split.split_seed_search(df, "k", weights, seeds).collect()
    clean, want = [r for r in rows if r[1] is not None], {}
    for seed in seeds[:3]:
        train = {r.k for r in split.hash_split(df.select("k"), "k", seed).filter("set = 'Train'").collect()}
        sums = [(sum(r[j] for r in clean), sum(r[j] for r in clean if r[0] in train)) for j in (1, 2, 3)]
        m = sum(r[0] in train for r in clean)
        want[seed] = (m, sum(abs(w * s / 500 - w * t / m) for w, (s, t) in zip(weights.values(), sums)))
    for r in got:
        assert r.n_all == 500
        if r.seed in want:
            assert (r.n_train, pytest.approx(r.score, abs=1e-12)) == want[r.seed]
    best = min(got, key=lambda r: (r.score, r.seed))
    assert [r.seed for r in got if r.is_best] == [best.seed] and len(got) == len(seeds)


def test_exact_split_sizes_are_whole_number_arithmetic(spark):
    """0.7 x 90 falls short of 63 in floating point."""
    from benchcohort.operators import split
    for n in (90, 170, 10, 1, 0):
        df = split.exact_size_split(spark.range(n).withColumnRenamed("id", "k"), "k", 3)
        assert df.filter("set = 'Train'").count() == n * 7 // 10


@pytest.mark.parametrize("method", intervals.METHODS)
def test_cells_and_rows_draw_from_one_distribution(spark, method):
    """Few and many values, heavy ones, nulls: means and spreads of replicate means, by either form."""
    rng = np.random.default_rng(3)
    groups = {"binary": (rng.random(900) < 0.2).astype(float).tolist(), "many": rng.normal(5, 2, 500).tolist(),
              "mixed": [0.0] * 300 + [1.0] * 40 + rng.random(60).tolist() + [None] * 100, "one": [2.5], "null": [None] * 3}
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    R, found = 600, {}
    for form in intervals.FORMS:
        reps = intervals._replicates(df, ["g"], "k", "v", R, 9, method, form)[0]
        found[form] = {r.g: r for r in reps.groupBy("g").agg(F.avg("rep_mean").alias("m"), F.stddev("rep_mean").alias("s"),
                                                             F.count("rep_mean").alias("n")).collect()}
    for g in ("binary", "many", "mixed"):
        known = np.array([v for v in groups[g] if v is not None])
        se = known.std() / np.sqrt(len(known))
        for form in intervals.FORMS:
            r = found[form][g]
            assert r.n == R and abs(r.m - known.mean()) < 5 * se / np.sqrt(R)
            assert r.s == pytest.approx(se, rel=0.2)
    assert found["cells"]["one"].m == 2.5
    assert "null" not in found["cells"] or found["cells"]["null"].m is None
    out = intervals.bootstrap_distribution(df, ["g"], "k", "v", 100, 9, method).collect()
    assert {r.g: r.n for r in out if r.n} == {g: sum(v is not None for v in vs) for g, vs in groups.items() if g != "null"}


def test_multinomial_cells_draw_every_unit_once_on_average(spark, monkeypatch):
    """Each replicate has exactly n draws, whatever the leaves; cell shares are right over all replicates."""
    monkeypatch.setattr(intervals, "LEAF", 4)
    rows = [(i, float(v)) for i, v in enumerate([0] * 50 + [1] * 3 + [2] * 30 + list(range(3, 40)))]
    df = spark.createDataFrame(rows, "k long, v double").withColumn("g", F.lit("a"))
    leaves = intervals.leaves_of(intervals.cells_of(df, ["g"], "v"), ["g"]).orderBy("place").collect()
    assert sum(r.w for r in leaves) == len(rows) and max(r.w for r in leaves if r.m > 1) <= 8
    assert [c.v for r in leaves for c in r.cells] == sorted({v for _, v in rows})
    for value in (0.0, 2.0, 17.0):  # the mean of an indicator is the share drawn
        one = df.withColumn("v", F.when(F.col("v") == value, 1.0).otherwise(F.col("v") * 1e-9))
        shares = [r.rep_mean for r in intervals.multinomial_cells(one, ["g"], "v", 400, 5)[0].collect()]
        n, p = len(rows), sum(v == value for _, v in rows) / len(rows)
        assert all(abs(s * n - round(s * n)) < 1e-3 for s in shares)
        assert abs(np.mean(shares) - p) < 5 * np.sqrt(p * (1 - p) / n / 400)


def test_bootstrap_cost_does_not_grow_with_equal_units(spark):
    """A million units of two values cost what their two cells cost."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("double").alias("v"))
    r = intervals.bootstrap_mean_ci(df, ["g"], "k", "v", 1000, 4).first()
    half = 1.96 * np.sqrt(0.1875 / 1e6)
    assert r.mean == 0.25 and r.n == 1_000_000
    assert r.lcl == pytest.approx(0.25 - half, abs=half / 5) and r.ucl == pytest.approx(0.25 + half, abs=half / 5)


def test_edges_of_metrics_effects_codes_and_scorecard(spark):
    from benchcohort.functions.exact import fixed_moments, sd_from_moments
    from benchcohort.operators import cohort, effects, metrics, scorecard
    long = spark.createDataFrame([("a", "x", 1, .5), ("a", "x", 0, .2), ("b", "x", 0, .5)],
                                 "grp string, target string, truth int, score double")
    for metric in (metrics.auroc, metrics.auprc):
        got = {(r[0], r[1]): r[2] for r in metric(long).select("grp", "target", metric.__name__.replace("auroc", "auc")).collect()}
        assert got[("a", "x")] is not None and got[("b", "x")] is None
    flat = spark.createDataFrame([("p", 1.0), ("q", 1.0), ("p", 1.0)], "w string, y double")
    assert all(r.t_value is None and r.r_squared is None for r in effects.ols_factor(flat, "y", "w").collect())
    codes = spark.createDataFrame([(12345, "7"), (6, "007")], "n int, s string")
    assert [r.n for r in cohort.pad_code(codes, "n", width=3).collect()] == ["12345", "006"]
    assert [r.s for r in cohort.pad_code(codes, "s", width=5).collect()] == ["7", "007"]
    big = spark.createDataFrame([(1e13,), (1e13 + 2,), (-1e13,), (0.25,)], "x double")
    m = big.agg(*fixed_moments(F.col("x"), "m")).select(sd_from_moments(F.col("m_n"), F.col("m_s1"), F.col("m_s2"))).first()[0]
    assert m == pytest.approx(np.std([1e13, 1e13 + 2, -1e13, 0.25], ddof=1), rel=1e-12)
    rows = [("B", "m", "", .5, .4, .6), ("B", "m", "", .6, .5, .7)]
    sc = spark.createDataFrame(rows, "Bench string, Model string, Improve string, Center double, L95 double, U95 double")
    with pytest.raises(Exception, match="two scorecard entries for B / m"):
        scorecard.compare_to_base(sc).collect()


def test_poisson_counts_have_mean_one():
    from benchcohort.functions.hashing import POISSON1_CUTS, TWO32
    assert len(POISSON1_CUTS) == 12
    assert sum(1 - cut / TWO32 for cut in POISSON1_CUTS) == pytest.approx(1, abs=1e-8)


def test_exact_size_split_and_hash_split_agree(spark):
    from benchcohort.operators import split
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    exact = split.exact_size_split(df, "k", 1221)
    assert exact.filter("set = 'Train'").count() == 700
    approx = split.hash_split(df, "k", 1221)
    both = exact.join(approx.withColumnRenamed("set", "s2"), "k")
    # the exact split is the approximate one with the threshold moved to the 700th draw
    assert both.filter("set != s2").count() <= 40


def test_auc_hot_class_over_many_partitions(spark):
    """A class holding most rows, with thousands of distinct scores, spread
    over many range partitions: the distributed running totals are exact."""
    rng = np.random.default_rng(11)
    n = 4000
    truth = (rng.random(n) < 0.4).astype(int)
    score = np.round(rng.random(n) * 0.6 + 0.4 * truth, 4)
    rows = [(i, "all", "hot", int(t), float(v)) for i, (t, v) in enumerate(zip(truth, score))]
    rows += [(i, "all", "cold", int(t), float(v)) for i, (t, v) in enumerate(zip(truth[:50], score[:50]))]
    long = spark.createDataFrame(rows, "id long, grp string, target string, truth int, score double")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.target: r.auc for r in metrics.auroc(long).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    pos, neg = score[truth == 1], score[truth == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got["hot"] == pytest.approx(brute, abs=1e-12)


def test_column_profile_exact_and_approx_agree(spark):
    rows = [(i % 3, None if i % 5 == 0 else float(i % 7), "s" + str(i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b double, c string")
    exact = {r.column: r for r in co.column_profile(df, ["a", "b", "c"]).collect()}
    approx = {r.column: r for r in co.column_profile(df, ["a", "b", "c"], approx_distinct=True).collect()}
    for k in ("a", "b", "c"):
        assert exact[k].n_missing == approx[k].n_missing
        assert exact[k].n_distinct == approx[k].n_distinct
        assert exact[k].is_categorical == approx[k].is_categorical
    assert exact["b"].n_missing == 40 and exact["c"].is_categorical == 1 and exact["a"].is_categorical == 0


def test_recode_paths_agree(spark):
    """Broadcast join and shuffle join give the same recode."""
    vals = ["INTERVENTION_ARIPIPRAZOLE.ORAL.ANTIPSYCHOTIC", "REF_CLOZAPINE", None, "INTERVENTION_TYPICAL",
            "ABILIFY.MAINTENA"]
    df = spark.createDataFrame([(i, vals[i % len(vals)]) for i in range(50)], "k int, v string")
    bcast = co.recode_via_distinct(df, "v", "r")
    shuffle = co.recode_via_distinct(df, "v", "r", most_broadcast_bytes=0)
    a, b = (sorted(((r.k, r.v, r.r) for r in x.collect()), key=str) for x in (bcast, shuffle))
    assert a == b
    got = {v: r for _, v, r in a}
    assert got["INTERVENTION_ARIPIPRAZOLE.ORAL.ANTIPSYCHOTIC"] == "Oral.Ari"
    assert got["REF_CLOZAPINE"] == ".Clozapine" and got[None] is None


def test_column_roles_are_decided_by_name_and_rank():
    from benchcohort.operators.roles import column_roles
    names = ["zip", "log_x", "cci_b", "outcome_regimen.12mo", "index_year", "outcome_ip.visit.or.regimen.12mo", "b", "charl_a", "age",
             "outcome_er.visit.06mo", "src", "outcome_ip.visit.any.12mo", "intervention", "years_followup_ge1", "outcome_other.12mo",
             "patient_id", "index_date", "baseline_years.since.initial.dx"]
    r = column_roles(names)
    assert r.identifiers == ["src", "patient_id", "index_date"] and r.treatment == ["intervention"] and r.excluded == ["zip", "log_x"]
    assert r.outcomes == ["outcome_ip.visit.or.regimen.12mo", "outcome_ip.visit.any.12mo", "outcome_regimen.12mo", "outcome_other.12mo"]
    assert r.other_outcomes == ["outcome_er.visit.06mo"]
    assert r.predictors == ["age", "index_year", "cci_b", "charl_a", "b", "years_followup_ge1", "baseline_years.since.initial.dx"]
    assert r.table_one == [*r.outcomes, "years_followup_ge1", "baseline_years.since.initial.dx", "src", "age", "index_year", "cci_b", "charl_a", "b"]
    assert column_roles(names, strata="src").table_one[6] == "intervention"
    assert column_roles(["x", "cci_z"]).predictors == ["x", "cci_z"] and column_roles([]).rows() == []
    everything = [n for _, _, n in column_roles(names).rows()]
    assert set(everything) == set(names)


def test_levels_are_bounded_and_nulls_are_no_level(spark, monkeypatch):
    df = spark.createDataFrame([("b", "x"), ("a", None), (None, "x"), ("b", "y")], "g string, h string")
    assert co.levels(df, "g") == [None, "a", "b"]
    assert {(r.g, r.Freq) for r in co.frequency_table(df, "g").collect()} == {("a", 1), ("b", 2)}
    assert {(r.row, r.col, r.share) for r in co.contingency_share(df, "g", "h").collect()} == {("b", "x", 0.5), ("b", "y", 0.5)}
    assert {(r.g, r.code) for r in co.category_codes(df, "g", "code").collect()} == {("a", 0), ("b", 1), (None, None)}
    assert co.categorical_columns(df.withColumn("n", F.lit(2)).withColumn("m", F.lit(None).cast("int")), ["g", "n", "m"]) == ["g", "m"]
    assert co.filter_sources(df, ["B"], "g").count() == 2 and co.filter_sources(df, ["ALL"], "g").count() == 4
    monkeypatch.setattr(co, "MOST_LEVELS", 1)
    with pytest.raises(ValueError, match="levels"):
        co.levels(df, "g")


def test_report_options_select_rows_and_markers(spark):
    from benchcohort.operators import report
    rows = [  # Bench, Model, Center, Improve, Best, BestMeta, Improve_Last, Base, Progress, Improve_Label
        ("Ax", "o3", 0.5, "", 0, 0, 0, None, None, None), ("Ax", "M", 0.4, "", 0, 1, 0, None, None, None),
        ("Ax", "M-rag1", 0.45, "-rag1", 0, 0, 0, "M", "Better", "R1"), ("Ax", "M-rag2", 0.6, "-rag2", 1, 0, 1, "M", "Better", "R2"),
        ("Ax", "M-prompt", 0.3, "-prompt", 0, 0, 1, "M", "Worse", "P"), ("Ax", "low", 0.1, "", 0, 0, 0, None, None, None),
        ("By", "o3", 0.2, "", 1, 0, 0, None, None, None)]
    names = "Bench Model Center Improve Best BestMeta Improve_Last Base Progress Improve_Label".split()
    sc = spark.createDataFrame(rows, "Bench string, Model string, Center double, Improve string, Best int, BestMeta int, Improve_Last int, "
                                     "Base string, Progress string, Improve_Label string").toDF(*names)
    for n in ("L95", "U95", "Center_Best"):
        sc = sc.withColumn(n, F.col("Center"))
    sc = sc.withColumns({"limits_not_ci": F.lit(0), "Worse": F.lit(0)})
    options = report.ReportOptions
    models = lambda o: sorted((r.Bench, r.Model) for r in report.selected_rows(sc, o).collect())
    everything = sorted((r[0], r[1]) for r in rows)
    assert models(options(improvements="Regular", last_only=False)) == everything
    assert models(options()) == [r for r in everything if r[1] != "M-rag1"]
    assert models(options(bench=["^B", "zz"])) == [("By", "o3")]
    assert models(options(exclude=["O3"], down_to="o3", last_only=False)) == [("Ax", "M-rag2")]
    assert models(options(include=["LOW"])) == [("Ax", "low")]
    out = {(r.Bench, r.Model): r for r in report.report_layout(sc, options()).collect()}
    assert out["Ax", None].Showing == "(Showing 3 of 5 models)" and out["By", None].Showing == "(Showing all 1 models)"
    assert [m for (b, m), r in sorted(out.items(), key=lambda x: -x[1].y)] == [None, "M-rag2", "o3", "M", None, "o3"]
    assert out["Ax", "M"].BestMeta == 1 and out["Ax", "M"].Showing is None and sorted(r.y for r in out.values()) == list(range(6))
    layout = report.report_layout(sc, options(top_only=False))
    marks = lambda **o: sorted(r.Improve_Label for r in report.overlay_markers(layout, sc, options(**{k: v for k, v in o.items() if k != "best"}), o.get("best", False)).collect())
    assert marks() == ["P", "R2"] and marks(last_only=False) == ["P", "R1", "R2"]
    assert marks(improvements="Worse") == ["P"] and marks(best=True) == ["R2"]


def test_poisson_weights_are_added_up_in_the_tasks(spark, monkeypatch):
    """No row a replicate before the sums; blocks and group limits change nothing; nulls weigh but add nothing."""
    from benchcohort.functions.hashing import h, poisson1_of, stream
    rows = [(None if i % 7 == 0 else "ab"[i % 2], i, None if i % 5 == 0 else i % 11) for i in range(300)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    w = poisson1_of(stream(h(5, F.col("k")), F.col("r"))).cast("long")
    want = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("r")).groupBy("g", "r").agg(
        F.try_divide(F.sum(w * F.col("v")), F.sum(w)).alias("m")).collect()
    for blocks in ({}, {"UNIT_BLOCK": 7, "WEIGHT_BLOCK": 3, "MOST_GROUPS": 1}):
        for name, value in blocks.items():
            monkeypatch.setattr(intervals, name, value)
        reps = intervals.poisson_replicates(df, ["g"], [F.col("k")], F.col("v"), 20, 5)
        assert {(r.g, r.r): r.rep_mean for r in reps.collect()} == {(r.g, r.r): r.m for r in want}
    for found in (reps, intervals.poisson_cells(df, ["g"], "v", 20, 5)[0]):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "sequence(" not in plan


def test_poisson_bootstrap_draws_a_weight_for_each_line_item(spark, tmp_path):
    """Line items of equal values have weights of their own: other keys, other draws."""
    from benchcohort.plans import ORACLES, QUERIES
    assert "l_orderkey" in ORACLES["bootstrap_poisson"]
    got = []
    for first in (0, 1000):
        rows = [(first + i, 1, 2, 3, 100.0 + i, (i % 3) / 100, "A") for i in range(60)]
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, "
                                    "l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/{first}/lineitem.parquet")
        got.append(QUERIES["bootstrap_poisson"](spark, f"{tmp_path}/{first}").first())
    a, b = got
    assert (a.n, a.mean, a.R_used) == (b.n, b.mean, b.R_used) == (60, 0.01, 1000)
    assert (a.L95, a.Median, a.U95) != (b.L95, b.Median, b.U95) and a.L95 < 0.01 < a.U95


def test_multinomial_draws_are_made_in_the_tasks(spark):
    """No row for each replicate and leaf: a leaf's replicates stay together by blocks until they are added up."""
    df = spark.createDataFrame([("g", i, i / 7) for i in range(200)], "g string, k long, v double")
    reps = intervals.multinomial_cells(df, ["g"], "v", 120, 5)[0]
    assert sorted(r.r for r in reps.collect()) == list(range(120))
    plan = reps._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan
