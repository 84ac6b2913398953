"""Properties of the full scorecard: intervals contain their
centre, every bench has its best row(s), worse means below the top row's
lower limit, flags are 0/1 and (Bench, Model) is unique."""

from collections import defaultdict

import __spark_entry__ as entry

from .conftest import SF_SMALL


def test_full_scorecard_properties(spark):
    rows = entry.queries()["full_scorecard"](spark, SF_SMALL).collect()
    assert rows
    assert len({(r.Bench, r.Model) for r in rows}) == len(rows)
    by_bench = defaultdict(list)
    for r in rows:
        by_bench[r.Bench].append(r)
        assert r.L95 <= r.U95 + 1e-12
        assert r.L95 - 1e-6 <= r.Center <= r.U95 + 1e-6, (r.Bench, r.Model)
        for flag in (r.Best, r.Worse, r.Meta, r.BestMeta, r.Improve_Last, r.limits_not_ci):
            assert flag in (0, 1)
        if r.Improve == "":
            assert r.Base is None and r.Improve_Last == 0
    for bench, rs in by_bench.items():
        top = max(r.Center for r in rs)
        best = [r for r in rs if r.Best == 1]
        assert best and all(abs(r.Center - top) < 1e-9 for r in best), bench
        lead = sorted(rs, key=lambda r: (-r.Center, r.Model))[0]
        for r in rs:
            assert r.Worse == int(r.Center < lead.L95 - 1e-9) or abs(r.Center - lead.L95) < 1e-6, (bench, r.Model)
            assert r.Center_Best == top
        metas = [r for r in rs if r.Meta == 1]
        if metas:
            top_meta = max(r.Center for r in metas)
            assert all(r.BestMeta == int(r.Meta == 1 and abs(r.Center - top_meta) < 1e-9) for r in rs), bench


def test_aipw_ml_agrees_with_stratified_and_is_not_degenerate(spark):
    qs = entry.queries()
    sf = "/root/testdata/sf0.01"
    ml = {r.arm: r for r in qs["aipw_ml"](spark, sf).collect()}
    st = {r.arm: r for r in qs["aipw_stratified"](spark, sf).collect()}
    assert set(ml) == set(st) and ml
    for arm, r in ml.items():
        assert r.std_err > 1e-4, arm  # a near-zero SE would mean the outcome leaked into the features
        assert abs(r.estimate - st[arm].estimate) < 4 * max(r.std_err, st[arm].std_err), arm
