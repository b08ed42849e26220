import random

import pytest
from chartweave.operators import metrics as M
from chartweave.operators import tasks


def run(spark, rows, **kw):
    """rows: (grp, y, yhat, score)"""
    df = spark.createDataFrame([("m", "t", *r) for r in rows], "model string, task string, grp string, y string, yhat string, score double")
    out = M.subgroup_metrics(M.mark_positive(df, {"t": "1"}), digits=None, **kw)
    return {r["grp"]: r.asDict() for r in out.collect()}


def test_one_class(spark):
    got = run(spark, [("all", "1", "1", 0.3), ("all", "1", "1", 0.4)])["all"]
    assert got["micro_f1"] == 1 and got["auroc"] == 0
    assert got["specificity"] == 0 and got["sensitivity"] == 0


def test_ties_count_one_half(spark):
    assert run(spark, [("all", "0", "0", 0.5), ("all", "1", "0", 0.5)])["all"]["auroc"] == 0.5


def test_perfect_ranking(spark):
    got = run(spark, [("all", "1", "1", 0.9), ("all", "0", "0", 0.1)])["all"]
    assert got["auroc"] == 1 and got["auprc"] == 1
    assert got["specificity"] == 1 and got["sensitivity"] == 1


def test_multiclass_areas_are_zero(spark):
    got = run(spark, [("all", "1", "1", 0.9), ("all", "0", "0", 0.1), ("all", "2", "0", 0.2)])["all"]
    assert got["auroc"] == 0 and got["auprc"] == 0 and got["specificity"] == 0
    assert got["micro_f1"] == pytest.approx(2 / 3)
    assert got["macro_f1"] == pytest.approx((1 + 2 / 3 + 0) / 3)


def brute(rows):
    pos = [s for y, s in rows if y == "1"]
    neg = [s for y, s in rows if y != "1"]
    auroc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    area, r0, p0 = 0.0, 0.0, 1.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        r, p = tp / len(pos), tp / (tp + fp)
        area += (r - r0) * (p + p0) / 2
        r0, p0 = r, p
    return auroc, area


@pytest.mark.parametrize("kw", [{}, {"max_group_rows": 3, "slices": 5}])
def test_areas_against_brute_force(spark, kw):
    rng = random.Random(3)
    rows = [(rng.choice("01"), round(rng.random(), 2)) for _ in range(120)]
    got = run(spark, [("all", y, "0", s) for y, s in rows], **kw)["all"]
    auroc, auprc = brute(rows)
    assert got["auroc"] == pytest.approx(auroc) and got["auprc"] == pytest.approx(auprc)
    flipped = run(spark, [("all", y, "0", -s) for y, s in rows], **kw)["all"]
    assert flipped["auroc"] == pytest.approx(1 - auroc)


def test_subgroups(spark):
    df = spark.createDataFrame([("M", "WHITE"), ("F", "OTHER"), (None, None)], "gender string, ethnicity string")
    got = tasks.with_subgroups(df, tasks.SUBGROUPS).groupBy("grp").count().collect()
    assert {r["grp"]: r["count"] for r in got} == {"all": 3, "men": 1, "women": 1, "white": 1}


def test_no_python_in_the_metric_plan(spark):
    df = spark.createDataFrame([("m", "t", "all", "1", "1", 0.5)], "model string, task string, grp string, y string, yhat string, score double")
    plan = M.confusion(M.cells(M.mark_positive(df, {"t": "1"})))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
