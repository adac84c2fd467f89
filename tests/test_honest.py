import datetime as dt

from asofkit.operators import learn as M


def test_judged_folds(spark):
    d = lambda y, m=6: dt.date(y, m, 1)
    fit = spark.createDataFrame([(1, d(2000)), (1, d(2001)), (2, d(2000)), (2, d(2002, 7)), (3, d(2004)), (5, None)], "fold int, d date")
    scored = spark.createDataFrame([(1, d(2002)), (1, d(2002, 9)), (2, d(2002)), (2, d(2002, 9)), (3, d(2003)), (4, d(2003)), (5, d(2003))], "fold int, d date")
    got = {r.fold: r for r in M.judge_folds(scored, M.fit_window(fit, "fold", "d"), "fold", "d").collect()}
    # before, overlapping, fitted on later days, no window at all, window without days
    assert {f: r.honest for f, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert (got[1].fit_start, got[1].fit_end, got[1].eval_start, got[1].eval_end) == (d(2000), d(2001), d(2002), d(2002, 9))


def test_dishonest_folds_leave_the_pool(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, True), (1, 0, 0.5, True), (2, 1, 0.999, False)], "fold int, y int, p double, ok boolean")
    got = {r.fold: (r.n, round(r.ll, 6), r.honest) for r in M.evaluate_folds(rows, "fold", "y", "p", "ok").collect()}
    assert got[None] == (2, 0.693147, True) and got[2][2] is False
