import datetime as dt

from pyspark.sql import functions as F

from vinculum.operators import references as R

T = lambda d: dt.datetime(2024, 1, d)


def refs(spark, rows):
    return spark.createDataFrame(rows, R.REFERENCE)


def parents(spark, rows):
    return spark.createDataFrame(rows, R.PARENT)


def orphans(state):
    return {r.row_no for r in state.orphans().collect()}


def test_arrivals_resolve_and_deletions_reopen(spark):
    s = R.advance(R.OrphanState.empty(spark), refs(spark, [("t", 1, "f", "a", T(5)), ("t", 2, "f", "b", T(5)), ("t", 3, "f", "a", T(20)), ("t", 4, "f", None, T(1)), ("t", 5, "f", "c", None)]), parents(spark, [("a", T(1), None)]))
    assert orphans(s) == {2, 5}
    s = R.advance(s, refs(spark, []), parents(spark, [("b", T(5), None), ("c", T(1), None)]))
    assert orphans(s) == {5}
    s = R.advance(s, refs(spark, [("t", 3, "f", "a", T(20)), ("t", 6, "f", "a", T(9))]), parents(spark, [("a", T(1), T(10))]))
    assert orphans(s) == {3, 5}
    snap = {(r.table_name, r.period.day, r.orphans, r.refs) for r in s.snapshot("day").filter("period is not null").collect()}
    assert ("t", 20, 1, 1) in snap and ("t", 9, 0, 1) in snap


def test_one_batch_equals_many(spark):
    r = [("t", k, "f", "abc"[k % 3], T(1 + k % 28)) for k in range(60)]
    p = [("a", T(3), T(9)), ("a", T(15), None), ("b", T(10), None), ("a", T(3), T(9))]
    whole = orphans(R.first_state(refs(spark, r), parents(spark, p)))
    s = R.OrphanState.empty(spark)
    for k in range(3):
        s = R.advance(s, refs(spark, r[20 * k : 20 * k + 20]), parents(spark, p[k : k + 2]))
    want = {k for _, k, _, key, at in r if not any(x == key and b <= at and (e is None or e > at) for x, b, e in p)}
    assert whole == want == orphans(s)


def test_writings_of_a_uuid(spark):
    u = "262f399f-9fb0-4b2d-a429-20ad60093e43"
    rows = [(x,) for x in (u, u.upper(), u.replace("-", ""), "{" + u + "}", f"urn:uuid:{u}", f" {u} ", "other", None)]
    got = [r.k for r in spark.createDataFrame(rows, "v string").select(R.uuid_key(F.col("v")).alias("k")).collect()]
    assert set(got[:6]) == {u.replace("-", "")} and got[6:] == ["other", None]


def test_claims(spark):
    claims = spark.createDataFrame([(1, 10, 2), (2, 11, 0), (3, 12, None), (4, 13, 1), (5, None, 0), (6, None, 3)], "row_no int, document int, claimed long")
    staged = spark.createDataFrame([(1, 10, True), (2, 10, False), (3, 10, False), (4, 13, False)], "row_no int, document int, has_null boolean")
    broken = spark.createDataFrame([(2,), (2,)], "row_no int")
    assert {r.row_no for r in R.wrong_claims(claims, staged, broken).collect()} == {4, 6}


def test_any_stored_row_of_a_parent_resolves(spark):
    s = R.first_state(refs(spark, [("t", 1, "f", "a", T(5))]), parents(spark, [("a", T(1), T(3)), ("a", T(1), None)]))
    assert orphans(s) == set()


def test_advance_keeps_every_stored_row(spark):
    s = R.advance(R.OrphanState.empty(spark), refs(spark, [("t", 1, "f", "a", T(5))]), parents(spark, [("a", T(1), T(3)), ("a", T(1), None)]))
    assert orphans(s) == set()


def test_replay_by_periods_equals_the_definition(spark):
    p = [("a", T(1), None), ("a", T(1), T(3)), ("b", T(2), T(9)), ("b", T(2), T(5)), ("b", T(20), None), ("c", T(6), T(4)), ("d", T(3), T(3)), ("e", None, None)]
    r = [("t", 30 * i + d, "f", k, T(d)) for i, k in enumerate("abcdefg") for d in range(1, 29)] + [("t", 900, "f", "a", None), ("t", 901, "f", None, T(3))]
    s = R.replay(refs(spark, r), parents(spark, p), "day")
    want = {n for _, n, _, key, at in r if key and not any(at and x == key and b and b <= at and (e is None or e > at) for x, b, e in p)}
    assert orphans(s) == want and s.references.count() == len(r) - 1


def test_queries_advance_the_state(spark, small, monkeypatch):
    from vinculum.plans import data_quality

    calls, whole = [], R.advance
    monkeypatch.setattr(R, "advance", lambda *a, **k: calls.append(1) or whole(*a, **k))
    assert data_quality.p2_snapshot(spark, small).count() > 0 and len(calls) > 1
