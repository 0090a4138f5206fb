import datetime as dt
import itertools
import random

from vinculum.operators import patterns as P

T0 = dt.datetime(2024, 1, 1)
H = lambda h: T0 + dt.timedelta(hours=h)


def transfers(spark, rows):
    return spark.createDataFrame(rows, "record_id string, sender string, recipient string, ts timestamp_ntz")


def chains(spark, rows):
    return {(r.a, r.b, r.c, r.first_id, r.second_id) for r in P.rapid_chains(transfers(spark, rows)).collect()}


def test_chain_bounds_and_rules(spark):
    us = dt.timedelta(microseconds=1)
    assert chains(spark, [("1", "A", "B", H(0)), ("2", "B", "C", H(48))]) == {("A", "B", "C", "1", "2")}
    assert chains(spark, [("1", "A", "B", H(0)), ("2", "B", "C", H(48) + us)]) == set()
    assert chains(spark, [("1", "A", "B", H(5)), ("2", "B", "C", H(4))]) == set()
    assert chains(spark, [("1", "A", "B", H(0)), ("2", "B", "A", H(1))]) == set()
    assert chains(spark, [("1", "A", "B", H(0)), ("1", "B", "C", H(1))]) == set()
    assert chains(spark, [("1", "A", "B", H(0)), ("2", "C", "B", H(1))]) == set()
    assert chains(spark, [(None, "A", "B", H(0)), ("2", None, "C", H(1)), ("3", "B", "C", None)]) == set() == chains(spark, [])


def cycle_rows(days):
    return [("1", "B", "C", T0), ("2", "C", "A", T0 + dt.timedelta(days=days)), ("3", "A", "B", T0 + dt.timedelta(days=1))]


def test_cycle_bounds(spark):
    got = P.cycles(transfers(spark, cycle_rows(30) + cycle_rows(30))).collect()
    assert [(r.a, r.b, r.c, r.evidence_ids) for r in got] == [("A", "B", "C", ["1", "2", "3"])]
    late = cycle_rows(30)
    late[1] = (*late[1][:3], late[1][3] + dt.timedelta(microseconds=1))
    assert P.cycles(transfers(spark, late)).count() == 0


def test_random_transfers_against_brute_force_in_any_order(spark):
    rng = random.Random(3)
    rows = [(str(k), *rng.sample("ABCDE", 2), T0 + dt.timedelta(hours=rng.randint(0, 24 * 60))) for k in range(60)]
    want = {(x[1], x[2], y[2], x[0], y[0]) for x, y in itertools.permutations(rows, 2) if x[2] == y[1] and x[1] != y[2] and dt.timedelta() <= y[3] - x[3] <= dt.timedelta(hours=48)}
    rings = {
        (x[1], x[2], y[2], tuple(sorted((x[0], y[0], z[0]))))
        for x, y, z in itertools.permutations(rows, 3)
        if x[2] == y[1] and y[2] == z[1] and z[2] == x[1] and len({x[1], y[1], z[1]}) == 3 and x[1] == min(x[1], y[1], z[1])
        and max(x[3], y[3], z[3]) - min(x[3], y[3], z[3]) <= dt.timedelta(days=30)
    }
    for _ in range(2):
        rng.shuffle(rows)
        assert chains(spark, rows) == want
        assert {(r.a, r.b, r.c, tuple(r.evidence_ids)) for r in P.cycles(transfers(spark, rows)).collect()} == rings


def test_meetings(spark):
    rows = [("a", "City  Park.", "1", H(0)), ("b", "city park", "2", H(2)), ("A", "City Park", "3", H(1)), ("c", "Market", "4", H(0)), ("d", None, "5", H(0)), ("e", "city park", "6", H(4.1)), ("f", "!!", "7", H(0)), ("g", "??", "8", H(0))]
    df = spark.createDataFrame(rows, "entity string, location string, record_id string, ts timestamp_ntz")
    assert {(r.entity_a, r.entity_b, r.id_a, r.id_b) for r in P.meetings(df).collect()} == {("a", "b", "1", "2"), ("A", "b", "2", "3")}
    assert P.meetings(df.limit(0)).count() == 0


def test_leads_and_ids(spark):
    t = transfers(spark, cycle_rows(2))
    p = P.as_patterns(P.cycles(t), P.rapid_chains(t), P.meetings(spark.createDataFrame([], "entity string, location string, record_id string, ts timestamp_ntz")))
    rows = P.leads(p.union(p)).orderBy("priority_rank", "lead_type").collect()
    assert [(r.lead_type, r.priority, r.priority_score, r.status) for r in rows] == [("CIRCULAR_TRANSACTION_LEAD", "HIGH", 0.90, "REVIEW_REQUIRED"), ("RAPID_TRANSFER_LEAD", "HIGH", 0.85, "REVIEW_REQUIRED")]
    assert P.first_chain_per_triple(t).count() == 1


def test_transfers_without_record_id_count(spark):
    assert chains(spark, [(None, "A b", "B", H(0)), (" ", "B", "C", H(1))]) == {("A b", "B", "C", "tx_A_b_B_20240101T000000", "tx_B_C_20240101T010000")}
    rows = [(None, "a", "p", H(0)), (None, "b", "p", H(1))]
    df = spark.createDataFrame([(r, e, loc, t) for r, e, loc, t in rows], "record_id string, entity string, location string, ts timestamp_ntz")
    assert {(r.id_a, r.id_b) for r in P.meetings(df).collect()} == {("ev_a_p_20240101T000000", "ev_b_p_20240101T010000")}


def test_groups_keep_patterns_apart(spark):
    rows = [("1", "A", "B", H(0), "x"), ("2", "B", "C", H(1), "y"), ("3", "B", "D", H(2), "x")]
    df = spark.createDataFrame(rows, "record_id string, sender string, recipient string, ts timestamp_ntz, case_id string")
    assert [(r.case_id, r.c) for r in P.rapid_chains(df, group="case_id").collect()] == [("x", "D")]


def test_older_cycles_follow_in_time_and_count_whole_days(spark):
    late = [("1", "A", "B", T0), ("2", "B", "C", T0 + dt.timedelta(days=5)), ("3", "C", "A", T0 + dt.timedelta(days=30, hours=23, minutes=59, seconds=59)), ("4", "C", "A", T0 + dt.timedelta(days=31))]
    got = P.first_cycle_per_set(transfers(spark, late)).collect()
    assert [(r.entities, r.evidence_ids) for r in got] == [(["A", "B", "C"], ["1", "2", "3"])]
    assert P.first_cycle_per_set(transfers(spark, [late[2], (*late[0][:3], H(24 * 32)), (*late[1][:3], H(24 * 33))])).count() == 1
    assert P.first_cycle_per_set(transfers(spark, [late[0], (*late[1][:3], H(24 * 12)), (*late[2][:3], H(24 * 10))])).count() == 0


def test_meeting_counts_equal_the_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abcdeF"), rng.choice(["p", "P", "q"]), k, T0 + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 6))) for k in range(150)]
    df = spark.createDataFrame(rows, "entity string, location string, record_id int, ts timestamp_ntz")
    pairs = [(x, y) for x, y in itertools.permutations(rows, 2) if x[1].lower() == y[1].lower() and x[0].lower() != y[0].lower() and abs(x[3] - y[3]) <= dt.timedelta(hours=2)]
    points = {(x[1].lower(), x[0].lower(), x[3]) for x, _ in pairs}
    want = {p: (sum(q[0] == p for q in points), len({q[1] for q in points if q[0] == p})) for p in {q[0] for q in points}}
    assert {r.place: (r.meetings, r.entities) for r in P.meeting_counts(df).collect()} == want
    assert P.meeting_counts(df.limit(0)).count() == 0


def test_explanations_and_titles(spark):
    t = transfers(spark, cycle_rows(2))
    points = spark.createDataFrame([("b", "City Park", "2", H(0.5)), ("a", "city park", "1", H(0))], "entity string, location string, record_id string, ts timestamp_ntz")
    rows = {r.type: r for r in P.lead_texts(P.as_patterns(P.cycles(t), P.rapid_chains(t), P.meetings(points), explain=True)).collect()}
    assert rows["CIRCULAR_TRANSACTION"].explanation == "Circular fund transfer detected: A → B → C → A completed in 2.0 days (max allowed: 30 days)."
    assert rows["RAPID_TRANSFER_CHAIN"].explanation == "Rapid fund transfer chain detected: B → C → A completed in 48.0 hours (max allowed: 48 hours)." or "completed in" in rows["RAPID_TRANSFER_CHAIN"].explanation
    assert rows["LOCATION_TIME_OVERLAP"].explanation == "Location-time overlap detected at city park between a and b within 30 minutes (max allowed: 2 hours)."
    assert rows["LOCATION_TIME_OVERLAP"].title == "Review spatio-temporal co-presence of a and b" and rows["CIRCULAR_TRANSACTION"].title == "Investigate circular transaction cycle (A → B → C)"


def test_running_ids(spark):
    df = spark.createDataFrame([(k % 2, k) for k in range(2100)], "g int, k int")
    got = {(r.g, r.k): r.staging_id for r in P.numbered(df, "lead", ["k"], ["g"]).collect()}
    assert got[0, 0] == "lead_001" and got[0, 1998] == "lead_1000"
