import pytest
from pyspark.errors import PySparkException

from vinculum.operators import evidence as E
from vinculum.operators import validation as V

REL = "rel_id bigint, src string, tgt string, type string, confidence double, status string, doc bigint, record string, snippet string"


def test_firewall_gives_the_first_reason(spark):
    ents = spark.createDataFrame([("p", "PERSON"), ("q", "PERSON"), ("v", "VEHICLE")], "node string, etype string")
    rows = [
        (1, "p", "q", "CALLED", 0.9, "CONFIRMED", 1, None, "called him"), (2, "p", "x", "CALLED", 0.9, "CONFIRMED", 1, None, "a"), (3, "p", "p", "CALLED", 0.9, "CONFIRMED", 1, None, "a"),
        (4, "p", "q", "CALLED", 0.1, "CONFIRMED", 1, None, "a"), (5, "p", "v", "CALLED", 0.9, "CONFIRMED", 1, None, "a"), (6, "p", "q", "CALLED", 0.9, "CONFIRMED", 1, "r9", "a"),
        (7, "p", "q", "CALLED", 0.9, "CONFIRMED", 1, None, "entirely other words"), (8, "p", "q", "CALLED", 0.9, "CONFIRMED", 1, "r1", None), (9, None, "q", "CALLED", 0.9, "CONFIRMED", None, None, None),
    ]
    texts = spark.createDataFrame([(1, "He called  him twice.")], "doc bigint, text string")
    records = spark.createDataFrame([("r1",)], "record string")
    got = {r.rel_id: r.reason for r in E.firewall_reasons(spark.createDataFrame(rows, REL), ents, texts, records, 0.5).collect()}
    assert got == {1: None, 2: "unknown_endpoint", 3: "self_loop", 4: "below_confidence_threshold", 5: "invalid_endpoint_types", 6: "unknown_record_provenance", 7: "ungrounded_evidence", 8: None, 9: "unknown_endpoint"}
    strength = {r.rel_id: r.strength for r in E.assess(spark.createDataFrame(rows, REL), texts, records).collect()}
    assert (strength[1], strength[6], strength[7], strength[8]) == ("EXPLICIT", "UNGROUNDED", "UNGROUNDED", "STRUCTURED")


def test_groups_edges_and_changes(spark):
    rows = [
        (1, "a", "b", "T", 0.5, "INFERRED", 1, None, "x"), (2, "a", "b", "T", 0.4, "CONFIRMED", 1, None, " x "), (3, "a", "b", "T", 0.6, "INFERRED", None, "r", None),
        (4, "a", "c", "T", 0.98, "PREDICTED", 1, None, "x"), (5, "a", "c", "T", 0.97, "PREDICTED", 2, None, "x"),
    ]
    df = spark.createDataFrame(rows, REL)
    g = {(r.src, r.tgt): r for r in E.evidence_groups(df).collect()}
    assert (g["a", "b"].rel_ids, g["a", "b"].n_sources, g["a", "b"].calibrated, g["a", "b"].strongest_status) == ([1, 2, 3], 2, 0.63, "CONFIRMED")
    assert g["a", "c"].calibrated == 0.99
    best = {(r.tgt): (r.rel_id, r.duplicates) for r in E.accepted_edges(df).collect()}
    assert best == {"b": (2, 2)} and E.accepted_edges(df, include_predicted=True).count() == 2
    assert {(r.tgt, r.contradictions) for r in E.status_changes(df).collect()} == {("b", 2), ("c", 0)}


def test_signals_levels(spark):
    p = spark.createDataFrame([("A", "RAPID_TRANSFER_CHAIN", "HIGH"), ("B", "LOCATION_TIME_OVERLAP", "MEDIUM")], "case_id string, type string, severity string")
    r = spark.createDataFrame([("A", "CONFIRMED")] * 6 + [("B", "INFERRED")] * 2 + [("C", "PREDICTED")], "case_id string, status string")
    got = {x.case_id: (x.score, x.level, x.reason_codes) for x in E.case_signals(p, r).collect()}
    assert got == {"A": (0.85, "CRITICAL", ["MULTI_RELATIONSHIP_SUPPORT", "RAPID_TRANSFER_CHAIN"]), "B": (0.45, "MEDIUM", ["INFERRED_NETWORK_SIGNAL", "LOCATION_TIME_OVERLAP"]), "C": (0.0, "LOW", [])}


def test_f1(spark):
    t = lambda *r: spark.createDataFrame([(x,) for x in r], "x string")
    r = E.f1_scores(t("a", "b", "b"), t("b", "c")).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    r = E.f1_scores(t(), t()).first()
    assert (r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0)


def test_candidates_and_ends(spark):
    ents = spark.createDataFrame([(1, "PERSON", "Rona Bel", 0.9)], "doc int, etype string, name string, confidence double")
    new = spark.createDataFrame([(1, "PERSON", "rona bel", 0.2), (1, "VEHICLE", "QX 1", 7.0), (1, "GHOST", "x", 0.5), (1, "PHONE", " ", 0.5)], ents.schema)
    edges = spark.createDataFrame([(1, "Rona Bel", "QX 1", "OWNS_VEHICLE", 2.0, "owns QX 1"), (1, "Rona Bel", "nobody", "CALLED", 0.5, "owns"), (1, "Rona Bel", "QX 1", "FLEW", 0.5, "owns QX 1"), (1, "Rona Bel", "rona bel", "CALLED", 0.5, "owns QX 1")], "doc int, source string, target string, type string, confidence double, snippet string")
    texts = spark.createDataFrame([(1, "Rona Bel owns QX 1.")], "doc int, text string")
    everyone, stand = E.integrate_candidates(ents, new, edges, texts)
    assert {(r.etype, r.name, r.confidence) for r in everyone.collect()} == {("PERSON", "Rona Bel", 0.9), ("VEHICLE", "QX 1", 1.0)}
    assert [(r.target, r.status, r.confidence) for r in stand.collect()] == [("QX 1", "PREDICTED", 1.0)]
    m = spark.createDataFrame([(1, "mention_001", "Rona Bel"), (1, "mention_002", "rona bel"), (1, "mention_003", "QX 1")], "doc int, mention_id string, name string")
    assert {(r.source_id, r.target_id) for r in E.remap_ends(edges, m).collect()} == {("mention_002", "mention_003")}


def test_ocr_confidence(spark):
    m = spark.createDataFrame([(1, "a", "Bel", 0.8), (1, "b", "Zed", 0.8)], "doc int, mention_id string, name string, confidence double")
    b = spark.createDataFrame([(1, "x bel y", 0.5), (1, "BEL", 0.2)], "doc int, text string, confidence double")
    assert {r.mention_id: round(r.weighed, 6) for r in E.ocr_confidence(m, b).collect()} == {"a": 0.6, "b": 0.8}


def test_records_are_checked(spark):
    rows = [("A", "B", 5.0, "inr", "2024-01-01T10:00:00"), ("A", "a-b".replace("a-b", "A "), 5.0, "INR", "2024-01-01"), ("A", None, 1.0, "INR", "x"), ("A", "B", None, "INR", "2024-01-01"), ("A", "B", -1.0, "INR", "2024-01-01"),
            ("A", "B", 1.0, "RUPEE", "2024-01-01"), ("A", "B", 1.0, "INR", None), ("A", "B", 1.0, "INR", "2024-13-01"), ("A", "B", float("nan"), "INR", "2024-01-01T00:00:00+05:30")]
    df = spark.createDataFrame(rows, "sender string, recipient string, amount double, currency string, transaction_time string")
    checked = V.check_transfers(df)
    assert [r.reject for r in checked.collect()] == [None, "same_party", "missing_recipient", "missing_amount", "non_positive_amount", "invalid_currency", "missing_time", "invalid_time", None]
    assert V.lenient(checked).count() == 2
    with pytest.raises(PySparkException):
        V.strict(checked).collect()
    calls = spark.createDataFrame([("+91 98765 43210", "09876543210", "2024-01-01", 1.0), ("1", "2", "2024-01-01", -1.0), ("1", "2", "2024-01-01", None), (None, "2", "", 1.0)], "caller string, callee string, call_time string, duration double")
    assert [r.reject for r in V.check_calls(calls).collect()] == ["same_party", "invalid_duration", None, "missing_caller"]


def test_bounds_and_junk(spark):
    for bad in (True, 0, 6, "3", None):
        with pytest.raises(ValueError):
            V.bounded(bad, 1, 5, "hops")
    assert V.bounded(3, 1, 5, "hops") == 3
    df = spark.createDataFrame([("He",), ("x",), (None,), ("vs. State",), ("Rona",)], "n string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(V.is_junk(F.col("n"))).collect()] == [True, True, True, True, False]


def test_chunks_become_one_set_and_ends_cap_confidence(spark):
    ents = spark.createDataFrame([(1, 0, "PERSON", "Asha Rao", 0.7), (1, 1, "person", " asha rao ", 0.9), (1, 1, "PERSON", " ", 0.9), (1, 1, "GHOST", "x", 0.9), (1, 2, "PHONE", "1", None)], "doc int, chunk int, etype string, name string, confidence double")
    rels = spark.createDataFrame([(1, 0, "A", "B", "CALLED", 0.6, "s"), (1, 1, "a", "b ", "called", 0.6, "t"), (1, 1, "A", "a", "CALLED", 0.9, "u"), (1, 1, "A", "C", "CALLED", None, " ")], "doc int, chunk int, source string, target string, type string, confidence double, snippet string")
    e, r = E.merge_chunks(ents, rels)
    assert {(x.etype, x.name, x.confidence) for x in e.collect()} == {("PERSON", "asha rao", 0.9), ("PHONE", "1", 0.9)}
    assert {(x.source, x.target, x.confidence, x.snippet) for x in r.collect()} == {("A", "B", 0.6, "s"), ("A", "C", 0.85, "Extracted connection between A and C.")}
    m = spark.createDataFrame([(1, "m1", 0.7), (1, "m2", 0.81234)], "doc int, mention_id string, confidence double")
    edges = spark.createDataFrame([(1, "m1", "m2", 0.95), (1, "m2", "m2", 0.95), (1, "m1", "zz", 0.95)], "doc int, src string, tgt string, confidence double")
    assert {(x.src, x.tgt, x.capped) for x in E.cap_by_ends(edges, m).collect()} == {("m1", "m2", 0.7), ("m2", "m2", 0.8123), ("m1", "zz", 0.95)}
    told = E.candidate_telemetry(edges, edges.limit(1), ["src", "tgt"]).first()
    assert (told.seen, told.accepted, told.rejected) == (3, 1, 2)
