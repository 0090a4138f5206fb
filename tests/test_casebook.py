import datetime as dt

from vinculum.operators import casebook as C
from vinculum.operators import resolution as R

T = lambda d: dt.datetime(2024, 1, d)


def test_access_lists_and_search(spark):
    cases = spark.createDataFrame(
        [("1", "Alpha", "N1", "OPEN", '{"category":"FRAUD","priority":"HIGH","narrative":"bank","location":"Pelgaon"}', T(1)), ("2", "Beta", "N2", "CLOSED", "plain", T(2)), ("3", "Gamma", "N3", "OPEN", "{broken}", T(3)), ("4", "D", "N4", "OPEN", None, T(3))],
        "case_id string, title string, case_number string, status string, description string, created_at timestamp",
    )
    members = spark.createDataFrame([("1", "u"), ("2", "u"), ("3", "v")], "case_id string, user_id string")
    assert [r.case_id for r in C.accessible_cases(cases, members, "u").collect()] == ["2", "1"]
    assert [r.case_id for r in C.accessible_cases(cases, members, "x", admin=True).collect()] == ["4", "3", "2", "1"]
    meta = C.case_meta(cases)
    got = {r.case_id: (r.category, r.priority, r.sub_status, r.narrative) for r in meta.collect()}
    assert got == {"1": ("FRAUD", "HIGH", "ACTIVE", "bank"), "2": ("OTHER", "MEDIUM", "SOLVED", "plain"), "3": ("OTHER", "MEDIUM", "ACTIVE", "{broken}"), "4": ("OTHER", "MEDIUM", "ACTIVE", "")}
    ids = lambda **k: {r.case_id for r in C.search_cases(meta, **k).collect()}
    assert ids(term=" PELGAON ") == {"1"} and ids(status="SOLVED") == {"2"} and ids(status="ACTIVE", category="FRAUD") == {"1"} and ids(top=2) == {"1", "2"}


def test_connections_and_profiles(spark):
    ents = spark.createDataFrame([("a", "PERSON", "Asha Rao"), ("p", "PHONE", "111"), ("l", "LOCATION", "Park")], "node string, etype string, name string")
    edges = spark.createDataFrame([(1, "a", "p", "T"), (2, "l", "a", "T"), (3, "a", None, "T"), (4, "a", "gone", "T")], "edge_id bigint, src string, tgt string, type string")
    linked = C.connections(edges, ents)
    assert {(r.other, r.name, r.direction) for r in linked.filter("node = 'a'").collect()} == {("p", "111", "OUT"), ("l", "Park", "IN"), ("gone", "Unknown", "OUT")}
    assert C.connections(edges, ents, cap=1).filter("node = 'a'").count() == 1
    m = spark.createDataFrame([("a", "ASHA RAO", "x ", "f1"), ("a", "Asha", None, "f2"), ("a", "Asha", " x", None)], "node string, name string, snippet string, filename string")
    r = {x.node: x for x in C.profiles(ents, m, linked).collect()}
    assert (r["a"].aliases, r["a"].evidence_snippets, r["a"].source_documents, r["a"].phone_numbers, r["a"].locations) == (["Asha"], ["x"], ["f1", "f2"], ["111"], ["Park"])
    assert r["p"].aliases == []
    links = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "node string, case_id string")
    members = spark.createDataFrame([("1", "u")], "case_id string, user_id string")
    assert {tuple(x) for x in C.entity_cases(links, members, "u").collect()} == {("a", 1, "ok"), ("b", 0, "forbidden")}


def test_projection_is_idempotent_and_prunes(spark):
    V, E = "node string, case_id string", "edge_id bigint, src string, tgt string, case_id string"
    v, e = spark.createDataFrame([("a", "1"), ("b", "1")], V), spark.createDataFrame([(1, "a", "b", "1"), (2, "a", None, "1")], E)
    old_v, old_e = spark.createDataFrame([("a", "1"), ("x", "1"), ("c", "2"), ("d", "2")], V), spark.createDataFrame([(9, "a", "x", "1"), (5, "c", "d", "2")], E)
    for _ in range(2):
        nv, ne, n = C.project_graph(v, e, old_v, old_e)
        old_v, old_e = nv, ne
        assert {tuple(r) for r in nv.collect()} == {("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")} and {r.edge_id for r in ne.collect()} == {1, 5}
    assert tuple(n.first()) == (1, 1, 0, 0)


def test_bridge_and_references(spark):
    rec = spark.createDataFrame([("1", "TRANSACTION", {"source": "A", "target": "B", "amount": "5", "timestamp": "t"}), ("2", "TRANSACTION", {"sender": "A"}), ("3", "CDR", {"entity": "E", "call_time": "t"})], "record_id string, record_type string, raw map<string,string>")
    tx, cdr = C.bridge_records(rec)
    assert [(r.sender, r.amount, r.currency) for r in tx.collect()] == [("A", 5.0, "INR")] and [(r.caller, r.callee) for r in cdr.collect()] == [("E", "E_unknown")]
    refs = spark.createDataFrame([("c", 1, "n1"), ("c", 1, "m1"), ("c", 2, "m1"), ("c", 1, "zz")], "case_id string, doc int, raw string")
    links = spark.createDataFrame([("n1", "c"), ("n2", "c")], "node string, case_id string")
    ms = spark.createDataFrame([("c", 1, "m1", "n2", T(5), "i2"), ("c", 3, "m1", "n3", T(1), "i1"), ("c", 1, "m1", None, T(1), "i0")], "case_id string, doc int, mention_id string, node string, created_at timestamp, id string")
    assert sorted((r.doc, r.raw, r.resolved) for r in C.resolve_entity_refs(refs, links, ms).collect()) == [(1, "m1", "n2"), (1, "n1", "n1"), (1, "zz", "zz"), (2, "m1", "n3")]
    t = lambda *i: spark.createDataFrame([("c", x) for x in i], "case_id string, id string")
    rels = spark.createDataFrame([("c", "r1", "rel_001")], "case_id string, id string, occurrence string")
    q = spark.createDataFrame([("c", x) for x in ("d1", "s1", "r1", "rel_001", "?")], "case_id string, raw string")
    assert {(r.raw, r.resolved, r.kind) for r in C.resolve_evidence_refs(q, t("d1"), t("s1"), rels).collect()} == {("d1", "d1", "document"), ("s1", "s1", "record"), ("r1", "r1", "relationship"), ("rel_001", "r1", "occurrence"), ("?", "?", "raw")}


def test_insights(spark):
    S = "case_id string, kind string, source_id string, payload string, created_at timestamp"
    old = spark.createDataFrame([("c", "PATTERN", "1", '{"type":"A"}', T(1)), ("c", "LEAD", "1", "{}", T(1))], S)
    new = spark.createDataFrame([("c", "PATTERN", "1", '{"type":"B"}', T(2)), ("c", "PATTERN", "2", "oops", T(1))], S)
    both = C.store_insights(old, new)
    assert both.count() == 3 and C.store_insights(both, new).count() == 3
    assert [(r.source_id, r.type) for r in C.list_insights(both, "c", "PATTERN", "type string").collect()] == [("2", None), ("1", "B")]


def test_equivalent_entities(spark):
    rows = [("1", "PERSON", "Dr. Punjal Meher"), ("2", "PERSON", "punjal meher"), ("3", "PERSON", "Punjal"), ("4", "PERSON", "Sona Sekhar Sahu"), ("5", "PERSON", "Sanjib Sahu"), ("6", "PERSON", "Sanju @ Sanjib Sahu"), ("7", "PERSON", "Sona"), ("8", "PERSON", "Sona Das"),
            ("9", "ORGANIZATION", "Central Bureau of Work"), ("a", "ORGANIZATION", "CBOW"), ("b", "ORGANIZATION", "Central Bureau"), ("c", "VEHICLE", "mh 1 a 2"), ("d", "VEHICLE", "MH1A2"), ("e", "LOCATION", "City Park."), ("f", "LOCATION", "city park")]
    df = spark.createDataFrame([("g", *r) for r in rows], "grp string, node string, etype string, name string")
    got = {(r.a, r.b): r.best_name for r in R.equivalent(df).collect()}
    assert got == {("1", "2"): "Punjal Meher", ("1", "3"): "Dr. Punjal Meher", ("2", "3"): "punjal meher", ("5", "6"): "Sanju @ Sanjib Sahu", ("9", "a"): "Central Bureau of Work", ("c", "d"): "MH1A2", ("e", "f"): "City Park."}


def test_canonical_order(spark):
    new = spark.createDataFrame([("g", "n1", "PERSON", "asha rao", None), ("g", "n2", "PHONE", "+91 1", None), ("g", "n3", "PHONE", "77", None), ("g", "n4", "PERSON", "x y", "kept")], "grp string, node string, etype string, name string, existing string")
    known = spark.createDataFrame([("g", "k1", "PERSON", "Asha Rao", T(1)), ("h", "k3", "PHONE", "+911", T(3)), ("h", "k2", "PHONE", "+91 1", T(2)), ("h", "k9", "PERSON", "x y", T(1))], "grp string, node string, etype string, name string, created_at timestamp")
    got = {r.node: r.entity for r in R.resolve_canonical(new, known).collect()}
    assert got["n1"] == "k1" and got["n2"] == "k2" and got["n4"] == "kept" and len(got["n3"]) == 32
