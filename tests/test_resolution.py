from vinculum.operators import resolution as R


def attributed(spark, rows, edges=()):
    m = spark.createDataFrame([("g", *r) for r in rows], "grp string, node string, etype string, name string")
    e = spark.createDataFrame(list(edges), "src string, tgt string")
    return R.attributes(m, e)


def pairs(spark, rows, edges=(), **kw):
    return {(r.a, r.b): (r.confidence, r.signals) for r in R.compare(attributed(spark, rows, edges), **kw).collect()}


def test_identifiers_and_types(spark):
    rows = [("1", "PHONE", "+91 98765-43210"), ("2", "PHONE", "09876543210"), ("3", "PERSON", "9876543210"), ("4", "VEHICLE", "mh 12-ab 1"), ("5", "VEHICLE", "MH12AB1"), ("6", "BANK_ACCOUNT", "12-3"), ("7", "BANK_ACCOUNT", "123"), ("8", "EVENT", "Raid "), ("9", "EVENT", "raid")]
    got = pairs(spark, rows)
    assert got == {("1", "2"): (0.95, ["PHONE_MATCH"]), ("4", "5"): (0.95, ["VEHICLE_MATCH"]), ("6", "7"): (0.95, ["ACCOUNT_MATCH"]), ("8", "9"): (0.80, ["NAME_SIMILARITY"])}


def test_persons(spark):
    rows = [("1", "PERSON", "Mr. Rahul Kumar"), ("2", "PERSON", "rahul kumar"), ("3", "PERSON", "Rahul K."), ("4", "PERSON", "Amit Kumar"), ("5", "PERSON", "Sanju @ Sanjib Sahu"), ("6", "PERSON", "Sanjib Sahu")]
    got = {k: v[0] for k, v in pairs(spark, rows).items()}
    assert got == {("1", "2"): 0.80, ("1", "3"): 0.60, ("2", "3"): 0.60, ("5", "6"): 0.88}
    assert {k: v[0] for k, v in pairs(spark, rows, fuzzy=False).items()} == {("1", "2"): 0.80, ("5", "6"): 0.88}


def test_signals_and_conflicts(spark):
    rows = [("1", "PERSON", "Asha Rao"), ("2", "PERSON", "Asha Rao"), ("3", "PERSON", "Asha Rao"), ("p", "PHONE", "9876543210"), ("q", "PHONE", "9999999999"), ("l", "LOCATION", "City Park")]
    got = pairs(spark, rows, [("1", "p"), ("p", "2"), ("3", "q"), ("1", "l"), ("2", "l")])
    assert got == {("1", "2"): (0.98, ["NAME_SIMILARITY", "PHONE_MATCH", "LOCATION_MATCH"])}


def test_organisations(spark):
    rows = [("1", "ORGANIZATION", "Delta Foods Pvt Ltd"), ("2", "ORGANIZATION", "delta foods"), ("3", "ORGANIZATION", "Delta Foods Exports"), ("4", "ORGANIZATION", "DF"), ("5", "ORGANIZATION", "Kota P.S."), ("6", "ORGANIZATION", "Kota Police Station")]
    got = {k: v[0] for k, v in pairs(spark, rows).items()}
    assert got[("1", "2")] == 0.90 and got[("1", "3")] == 0.88 and got[("1", "4")] == 0.88 and got[("5", "6")] == 0.90 and ("4", "5") not in got


def test_proposals_memory_and_consolidation(spark):
    m = attributed(spark, [("1", "PERSON", "Asha Rao"), ("2", "PERSON", "asha rao"), ("3", "PERSON", "Asha R."), ("x", "PHONE", "111")])
    props = R.propose(R.compare(m))
    assert {(r.node, r.root, r.confidence) for r in props.collect()} == {("1", "1", 0.80), ("2", "1", 0.80)}
    links = R.memory_links(m.filter("node = '2'"), m.filter("node = '1'")).collect()
    assert [(r.a, r.b, r.needs_review) for r in links] == [("2", "1", True)]
    nodes = spark.createDataFrame([("1",), ("2",), ("3",)], "node string")
    edges = spark.createDataFrame([(1, "1", "3", "T", 0.5), (2, "2", "3", "T", 0.9), (3, "1", "2", "T", 0.9), (4, "2", None, "T", 0.1), (5, None, None, "T", 0.1), (6, None, None, "T", 0.1)], "edge_id int, src string, tgt string, type string, confidence double")
    left, kept = R.consolidate(nodes, edges, props)
    assert {r.node for r in left.collect()} == {"1", "3"}
    assert {(r.edge_id, r.src, r.tgt) for r in kept.collect()} == {(2, "1", "3"), (4, "1", None), (5, None, None), (6, None, None)}


def test_empty(spark):
    assert pairs(spark, []) == {}
    assert pairs(spark, [("1", "PHONE", None), ("2", "PHONE", None), ("3", "PERSON", None)]) == {}
