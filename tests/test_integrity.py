import datetime as dt
import hashlib

from pyspark.sql import functions as F

from vinculum.operators import integrity as I


def test_ledger_chain_and_tampering(spark):
    items = spark.createDataFrame([(k, f"e{k}", hashlib.sha256(str(k).encode()).hexdigest()) for k in range(50)] + [(60, "e1", "x"), (70, "n", None)], "k int, e string, h string")
    led = I.build_ledger(items, "k", "e", "h").collect()
    assert len(led) == 50 and led[0].previous_hash == "0" and all(b.previous_hash == a.block_hash for a, b in zip(led, led[1:]))
    df = spark.createDataFrame(led)
    assert I.verify_ledger(df).filter("not own_ok or not link_ok").count() == 0
    bad = df.withColumn("data_hash", F.when(F.col("block_index") == 7, "00").otherwise(F.col("data_hash")))
    assert {(r.block_index) for r in I.verify_ledger(bad).filter("not own_ok").collect()} == {7}
    assert I.latest_block(df).first().block_index == 49 and I.latest_block(df.limit(0)).count() == 0
    one = df.filter("block_index = 1").first()
    assert I.block_payload(1, one.evidence_id, one.data_hash, one.previous_hash, "", "", "") == f'{{"actor":"","block_index":1,"case_id":"","data_hash":"{one.data_hash}","evidence_id":"{one.evidence_id}","previous_hash":"{led[0].block_hash}","timestamp":""}}'
    cut = df.filter("block_index <> 20")
    assert {r.block_index for r in I.verify_ledger(cut).filter("not link_ok").collect()} == {21}
    now = items.select("e", "h").filter("e in ('e1', 'e2') and h <> 'x'").union(spark.createDataFrame([("e3", "changed"), ("zz", "x")], "e string, h string"))
    got = {r.e: (r.anchored, r.verified) for r in I.verify_documents(df, now, "e", "h").collect()}
    assert got == {"e1": (True, True), "e2": (True, True), "e3": (True, False), "zz": (False, False)}


def test_blocks_cover_actor_case_and_time(spark):
    rows = [(1, "e", "AB", "c1", "Zoë", dt.datetime(2025, 1, 2, 3, 4, 5, 6))]
    led = I.build_ledger(spark.createDataFrame(rows, "k int, e string, h string, c string, a string, t timestamp"), "k", "e", "h", "c", "a", "t")
    payload = '{"actor":"Zo\\u00eb","block_index":0,"case_id":"c1","data_hash":"ab","evidence_id":"e","previous_hash":"0","timestamp":"2025-01-02T03:04:05.000006Z"}'
    assert led.first().block_hash == hashlib.sha256(payload.encode()).hexdigest()
    for column in ("case_id", "actor", "made_at"):
        assert I.verify_ledger(led.withColumn(column, F.lit("other"))).filter("own_ok").count() == 0


def test_fingerprints(spark):
    def prints(ents, rels, docs):
        e = spark.createDataFrame(ents, "case_id string, id string, name string, etype string")
        r = spark.createDataFrame(rels, "case_id string, id int, src string, tgt string, status string")
        d = spark.createDataFrame(docs, "case_id string, id int, filename string")
        return {x.case_id: x.fingerprint for x in I.network_fingerprint(e, r, d).collect()}

    ents, rels, docs = [("A", "2", "n2", "PERSON"), ("A", "1", "n1", "PHONE"), ("B", "1", None, "PERSON")], [("A", 10, "1", None, "CONFIRMED"), ("A", 9, "1", "2", "INFERRED")], [("C", 7, "f"), ("A", 5, None)]
    sign = "mode=full#ENT(2):1:n1:PHONE;2:n2:PERSON#REL(2):10:1:None:CONFIRMED;9:1:2:INFERRED#DOC(1):5:None"
    one = prints(ents, rels, docs)
    assert one["A"] == hashlib.sha256(sign.encode()).hexdigest()[:24]
    assert one["B"] == hashlib.sha256(b"mode=full#ENT(1):1:None:PERSON#REL(0):#DOC(0):").hexdigest()[:24]
    assert one["C"] == hashlib.sha256(b"mode=full#ENT(0):#REL(0):#DOC(1):7:f").hexdigest()[:24]
    assert prints(ents[::-1], rels[::-1], docs)["A"] == one["A"] != prints(ents, rels, [("A", 5, "x")])["A"]
    assert prints([], [], []) == {}
    saved = spark.createDataFrame([("A", one["A"]), ("B", "old")], "case_id string, fingerprint string")
    now = spark.createDataFrame(list(one.items()), "case_id string, fingerprint string")
    assert {(r.case_id, r.status) for r in I.changed(now, saved).collect()} == {("A", "hit"), ("B", "changed"), ("C", "miss")}


def test_writes_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, t int")
    new = spark.createDataFrame([("b", 2, 1), ("c", 2, 1), ("c", 2, 1), ("a", 0, 0)], "k string, v int, t int")
    assert {tuple(r) for r in I.insert_new(old, new, "k").collect()} == {("a", 1, 1), ("b", 1, 1), ("c", 2, 1)}
    assert I.insert_new(I.insert_new(old, new, "k"), new, "k").count() == 3
    assert {tuple(r) for r in I.upsert(old, new, ["k"], "t").collect()} == {("a", 1, 1), ("b", 2, 1), ("c", 2, 1)}
