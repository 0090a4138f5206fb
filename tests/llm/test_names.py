import random

import pytest
from pyspark.sql import functions as F

from vinculum.llm import names

ENTITY = ["Weniya Ketrivel", "KETRIVEL Weniya", "Ketrivel, Weniya", "weniya ketrivel", "Weniya Ketrīvēl", "Weniya Ketruvel", "Shri Weniya Ketrivel", "Weniya  Ketrivel ", "WeniyaKetrivel", "W. Ketrivel", "Weniya Lavelo Ketrivel", "Weniya Ketrivel alias Kaltu", "Kaltu"]
FIRM = ["Keslomont Jewellers Cooperative Society", "Keslomonnt Jwlrs. Cooperative Soc", "KESLOMONT JEWELLERS", "M/s Keslomont Jewellers", "the keslomont jewellers co-op. soc.", "KJCS-KES", "Jewellers Keslomont Cooperative Society"]
OTHERS = ["Noresh Sudari Ketrivel", "Weniya Bharshilia", "Keslomont Exports Ltd", "SYNTH 645 0925"]


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.case_id, r.entity), set()).add(r.name)
    return sorted(map(sorted, out.values()))


def run(spark, rows, owners=()):
    n = spark.createDataFrame([(c, x, "ignored") for c, x in rows], "case_id string, name string, owner string")
    o = spark.createDataFrame(list(owners), "case_id string, name string, owner string")
    return names.link_names(n, o)


def test_spellings_of_one_entity_are_linked_and_others_are_not(spark):
    rows = [("A", x) for x in ENTITY + FIRM + OTHERS]
    got = groups(run(spark, rows))
    assert sorted(ENTITY) in got
    assert sorted(FIRM) in got
    assert ["Noresh Sudari Ketrivel"] in got and ["Weniya Bharshilia"] in got and ["Keslomont Exports Ltd"] in got
    assert not any("SYNTH 645 0925" in g for g in got)


def test_groups_are_apart_and_owners_link(spark):
    rows = [("A", "Weniya Ketrivel"), ("B", "weniya ketrivel"), ("A", "Thesy")]
    got = groups(run(spark, rows, [("A", "Thesy", "1"), ("A", "Noresh Sudari", "1"), ("A", "Noresh Sudari", "2")]))
    assert got == sorted([["Noresh Sudari", "Thesy"], ["Weniya Ketrivel"], ["weniya ketrivel"]])


def test_ambiguous_initials_stay_alone(spark):
    got = groups(run(spark, [("A", x) for x in ("W. Ketrivel", "Weniya Ketrivel", "Wolam Ketrivel")]))
    assert ["W. Ketrivel"] in got


def test_nulls_copies_and_empty_tables(spark):
    rows = [("A", None), ("A", ""), ("A", "   "), (None, "Weniya Ketrivel"), ("A", "Weniya Ketrivel"), ("A", "Weniya Ketrivel"), ("A", "ab " * 500)]
    got = run(spark, rows).collect()
    assert sorted(r.name for r in got) == sorted(["Weniya Ketrivel", "ab " * 500])
    assert run(spark, []).count() == 0


def test_bands_follow_the_collision_curve():
    bands, rows = names.tune_bands(0.5, 0.95)
    assert names.collision(0.5, bands, rows) >= 0.95 and bands * rows <= 96
    with pytest.raises(ValueError):
        names.tune_bands(0.01, 0.999, most=8)


def test_similar_words_find_what_brute_force_finds(spark):
    vocabulary = sorted({w for a in ("kesla", "bromi", "tavuro", "nildar", "shogen") for w in (a + "mont", a[:-1] + "xmont", a[1] + a[0] + a[2:] + "mont", a + "wala", a + "vala")})
    df = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    got = {(r.a, r.b) for r in names.similar_words(df).collect()}
    want = {(a, b) for a in vocabulary for b in vocabulary if a != b and names.distance(a, b) <= (2 if min(len(a), len(b)) >= 7 else 1)}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_all_pairs_of_a_class_come_out(spark, small):
    from vinculum.llm.plans import p1_found

    df = p1_found(spark, small)
    assert df.columns == ["case_id", "name_a", "name_b"]
    assert df.filter(F.col("name_a") >= F.col("name_b")).count() == 0 and df.count() == df.distinct().count() > 0


def test_similar_words_miss_no_pair_within_the_limit(spark):
    pairs = "urvu uvru raju rauj ketot ketto norot nroot ketik kteik sorab soarb tavuroq atvuorq wili vily".split()
    long = ["bromikeslatavuronildar", "bromiekslatavuronilrdar", "rbomikeslatavuronilda", "nildarshogenketotwa", "nildarshogenketot", "indlarshogenketotwa"]
    r = random.Random(3)
    made = ["".join(r.choices("abce", k=r.randint(3, 9))) for _ in range(150)]
    vocabulary = sorted({*pairs, *long, *made})
    got = {(r.a, r.b) for r in names.similar_words(spark.createDataFrame([(w,) for w in vocabulary], "word string")).collect()}
    want = {(a, b) for a in vocabulary for b in vocabulary if a != b and names.distance(a, b, 2) <= (2 if min(len(a), len(b)) >= 7 else 1)}
    assert got == want and len(want) > 100


def test_every_member_of_a_group_comes_into_a_star(spark):
    rows = [(k, ["weniya", i, "ketrivel"], n, "g") for k, (i, n) in enumerate([("a", 9), ("b", 8), ("c", 7), ("d", 6), ("d", 1), ("e", 5), ("c", 1)])]
    rows += [(10 + k, w, n, "h") for k, (w, n) in enumerate([(["weniya", "a", "ketrivel"], 2), (["weniya", "ketrivel"], 1)])]
    df = spark.createDataFrame(rows, "node bigint, words array<string>, n bigint, k string")
    got = {r.node: r.centre for r in names._stars(df, ["k"], 0.7).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 2, 10: 10, 11: 10}


def test_chains_of_spellings_end_at_their_last_word(spark):
    chain = ["abdefg", "hbdefg", "hidefg", "hijefg", "hijkfg", "hijklg", "hijklm"]
    df = spark.createDataFrame([("g", w, 1) for w in chain], "g string, word string, n bigint")
    assert {r.main for r in names.common_spelling(df).collect()} == {chain[-1]}


def test_names_with_digits_in_them_are_names(spark):
    rows = [("A", x) for x in ("Ravi4 Kumar", "Ravi Kumar", "24x7 Security Services Ltd", "24x7 Security Services", "SYNTH 645 0925", "XX12 3456", "7 Hills Traders", "9 Hills Traders")]
    got = groups(run(spark, rows))
    assert ["Ravi Kumar", "Ravi4 Kumar"] in got and ["24x7 Security Services", "24x7 Security Services Ltd"] in got
    assert ["7 Hills Traders"] in got and ["9 Hills Traders"] in got and not any("SYNTH 645 0925" in g or "XX12 3456" in g for g in got)
