import itertools
import random

from vinculum.llm.leaks import Searcher, find_leaks, passage_words

rng = random.Random(5)
VOCABULARY = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(60)]
PASSAGES = [(k, " ".join(rng.choices(VOCABULARY, k=n))) for k, n in enumerate([19, 20, 30, 45, 60, 60])]


def brute(text, passages, need=20):
    """A window of the passage is there if the document's words hold it but for one word changed or dropped."""
    d = passage_words(text)
    found = set()
    for item, p in passages:
        p = passage_words(p)
        for i in range(len(p) - need + 1):
            w = p[i : i + need]
            for at in range(len(d)):
                k = 0
                while k < need and at + k < len(d) and d[at + k] == w[k]:
                    k += 1
                if k == need or k < need and (w[k + 1 :] == d[at + k + 1 : at + need] or w[k + 1 :] == d[at + k : at + need - 1]):
                    found.add(item)
                    break
            else:
                continue
            break
    return found


def test_search_equals_brute_force_on_damaged_quotes():
    s = Searcher(PASSAGES)
    seen = set()
    for trial in range(400):
        _, p = rng.choice(PASSAGES)
        w = p.split()
        n = rng.randint(15, 26)
        a = rng.randint(0, max(0, len(w) - n))
        q = w[a : a + n]
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(q))
            q[k : k + 1] = rng.choice([["zzz"], [], [q[k] + "x"]])
        filler = rng.choices(VOCABULARY, k=30)
        text = " ".join(filler[:15] + q + filler[15:])
        want = brute(text, PASSAGES)
        assert s.find(text) == want, (trial, text)
        seen |= {bool(want)}
    assert seen == {True, False}


def test_case_punctuation_and_spacing_do_not_count():
    s = Searcher(PASSAGES)
    w = PASSAGES[3][1].split()[5:27]
    assert s.find("x, " + " ".join(x.upper() + "," for x in w) + "!") >= {3}
    assert s.find(" ".join(w[:6]) + "".join(w[6:])) >= {3}
    assert s.find(" ".join(w[:15])) == set()


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    items = spark.createDataFrame([(k, p, "i") for k, p in PASSAGES] + [(90, None, None), (91, "", "x"), (3, PASSAGES[3][1], "again")], "item_id int, passage string, text string")
    docs = [(1, PASSAGES[3][1], 0), (1, PASSAGES[3][1], 0), (2, None, 0), (3, "", 0), (4, "  ", 0), (None, PASSAGES[3][1], 0), (5, "q " * 50_000 + PASSAGES[5][1], 0)]
    df = spark.createDataFrame(docs, "doc_id int, text string, item_id int")
    got = find_leaks(df, items)
    assert got.columns == ["doc_id", "item_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 3), (None, 3), (5, 5)], key=str)
    assert find_leaks(df.limit(0), items).count() == 0
    assert find_leaks(df, items.limit(0)).count() == 0


def test_smallest_tables_against_brute_force(spark, small):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/eval_items.parquet").select("item_id", "passage").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if r.text]
    got = find_leaks(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/eval_items.parquet")).collect()
    near = {d for d, t in docs if len(t) < 3000}
    short = [(d, t) for d, t in docs if d in near]
    grams = {g for _, p in items for g in zip(*[passage_words(p)[k:] for k in range(9)])}
    want = set()
    for d, t in short:
        w = passage_words(t)
        if any(g in grams for g in zip(*[w[k:] for k in range(9)])):
            want |= set(itertools.product([d], brute(t, items)))
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id in near} == want


def test_more_items_than_one_batch_holds(spark):
    docs = spark.createDataFrame([(k, f"x {p} y") for k, p in PASSAGES], "doc_id int, text string")
    items = spark.createDataFrame(PASSAGES + PASSAGES, "item_id int, passage string")
    whole = {tuple(r) for r in find_leaks(docs, items).collect()}
    assert whole and {tuple(r) for r in find_leaks(docs, items, most_items=2).collect()} == whole
