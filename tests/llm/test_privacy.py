import numpy as np

from vinculum.llm import privacy as P
from vinculum.llm.plans import QUERIES
from vinculum.llm.trees import BoostedTrees

TEXT = (
    "Memo 184-A: urvola ishlonath, resident of Flt 24-E, Palmora Apartments, Rangindel Str, Pambatawadi Enclave, was questioned on 2025-05-02. "
    "The informant may be reached at (+91) 0863 686 048 or by mail at prelik.n [at] mail [dot] example [dot] net. "
    "Identity of Mr Lunu Vortudur was verified against document ZZ-77 20630045879. Lavnesh Motors and Sons paid Rs. 62,500 from SYNTH5180805. "
    "Adv. Sordapur deposed that Ketot Sorkabekar had rung from 019 394 9195 soon after. PERSON_A owed ORG_B. Case file 195/2026, hash 93df74745e06fc43fc8f71b4cd678753."
)
ITEMS = {
    ("NAME", "urvola ishlonath"), ("ADDRESS", "Flt 24-E, Palmora Apartments, Rangindel Str, Pambatawadi Enclave"), ("PHONE", "(+91) 0863 686 048"),
    ("EMAIL", "prelik.n [at] mail [dot] example [dot] net"), ("NAME", "Lunu Vortudur"), ("ID_NUMBER", "ZZ-77 20630045879"), ("NAME", "Sordapur"),
    ("NAME", "Ketot Sorkabekar"), ("PHONE", "019 394 9195"),
}
#: Ordinary sentences whose frames are nowhere trained on.
ORDINARY = [
    ("The keys were left with Aarti Deshmukh at reception.", {("NAME", "Aarti Deshmukh")}),
    ("Our accountant Pavel Dvorak filed the papers late.", {("NAME", "Pavel Dvorak")}),
    ("Payment was received from Malelo Prelmawala for the goods.", {("NAME", "Malelo Prelmawala")}),
    ("call me at 555-0147 or +44 20 7946 0958", {("PHONE", "555-0147"), ("PHONE", "+44 20 7946 0958")}),
    ("On Tuesday Harish Menon and Leela Thomas inspected the boiler.", {("NAME", "Harish Menon"), ("NAME", "Leela Thomas")}),
    ("the cash was counted by ramesh yadav in front of two clerks", {("NAME", "ramesh yadav")}),
    ("Mrs. Oduya phoned from (212) 555-0188 to cancel.", {("NAME", "Oduya"), ("PHONE", "(212) 555-0188")}),
    ("Forward all bills to nadia.petrov@mail.example.org please.", {("EMAIL", "nadia.petrov@mail.example.org")}),
    ("He now rents 14 Neelmira Street, Venduri 109657 from a cousin.", {("ADDRESS", "14 Neelmira Street, Venduri 109657")}),
    ("She grew up at 12/A Hill Road, Rose Nagar before the flood.", {("ADDRESS", "12/A Hill Road, Rose Nagar")}),
    ("Kindly book a seat for Tomasz Zielinski, passport ZX1234567.", {("NAME", "Tomasz Zielinski"), ("ID_NUMBER", "ZX1234567")}),
    ("IMRAN QURESHI WAS LAST HEARD OF IN MARCH.", {("NAME", "IMRAN QURESHI")}),
    ("Nobody at Brightwater Foods Ltd remembers the order.", set()),
    ("The weekly market near North Gate was closed.", set()),
    ("Signed, Dr K. Balasubramaniam", {("NAME", "K. Balasubramaniam")}),
    ("सुनीता वर्मा ने दुकान बंद कर दी।", {("NAME", "सुनीता वर्मा")}),
    ("His grandson, Vikram Sethi, drives the truck.", {("NAME", "Vikram Sethi")}),
    ("If you see Olumide Bankole, ask about the ladder.", {("NAME", "Olumide Bankole")}),
    ("Tickets cost Rs. 1,250 and the show starts on 12 May 2025.", set()),
    ("Parcel for Shri Vorik Devmasen left quickly.", {("NAME", "Vorik Devmasen")}),
    ("My aadhaar is 4821 7713 9020 and it expired.", {("ID_NUMBER", "4821 7713 9020")}),
    ("Interview of Grace Mwangi (clerk) took an hour.", {("NAME", "Grace Mwangi")}),
    ("The roof over Flat 9, Sunrise Towers, Lake Road leaks.", {("ADDRESS", "Flat 9, Sunrise Towers, Lake Road")}),
    ("Later we heard that Bela Kovacs had sold the boat to Ines Duarte.", {("NAME", "Bela Kovacs"), ("NAME", "Ines Duarte")}),
]


def found(text):
    return {(P.KINDS[k], text[a:b]) for a, b, k in P.trained().find([text])[0]}


def scores(rows):
    hit = miss = extra = 0
    for text, gold in rows:
        got = found(text)
        hit, miss, extra = hit + len(got & gold), miss + len(gold - got), extra + len(got - gold)
    return hit / max(1, hit + miss), hit / max(1, hit + extra)


def test_items_of_each_kind_and_nothing_else():
    assert found(TEXT) == ITEMS


def test_recall_on_frames_never_trained_on():
    held = [(t, g) for t, g, f in P.labelled_rows(seed=77) if f % 4 == 3]
    recall, precision = scores(held)
    assert recall >= 0.9 and precision >= 0.9 and P.trained().f1 >= 0.9
    recall, precision = scores(ORDINARY)
    assert recall >= 0.9 and precision >= 0.9


def test_every_part_of_a_run_of_words_is_a_candidate():
    text = "Yesterday Vorik Anel Devmasen Turned"
    w = P.Words(text, P.lexicon(P.trained().path))
    got = {text[w.starts[i] : w.ends[j]] for i, j, _, _ in P._names(w)}
    assert {"Vorik Anel Devmasen", "Vorik Anel", "Anel Devmasen", "Vorik Anel Devmasen Turned"} <= got
    assert not any("Yesterday" in g for g in got)


def test_tables_with_nulls_repeats_and_long_texts(spark):
    long = "Nothing was said. " * 5000 + TEXT
    rows = [(1, TEXT, "x"), (1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (None, TEXT, "x"), (4, long, "x")]
    df = spark.createDataFrame(rows, "k int, t string, pii_kind string")
    got = [tuple(r) for r in P.find_personal(df, "k", "t").collect()]
    assert sorted(got, key=str) == sorted([(k, *i) for k in (1, 1, None, 4) for i in ITEMS], key=str)
    assert P.find_personal(df.limit(0), "k", "t").count() == 0
    red = {r.k: r.redacted for r in P.redact(df, "k", "t").collect()}
    assert red[2] is None and red[3] == "" and "[PHONE]" in red[1] and "Vortudur" not in red[1] and red[1].startswith("Memo 184-A: [NAME], resident of [ADDRESS], was")


def test_redacted_holds_every_document_and_every_snippet(spark, tmp_path):
    plain = "Nothing was said."
    spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, plain), (4, plain)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    listed = [("e1", [TEXT, plain, TEXT]), ("e2", [None, "", "Ask Mr Lunu Vortudur."]), ("e3", []), ("e4", None), (None, [plain])]
    spark.createDataFrame(listed, "entity_id string, evidence_snippets array<string>").write.parquet(f"{tmp_path}/entity_attributes.parquet")
    got = [tuple(r) for r in QUERIES["p6_redacted"](spark, str(tmp_path)).select("doc_id", "entity_id", "snippet_no", "redacted").collect()]
    red = next(r[3] for r in got if r[0] == 1)
    assert red.startswith("Memo 184-A: [NAME], resident of [ADDRESS], was") and not any(item in red for _, item in ITEMS)
    docs = [(1, red), (2, None), (3, ""), (4, plain), (4, plain)]
    snippets = [("e1", 0, red), ("e1", 1, plain), ("e1", 2, red), ("e2", 0, None), ("e2", 1, ""), ("e2", 2, "Ask Mr [NAME]."), (None, 0, plain)]
    assert sorted(got, key=str) == sorted([*((k, None, None, t) for k, t in docs), *((None, e, n, t) for e, n, t in snippets)], key=str)


def test_odd_texts_do_no_harm():
    for text in ("", " ", "@", "at", "A.", "12", "((+", "₹", "ـ" * 50, "x" * 5000, "9" * 5000, "Ab " * 3000, "a-b'c/d_e", "शब्द" * 999, "[at] [dot]", "# 1", "Mr.", "Mr. ", "\n\n\t", "İstanbul Şahin"):
        P.trained().find([text])


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((800, 5))
    x[:, 2] = 7  # constant
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = BoostedTrees(rounds=40, depth=3).fit(x[:600], y[:600])
    assert ((m.probability(x[600:]) > 0.5) == y[600:]).mean() > 0.93
