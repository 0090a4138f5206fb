from vinculum.llm import scans

BODY = ["The vehicle was parked near the water tank and", "nobody saw it leave before the evening. The offi-", "cer on duty recorded the statement of a witness", "and the register is kept by the head clerk."]


FILL = [f"{a} {b} went to the {c} and" for a, b, c in zip(["malo", "tevi", "soru", "neka", "pilo", "gari"] * 4, ["dron", "kast", "velm", "yurt", "hosk"] * 5, ["hall", "yard", "shop", "gate"] * 6)]


def pages(n=6):
    rows = []
    for p in range(1, n + 1):
        u = FILL[4 * p - 4 : 4 * p]
        lines = ["MARKOL POLICE STATION", *u[:2], "they left.", *BODY, "82283", "the vehic1e was seen tlirough the shutter and the", "co-accused used to meet behind the grain godown.", *u[2:], f"- {p} -"]
        rows += [(1, p, k, t, None, 0.9) for k, t in enumerate(lines, 1)]
    more = [(2, p, k, t, None, None) for p in range(1, 12) for k, t in enumerate(["a line of its own " + FILL[p], *FILL[p : p + 2], "the vehicle was seen through the shutter by an officer", "and the co-accused was seen with the vehicle", "through the shutter of the grain godown there", *FILL[p + 3 : p + 6]], 1)]
    return rows + more


SCHEMA = "scan_id bigint, page bigint, line_id bigint, text string, bbox array<double>, confidence double"


def defects(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in scans.find_defects(df).collect()}


def test_headers_numbers_hyphens_and_misread_words(spark):
    got = defects(spark, pages())
    for p in range(1, 7):
        assert {(1, p, 1, "header"), (1, p, 14, "page_number"), (1, p, 6, "hyphen"), (1, p, 10, "misread")} <= got
    assert len([d for d in got if d[0] == 1]) == 6 * 4


def test_compound_at_its_own_hyphen_is_no_broken_word(spark):
    rows = pages() + [(3, 1, 1, "and then the co-", None, None), (3, 1, 2, "accused was seen", None, None)]
    assert not any(d[0] == 3 for d in defects(spark, rows))


def test_nulls_repeats_and_empty_tables(spark):
    assert defects(spark, []) == set()
    rows = [(1, 1, 1, None, None, None), (1, 1, 2, "", None, None), (None, 1, 1, "x", None, None), (1, None, 1, "x", None, None), (1, 1, 3, "word " * 20_000, None, None)]
    assert defects(spark, rows + rows) == set()


def test_paragraphs_are_continuous(spark):
    rows = pages()
    blocks = spark.createDataFrame(rows, SCHEMA)
    raw = []
    for p in range(1, 7):
        lines = [r[3] for r in rows if r[:2] == (1, p)]
        raw.append((1, p, "\n".join([*lines[:4], "", *lines[4:8], "", lines[8], "", *lines[9:11], "", *lines[11:]])))
    results = spark.createDataFrame(raw + [(2, p, None) for p in range(1, 12)], "scan_id bigint, page bigint, raw_text string")
    got = [r.text for r in scans.paragraphs(blocks, results).collect() if r.scan_id == 1]
    assert got.count("The vehicle was parked near the water tank and nobody saw it leave before the evening. The officer on duty recorded the statement of a witness and the register is kept by the head clerk.") == 6
    assert got.count("the vehicle was seen through the shutter and the co-accused used to meet behind the grain godown.") == 6
    assert not any("POLICE STATION" in t or "- 3 -" in t for t in got)


def test_page_numbers_of_any_size(spark):
    from pyspark.sql import functions as F

    texts = ["xxi", "xlii", "mcmxc", "12345", "Page 10001 of 20000", "- 7 -", "mill", "iiii", "livid", "xx|"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scans._number(F.col("t")).alias("n")).collect()]
    assert got == [21, 42, 1990, 12345, 10001, 7, None, None, None, 21]
    rows = [(1, p, 1, str(p + 5000), None, None) for p in range(1, 4)] + [(1, p, k, f"{FILL[3 * p + k]}", None, None) for p in range(1, 4) for k in (2, 3, 4)]
    assert {d for d in defects(spark, rows) if d[3] == "page_number"} == {(1, p, 1, "page_number") for p in range(1, 4)}
