import pytest

from vinculum.llm import pieces, vocabulary

PATH = vocabulary.default_path()
LINE = "The vehicle was parked near the water tank. Nobody saw it leave, as the guard said. "


def check(text, limit, overlap):
    ids = vocabulary.encoding(PATH).encode_ordinary(text)
    got = pieces.cut(text, PATH, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(ids)
    assert all(b - a <= limit for a, b, _, _ in got)
    assert all(nxt[0] == prev[1] - overlap and nxt[1] > prev[1] for prev, nxt in zip(got, got[1:]))
    raw = text.encode()
    for a, b, x, y in got:
        assert len(vocabulary.encoding(PATH).encode_ordinary(raw[x:y].decode())) <= limit or limit < 100
    return got


@pytest.mark.parametrize("limit,overlap", [(60, 10), (200, 20), (2000, 100)])
def test_pieces_cover_the_text_within_the_limit(limit, overlap):
    long_section = "# HEAD\n\n" + LINE * 120
    for text in (LINE * 300, ("TITLE OF IT\n\n" + LINE * 3 + "\n\n") * 60, "xq" * 9000, "नमस्ते दुनिया। " * 800, "🙏🏽" * 1500, "a\n" * 5000, "\n" * 40_000, "HEAD\n\n" + long_section + long_section):
        assert len(check(text * 3, limit, overlap)) > 1


def test_cuts_fall_on_paragraphs_and_sentences():
    text = "\n\n".join(LINE * 4 for _ in range(12))
    raw = text.encode()
    for a, b, x, y in check(text, 300, 20)[:-1]:
        assert raw[y : y + 3].strip() == b"" or raw[y - 1 : y].isspace()
    text = LINE * 60
    raw = text.encode()
    assert all(raw[:y].endswith(b".") for _, _, _, y in check(text, 300, 20)[:-1])


def test_table_with_nulls_and_repeats(spark):
    long = LINE * 300
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0), (None, "short", 0)], "doc_id int, text string, piece int")
    rows = pieces.split_oversized(df).collect()
    assert {(r.doc_id, r.piece) for r in rows if r.doc_id != 3} == {(1, None), (2, ""), (None, "short")}
    n = len(pieces.cut(long, PATH, 2000, 100))
    assert sorted(r.piece_no for r in rows if r.doc_id == 3) == sorted([*range(n)] * 2)
    assert pieces.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.split_oversized(df, limit=100, overlap=50)


def test_found_documents_are_those_over_the_limit(spark, small):
    from vinculum.llm.plans import p10_found

    enc = vocabulary.encoding(PATH)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id for r in docs if len(enc.encode_ordinary(r.text or "")) > 2000}
    assert {r.doc_id for r in p10_found(spark, small).collect()} == want


def kinds(node, depth=0):
    return [(depth, node.kind), *(k for c in node.children for k in kinds(c, depth + 1))]


def test_headings_lists_and_markup_make_a_nested_tree():
    text = "# A\nintro\n\n## A1\npara one\nline two\n\n- x\n  - x1\n  - x2\n- y\n\n## A2\npara\n\n# B\n<div><p>one</p><p>two</p></div>\n```\n# no heading\n```\n"
    tree = pieces.parse(text)
    a, b = tree.children[0], [c for c in tree.children if text[c.start : c.end].startswith("# B")][0]
    assert text[a.start : a.end].startswith("# A\nintro") and [c.kind for c in a.children] == ["paragraph", "section", "section"]
    lists = [c for c in a.children[1].children if c.kind == "list"][0]
    assert [c.kind for c in lists.children] == ["item", "item"] and [c.kind for c in lists.children[0].children] == ["paragraph", "list"]
    assert len(lists.children[0].children[1].children) == 2
    markup = [c for c in tree.children if c.kind == "markup"][0]
    assert [text[c.start : c.end] for c in markup.children if c.kind == "markup"] == ["<p>one</p>", "<p>two</p></div>\n"[:10]] or len([c for c in markup.children if c.kind == "markup"]) == 2
    assert b.kind == "section" and not any("no heading" in text[c.start : c.end] and c.kind == "section" and c is not b for c in tree.children)

    def covered(node):
        if node.children:
            assert node.children[0].start == node.start and node.children[-1].end == node.end
            assert all(x.end == y.start for x, y in zip(node.children, node.children[1:]))
            for c in node.children:
                covered(c)

    covered(tree)


def test_no_part_of_an_oversized_node_is_glued_to_its_uncle():
    text = "# A\n\n## A1\n\n" + LINE * 30 + "\n\n## A2\n\n" + LINE * 2 + "\n\n## A3\n\n" + LINE * 2 + "\n\n# B\n\n" + LINE * 3
    raw = text.encode()
    fresh = [raw[y0:y].decode() for (_, _, _, y), y0 in zip(check(text, 300, 20), [0, *(p[3] for p in check(text, 300, 20))])]
    assert not any("## A2" in p and not p.lstrip().startswith("## A2") for p in fresh)
    assert any("## A2" in p and "## A3" in p for p in fresh)  # siblings are merged
    assert not any("## A3" in p and "# B" in p.replace("## ", "") and "# B" in p for p in fresh)


def test_pieces_of_all_documents_encoded_anew_keep_the_limit(spark, small):
    from vinculum.llm.plans import p10_pieces

    enc = vocabulary.encoding(PATH)
    rows = p10_pieces(spark, small).collect()
    assert rows and all(len(enc.encode_ordinary(r.piece)) <= 2000 for r in rows)


def test_token_columns_are_given_for_short_texts_too(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id int, text string")
    assert {(r.doc_id, r.n_tokens) for r in pieces.split_oversized(df).collect()} == {(1, 2), (2, 0), (3, 0)}
    assert pieces.split_oversized(df, with_tokens=False, with_text=False).columns == ["doc_id", "piece_no", "n_pieces"]
