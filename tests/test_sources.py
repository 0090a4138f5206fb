import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vinculum.functions import text as T
from vinculum.sources import files as S


def docx(lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return b.getvalue()


def test_documents_by_magic_and_extension(spark, tmp_path):
    data = {"a.txt": "héllo".encode(), "b.txt": "héllo".encode("latin-1"), "c.docx": docx(["One", "", "Two"]), "d.bin": b"%PDF-1.4", "e.png": b"\x89PNG\r\n\x1a\n", "f.csv": b"x,y\n"}
    for n, raw in data.items():
        (tmp_path / n).write_bytes(raw)
    got = {r.filename: (r.kind, r.text) for r in S.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("TEXT", "héllo"), "b.txt": ("TEXT", "héllo"), "c.docx": ("DOCX", "One\nTwo"), "d.bin": ("PDF", None), "e.png": ("IMAGE", None), "f.csv": ("CSV", "x,y\n")}


def test_uploads(spark):
    rows = [("a.txt", b"ok"), ("a.txt", b""), ("a.exe", b"MZ"), ("a.pdf", b"no"), ("a.pdf", b"%PDF-1"), ("a.txt", b"%PDF-1"), ("a.txt", b"x" * 50), ("a.docx", docx(["x"]))]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    assert [r.reject for r in S.check_uploads(df, 10_000).collect()] == [None, "empty", "extension_not_allowed", "content_mismatch", None, "content_mismatch", None, None]
    assert [r.reject for r in S.check_uploads(df.filter("length(content) = 50"), 40).collect()] == ["too_large"]
    names = spark.createDataFrame([("C:\\x\\y.txt",), ("/a/b.csv",), ("z",)], "p string").select(S.display_name(F.col("p")))
    assert [r[0] for r in names.collect()] == ["y.txt", "b.csv", "z"]


def test_csv_records(spark, tmp_path):
    tx = tmp_path / "t.csv"
    tx.write_text("Source,TARGET,Amount,Date,Txn_ID\nA,B,5.5,2024-01-01,1\nC,D,7,2024-01-02,2\n")
    kind, df = S.read_records(spark, str(tx))
    assert kind == "TRANSACTION" and [(r.sender, r.recipient, r.amount, r.currency, r.record_id) for r in df.collect()] == [("A", "B", 5.5, "INR", "1"), ("C", "D", 7.0, "INR", "2")]
    bad = tmp_path / "b.csv"
    bad.write_text("source,target,amount,date\nA,B,x,2024-01-01\nA,,5,2024-01-01\nA,B,5,2024-01-01\nA,B,5\n")
    assert [r.row_ok for r in S.read_records(spark, str(bad), strict=False)[1].collect()] == [False, False, True, False]
    with pytest.raises(PySparkException):
        S.read_records(spark, str(bad))[1].collect()
    cdr = tmp_path / "c.csv"
    cdr.write_text("entity,callee,timestamp,duration_s,tower\n1,2,2024-01-01,12.9,T1\n1,2,2024-01-01,soon,T1\n")
    kind, df = S.read_records(spark, str(cdr))
    assert kind == "CDR" and [(r.caller, r.duration, r.location) for r in df.collect()] == [("1", 12, "T1"), ("1", None, "T1")]
    with pytest.raises(ValueError):
        S.csv_kind(["a", "b"])


def test_lines_of_words(spark):
    rows = [(1, 1, 1, 1, 2, "world", 50, 10, 40, 12, 80.0), (1, 1, 1, 1, 1, "Hello", 5, 11, 40, 12, 90.0), (1, 1, 1, 2, 1, "x", 5, 30, 4, 12, -1.0), (1, 1, 2, 1, 1, "End", 5, 40, 30, 10, 70.0)]
    df = spark.createDataFrame(rows, "page int, block int, par int, line int, word_no int, text string, left int, top int, width int, height int, conf double")
    got = [(r.line_id, r.text, r.bbox, round(r.confidence, 3)) for r in S.lines_of_words(df).orderBy("line_id").collect()]
    assert got == [(1, "Hello world", [5.0, 10.0, 90.0, 23.0], 0.85), (2, "End", [5.0, 40.0, 35.0, 50.0], 0.7)]


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (T.normalize_text, "  a\u00a0\u2003b \r\n\r\n\r\n\r\nc\t\n", "a b\n\nc"), (T.normalize_text, "e\u0301", "é"), (T.normalize_text, "", ""), (T.normalize_text, None, None),
        (T.match_phone, "+91 98765-43210", "9876543210"), (T.match_phone, "098765 43210", "9876543210"), (T.display_phone, " 1  2 ", "1 2"),
        (T.match_vehicle, "mh-12 ab 1", "MH12AB1"), (T.display_vehicle, " mh-12  ab", "MH 12 AB"), (T.match_org, "Kota P.S.", "kota police station"), (T.match_org, "Psych Hospital Ltd", "psych hospital"),
        (T.match_location, " City,  Park. ", "city park"), (T.match_person, "Dr. A. Rao-X", "a. raox"), (T.alias_parts, "Sanju @ Sanjib", ["Sanju", "Sanjib"]), (T.alias_parts, " X ", ["X"]),
        (T.sentences, "A b. C d! E", ["A b.", "C d!", "E"]), (T.clamp, "7", 1.0), (T.clamp, "x", 0.5), (T.clamp, None, 0.5),
    ],
)
def test_normalisers(spark, f, value, want):
    assert one(spark, f, value) == want
    if f is T.normalize_text and want is not None:
        assert one(spark, f, want) == want


def test_grounding_types_and_chunks(spark):
    assert one(spark, T.grounding_ratio, "He  called", "she said he CALLED.") == 1.0
    assert one(spark, T.grounding_ratio, "alpha beta gamma", "alpha gamma") == pytest.approx(2 / 3)
    assert one(spark, T.grounding_ratio, "", "x") == 0.0 == one(spark, T.grounding_ratio, None, "x")
    assert one(spark, T.document_type, "The seizure memo was seized", "x") == "SEIZURE_MEMO" and one(spark, T.document_type, "nothing", None) == "GENERIC_EVIDENCE"
    text = "0123456789" * 2000
    got = one(spark, T.chunks, text)
    assert all(len(c) <= 9000 for c in got) and got[0] + "".join(c[1000:] for c in got[1:]) == text and one(spark, T.chunks, "short") == ["short"]
