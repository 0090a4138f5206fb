"""Files into tables: kinds by magic bytes, decoding, DOCX text, upload checks, CSV records, word boxes into lines."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Magic bytes and extensions of the kinds.
MAGIC = [("PDF", "255044462d"), ("IMAGE", "89504e470d0a1a0a"), ("IMAGE", "ffd8ff"), ("IMAGE", "474946383761"), ("IMAGE", "474946383961"), ("IMAGE", "49492a00"), ("IMAGE", "4d4d002a"), ("IMAGE", "424d")]
EXTENSIONS = {"pdf": "PDF", "png": "IMAGE", "jpg": "IMAGE", "jpeg": "IMAGE", "gif": "IMAGE", "tif": "IMAGE", "tiff": "IMAGE", "bmp": "IMAGE", "webp": "IMAGE", "docx": "DOCX", "csv": "CSV", "txt": "TEXT", "md": "TEXT", "json": "TEXT"}
ALLOWED = ["pdf", "png", "jpg", "jpeg", "tif", "tiff", "docx", "csv", "txt"]
SOURCE = ["source", "sender"]
TARGET = ["target", "recipient"]
TIME = ["timestamp", "transaction_time", "call_time", "time", "date"]
TX_ID = ["record_id", "id", "txn_id", "transaction_id"]
CALLER = ["caller", "entity"]
DURATION = ["duration", "duration_s", "duration_sec"]
PLACE = ["location", "cell", "cell_id", "tower"]
CALL_ID = ["record_id", "id", "cdr_id", "call_id"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def display_name(path: Column) -> Column:
    """Last part of a path with either slash, at most 255 characters."""
    return F.substring(F.regexp_extract(path, r"([^/\\]*)$", 1), 1, 255)


def kind(content: Column, path: Column) -> Column:
    """Magic bytes before extension; ZIP counts as DOCX with that extension; the default is TEXT."""
    head = F.lower(F.hex(F.substring(content, 1, 8)))
    by_magic = F.when(head.startswith("504b0304") & (extension(path) == "docx"), "DOCX")
    for name, magic in MAGIC:
        by_magic = by_magic.when(head.startswith(magic), name)
    table = F.create_map(*[F.lit(x) for k, v in EXTENSIONS.items() for x in (k, v)])
    return F.coalesce(by_magic, F.try_element_at(table, extension(path)), F.lit("TEXT"))


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


@F.pandas_udf(T.StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Paragraphs of a DOCX, blank ones dropped, one a line; null for what is no DOCX."""
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(raw):
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except Exception:
            return None
        lines = ("".join(t.text or "" for t in p.iter(f"{space}t")).strip() for p in root.iter(f"{space}p"))
        return "\n".join(x for x in lines if x)

    return content.map(lambda raw: None if raw is None else one(bytes(raw)))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, kind, file_hash, text) of the files under ``path``; PDF and images have null text and await a reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    k = kind(F.col("content"), F.col("path"))
    text = F.when(k == "DOCX", docx_text("content")).when(k.isin("TEXT", "CSV"), decode(F.col("content")))
    return raw.select("path", display_name(F.col("path")).alias("filename"), k.alias("kind"), F.sha2("content", 256).alias("file_hash"), text.alias("text"))


def check_uploads(files: DataFrame, most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """Files (path, content) with ``reject``: empty, too_large, extension_not_allowed, content_mismatch; null if acceptable."""
    size, ext = F.length("content"), extension(F.col("path"))
    claimed = F.try_element_at(F.create_map(*[F.lit(x) for k, v in EXTENSIONS.items() for x in (k, v)]), ext)
    real = kind(F.col("content"), F.lit(""))
    magic_kinds = claimed.isin("PDF", "IMAGE")
    zipped = F.hex(F.substring(F.col("content"), 1, 4)) == "504B0304"
    mismatch = (magic_kinds & (real != claimed)) | ((claimed == "DOCX") & ~zipped) | (claimed.isin("TEXT", "CSV") & (real != "TEXT"))
    reason = F.when(size == 0, "empty").when(size > most_bytes, "too_large").when(~ext.isin(*ALLOWED), "extension_not_allowed").when(mismatch, "content_mismatch")
    return files.withColumn("reject", reason)


def csv_kind(columns: list[str]) -> str:
    """TRANSACTION or CDR by the header's aliases; other headers raise ValueError."""
    have = {c.strip().lower() for c in columns}
    if have & set(SOURCE) and have & set(TARGET) and "amount" in have:
        return "TRANSACTION"
    if have & set(CALLER) and "callee" in have:
        return "CDR"
    raise ValueError(f"header is neither of transactions nor of calls: {sorted(have)}")


def read_records(spark: SparkSession, path: str, strict: bool = True) -> tuple[str, DataFrame]:
    """Kind and normalised records of CSV files with one header; column row_ok tells whether a row is valid.

    Alias columns count in their declared order, the first filled one wins. Currency defaults to INR, durations are cut to
    whole seconds, unreadable ones are null. Rows of another length than the header are invalid. With ``strict`` reading an
    invalid row raises an error; otherwise they are kept with row_ok false. Files without data rows give an empty table.
    """
    header = spark.read.option("header", "true").csv(path)
    names = header.columns
    what = csv_kind(names)
    schema = ", ".join(f"`c{i}` string" for i in range(len(names))) + ", _bad string"
    rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    at = {n.strip().lower(): i for i, n in reversed(list(enumerate(names)))}

    def pick(aliases: list[str]) -> Column:
        cols = [F.nullif(F.trim(f"c{at[a]}"), F.lit("")) for a in aliases if a in at]
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    if what == "TRANSACTION":
        amount = pick(["amount"])
        out = [pick(SOURCE).alias("sender"), pick(TARGET).alias("recipient"), amount.try_cast("double").alias("amount"), F.coalesce(pick(["currency"]), F.lit("INR")).alias("currency"), pick(TIME).alias("transaction_time"), pick(TX_ID).alias("record_id")]
        need = ["sender", "recipient", "amount", "transaction_time"]
    else:
        out = [pick(CALLER).alias("caller"), pick(["callee"]).alias("callee"), pick(TIME).alias("call_time"), F.floor(pick(DURATION).try_cast("double")).cast("bigint").alias("duration"), pick(PLACE).alias("location"), pick(CALL_ID).alias("record_id")]
        need = ["caller", "callee", "call_time"]
    rows = rows.select(*out, F.col("_bad").isNull().alias("_ok"))
    ok = F.col("_ok")
    for c in need:
        ok &= F.col(c).isNotNull()
    rows = rows.withColumn("row_ok", ok).drop("_ok")
    if strict:
        rows = rows.filter(F.when(F.col("row_ok"), F.lit(True)).otherwise(F.raise_error(F.lit("invalid CSV row")).cast("boolean")))
    return what, rows


def lines_of_words(words: DataFrame) -> DataFrame:
    """Words (page, block, par, line, word_no, text, left, top, width, height, conf) into lines: page, line_id, text, bbox,
    confidence (mean of conf / 100, words with conf below 0 left out)."""
    w = words.filter(F.col("conf") >= 0).filter(F.trim("text") != "")
    key = ["page", "block", "par", "line"]
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    box = F.array(*[c.cast("double") for c in (F.min("left"), F.min("top"), F.max(right), F.max(bottom))])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
    rows = w.groupBy(*key).agg(text.alias("text"), box.alias("bbox"), (F.avg("conf") / 100).alias("confidence"))
    from pyspark.sql import Window as W

    return rows.withColumn("line_id", F.row_number().over(W.partitionBy("page").orderBy("block", "par", "line"))).select("page", "line_id", "text", "bbox", "confidence")
