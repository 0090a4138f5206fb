"""A whole corpus as token ids, by a table of its distinct words.

Texts are split into the tokenizer's words by Spark; each distinct word is encoded once; ids come back by position. Words that
make up at least 1/``hot`` of all occurrences are at most ``hot`` many, so exactly these are looked up in a broadcast table;
all others come back through a join on the word, in which no key holds more than that share of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm import vocabulary
from vinculum.session import materialise, release

#: Fixed value: how the byte-level tokenizer splits words; (?U) gives \s the Unicode white space.
WORD = r"(?U)('(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"


def _words(text: str):
    return F.regexp_extract_all(F.col(text), F.lit(WORD), 1)


def width_of(path: str) -> np.dtype:
    """The unsigned integers in which the ids of a vocabulary are packed: two bytes if they fit, else four; the largest of the kind
    stands for a word whose ids are still missing."""
    return np.dtype(np.uint16 if max(vocabulary.ranks(path).values()) < 65_535 else np.uint32)


def packed(edges: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Binary values of the bytes of ``ids``, one for each range between ``edges``."""
    size = ids.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def unpacked(values: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Edges and ids of packed values."""
    _, edges, data = values.buffers()
    edges = np.frombuffer(edges, dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    if data is None or edges[-1] == edges[0]:
        return np.zeros(len(values) + 1, dtype=np.int64), np.empty(0, dtype=kind)
    return (edges - edges[0]) // kind.itemsize, np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]].view(kind)


def word_table(df: DataFrame, text: str, path: str) -> DataFrame:
    """(word, n, ids): each distinct word of ``text``, its occurrences and its ids; the word is encoded once."""
    counts = df.filter(F.col(text) != "").select(F.explode(_words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def encode(batches):
        enc = vocabulary.encoding(path)
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return counts.mapInArrow(encode, "word string, n bigint, ids array<int>")


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, hot: int = 200_000) -> DataFrame:
    """(``key``, ``ids`` ARRAY<INT>) for every row of ``df``, in the ids of the byte-level vocabulary at ``path``.

    Null and empty texts have the empty list. Repeated keys and rows each keep their row; a null key stays null; extra
    columns are not returned. An empty table gives an empty one. Texts of any length are encoded whole.
    """
    path = path or vocabulary.default_path()
    kind_of_id = width_of(path)
    missing_id = np.iinfo(kind_of_id).max
    spark = df.sparkSession
    df = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    table = materialise(word_table(df, "_text", path))
    release(spark)
    total = table.agg(F.sum("n")).first()[0] or 0
    top = table.filter(F.col("n") >= max(1.0, total / hot)).select("word", "ids").collect() if total else []
    lens = np.array([len(r.ids) for r in top], dtype=np.int64)
    shared = spark.sparkContext.broadcast(
        ([r.word for r in top], np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), np.array([i for r in top for i in r.ids], dtype=kind_of_id))
    )

    def look_up(batches):
        words, starts, flat = shared.value
        words = pa.array(words, pa.string())
        sizes = np.diff(starts)
        for b in batches:
            lists = b.column("_words")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets -= offsets[0]
            at = pc.fill_null(pc.index_in(values, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            rare = at < 0
            if len(sizes):
                n = np.where(rare, 1, sizes[at])
            else:
                n = np.ones(len(at), dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            out = np.full(ends[-1], missing_id, dtype=kind_of_id)
            if len(sizes):
                src = np.repeat(np.where(rare, 0, starts[at]) - ends[:-1], n) + np.arange(ends[-1])
                known = np.repeat(~rare, n)
                out[known] = flat[src[known]]
            before = np.concatenate([[0], np.cumsum(rare)])
            missing = values.filter(pa.array(rare))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("_row"),
                    b.column("_key"),
                    packed(ends[offsets], out),
                    pa.ListArray.from_arrays(pa.array(before[offsets].astype(np.int32)), missing),
                ],
                ["_row", "_key", "ids", "rare"],
            )

    words = F.coalesce(_words("_text"), F.array().cast("array<string>"))
    kind = df.schema["_key"].dataType.simpleString()
    split = df.select(F.monotonically_increasing_id().alias("_row"), "_key", words.alias("_words"))
    found = materialise(split.mapInArrow(look_up, f"_row bigint, _key {kind}, ids binary, rare array<string>"))
    release(spark)
    spots = found.select("_row", F.posexplode("rare").alias("_at", "word"))
    spots = spots.join(table.select("word", F.col("ids").alias("_ids")), "word").groupBy("_row")
    spots = spots.agg(F.array_sort(F.collect_list(F.struct("_at", "_ids"))).alias("_fill"))
    open_ = found.filter(F.size("rare") > 0).select("_row", "_key", "ids").join(spots, "_row")

    def unpack(batches):
        for b in batches:
            offsets, flat = unpacked(b.column("ids"), kind_of_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("_key"), lists], ["_key", "ids"])

    def fill(batches):
        for b in batches:
            fills = b.column("_fill")
            offsets, flat = unpacked(b.column("ids"), kind_of_id)
            edge = fills.offsets.to_numpy()
            lists = fills.values.slice(edge[0], edge[-1] - edge[0]).field("_ids")
            edge = lists.offsets.to_numpy().astype(np.int64)
            new = lists.values.to_numpy(zero_copy_only=False)
            hole = flat == missing_id
            n = np.ones(len(flat), dtype=np.int64)
            n[hole] = np.diff(edge)
            ends = np.concatenate([[0], np.cumsum(n)])
            out = np.empty(ends[-1], dtype=np.int32)
            out[ends[:-1][~hole]] = flat[~hole]
            at = np.repeat(edge[:-1] - ends[:-1][hole], n[hole])
            where = np.repeat(hole, n)
            out[where] = new[at + np.flatnonzero(where)]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(out))], ["_key", "ids"])

    filled = open_.select("_key", "ids", "_fill").mapInArrow(fill, f"_key {kind}, ids array<int>")
    done = found.filter(F.size("rare") == 0).select("_key", "ids").mapInArrow(unpack, f"_key {kind}, ids array<int>")
    return done.unionByName(filled).withColumnRenamed("_key", key)


def pieces_table(spark, path: str | None = None) -> DataFrame:
    """(id, piece BINARY) of the vocabulary, 50,256 rows at any data size."""
    rows = [(k, bytearray(p)) for p, k in vocabulary.ranks(path or vocabulary.default_path()).items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(``key``, ``text``) from id lists: ids join the vocabulary's pieces (a table of fixed size, broadcast) and are put together
    by position. An empty or null list gives the empty text. Ids outside the vocabulary raise no error and give U+FFFD."""
    pieces = F.broadcast(pieces_table(df.sparkSession, path))
    rows = materialise(df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(ids).alias("_ids")))
    spots = rows.select("_row", F.posexplode("_ids").alias("_at", "id")).join(pieces, "id", "left")
    piece = F.coalesce(F.hex("piece"), F.lit("EFBFBD"))
    whole = spots.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", piece.alias("h")))).alias("_p"))
    text = F.decode(F.unhex(F.array_join(F.transform("_p", lambda x: x["h"]), "")), "UTF-8")
    return rows.select("_row", "_key").join(whole, "_row", "left").select(F.col("_key").alias(key), F.coalesce(text, F.lit("")).alias("text"))
