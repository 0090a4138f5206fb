"""Relationships between mentions: trigger words in sentences, calls and transfers of structured records."""

from __future__ import annotations

import functools
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.operators.extraction import mention_order
from vinculum.operators.fixed_values import NEGATION, TRIGGERS

_NOT = re.compile(NEGATION)
_BETWEEN = {name: re.compile(rf"\b(?:{p})\b", re.I) for name, p, _ in TRIGGERS}
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


@functools.cache
def _rules() -> dict[tuple[str, str], list[tuple[str, re.Pattern]]]:
    """The relationships that two types may have, in order."""
    table: dict[tuple[str, str], list[tuple[str, re.Pattern]]] = {}
    for name, _, ends in TRIGGERS:
        for pair in ends:
            table.setdefault(pair, []).append((name, _BETWEEN[name]))
    return table


def _spots(sentence: str, by_name: dict[str, list[tuple[str, str]]]) -> list[tuple[int, int, str, str]]:
    """(start, end, mention, type) of every mention's name in a sentence, in order; names may lie in each other."""
    low = sentence.lower()
    here = {name for name in by_name if name in low}
    spots = sorted(
        (m.start(), m.end(), i, kind) for name in here for m in re.finditer(rf"\b{re.escape(name)}\b", sentence, re.I) for i, kind in by_name[name]
    )
    return spots if len(spots) > 1 else []


def relations_of(text: str, found: list[tuple[str, str, str]]) -> list[tuple[int, str, str, str, str]]:
    """(ordinal, source, relationship, target, sentence) from the mentions (id, type, name) of one text.

    The positions of a sentence are joined with those to their right; the words between the two decide by the rules of their
    types. No negation may stand there or in the thirty characters before the source. Each (source, relationship, target)
    counts once, in its first sentence.
    """
    rules = _rules()
    by_name: dict[str, list[tuple[str, str]]] = {}
    for i, kind, name in found:
        by_name.setdefault(name.lower(), []).append((i, kind))
    first: dict[tuple[str, str, str], str] = {}
    for sentence in filter(None, map(str.strip, _SENTENCE.split(text))):
        spots = _spots(sentence, by_name)
        negated = [m.span() for m in _NOT.finditer(sentence)] if spots else []
        for (a, a_end, source, kind), (b, _, target, other) in itertools.product(spots, spots):
            allowed = rules.get((kind, other))
            if not allowed or a_end > b or any(a_end <= x and y <= b or max(0, a - 30) <= x and y <= a for x, y in negated):
                continue
            between = sentence[a_end:b]
            for name, trigger in allowed:
                if (source, name, target) not in first and trigger.search(between):
                    first[source, name, target] = sentence
    return [(k, *key, sentence) for k, (key, sentence) in enumerate(first.items())]


def text_relations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, ordinal, src, type, tgt, confidence, status, snippet) from documents (doc, text) and their mentions."""
    m = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(mention_order(F.col("mention_id")).alias("o"), "mention_id", "etype", "name"))).alias("_m"))
    rows = docs.select("doc", "text").join(m.filter(F.size("_m") > 1), "doc")

    def run(frames):
        for f in frames:
            out = [(d, *r) for d, t, ms in zip(f["doc"], f["text"], f["_m"]) for r in relations_of(t, [(x["mention_id"], x["etype"], x["name"]) for x in ms])]
            yield pd.DataFrame(out, columns=["doc", "ordinal", "src", "type", "tgt", "snippet"])

    kind = docs.schema["doc"].dataType.simpleString()
    got = rows.mapInPandas(run, f"doc {kind}, ordinal int, src string, type string, tgt string, snippet string")
    return got.select("doc", "ordinal", "src", "type", "tgt", F.lit(0.95).alias("confidence"), F.lit("CONFIRMED").alias("status"), "snippet")


def record_stubs(records: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """(doc, name, etype, confidence): parties of records (doc, source, target) that no mention of the document is named like.

    ``kind`` is TRANSACTION (parties are bank accounts) or CDR (phones)."""
    etype = "BANK_ACCOUNT" if kind == "TRANSACTION" else "PHONE"
    parties = records.select("doc", F.explode(F.array("source", "target")).alias("name")).filter("trim(name) <> ''").withColumn("_k", F.lower("name"))
    have = found.select("doc", F.lower("name").alias("_k"))
    return parties.join(have, ["doc", "_k"], "left_anti").groupBy("doc", "_k").agg(F.min("name").alias("name")).select("doc", "name", F.lit(etype).alias("etype"), F.lit(1.0).alias("confidence"))


def record_relations(records: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """(doc, src, type, tgt, confidence, status, record, snippet) of records (doc, record, source, target, what): CALLED for CDR,
    SENT_MONEY_TO for TRANSACTION, between the mentions of these names (the last one of a name), each key once by least record."""
    last = found.groupBy("doc", F.lower("name").alias("k")).agg(F.max_by("mention_id", mention_order(F.col("mention_id"))).alias("id"))
    r = records.select("doc", "record", F.lower("source").alias("_s"), F.lower("target").alias("_t"), "what")
    r = r.join(last.select("doc", F.col("k").alias("_s"), F.col("id").alias("src")), ["doc", "_s"]).join(last.select("doc", F.col("k").alias("_t"), F.col("id").alias("tgt")), ["doc", "_t"])
    name = "SENT_MONEY_TO" if kind == "TRANSACTION" else "CALLED"
    one = r.filter("src <> tgt").groupBy("doc", "src", "tgt").agg(F.min(F.struct("record", "what")).alias("m"))
    return one.select("doc", "src", F.lit(name).alias("type"), "tgt", F.lit(0.98).alias("confidence"), F.lit("CONFIRMED").alias("status"), F.col("m.record").alias("record"), F.col("m.what").alias("snippet"))


def number_relations(text: DataFrame, structured: DataFrame) -> DataFrame:
    """Text relations before structured ones, each (doc, src, type, tgt) once, with rel_id numbered within the document."""
    a = text.select("doc", "src", "type", "tgt", "confidence", "status", F.lit(None).cast("string").alias("record"), "snippet", F.lit(0).alias("_p"), F.col("ordinal").alias("_o"))
    b = structured.select("doc", "src", "type", "tgt", "confidence", "status", F.col("record").cast("string").alias("record"), "snippet", F.lit(1).alias("_p"), F.lit(0).alias("_o"))
    both = a.unionByName(b)
    first = W.partitionBy("doc", "src", "type", "tgt").orderBy("_p", "_o")
    rows = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    i = F.row_number().over(W.partitionBy("doc").orderBy("_p", "_o", "src", "tgt"))
    label = F.when(i < 1000, F.lpad(i.cast("string"), 3, "0")).otherwise(i.cast("string"))
    return rows.withColumn("rel_id", F.concat(F.lit("rel_"), label)).drop("_n", "_p", "_o")
