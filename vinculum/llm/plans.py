"""Queries of the text and linkage problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm import addresses, leaks, names, pieces, privacy, scans, tokens
from vinculum.session import table


def _pairs(members: DataFrame, group: list[str], name: str, a: str, b: str) -> DataFrame:
    """All pairs a < b of different values of ``name`` within each group; the stated form of the result."""
    left, right = members.select(*group, F.col(name).alias(a)), members.select(*group, F.col(name).alias(b))
    return left.join(right, group).filter(F.col(a) < F.col(b))


def _named(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").filter(F.col("entity_type").isin("PERSON", "ORGANIZATION")).select("id", "case_id", "canonical_name")
    listed = table(spark, d, "entity_attributes").select(F.col("entity_id").alias("id"), F.explode("aliases").alias("name"))
    owners = e.select("case_id", F.col("canonical_name").alias("name"), F.col("id").alias("owner")).unionByName(
        e.select("id", "case_id").distinct().join(listed, "id").select("case_id", "name", F.col("id").alias("owner"))
    )
    t = table(spark, d, "transfers")
    typed = t.select("case_id", F.explode(F.array("sender", "recipient")).alias("name"))
    return names.link_names(typed, owners)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Different strings of one case that name the same person or organisation."""
    return _pairs(_named(spark, d), ["case_id", "entity"], "name", "name_a", "name_b").select("case_id", "name_a", "name_b").distinct()


def _places(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls").select(F.col("location").alias("loc"))
    listed = table(spark, d, "entity_attributes").select(F.explode("locations").alias("loc"))
    return addresses.link_addresses(calls.unionByName(listed))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Different strings that denote one address."""
    return _pairs(_places(spark, d), ["place"], "loc", "loc_a", "loc_b").select("loc_a", "loc_b").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned pages and their defects."""
    return scans.find_defects(table(spark, d, "ocr_blocks")).distinct()


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The scans as continuous paragraphs."""
    return scans.paragraphs(table(spark, d, "ocr_blocks"), table(spark, d, "ocr_results"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct personal items of every document and evidence snippet."""
    docs = privacy.find_personal(table(spark, d, "documents"), "doc_id", "text")
    snippets = table(spark, d, "entity_attributes").select("entity_id", F.explode("evidence_snippets").alias("text"))
    found = privacy.find_personal(snippets, "entity_id", "text")
    row = lambda df, src, key: df.select(F.lit(src).alias("src"), F.col(key).cast("string").alias("row_key"), "pii_kind", "found_text")
    # items of one document are distinct already; an entity has several snippets
    return row(docs, "documents", "doc_id").unionByName(row(found, "entity_attributes", "entity_id").distinct())


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text and every evidence snippet with typed placeholders.

    (doc_id, entity_id, snippet_no, redacted): a row of documents has doc_id only, a snippet its entity and its place from 0.
    """
    docs = privacy.redact(table(spark, d, "documents"), "doc_id", "text")
    snippets = table(spark, d, "entity_attributes").select("entity_id", F.posexplode("evidence_snippets").alias("snippet_no", "text"))
    found = privacy.redact(snippets, ["entity_id", "snippet_no"], "text")
    return docs.unionByName(found, allowMissingColumns=True).select("doc_id", "entity_id", "snippet_no", "redacted")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, put together again from its ids."""
    return tokens.decode_corpus(p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are cut."""
    cut = pieces.split_oversized(table(spark, d, "documents"), with_text=False, with_tokens=False)
    return cut.filter("n_pieces > 1 and piece_no = 0").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the documents that are cut, in order."""
    return pieces.split_oversized(table(spark, d, "documents")).filter("n_pieces > 1")


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_paragraphs": p4_paragraphs,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p10_found": p10_found, "p10_pieces": p10_pieces,
}

ORACLE = {
    # texts without ids have the empty text
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
