"""Queries of the general data problems (references, instants, sums) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.operators import instants, quantities, references
from vinculum.session import table


def _entity_parents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities")
    return e.select(references.uuid_key(F.col("id")).alias("key"), F.col("created_at").alias("born"), F.col("deleted_at").alias("gone"))


def _staged_references(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relationships_staging")
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in ("source_entity_id", "target_entity_id")]))
    return r.select("rel_no", "extracted_at", ends.alias("e")).select(
        F.lit("relationships_staging").alias("table_name"), F.col("rel_no").alias("row_no"), F.col("e.f").alias("ref_field"),
        references.uuid_key(F.col("e.v")).alias("key"), F.col("extracted_at").alias("at"),
    )


def _wrong_claims(spark: SparkSession, d: str, orphans: DataFrame) -> DataFrame:
    """(row_no) of the processing runs whose count of unresolved relationships isn't so."""
    r = table(spark, d, "relationships_staging")
    staged = r.select(
        F.col("rel_no").alias("row_no"), F.col("source_document_id").alias("document"),
        (F.col("source_entity_id").isNull() | F.col("target_entity_id").isNull()).alias("has_null"),
    )
    claims = table(spark, d, "process_results").select(
        F.col("proc_no").alias("row_no"), F.col("document_id").alias("document"), F.col("relationships_unresolved").alias("claimed")
    )
    return references.wrong_claims(claims, staged, orphans)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan endpoints, and counts of unresolved relationships that aren't so; the state advances by years."""
    state = references.replay(_staged_references(spark, d), _entity_parents(spark, d))
    orphans = state.orphans().select("table_name", "row_no", "ref_field")
    wrong = _wrong_claims(spark, d, orphans).select(
        F.lit("process_results").alias("table_name"), "row_no", F.lit("relationships_unresolved").alias("ref_field")
    )
    return orphans.unionByName(wrong).distinct()


def p2_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Open and all references per table, field and month; of the processing runs the wrong counts and all counts."""
    state = references.replay(_staged_references(spark, d), _entity_parents(spark, d))
    month = lambda c: F.date_format(c, "yyyy-MM").alias("period")
    rows = state.snapshot("month").withColumn("period", month(F.col("period")))
    wrong = _wrong_claims(spark, d, state.orphans().select("row_no")).withColumn("_w", F.lit(1))
    runs = table(spark, d, "process_results").filter("relationships_unresolved is not null").select(F.col("proc_no").alias("row_no"), month(F.col("processed_at")))
    runs = runs.join(wrong, "row_no", "left").groupBy("period").agg(F.count("_w").alias("orphans"), F.count("*").alias("refs"))
    runs = runs.select(F.lit("process_results").alias("table_name"), F.lit("relationships_unresolved").alias("ref_field"), "period", "orphans", "refs")
    return rows.unionByName(runs)


def _instants(spark: SparkSession, d: str, name: str, text: str, row: str) -> DataFrame:
    feeds = F.broadcast(table(spark, d, "feeds"))  # fixed at ten rows
    t = table(spark, d, name).select(row, "record_id", "feed", text).join(feeds, "feed", "left")
    return instants.normalise_instants(t, text, "tz_name", "date_order")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Reports of one record whose time texts differ but denote the same instant."""
    parts = []
    for src, name, text, row in (("calls", "calls", "call_time", "call_no"), ("transfers", "transfers", "transaction_time", "transfer_no")):
        pairs = instants.same_instant_pairs(_instants(spark, d, name, text, row), "record_id", text, row)
        parts.append(pairs.select(F.lit(src).alias("src"), "row_a", "row_b"))
    return parts[0].unionByName(parts[1]).distinct()


def p5_status(spark: SparkSession, d: str) -> DataFrame:
    """Rows per table, feed and outcome of the normalisation."""
    parts = []
    for name, text, row in (("calls", "call_time", "call_no"), ("transfers", "transaction_time", "transfer_no")):
        n = _instants(spark, d, name, text, row)
        parts.append(n.groupBy(F.lit(name).alias("src"), "feed", "instant_status").agg(F.count("*").alias("n")))
    return parts[0].unionByName(parts[1])


def _sums(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transfers").select("transfer_no", "record_id", "amount", "amount_text", "currency")
    return quantities.normalise_amounts(t, table(spark, d, "money_units"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Reports of one record that write the same sum differently."""
    pairs = quantities.same_sum_pairs(_sums(spark, d), "record_id", "transfer_no", ["amount", "amount_text", "currency"])
    return pairs.select(F.col("row_a").alias("transfer_a"), F.col("row_b").alias("transfer_b")).distinct()


def p7_sources(spark: SparkSession, d: str) -> DataFrame:
    """Rows by where their sum came from, with the number flagged as of uncertain unit."""
    return _sums(spark, d).groupBy("amount_source", "unit_stated").agg(
        F.count("*").alias("n"), F.count_if("unit_uncertain").alias("n_uncertain")
    )


QUERIES = {
    "p2_found": p2_found, "p2_snapshot": p2_snapshot, "p5_found": p5_found, "p5_status": p5_status,
    "p7_found": p7_found, "p7_sources": p7_sources,
}

_KEY = "replace(replace(replace(replace(replace(lower(trim({c})),'urn:uuid:',''),'-',''),'{{',''),'}}',''),' ','')"
_ORPHANS = (
    "WITH e AS (SELECT " + _KEY.format(c="id") + " AS k, created_at, deleted_at FROM entities), refs AS (SELECT rel_no, f, k, extracted_at FROM ("
    "SELECT rel_no, 'source_entity_id' AS f, " + _KEY.format(c="source_entity_id") + " AS k, extracted_at FROM relationships_staging UNION ALL "
    "SELECT rel_no, 'target_entity_id', " + _KEY.format(c="target_entity_id") + ", extracted_at FROM relationships_staging) WHERE k IS NOT NULL), "
    "o AS (SELECT rel_no, f, extracted_at, NOT EXISTS (SELECT 1 FROM e WHERE e.k = refs.k AND created_at <= extracted_at AND "
    "(deleted_at IS NULL OR deleted_at > extracted_at)) AS orphan FROM refs)"
)
ORACLE = {
    "p2_found": _ORPHANS
    + ", n AS (SELECT source_document_id AS doc, count(*) AS n FROM relationships_staging r WHERE source_entity_id IS NULL OR target_entity_id IS NULL "
    "OR rel_no IN (SELECT rel_no FROM o WHERE orphan) GROUP BY 1) "
    "SELECT DISTINCT 'relationships_staging' AS table_name, rel_no AS row_no, f AS ref_field FROM o WHERE orphan UNION ALL "
    "SELECT 'process_results', proc_no, 'relationships_unresolved' FROM process_results LEFT JOIN n ON n.doc = document_id "
    "WHERE relationships_unresolved <> coalesce(n.n, 0)",
    "p2_snapshot": _ORPHANS
    + " SELECT 'relationships_staging' AS table_name, f AS ref_field, strftime(extracted_at, '%Y-%m') AS period, "
    "count(*) FILTER (WHERE orphan) AS orphans, count(*) AS refs FROM o GROUP BY 1, 2, 3 UNION ALL "
    "SELECT 'process_results', 'relationships_unresolved', strftime(processed_at, '%Y-%m'), count(*) FILTER (WHERE relationships_unresolved <> coalesce(n.n, 0)), count(*) "
    "FROM process_results LEFT JOIN (SELECT source_document_id AS doc, count(*) AS n FROM relationships_staging r WHERE source_entity_id IS NULL OR target_entity_id IS NULL "
    "OR rel_no IN (SELECT rel_no FROM o WHERE orphan) GROUP BY 1) n ON n.doc = document_id WHERE relationships_unresolved IS NOT NULL GROUP BY 3",
}
