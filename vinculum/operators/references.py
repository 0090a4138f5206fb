"""References to records that do not exist: keyed orphan state, kept incrementally.

The state holds the parents' life spans by key and every reference with its time. A new reference probes the parent index;
when parents arrive, change or are deleted, only references under the changed keys are probed again, so arriving parents
resolve waiting orphans and deletions reopen them. Snapshots count the open ones per table and period. ``replay`` feeds stored
tables to the state in batches by period.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.session import discard, materialise

REFERENCE = "table_name string, row_no bigint, ref_field string, key string, at timestamp"
PARENT = "key string, born timestamp, gone timestamp"


def uuid_key(value: Column) -> Column:
    """One form for all writings of a UUID: case, braces, urn prefix, hyphens and blanks don't count. Other texts are only
    trimmed and lowered. Null stays null."""
    low = F.lower(F.trim(value))
    bare = F.regexp_replace(F.regexp_replace(low, r"^urn:uuid:", ""), r"[\s{}()\[\]\-_]", "")
    return F.when(bare.rlike(r"^[0-9a-f]{32}$"), bare).otherwise(low)


@dataclass
class OrphanState:
    """``parents``: PARENT columns, the distinct stored rows. ``references``: REFERENCE columns and ``orphan`` BOOLEAN, one row per reference."""

    parents: DataFrame
    references: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> OrphanState:
        return OrphanState(spark.createDataFrame([], PARENT), spark.createDataFrame([], f"{REFERENCE}, orphan boolean"))

    def orphans(self) -> DataFrame:
        return self.references.filter("orphan").drop("orphan")

    def snapshot(self, period: str = "month") -> DataFrame:
        """Open and all references per table, field and period of the reference's time."""
        return (
            self.references.groupBy("table_name", "ref_field", F.date_trunc(period, "at").alias("period"))
            .agg(F.count_if("orphan").alias("orphans"), F.count("*").alias("refs"))
        )


def probe(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References with ``orphan``: whether no parent of the key lives at the reference's time.

    Two joins on the key with the life span as residual condition, no aggregation: nothing is gathered per key, and a key
    that holds a third of the references is split by the adaptive skew join.
    """
    r, p = references.alias("r"), parents.alias("p")
    living = (F.col("r.key") == F.col("p.key")) & (F.col("p.born") <= F.col("r.at")) & (F.col("p.gone").isNull() | (F.col("p.gone") > F.col("r.at")))
    missing = r.join(p, living, "left_anti").withColumn("orphan", F.lit(True))
    return missing.unionByName(r.join(p, living, "left_semi").withColumn("orphan", F.lit(False)))


def advance(state: OrphanState, references: DataFrame, parents: DataFrame, cut: bool = True) -> OrphanState:
    """The state after a batch of new references and of parent rows.

    ``parents`` (key, born, gone) states all rows that are stored of a key and birth: they take the place of those known, so a
    later deletion closes a span, and a row stored twice, once with and once without an end, stays open. References without key
    are ignored; repeated ones count once (equal table, row and field). A reference without time is an orphan, as no parent can
    be shown to live then.
    With ``cut`` both tables are written to the shared folder, so that lineage doesn't grow with the batches.
    """
    references = references.filter("key is not null").dropDuplicates(["table_name", "row_no", "ref_field"])
    changed = parents.filter("key is not null").select("key").distinct()
    stated = parents.filter("key is not null and born is not null").select("key", "born", "gone").distinct()
    spans = state.parents.join(stated.select("key", "born").distinct(), ["key", "born"], "left_anti").unionByName(stated)
    old = state.references
    seen = old.select("table_name", "row_no", "ref_field")
    fresh = references.join(seen, ["table_name", "row_no", "ref_field"], "left_anti").select("table_name", "row_no", "ref_field", "key", "at")
    again = old.join(changed, "key", "left_semi").drop("orphan")
    kept = old.join(changed, "key", "left_anti")
    if cut:
        spans = materialise(spans)
    found = kept.unionByName(probe(fresh.unionByName(again.select(*fresh.columns)), spans).select(*kept.columns))
    return OrphanState(spans, materialise(found) if cut else found)


def replay(references: DataFrame, parents: DataFrame, period: str = "year") -> OrphanState:
    """The state after stored tables have arrived batch by batch, in the order of the periods of their times.

    A reference arrives in the period of its time (without time in the first), a parent in that of its birth, still without an
    end that lies in a later period; when a period ends a stored row, all rows of its key and birth are stated again. The
    driver holds the list of periods only; each state's files are removed when the next one is written.
    """
    step = lambda c: F.date_trunc(period, c).cast("date")
    stored = parents.filter("key is not null and born is not null").select("key", "born", "gone").distinct()
    stored = stored.withColumn("ends", F.greatest(step("born"), step("gone"))).withColumn("ends", F.when(F.col("gone").isNotNull(), F.col("ends")))
    when = stored.select("key", "born", F.explode(F.array_compact(F.array(step("born"), F.col("ends")))).alias("step")).distinct()
    ended = F.col("ends") <= F.col("step")
    feed = stored.join(when, ["key", "born"]).select("step", "key", "born", F.when(ended, F.col("gone")).alias("gone"))
    feed = materialise(feed.repartitionByRange("step").sortWithinPartitions("step"))
    asked = references.select(F.coalesce(step("at"), F.lit("0001-01-01").cast("date")).alias("step"), "table_name", "row_no", "ref_field", "key", "at")
    asked = materialise(asked.filter("key is not null").repartitionByRange("step").sortWithinPartitions("step"))
    steps = sorted(r.step for r in feed.select("step").union(asked.select("step")).distinct().collect())
    state = OrphanState.empty(references.sparkSession)
    for k, at in enumerate(steps):
        now = F.col("step") == F.lit(at.isoformat()).cast("date")
        last, state = state, advance(state, asked.filter(now).drop("step"), feed.filter(now).drop("step"))
        if k:
            discard(last.parents)
            discard(last.references)
    return state


def first_state(references: DataFrame, parents: DataFrame) -> OrphanState:
    """The state after one batch that holds everything, without the lookups in an empty table.

    Parent rows count as they are stored, as in ``advance``: a reference is resolved if any row of its key lives at its time.
    """
    references = references.filter("key is not null")
    spans = parents.filter("key is not null and born is not null").select("key", "born", "gone").distinct()
    return OrphanState(spans, probe(references, spans))


def wrong_claims(claims: DataFrame, staged: DataFrame, orphans: DataFrame) -> DataFrame:
    """Rows of ``claims`` (row_no, document, claimed) whose non-null count differs from the document's staged rows with a null or
    orphan endpoint. ``staged``: row_no, document, has_null; ``orphans``: row_no, may repeat. Documents without such rows count 0.
    """
    broken = orphans.select("row_no").distinct().withColumn("_o", F.lit(1))
    counts = (
        staged.join(broken, "row_no", "left")
        .filter(F.col("has_null") | F.col("_o").isNotNull())
        .groupBy("document")
        .agg(F.count("*").alias("_n"))
    )
    return (
        claims.filter("claimed is not null")
        .join(counts, "document", "left")
        .filter(F.col("claimed") != F.coalesce(F.col("_n"), F.lit(0)))
        .select("row_no")
    )
