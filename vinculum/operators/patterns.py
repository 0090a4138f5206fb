"""Temporal patterns in transfers and sightings: three-party cycles, rapid chains, meetings in place and time; leads from them.

Each join has an equality on the node or place and on a time bucket as wide as the bound, so a busy node is split by time and
only neighbouring buckets meet; the exact bound is the residual condition.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinculum.functions.text import match_location
from vinculum.schemas import PATTERN_TYPES

HOUR = 3_600_000_000
DAY = 24 * HOUR
TRANSFER = ["record_id", "sender", "recipient", "ts"]


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp of either kind, wall time as it stands."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _bare(c: Column, sign: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), r"(?U)\W", sign)


def record_key(record: Column, kind: str, first: Column, second: Column, time: Column, sign: str = "_") -> Column:
    """The stripped record id or, where it is null or blank, one made of the parties and the time as written.

    ``kind`` is tx or cdr; signs that are no letters or digits become ``sign`` in the parties' names (the empty text for points in
    place and time) and fall out of the time.
    """
    own = F.regexp_replace(record.cast("string"), r"(?U)^\s+|\s+$", "")
    made = F.concat_ws("_", F.lit(kind), _bare(first, sign), _bare(second, sign), _bare(time, ""))
    return F.coalesce(F.nullif(own, F.lit("")), made)


def event_key(record: Column, entity: Column, place: Column, time: Column) -> Column:
    """The record id of an event that is neither call nor transfer or, where it is null or blank, one of entity, normal place and time."""
    own = F.regexp_replace(record.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.nullif(own, F.lit("")), F.concat_ws("_", F.lit("ev"), _bare(entity, "_"), place, _bare(time, "")))


def _written(ts: Column) -> Column:
    """A timestamp in ISO form, with its fraction if it has one."""
    whole = F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.pmod(micros(ts), F.lit(1_000_000)) == 0, whole).otherwise(F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def prepare(transfers: DataFrame, group: str | None = None) -> DataFrame:
    """Distinct transfers with both ends and a time; ``us`` is the time in microseconds, ``g`` the group (null without one).

    A transfer without record id gets that of ``record_key``, from the column time_text or, without it, the time in ISO form; no row is lost for want of an id.
    """
    rows = transfers.filter("sender is not null and recipient is not null and ts is not null and sender <> recipient")
    blank = F.col("record_id").isNull() | (F.trim(F.col("record_id").cast("string")) == "")
    text = F.col("time_text") if "time_text" in transfers.columns else _written(F.col("ts"))
    kind = transfers.schema["record_id"].dataType.simpleString()
    made = record_key(F.col("record_id"), "tx", F.col("sender"), F.col("recipient"), text)
    key = made if kind == "string" else F.when(blank, F.xxhash64(made)).otherwise(F.col("record_id"))
    g = F.col(group) if group else F.lit(None).cast("string")
    return rows.select(key.alias("record_id"), "sender", "recipient", micros(F.col("ts")).alias("us"), g.alias("g")).distinct()


def rapid_chains(transfers: DataFrame, hours: float = 48, group: str | None = None) -> DataFrame:
    """(a, b, c, first_id, second_id, first_us, second_us): money passed on within the bound, A, B, C and records distinct; with
    ``group`` within one group, which comes first."""
    bound = int(hours * HOUR)
    t = prepare(transfers, group)
    width = max(bound, 1)
    slot = F.floor(F.col("us") / width).cast("bigint")
    one = t.select("g", F.col("sender").alias("a"), F.col("recipient").alias("b"), F.col("record_id").alias("first_id"), F.col("us").alias("first_us"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    two = t.select(F.col("g").alias("g2"), F.col("sender").alias("b"), F.col("recipient").alias("c"), F.col("record_id").alias("second_id"), F.col("us").alias("second_us"), slot.alias("slot"))
    hop = one.join(two, ["b", "slot"]).filter(
        F.col("g").eqNullSafe(F.col("g2")) & (F.col("second_us") >= F.col("first_us")) & (F.col("second_us") - F.col("first_us") <= bound) & (F.col("a") != F.col("c")) & (F.col("first_id") != F.col("second_id"))
    )
    return hop.select(*_group(group), "a", "b", "c", "first_id", "second_id", "first_us", "second_us").distinct()


def _group(group: str | None) -> list[Column]:
    return [F.col("g").alias(group)] if group else []


def cycles(transfers: DataFrame, days: float = 30, group: str | None = None) -> DataFrame:
    """(a, b, c, evidence_ids, span_us): A to B to C to A by three records within the bound, in any order of time; with ``group``
    within one group, which comes first.

    The rotation begins at the smallest name, so each cycle is met once; evidence ids are sorted.
    """
    bound = int(days * DAY)
    t = prepare(transfers, group)
    slot = lambda c: F.floor(F.col(c) / bound).cast("bigint")
    ab = t.filter("sender < recipient").select("g", F.col("sender").alias("a"), F.col("recipient").alias("b"), F.col("record_id").alias("r1"), F.col("us").alias("u1"))
    bc = t.select(F.col("g").alias("g2"), F.col("sender").alias("b"), F.col("recipient").alias("c"), F.col("record_id").alias("r2"), F.col("us").alias("u2"))
    ca = t.filter("sender > recipient").select(F.col("g").alias("g3"), F.col("sender").alias("c"), F.col("recipient").alias("a"), F.col("record_id").alias("r3"), F.col("us").alias("u3"), slot("us").alias("slot"))
    ab = ab.withColumn("slot", F.explode(F.array(slot("u1") - 1, slot("u1"), slot("u1") + 1)))
    bc = bc.withColumn("slot", slot("u2"))
    two = ab.join(bc, ["b", "slot"]).filter(F.col("g").eqNullSafe(F.col("g2")) & (F.abs(F.col("u1") - F.col("u2")) <= bound) & (F.col("a") < F.col("c")) & (F.col("r1") != F.col("r2"))).drop("slot", "g2")
    low = slot("u1")
    two = two.withColumn("slot", F.explode(F.array(low - 1, low, low + 1)))
    three = two.join(ca, ["c", "a", "slot"]).filter(F.col("g").eqNullSafe(F.col("g3")) & (F.col("r3") != F.col("r1")) & (F.col("r3") != F.col("r2")))
    span = F.greatest("u1", "u2", "u3") - F.least("u1", "u2", "u3")
    return three.withColumn("span_us", span).filter(F.col("span_us") <= bound).select(*_group(group), "a", "b", "c", F.array_sort(F.array("r1", "r2", "r3")).alias("evidence_ids"), "span_us").distinct()


def first_cycle_per_set(transfers: DataFrame, days: int = 30) -> DataFrame:
    """(entities, evidence_ids, first_us, span_us) as the older detector keeps cycles: the three records follow each other in time, the
    span counts in whole days (so up to ``days`` days and 23:59:59.999999), and of each set of entities the earliest cycle
    stays; ties go to the smaller ids. Evidence ids are in the order of the transfers."""
    bound = (days + 1) * DAY - 1
    t = prepare(transfers)
    slot = lambda c: F.floor(F.col(c) / bound).cast("bigint")
    x = t.select(F.col("sender").alias("a"), F.col("recipient").alias("b"), F.col("record_id").alias("r1"), F.col("us").alias("u1"), F.explode(F.array(slot("us"), slot("us") + 1)).alias("slot"))
    y = t.select(F.col("sender").alias("b"), F.col("recipient").alias("c"), F.col("record_id").alias("r2"), F.col("us").alias("u2"), slot("us").alias("slot"))
    z = t.select(F.col("sender").alias("c"), F.col("recipient").alias("a"), F.col("record_id").alias("r3"), F.col("us").alias("u3"), slot("us").alias("slot"))
    two = x.join(y, ["b", "slot"]).filter("u1 <= u2 and r1 <> r2").filter(F.col("u2") - F.col("u1") <= bound)
    two = two.withColumn("slot", F.explode(F.array(slot("u1"), slot("u1") + 1)))
    three = two.join(z, ["c", "a", "slot"]).filter("u2 <= u3 and r3 <> r1 and r3 <> r2").filter(F.col("u3") - F.col("u1") <= bound)
    best = F.min(F.struct("u1", "u2", "u3", "r1", "r2", "r3")).alias("m")
    rows = three.groupBy(F.array_sort(F.array_distinct(F.array("a", "b", "c"))).alias("entities")).agg(best)
    return rows.select("entities", F.array("m.r1", "m.r2", "m.r3").alias("evidence_ids"), F.col("m.u1").alias("first_us"), (F.col("m.u3") - F.col("m.u1")).alias("span_us"))


def meetings(points: DataFrame, hours: float = 2, group: str | None = None) -> DataFrame:
    """(entity_a, entity_b, place, id_a, id_b, gap_us) for points (entity, location, record_id, ts): two entities at one place
    within the bound; with ``group`` within one group, which comes first. Places are compared without case and punctuation,
    entities without case; null parts match nothing, but a point without record id gets that of ``event_key``."""
    bound = int(hours * HOUR)
    g = F.col(group) if group else F.lit(None).cast("string")
    place = match_location(F.col("location").cast("string"))
    kind = points.schema["record_id"].dataType.simpleString()
    key = event_key(F.col("record_id"), F.col("entity"), place, _written(F.col("ts")))
    key = key if kind == "string" else F.coalesce("record_id", F.xxhash64(key).cast(kind))
    p = points.select(g.alias("g"), F.col("entity").cast("string").alias("e"), place.alias("place"), key.alias("id"), micros(F.col("ts")).alias("us"))
    p = p.filter("e is not null and place <> '' and us is not null").distinct()
    slot = F.floor(F.col("us") / bound).cast("bigint")
    x = p.select("g", F.col("e").alias("ex"), "place", F.col("id").alias("ix"), F.col("us").alias("ux"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    y = p.select(F.col("g").alias("g2"), F.col("e").alias("ey"), "place", F.col("id").alias("iy"), F.col("us").alias("uy"), slot.alias("slot"))
    near = x.join(y, ["place", "slot"]).filter(F.col("g").eqNullSafe(F.col("g2")) & (F.col("ix") < F.col("iy")) & (F.lower("ex") != F.lower("ey")) & (F.abs(F.col("ux") - F.col("uy")) <= bound))
    first = F.col("ex") < F.col("ey")
    return near.select(
        *_group(group), F.when(first, F.col("ex")).otherwise(F.col("ey")).alias("entity_a"), F.when(first, F.col("ey")).otherwise(F.col("ex")).alias("entity_b"), "place",
        F.col("ix").alias("id_a"), F.col("iy").alias("id_b"), F.abs(F.col("ux") - F.col("uy")).alias("gap_us"),
    ).distinct()


def meeting_counts(points: DataFrame, hours: float = 2) -> DataFrame:
    """(place, meetings, entities) for points as in ``meetings``: how many entities met another one at a place within the bound, and
    how many of their points had another entity's point within it. Neighbours in time decide, so no pair is formed and a place
    that holds a large share of the points costs a sort, split by day with an edge of the bound's width on either side."""
    bound, day = int(hours * HOUR), DAY
    p = points.select(F.lower(F.col("entity").cast("string")).alias("e"), match_location(F.col("location").cast("string")).alias("place"), micros(F.col("ts")).alias("us"))
    p = p.filter("e is not null and place <> '' and us is not null").distinct()
    home = F.floor(F.col("us") / day).cast("bigint")
    spread = F.array_distinct(F.array(F.floor((F.col("us") - bound) / day).cast("bigint"), home, F.floor((F.col("us") + bound) / day).cast("bigint")))
    p = p.withColumn("home", home).withColumn("day", F.explode(spread))
    order = W.partitionBy("place", "day").orderBy("us", "e")
    # the last point before and the first after of another entity: the neighbour, or the one beyond the run of the own entity
    run = p.withColumn("new", F.when(F.lag("e").over(order) == F.col("e"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    edge = run.groupBy("place", "day", "run").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    runs = W.partitionBy("place", "day").orderBy("run")
    edge = edge.withColumn("before", F.lag("hi").over(runs)).withColumn("after", F.lead("lo").over(runs)).select("place", "day", "run", "before", "after")
    met = run.filter("day = home").join(edge, ["place", "day", "run"]).filter((F.col("us") - F.col("before") <= bound) | (F.col("after") - F.col("us") <= bound))
    return met.groupBy("place").agg(F.count("*").alias("meetings"), F.count_distinct("e").alias("entities"))


def first_chain_per_triple(transfers: DataFrame, hours: float = 48) -> DataFrame:
    """The earliest chain of each A, B, C, as the older detector keeps it; ties go to the smaller ids."""
    best = F.min(F.struct("first_us", "second_us", "first_id", "second_id")).alias("m")
    return rapid_chains(transfers, hours).groupBy("a", "b", "c").agg(best).select("a", "b", "c", "m.first_id", "m.second_id")


#: Lead type, priority, rank and score of each pattern.
LEADS = {
    "CIRCULAR_TRANSACTION": ("CIRCULAR_TRANSACTION_LEAD", "HIGH", 0, 0.90),
    "RAPID_TRANSFER_CHAIN": ("RAPID_TRANSFER_LEAD", "HIGH", 0, 0.85),
    "LOCATION_TIME_OVERLAP": ("LOCATION_OVERLAP_LEAD", "MEDIUM", 1, 0.60),
}


@F.pandas_udf(T.StringType())
def _decimals(value: pd.Series, places: pd.Series) -> pd.Series:
    """Numbers with so many decimals, halves of the exact binary value to even."""
    return pd.Series([None if v is None or v != v else f"{v:.{int(k)}f}" for v, k in zip(value, places)], dtype=object)


def as_patterns(cycle: DataFrame, chain: DataFrame, meeting: DataFrame, group: str | None = None, explain: bool = False) -> DataFrame:
    """(type, severity, status, entities, evidence_ids) of the three detectors, ids as text; chains keep their order of ids. With
    ``group`` its column comes first, with ``explain`` the column explanation last."""
    text = lambda *c: F.array(*[F.col(x).cast("string") for x in c])
    g = [group] if group else []
    arrow = lambda *c: F.concat_ws(" → ", *[F.col(x).cast("string") for x in c])
    days, hours, minutes = F.col("span_us") / DAY, (F.col("second_us") - F.col("first_us")) / HOUR, F.col("gap_us") / 60_000_000
    told = [
        F.concat(F.lit("Circular fund transfer detected: "), arrow("a", "b", "c", "a"), F.lit(" completed in "), _decimals(days, F.lit(1)), F.lit(" days (max allowed: 30 days).")),
        F.concat(F.lit("Rapid fund transfer chain detected: "), arrow("a", "b", "c"), F.lit(" completed in "), _decimals(hours, F.lit(1)), F.lit(" hours (max allowed: 48 hours).")),
        F.concat(F.lit("Location-time overlap detected at "), F.col("place"), F.lit(" between "), F.col("entity_a"), F.lit(" and "), F.col("entity_b"), F.lit(" within "), _decimals(minutes, F.lit(0)), F.lit(" minutes (max allowed: 2 hours).")),
    ]
    told = [t.alias("explanation") if explain else F.lit(None).cast("string").alias("explanation") for t in told]
    row = lambda df, k, severity, entities, evidence: df.select(*g, F.lit(PATTERN_TYPES[k]).alias("type"), F.lit(severity).alias("severity"), entities.alias("entities"), evidence.alias("evidence_ids"), told[k])
    one = row(cycle, 0, "HIGH", text("a", "b", "c"), F.col("evidence_ids").cast("array<string>"))
    two = row(chain, 1, "HIGH", text("a", "b", "c"), text("first_id", "second_id"))
    three = row(meeting, 2, "MEDIUM", text("entity_a", "entity_b"), F.array_sort(text("id_a", "id_b")))
    both = one.union(two).union(three).withColumn("status", F.lit("INFERRED"))
    return both.select(*g, "type", "severity", "status", "entities", "evidence_ids", *(["explanation"] if explain else []))


def hash_id(case: Column, kind: Column, entities: Column, evidence: Column, suffix: str = "") -> Column:
    """First 32 hex digits of the SHA-256 of case, type, sorted entities and sorted evidence."""
    parts = F.concat_ws("|", case, F.concat(kind, F.lit(suffix)), F.array_join(F.array_sort(entities), ","), F.array_join(F.array_sort(evidence), ","))
    return F.left(F.sha2(parts, 256), F.lit(32))


def leads(patterns: DataFrame, group: str | None = None) -> DataFrame:
    """(lead_type, priority, priority_rank, priority_score, status, entities, evidence_ids), one per type and sets of entities
    and evidence; the order is by rank, type, entities, evidence. With ``group`` its column comes first and parts them."""
    pick = lambda k: F.create_map(*[F.lit(x) for t, v in LEADS.items() for x in (t, v[k])])
    rows = patterns.filter(F.col("type").isin(*LEADS)).select(
        *([group] if group else []),
        pick(0)[F.col("type")].alias("lead_type"), pick(1)[F.col("type")].alias("priority"), pick(2)[F.col("type")].alias("priority_rank"), pick(3)[F.col("type")].alias("priority_score"),
        F.lit("REVIEW_REQUIRED").alias("status"), F.array_sort("entities").alias("entities"), F.array_sort("evidence_ids").alias("evidence_ids"),
    )
    return rows.distinct()


def lead_texts(patterns: DataFrame) -> DataFrame:
    """Patterns (type, entities, evidence_ids, ...) with ``title`` and ``lead_explanation`` of their leads."""
    nodes, ids = F.array_join("entities", " → "), F.array_join("evidence_ids", ", ")
    e1, e2 = F.coalesce(F.try_element_at("entities", F.lit(1)), F.lit("Entity A")), F.coalesce(F.try_element_at("entities", F.lit(2)), F.lit("Entity B"))
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    kind = F.col("type")
    title = (
        F.when(kind == PATTERN_TYPES[0], cat("Investigate circular transaction cycle (", nodes, ")"))
        .when(kind == PATTERN_TYPES[1], cat("Investigate rapid fund transfer chain (", nodes, ")"))
        .when(kind == PATTERN_TYPES[2], cat("Review spatio-temporal co-presence of ", e1, " and ", e2))
    )
    why = (
        F.when(kind == PATTERN_TYPES[0], cat("Review the detected fund routing cycle (", nodes, ") and supporting transaction records (", ids, ") for potential layered routing."))
        .when(kind == PATTERN_TYPES[1], cat("Review the rapid consecutive fund transfer chain (", nodes, ") completed within 48 hours across linked intermediary accounts (", ids, ")."))
        .when(kind == PATTERN_TYPES[2], cat("Review the temporal and geographic proximity records (", ids, ") associating ", e1, " and ", e2, " at the same location within 2 hours."))
    )
    return patterns.withColumn("title", title).withColumn("lead_explanation", why)


def numbered(df: DataFrame, prefix: str, order: list, by: list[str], name: str = "staging_id") -> DataFrame:
    """Rows with a running id within ``by``: the prefix and at least three digits."""
    i = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_i", i).withColumn(name, F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("_i").cast("string"), F.greatest(F.lit(3), F.length(F.col("_i").cast("string"))), F.lit("0")))).drop("_i")
