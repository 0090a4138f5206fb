"""Evidence behind relationships: quality firewall, evidence groups, contradictions, signals, scores.

Relationships have the columns rel_id, src, tgt, type, confidence, status, doc, record, snippet; entities node, etype, name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum import schemas
from vinculum.functions.text import clamp, is_grounded
from vinculum.operators.extraction import mention_order


def status_rank(status: Column) -> Column:
    """0, 1, 2 by weight; -1 for unknown ones."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, schemas.STATUSES)), status), F.lit(0)).cast("int") - 1


def allowed_ends(kind: Column, source: Column, target: Column) -> Column:
    """Whether the endpoint matrix allows the types."""
    ok = F.lit(False)
    for name, pairs in schemas.ENDPOINTS.items():
        ok |= (kind == name) & F.concat_ws(">", source, target).isin(*[f"{a}>{b}" for a, b in pairs])
    return F.coalesce(ok, F.lit(False))


def firewall_reasons(rels: DataFrame, entities: DataFrame, texts: DataFrame | None = None, records: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """Every relationship with ``reason``: null if accepted, else the first rule that it fails.

    Rules in order: unknown_endpoint, self_loop, below_confidence_threshold, invalid_endpoint_types, unknown_record_provenance
    (``records`` with column record; not checked if None), ungrounded_evidence (``texts`` with doc, text; without record
    provenance the snippet must be grounded in its document; not checked if None). Repeated entity rows must be removed before.
    """
    ends = entities.select("node", "etype")
    r = rels.join(ends.select(F.col("node").alias("src"), F.col("etype").alias("_s")), "src", "left")
    r = r.join(ends.select(F.col("node").alias("tgt"), F.col("etype").alias("_t")), "tgt", "left")
    has_record = F.coalesce(F.col("record"), F.lit("")) != ""
    unknown = ungrounded = F.lit(False)
    if records is not None:
        r = r.join(records.select("record").distinct().withColumn("_known", F.lit(True)), "record", "left")
        unknown = has_record & F.col("_known").isNull()
    if texts is not None:
        r = r.join(texts.select("doc", F.col("text").alias("_text")), "doc", "left")
        ungrounded = ~has_record & ~is_grounded(F.col("snippet"), F.col("_text"))
    reason = (
        F.when(F.col("_s").isNull() | F.col("_t").isNull(), "unknown_endpoint")
        .when(F.col("src") == F.col("tgt"), "self_loop")
        .when(~(F.col("confidence") >= least), "below_confidence_threshold")
        .when(~allowed_ends(F.col("type"), F.col("_s"), F.col("_t")), "invalid_endpoint_types")
        .when(unknown, "unknown_record_provenance")
        .when(ungrounded, "ungrounded_evidence")
    )
    return r.select(*rels.columns, reason.alias("reason"))


def _best(order: Column) -> Column:
    return F.struct(status_rank(F.col("status")).alias("rank"), F.col("confidence"), order.alias("id"))


def accepted_edges(rels: DataFrame, include_predicted: bool = False) -> DataFrame:
    """The strongest relationship of each (src, type, tgt): by status, confidence, id; predicted ones only on demand."""
    rows = rels if include_predicted else rels.filter("status <> 'PREDICTED'")
    best = rows.groupBy("src", "type", "tgt").agg(F.max(_best(F.col("rel_id"))).alias("b"), F.count("*").alias("n"))
    return best.select("src", "type", "tgt", F.col("b.id").alias("rel_id"), F.col("b.confidence").alias("confidence"), F.element_at(F.array(*map(F.lit, ["UNKNOWN", *schemas.STATUSES])), F.col("b.rank") + 2).alias("status"), (F.col("n") - 1).alias("duplicates"))


def status_changes(rels: DataFrame) -> DataFrame:
    """(src, type, tgt, contradictions): how often, going through the ids, a relationship's status differs from the best so far.

    An ordered fold over each key's statuses; a key's array holds its occurrences only.
    """
    item = F.struct(F.col("rel_id").alias("id"), status_rank(F.col("status")).alias("rank"), F.col("confidence").alias("conf"))
    first = F.col("items")[0]
    kind = rels.schema["rel_id"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("n"), first["rank"].alias("rank"), first["conf"].alias("conf"), first["id"].cast(kind).alias("id"))

    def step(s, x):
        better = F.struct(x["rank"], x["conf"], x["id"]) > F.struct(s["rank"], s["conf"], s["id"])
        pick = lambda name: F.when(better, x[name]).otherwise(s[name])
        return F.struct((s["n"] + F.when(x["rank"] != s["rank"], 1).otherwise(0)).alias("n"), pick("rank").alias("rank"), pick("conf").alias("conf"), pick("id").alias("id"))

    rows = rels.groupBy("src", "type", "tgt").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("src", "type", "tgt", F.aggregate(F.slice("items", 2, 1_000_000_000), start, step)["n"].alias("contradictions"))


def source_key(record: Column, doc: Column, snippet: Column) -> Column:
    """What makes evidence independent: the record, or document and stripped snippet."""
    by_doc = F.concat(F.lit("document:"), F.coalesce(doc.cast("string"), F.lit("unknown")), F.lit(":"), F.regexp_replace(F.coalesce(snippet, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(F.coalesce(record, F.lit("")) != "", F.concat(F.lit("record:"), record)).otherwise(by_doc)


def assess(rels: DataFrame, texts: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(rel_id, strength, grounded, source_key): STRUCTURED by a known record, EXPLICIT by a grounded snippet, else UNGROUNDED."""
    r = rels.join(texts.select("doc", F.col("text").alias("_text")), "doc", "left")
    has_record = F.coalesce(F.col("record"), F.lit("")) != ""
    known = F.lit(True)
    if records is not None:
        r = r.join(records.select("record").distinct().withColumn("_known", F.lit(True)), "record", "left")
        known = F.col("_known").isNotNull()
    grounded = F.when(has_record, known).otherwise(is_grounded(F.col("snippet"), F.col("_text")))
    strength = F.when(~grounded, "UNGROUNDED").when(has_record, "STRUCTURED").otherwise("EXPLICIT")
    key = F.when(has_record, F.concat(F.lit("record:"), "record")).otherwise(F.concat_ws(":", F.lit("document"), F.coalesce(F.col("doc").cast("string"), F.lit("unknown")), F.col("rel_id").cast("string")))
    return r.select("rel_id", strength.alias("strength"), grounded.alias("grounded"), key.alias("source_key"))


def evidence_groups(rels: DataFrame) -> DataFrame:
    """One row per (src, type, tgt) over all occurrences: rel_ids sorted, n_sources, max_confidence, calibrated, strongest_status.

    calibrated = least of 0.99 and the maximum plus 0.03 for each further independent source, four decimals.
    """
    rows = rels.withColumn("_k", source_key(F.col("record"), F.col("doc"), F.col("snippet")))
    g = rows.groupBy("src", "type", "tgt").agg(
        F.array_sort(F.collect_list("rel_id")).alias("rel_ids"), F.count_distinct("_k").cast("bigint").alias("n_sources"),
        F.max("confidence").alias("max_confidence"), F.max(F.struct(_best(F.col("rel_id")).alias("o"), F.col("status").alias("s"))).alias("b"),
    )
    calibrated = F.least(F.lit(0.99), F.col("max_confidence") + F.lit(0.03) * (F.col("n_sources") - 1))
    return g.select("src", "type", "tgt", "rel_ids", "n_sources", "max_confidence", F.round(calibrated, 4).alias("calibrated"), F.col("b.s").alias("strongest_status"))


def contradictions(rels: DataFrame, entities: DataFrame, kind: str = "LOCATED_AT", etype: str = "LOCATION") -> DataFrame:
    """(node, target_a, target_b, rel_a, rel_b): a source's not predicted edges of one kind to different entities of one type, by rising id."""
    places = entities.filter(F.col("etype") == etype).select(F.col("node").alias("tgt"))
    at = rels.filter((F.col("type") == kind) & (F.col("status") != "PREDICTED")).join(places, "tgt", "left_semi").select("src", "tgt", "rel_id")
    a = at.select("src", F.col("tgt").alias("target_a"), F.col("rel_id").alias("rel_a"))
    b = at.select("src", F.col("tgt").alias("target_b"), F.col("rel_id").alias("rel_b"))
    return a.join(b, "src").filter("rel_a < rel_b and target_a <> target_b").withColumnRenamed("src", "node")


def case_signals(patterns: DataFrame, rels: DataFrame) -> DataFrame:
    """(case_id, score, level, reason_codes) from patterns (case_id, type, severity) and relationships (case_id, status)."""
    weight = F.when(F.col("severity") == "HIGH", 0.70).when(F.col("severity") == "MEDIUM", 0.45).when(F.col("severity") == "LOW", 0.20).otherwise(0.0)
    p = patterns.groupBy("case_id").agg(F.max(weight).alias("p_score"), F.collect_set("type").alias("p_types"))
    r = rels.groupBy("case_id").agg(F.count_if(F.col("status") == "CONFIRMED").alias("c"), F.count_if(F.col("status") == "INFERRED").alias("i"))
    rows = p.join(r, "case_id", "full_outer").na.fill(0, ["c", "i"]).na.fill(0.0, ["p_score"])
    many = F.col("c") >= 3
    network = ~many & (F.col("i") >= 2)
    score = F.greatest("p_score", F.when(many, F.least(F.lit(0.85), F.lit(0.55) + F.col("c") * F.lit(0.05))).when(network, 0.45).otherwise(0.0))
    extra = F.filter(F.array(F.when(many, "MULTI_RELATIONSHIP_SUPPORT"), F.when(network, "INFERRED_NETWORK_SIGNAL")), lambda x: x.isNotNull())
    codes = F.array_sort(F.concat(F.coalesce("p_types", F.array().cast("array<string>")), extra))
    rows = rows.select("case_id", F.round(score, 4).alias("score"), codes.alias("reason_codes"))
    level = F.when(F.col("score") >= 0.80, "CRITICAL").when(F.col("score") >= 0.60, "HIGH").when(F.col("score") >= 0.35, "MEDIUM").otherwise("LOW")
    return rows.withColumn("level", level)


def f1_scores(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of two sets with the same columns; repeated rows count once.

    Empty denominators give precision and recall 1 and, where both are 0, f1 0.
    """
    cols = expected.columns
    e, f = expected.distinct().withColumn("_e", F.lit(1)), found.select(*cols).distinct().withColumn("_f", F.lit(1))
    both = e.unionByName(f, allowMissingColumns=True).groupBy(*cols).agg(F.max("_e").alias("e"), F.max("_f").alias("f"))
    n = both.agg(
        F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn")
    )
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    total = F.col("precision") + F.col("recall")
    return n.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))


def integrate_candidates(entities: DataFrame, candidates: DataFrame, candidate_edges: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with unseen candidates added, and the candidate edges that stand: known ends by name, known type, grounded,
    always PREDICTED. Tables: entities and candidates doc, etype, name, confidence; edges doc, source, target, type, confidence,
    snippet; texts doc, text. Names are compared by lower case within a document; no self-loops."""
    key = F.lower(F.trim("name"))
    have = entities.select("doc", "etype", key.alias("_k")).distinct()
    new = candidates.filter(F.col("etype").isin(*schemas.ENTITY_TYPES) & (F.trim("name") != "")).withColumn("_k", key).join(have, ["doc", "etype", "_k"], "left_anti")
    new = new.withColumn("confidence", clamp(F.col("confidence"))).dropDuplicates(["doc", "etype", "_k"]).drop("_k")
    everyone = entities.select("doc", "etype", "name", "confidence").unionByName(new.select("doc", "etype", "name", "confidence"))
    ends = everyone.select("doc", key.alias("k")).distinct()
    e = candidate_edges.filter(F.col("type").isin(*schemas.RELATIONSHIP_TYPES)).withColumn("_s", F.lower(F.trim("source"))).withColumn("_t", F.lower(F.trim("target")))
    for side in ("_s", "_t"):
        e = e.join(ends.withColumnRenamed("k", side), ["doc", side], "left_semi")
    e = e.filter("_s <> _t").join(texts.select("doc", "text"), "doc").filter(is_grounded(F.col("snippet"), F.col("text")))
    return everyone, e.select("doc", "source", "target", "type", clamp(F.col("confidence")).alias("confidence"), "snippet", F.lit("PREDICTED").alias("status"))


def ocr_confidence(mentions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mentions (doc, mention_id, name, confidence) with the confidence weighed by the surest block (doc, text, confidence) that
    holds the name: confidence x (0.5 + 0.5 x block). Without such a block it stays."""
    b = blocks.select("doc", F.lower("text").alias("_t"), F.col("confidence").alias("_c"))
    sure = mentions.join(b, "doc").filter(F.col("_t").contains(F.lower("name"))).groupBy("doc", "mention_id").agg(F.max("_c").alias("block"))
    return mentions.join(sure, ["doc", "mention_id"], "left").withColumn("weighed", F.round(F.col("confidence") * F.coalesce(F.lit(0.5) + F.lit(0.5) * F.col("block"), F.lit(1.0)), 4))


def cap_by_ends(rels: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relationships (doc, src, tgt, confidence, ...) with ``capped``: never surer than the less certain of their ends, the mentions
    (doc, mention_id, confidence), four decimals; where an end is unknown the confidence stays."""
    ends = mentions.groupBy("doc", "mention_id").agg(F.max("confidence").alias("c"))
    r = rels
    for side in ("src", "tgt"):
        r = r.join(ends.select("doc", F.col("mention_id").alias(side), F.col("c").alias(f"_{side}")), ["doc", side], "left")
    both = F.col("_src").isNotNull() & F.col("_tgt").isNotNull()
    return r.withColumn("capped", F.when(both, F.round(F.least("confidence", "_src", "_tgt"), 4)).otherwise(F.col("confidence"))).drop("_src", "_tgt")


def merge_chunks(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of a document's chunks as one set: the surest of each (doc, type, lower-case name) and of each (doc, source, target,
    type). Blank names, unknown types and self-loops are left out; without evidence an edge gets a plain sentence.

    entities: doc, chunk, etype, name, confidence; edges: doc, chunk, source, target, type, confidence, snippet. Of equally sure
    ones that of the first chunk stays."""
    order = F.struct(F.col("confidence"), -F.col("chunk"))
    e = entities.withColumn("name", F.trim("name")).withColumn("etype", F.upper(F.trim("etype"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.9)))
    e = e.filter((F.col("name") != "") & F.col("etype").isin(*schemas.ENTITY_TYPES)).groupBy("doc", "etype", F.lower("name").alias("k"))
    e = e.agg(F.max_by(F.struct("name", "confidence"), order).alias("m")).select("doc", "etype", "m.name", "m.confidence")
    r = edges.withColumn("type", F.upper(F.trim("type"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.85)))
    for side in ("source", "target"):
        r = r.withColumn(side, F.trim(side))
    r = r.filter((F.col("source") != "") & (F.col("target") != "") & F.col("type").isin(*schemas.RELATIONSHIP_TYPES) & (F.lower("source") != F.lower("target")))
    r = r.groupBy("doc", F.lower("source").alias("s"), F.lower("target").alias("t"), "type").agg(F.max_by(F.struct("source", "target", "confidence", "snippet"), order).alias("m"))
    plain = F.concat(F.lit("Extracted connection between "), F.col("m.source"), F.lit(" and "), F.col("m.target"), F.lit("."))
    return e, r.select("doc", "m.source", "m.target", "type", "m.confidence", F.coalesce(F.nullif(F.trim("m.snippet"), F.lit("")), plain).alias("snippet"))


def macro_f1(scores: DataFrame) -> DataFrame:
    """(macro_f1): the mean of the f1 of several score rows, four decimals."""
    return scores.agg(F.round(F.avg("f1"), 4).alias("macro_f1"))


def candidate_telemetry(candidates: DataFrame, standing: DataFrame, keys: list[str]) -> DataFrame:
    """(doc, seen, accepted, rejected): how many candidate edges of each document stand."""
    c = candidates.groupBy("doc").agg(F.count("*").alias("seen"))
    s = standing.select("doc", *keys).distinct().groupBy("doc").agg(F.count("*").alias("accepted"))
    return c.join(s, "doc", "left").select("doc", "seen", F.coalesce("accepted", F.lit(0)).alias("accepted"), (F.col("seen") - F.coalesce("accepted", F.lit(0))).alias("rejected"))


def remap_ends(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges (doc, source, target, type) with source_id and target_id of the mentions (doc, mention_id, name) of these names by
    lower case, the last mention winning; edges without an end or with equal ends are left out."""
    last = mentions.groupBy("doc", F.lower("name").alias("k")).agg(F.max_by("mention_id", mention_order(F.col("mention_id"))).alias("id"))
    for side in ("source", "target"):
        edges = edges.withColumn("k", F.lower(side)).join(last.withColumnRenamed("id", f"{side}_id"), ["doc", "k"]).drop("k")
    return edges.filter("source_id <> target_id")
