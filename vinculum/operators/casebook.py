"""Case views: access, lists, profiles, connections, projected graph tables, stored insights, references resolved in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.operators.graph import both_ways
from vinculum.operators.integrity import upsert


def accessible_cases(cases: DataFrame, members: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """Cases (case_id, created_at, ...) that a user is a member of (case_id, user_id), all for an admin; newest first."""
    mine = cases if admin else cases.join(members.filter(F.col("user_id") == user).select("case_id"), "case_id", "left_semi")
    return mine.orderBy(F.col("created_at").desc(), F.col("case_id").desc())


def case_meta(cases: DataFrame) -> DataFrame:
    """Cases (case_id, title, case_number, status, description) with category, priority, sub_status, location, narrative, read
    from a description that is a JSON object; other descriptions are the narrative. Closed cases are SOLVED."""
    raw = F.trim(F.coalesce("description", F.lit("")))
    parsed = F.when(raw.startswith("{") & raw.endswith("}"), F.from_json(raw, "category string, priority string, subStatus string, location string, narrative string", {"mode": "PERMISSIVE"}))
    valid = F.when(raw.startswith("{") & raw.endswith("}"), F.try_parse_json(raw).isNotNull()).otherwise(False)
    field = lambda c, default: F.coalesce(F.nullif(F.when(valid, parsed[c]), F.lit("")), default)
    sub = F.when(F.col("status") == "CLOSED", "SOLVED").otherwise(field("subStatus", F.lit("ACTIVE")))
    return cases.select(
        "*", field("category", F.lit("OTHER")).alias("category"), field("priority", F.lit("MEDIUM")).alias("priority"), sub.alias("sub_status"),
        F.when(valid, parsed["location"]).alias("location"), F.when(valid, F.coalesce(parsed["narrative"], F.lit(""))).otherwise(raw).alias("narrative"),
    )


def search_cases(meta: DataFrame, term: str = "", status: str = "ALL", category: str = "ALL", priority: str = "ALL", top: int | None = None) -> DataFrame:
    """Rows of ``case_meta`` that pass the filters and hold the term; ``top`` gives the first suggestions by case_id."""
    ok = F.lit(True)
    if status in ("ACTIVE", "ON_HOLD"):
        ok &= (F.col("status") == "OPEN") & (F.col("sub_status") == status)
    elif status == "SOLVED":
        ok &= (F.col("status") == "CLOSED") | (F.col("sub_status") == "SOLVED")
    ok &= (F.col("category") == category) if category != "ALL" else F.lit(True)
    ok &= (F.col("priority") == priority) if priority != "ALL" else F.lit(True)
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "case_number", "location", "narrative", "category")]))
    found = meta.filter(ok & hay.contains(term.strip().lower()))
    return found if top is None else found.orderBy("case_id").limit(top)


def connections(edges: DataFrame, entities: DataFrame, cap: int | None = None) -> DataFrame:
    """(node, other, type, etype, name, direction, edge_id): each entity's edges with the entity at the other end; with ``cap`` the
    first ones of each node by edge id text."""
    rows = both_ways(edges, keep=["edge_id", "type"]).join(entities.select(F.col("node").alias("other"), "etype", "name"), "other", "left")
    rows = rows.withColumn("name", F.coalesce("name", F.lit("Unknown")))
    if cap is not None:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("node").orderBy(F.col("edge_id").cast("string"), "other"))).filter(F.col("_n") <= cap).drop("_n")
    return rows.select("node", "other", "type", "etype", "name", "direction", "edge_id")


def profiles(entities: DataFrame, mentions: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, aliases, evidence_snippets, source_documents, phone_numbers, locations, vehicles, organizations), arrays sorted and
    distinct. mentions: node, name, snippet, filename; ``linked``: output of ``connections``. Aliases differ from the canonical
    name by more than case."""
    m = mentions.join(entities.select("node", F.col("name").alias("_c")), "node")
    name = F.trim("name")
    arrays = m.groupBy("node").agg(
        F.array_sort(F.collect_set(F.when((name != "") & (F.lower(name) != F.lower("_c")), name))).alias("aliases"),
        F.array_sort(F.collect_set(F.when(F.trim("snippet") != "", F.trim("snippet")))).alias("evidence_snippets"),
        F.array_sort(F.collect_set("filename")).alias("source_documents"),
    )
    kinds = {"phone_numbers": "PHONE", "locations": "LOCATION", "vehicles": "VEHICLE", "organizations": "ORGANIZATION"}
    around = linked.groupBy("node").agg(*[F.array_sort(F.collect_set(F.when(F.col("etype") == k, F.col("name")))).alias(c) for c, k in kinds.items()])
    none = F.array().cast("array<string>")
    out = entities.select("node").join(arrays, "node", "left").join(around, "node", "left")
    return out.select("node", *[F.coalesce(c, none).alias(c) for c in ("aliases", "evidence_snippets", "source_documents", *kinds)])


def entity_cases(links: DataFrame, members: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """(node, n_cases, access): ok where the user may see a case of the entity (node, case_id), else forbidden; entities
    without a case are not found and give no row."""
    allowed = links if admin else links.join(members.filter(F.col("user_id") == user).select("case_id"), "case_id", "left_semi")
    n = allowed.groupBy("node").agg(F.count_distinct("case_id").alias("n"))
    rows = links.select("node").distinct().join(n, "node", "left")
    return rows.select("node", F.coalesce("n", F.lit(0)).alias("n_cases"), F.when(F.col("n") > 0, "ok").otherwise("forbidden").alias("access"))


def project_graph(vertices: DataFrame, edges: DataFrame, old_vertices: DataFrame, old_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertex table, edge table and counts (projected, skipped, pruned_edges, pruned_nodes) after projecting cases again.

    vertices: node, case_id, ...; edges: edge_id, src, tgt, case_id, ... . The new rows of the cases at hand replace the old ones;
    unresolved edges are skipped; old vertices stay if another case's edge or membership needs them. Repeating changes nothing.
    """
    cases = vertices.select("case_id").unionByName(edges.select("case_id")).distinct()
    good = edges.filter(F.col("src").isNotNull() & F.col("tgt").isNotNull())
    others = old_edges.join(cases, "case_id", "left_anti")
    new_edges = others.select(*good.columns).unionByName(good).dropDuplicates(["edge_id"])
    kept = old_vertices.join(cases, "case_id", "left_anti").select(*vertices.columns)
    ends = new_edges.select(F.col("src").alias("node")).unionByName(new_edges.select(F.col("tgt").alias("node"))).distinct()
    needed = old_vertices.join(cases, "case_id", "left_semi").join(ends, "node", "left_semi").join(vertices.select("node"), "node", "left_anti").select(*vertices.columns)
    new_vertices = kept.unionByName(vertices).unionByName(needed).dropDuplicates(["node", "case_id"])
    gone_edges = old_edges.join(new_edges.select("edge_id"), "edge_id", "left_anti").agg(F.count("*").alias("pruned_edges"))
    gone_nodes = old_vertices.select("node").distinct().join(new_vertices.select("node"), "node", "left_anti").agg(F.count("*").alias("pruned_nodes"))
    n = edges.agg(F.count_if(F.col("src").isNotNull() & F.col("tgt").isNotNull()).alias("projected"), F.count_if(F.col("src").isNull() | F.col("tgt").isNull()).alias("skipped"))
    return new_vertices, new_edges, n.crossJoin(gone_edges).crossJoin(gone_nodes)  # three tables of one row each


def bridge_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transfers and calls from stored records (record_id, record_type, raw MAP<STRING,STRING>) with either field naming; a call
    without callee gets the caller's name and _unknown; records without party or time are left out."""
    get = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at("raw", F.lit(k)), F.lit("")) for k in keys])
    tx = records.filter("record_type = 'TRANSACTION'").select(
        "record_id", get("source", "sender").alias("sender"), get("target", "recipient").alias("recipient"), get("amount").try_cast("double").alias("amount"),
        F.coalesce(get("currency"), F.lit("INR")).alias("currency"), get("timestamp", "transaction_time").alias("transaction_time"),
    ).filter("sender is not null and recipient is not null and transaction_time is not null")
    caller = get("entity", "caller")
    cdr = records.filter("record_type = 'CDR'").select(
        "record_id", caller.alias("caller"), F.coalesce(get("callee"), F.concat(caller, F.lit("_unknown"))).alias("callee"), get("timestamp", "call_time").alias("call_time"), get("location").alias("location"),
    ).filter("caller is not null and call_time is not null")
    return tx, cdr


def resolve_entity_refs(refs: DataFrame, links: DataFrame, mentions: DataFrame) -> DataFrame:
    """refs (case_id, doc, raw) with ``resolved``: an entity of the case by id, else the entity of the first mention of that id in
    the same document, else in the case, else the raw text.

    links: node, case_id; mentions: case_id, doc, mention_id, node, created_at, id."""
    direct = links.select("case_id", F.col("node").alias("raw"), F.col("node").alias("_1")).distinct()
    m = mentions.filter("node is not null")
    first = F.min(F.struct("created_at", "id", "node")).alias("m")
    in_doc = m.groupBy("case_id", "doc", "mention_id").agg(first).select("case_id", "doc", F.col("mention_id").alias("raw"), F.col("m.node").alias("_2"))
    in_case = m.groupBy("case_id", "mention_id").agg(first).select("case_id", F.col("mention_id").alias("raw"), F.col("m.node").alias("_3"))
    r = refs.join(direct, ["case_id", "raw"], "left").join(in_doc, ["case_id", "doc", "raw"], "left").join(in_case, ["case_id", "raw"], "left")
    return r.select(*refs.columns, F.coalesce("_1", "_2", "_3", "raw").alias("resolved"))


def resolve_evidence_refs(refs: DataFrame, documents: DataFrame, records: DataFrame, rels: DataFrame) -> DataFrame:
    """refs (case_id, raw) with ``resolved`` and ``kind``: document, record, relationship, occurrence (by its id in the document)
    or raw, the first that the case has. Tables: case_id, id; relationships also occurrence."""
    r = refs
    for k, t in (("document", documents), ("record", records), ("relationship", rels)):
        r = r.join(t.select("case_id", F.col("id").alias("raw"), F.col("id").alias(f"_{k}")).distinct(), ["case_id", "raw"], "left")
    o = rels.groupBy("case_id", F.col("occurrence").alias("raw")).agg(F.min("id").alias("_occurrence"))
    r = r.join(o, ["case_id", "raw"], "left")
    order = ["document", "record", "relationship", "occurrence"]
    kind = F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), k) for k in order], F.lit("raw"))
    return r.select(*refs.columns, F.coalesce(*[f"_{k}" for k in order], "raw").alias("resolved"), kind.alias("kind"))


def store_insights(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insights (case_id, kind, source_id, payload, created_at) after an upsert on case, kind and source_id."""
    return upsert(existing, incoming, ["case_id", "kind", "source_id"], "created_at")


def list_insights(insights: DataFrame, case: str, kind: str, schema: str) -> DataFrame:
    """A case's insights of one kind, their JSON payload as columns, by time and source_id; unreadable payloads give nulls."""
    rows = insights.filter((F.col("case_id") == case) & (F.col("kind") == kind))
    return rows.select("source_id", "created_at", F.from_json("payload", schema).alias("p")).orderBy("created_at", "source_id").select("source_id", "p.*")


def ranked_relationships(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with the names of their ends (Unknown where none), by falling confidence and rising id."""
    name = entities.select("node", "name")
    r = rels.join(name.select(F.col("node").alias("src"), F.col("name").alias("source_name")), "src", "left").join(name.select(F.col("node").alias("tgt"), F.col("name").alias("target_name")), "tgt", "left")
    return r.na.fill("Unknown", ["source_name", "target_name"]).orderBy(F.col("confidence").desc(), "rel_id")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
