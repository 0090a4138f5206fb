"""Queries of the linked-evidence operators over the project's tables, with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum import schemas
from vinculum.functions import text
from vinculum.operators import casebook, evidence, extraction, graph, integrity, patterns, references, relations, resolution, validation
from vinculum.operators.components import connected_components
from vinculum.session import materialise, table

# --- tables as relations -------------------------------------------------------------------------------------------------


def _event_transfers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("record_id"), F.col("user_id").alias("sender"), F.get_json_object("props", "$.k").cast("bigint").alias("recipient"), "ts")


def _event_points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'view'")
    return e.select(F.col("user_id").alias("entity"), F.get_json_object("props", "$.k").alias("location"), F.col("event_id").alias("record_id"), "ts")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").filter("id is not null").withColumn("node", references.uuid_key(F.col("id")))
    one = e.groupBy("node").agg(F.min(F.struct("entity_type", "canonical_name", "case_id")).alias("m"))
    return one.select("node", F.col("m.entity_type").alias("etype"), F.col("m.canonical_name").alias("name"), F.col("m.case_id").alias("case_id"))


def _relationships(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relationships_staging")
    return r.select(
        F.col("rel_no").alias("rel_id"), references.uuid_key(F.col("source_entity_id")).alias("src"), references.uuid_key(F.col("target_entity_id")).alias("tgt"),
        F.col("relationship_type").alias("type"), "confidence", "status", F.col("source_document_id").alias("doc"), F.col("source_record_id").alias("record"),
        F.col("evidence_snippet").alias("snippet"), "case_id",
    )


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Resolved edges between stored entities, self-loops left out."""
    r = _relationships(spark, d).filter("src <> tgt")
    e = _entities(spark, d).select("node")
    for side in ("src", "tgt"):
        r = r.join(e.withColumnRenamed("node", side), side, "left_semi")
    return r.withColumnRenamed("rel_id", "edge_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


_K = "replace(replace(replace(replace(replace(lower(trim({c})),'urn:uuid:',''),'-',''),'{{',''),'}}',''),' ','')"
_TR = "t AS (SELECT event_id AS id, user_id AS s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS r, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), tr AS (SELECT DISTINCT * FROM t WHERE r IS NOT NULL AND s <> r AND us IS NOT NULL)"
_ENT = f"ent AS (SELECT node, m.entity_type AS etype, m.canonical_name AS name, m.case_id AS case_id FROM (SELECT {_K.format(c='id')} AS node, min({{'entity_type': entity_type, 'canonical_name': canonical_name, 'case_id': case_id}}) AS m FROM entities GROUP BY 1))"
_REL = f"rel AS (SELECT rel_no AS rel_id, {_K.format(c='source_entity_id')} AS src, {_K.format(c='target_entity_id')} AS tgt, relationship_type AS type, confidence, status, source_document_id AS doc, source_record_id AS record, evidence_snippet AS snippet, case_id FROM relationships_staging)"
_EDG = "edg AS (SELECT rel_id AS edge_id, src, tgt, type, confidence, status, case_id FROM rel WHERE src <> tgt AND src IN (SELECT node FROM ent) AND tgt IN (SELECT node FROM ent))"
_BOTH = "nb AS (SELECT src AS node, tgt AS other, 'OUT' AS direction, edge_id FROM edg UNION ALL SELECT tgt, src, 'IN', edge_id FROM edg)"
_W = f"WITH {_ENT}, {_REL}, {_EDG}, {_BOTH}"
_RANK = "(CASE status WHEN 'PREDICTED' THEN 0 WHEN 'INFERRED' THEN 1 WHEN 'CONFIRMED' THEN 2 ELSE -1 END)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# --- temporal patterns ---------------------------------------------------------------------------------------------------

_CHAIN = (
    "SELECT DISTINCT x.s AS a, x.r AS b, y.r AS c, x.id AS first_id, y.id AS second_id, x.us AS first_us, y.us AS second_us FROM tr x JOIN tr y ON x.r = y.s "
    "AND y.us >= x.us AND y.us - x.us <= 172800000000 AND x.s <> y.r AND x.id <> y.id"
)


@query("rapid_chain_48h", f"WITH {_TR} {_CHAIN}")
def rapid_chain_48h(spark, d):
    return patterns.rapid_chains(_event_transfers(spark, d))


@query(
    "chain_first_per_triple",
    f"WITH {_TR}, ch AS ({_CHAIN}) SELECT a, b, c, first_id, second_id FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY first_us, second_us, first_id, second_id) AS n FROM ch) WHERE n = 1",
)
def chain_first_per_triple(spark, d):
    return patterns.first_chain_per_triple(_event_transfers(spark, d))


def _cycle_sql(days: int) -> str:
    return (
        f"SELECT DISTINCT x.s AS a, x.r AS b, y.r AS c, list_sort([x.id, y.id, z.id]) AS evidence_ids, greatest(x.us, y.us, z.us) - least(x.us, y.us, z.us) AS span_us "
        f"FROM tr x JOIN tr y ON x.r = y.s JOIN tr z ON z.s = y.r AND z.r = x.s WHERE x.s < x.r AND x.s < y.r AND x.id <> y.id AND x.id <> z.id AND y.id <> z.id AND y.r <> x.r "
        f"AND greatest(x.us, y.us, z.us) - least(x.us, y.us, z.us) <= {days} * 86400000000"
    )


@query("cycle_7d", f"WITH {_TR} {_cycle_sql(7)}")
def cycle_7d(spark, d):
    return patterns.cycles(_event_transfers(spark, d), 7)


@query("cycle_30d", f"WITH {_TR} {_cycle_sql(30)}")
def cycle_30d(spark, d):
    return patterns.cycles(_event_transfers(spark, d), 30)


_POINT = "p AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS e, json_extract_string(props, '$.k') AS place, event_id AS id, epoch_us(ts) AS us FROM events WHERE event_type = 'view')"
_MEET = (
    "SELECT DISTINCT least(x.e, y.e) AS entity_a, greatest(x.e, y.e) AS entity_b, x.place, x.id AS id_a, y.id AS id_b, abs(x.us - y.us) AS gap_us FROM p x JOIN p y ON x.place = y.place "
    "AND x.id < y.id AND x.e <> y.e AND abs(x.us - y.us) <= 7200000000"
)


@query("colocation_2h", f"WITH {_POINT} {_MEET}")
def colocation_2h(spark, d):
    return patterns.meetings(_event_points(spark, d))


def _patterns(spark, d):
    t = _event_transfers(spark, d)
    return patterns.as_patterns(patterns.cycles(t, 7), patterns.rapid_chains(t), patterns.meetings(_event_points(spark, d)))


@query(
    "leads_ranked",
    f"WITH {_TR}, {_POINT}, ch AS ({_CHAIN}), cy AS ({_cycle_sql(7)}), me AS ({_MEET}), l AS ("
    "SELECT 'CIRCULAR_TRANSACTION_LEAD' AS lead_type, 'HIGH' AS priority, 0 AS priority_rank, 0.9::DOUBLE AS priority_score, list_sort([a::VARCHAR, b::VARCHAR, c::VARCHAR]) AS entities, list_sort(list_transform(evidence_ids, lambda x: x::VARCHAR)) AS evidence_ids FROM cy UNION "
    "SELECT 'RAPID_TRANSFER_LEAD', 'HIGH', 0, 0.85::DOUBLE, list_sort([a::VARCHAR, b::VARCHAR, c::VARCHAR]), list_sort([first_id::VARCHAR, second_id::VARCHAR]) FROM ch UNION "
    "SELECT 'LOCATION_OVERLAP_LEAD', 'MEDIUM', 1, 0.6::DOUBLE, list_sort([entity_a, entity_b]), list_sort([id_a::VARCHAR, id_b::VARCHAR]) FROM me) "
    "SELECT DISTINCT lead_type, priority, priority_rank, priority_score, 'REVIEW_REQUIRED' AS status, entities, evidence_ids FROM l ORDER BY priority_rank, lead_type, entities, evidence_ids",
)
def leads_ranked(spark, d):
    return patterns.leads(_patterns(spark, d)).orderBy("priority_rank", "lead_type", "entities", "evidence_ids")


@query(
    "pattern_hash_ids",
    f"WITH {_TR}, ch AS ({_CHAIN}) SELECT first_id, second_id, left(sha256('events|RAPID_TRANSFER_CHAIN|' || array_to_string(list_sort([a::VARCHAR, b::VARCHAR, c::VARCHAR]), ',') || '|' || array_to_string(list_sort([first_id::VARCHAR, second_id::VARCHAR]), ',')), 32) AS pattern_id FROM ch",
)
def pattern_hash_ids(spark, d):
    text_of = lambda *c: F.array(*[F.col(x).cast("string") for x in c])
    h = patterns.hash_id(F.lit("events"), F.lit("RAPID_TRANSFER_CHAIN"), text_of("a", "b", "c"), text_of("first_id", "second_id"))
    return patterns.rapid_chains(_event_transfers(spark, d)).select("first_id", "second_id", h.alias("pattern_id"))


# --- validation ----------------------------------------------------------------------------------------------------------

_ISO = "'^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,6})?)?(Z|[+-]\\d{2}:?\\d{2})?)?$'"


def _bad_time(c: str) -> str:
    return f"(NOT regexp_matches({c}, {_ISO}) OR try_cast(regexp_replace({c}, '([+-][0-9][0-9]:?[0-9][0-9]|Z)$', '') AS TIMESTAMP) IS NULL)"



_TX_REJECT = (
    "CASE WHEN coalesce(trim(sender), '') = '' THEN 'missing_sender' WHEN coalesce(trim(recipient), '') = '' THEN 'missing_recipient' "
    "WHEN regexp_replace(sender, '[\\s\\x{00A0}-]', '', 'g') = regexp_replace(recipient, '[\\s\\x{00A0}-]', '', 'g') THEN 'same_party' WHEN amount IS NULL THEN 'missing_amount' WHEN amount <= 0 THEN 'non_positive_amount' "
    "WHEN NOT coalesce(regexp_matches(upper(trim(currency)), '^[A-Z]{3}$'), false) THEN 'invalid_currency' WHEN coalesce(trim(transaction_time), '') = '' THEN 'missing_time' "
    f"WHEN {_bad_time('transaction_time')} THEN 'invalid_time' END"
)


@query("transfer_validation_rejects", f"SELECT coalesce(reject, 'valid') AS reject, count(*) AS n FROM (SELECT {_TX_REJECT} AS reject FROM transfers) GROUP BY 1")
def transfer_validation_rejects(spark, d):
    return validation.check_transfers(table(spark, d, "transfers")).groupBy(F.coalesce("reject", F.lit("valid")).alias("reject")).agg(F.count("*").alias("n"))


_DIG = "regexp_replace({c}, '\\D', '', 'g')"
_PHONE = f"(CASE WHEN length({_DIG}) = 12 AND starts_with({_DIG}, '91') THEN substr({_DIG}, 3, 10) WHEN length({_DIG}) = 11 AND starts_with({_DIG}, '0') THEN substr({_DIG}, 2, 10) ELSE {_DIG} END)"


def _phone(c: str) -> str:
    return _PHONE.replace("{c}", c)


_CALL_REJECT = (
    "CASE WHEN coalesce(trim(caller), '') = '' THEN 'missing_caller' WHEN coalesce(trim(callee), '') = '' THEN 'missing_callee' "
    f"WHEN coalesce(trim(call_time), '') = '' THEN 'missing_time' WHEN {_phone('caller')} = {_phone('callee')} THEN 'same_party' WHEN {_bad_time('call_time')} THEN 'invalid_time' "
    "WHEN duration < 0 THEN 'invalid_duration' END"
)


@query("call_validation_rejects", f"SELECT coalesce(reject, 'valid') AS reject, count(*) AS n FROM (SELECT {_CALL_REJECT} AS reject FROM calls) GROUP BY 1")
def call_validation_rejects(spark, d):
    return validation.check_calls(table(spark, d, "calls")).groupBy(F.coalesce("reject", F.lit("valid")).alias("reject")).agg(F.count("*").alias("n"))


_TYPES = ", ".join(f"'{t}'" for t in schemas.RELATIONSHIP_TYPES)


@query(
    "contract_violations",
    f"WITH {_REL} SELECT v AS violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence_out_of_range' END, CASE WHEN doc IS NULL AND coalesce(trim(record), '') = '' THEN 'missing_provenance' END, "
    f"CASE WHEN NOT coalesce(type IN ({_TYPES}), false) THEN 'unknown_relationship' END, CASE WHEN NOT coalesce(status IN ('PREDICTED', 'INFERRED', 'CONFIRMED'), false) THEN 'unknown_status' END], lambda x: x IS NOT NULL)) AS v FROM rel) GROUP BY 1",
)
def contract_violations(spark, d):
    return validation.relationship_violations(_relationships(spark, d)).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query(
    "repeated_occurrences",
    "SELECT source_document_id, source_occurrence_id, count(*) AS n FROM relationships_staging WHERE source_document_id IS NOT NULL AND source_occurrence_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
)
def repeated_occurrences(spark, d):
    return validation.repeated_keys(table(spark, d, "relationships_staging"), ["source_document_id", "source_occurrence_id"])


# --- patterns of the cases' own records: valid rows only, as the pipeline reads them -------------------------------------------


def _iso_us(c: str) -> str:
    """Microseconds of an ISO text in SQL; naive times are UTC."""
    zone = "'(Z|[+-][0-9]{2}:?[0-9]{2})$'"
    part = lambda k: f"regexp_extract({c}, '([+-])([0-9]{{2}}):?([0-9]{{2}})$', {k})"
    plus = f"(CASE WHEN length({c}) > 10 AND regexp_matches({c}, '[+-][0-9]{{2}}:?[0-9]{{2}}$') THEN (CASE {part(1)} WHEN '-' THEN -1 ELSE 1 END) * (CAST({part(2)} AS BIGINT) * 60 + CAST({part(3)} AS BIGINT)) ELSE 0 END)"
    return f"(epoch_us(CAST(CASE WHEN length({c}) > 10 THEN regexp_replace({c}, {zone}, '') ELSE {c} END AS TIMESTAMP)) - {plus} * 60000000)"


_W_BARE = "regexp_replace(trim({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', '{}', 'g')"


def _made_id(kind: str, first: str, second: str, time: str, sign: str) -> str:
    return f"coalesce(nullif(trim(record_id), ''), '{kind}_' || {_W_BARE.format(first, sign)} || '_' || {_W_BARE.format(second, sign)} || '_' || {_W_BARE.format(time, '')})"


_CASE_TX = (
    f"vt AS MATERIALIZED (SELECT * FROM (SELECT *, {_TX_REJECT} AS reject FROM transfers) WHERE reject IS NULL), "
    f"tx AS MATERIALIZED (SELECT DISTINCT case_id, {_made_id('tx', 'sender', 'recipient', 'transaction_time', '_')} AS id, sender AS s, recipient AS r, {_iso_us('transaction_time')} AS us FROM vt WHERE sender <> recipient)"
)
_LOC = "trim(regexp_replace(lower(trim(regexp_replace(location, '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', '', 'g'))), '\\s+', ' ', 'g'))"
_CASE_POINTS = (
    f"vc AS MATERIALIZED (SELECT * FROM (SELECT *, {_CALL_REJECT} AS reject FROM calls) WHERE reject IS NULL), "
    f"pt AS MATERIALIZED (SELECT DISTINCT case_id, caller AS e, {_LOC} AS place, {_made_id('cdr', 'caller', 'callee', 'call_time', '')} AS id, {_iso_us('call_time')} AS us FROM vc WHERE coalesce({_LOC}, '') <> '' "
    f"UNION SELECT case_id, sender, {_LOC}, {_made_id('tx', 'sender', 'recipient', 'transaction_time', '')}, {_iso_us('transaction_time')} FROM vt WHERE coalesce({_LOC}, '') <> '')"
)
_CASE_CHAIN = (
    "SELECT DISTINCT x.case_id, x.s AS a, x.r AS b, y.r AS c, x.id AS first_id, y.id AS second_id, x.us AS first_us, y.us AS second_us FROM tx x JOIN tx y ON x.case_id IS NOT DISTINCT FROM y.case_id AND x.r = y.s "
    "AND y.us >= x.us AND y.us - x.us <= 172800000000 AND x.s <> y.r AND x.id <> y.id"
)
_CASE_CYCLE = (
    "SELECT DISTINCT x.case_id, x.s AS a, x.r AS b, y.r AS c, list_sort([x.id, y.id, z.id]) AS evidence_ids, greatest(x.us, y.us, z.us) - least(x.us, y.us, z.us) AS span_us "
    "FROM tx x JOIN tx y ON x.case_id IS NOT DISTINCT FROM y.case_id AND x.r = y.s JOIN tx z ON z.case_id IS NOT DISTINCT FROM x.case_id AND z.s = y.r AND z.r = x.s WHERE x.s < x.r AND x.s < y.r AND x.id <> y.id AND x.id <> z.id AND y.id <> z.id "
    "AND y.r <> x.r AND greatest(x.us, y.us, z.us) - least(x.us, y.us, z.us) <= 2592000000000"
)
_CASE_MEET = (
    "SELECT DISTINCT x.case_id, least(x.e, y.e) AS entity_a, greatest(x.e, y.e) AS entity_b, x.place, x.id AS id_a, y.id AS id_b, abs(x.us - y.us) AS gap_us FROM pt x JOIN pt y ON x.case_id IS NOT DISTINCT FROM y.case_id AND x.place = y.place "
    "AND x.id < y.id AND lower(x.e) <> lower(y.e) AND abs(x.us - y.us) <= 7200000000"
)
_CASE_ALL = f"{_CASE_TX}, {_CASE_POINTS}, ch AS ({_CASE_CHAIN}), cy AS ({_CASE_CYCLE}), me AS ({_CASE_MEET})"


def _case_transfers(spark, d) -> DataFrame:
    t = validation.lenient(validation.check_transfers(table(spark, d, "transfers")))
    return t.select("case_id", "record_id", "sender", "recipient", "location", F.col("transaction_time").alias("time_text"), validation.iso_instant(F.col("transaction_time")).alias("ts"))


def _case_points(spark, d) -> DataFrame:
    c = validation.lenient(validation.check_calls(table(spark, d, "calls")))
    calls = c.select("case_id", F.col("caller").alias("entity"), "location", patterns.record_key(F.col("record_id"), "cdr", F.col("caller"), F.col("callee"), F.col("call_time"), "").alias("record_id"), validation.iso_instant(F.col("call_time")).alias("ts"))
    t = _case_transfers(spark, d)
    sums = t.select("case_id", F.col("sender").alias("entity"), "location", patterns.record_key(F.col("record_id"), "tx", F.col("sender"), F.col("recipient"), F.col("time_text"), "").alias("record_id"), "ts")
    return calls.unionByName(sums)


@query("chains_transfers", f"WITH {_CASE_TX} {_CASE_CHAIN}")
def chains_transfers(spark, d):
    """Rapid chains in the cases' transfers."""
    return patterns.rapid_chains(_case_transfers(spark, d), group="case_id")


def _across(sql: str) -> str:
    """The SQL of a pattern without its bound to one case."""
    for bound in ("x.case_id IS NOT DISTINCT FROM y.case_id AND ", "z.case_id IS NOT DISTINCT FROM x.case_id AND ", "x.case_id, "):
        sql = sql.replace(bound, "")
    return sql


_TWO_YEARS = _CASE_CYCLE.replace("2592000000000", "63072000000000")


@query("cycles_transfers", f"WITH {_CASE_TX} {_across(_TWO_YEARS)}")
def cycles_transfers(spark, d):
    """Three-party cycles within two years in the transfers of all cases."""
    return patterns.cycles(_case_transfers(spark, d), 730)


@query("meetings_records", f"WITH {_CASE_TX}, {_CASE_POINTS} {_across(_CASE_MEET)}")
def meetings_records(spark, d):
    """Meetings in place and time in the calls and transfers of all cases."""
    return patterns.meetings(_case_points(spark, d))


def _case_patterns(spark, d) -> DataFrame:
    t, p = _case_transfers(spark, d), _case_points(spark, d)
    return patterns.as_patterns(patterns.cycles(t, 30, "case_id"), patterns.rapid_chains(t, 48, "case_id"), patterns.meetings(p, 2, "case_id"), group="case_id")


@query(
    "leads_cases",
    f"WITH {_CASE_ALL}, l AS ("
    "SELECT case_id, 'CIRCULAR_TRANSACTION_LEAD' AS lead_type, 'HIGH' AS priority, 0 AS priority_rank, 0.9::DOUBLE AS priority_score, list_sort([a, b, c]) AS entities, evidence_ids FROM cy UNION "
    "SELECT case_id, 'RAPID_TRANSFER_LEAD', 'HIGH', 0, 0.85::DOUBLE, list_sort([a, b, c]), list_sort([first_id, second_id]) FROM ch UNION "
    "SELECT case_id, 'LOCATION_OVERLAP_LEAD', 'MEDIUM', 1, 0.6::DOUBLE, list_sort([entity_a, entity_b]), list_sort([id_a, id_b]) FROM me) "
    "SELECT DISTINCT case_id, lead_type, priority, priority_rank, priority_score, 'REVIEW_REQUIRED' AS status, entities, evidence_ids FROM l",
)
def leads_cases(spark, d):
    """Leads from all patterns of the cases' records."""
    return patterns.leads(_case_patterns(spark, d), "case_id")


@query(
    "lead_titles",
    f"WITH {_CASE_TX}, cy AS ({_across(_TWO_YEARS)}) SELECT 'Investigate circular transaction cycle (' || a || ' → ' || b || ' → ' || c || ')' AS title, "
    "'Review the detected fund routing cycle (' || a || ' → ' || b || ' → ' || c || ') and supporting transaction records (' || array_to_string(evidence_ids, ', ') || ') for potential layered routing.' AS lead_explanation FROM cy",
)
def lead_titles(spark, d):
    """Titles and explanations of the leads from cycles."""
    none = patterns.rapid_chains(_case_transfers(spark, d)).limit(0), meetings_records(spark, d).limit(0)
    return patterns.lead_texts(patterns.as_patterns(cycles_transfers(spark, d), *none)).select("title", "lead_explanation")


@query(
    "first_cycle_per_set",
    f"WITH {_TR}, cy AS (SELECT list_sort(list_distinct([x.s, x.r, y.r])) AS entities, {{'u1': x.us, 'u2': y.us, 'u3': z.us, 'r1': x.id, 'r2': y.id, 'r3': z.id}} AS m FROM tr x JOIN tr y ON x.r = y.s JOIN tr z ON z.s = y.r AND z.r = x.s "
    "WHERE x.us <= y.us AND y.us <= z.us AND x.id <> y.id AND x.id <> z.id AND y.id <> z.id AND (z.us - x.us) // 86400000000 <= 30), g AS (SELECT entities, min(m) AS m FROM cy GROUP BY 1) "
    "SELECT entities, [m.r1, m.r2, m.r3] AS evidence_ids, m.u1 AS first_us, m.u3 - m.u1 AS span_us FROM g",
)
def first_cycle_per_set(spark, d):
    """Cycles as the older detector keeps them."""
    return patterns.first_cycle_per_set(_event_transfers(spark, d))


@query(
    "call_colocation_2h",
    f"WITH vc AS MATERIALIZED (SELECT * FROM (SELECT *, {_CALL_REJECT} AS reject FROM calls) WHERE reject IS NULL), p AS MATERIALIZED (SELECT DISTINCT {_phone('caller')} AS e, lower(regexp_replace(cell_id, '[^\\w\\s]', '', 'g')) AS place, {_iso_us('call_time')} AS us FROM vc WHERE cell_id IS NOT NULL) "
    "SELECT place, count(*) AS meetings, count(DISTINCT e) AS entities FROM p x WHERE EXISTS (SELECT 1 FROM p y WHERE y.place = x.place AND y.e <> x.e AND abs(y.us - x.us) <= 7200000000) GROUP BY 1",
)
def call_colocation_2h(spark, d):
    """Callers that met another one at a cell within two hours, over the valid calls."""
    c = validation.lenient(validation.check_calls(table(spark, d, "calls"))).filter("cell_id is not null")
    return patterns.meeting_counts(c.select(text.match_phone(F.col("caller")).alias("entity"), F.col("cell_id").alias("location"), validation.iso_instant(F.col("call_time")).alias("ts")))


# --- graph ---------------------------------------------------------------------------------------------------------------


@query("degree_topk", f"{_W} SELECT node, count(*) AS degree FROM nb GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def degree_topk(spark, d):
    return graph.top_degrees(_edges(spark, d), 20)


@query("orphan_nodes", f"{_W} SELECT node FROM ent WHERE node NOT IN (SELECT node FROM nb)")
def orphan_nodes(spark, d):
    return graph.isolated(_entities(spark, d), _edges(spark, d))


@query("neighbours_1hop", f"{_W} SELECT node, other, direction, edge_id FROM nb")
def neighbours_1hop(spark, d):
    return graph.neighbours(_edges(spark, d), _entities(spark, d), ["edge_id"])


_HUB = "hub AS (SELECT node FROM (SELECT node, count(*) AS n FROM nb GROUP BY 1) ORDER BY n DESC, node LIMIT 1)"


def _hub(edges: DataFrame) -> DataFrame:
    return graph.top_degrees(edges, 1).select("node")


@query(
    "two_hop_ring",
    f"{_W}, {_HUB}, h1 AS (SELECT DISTINCT other AS node FROM nb WHERE node IN (SELECT node FROM hub) AND other NOT IN (SELECT node FROM hub)), h2 AS (SELECT DISTINCT other AS node FROM nb WHERE node IN (SELECT node FROM h1) AND other NOT IN (SELECT node FROM h1) AND other NOT IN (SELECT node FROM hub)) "
    "SELECT node, 0 AS hop FROM hub UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2",
)
def two_hop_ring(spark, d):
    e = materialise(_edges(spark, d))
    return graph.ring(e, _hub(e), 2)


def _bfs(hops: int) -> str:
    sql = f"{_W}, {_HUB}, e AS (SELECT node, other, min(lpad(edge_id::VARCHAR, 12, '0')) AS k FROM nb GROUP BY 1, 2), l0 AS (SELECT node, '' AS path, 0 AS hops FROM hub)"
    seen = "SELECT node FROM l0"
    for h in range(1, hops + 1):
        sql += f", l{h} AS (SELECT e.other AS node, min(l.path || '|' || e.k) AS path, {h} AS hops FROM l{h - 1} l JOIN e ON e.node = l.node WHERE e.other NOT IN ({seen}) GROUP BY 1)"
        seen += f" UNION ALL SELECT node FROM l{h}"
    return sql + " SELECT (SELECT node FROM hub) AS source, node, hops, path FROM (" + " UNION ALL ".join(f"SELECT * FROM l{h}" for h in range(hops + 1)) + ")"


@query("shortest_path_bounded", _bfs(5))
def shortest_path_bounded(spark, d):
    """From the node of highest degree to every node within five hops."""
    e = materialise(_edges(spark, d))
    return graph.shortest_paths(e, _hub(e), 5)


@query(
    "case_graph_truncated",
    f"{_W}, c AS (SELECT edge_id, src, tgt, type, row_number() OVER (ORDER BY edge_id::VARCHAR) AS n FROM edg WHERE case_id = 'CASE-00-000001') SELECT edge_id, src, tgt, type, (SELECT count(*) FROM c) > 50 AS truncated FROM c WHERE n <= 50",
)
def case_graph_truncated(spark, d):
    return graph.case_graph(_edges(spark, d), "CASE-00-000001", 50)


_SIMILAR = (
    "c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, c_acctbal AS b FROM customer), "
    "ed AS (SELECT x.k AS a, y.k AS b FROM c x JOIN c y ON x.n = y.n AND x.m = y.m AND x.k <> y.k AND abs(x.b - y.b) <= 50)"
)


@query(
    "components_customers",
    f"WITH RECURSIVE {_SIMILAR}, walk(node, root) AS (SELECT a, a FROM ed UNION SELECT ed.a, walk.root FROM walk JOIN ed ON ed.b = walk.node WHERE walk.root < ed.a) SELECT node, min(root) AS root FROM walk GROUP BY 1",
)
def components_customers(spark, d):
    """Components of customers alike in nation, segment and, within 50, balance; a band join by buckets of the bound."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"), F.col("c_acctbal").alias("b"))
    slot = F.floor(F.col("b") / 50).cast("bigint")
    x = c.select("n", "m", F.col("k").alias("a"), F.col("b").alias("ba"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    y = c.select("n", "m", F.col("k").alias("b"), F.col("b").alias("bb"), slot.alias("slot"))
    return connected_components(x.join(y, ["n", "m", "slot"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ba") - F.col("bb")) <= 50)).select("a", "b"))


_ORG_NORM = "trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\\bp\\.?\\s?s\\b\\.?', 'police station', 'g'), '(?i)\\b(?:pvt\\s+ltd|ltd|llc|llp|inc|corp|corporation)\\b', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', '', 'g'))), '\\s+', ' ', 'g'))"
_SHARED = (
    f"ph AS (SELECT {_K.format(c='entity_id')} AS node, {_ORG_NORM.format('p')} AS p FROM (SELECT entity_id, unnest(organizations) AS p FROM entity_attributes)), "
    "st AS (SELECT node AS a, min(node) OVER (PARTITION BY p) AS b FROM ph WHERE p <> ''), ed AS (SELECT a, b FROM st WHERE a <> b UNION SELECT b, a FROM st WHERE a <> b)"
)


def _shared_orgs(spark, d) -> DataFrame:
    a = table(spark, d, "entity_attributes").select(references.uuid_key(F.col("entity_id")).alias("a"), F.explode("organizations").alias("p"))
    a = a.withColumn("p", text.match_org(F.col("p"))).filter("p <> ''")
    return a.join(a.groupBy("p").agg(F.min("a").alias("b")), "p").filter("a <> b").select("a", "b")


@query(
    "components_shared_org",
    f"WITH RECURSIVE {_SHARED}, walk(node, root) AS (SELECT a, a FROM ed UNION SELECT ed.a, walk.root FROM walk JOIN ed ON ed.b = walk.node) SELECT node, min(root) AS root FROM walk GROUP BY 1",
)
def components_shared_org(spark, d):
    """Components of entities that name the same organisation among their attributes."""
    return connected_components(_shared_orgs(spark, d))


@query(
    "graph_clusters",
    f"WITH RECURSIVE {_ENT}, {_REL}, {_EDG}, {_BOTH}, c AS (SELECT DISTINCT node, other FROM nb), l0 AS (SELECT node, least(node, min(other)) AS root FROM c GROUP BY node), "
    "w(node, root) AS (SELECT node, node FROM c UNION SELECT c.other, w.root FROM w JOIN c ON c.node = w.node WHERE w.root < c.other), r AS (SELECT node, min(root) AS root FROM w GROUP BY node), "
    "dg AS (SELECT node, count(*) AS degree FROM nb GROUP BY node) SELECT root, count(*) AS size, arg_min(r.node, (-degree, r.node)) AS hub, max(degree) AS hub_degree FROM r JOIN dg USING (node) GROUP BY root",
)
def graph_clusters(spark, d):
    return graph.clusters(materialise(_edges(spark, d)))


@query(
    "orphan_explanations",
    f"{_W}, acc AS (SELECT node, count(*) AS a FROM (SELECT src AS node FROM edg WHERE status = 'CONFIRMED' UNION ALL SELECT tgt FROM edg WHERE status = 'CONFIRMED') GROUP BY 1), cand AS (SELECT node, count(*) AS c FROM nb GROUP BY 1) "
    "SELECT ent.node, 0 AS accepted_degree, coalesce(c, 0) AS candidate_degree, CASE WHEN coalesce(c, 0) > 0 THEN 'candidate_edges_rejected' ELSE 'no_relationship_evidence' END AS reason FROM ent LEFT JOIN acc USING (node) LEFT JOIN cand USING (node) WHERE coalesce(a, 0) = 0",
)
def orphan_explanations(spark, d):
    e = _edges(spark, d)
    return graph.explain_isolated(_entities(spark, d), e.filter("status = 'CONFIRMED'"), e)


@query("entity_connections", f"{_W} SELECT nb.node, nb.other, edg.type, ent.etype, coalesce(ent.name, 'Unknown') AS name, nb.direction, nb.edge_id FROM nb JOIN edg USING (edge_id) LEFT JOIN ent ON ent.node = nb.other")
def entity_connections(spark, d):
    return casebook.connections(_edges(spark, d), _entities(spark, d))


_AT = f"(SELECT {_K.format(c='entity_id')} AS node, * EXCLUDE (entity_id) FROM entity_attributes)"


@query(
    "entity_profiles",
    f"{_W}, c AS (SELECT nb.node, ent.etype, ent.name FROM nb JOIN ent ON ent.node = nb.other), attr AS {_AT}, "
    "al AS (SELECT ent.node, trim(x) AS v FROM (SELECT node, unnest(aliases) AS x FROM attr) JOIN ent USING (node) WHERE trim(x) <> '' AND lower(trim(x)) <> lower(ent.name)), "
    "sn AS (SELECT node, trim(x) AS v FROM (SELECT node, unnest(evidence_snippets) AS x FROM attr) WHERE trim(x) <> ''), "
    "fi AS (SELECT node, filename AS v FROM (SELECT node, unnest(source_documents) AS x FROM attr) JOIN documents ON doc_id = x WHERE filename IS NOT NULL), "
    + ", ".join(f"l_{t} AS (SELECT node, list_sort(list(DISTINCT v)) AS v FROM {t} GROUP BY 1)" for t in ("al", "sn", "fi"))
    + ", k AS (SELECT ent.node, "
    + ", ".join(f"coalesce(list_sort(list(DISTINCT c.name) FILTER (WHERE c.etype = '{k}')), []) AS {n}" for n, k in (("phone_numbers", "PHONE"), ("locations", "LOCATION"), ("vehicles", "VEHICLE"), ("organizations", "ORGANIZATION")))
    + " FROM ent LEFT JOIN c ON c.node = ent.node GROUP BY ent.node) SELECT k.*, coalesce(l_al.v, []) AS aliases, coalesce(l_sn.v, []) AS evidence_snippets, coalesce(l_fi.v, []) AS source_documents "
    "FROM k LEFT JOIN l_al USING (node) LEFT JOIN l_sn USING (node) LEFT JOIN l_fi USING (node)",
)
def entity_profiles(spark, d):
    """Each entity's aliases, snippets and documents, and the names of its neighbours by type."""
    e = _entities(spark, d)
    a = table(spark, d, "entity_attributes").withColumn("node", references.uuid_key(F.col("entity_id")))
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "filename")
    seen = a.select("node", F.explode("aliases").alias("name"), none.alias("snippet"), none.alias("filename"))
    seen = seen.unionByName(a.select("node", none.alias("name"), F.explode("evidence_snippets").alias("snippet"), none.alias("filename")))
    seen = seen.unionByName(a.select("node", F.explode("source_documents").alias("doc")).join(docs, "doc").select("node", none.alias("name"), none.alias("snippet"), "filename"))
    return casebook.profiles(e, seen, casebook.connections(_edges(spark, d), e))


@query(
    "projected_graph",
    f"{_W}, v AS (SELECT node, case_id FROM ent), e AS (SELECT rel_id, src, tgt, case_id, status FROM rel), good AS (SELECT * FROM e WHERE src IS NOT NULL AND tgt IS NOT NULL), "
    "v1 AS (SELECT node FROM ent WHERE case_id = 'CASE-00-000001' AND etype = 'PERSON'), e1 AS (SELECT * FROM e WHERE case_id = 'CASE-00-000001' AND status = 'CONFIRMED'), "
    "ne AS (SELECT rel_id, src, tgt FROM good WHERE case_id IS DISTINCT FROM 'CASE-00-000001' UNION SELECT rel_id, src, tgt FROM e1 WHERE src IS NOT NULL AND tgt IS NOT NULL), ends AS (SELECT src AS node FROM ne UNION SELECT tgt FROM ne), "
    "nv AS (SELECT node FROM v WHERE case_id IS DISTINCT FROM 'CASE-00-000001' UNION SELECT node FROM v1 UNION SELECT node FROM v WHERE case_id = 'CASE-00-000001' AND node IN (SELECT node FROM ends)) "
    "SELECT (SELECT count(*) FROM nv) AS vertices, (SELECT count(*) FROM ne) AS edges, (SELECT count(*) FROM e1 WHERE src IS NOT NULL AND tgt IS NOT NULL) AS projected, (SELECT count(*) FROM e1 WHERE src IS NULL OR tgt IS NULL) AS skipped, "
    "(SELECT count(*) FROM good WHERE rel_id NOT IN (SELECT rel_id FROM ne)) AS pruned_edges, (SELECT count(DISTINCT node) FROM v WHERE node NOT IN (SELECT node FROM nv)) AS pruned_nodes",
)
def projected_graph(spark, d):
    """Counts of projecting the persons and confirmed edges of the largest case into the graph of all cases."""
    e = _entities(spark, d)
    r = _relationships(spark, d).withColumnRenamed("rel_id", "edge_id")
    old_v, old_e = e.select("node", "case_id"), r.filter("src is not null and tgt is not null").select("edge_id", "src", "tgt", "case_id")
    one = F.col("case_id") == "CASE-00-000001"
    nv, ne, n = casebook.project_graph(e.filter(one & (F.col("etype") == "PERSON")).select("node", "case_id"), r.filter(one & (F.col("status") == "CONFIRMED")).select("edge_id", "src", "tgt", "case_id"), old_v, old_e)
    counts = nv.agg(F.count_distinct("node").alias("vertices")).crossJoin(ne.agg(F.count("*").alias("edges")))
    return counts.crossJoin(n.select("projected", "skipped", "pruned_edges", "pruned_nodes"))  # tables of one row each


# --- evidence ------------------------------------------------------------------------------------------------------------


_ALLOWED = " OR ".join(f"(type = '{k}' AND (s.etype || '>' || t.etype) IN ({', '.join(repr(f'{a}>{b}') for a, b in v)}))" for k, v in schemas.ENDPOINTS.items())


@query(
    "firewall_reasons",
    f"WITH {_ENT}, {_REL}, rec AS (SELECT DISTINCT record_id AS record FROM calls WHERE record_id IS NOT NULL UNION SELECT record_id FROM transfers WHERE record_id IS NOT NULL), f AS (SELECT CASE WHEN s.etype IS NULL OR t.etype IS NULL THEN 'unknown_endpoint' WHEN src = tgt THEN 'self_loop' "
    f"WHEN NOT confidence >= 0.5 THEN 'below_confidence_threshold' WHEN NOT ({_ALLOWED}) THEN 'invalid_endpoint_types' WHEN coalesce(rel.record, '') <> '' AND rec.record IS NULL THEN 'unknown_record_provenance' END AS reason "
    "FROM rel LEFT JOIN ent s ON s.node = src LEFT JOIN ent t ON t.node = tgt LEFT JOIN rec ON rec.record = rel.record) SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM f GROUP BY 1",
)
def firewall_reasons(spark, d):
    records = table(spark, d, "calls").select(F.col("record_id").alias("record")).unionByName(table(spark, d, "transfers").select(F.col("record_id").alias("record"))).filter("record is not null")
    rows = evidence.firewall_reasons(_relationships(spark, d), _entities(spark, d), None, records, 0.5)
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


_FOLD = "regexp_replace(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')"


@query(
    "grounded_evidence",
    f"WITH {_REL}, j AS (SELECT rel.*, {_FOLD.format('snippet')} AS s, {_FOLD.format('documents.text')} AS t, coalesce(snippet, '') <> '' AND coalesce(documents.text, '') <> '' AS there FROM rel LEFT JOIN documents ON doc_id = doc), "
    "w AS (SELECT *, list_filter(regexp_extract_all(s, '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: length(x) > 2) AS ws FROM j), "
    "g AS (SELECT *, coalesce(record, '') <> '' AS has, CASE WHEN NOT there THEN 0.0 WHEN contains(t, s) THEN 1.0 WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda x: contains(t, x)))::DOUBLE / len(ws) END >= 0.65 AS ok FROM w) "
    "SELECT CASE WHEN has THEN 'STRUCTURED' WHEN ok THEN 'EXPLICIT' ELSE 'UNGROUNDED' END AS strength, count(*) AS n, count(DISTINCT CASE WHEN has THEN 'record:' || record ELSE 'document:' || coalesce(doc::VARCHAR, 'unknown') || ':' || rel_id END) AS sources FROM g GROUP BY 1",
)
def grounded_evidence(spark, d):
    """Relationships by strength of their evidence, snippets checked against the whole documents."""
    rows = evidence.assess(_relationships(spark, d), _texts(spark, d))
    return rows.groupBy("strength").agg(F.count("*").alias("n"), F.count_distinct("source_key").alias("sources"))


_SRC = "CASE WHEN coalesce(record, '') <> '' THEN 'record:' || record ELSE 'document:' || coalesce(doc::VARCHAR, 'unknown') || ':' || regexp_replace(coalesce(snippet, ''), '^\\s+|\\s+$', '', 'g') END"


@query(
    "evidence_groups",
    f"WITH {_REL}, g AS (SELECT src, type, tgt, list_sort(list(rel_id)) AS rel_ids, count(DISTINCT {_SRC}) AS n_sources, max(confidence) AS max_confidence, arg_max(status, ({_RANK}, confidence, rel_id)) AS strongest_status FROM rel GROUP BY 1, 2, 3) "
    "SELECT src, type, tgt, rel_ids, n_sources, max_confidence, round(least(0.99::DOUBLE, max_confidence + 0.03::DOUBLE * (n_sources - 1)), 4) AS calibrated, strongest_status FROM g",
)
def evidence_groups(spark, d):
    return evidence.evidence_groups(_relationships(spark, d))


@query(
    "accepted_edges",
    f"WITH {_REL}, r AS (SELECT * FROM rel WHERE src IS NOT NULL AND tgt IS NOT NULL AND status IN ('INFERRED', 'CONFIRMED')) SELECT src, type, tgt, arg_max(rel_id, ({_RANK}, confidence, rel_id)) AS rel_id, arg_max(confidence, ({_RANK}, confidence, rel_id)) AS confidence, arg_max(status, ({_RANK}, confidence, rel_id)) AS status, count(*) - 1 AS duplicates FROM r GROUP BY 1, 2, 3",
)
def accepted_edges(spark, d):
    return evidence.accepted_edges(_relationships(spark, d).filter("src is not null and tgt is not null and status in ('INFERRED', 'CONFIRMED')"))


@query(
    "status_changes",
    f"WITH {_REL}, r AS (SELECT src, type, tgt, rel_id, {_RANK} AS k FROM rel WHERE src IS NOT NULL AND tgt IS NOT NULL), m AS (SELECT *, max(k) OVER (PARTITION BY src, type, tgt ORDER BY rel_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r) "
    "SELECT src, type, tgt, count(*)::INT AS contradictions FROM m WHERE best IS NOT NULL AND k <> best GROUP BY 1, 2, 3",
)
def status_changes(spark, d):
    return evidence.status_changes(_relationships(spark, d).filter("src is not null and tgt is not null")).filter("contradictions > 0")


def _contra(kind: str, etype: str) -> str:
    return (
        f"SELECT '{kind}' AS kind, x.src AS node, x.tgt AS target_a, y.tgt AS target_b, x.rel_id AS rel_a, y.rel_id AS rel_b FROM rel x JOIN rel y ON x.src = y.src AND x.rel_id < y.rel_id AND x.tgt <> y.tgt WHERE x.type = '{kind}' AND y.type = '{kind}' "
        f"AND x.status <> 'PREDICTED' AND y.status <> 'PREDICTED' AND x.tgt IN (SELECT node FROM ent WHERE etype = '{etype}') AND y.tgt IN (SELECT node FROM ent WHERE etype = '{etype}')"
    )


@query("contradictions", f"WITH {_ENT}, {_REL} {_contra('LOCATED_AT', 'LOCATION')} UNION ALL {_contra('WORKS_FOR', 'ORGANIZATION')}")
def contradictions(spark, d):
    """Sources placed at two locations, or working for two organisations."""
    parts = [evidence.contradictions(_relationships(spark, d), _entities(spark, d), k, e).select(F.lit(k).alias("kind"), "*") for k, e in (("LOCATED_AT", "LOCATION"), ("WORKS_FOR", "ORGANIZATION"))]
    return parts[0].unionByName(parts[1])


@query(
    "case_signal",
    f"WITH {_REL}, {_CASE_ALL}, r AS (SELECT case_id, count(*) FILTER (WHERE status = 'CONFIRMED') AS c, count(*) FILTER (WHERE status = 'INFERRED') AS i FROM rel GROUP BY 1), "
    "q AS (SELECT case_id, 'CIRCULAR_TRANSACTION' AS t, 0.7::DOUBLE AS w FROM cy UNION ALL SELECT case_id, 'RAPID_TRANSFER_CHAIN', 0.7 FROM ch UNION ALL SELECT case_id, 'LOCATION_TIME_OVERLAP', 0.45 FROM me), "
    "p AS (SELECT case_id, max(w) AS ps, list(DISTINCT t) AS ts FROM q GROUP BY 1), "
    "s AS (SELECT coalesce(p.case_id, r.case_id) AS case_id, coalesce(ps, 0) AS ps, coalesce(ts, []) AS ts, coalesce(c, 0) AS c, coalesce(i, 0) AS i FROM p FULL JOIN r ON p.case_id = r.case_id), "
    "z AS (SELECT *, round(greatest(ps, CASE WHEN c >= 3 THEN least(0.85::DOUBLE, 0.55::DOUBLE + c * 0.05::DOUBLE) WHEN i >= 2 THEN 0.45::DOUBLE ELSE 0 END), 4) AS score FROM s) "
    "SELECT case_id, score, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS level, "
    "list_sort(list_concat(ts, list_filter([CASE WHEN c >= 3 THEN 'MULTI_RELATIONSHIP_SUPPORT' END, CASE WHEN c < 3 AND i >= 2 THEN 'INFERRED_NETWORK_SIGNAL' END], lambda x: x IS NOT NULL))) AS reason_codes FROM z",
)
def case_signal(spark, d):
    """Signals of the cases from the patterns of their records and their relationships."""
    return evidence.case_signals(_case_patterns(spark, d), _relationships(spark, d))


@query(
    "f1_confirmed_inferred",
    f"WITH {_REL}, e AS (SELECT DISTINCT src, type, tgt FROM rel WHERE status = 'CONFIRMED'), f AS (SELECT DISTINCT src, type, tgt FROM rel WHERE status = 'INFERRED'), n AS (SELECT (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM f)) AS tp, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM e)) AS fp, (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM f)) AS fn), "
    "q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall FROM n) SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM q",
)
def f1_confirmed_inferred(spark, d):
    r = _relationships(spark, d)
    return evidence.f1_scores(r.filter("status = 'CONFIRMED'").select("src", "type", "tgt"), r.filter("status = 'INFERRED'").select("src", "type", "tgt"))


@query(
    "macro_f1",
    f"WITH {_REL}, p AS (SELECT * FROM (VALUES ('CONFIRMED', 'INFERRED'), ('INFERRED', 'PREDICTED')) v(e, f)), k AS (SELECT DISTINCT status, src, type, tgt FROM rel), "
    "n AS (SELECT p.e, p.f, (SELECT count(*) FROM (SELECT src, type, tgt FROM k WHERE status = p.e INTERSECT SELECT src, type, tgt FROM k WHERE status = p.f)) AS tp, (SELECT count(*) FROM k WHERE status = p.e) AS ne, (SELECT count(*) FROM k WHERE status = p.f) AS nf FROM p) "
    "SELECT round(avg(CASE WHEN ne + nf = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (tp::DOUBLE / nf) * (tp::DOUBLE / ne) / (tp::DOUBLE / nf + tp::DOUBLE / ne) END), 4) AS macro_f1 FROM n",
)
def macro_f1(spark, d):
    """Mean of the f1 of confirmed against inferred and inferred against predicted relationships."""
    r = _relationships(spark, d)
    of = lambda s: r.filter(F.col("status") == s).select("src", "type", "tgt")
    return evidence.macro_f1(evidence.f1_scores(of("CONFIRMED"), of("INFERRED")).unionByName(evidence.f1_scores(of("INFERRED"), of("PREDICTED"))))


@query("category_counts", "SELECT case_id, entity_type, count(*) AS n FROM entities GROUP BY 1, 2")
def category_counts(spark, d):
    return table(spark, d, "entities").groupBy("case_id", "entity_type").agg(F.count("*").alias("n"))


@query(
    "capped_confidence",
    f"WITH {_ENT}, {_REL}, o AS (SELECT node, 0.5 + (length(name) % 50) / 100.0 AS c FROM ent) SELECT rel_id, CASE WHEN s.c IS NULL OR t.c IS NULL THEN confidence ELSE round(least(confidence, s.c::DOUBLE, t.c::DOUBLE), 4) END AS capped FROM rel LEFT JOIN o s ON s.node = src LEFT JOIN o t ON t.node = tgt",
)
def capped_confidence(spark, d):
    """Relationships never surer than their ends, the ends' confidence being made up from the length of their names."""
    m = _entities(spark, d).select(F.lit(1).alias("doc"), F.col("node").alias("mention_id"), (F.lit(0.5) + F.pmod(F.length("name"), F.lit(50)) / F.lit(100.0)).alias("confidence"))
    return evidence.cap_by_ends(_relationships(spark, d).drop("doc").withColumn("doc", F.lit(1)), m).select("rel_id", "capped")


@query("kpi_counts", "SELECT case_id, count(*) AS calls, count(DISTINCT caller) AS callers, count(*) FILTER (WHERE duration > 600) AS long_calls FROM calls GROUP BY 1")
def kpi_counts(spark, d):
    return table(spark, d, "calls").groupBy("case_id").agg(F.count("*").alias("calls"), F.count_distinct("caller").alias("callers"), F.count_if(F.col("duration") > 600).alias("long_calls"))


# --- text ----------------------------------------------------------------------------------------------------------------


@query("phone_match_norm", f"SELECT {_phone('caller')} AS phone, count(*) AS n FROM calls GROUP BY 1")
def phone_match_norm(spark, d):
    return table(spark, d, "calls").groupBy(text.match_phone(F.col("caller")).alias("phone")).agg(F.count("*").alias("n"))


@query("org_norm", f"SELECT canonical_name AS name, {_ORG_NORM.format('canonical_name')} AS norm FROM entities WHERE entity_type = 'ORGANIZATION'")
def org_norm(spark, d):
    e = table(spark, d, "entities").filter("entity_type = 'ORGANIZATION'")
    return e.select(F.col("canonical_name").alias("name"), text.match_org(F.col("canonical_name")).alias("norm"))


@query("location_norm", f"SELECT location, {_LOC} AS norm, count(*) AS n FROM calls GROUP BY 1, 2")
def location_norm(spark, d):
    return table(spark, d, "calls").groupBy("location", text.match_location(F.col("location")).alias("norm")).agg(F.count("*").alias("n"))


_HINTS = ", ".join(
    "{'s': -(" + " + ".join(f"contains(h, '{t}')::INT" for t in tokens) + f"), 'n': '{name}'}}" for name, tokens in sorted(text.DOCUMENT_TOKENS.items())
)


@query("doc_type_hint", f"WITH h AS (SELECT doc_id, lower(coalesce(filename, '') || chr(10) || coalesce(text, '')) AS h FROM documents), s AS (SELECT doc_id, list_min([{_HINTS}]) AS b FROM h) SELECT doc_id, CASE WHEN b.s < 0 THEN b.n ELSE 'GENERIC_EVIDENCE' END AS document_type FROM s")
def doc_type_hint(spark, d):
    return table(spark, d, "documents").select("doc_id", text.document_type(F.col("text"), F.col("filename")).alias("document_type"))


@query("text_normalised", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[\\t\\x0b\\f\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s]+|[\\s]+$', '', 'g') AS text FROM documents")
def text_normalised(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query("text_chunks", "SELECT doc_id, i AS start_char, substr(text, i + 1, 9000) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1000, 1), 8000)) AS i FROM documents WHERE text IS NOT NULL)")
def text_chunks(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("k", "piece"))
    return t.select("doc_id", (F.col("k") * 8000).cast("bigint").alias("start_char"), "piece")


@query("mention_counts")
def mention_counts(spark, d):
    """Mentions found in all documents, by type."""
    return extraction.mentions(_texts(spark, d)).groupBy("etype").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query("rejected_candidates")
def rejected_candidates(spark, d):
    c = extraction.classify(extraction.candidates(_texts(spark, d)))
    return c.groupBy("reason", "accepted").agg(F.count("*").alias("n"))


@query("text_relationships")
def text_relationships(spark, d):
    """Relationships read from the sentences of all documents."""
    docs = _texts(spark, d)
    found = materialise(extraction.mentions(docs))
    return relations.number_relations(relations.text_relations(docs, found), _no_records(found)).select("doc", "rel_id", "src", "type", "tgt", "confidence", "status", "snippet")


def _no_records(found: DataFrame) -> DataFrame:
    kind = found.schema["doc"].dataType.simpleString()
    return found.sparkSession.createDataFrame([], f"doc {kind}, src string, type string, tgt string, confidence double, status string, record string, snippet string")


@query(
    "record_relationships",
    f"WITH vc AS (SELECT * FROM (SELECT *, {_CALL_REJECT} AS reject FROM calls) WHERE reject IS NULL AND case_id IS NOT NULL), r AS (SELECT case_id, {_made_id('cdr', 'caller', 'callee', 'call_time', '')} AS record, {_phone('caller')} AS s, {_phone('callee')} AS t FROM vc), "
    "n AS (SELECT DISTINCT case_id, s AS name FROM r WHERE trim(s) <> '' UNION SELECT case_id, t FROM r WHERE trim(t) <> ''), m AS (SELECT case_id, name, 'mention_' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, '0') AS id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY name) AS i FROM n)) "
    "SELECT r.case_id AS doc, a.id AS src, 'CALLED' AS type, b.id AS tgt, 0.98::DOUBLE AS confidence, 'CONFIRMED' AS status, min(r.record) AS record FROM r JOIN m a ON a.case_id = r.case_id AND a.name = r.s JOIN m b ON b.case_id = r.case_id AND b.name = r.t WHERE a.id <> b.id GROUP BY 1, 2, 4",
)
def record_relationships(spark, d):
    """Who called whom in each case, from its valid calls, between the mentions that the records' own parties give."""
    c = validation.lenient(validation.check_calls(table(spark, d, "calls"))).filter("case_id is not null")
    record = patterns.record_key(F.col("record_id"), "cdr", F.col("caller"), F.col("callee"), F.col("call_time"), "")
    records = c.select(F.col("case_id").alias("doc"), record.alias("record"), text.match_phone(F.col("caller")).alias("source"), text.match_phone(F.col("callee")).alias("target"), F.lit(None).cast("string").alias("what"))
    nobody = records.select("doc", F.col("source").alias("name")).limit(0)
    found = patterns.numbered(relations.record_stubs(records, nobody, "CDR"), "mention", ["name"], ["doc"], "mention_id")
    return relations.record_relations(records, found, "CDR").drop("snippet")


@query("evidence_blocks")
def evidence_blocks(spark, d):
    return extraction.evidence_blocks(_texts(spark, d))


@query("phone_mentions")
def phone_mentions(spark, d):
    return extraction.candidates(_texts(spark, d)).filter("etype = 'PHONE'").select("doc", "name", "confidence")


# --- resolution ----------------------------------------------------------------------------------------------------------


def _mention_attributes(spark, d) -> DataFrame:
    e = _entities(spark, d)
    return resolution.attributes(e.withColumnRenamed("case_id", "grp"), _edges(spark, d))


@query("resolution_pairs")
def resolution_pairs(spark, d):
    """Pairs of a case's entities that may be one, with confidence and signals."""
    return resolution.compare(_mention_attributes(spark, d))


@query("resolution_proposals")
def resolution_proposals(spark, d):
    return resolution.propose(materialise(resolution.compare(_mention_attributes(spark, d))))


@query("consolidated_edges")
def consolidated_edges(spark, d):
    merged = resolution.propose(materialise(resolution.compare(_mention_attributes(spark, d))), 0.85)
    edges = _relationships(spark, d).withColumnRenamed("rel_id", "edge_id").select("edge_id", "src", "tgt", "type", "confidence", "status")
    return resolution.consolidate(_entities(spark, d), edges, merged)[1]


@query("equivalent_entities")
def equivalent_entities(spark, d):
    """Pairs of a case's entities that the stricter rule holds to be one, with the better name."""
    return resolution.equivalent(_entities(spark, d).withColumnRenamed("case_id", "grp"))


# --- integrity -----------------------------------------------------------------------------------------------------------


@query("file_hash", "SELECT doc_id, sha256(text) AS data_hash FROM documents")
def file_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", integrity.content_hash(F.col("text")).alias("data_hash"))


def _ledger(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "case_id", "uploaded_at", "lang", integrity.content_hash(F.col("text")).alias("data_hash"))
    return integrity.build_ledger(docs, "doc_id", "doc_id", "data_hash", "case_id", "lang", "uploaded_at")


_BLOCK = (
    "sha256('{{\"actor\":\"' || actor || '\",\"block_index\":' || {i} || ',\"case_id\":\"' || case_id || '\",\"data_hash\":\"' || data_hash || '\",\"evidence_id\":\"' || evidence_id || '\",\"previous_hash\":\"' || {p} || '\",\"timestamp\":\"' || made_at || '\"}}')"
)


@query(
    "ledger_blocks",
    "WITH RECURSIVE it AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id::VARCHAR AS evidence_id, sha256(text) AS data_hash, coalesce(case_id, '') AS case_id, coalesce(lang, '') AS actor, coalesce(strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S.%fZ'), '') AS made_at FROM documents WHERE text IS NOT NULL), "
    "ch AS (SELECT i, evidence_id, data_hash, '0' AS previous_hash, case_id, actor, made_at, " + _BLOCK.format(i="i", p="'0'") + " AS block_hash FROM it WHERE i = 0 UNION ALL "
    "SELECT it.i, it.evidence_id, it.data_hash, ch.block_hash, it.case_id, it.actor, it.made_at, " + _BLOCK.replace("actor ||", "it.actor ||").replace("case_id ||", "it.case_id ||").replace("data_hash ||", "it.data_hash ||").replace("evidence_id ||", "it.evidence_id ||").replace("|| made_at ||", "|| it.made_at ||").format(i="it.i", p="ch.block_hash") + " FROM ch JOIN it ON it.i = ch.i + 1) "
    "SELECT i AS block_index, evidence_id, data_hash, previous_hash, case_id, actor, made_at, block_hash FROM ch",
)
def ledger_blocks(spark, d):
    """The ledger of all documents."""
    return _ledger(spark, d)


@query(
    "ledger_tampered",
    "WITH it AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS block_index FROM documents WHERE text IS NOT NULL), k AS (SELECT * FROM it WHERE block_index % 11 <> 5) SELECT block_index, block_index % 7 <> 3 AS own_ok, block_index = 0 OR block_index - 1 IN (SELECT block_index FROM k) AS link_ok FROM k",
)
def ledger_tampered(spark, d):
    """What verification tells of the ledger once the data hash of every seventh block is changed and every eleventh block is gone."""
    ledger = materialise(_ledger(spark, d)).filter("block_index % 11 <> 5")
    bad = ledger.withColumn("data_hash", F.when(F.col("block_index") % 7 == 3, F.reverse("data_hash")).otherwise(F.col("data_hash")))
    return integrity.verify_ledger(bad)


@query(
    "network_fingerprint",
    f"WITH {_ENT}, {_REL}, e AS (SELECT case_id, count(*) AS n, string_agg(node || ':' || coalesce(name, 'None') || ':' || coalesce(etype, 'None'), ';' ORDER BY node) AS s FROM ent GROUP BY 1), "
    "r AS (SELECT case_id, count(*) AS n, string_agg(rel_id::VARCHAR || ':' || coalesce(src, 'None') || ':' || coalesce(tgt, 'None') || ':' || coalesce(status, 'None'), ';' ORDER BY rel_id::VARCHAR) AS s FROM rel GROUP BY 1), "
    "d AS (SELECT case_id, count(*) AS n, string_agg(doc_id::VARCHAR || ':' || coalesce(filename, 'None'), ';' ORDER BY doc_id::VARCHAR) AS s FROM documents GROUP BY 1), c AS (SELECT case_id FROM e UNION SELECT case_id FROM r UNION SELECT case_id FROM d) "
    "SELECT case_id, left(sha256('mode=full#ENT(' || coalesce(e.n, 0) || '):' || coalesce(e.s, '') || '#REL(' || coalesce(r.n, 0) || '):' || coalesce(r.s, '') || '#DOC(' || coalesce(d.n, 0) || '):' || coalesce(d.s, '')), 24) AS fingerprint, "
    "coalesce(e.n, 0) AS entities_count, coalesce(r.n, 0) AS relationships_count, coalesce(d.n, 0) AS documents_count FROM c LEFT JOIN e USING (case_id) LEFT JOIN r USING (case_id) LEFT JOIN d USING (case_id) WHERE case_id IS NOT NULL",
)
def network_fingerprint(spark, d):
    """Fingerprints of the cases over their entities, relationships and documents."""
    e = _entities(spark, d).withColumnRenamed("node", "id")
    r = _relationships(spark, d).select("case_id", F.col("rel_id").alias("id"), "src", "tgt", "status")
    return integrity.network_fingerprint(e, r, table(spark, d, "documents").select("case_id", F.col("doc_id").alias("id"), "filename"))


@query("record_fingerprints", "SELECT call_no, sha256(concat_ws('|', call_no::VARCHAR, 'CDR', 'call_time=' || call_time, 'callee=' || callee, 'caller=' || caller)) AS fp FROM calls")
def record_fingerprints(spark, d):
    c = table(spark, d, "calls")
    return c.select("call_no", integrity.record_fingerprint(F.col("call_no"), F.lit("CDR"), {k: F.col(k) for k in ("caller", "callee", "call_time")}).alias("fp"))
