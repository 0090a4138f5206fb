"""Integrity: content hashes, hash-linked ledger, network fingerprints, idempotent writes, audit trail."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0"


def content_hash(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, lower-case hex; null stays null."""
    return F.sha2(text, 256)


def block_payload(index: int, evidence: str, data_hash: str, previous: str, case: str, actor: str, at: str) -> str:
    """Canonical JSON of a block: keys in order, no blanks, other signs than ASCII escaped; the data hash in lower case."""
    block = {"actor": actor, "block_index": index, "case_id": case, "data_hash": data_hash.lower(), "evidence_id": evidence, "previous_hash": previous, "timestamp": at}
    return json.dumps(block, sort_keys=True, separators=(",", ":"))


def _block_hash(*parts) -> str:
    return hashlib.sha256(block_payload(*parts).encode()).hexdigest()


LEDGER = "block_index bigint, evidence_id string, data_hash string, previous_hash string, case_id string, actor string, made_at string, block_hash string"


def build_ledger(items: DataFrame, order: str, evidence: str, data_hash: str, case: str | None = None, actor: str | None = None, at: str | None = None) -> DataFrame:
    """(block_index, evidence_id, data_hash, previous_hash, case_id, actor, made_at, block_hash): one chained block per item in ``order``.

    ``case``, ``actor`` and ``at`` (a timestamp, in UTC with microseconds and Z) are columns; without one the text is empty. A
    block's hash covers its predecessor's, so the chain is sequential by nature: the items, a few short columns each, pass
    through one ordered task that streams them batch by batch and keeps one hash. Items without hash are left out; of repeated
    evidence the first counts.
    """
    first = W.partitionBy(evidence).orderBy(order)
    rows = items.filter(F.col(data_hash).isNotNull()).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    time = F.coalesce(F.date_format(F.col(at).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("")) if at else F.lit("")
    rows = rows.select(F.col(order).alias("_o"), F.col(evidence).cast("string").alias("e"), F.lower(F.col(data_hash)).alias("h"), text(case).alias("c"), text(actor).alias("a"), time.alias("t"))
    rows = rows.repartition(1).sortWithinPartitions("_o")

    def chain(frames):
        previous, index = GENESIS, 0
        for f in frames:
            out = []
            for e, h, c, a, t in zip(f["e"], f["h"], f["c"], f["a"], f["t"]):
                block = _block_hash(index, e, h, previous, c, a, t)
                out.append((index, e, h, previous, c, a, t, block))
                previous, index = block, index + 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])

    return rows.mapInPandas(chain, LEDGER)


def verify_ledger(ledger: DataFrame) -> DataFrame:
    """(block_index, own_ok, link_ok): the block's own hash, and its link to the predecessor; both for every block at once.

    The predecessor is joined by index, so blocks are checked in parallel and a gap shows as a broken link.
    """
    names = ["block_index", "evidence_id", "data_hash", "previous_hash", "case_id", "actor", "made_at", "block_hash"]

    def check(frames):
        for f in frames:
            own = [None not in r[:7] and _block_hash(int(r[0]), *r[1:7]) == r[7] for r in zip(*[f[n] for n in names])]
            yield pd.DataFrame({"block_index": f["block_index"], "previous_hash": f["previous_hash"], "own_ok": own})

    own = ledger.select(*names).mapInPandas(check, "block_index bigint, previous_hash string, own_ok boolean")
    before = ledger.select((F.col("block_index") + 1).alias("block_index"), F.col("block_hash").alias("_p"))
    link = F.when(F.col("block_index") == 0, F.col("previous_hash") == GENESIS).otherwise(F.coalesce(F.col("previous_hash") == F.col("_p"), F.lit(False)))
    return own.join(before, "block_index", "left").select("block_index", "own_ok", link.alias("link_ok"))


def verify_documents(ledger: DataFrame, current: DataFrame, key: str, data_hash: str) -> DataFrame:
    """(``key``, anchored, verified): whether a document has a block, and whether that block and the current hash agree."""
    checks = ledger.join(verify_ledger(ledger), "block_index").select(F.col("evidence_id").alias("_e"), F.col("data_hash").alias("_h"), (F.col("own_ok") & F.col("link_ok")).alias("_ok"))
    c = current.select(F.col(key), F.col(data_hash).alias("_now")).join(checks, F.col(key).cast("string") == F.col("_e"), "left")
    return c.select(key, F.col("_e").isNotNull().alias("anchored"), F.coalesce(F.col("_ok") & (F.col("_h") == F.col("_now")), F.lit(False)).alias("verified"))


def latest_block(ledger: DataFrame) -> DataFrame:
    """The block of highest index; no row for an empty ledger."""
    return ledger.agg(F.max_by(F.struct(*ledger.columns), "block_index").alias("b")).filter("b is not null").select("b.*")


def network_fingerprint(entities: DataFrame, relationships: DataFrame, documents: DataFrame, group: str = "case_id", mode: str = "mode=full") -> DataFrame:
    """(``group``, fingerprint, entities_count, relationships_count, documents_count): the first 24 hex digits of the SHA-256 of a
    group's sorted signature, which changes with any of its entities, relationships and documents.

    entities: group, id, name, etype; relationships: group, id, src, tgt, status; documents: group, id, filename; parts are joined as
    texts, null as None, in the order of the id as text. A hash of ordered text is sequential within a group by nature: the
    tokens, sorted by the shuffle, stream through one digest, and no group is ever held as a whole.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    part = lambda df, k, *cols: df.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.lit(k).alias("part"), text("id").alias("id"), F.concat_ws(":", text("id"), *map(text, cols)).alias("token"))
    tokens = part(entities, 0, "name", "etype").unionByName(part(relationships, 1, "src", "tgt", "status")).unionByName(part(documents, 2, "filename"))
    counts = tokens.groupBy("g").agg(*[F.count_if(F.col("part") == k).alias(f"n{k}") for k in range(3)])
    rows = tokens.join(counts, "g").repartition("g").sortWithinPartitions("g", "part", "id", "token")

    def digest(frames):
        group_, sha, at, n = None, None, 0, (0, 0, 0)
        heads = ("#ENT", "#REL", "#DOC")

        def close():
            for k in range(at + 1, 3):
                sha.update(f"{heads[k]}({n[k]}):".encode())
            return (group_, sha.hexdigest()[:24], *n)

        for f in frames:
            out = []
            for g, k, token, *sizes in zip(f["g"], f["part"], f["token"], f["n0"], f["n1"], f["n2"]):
                if sha is None or g != group_:
                    if sha is not None:
                        out.append(close())
                    group_, sha, at, n, first = g, hashlib.sha256(mode.encode()), -1, tuple(map(int, sizes)), True
                while at < k:
                    at += 1
                    sha.update(f"{heads[at]}({n[at]}):".encode())
                    first = True
                sha.update((token if first else f";{token}").encode())
                first = False
            yield pd.DataFrame(out, columns=["g", "fingerprint", "n0", "n1", "n2"])
        if sha is not None:
            yield pd.DataFrame([close()], columns=["g", "fingerprint", "n0", "n1", "n2"])

    found = rows.mapInPandas(digest, f"g {entities.schema[group].dataType.simpleString()}, fingerprint string, n0 bigint, n1 bigint, n2 bigint")
    return found.select(F.col("g").alias(group), "fingerprint", F.col("n0").alias("entities_count"), F.col("n1").alias("relationships_count"), F.col("n2").alias("documents_count"))


def changed(now: DataFrame, saved: DataFrame, group: str = "case_id") -> DataFrame:
    """(``group``, status) of the saved reports: hit if the fingerprint is the same, changed if not, miss if none is saved."""
    old = saved.select(group, F.col("fingerprint").alias("_f"))
    return now.join(old, group, "left").select(group, F.when(F.col("_f").isNull(), "miss").when(F.col("_f") == F.col("fingerprint"), "hit").otherwise("changed").alias("status"))


def record_fingerprint(doc: Column, kind: Column, fields: dict[str, Column]) -> Column:
    """SHA-256 of document, type and the sorted fields of a record; nulls count as absent."""
    parts = [F.concat(F.lit(f"{k}="), fields[k].cast("string")) for k in sorted(fields)]
    return F.sha2(F.concat_ws("|", doc.cast("string"), kind, *parts), 256)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows and those incoming ones whose key is new, each key once: repeating the call adds nothing."""
    fresh = incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest ``version`` for each key; incoming rows win ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = W.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_new")


def audit_trail(events: DataFrame, case: str) -> DataFrame:
    """A case's audit rows (case_id, created_at, id), newest first."""
    return events.filter(F.col("case_id") == case).orderBy(F.col("created_at").desc(), F.col("id").desc())
