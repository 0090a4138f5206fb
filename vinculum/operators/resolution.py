"""Entity resolution: blocked comparison of mentions, proposals by connected components, case memory, consolidation.

Blocking keys lose no match: equal identifiers and names meet on the equal key, persons on the first word of the name or an
alias, organisations on equal names and acronyms, and on the rarest 3-gram of a name that another one may hold.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinculum.functions import text
from vinculum.operators.components import connected_components

ATTRIBUTES = ["phones", "accounts", "vehicles", "orgs", "locations"]


def same_name(a: str, b: str) -> bool:
    """Whether two normal person names may be one: equal first words and an abbreviated, shortened or similar rest."""
    x, y = a.replace(".", "").split(), b.replace(".", "").split()
    if not x or not y or x[0] != y[0]:
        return False
    short, long = sorted((x, y), key=len)
    if len(short) == 1 or long[: len(short)] == short:
        return True
    if len(x) == len(y) and (len(x[1]) == 1 and y[1].startswith(x[1]) or len(y[1]) == 1 and x[1].startswith(y[1])):
        return True
    return SequenceMatcher(None, a, b).ratio() >= 0.85


@F.pandas_udf(T.BooleanType())
def similar_names(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bool(x and y and same_name(x, y)) for x, y in zip(a, b)], dtype="bool")


@F.pandas_udf(T.BooleanType())
def similar_aliases(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(xs, ys):
        if xs is None or ys is None or max(len(xs), len(ys)) < 2:
            return False
        return any(x == y or len(x.split()) > 1 and len(y.split()) > 1 and same_name(x, y) for x in xs for y in ys)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="bool")


def attributes(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(grp, node, phones, accounts, vehicles, orgs, locations): normal names of the neighbours of each type.

    mentions: grp, node, etype, name; edges: src, tgt."""
    other = mentions.select(F.col("node").alias("other"), F.col("etype").alias("_e"), F.col("name").alias("_n"))
    both = edges.select(F.col("src").alias("node"), F.col("tgt").alias("other")).unionByName(edges.select(F.col("tgt").alias("node"), F.col("src").alias("other")))
    n = both.join(other, "other")
    kinds = {"phones": ("PHONE", text.match_phone), "accounts": ("BANK_ACCOUNT", text.match_account), "vehicles": ("VEHICLE", text.match_vehicle), "orgs": ("ORGANIZATION", text.match_org), "locations": ("LOCATION", text.match_location)}
    sets = n.groupBy("node").agg(*[F.array_sort(F.collect_set(F.when(F.col("_e") == k, f(F.col("_n"))))).alias(c) for c, (k, f) in kinds.items()])
    none = F.array().cast("array<string>")
    return mentions.join(sets, "node", "left").select("grp", "node", "etype", "name", *[F.coalesce(c, none).alias(c) for c in ATTRIBUTES])


def _acronym(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), "")


def _keys(m: DataFrame) -> DataFrame:
    """Mentions with normal name ``norm``, alias names ``parts`` and an array of blocking keys."""
    n, e = F.col("name"), F.col("etype")
    norm = (
        F.when(e == "PHONE", text.match_phone(n)).when(e == "BANK_ACCOUNT", text.match_account(n)).when(e == "VEHICLE", text.match_vehicle(n))
        .when(e == "ORGANIZATION", text.match_org(n)).when(e == "LOCATION", text.match_location(n)).when(e == "PERSON", text.match_person(n)).otherwise(F.lower(F.trim(n)))
    )
    parts = F.transform(text.alias_parts(n), lambda p: text.match_person(p))
    m = m.withColumn("norm", norm).withColumn("parts", F.when(e == "PERSON", parts)).withColumn("acr", F.when(e == "ORGANIZATION", _acronym(F.col("norm"))))
    first = lambda c: F.split(F.regexp_replace(c, r"\.", ""), " ")[0]
    person = F.array_distinct(F.concat(F.array(first(F.col("norm"))), F.transform("parts", lambda p: first(p))))
    org = F.array_distinct(F.filter(F.array(F.col("norm"), F.when(F.length("acr") >= 2, F.col("acr"))), lambda k: k.isNotNull()))
    return m.withColumn("keys", F.when(e == "PERSON", person).when(e == "ORGANIZATION", org).otherwise(F.array("norm")))


def _contained(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
    """(grp, etype, x, y) of organisations of one group of which one's normal name holds the other's, without comparing all.

    A name that is held has all its 3-grams in the holder; the one that the fewest names of the group have is the join key.
    Names of one or two letters are their own key.
    """
    side = lambda df: df.filter("etype = 'ORGANIZATION' and norm <> ''").select("grp", "etype", F.struct("node", "norm", "parts", "acr", *ATTRIBUTES).alias("z"), "norm")

    def grams(q: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("norm") - q + 1, F.lit(1))), lambda i: F.substring("norm", i, F.lit(q))))

    def held(holders: DataFrame, shorter: DataFrame) -> DataFrame:
        index = side(holders).select("grp", "etype", F.col("z").alias("big"), F.explode(F.array_union(F.array_union(grams(1), grams(2)), grams(3))).alias("q"))
        often = index.groupBy("grp", "q").agg(F.count("*").alias("n"))
        own = side(shorter).withColumn("q", F.explode(F.when(F.length("norm") < 3, F.array("norm")).otherwise(grams(3))))
        rare = own.join(often, ["grp", "q"]).groupBy("grp", "etype", "z").agg(F.min(F.struct("n", "q")).alias("m"))
        rare = rare.select("grp", "etype", F.col("z").alias("small"), F.col("m.q").alias("q"))
        return rare.join(index, ["grp", "etype", "q"]).filter(F.col("big.norm").contains(F.col("small.norm")) & (F.col("big.node") != F.col("small.node"))).drop("q")

    if same:
        found = held(left, left)
        first = F.col("small.node") < F.col("big.node")
        return found.select("grp", "etype", F.when(first, F.col("small")).otherwise(F.col("big")).alias("x"), F.when(first, F.col("big")).otherwise(F.col("small")).alias("y"))
    one = held(right, left).select("grp", "etype", F.col("small").alias("x"), F.col("big").alias("y"))
    return one.unionByName(held(left, right).select("grp", "etype", F.col("big").alias("x"), F.col("small").alias("y")))


def compare(mentions: DataFrame, known: DataFrame | None = None, contained: bool = True, fuzzy: bool = True) -> DataFrame:
    """(grp, a, b, confidence, signals): pairs of mentions of one group that may be one entity.

    ``mentions``: output of ``attributes``; with ``known``, of the same columns, each mention is compared with the known ones
    instead of with each other (a is the mention). ``contained`` also finds organisations by containment of names; ``fuzzy`` allows person names that are merely similar.
    """
    left = _keys(mentions)
    right = left if known is None else _keys(known)
    side = lambda df, s: df.select("grp", "etype", F.struct("node", "norm", "parts", "acr", *ATTRIBUTES).alias(s), F.explode("keys").alias("k"))
    pairs = side(left, "x").join(side(right, "y"), ["grp", "etype", "k"])
    if contained:
        inside = _contained(left, right, known is None)
        pairs = pairs.drop("k").unionByName(inside)
    pairs = pairs.filter(F.col("x.node") < F.col("y.node")) if known is None else pairs
    pairs = pairs.select("grp", "etype", "x", "y").dropDuplicates(["grp", "x", "y"])
    e, a, b = F.col("etype"), F.col("x.norm"), F.col("y.norm")
    apart = lambda c: (F.size(f"x.{c}") > 0) & (F.size(f"y.{c}") > 0) & ~F.arrays_overlap(f"x.{c}", f"y.{c}")
    shared = {c: F.arrays_overlap(f"x.{c}", f"y.{c}") for c in ATTRIBUTES}
    exact = a == b
    alias = similar_aliases(F.col("x.parts"), F.col("y.parts"))
    like = similar_names(a, b) if fuzzy else F.lit(False)
    p = pairs.withColumn("_exact", exact).withColumn("_alias", F.when(e == "PERSON", alias).otherwise(False)).withColumn("_like", F.when(e == "PERSON", like).otherwise(False))
    strong, weak = shared["phones"] | shared["accounts"], shared["vehicles"] | shared["orgs"]
    person = F.when(apart("phones") | apart("accounts"), None).when(
        F.col("_exact") | F.col("_alias"), F.when(strong, 0.98).when(weak | shared["locations"], 0.92).when(F.col("_alias"), 0.88).otherwise(0.80)
    ).when(F.col("_like"), F.when(strong, 0.90).when(weak, 0.85).otherwise(0.60))
    org = F.when((a != "") & (b != ""), F.when(exact, 0.90).otherwise(0.88))
    conf = F.when(e == "PERSON", person).when(e == "ORGANIZATION", org).when((a == "") | ~exact, None).when(e == "LOCATION", 0.85).when(e == "EVENT", 0.80).otherwise(0.95)
    names = {"phones": "PHONE_MATCH", "accounts": "ACCOUNT_MATCH", "vehicles": "VEHICLE_MATCH", "orgs": "ORGANIZATION_MATCH", "locations": "LOCATION_MATCH"}
    persons = F.concat(F.array(F.lit("NAME_SIMILARITY")), F.filter(F.array(*[F.when(shared[c], s) for c, s in names.items()]), lambda x: x.isNotNull()))
    single = F.when(e == "PHONE", "PHONE_MATCH").when(e == "BANK_ACCOUNT", "ACCOUNT_MATCH").when(e == "VEHICLE", "VEHICLE_MATCH").when(e == "ORGANIZATION", "ORGANIZATION_MATCH").when(e == "LOCATION", "LOCATION_MATCH").otherwise("NAME_SIMILARITY")
    p = p.withColumn("confidence", conf).filter("confidence is not null")
    return p.select("grp", F.col("x.node").alias("a"), F.col("y.node").alias("b"), "confidence", F.when(e == "PERSON", persons).otherwise(F.array(single)).alias("signals"))


def propose(pairs: DataFrame, least: float = 0.70) -> DataFrame:
    """(node, root, confidence, signals): proposals of the components of pairs from ``least`` on: each node with the root, its
    highest incident confidence and all its signals."""
    strong = pairs.filter(F.col("confidence") >= least)
    ends = strong.select(F.explode(F.array("a", "b")).alias("node"), "confidence", "signals")
    facts = ends.groupBy("node").agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"))
    return connected_components(strong).join(facts, "node")


def memory_links(mentions: DataFrame, canonical: DataFrame, least: float = 0.70) -> DataFrame:
    """(a, b, confidence, signals, needs_review): new mentions against known entities; a shared phone, account or vehicle needs
    no review. In the order of mention, falling confidence and known entity."""
    sure = F.arrays_overlap("signals", F.array(*map(F.lit, ["PHONE_MATCH", "ACCOUNT_MATCH", "VEHICLE_MATCH"])))
    return compare(mentions, canonical).filter(F.col("confidence") >= least).withColumn("needs_review", ~sure).orderBy("a", F.col("confidence").desc(), "b")


def consolidate(nodes: DataFrame, edges: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after merging (node, root): edges are repointed, resolved self-loops dropped, and of resolved edges with
    equal ends and type the most confident kept (ties to the smallest id); edges with a null end all stay.

    nodes: node, ...; edges: edge_id, src, tgt, type, confidence, ... ."""
    to = merged.select("node", "root").filter("node <> root")
    left = nodes.join(to.select("node"), "node", "left_anti")
    for side in ("src", "tgt"):
        edges = edges.join(to.select(F.col("node").alias(side), F.col("root").alias("_r")), side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    whole = F.col("src").isNotNull() & F.col("tgt").isNotNull()
    best = W.partitionBy("src", "tgt", "type").orderBy(F.col("confidence").desc(), "edge_id")
    kept = edges.filter(whole & (F.col("src") != F.col("tgt"))).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return left, kept.unionByName(edges.filter(~F.coalesce(whole, F.lit(False))).select(*kept.columns))


@F.pandas_udf(T.StringType())
def titled(name: pd.Series) -> pd.Series:
    """Each run of letters capitalised; null stays null."""
    return name.map(lambda n: None if n is None else n.title())


def storage_key(name: Column, kind: Column) -> Column:
    """Identifier as stored: phones keep plus and digits, accounts lose blanks, vehicles too in upper case."""
    stored = text.storage_identifier(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), kind)
    return F.when(kind == "VEHICLE", F.upper(stored)).otherwise(stored)


def equivalent(entities: DataFrame) -> DataFrame:
    """(grp, a, b, best_name): entities (grp, node, etype, name) of one group and type that the stricter rule holds to be one.

    Identifiers by their stored form, places and organisations by normal name (organisations by acronym, too, never by
    containment), events without case. Persons by alias, normal name, or equal first word and one name beginning with the
    other; a single first name only where at most one full name of the group begins with it. The longer name is the best.
    """
    n, e = F.col("name"), F.col("etype")
    strong = e.isin("PHONE", "BANK_ACCOUNT", "VEHICLE")
    norm = F.when(strong, storage_key(n, e)).when(e == "LOCATION", text.match_location(n)).when(e == "ORGANIZATION", text.match_org(n)).when(e == "PERSON", text.match_person(n)).otherwise(F.lower(F.trim(n)))
    m = entities.select("grp", "node", "etype", "name", norm.alias("norm")).filter("norm is not null")
    m = m.withColumn("acr", F.when(e == "ORGANIZATION", _acronym(F.col("norm")))).withColumn("parts", F.when(e == "PERSON", F.transform(text.alias_parts(n), lambda p: text.match_person(p))))
    word = F.split("norm", " ")
    m = m.withColumn("words", F.when(e == "PERSON", F.size(word)))
    person = F.array_distinct(F.concat(F.array(word[0]), F.transform("parts", lambda p: p)))
    org = F.array_distinct(F.filter(F.array(F.col("norm"), F.when(F.length("acr") >= 2, F.col("acr"))), lambda k: k.isNotNull()))
    m = m.withColumn("k", F.explode(F.filter(F.when(e == "PERSON", person).when(e == "ORGANIZATION", org).otherwise(F.array("norm")), lambda k: k != "")))
    full = m.filter("etype = 'PERSON' and words >= 2").groupBy("grp", F.split("norm", " ")[0].alias("first")).agg(F.count_distinct("norm").alias("fulls"))
    cols = ["node", "name", "norm", "acr", "parts", "words"]
    x, y = m.select("grp", "etype", "k", F.struct(*cols).alias("x")), m.select("grp", "etype", "k", F.struct(*cols).alias("y"))
    p = x.join(y, ["grp", "etype", "k"]).filter("x.node < y.node").drop("k").dropDuplicates(["grp", "x", "y"])
    p = p.withColumn("first", F.split("x.norm", " ")[0]).join(full, ["grp", "first"], "left")
    a, b = F.col("x.norm"), F.col("y.norm")
    alias = ((F.size("x.parts") > 1) | (F.size("y.parts") > 1)) & F.exists("x.parts", lambda q: F.array_contains("y.parts", q) & (q != ""))
    heads = (F.split(a, " ")[0] == F.split(b, " ")[0]) & (a != "") & (b != "")
    begins = F.concat(a, F.lit(" ")).startswith(F.concat(b, F.lit(" "))) | F.concat(b, F.lit(" ")).startswith(F.concat(a, F.lit(" ")))
    both_full = (F.col("x.words") >= 2) & (F.col("y.words") >= 2)
    single = (F.col("x.words") == 1) != (F.col("y.words") == 1)
    human = F.coalesce(alias, F.lit(False)) | ((a == b) & (a != "")) | (heads & begins & (both_full | (single & (F.coalesce("fulls", F.lit(0)) <= 1))))
    kin = F.when(e == "PERSON", human).when(e == "ORGANIZATION", F.lit(True)).otherwise(a == b)
    longer = F.when(F.length("x.name") >= F.length("y.name"), F.col("x.name")).otherwise(F.col("y.name"))
    best = F.when((e == "PERSON") & (a == b) & ~F.coalesce(alias, F.lit(False)), titled(a)).when(strong, a).when(e == "EVENT", F.col("x.name")).otherwise(longer)
    return p.filter(kin).select("grp", F.col("x.node").alias("a"), F.col("y.node").alias("b"), best.alias("best_name"))


def resolve_canonical(new: DataFrame, known: DataFrame) -> DataFrame:
    """New mentions (grp, node, etype, name, existing) with ``entity``: the existing entity, else the smallest equivalent known one
    of the group, else the oldest known one anywhere with the same stored identifier, else a minted id.

    known: grp, node, etype, name, created_at. Minted ids are the same for the same type and stored name."""
    key = storage_key(F.col("name"), F.col("etype"))
    fresh = new.filter("existing is null").select("grp", F.concat(F.lit("~"), "node").alias("node"), "etype", "name")
    pairs = equivalent(known.select("grp", "node", "etype", "name").unionByName(fresh))
    local = pairs.filter(F.col("b").startswith("~") & ~F.col("a").startswith("~")).groupBy("grp", F.substring("b", 2, 1_000_000).alias("node")).agg(F.min("a").alias("_local"))
    strong = known.filter(F.col("etype").isin("PHONE", "BANK_ACCOUNT", "VEHICLE")).groupBy("etype", key.alias("_key")).agg(F.min(F.struct("created_at", "node")).alias("m"))
    rows = new.withColumn("_key", key).join(local, ["grp", "node"], "left").join(strong.select("etype", "_key", F.col("m.node").alias("_global")), ["etype", "_key"], "left")
    minted = F.left(F.sha2(F.concat_ws("|", "etype", "_key"), 256), F.lit(32))
    return rows.select(*new.columns, F.coalesce("existing", "_local", "_global", minted).alias("entity"))
