"""Spellings of one person's or organisation's name, linked within a group such as a case.

Names are parsed into words with a role. The words of the whole corpus are banded by MinHash over padded q-grams, the bands
being chosen from the collision curve for a stated recall, and keyed by what is left without one or two letters; a rare word that is a slight misspelling of a common one takes its
place. Names that then agree in first and last word (persons) or in name and trade (organisations) are candidates; in each
candidate group the fullest and most frequent spelling is the centre of a star, and spellings whose Monge-Elkan similarity to
it suffices are its satellites. Initials, nicknames and acronyms join the one star of the group that they fit.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.llm.addresses import osa
from vinculum.operators.components import connected_components
from vinculum.session import materialise

#: Titles, the marks of a second name, the trades and legal forms of organisations with their abbreviations.
TITLES = {"shri", "sri", "smt", "shrimati", "mr", "mrs", "ms", "miss", "dr", "adv", "prof", "kum", "kumari", "km", "er", "capt", "late"}
ALIAS = re.compile(r"\s*(?:@|\balias\b|\ba\.?\s?k\.?\s?a\.?(?=\s)|\bknown as\b|\bnick\s?named\b|[(\[\"“”]+)\s*", re.I)
TRADES = {
    "exports": ["exp", "expts"], "imports": ["imp"], "finance": ["fin", "fnc"], "chemicals": ["chem", "chems"],
    "constructions": ["constr", "const", "cons"], "electronics": ["elec", "elect", "electr"], "jewellers": ["jwlrs", "jewel", "jlrs"],
    "foods": ["fds", "fd"], "traders": ["trdrs", "trd", "trading"], "textiles": ["tex", "text", "txtls"],
    "transport": ["transpt", "trans", "trpt", "tpt"], "logistics": ["log", "logs", "lgstcs"], "motors": ["mot", "mtrs"], "media": ["med"],
    "steel": ["stl"], "works": ["wks", "wrks"], "security": ["sec", "secy"], "services": ["svcs", "serv", "svc"],
    "industries": ["ind", "inds"], "enterprises": ["ent", "entp"], "agency": [], "stores": [], "hotels": [], "pharma": [],
}
LEGAL = {
    "private": ["pvt", "p"], "limited": ["ltd"], "llp": [], "company": ["co"], "sons": ["son"], "cooperative": ["coop", "co-op"],
    "society": ["soc"], "corporation": ["corp"], "brothers": ["bros"],
}
_TRADE_OF = {w: t for t, more in TRADES.items() for w in [t, *more]}
_LEGAL_OF = {w: t for t, more in LEGAL.items() for w in [t, *more]}
_ACRONYM = re.compile(r"^\s*([A-Z]{2,7})-([A-Z]{3})\s*$")


def plain(word: str) -> str:
    """A word's letters without accents and case."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if c.isalpha())


def plain_code(word: str) -> str:
    """As ``plain``, with digits, which tell organisations apart."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if c.isalnum())


def sounds(word: str) -> str:
    """A plain word with one letter for each of the spellings that stand for one sound."""
    s = word.replace("w", "v").replace("ee", "i").replace("oo", "u").replace("au", "o").replace("ph", "f")
    return re.sub(r"ck|c(?!h)|q", "k", s)


def distance(a: str, b: str, most: int = 3) -> int:
    """The least edit distance, a transposition counting once, of two plain words as typed, by their sounds, and by their sounds
    without doubled letters; words of different digits are never near."""
    if re.sub(r"\D", "", a) != re.sub(r"\D", "", b):
        return most + 1
    x, y = sounds(a), sounds(b)
    d = min(osa(a, b, most), osa(x, y, most))
    return min(d, osa(re.sub(r"(.)\1+", r"\1", x), re.sub(r"(.)\1+", r"\1", y), most))


def _trade(word: str, cache: dict = {}) -> str | None:  # noqa: B006
    if word not in cache:
        if len(cache) > 200_000:
            cache.clear()
        hit = _TRADE_OF.get(word)
        if hit is None and len(word) >= 4:
            close = [t for t in TRADES if len(t) >= 5 and osa(word, t, 2 if len(t) >= 8 else 1) <= (2 if len(t) >= 8 else 1)]
            hit = close[0] if len(close) == 1 else None
        cache[word] = hit
    return cache[word]


def _shortened(word: str) -> str | None:
    """The one trade that a word abbreviates by leaving letters out."""
    def within(t: str) -> bool:
        rest = iter(t)
        return t[0] == word[0] and all(c in rest for c in word)

    fits = [t for t in TRADES if 3 <= len(word) < len(t) and within(t)]
    return fits[0] if len(fits) == 1 else None


def parse(name: str) -> dict:
    """Kind ('P' person, 'O' organisation, 'A' acronym) and the parts of a name as typed."""
    out = {"kind": "P", "words": [], "nick": [], "base": "", "trade": "", "legal": "", "code": ""}
    m = _ACRONYM.match(name)
    if m:
        return out | {"kind": "A", "code": f"{m[1]}-{m[2]}".lower()}
    s = unicodedata.normalize("NFKD", name)
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"[\s​]+", " ", s).strip()
    firm = bool(re.match(r"(?i)m/s\b\.?", s))
    s = re.sub(r"(?i)^m/s\b\.?\s*", "", s)
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s)  # words run together
    low = re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", s.lower())  # l.l.p. is one word
    low = re.sub(r"\bco-op\b", "coop", low)
    words = [w.replace("'", "") for w in re.findall(r"[^\W_]+(?:'[^\W_]+)?", low)]
    trades = [(k, _trade(w)) for k, w in enumerate(words)]
    marks = [k for k, w in enumerate(words) if w in _LEGAL_OF and (len(w) > 1 or k > 0)]
    if firm or any(t for _, t in trades) or any(_LEGAL_OF[words[k]] not in ("sons",) and len(words[k]) > 1 for k in marks):
        legal = [_LEGAL_OF[words[k]] for k in marks]
        trades = [(k, t or (_shortened(words[k]) if k > 0 and k not in marks and words[k] not in ("the", "and") else None)) for k, t in trades]
        base = [w for k, w in enumerate(words) if not trades[k][1] and k not in marks and w not in ("the", "and", "n", "of")]
        trade = [t for _, t in trades if t]
        parts = [*(b[0] for b in base), *(t[0] for t in trade)]
        parts += ["a"] if legal and legal[-1] in ("company", "sons") else []
        parts += ["llp"[0] if x == "llp" else x[0] for x in legal]
        return out | {
            "kind": "O", "words": [], "base": "".join(map(plain_code, base)), "trade": " ".join(trade), "legal": " ".join(sorted(set(legal))),
            "code": f"{''.join(parts)}-{''.join(base)[:3]}" if legal else "",
        }
    pieces = [p for p in ALIAS.split(s) if p.strip()]
    take = lambda p: [w for w in re.findall(r"[^\W\d_]+", p.lower()) if w not in TITLES]
    main = take(pieces[0]) if pieces else []
    words, nick = [plain(w) for w in main], [plain(w) for p in pieces[1:] for w in take(p)]
    return out | {"words": [w for w in words if w], "nick": [w for w in nick if w]}


def collision(similarity: float, bands: int, rows: int) -> float:
    """Probability that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def tune_bands(similarity: float, recall: float, most: int = 96) -> tuple[int, int]:
    """Bands and rows from the collision curve: the most rows a band (fewest chance collisions) that still find pairs of the
    given similarity with the given recall within ``most`` hashes."""
    best = None
    for rows in range(1, 7):
        for bands in range(1, most // rows + 1):
            if collision(similarity, bands, rows) >= recall:
                best = (bands, rows)
                break
    if best is None:
        raise ValueError("no banding reaches that recall")
    return best


def _sound_columns() -> list:
    """The forms of column ``word`` that ``distance`` compares, as column expressions."""
    s = F.col("word")
    for spelling, letter in (("w", "v"), ("ee", "i"), ("oo", "u"), ("au", "o"), ("ph", "f")):
        s = F.replace(s, F.lit(spelling), F.lit(letter))
    s = F.regexp_replace(s, "ck|c(?!h)|q", "k")
    return [F.col("word"), s, F.regexp_replace(s, r"(.)\1+", "$1")]


def error_keys(word: str, errors: int) -> set[str]:
    """Keys of which two words within so many errors (1 or 2, a transposition counting once) have one in common.

    What is left of the word without up to so many letters. Long words have the same for one error of their first and their
    last eight letters, as two errors can't spoil both ends twice; of 18 and 19 letters they have both.
    """
    n, keys = len(word), set()
    if n < 20:
        keys = {word}
        for _ in range(errors):
            keys |= {w[:k] + w[k + 1 :] for w in keys for k in range(len(w))}
    if n >= 18:
        for mark, end in (("<", word[:8]), (">", word[::-1][:8])):
            keys |= {mark + end[:7]} | {mark + end[:k] + end[k + 1 :] for k in range(8)}
    return keys


def similar_words(words: DataFrame, similarity: float = 0.4, recall: float = 0.95, q: int = 2, by: str | None = None) -> DataFrame:
    """(a, b, d) for distinct words of the column ``word``, a <> b, both ways, within one error (two from seven letters on).

    Candidates share a MinHash band of their padded q-grams or an ``error_keys`` key of one of the forms that the distance
    compares, which finds every pair within the limit, however few q-grams a short word keeps; with ``by`` only words that meet
    in one group are compared. The distance counts a transposition once and is computed once for each pair of words.
    """
    bands, rows = tune_bands(similarity, recall)
    padded = F.concat(F.lit("#" * (q - 1)), F.col("word"), F.lit("#" * (q - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, F.lit(q)))

    def smallest(k: int):
        return F.array_min(F.transform("grams", lambda g: F.xxhash64(g, F.lit(k))))

    mins = [smallest(k) for k in range(bands * rows)]
    keys = F.array(*[F.xxhash64(F.lit(b), *mins[b * rows : (b + 1) * rows]) for b in range(bands)])
    distinct = words.filter("word <> ''").select("word").distinct()

    def spell(frames):
        for f in frames:
            errors = [2 if len(w) >= 7 else 1 for w in f["word"]]
            left = [sorted(set().union(*(error_keys(x, e) for x in set(forms)))) for forms, e in zip(f["s"], errors)]
            yield f.assign(left=left)

    formed = distinct.filter(F.length("word") >= 3).withColumn("grams", grams)
    formed = formed.select("word", F.array(*_sound_columns()).alias("s"), keys.alias("bands"))
    formed = formed.mapInPandas(spell, "word string, s array<string>, bands array<bigint>, left array<string>")
    left = F.transform("left", lambda x: F.xxhash64(x))
    banded = materialise(formed.select(F.struct("word", "s").alias("w"), F.array_union("bands", left).alias("keys")))
    if by:
        group = words.filter("word <> ''").select(F.col(by).alias("_g"), "word").distinct()
        banded = group.join(banded.withColumn("word", F.col("w.word")), "word").select("_g", "w", F.explode("keys").alias("band"))
    else:
        banded = banded.select(F.lit(0).alias("_g"), "w", F.explode("keys").alias("band"))
    a, b = banded.withColumnRenamed("w", "x"), banded.withColumnRenamed("w", "y")
    sizes = F.length("x.word"), F.length("y.word")
    pairs = a.join(b, ["_g", "band"]).filter(F.col("x.word") < F.col("y.word"))
    most = F.when(F.least(*sizes) >= 7, 2).otherwise(1)
    near = F.lit(False)
    for k in range(3):  # within twice the limit by plain edit distance, which counts a transposition as two
        near |= F.levenshtein(F.col("x.s")[k], F.col("y.s")[k], 4).between(0, 2 * most)
    pairs = pairs.filter(near).select(F.col("x.word").alias("a"), F.col("y.word").alias("b")).distinct()

    def verify(frames):
        for f in frames:
            rows = [(x, y, distance(x, y, 2)) for x, y in zip(f["a"], f["b"])]
            rows = [r for r in rows if r[2] <= (2 if min(len(r[0]), len(r[1])) >= 7 else 1) and min(len(r[0]), len(r[1])) >= 3]
            yield pd.DataFrame(rows, columns=["a", "b", "d"]).astype({"a": object, "b": object, "d": "int32"})

    found = materialise(pairs.mapInPandas(verify, "a string, b string, d int"))
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def common_spelling(words: DataFrame) -> DataFrame:
    """(g, word, main): for each word of (g, word, n), n being its names in the group, the spelling that stands for it there.

    That is the most frequent similar word of the same group, unless both are common in the corpus (at least four times and a
    tenth of the other) and differ in sound, as names that merely resemble each other are. Chains end at their last word.
    """
    words = materialise(words)
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("all")))
    near = similar_words(words, by="g")
    near = near.join(counts.select(F.col("word").alias("a"), F.col("all").alias("na")), "a").join(counts.select(F.col("word").alias("b"), F.col("all").alias("nb")), "b")
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    near = near.filter((F.col("d") == 0) | ~((low >= 4) & (low * 10 >= high)))
    own = words.select("g", F.col("word").alias("a"), F.col("n").alias("ga"))
    other = words.select("g", F.col("word").alias("b"), F.col("n").alias("gb"))
    pairs = own.join(near, "a").join(other, ["g", "b"])
    rank = lambda x: F.struct(F.col(f"n{x}"), F.col(f"g{x}"), F.col(x))
    best = pairs.filter(rank("b") > rank("a")).groupBy("g", "a").agg(F.max(F.struct(-F.col("d"), rank("b"))).alias("m"))
    best = best.select("g", F.col("a").alias("word"), F.col("m.col2.b").alias("main"))
    best = materialise(words.select("g", "word").join(best, ["g", "word"], "left").select("g", "word", F.coalesce("main", "word").alias("main")))
    while True:  # every jump doubles its length, until none moves; the rank grows along a chain, so there are no rings
        nxt = best.select("g", F.col("word").alias("main"), F.col("main").alias("m2"))
        best = materialise(best.join(nxt, ["g", "main"]).select("g", "word", F.col("m2").alias("main"), (F.col("m2") != F.col("main")).alias("moved")))
        moved = not best.filter("moved").isEmpty()
        best = best.drop("moved")
        if not moved:
            break
    return best


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the words of the shorter name of the best similarity to a word of the longer one; an initial equals a word that
    begins with it."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0

    def one(x: str, y: str) -> float:
        if len(x) == 1 or len(y) == 1:
            return 1.0 if x[0] == y[0] else 0.0
        return 1 - distance(x, y) / max(len(x), len(y))

    return sum(max(one(x, y) for y in b) for x in a) / len(a)


def _stars(members: DataFrame, key: list[str], least: float) -> DataFrame:
    """(node, centre) by star election in the groups of ``key``, until every member is in a star; members have node, words, n.

    The fullest and most frequent member left is the next centre, and who is like it joins it: so in that order each member
    joins the first centre that it fits or becomes one itself. A sorted pass holds one group's centres only.
    """
    order = [F.col("n").desc(), F.size("words").desc(), F.col("node")]
    rows = members.select(F.struct(*key).alias("_key"), *key, "node", "words", "n").repartition(*key).sortWithinPartitions(*key, *order)

    def elect(frames):
        group, centres = None, []
        for f in frames:
            out = []
            for k, node, words in zip(f["_key"], f["node"], f["words"]):
                words = list(words)
                if k != group:
                    group, centres = k, []
                fit = next((c for c, w in centres if monge_elkan(words, w) >= least), None)
                if fit is None:
                    centres.append((node, words))
                out.append((node, node if fit is None else fit))
            yield pd.DataFrame(out, columns=["node", "centre"], dtype="int64")

    rows = rows.select(F.to_json("_key").alias("_key"), "node", "words")
    return materialise(rows.mapInPandas(elect, "node bigint, centre bigint"))


def link_names(names: DataFrame, owners: DataFrame, group: str = "case_id", least: float = 0.7) -> DataFrame:
    """(``group``, name, entity): every distinct name of every group with the id of its entity within the group; a name of one
    word, such as a nickname, that several entities share has a row for each.

    ``names``: ``group``, name. ``owners``: ``group``, name, owner: names that are known to be one owner's. Rows with null or
    blank names or a null group are left out, copies count once, other columns are ignored, empty tables give an empty one.
    Strings of six and more digits, or of no more letters than digits, are account numbers and no names; other digits don't count
    in persons' names, but do in organisations'. Spelling statistics are over all groups.
    """
    g = F.col(group).alias("g")
    known = owners.select(g, "name", F.col("owner").cast("string").alias("owner"))
    every = names.select(g, "name").unionByName(known.select("g", "name"))
    digits = F.length(F.regexp_replace("name", r"\D", ""))
    account = (digits >= 6) | (digits >= F.length(F.regexp_replace("name", r"[^\p{L}]", "")))
    every = every.filter(F.col("g").isNotNull() & F.col("name").rlike(r"\p{L}") & ~account)
    every = every.groupBy("g", "name").agg(F.count("*").alias("n"))

    def run(frames):
        for f in frames:
            parts = [parse(x) for x in f["name"]]
            yield pd.DataFrame({"name": f["name"], **{c: [p[c] for p in parts] for c in ("kind", "words", "nick", "base", "trade", "legal", "code")}})

    schema = "name string, kind string, words array<string>, nick array<string>, base string, trade string, legal string, code string"
    parsed = every.select("name").distinct().mapInPandas(run, schema)
    nodes = materialise(every.join(parsed, "name").withColumn("node", F.xxhash64("g", "name")))
    # words of the corpus and their common spelling
    spots = nodes.filter("kind = 'P'").select("g", "node", "n", F.posexplode("words").alias("at", "word"), F.size("words").alias("size"))
    bases = nodes.filter("kind = 'O' and base <> ''").select("g", F.concat(F.lit("."), "base").alias("word"))
    nicks = nodes.filter(F.size("nick") > 0).select("g", F.explode("nick").alias("word"))
    counts = spots.filter(F.length("word") > 1).select("g", "word").unionByName(bases).unionByName(nicks).groupBy("g", "word").agg(F.count("*").alias("n"))
    main = materialise(common_spelling(counts))
    # persons: which words are family names, by where they mostly stand
    spots = materialise(spots.join(main, ["g", "word"], "left").withColumn("main", F.coalesce("main", "word")))
    roles = spots.filter((F.col("size") > 1) & (F.length("main") > 1)).groupBy("main").agg(
        (F.sum(F.when(F.col("at") == F.col("size") - 1, 1.0).otherwise(0.0)) / F.count("*")).alias("last"), F.count("*").alias("all")
    )
    placed = spots.join(roles, "main", "left").withColumn("last", F.when(F.length("main") == 1, -1.0).otherwise(F.coalesce("last", F.lit(0.0))))
    person = placed.groupBy("g", "node", "n", "size").agg(
        F.max(F.struct("last", "at", "main")).alias("fam"), F.array_sort(F.collect_list(F.struct("at", "main", "word"))).alias("all")
    )
    others = F.filter("all", lambda x: x["at"] != F.col("fam.at"))
    person = person.select(
        "g", "node", "n", "size", F.col("fam.main").alias("family"), F.try_element_at(others, F.lit(1))["main"].alias("first"),
        F.transform("all", lambda x: x["word"]).alias("words"),
    )
    person = materialise(person)
    full = person.filter((F.col("size") >= 2) & (F.length("first") > 1) & (F.length("family") > 1))
    stars = _stars(full.withColumnRenamed("first", "first_"), ["g", "first_", "family"], least)
    links = [stars.select(F.col("node").alias("a"), F.col("centre").alias("b"))]
    # one centre of each pair of first and family name, for what is written shorter
    whole = full.groupBy("g", "first", "family").agg(F.max(F.struct("n", F.size("words"), "node")).alias("m")).select("g", "first", "family", F.col("m.node").alias("centre"))
    sound = lambda c: F.when(c == "w", "v").when(c == "c", "k").otherwise(c)
    initials = person.filter((F.col("size") >= 2) & (F.length("first") == 1) & (F.length("family") > 1)).select("g", "node", "family", sound(F.col("first")).alias("i"))
    fits = initials.join(whole.withColumn("i", sound(F.substring("first", 1, 1))), ["g", "family", "i"])
    links.append(_only_one(fits))
    # initials that fit nobody's full name, or the same initial and family name in several writings
    links.append(initials.select(F.col("node").alias("a"), F.min("node").over(W.partitionBy("g", "family", "i")).alias("b")))
    # nicknames: stated beside a full name, or a first name cut short
    stated = nodes.filter(F.size("nick") > 0).select("g", "node", F.explode("nick").alias("word")).join(main, ["g", "word"])
    stated = stated.select("g", "node", F.col("main").alias("nick")).join(
        full.select("node", "first", "family"), "node"
    ).join(whole, ["g", "first", "family"]).select("g", "nick", "family", "centre").distinct()
    lone = person.filter((F.col("size") == 1) & (F.length("family") > 1)).select("g", "node", F.col("family").alias("nick"))
    links.append(_only_one(lone.join(stated, ["g", "nick"])))
    short = full.select("g", "node", F.col("first").alias("nick"), "family")
    links.append(_only_one(short.join(stated, ["g", "nick", "family"])))
    stem = lambda c: F.regexp_extract(c, r"^(.{3,}?)(?:u|i|y|iy|ji|o|ka|lu|bu|tu|ty|ky)$", 1)
    cut = lone.withColumn("stem", stem(F.col("nick"))).filter("stem <> ''").withColumn("s3", F.substring("stem", 1, 3))
    heads = whole.withColumn("s3", F.substring("first", 1, 3))
    begun = F.col("first").startswith(F.col("stem")) & (F.col("first") != F.col("nick"))
    links.append(_only_one(cut.join(heads, ["g", "s3"]).filter(begun).select("g", "node", "centre")))
    cut2 = short.withColumn("stem", stem(F.col("nick"))).filter("stem <> ''")
    known_first = roles.filter("last < 0.5 and all >= 4").select(F.col("main").alias("nick"))
    cut2 = cut2.join(known_first, "nick", "left_anti")
    links.append(_only_one(cut2.join(whole, ["g", "family"]).filter(begun & (F.col("first") != F.col("nick"))).select("g", "node", "centre")))
    # organisations
    org = nodes.filter("kind = 'O' and base <> ''").withColumn("word", F.concat(F.lit("."), "base")).join(main, ["g", "word"], "left")
    org = org.withColumn("key", F.coalesce("main", "word"))
    forms = org.filter("legal <> ''").groupBy("g", "key", "trade").agg(F.count_distinct("legal").alias("k"), F.min("legal").alias("only"))
    org = org.join(forms, ["g", "key", "trade"], "left").withColumn("form", F.when(F.coalesce("k", F.lit(0)) <= 1, F.lit("")).otherwise(F.col("legal")))
    org = org.withColumn("words", F.array_remove(F.concat(F.array("base"), F.split("trade", " ")), ""))
    stars = _stars(org.select("g", "node", "n", "words", "key", "trade", "form"), ["g", "key", "trade", "form"], least)
    links.append(stars.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    acronyms = nodes.filter("kind = 'A'").select("g", "node", "code")
    coded = org.filter("code <> ''").join(stars, "node").select("g", "code", "centre").distinct()
    links.append(_only_one(acronyms.join(coded, ["g", "code"])))
    # what is known to be one owner's, around a name of several words where there is one
    lonely = person.filter("size = 1").select("node").withColumn("_lone", F.lit(True))
    mine = known.join(nodes.select("g", "name", "node"), ["g", "name"]).join(lonely, "node", "left")
    centre = mine.groupBy("g", "owner").agg(F.min(F.struct(F.coalesce("_lone", F.lit(False)).alias("l"), "node")).alias("m"))
    links.append(mine.join(centre, ["g", "owner"]).select(F.col("node").alias("a"), F.col("m.node").alias("b")))
    edges = links[0]
    for x in links[1:]:
        edges = edges.unionByName(x.select("a", "b"))
    edges = edges.filter("a <> b").distinct()
    flag = lambda df, c: df.join(lonely.select(F.col("node").alias(c), F.col("_lone").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", F.lit(False)))
    edges = materialise(flag(flag(edges, "a"), "b"))
    # a lone word may name several entities: it joins each, but doesn't join them to each other
    one_lone = edges.filter("la <> lb").select(F.when(F.col("la"), F.col("a")).otherwise(F.col("b")).alias("node"), F.when(F.col("la"), F.col("b")).otherwise(F.col("a")).alias("other"))
    held = one_lone.select("node").distinct()
    apart = edges.filter("la and lb").join(held.select(F.col("node").alias("a")), "a", "left_anti").join(held.select(F.col("node").alias("b")), "b", "left_anti")
    roots = materialise(connected_components(edges.filter("not la and not lb").select("a", "b").unionByName(apart.select("a", "b"))))
    other = roots.select(F.col("node").alias("other"), "root")
    joined = one_lone.join(other, "other", "left").select("node", F.coalesce("root", "other").alias("entity")).distinct()
    rest = nodes.join(held, "node", "left_anti").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("entity"))
    member = rest.unionByName(joined)
    return nodes.select("node", F.col("g").alias(group), "name").join(member, "node").select(group, "name", "entity")


def _only_one(fits: DataFrame) -> DataFrame:
    """(a, b) for nodes that fit exactly one centre."""
    one = fits.groupBy("node").agg(F.min("centre").alias("b"), F.max("centre").alias("hi"))
    return one.filter(F.col("b") == F.col("hi")).select(F.col("node").alias("a"), "b")
