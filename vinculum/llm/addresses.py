"""Records of one postal address in different writings, by multi-pass sorted neighbourhoods.

Strings are parsed once into unit kind, unit number, building, street, locality, city and PIN. Several passes sort the parsed
forms by the components in differing orders and compare each form with its neighbours: unit kind and number must be equal,
names may differ by an edit-distance that counts a transposition once, PINs that are both there must be equal. Forms that share
number, street and area exactly are linked through the smallest of them, whatever the window.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.operators.components import connected_components
from vinculum.session import materialise

#: Spellings of the words that end the name of a building, street or locality.
BUILDINGS = {
    "apartments": ["apartment", "apts", "apt", "appts", "appt", "apmts"], "complex": ["compl", "cplx", "cmplx", "comp"],
    "towers": ["tower", "twrs", "twr"], "chambers": ["chamber", "chb", "chmbrs", "chbrs"], "bhavan": ["bhawan", "bhvn", "bhn"],
    "mansion": ["mansions"], "building": ["bldg"], "house": [], "plaza": [], "residency": [], "heights": [],
}
STREETS = {
    "street": ["st", "str", "strt"], "road": ["rd", "raod"], "lane": ["ln", "gali"], "marg": ["mg", "mrg"],
    "avenue": ["ave", "av", "avn"], "path": [], "cross": [], "highway": ["hwy"],
}
LOCALITIES = {
    "nagar": ["ngr", "nagr"], "colony": ["col", "coly", "clny"], "market": ["mkt", "mrkt"], "layout": ["lyt", "lay"],
    "enclave": ["encl", "enclv"], "vihar": ["vhr", "vihaar"], "extension": ["extn"], "sector": [], "phase": [],
}
UNITS = {
    "flat": ["flat", "flt", "fl", "apartment no"], "shop": ["shop", "shp", "sh"], "plot": ["plot", "plt", "p"],
    "godown": ["godown", "gdn", "gd"], "house": ["house", "hse", "h", "d", "door"],
}
LANDMARK = r"\b(?:near|nr|opp|opposite|behind|beside|next to|adjacent to)\b\.?"
LANDMARK_ENDS = r"(?:tower|bridge|market|depot|tank|school|crossing|bunk|court|stand|temple|hospital|office|mosque|church|park|cinema|station|gate|bank)"

_KINDS = {w: (slot, kind) for slot, group in (("building", BUILDINGS), ("street", STREETS), ("locality", LOCALITIES)) for kind, more in group.items() for w in [kind, *more]}
_UNIT_OF = {w: k for k, ws in UNITS.items() for w in ws}
_NUMBER = r"(\d+)(?:\s*[-/\\]\s*(\d{1,3}|[a-z])(?![a-z\d]| ?\d)|\s?([a-z])(?![a-z.]))?"
_FULL_UNITS = "|".join(sorted((w for w in _UNIT_OF if len(w) > 2), key=len, reverse=True))
_SHORT_UNITS = "|".join(sorted((w for w in _UNIT_OF if len(w) <= 3), key=len, reverse=True))
_UNIT = re.compile(rf"(?:\b({_FULL_UNITS})\b\.?\s*(?:no\b|number\b)?\s*[.:]?\s*|\b({_SHORT_UNITS})\.?\s*no\b\s*[.:]?\s*|(\#)\s*(?:no\b\.?)?\s*){_NUMBER}")
_LOOSE_UNIT = re.compile(rf"\b([a-z]{{3,7}})\.?\s*(?:no\b|number\b)?\s*[.:]?\s*{_NUMBER}")
_PIN = re.compile(r"(?:\bpin(?:\s*code)?\b\s*[:.\-]?\s*)?(?<![\d/\\])(\d{3}) ?(\d{3})(?![\d/\\])")
_NOT_ADDRESS = re.compile(r"^\s*(?:cell\b.*|unknown|n/?a|null|none|nil|-*)\s*$")


def osa(a: str, b: str, most: int) -> int:
    """Edit distance in which swapping two neighbours counts once; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return prev[-1]


def _ending(word: str, cache: dict = {}) -> tuple[str, str] | None:  # noqa: B006
    """Slot and canonical form of a word that ends a component's name, allowing one error in longer words."""
    if word not in cache:
        if len(cache) > 200_000:
            cache.clear()
        hit = _KINDS.get(word)
        if hit is None and len(word) >= 4:
            close = [k for w, k in _KINDS.items() if len(w) >= 4 and osa(word, w, 1) == 1]
            hit = close[0] if close and len(set(close)) == 1 else None
        cache[word] = hit
    return cache[word]


def parse(text: str | None) -> dict[str, str] | None:
    """Components of an address; None for placeholders, cell ids and texts without unit number."""
    if not text:
        return None
    s = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    s = re.sub(r"[\s​]+", " ", s)
    if _NOT_ADDRESS.match(s):
        return None
    s = re.sub(r"\b(?:lay out|l/o)(?![a-z])", "layout", s)
    s = re.sub(rf"{LANDMARK}\s*(?:[a-z]+\.? ){{0,3}}?{LANDMARK_ENDS}\b|{LANDMARK}[^,;]*", ",", s)
    out = dict.fromkeys(("kind", "number", "building", "building_type", "street", "street_type", "locality", "locality_type", "city", "pin"), "")
    m = _UNIT.search(s)
    if m:
        out["kind"] = "house" if m[3] else _UNIT_OF[m[1] or m[2]]
        number = (m[4], m[5] or m[6])
    else:
        for m in _LOOSE_UNIT.finditer(s):
            close = {k for w, k in _UNIT_OF.items() if len(w) >= 4 and osa(m[1], w, 1) <= 1}
            if len(close) == 1:
                out["kind"], number = close.pop(), (m[2], m[3] or m[4])
                break
        else:
            return None
    out["number"] = "/".join(x.lstrip("0") or "0" for x in number if x)
    s = f"{s[: m.start()]},{s[m.end() :]}"
    p = None
    for p in _PIN.finditer(s):
        pass
    if p:
        out["pin"] = p[1] + p[2]
        s = f"{s[: p.start()]},{s[p.end() :]}"
    rest = []
    for segment in re.split(r"[,;|\n]| - ", s):
        pending: list[str] = []
        for w in re.findall(r"[a-z][a-z'\-]*", segment):
            w = w.strip("-'")
            if not w or w in ("pin", "no"):
                continue
            end = _ending(w)
            if end and pending and not out[end[0]]:
                out[end[0]], out[f"{end[0]}_type"] = pending[-1], end[1]
                rest += pending[:-1]
                pending = []
            else:
                pending.append(w)
        rest += pending
    out["city"] = re.sub(r"[^a-z]", "", "".join(rest))
    return out


FIELDS = ["kind", "number", "building", "building_type", "street", "street_type", "locality", "locality_type", "city", "pin"]
_NAMES = ("building", "street", "locality", "city")


def _close(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return a == b or n >= 4 and osa(a, b, 2 if n >= 8 else 1) <= (2 if n >= 8 else 1)


def same_address(x: dict, y: dict, established) -> bool:
    """Whether two parsed forms with equal unit denote one place.

    ``established(a, b)``: whether both are common names, so that their likeness is no typing error. Two components of
    building, street, locality, city and PIN must agree, among them street or building, and none may disagree; of types that
    are both known, none may differ.
    """
    agree = 0
    if x["pin"] and y["pin"]:
        if x["pin"] != y["pin"]:
            return False
        agree += 1
    place = False
    for n in _NAMES:
        a, b = x[n], y[n]
        if a and b:
            if a != b and (not _close(a, b) or established(n, a, b)):
                return False
            if n != "city" and x[f"{n}_type"] != y[f"{n}_type"]:
                return False
            agree += 1
            place |= n in ("building", "street")
    return place and agree >= 2


def parsed_forms(strings: DataFrame) -> DataFrame:
    """(loc, form, FIELDS...): each distinct string of the column ``loc`` that is an address, with the id of its parsed form."""

    def run(frames):
        for f in frames:
            rows = []
            for t in f["loc"]:
                p = parse(t)
                if p and (p["street"] or p["building"]):
                    rows.append((t, *(p[c] for c in FIELDS)))
            yield pd.DataFrame(rows, columns=["loc", *FIELDS], dtype=object)

    rows = strings.filter("loc is not null").select("loc").distinct().mapInPandas(run, "loc string, " + ", ".join(f"{c} string" for c in FIELDS))
    return rows.withColumn("form", F.xxhash64(*FIELDS))


def link_addresses(strings: DataFrame, window: int = 10) -> DataFrame:
    """(loc, place): for every distinct address string of the column ``loc`` the id of its place.

    Null, blank and placeholder strings and cell ids are no addresses and are left out; copies count once; other columns are
    ignored; an empty table gives an empty one. ``window`` is the number of following neighbours in each of the passes.
    """
    rows = materialise(parsed_forms(strings))
    forms = rows.select("form", *FIELDS).dropDuplicates(["form"])
    links = [rows.select(F.col("form").alias("a"), F.col("form").alias("b"))]
    # forms that agree exactly in unit, street and an area, and disagree in nothing by it: through the smallest form
    unit = ["kind", "number"]
    for area in (["pin"], ["locality", "locality_type", "city"]):
        key = [*unit, "street", "street_type", *area, "building", "building_type"]
        there = (F.col("street") != "") & (F.col(area[0]) != "") & (F.col(area[-1]) != "")
        first = F.min("form").over(W.partitionBy(*key))
        links.append(forms.filter(there).select(F.col("form").alias("a"), first.alias("b")).filter("a <> b"))
    # how often a name stands in distinct forms: two common names that look alike are two names
    counts = None
    for n in _NAMES:
        c = forms.filter(F.col(n) != "").groupBy(F.lit(n).alias("slot"), F.col(n).alias("name")).agg(F.count("*").alias("n"))
        counts = c if counts is None else counts.unionByName(c)
    lead = []
    record = F.struct("form", *FIELDS)
    for order in (["street", "pin", "locality", "building"], ["pin", "street", "city"], ["locality", "street", "pin"], ["city", "street", "building"], ["building", "street", "locality"]):
        block = W.partitionBy(*unit, F.substring(order[0], 1, 1)).orderBy(*order, "form")
        near = F.collect_list(record).over(block.rowsBetween(1, window))
        lead.append(forms.filter(F.col(order[0]) != "").select(record.alias("x"), near.alias("_near")).select("x", F.explode("_near").alias("y")))
    pairs = lead[0]
    for p in lead[1:]:
        pairs = pairs.unionByName(p)
    near_enough = F.lit(True)
    for n in _NAMES:
        a, b = F.col(f"x.{n}"), F.col(f"y.{n}")
        near_enough &= (a == "") | (b == "") | (a == b) | (F.levenshtein(a, b, 4) >= 0)
    pin_ok = (F.col("x.pin") == "") | (F.col("y.pin") == "") | (F.col("x.pin") == F.col("y.pin"))
    swapped = F.col("x.form") > F.col("y.form")
    pairs = (
        pairs.filter(near_enough & pin_ok)
        .select(F.when(swapped, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swapped, F.col("x")).otherwise(F.col("y")).alias("y"))
        .dropDuplicates(["x", "y"])
    )
    for k, n in enumerate(_NAMES):
        for side in "xy":
            own = counts.filter(F.col("slot") == n).select(F.col("name").alias("_name"), F.col("n").alias(f"n_{side}{k}"))
            pairs = pairs.join(own, F.col(f"{side}.{n}") == F.col("_name"), "left").drop("_name")

    def verify(frames):
        for f in frames:
            keep = []
            for i, (x, y) in enumerate(zip(f["x"], f["y"])):
                n = {name: (f[f"n_x{k}"].iat[i], f[f"n_y{k}"].iat[i]) for k, name in enumerate(_NAMES)}

                def established(slot, a, b, n=n):
                    low, high = sorted(n[slot])
                    return low >= 4 and low >= 0.1 * high

                if same_address(x, y, established):
                    keep.append((x["form"], y["form"]))
            yield pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    verified = pairs.mapInPandas(verify, "a bigint, b bigint")
    every = materialise(links[1].unionByName(links[2]).unionByName(verified).distinct())
    # a form without PIN may fit places of several PINs: it takes the one that most of its links have, and joins no two
    pins = forms.select(F.col("form").alias("b"), F.col("pin").alias("_p"))
    both = every.unionByName(every.select(F.col("b").alias("a"), F.col("a").alias("b")))
    votes = both.join(pins.filter("_p <> ''"), "b").groupBy("a", "_p").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("a").agg(F.max(F.struct("n", "_p")).alias("m")).select(F.col("a").alias("form"), F.col("m._p").alias("vote"))
    own = forms.select("form", "pin").join(chosen, "form", "left").select("form", F.when(F.col("pin") != "", F.col("pin")).otherwise(F.coalesce("vote", F.lit(""))).alias("p"))
    every = every.join(own.select(F.col("form").alias("a"), F.col("p").alias("pa")), "a").join(own.select(F.col("form").alias("b"), F.col("p").alias("pb")), "b")
    every = every.filter("pa = '' or pb = '' or pa = pb").select("a", "b")
    roots = connected_components(every)
    placed = rows.select("loc", "form").join(roots.withColumnRenamed("node", "form"), "form", "left")
    return placed.select("loc", F.coalesce("root", "form").alias("place"))
