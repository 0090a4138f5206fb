"""Sums recorded in different units, scales and writings, converted to one unit (paise).

Number, scale word and currency are read from the text or, where there is none, from the amount and unit columns. Rows that
name no unit at all follow the stated convention (rupees); beside it a log-scale mixture whose components are offset by the
known conversion factors gives the posterior of each unit, so rows whose size contradicts the convention are flagged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.session import materialise

#: Scale words (lower case, without a final s) and their factors.
SCALES = {
    "k": 10**3, "thousand": 10**3, "'000": 10**3, "000": 10**3, "hundred": 100, "l": 10**5, "lakh": 10**5, "lac": 10**5,
    "cr": 10**7, "crore": 10**7, "mn": 10**6, "m": 10**6, "million": 10**6, "bn": 10**9, "billion": 10**9,
}
#: Number words.
WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
#: Spellings of the rupee and of its hundredth beside the unit table's codes and symbols.
RUPEE = ["rupees", "rupee", "rs.", "rs"]
PAISA = ["paise", "paisa"]

_NUMBER = r"\d(?:[\d.,]*\d)?"


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])


def unit_table(units: DataFrame, code: str = "code", symbols: str = "symbols", rate: str = "paise_per_unit", most: int = 1000) -> dict[str, int]:
    """Lower-case unit token to paise per unit, from the unit table. Its size is checked: more than ``most`` rows raise."""
    rows = units.select(code, symbols, rate).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the unit table has more than {most} rows")
    found = {}
    for r in rows:
        if r[0] is not None and r[2] is not None:
            for token in [r[0], *(r[1] or [])]:
                found[token.lower()] = int(r[2])
    found |= {x: found.get("inr", 100) for x in RUPEE} | dict.fromkeys(PAISA, 1)
    return found


def _plain_number(n: Column) -> Column:
    """The decimal value of a number text with thousands and decimal marks of either custom.

    With both marks the later one is decimal; a lone comma is decimal unless three digits follow; a lone dot is decimal;
    several dots without comma are thousands marks.
    """
    comma, dot = F.locate(",", F.reverse(n)), F.locate(".", F.reverse(n))
    last_dot_decimal = (comma > 0) & (dot > 0) & (dot < comma)
    last_comma_decimal = (comma > 0) & (dot > 0) & (comma < dot)
    only_comma, only_dot = (comma > 0) & (dot == 0), (dot > 0) & (comma == 0)
    no_comma, no_dot = F.regexp_replace(n, ",", ""), F.regexp_replace(n, r"\.", "")
    text = (
        F.when(last_dot_decimal, no_comma)
        .when(last_comma_decimal, F.regexp_replace(no_dot, ",", "."))
        .when(only_comma & n.rlike(r",\d{3}$"), no_comma)
        .when(only_comma, F.when(n.rlike(r"^\d+,\d+$"), F.regexp_replace(n, ",", ".")).otherwise(no_comma))
        .when(only_dot & n.rlike(r"\..*\."), no_dot)
        .otherwise(n)
    )
    return text.try_cast("decimal(28,8)")


def _in_words(tokens: Column) -> Column:
    """Value of an array of number and scale words; null if another word is among them or none is a number."""
    words, scales = _map(WORDS), _map({k: v for k, v in SCALES.items() if len(k) > 2 and k.isalpha()} | {"and": -1})
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("now"), F.lit(True).alias("ok"))

    def step(s, w):
        value, scale = F.try_element_at(words, w), F.try_element_at(scales, F.regexp_replace(w, "s$", ""))
        below = F.pmod(s["sum"], scale)
        return (
            F.when(value.isNotNull(), F.struct(s["sum"].alias("sum"), (s["now"] + value).alias("now"), s["ok"].alias("ok")))
            .when(scale == -1, s)
            .when(scale == 100, F.struct(s["sum"].alias("sum"), (F.greatest(s["now"], F.lit(1)) * 100).alias("now"), s["ok"].alias("ok")))
            .when(
                scale > 100,
                F.struct((s["sum"] - below + F.greatest(below + s["now"], F.lit(1)) * scale).alias("sum"), F.lit(0).cast("bigint").alias("now"), s["ok"].alias("ok")),
            )
            .otherwise(F.struct(s["sum"].alias("sum"), s["now"].alias("now"), F.lit(False).alias("ok")))
        )

    got = F.aggregate(tokens, start, step)
    return F.when((F.size(tokens) > 0) & got["ok"], (got["sum"] + got["now"]).cast("decimal(28,8)"))


def _scale_and_rate(tokens: Column, units: dict[str, int]) -> tuple[Column, Column, Column]:
    """Factor, paise per unit (null: none named) and whether all tokens are understood."""
    scales, rates = _map(SCALES), _map(units)
    bare = F.transform(tokens, lambda w: F.when(F.length(w) > 2, F.regexp_replace(w, "s$", "")).otherwise(w))
    known_scales = F.filter(F.transform(bare, lambda w: F.try_element_at(scales, w)), lambda x: x.isNotNull())
    known_rates = F.filter(F.transform(tokens, lambda w: F.try_element_at(rates, w)), lambda x: x.isNotNull())
    understood = F.forall(
        tokens,
        lambda w: F.try_element_at(rates, w).isNotNull()
        | F.try_element_at(scales, F.when(F.length(w) > 2, F.regexp_replace(w, "s$", "")).otherwise(w)).isNotNull()
        | w.isin("only", "/-", "-", ""),
    )
    factor = F.aggregate(known_scales, F.lit(1).cast("bigint"), lambda a, x: a * x)
    # "INR paise": the hundredth beside its currency is the unit; two different currencies are not understood
    paise = F.array_contains(known_rates, 1)
    others = F.array_distinct(F.filter(known_rates, lambda x: x != 1))
    rate = F.when(paise, F.lit(1)).otherwise(F.try_element_at(others, F.lit(1)))
    return factor, rate, understood & (F.size(others) <= 1)


def normalise_amounts(df: DataFrame, units: DataFrame, amount: str = "amount", text: str = "amount_text", unit: str = "currency", per_decade: int = 8, sure: float = 0.9) -> DataFrame:
    """Add the sum of each row in paise and how it was come by.

    New columns: ``paise`` DECIMAL(38,0), null if unreadable; ``amount_source`` 'text', 'column', 'none' or 'unreadable';
    ``unit_stated`` BOOLEAN; for rows without a stated unit ``unit_posterior`` DOUBLE (probability that the convention, whole
    rupees, holds), ``unit_assigned`` DECIMAL (rupees in the unit of the highest posterior: 1, 1000, 100000, ... ),
    ``assigned_posterior`` DOUBLE, ``unit_uncertain`` BOOLEAN (the convention's is below 0.5, or no unit's reaches ``sure``), null for the rest, and
    ``paise_assigned``, the sum in the assigned unit (``paise`` where a unit is stated). ``paise`` itself follows the convention.
    A text, if present and not blank, states number and unit (rupees if it names no currency); otherwise the amount counts in
    its unit, rupees if null. Null, empty, NaN and infinite amounts and unknown units give null. Zero and negative sums
    convert like others. All rows and columns are kept; columns of the input with the new names are replaced; helper names begin with ``_`` and must be free.

    The mixture is fitted on a histogram of log10 of all rows with and without stated unit (``per_decade`` bins a decade, so
    its size is bounded by the range of doubles); only the histogram reaches the driver.
    """
    df = df.drop("paise", "amount_source", "unit_stated", "unit_posterior", "unit_uncertain", "unit_assigned", "assigned_posterior", "paise_assigned")
    table = unit_table(units)
    cols = df.columns
    t = F.lower(F.trim(F.regexp_replace(F.col(text), r"(?U)[\s​]+", " ")))
    df = df.withColumn("_t", F.when(t != "", t))
    t = F.col("_t")
    df = df.withColumn("_n", F.regexp_extract(t, rf"({_NUMBER})", 1))
    signed = t.rlike(rf"^[^\d]*[-−(]\s*[^\d]*{_NUMBER}")
    rest = F.regexp_replace(F.regexp_replace(t, rf"{_NUMBER}(/-)?", " "), r"[-−()]", " ")
    # cut between letters and signs, so that "₹" and "rs." stand alone
    rest = F.regexp_replace(rest, r"([₹€£¥]|[a-z]*\$)", " $1 ")
    df = df.withColumn("_rest", F.filter(F.split(rest, r"\s+"), lambda w: w != ""))
    df = df.withColumn("_words", F.filter(F.split(F.regexp_replace(t, r"[-,/]", " "), r"\s+"), lambda w: w != ""))
    drop = [*RUPEE, "only", *[c for c in table if c.isalpha() and c not in PAISA]]
    spelled = _in_words(F.filter("_words", lambda w: ~w.isin(*drop)))
    factor, rate, good = _scale_and_rate(F.col("_rest"), table)
    word_rate = F.try_element_at(F.filter(F.transform("_words", lambda w: F.try_element_at(_map(table), w)), lambda x: x.isNotNull()), F.lit(1))
    has_digits = F.col("_n") != ""
    one_number = F.size(F.regexp_extract_all(t, F.lit(rf"({_NUMBER})"), 1)) == 1
    number = F.when(has_digits, F.when(one_number & good, _plain_number(F.col("_n")) * F.when(signed, -1).otherwise(1))).otherwise(spelled)
    df = (
        df.withColumn("_value", number)
        .withColumn("_factor", F.when(has_digits, factor).otherwise(F.lit(1).cast("bigint")))
        .withColumn("_rate", F.when(has_digits, rate).otherwise(word_rate))
    )
    u = F.lower(F.trim(F.regexp_replace(F.col(unit), r"(?U)[\s​]+", " ")))
    u = F.filter(F.split(u, " "), lambda w: w != "")
    c_factor, c_rate, c_good = _scale_and_rate(u, table)
    no_unit = F.col(unit).isNull() | (F.size(u) == 0)
    a = F.col(amount)
    finite = a.isNotNull() & ~F.isnan(a) & (F.abs(a) < 1e19)
    huge = F.when(~F.isnan(a) & (F.abs(a) >= 1e19) & (F.abs(a) < 1e36), a.cast("double").try_cast("decimal(38,0)"))  # doubles of this size are whole
    df = (
        df.withColumn("_from_text", F.col("_t").isNotNull())
        .withColumn("_huge", F.when(F.col("_t").isNull() & (no_unit | c_good), huge))
        .withColumn("_value", F.when(F.col("_from_text"), F.col("_value")).otherwise(F.when(finite & (no_unit | c_good), a.try_cast("decimal(28,8)"))))
        .withColumn("_factor", F.when(F.col("_from_text"), F.col("_factor")).otherwise(F.when(no_unit, F.lit(1).cast("bigint")).otherwise(c_factor)))
        .withColumn("_rate", F.when(F.col("_from_text"), F.col("_rate")).otherwise(F.when(~no_unit, c_rate)))
        .withColumn("unit_stated", F.col("_rate").isNotNull() | (F.col("_factor") > 1))
    )
    per = (F.col("_factor") * F.coalesce(F.col("_rate").cast("bigint"), F.lit(table.get("inr", 100)))).cast("decimal(20,0)")
    # split at the decimal point so that no product leaves 38 digits
    whole = F.floor(F.col("_value")).cast("decimal(20,0)")
    part = (F.col("_value") - whole).cast("decimal(9,8)")
    paise = F.round(whole * per.cast("decimal(18,0)") + part * per.cast("decimal(18,0)"), 0).cast("decimal(38,0)")
    paise = F.coalesce(paise, F.try_multiply(F.col("_huge"), per.cast("decimal(18,0)")).try_cast("decimal(38,0)"))
    source = (
        F.when(F.col("_from_text"), F.when(F.col("_value").isNull(), "unreadable").otherwise("text"))
        .when(a.isNull(), "none")
        .when(paise.isNull(), "unreadable")
        .otherwise("column")
    )
    # read by the histogram and by the result: written once
    df = materialise(df.select(*cols, paise.alias("paise"), source.alias("amount_source"), "unit_stated", F.coalesce(F.col("_value").cast("double"), F.col("_huge").cast("double")).alias("_v")))
    posterior = _posterior(df, table, per_decade)
    bin_of = F.when(~F.col("unit_stated") & (F.col("_v") > 0), F.floor(F.log10("_v") * per_decade))
    return (
        df.withColumn("_bin", bin_of.cast("bigint"))
        .join(F.broadcast(posterior), "_bin", "left")
        .withColumn("unit_uncertain", (F.col("unit_posterior") < 0.5) | (F.col("assigned_posterior") < F.lit(sure)))
        .withColumn("_up", F.greatest("_factor", F.lit(1.0)).cast("decimal(18,0)"))
        .withColumn("_down", F.round(F.lit(1.0) / F.least("_factor", F.lit(1.0))).cast("decimal(18,0)"))
        .withColumn("paise_assigned", F.when(F.col("_factor").isNull(), F.col("paise")).otherwise(F.round(F.try_divide(F.try_multiply(F.col("paise"), F.col("_up")), F.col("_down")), 0).try_cast("decimal(38,0)")))
        .withColumn("unit_assigned", F.col("_factor"))
        .select(*cols, "paise", "amount_source", "unit_stated", "unit_posterior", "unit_uncertain", "unit_assigned", "assigned_posterior", "paise_assigned")
    )


def _posterior(df: DataFrame, units: dict[str, int], per_decade: int, rounds: int = 25) -> DataFrame:
    """(_bin, unit_posterior, _factor, assigned_posterior) for a bare number, by bin of its log10: the probability of whole rupees, and
    the likeliest unit with its probability.

    The shape of sums is the histogram of log10 rupees of rows with stated units, smoothed; component c of the mixture is
    this shape shifted by log10 of c's factor; the weights are fitted by expectation maximisation on the bare numbers. A foreign
    currency without its name shifts by less than a sum's own spread, so the components are the rupee and those multiples
    and units that are apart by at least half a decade.
    """
    spark = df.sparkSession
    v = F.when(F.col("unit_stated"), F.col("paise").cast("double") / 100).otherwise(F.col("_v"))
    counts = df.filter(v > 0).groupBy(F.floor(F.log10(v) * per_decade).cast("bigint").alias("b"), "unit_stated").count().collect()
    shape, bare = {}, {}
    for r in counts:
        (shape if r.unit_stated else bare)[r.b] = r["count"]
    total = sum(shape.values())
    factors: list[float] = [1.0]
    for f in sorted({*(f / 100 for f in units.values()), *map(float, SCALES.values())}, key=lambda f: (abs(math.log10(f)), f)):
        if all(abs(math.log10(f / g)) >= 0.5 for g in factors):
            factors.append(f)

    def density(b: float) -> float:
        k = round(b)
        return (sum(shape.get(k + d, 0) * w for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25))) + 1e-3) / (total + 1.0)

    weights = {f: 0.9 if f == 1.0 else 0.1 / max(1, len(factors) - 1) for f in factors}
    like = {b: {f: density(b + math.log10(f) * per_decade) for f in factors} for b in bare}
    for _ in range(rounds):
        new = dict.fromkeys(factors, 0.0)
        for b, n in bare.items():
            norm = sum(weights[f] * like[b][f] for f in factors)
            for f in factors:
                new[f] += n * weights[f] * like[b][f] / norm
        whole = sum(new.values())
        weights = {f: x / whole for f, x in new.items()} if whole else weights
    rows = []
    for b, x in like.items():
        norm = sum(weights[f] * x[f] for f in factors)
        best = max(factors, key=lambda f: (weights[f] * x[f], -f))
        rows.append((b, weights[1.0] * x[1.0] / norm, best, weights[best] * x[best] / norm))
    return spark.createDataFrame(rows, "_bin bigint, unit_posterior double, _factor double, assigned_posterior double")


def same_sum_pairs(df: DataFrame, record: str, row: str, written: list[str]) -> DataFrame:
    """Pairs (row_a, row_b), row_a < row_b, of rows with equal non-null ``record`` and equal ``paise`` that differ in one of the
    ``written`` columns. The columns needed are written once to the shared folder, as three plans read them. Groups written alike are sorted out by a partial aggregation before the join."""
    as_stored = F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(written)])
    rows = df.filter(F.col(record).isNotNull() & F.col("paise").isNotNull()).select(
        F.col(record).alias("_r"), "paise", F.xxhash64(F.to_json(as_stored)).alias("_h"), as_stored.alias("_w"), F.col(row).alias("_row")
    )
    rows = materialise(rows)
    keys = rows.groupBy("_r", "paise").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi")).filter("_lo <> _hi").select("_r", "paise")
    rows = rows.join(keys, ["_r", "paise"], "left_semi")
    a = rows.select("_r", "paise", F.col("_w").alias("_wa"), F.col("_row").alias("row_a"))
    b = rows.select("_r", "paise", F.col("_w").alias("_wb"), F.col("_row").alias("row_b"))
    return a.join(b, ["_r", "paise"]).filter((F.col("row_a") < F.col("row_b")) & ~F.col("_wa").eqNullSafe(F.col("_wb"))).select("row_a", "row_b")
