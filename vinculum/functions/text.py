"""Text normalisers as column expressions. Java patterns carry (?U), so that classes cover Unicode as the semantics require."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def tidy(text: Column) -> Column:
    """Line ends to newline, blanks within lines collapsed, lines stripped, at most one blank line in a row, ends stripped."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """``tidy`` of the NFC form; applying it twice changes nothing more."""
    return tidy(nfc(text))


def counts(text: Column) -> Column:
    """Struct of line and character counts; the empty text has no line."""
    lines = F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0)
    return F.struct(lines.alias("line_count"), F.length(text).alias("char_count"))


def match_phone(phone: Column) -> Column:
    """Digits for comparison: 91 before ten digits and 0 before ten digits fall away."""
    d = F.regexp_replace(phone, r"(?U)\D", "")
    return F.when(d.startswith("91") & (F.length(d) == 12), F.substring(d, 3, 10)).when(d.startswith("0") & (F.length(d) == 11), F.substring(d, 2, 10)).otherwise(d)


def display_phone(phone: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(phone, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def storage_identifier(value: Column, kind: Column) -> Column:
    """Stored form: phones keep plus and digits, accounts and vehicles lose blanks, other kinds stay."""
    return F.when(kind == "PHONE", F.regexp_replace(value, r"[^+\d]", "")).when(kind.isin("BANK_ACCOUNT", "VEHICLE"), F.regexp_replace(value, r"(?U)\s", "")).otherwise(value)


def match_account(account: Column) -> Column:
    return F.regexp_replace(account, r"(?U)[\s-]", "")


def match_vehicle(vehicle: Column) -> Column:
    return F.upper(match_account(vehicle))


def display_vehicle(vehicle: Column) -> Column:
    v = F.regexp_replace(F.upper(F.regexp_replace(vehicle, r"(?U)^\s+|\s+$", "")), "-+", " ")
    return F.regexp_replace(v, r"(?U)\s+", " ")


def _level(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(t, r"(?U)\s+", " ")


def match_org(org: Column, compat: bool = False) -> Column:
    """Name without corporate suffix and punctuation, PS as police station.

    By default PS must be a word of its own; with ``compat`` the pattern has no right bound, as in the older rule.
    """
    ps = r"(?i)\bp\.?\s*s\.?|\bps\b" if compat else r"(?i)\bp\.?\s?s\b\.?"
    t = F.regexp_replace(org, ps, "police station")
    t = F.regexp_replace(t, r"(?i)\b(?:pvt\s+ltd|ltd|llc|llp|inc|corp|corporation)\b", "")
    return _level(F.regexp_replace(t, r"(?U)[^\w\s]", ""))


def match_location(location: Column) -> Column:
    return _level(F.regexp_replace(location, r"(?U)[^\w\s]", ""))


#: Honorifics that a person's name may begin with.
HONORIFICS = ["Mr.", "Mrs.", "Ms.", "Shri", "Smt.", "Dr.", "Prof.", "Professor", "Advocate", "Adv.", "Insp.", "Inspector", "Sub-Inspector", "SI", "ASI", "Constable"]


def match_person(name: Column) -> Column:
    titles = "|".join(h.replace(".", r"\.") for h in HONORIFICS)
    t = F.regexp_replace(name, rf"(?iU)\b(?:{titles})\s+", "")
    return _level(F.regexp_replace(t, r"(?U)[^\w\s.]", ""))


def alias_parts(name: Column) -> Column:
    """Parts of a name that states an alias; of other names the stripped name alone."""
    stripped = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    parts = F.split(stripped, r"(?iU)\s+(?:@|alias|a\.k\.a\.?|aka)\s+")
    parts = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(stripped))


def sentences(text: Column) -> Column:
    parts = F.split(text, r"(?U)(?<=[.!?\n])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def grounding_ratio(snippet: Column, text: Column) -> Column:
    """Share of the snippet's words of three and more letters that the text holds; 1 if it holds the snippet itself.

    Null or empty snippets and texts give 0.
    """
    fold = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")
    s, t = fold(snippet), fold(text)
    words = F.filter(F.regexp_extract_all(s, F.lit(r"(?U)(\w+)"), 1), lambda w: F.length(w) > 2)
    share = F.size(F.filter(words, lambda w: t.contains(w))) / F.size(words)
    there = (F.coalesce(snippet, F.lit("")) != "") & (F.coalesce(text, F.lit("")) != "")
    return F.when(~there, 0.0).when(t.contains(s), 1.0).when(F.size(words) == 0, 0.0).otherwise(share)


def is_grounded(snippet: Column, text: Column, least: float = 0.65) -> Column:
    return grounding_ratio(snippet, text) >= least


def chunks(text: Column, size: int = 9000, overlap: int = 1000) -> Column:
    """Array of overlapping pieces of ``size`` characters; shorter texts are one piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def clamp(value: Column, default: float = 0.5) -> Column:
    """A confidence within 0..1; what is no number becomes the default."""
    v = F.coalesce(value.try_cast("double"), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


#: Tokens that hint at a document's type; they count as parts of words, too.
DOCUMENT_TOKENS = {
    "FIR": ["first information report", "fir", "crime no", "police station"],
    "CDR": ["call detail record", "cdr", "caller", "callee", "cell id"],
    "TRANSACTION_LEDGER": ["transaction ledger", "bank statement", "sender", "recipient", "upi", "transaction id"],
    "SEIZURE_MEMO": ["seizure memo", "seized", "inventory of articles", "panchnama"],
    "TRANSCRIPT": ["transcript", "statement of", "question:", "answer:"],
}


def document_type(text: Column, filename: Column) -> Column:
    """The type with the most tokens in file name and text; of equal ones the first by name; without any GENERIC_EVIDENCE."""
    hay = F.lower(F.concat(F.coalesce(filename, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    scored = [F.struct((-sum(hay.contains(t).cast("int") for t in tokens)).alias("s"), F.lit(name).alias("n")) for name, tokens in sorted(DOCUMENT_TOKENS.items())]
    best = F.array_min(F.array(*scored))
    return F.when(best["s"] < 0, best["n"]).otherwise("GENERIC_EVIDENCE")
