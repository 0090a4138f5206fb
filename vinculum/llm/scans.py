"""Text of scanned pages: running headers, page numbers, broken and misread words found, continuous paragraphs restored.

Words are grouped by a skeleton in which glyphs that scanners confuse are one; the frequent form of a group that its context
supports replaces the rare ones. Headers are lines that recur at page edges once digits are masked. Paragraphs are reflowed
by SQL windows over the lines in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.session import materialise

#: What a glyph or a pair is misread as. Letters that stand on both sides make one class.
CONFUSED = [
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("m", "rn"), ("w", "vv"), ("d", "cl"), ("h", "li"), ("u", "ii"), ("n", "ri"),
    ("e", "c"), ("s", "5"), ("o", "0"), ("t", "†"), ("i", "|"), ("l", "1"), ("a", "@"), ("g", "9"), ("b", "6"), ("€", "c"), ("¢", "c"),
]
#: Position of a broken word, put together, beyond all words of its line.
WHOLE = 1_000_000_000
HYPHENS = "-‐\u00ad¬"
#: Values of the letters of Roman numbers, and the form of such a number.
_ROMAN_LETTERS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_ROMAN_FORM = r"^m*(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
_PAGE = r"^(?:p(?:a|@)(?:g|9)(?:e|c)|p(?:g|9)\.?|p\.)?\s*[-–\[(]*\s*([0-9lIO|]{1,9}|[ivxlcdm|]{1,15})\s*[-–\])]*\s*(?:(?:o|0)f\s+[0-9lIO|]{1,9})?\s*[-–\])]*\.?$"
_LABEL = r"^p(?:a|@)?(?:g|9)(?:e|c)?\b|^[-–\[(]\s*[0-9lio|]{1,9}\s*[-–\])]$"
_PAGE_TAIL = r"(?i)\s{2,}[-–\[(]*\s*(?:(?:p[a@][g9][ec]|p[g9]\.?|p\.)\s*)?[-–\[(]*\s*[0-9lIO|]{1,9}\s*[-–\])]*(?:\s+[o0]f\s+[0-9lIO|]{1,9})?\s*[-–\])]*\s*$"
_ODD = r"[|†@ﬁﬂﬀ€¢]"


def skeleton(word: Column) -> Column:
    """A lower-case word with one sign for each class of confusable glyphs."""
    out = F.lower(word)
    for glyph, read in CONFUSED:
        out = F.replace(out, F.lit(glyph), F.lit(read))
    return out


def _mask(text: Column) -> Column:
    """Text with numbers masked, blanks and case levelled."""
    level = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, _PAGE_TAIL, ""), r"(?U)\s+", " ")))
    return F.regexp_replace(level, r"(?<![a-z|†@])\d[\d/.,:\-]*(?![a-z|†@])", "#")


def _lines(blocks: DataFrame) -> DataFrame:
    """Lines with masked text and their places from the page's top and bottom."""
    page = W.partitionBy("scan_id", "page")
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = blocks.select("scan_id", "page", "line_id", t.alias("text")).distinct()
    rows = rows.filter(F.col("scan_id").isNotNull() & F.col("page").isNotNull() & F.col("line_id").isNotNull())
    return (
        rows.withColumn("top", F.row_number().over(page.orderBy("line_id", "text")))
        .withColumn("bottom", F.count("*").over(page) - F.col("top") + 1)
        .withColumn("edge", F.least("top", "bottom"))
        .withColumn("mask", _mask(F.col("text")))
        .withColumn("key", F.array_join(F.transform(F.split("mask", " "), lambda w: F.when(w == "#", w).otherwise(skeleton(w))), " "))
    )


def _number(text: Column) -> Column:
    """Value of a line that holds nothing but a page number; null otherwise."""
    raw = F.regexp_extract(F.lower(F.trim(text)), _PAGE.replace("lIO", "lio"), 1)
    arabic = F.translate(raw, "lio|", "1101")
    letters = F.translate(raw, "|", "i")
    value = F.create_map(*[F.lit(x) for pair in _ROMAN_LETTERS.items() for x in pair])
    each = F.transform(F.split(letters, ""), lambda c: F.coalesce(F.try_element_at(value, c), F.lit(0)))
    signed = F.transform(each, lambda x, i: F.when(x < F.coalesce(F.get(each, i + 1), F.lit(0)), -x).otherwise(x))
    roman = F.when(letters.rlike(_ROMAN_FORM), F.aggregate(signed, F.lit(0), lambda a, x: a + x).cast("bigint"))
    return F.when(raw == "", None).when(raw.rlike("[0-9]") | (raw.isin("l", "|", "o")), arabic.try_cast("bigint")).otherwise(F.when(roman > 0, roman))


def _masked(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(scan_id, page, line_id, edge, part, key2): the lines' keys with all words but the known ones (column w) masked, as a whole
    and their first and last three words; lines without known word are left out."""
    line = ["scan_id", "page", "line_id", "edge"]
    words = lines.select(*line, F.posexplode(F.split("key", " ")).alias("at", "w")).join(known.withColumn("k", F.lit(True)), "w", "left")
    rows = words.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("k"), F.col("w")).otherwise(F.lit("*")).alias("w")))).alias("ws"), F.count_if("k").alias("n"))
    text_of = lambda ws: F.array_join(F.transform(ws, lambda x: x["w"]), " ")
    keys = F.array(
        F.struct(F.lit("whole").alias("part"), text_of(F.col("ws")).alias("key2")), F.struct(F.lit("first").alias("part"), text_of(F.slice("ws", 1, 3)).alias("key2")),
        F.when(F.size("ws") > 3, F.struct(F.lit("last").alias("part"), text_of(F.slice("ws", -3, 3)).alias("key2"))),
    )
    keys = F.filter(keys, lambda x: x.isNotNull() & x["key2"].rlike(r"[a-z|†@0159]{2}"))
    return rows.filter("n > 0").select(*line, F.explode(keys).alias("x")).select(*line, "x.part", "x.key2")


def classify(blocks: DataFrame, near: int = 3, least_known: int = 5) -> DataFrame:
    """Lines with ``role`` 'header', 'page_number' or 'body'.

    A page number stands in the first or last two lines and is labelled so, equals the page, or is the page plus a shift that
    another page of the scan shares. A header stands within ``near`` lines of an edge and, digits masked and confusable glyphs made one, recurs
    there on another page of the scan; or, words known from fewer than ``least_known`` scans masked too, it recurs at the
    edges of three scans and nearly never elsewhere.
    """
    lines = _lines(blocks).withColumn("number", F.when(F.col("edge") <= 2, _number(F.col("text"))))
    lines = materialise(lines.withColumn("shift", F.col("number") - F.col("page")))
    shifts = lines.filter("shift <> 0").groupBy("scan_id", "shift").agg(F.count_distinct("page").alias("agree"))
    lines = lines.join(shifts, ["scan_id", "shift"], "left").withColumn("agree", F.coalesce("agree", F.lit(0)))
    lines = lines.withColumn("is_number", F.coalesce((F.col("shift") == 0) | (F.col("agree") >= 2) | F.lower(F.trim("text")).rlike(_LABEL), F.lit(False)) & F.col("number").isNotNull())
    lines = materialise(lines.drop("shift", "agree", "number"))
    # words by the scans that hold them
    words = lines.select("scan_id", F.explode(F.split("key", " ")).alias("w")).filter("w <> ''").distinct()
    known = words.groupBy("w").agg(F.count("*").alias("scans")).filter(F.col("scans") >= least_known).select("w")
    known = materialise(known)
    at_edges = materialise(_masked(lines.filter((F.col("edge") <= near) & ~F.col("is_number")), known))
    often = at_edges.groupBy("part", "key2").agg(F.count_distinct("scan_id").alias("scans")).filter("scans >= if(part = 'whole', 3, 6)").select("part", "key2")
    often = materialise(often)
    # inner lines that could have one of these keys hold the key's first known word in its place
    ws = F.split("key2", " ")
    anchor = F.element_at(F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: ~x["w"].isin("*", "#", "")), 1)
    anchors = often.select("part", anchor.alias("a"), F.size(ws).alias("k")).select(
        F.col("a.w").alias("w"), F.when(F.col("part") != "last", F.col("a.i")).alias("from_start"), F.when(F.col("part") == "last", F.col("k") - F.col("a.i")).alias("from_end")
    ).distinct()
    inner = lines.filter((F.col("edge") > near) & ~F.col("is_number"))
    words_at = inner.select("scan_id", "page", "line_id", F.posexplode(F.split("key", " ")).alias("at", "w"), F.size(F.split("key", " ")).alias("size"))
    here = (F.col("at") == F.col("from_start")) | (F.col("size") - F.col("at") == F.col("from_end"))
    place = ["scan_id", "page", "line_id"]
    like = words_at.join(anchors, "w").filter(here).select(*place).distinct()
    inside = _masked(inner.join(like, place, "left_semi"), known)
    masked = at_edges.unionByName(inside).join(often, ["part", "key2"], "left_semi")
    stats = (
        masked.groupBy("part", "key2")
        .agg(F.avg(F.when(F.col("edge") <= near, 1.0).otherwise(0.0)).alias("share"), F.avg(F.when(F.col("edge") <= 2, 1.0).otherwise(0.0)).alias("close"))
        .filter("share >= 0.95 and close >= 0.9")
        .select("part", "key2")
    )
    common = at_edges.join(stats, ["part", "key2"], "left_semi").select(*place, F.lit(True).alias("common")).distinct()
    at_edge = F.when((F.col("edge") <= near) & ~F.col("is_number"), F.col("page"))
    places = lines.groupBy("key").agg(F.count("*").alias("all"), F.count(at_edge).alias("edges")).filter("edges >= 2 and edges * 10 >= all * 8").select("key")
    again = lines.join(places, "key", "left_semi").groupBy("scan_id", "key").agg(F.count_distinct(at_edge).alias("pages")).filter("pages >= 2")
    lines = lines.join(again, ["scan_id", "key"], "left")
    repeated = (F.col("edge") <= near) & F.col("pages").isNotNull() & F.col("key").rlike("[a-z]{2}|rri")
    lines = lines.join(common, ["scan_id", "page", "line_id"], "left")
    role = F.when(F.col("is_number"), "page_number").when(repeated | F.coalesce("common", F.lit(False)), "header").otherwise("body")
    return lines.select("scan_id", "page", "line_id", "text", role.alias("role"))


def _next_page(firsts: DataFrame, columns: list[str], back: bool = False) -> DataFrame:
    """(scan_id, page, columns...): the columns of the next page with a row, or of the one before.

    ``firsts`` has one short row per page, so even a scan that holds a large share of all lines stays a small window.
    """
    order = W.partitionBy("scan_id").orderBy("page")
    move = F.lag if back else F.lead
    return firsts.select("scan_id", "page", *[move(c).over(order).alias(c) for c in columns])


def _body(lines: DataFrame) -> DataFrame:
    """Body lines with the place of the next one (npage, nline), the word that it begins with, and the hyphen at their end.

    Lines are put in order within their page; only the first word of each page is looked up across pages.
    """
    order = W.partitionBy("scan_id", "page").orderBy("line_id")
    head = F.regexp_extract("text", r"(?U)^\s*([\p{L}|†@01569ﬁﬂ][^\s.,;:()]*)", 1)
    body = lines.filter("role = 'body' and trim(text) <> ''").withColumn("head", head)
    firsts = body.groupBy("scan_id", "page").agg(F.min(F.struct("line_id", "head")).alias("f"))
    firsts = firsts.select("scan_id", "page", F.col("page").alias("npage_"), F.col("f.line_id").alias("nline_"), F.col("f.head").alias("rest_"))
    body = body.withColumn("nline", F.lead("line_id").over(order)).withColumn("rest", F.lead("head").over(order))
    body = body.join(_next_page(firsts, ["npage_", "nline_", "rest_"]), ["scan_id", "page"], "left")
    last = F.col("nline").isNull()
    end = rf"(?U)(\S*[\p{{L}}|†@01569ﬁﬂ])([{HYPHENS}])\s*$"
    return (
        body.withColumn("npage", F.when(last, F.col("npage_")).otherwise(F.col("page")))
        .withColumn("rest", F.coalesce(F.when(last, F.col("rest_")).otherwise(F.col("rest")), F.lit("")))
        .withColumn("nline", F.when(last, F.col("nline_")).otherwise(F.col("nline")))
        .withColumn("cut", F.regexp_extract("text", end, 1))
        .withColumn("mark", F.regexp_extract("text", end, 2))
        .drop("npage_", "nline_", "rest_", "head")
    )


def _bare(word: Column) -> Column:
    """A word without the punctuation around it."""
    return F.regexp_replace(word, r"(?U)^[^\p{L}\p{N}|†@]+|[^\p{L}\p{N}|†@]+$", "")


def repair_lines(lines: DataFrame, often_share: float = 1.5e-4) -> DataFrame:
    """Body lines of the output of ``classify`` with role, defects and repaired text: scan_id, page, line_id, text, role, hyphen BOOLEAN, misread BOOLEAN, fixed.

    ``fixed`` is the body line with misread words replaced; ``hyphen`` tells that its last word goes on in the next body line.
    Null texts count as empty and have no defect, repeated rows count once, rows without scan, page or line number are left
    out, other columns are ignored, an empty table gives an empty one. A word's replacement is the most frequent form of its
    skeleton, if that is at least three times as frequent (twice where the words beside it are found beside that form, too)
    or if the word holds a sign that no word has.
    """
    body = materialise(_body(lines).withColumnRenamed("role", "_role"))
    joined = F.lower(F.concat("cut", "rest"))
    compound = F.lower(F.concat(F.col("cut"), F.lit("-"), F.col("rest")))
    # all words in their places, with the words beside them; a broken word stands once, as a whole
    tokens = F.filter(F.split(F.col("text"), r"(?U)\s+"), lambda w: w != "")
    beside = F.transform("tokens", lambda w, i: F.struct(w.alias("raw"), F.get("tokens", i - 1).alias("before"), F.get("tokens", i + 1).alias("after")))
    spots = body.select("scan_id", "page", "line_id", "mark", tokens.alias("tokens")).select("scan_id", "page", "line_id", "mark", F.posexplode(beside).alias("at", "t"), F.size("tokens").alias("size"))
    inside = ~((F.col("mark") != "") & (F.col("at") == F.col("size") - 1))
    split = lambda c: F.split(F.lower(_bare(c)), r"[-/‐]")
    parts = spots.filter(inside).select(
        "scan_id", "page", "line_id", "at", F.explode(split(F.col("t.raw"))).alias("word"), F.col("t.raw").alias("raw"),
        F.element_at(split(F.col("t.before")), -1).alias("before"), F.element_at(split(F.col("t.after")), 1).alias("after"),
    ).filter(F.length("word") >= 2)
    lexicon = materialise(parts.groupBy("word").agg(F.count("*").alias("n")))
    compounds = materialise(
        spots.filter(inside).select(F.lower(_bare(F.col("t.raw"))).alias("word")).filter(F.col("word").rlike(r"(?U)\p{L}-\p{L}")).groupBy("word").agg(F.count("*").alias("nc"))
    )
    # a word is usual from this share of all words on, whatever the size of the corpus
    usual = (lexicon.agg(F.sum("n")).first()[0] or 0) * often_share
    # broken words
    ends = body.filter("mark <> '' and rest <> ''").select("scan_id", "page", "line_id", "npage", "nline", "mark", "cut", "rest", joined.alias("joined"), compound.alias("compound"))
    bare_compound = _bare(F.col("compound"))
    heads = lexicon.select(skeleton(F.col("word")).alias("sk"), "n").groupBy("sk").agg(F.sum("n").alias("n"))
    cheads = compounds.select(skeleton(F.col("word")).alias("skc"), "nc").groupBy("skc").agg(F.sum("nc").alias("nc"))
    alone = F.element_at(F.split(F.lower(F.col("cut")), "-"), -1)
    last = _bare(F.concat(alone, F.element_at(F.split(F.lower(F.col("rest")), "-"), 1)))
    ends = ends.withColumn("sk", skeleton(last)).withColumn("skc", skeleton(bare_compound)).join(heads, "sk", "left").join(cheads, "skc", "left")
    ends = ends.withColumn("ska", skeleton(alone)).withColumn("skr", skeleton(_bare(F.lower(F.col("rest")))))
    ends = ends.join(heads.select(F.col("sk").alias("ska"), F.col("n").alias("na")), "ska", "left").join(heads.select(F.col("sk").alias("skr"), F.col("n").alias("nr")), "skr", "left")
    n, nc, na, nr = (F.coalesce(c, F.lit(0)) for c in ("n", "nc", "na", "nr"))
    soft = F.col("mark") != "-"
    lower_rest = F.col("rest").rlike(r"(?U)^[\p{Ll}|†@01569ﬁﬂ]") | F.col("cut").rlike(r"(?U)\p{Lu}\p{Lu}$")
    digits = F.col("cut").rlike(r"\d{2}$|^\d+$") | F.col("rest").rlike(r"^\d{2}")
    is_cut = F.when(digits, False).when(soft, True).otherwise(lower_rest & (nc <= n) & ~((n == 0) & (na >= usual) & (nr >= usual)))
    ends = materialise(ends.select("scan_id", "page", "line_id", "npage", "nline", "cut", "rest", "joined", is_cut.alias("hyphen")))
    # misread words: whole ones and broken ones
    # words are judged once each; only occurrences of suspects are looked at again
    none = F.lit(None).cast("string")
    whole = ends.filter("hyphen").select("scan_id", "page", "line_id", F.lit(WHOLE).alias("at"), last.alias("word"), none.alias("raw"), none.alias("before"), none.alias("after")).filter(F.length("word") >= 2)
    moved = ends.filter("hyphen").select("scan_id", F.col("npage").alias("page"), F.col("nline").alias("line_id"), F.lit(0).alias("at"))
    forms = lexicon.withColumn("sk", skeleton(F.col("word")))
    clean = forms.filter(~F.col("word").rlike(r"[^\p{L}]"))
    main = clean.groupBy("sk").agg(F.max(F.struct("n", "word")).alias("m")).select("sk", F.col("m.word").alias("main"), F.col("m.n").alias("often"))
    words = forms.unionByName(whole.select("word").distinct().join(lexicon.select("word"), "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("n")).withColumn("sk", skeleton(F.col("word"))))
    words = words.join(main, "sk", "left").filter(F.col("main").isNull() | (F.col("main") != F.col("word")))
    odd_shape = F.col("word").rlike(rf"(?U)\p{{L}}{_ODD}|{_ODD}\p{{L}}|^[0-9]?\p{{L}}*\p{{Ll}}[015 69]\p{{L}}+$|^[1569]\p{{Ll}}{{3,}}$")
    ids = F.col("word").rlike(r"\d{2}|^\d|\d$") & (F.length(F.regexp_replace("word", r"\D", "")) * 2 > F.length("word"))

    def at_one(glyph: str, read: str) -> Column:
        m = F.col("main")
        spots = F.sequence(F.lit(1), F.greatest(F.length(m), F.lit(1)))
        made = lambda i: F.concat(F.substring(m, F.lit(1), i - 1), F.lit(read), F.substring(m, i + len(glyph), F.length(m)))
        here = lambda i: F.substring(m, i, F.lit(len(glyph))) == glyph
        return (F.replace(m, F.lit(glyph), F.lit(read)) == F.col("word")) | F.exists(spots, lambda i: here(i) & (made(i) == F.col("word")))

    one = F.lit(False)  # letters misread as letters: one class of glyphs, at one place or at all
    for glyph, read in [*CONFUSED, ("rn", "m"), ("cl", "d")]:
        one |= F.col("main").contains(glyph) & at_one(glyph, read)
    sign, rare = F.col("word").rlike(r"[^\p{L}]"), F.greatest("n", F.lit(1))
    verdict = (
        F.when(ids, None)
        .when(F.col("main").isNull(), F.when(odd_shape & (F.length("word") >= 3), "odd"))
        .when(sign, F.when((F.length("word") >= 3) | (F.col("often") >= usual), "sure"))
        .when((F.col("often") >= 2 * rare) & one, F.when(F.col("often") >= 3 * rare, "sure").otherwise("maybe"))
    )
    suspects = materialise(words.withColumn("verdict", verdict).filter("verdict is not null").select("word", "main", "verdict"))
    found = parts.join(suspects, "word").join(moved, ["scan_id", "page", "line_id", "at"], "left_anti").unionByName(whole.join(suspects, "word").select("word", *[c for c in parts.columns if c != "word"], "main", "verdict"))
    mail = F.coalesce(F.col("raw").rlike(r"@[^\s]*\.[^\s.]|[._+\d][^\s@]*@|@.*@"), F.lit(False))
    mail_end = F.coalesce(F.col("raw").rlike(r"[\w.+\-]{3,}@[\w\-]{3,}$"), F.lit(False))  # cut by the line's end
    found = materialise(found.filter(~mail & ((F.col("verdict") != "odd") | ~mail_end)))
    # context: how often the words beside a doubtful one stand beside its frequent form
    doubt = found.filter("verdict = 'maybe'")
    seen = parts.join(doubt.select(F.col("main").alias("word")).distinct(), "word", "left_semi")
    left = seen.groupBy(F.col("word").alias("main"), "before").agg(F.count("*").alias("n_before"))
    right = seen.groupBy(F.col("word").alias("main"), "after").agg(F.count("*").alias("n_after"))
    doubt = doubt.join(left, ["main", "before"], "left").join(right, ["main", "after"], "left").filter(F.coalesce("n_before", F.lit(0)) + F.coalesce("n_after", F.lit(0)) >= 2)
    columns = ["scan_id", "page", "line_id", "at", "word", "raw", F.col("main").alias("right")]
    bad = found.filter("verdict <> 'maybe'").select(*columns).unionByName(doubt.select(*columns))
    # a broken word is misread in the line that holds the wrong part
    place = ["scan_id", "page", "line_id"]
    halves = bad.filter(F.col("at") == WHOLE).join(ends.select(*place, "npage", "nline", "cut", "rest"), place)
    a, b = alone, _bare(F.element_at(F.split(F.lower(F.col("rest")), "-"), 1))
    right = F.coalesce("right", F.regexp_replace("word", _ODD, ""))
    first_ok, second_ok = F.coalesce(right.startswith(a), F.lit(False)) & ~a.rlike(_ODD), F.coalesce(right.endswith(b), F.lit(False)) & ~b.rlike(_ODD)
    here, there = F.struct("page", "line_id"), F.struct(F.col("npage").alias("page"), F.col("nline").alias("line_id"))
    halves = halves.select("scan_id", F.explode(F.filter(F.array(F.when(~first_ok, here), F.when(~second_ok, there)), lambda x: x.isNotNull())).alias("w")).select("scan_id", "w.page", "w.line_id")
    flagged = bad.filter(F.col("at") < WHOLE).select(*place).unionByName(halves).distinct().withColumn("misread", F.lit(True))
    swaps = bad.filter((F.col("at") < WHOLE) & F.col("right").isNotNull()).groupBy(*place).agg(F.array_sort(F.collect_set(F.struct("word", "right"))).alias("swaps"))
    out = body.join(flagged, place, "left").join(swaps, place, "left").join(ends.select(*place, "hyphen"), place, "left")

    def swap(text: Column, s: Column) -> Column:
        return F.regexp_replace(text, F.concat(F.lit(r"(?<![\p{L}\p{N}|†@])(?i:\Q"), s["word"], F.lit(r"\E)(?![\p{L}\p{N}|†@])")), s["right"])

    fixed = F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<word:string,right:string>>")), F.col("text"), lambda t, s: swap(t, s))
    body_out = out.select("scan_id", "page", "line_id", "text", F.col("_role").alias("role"), F.coalesce("hyphen", F.lit(False)).alias("hyphen"), F.coalesce("misread", F.lit(False)).alias("misread"), fixed.alias("fixed"))
    return body_out


def paragraphs(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """(scan_id, para_no, first_page, text): each scan's body as continuous paragraphs in reading order.

    Headers and page numbers are left out, misread words replaced, broken words joined. A paragraph ends at a blank line of the
    page's ``raw_text`` or, where that is null, at a wider line gap by ``bbox``; at the turn of a page it goes on unless its
    last line ends a sentence. Scans without body lines give no row.
    """
    lines = materialise(repair_lines(materialise(classify(blocks))))
    page = W.partitionBy("scan_id", "page").orderBy("line_id")
    t = F.coalesce(F.col("text"), F.lit(""))
    boxes = blocks.select("scan_id", "page", "line_id", t.alias("_t"), F.try_element_at("bbox", F.lit(2)).alias("y")).dropDuplicates(["scan_id", "page", "line_id"])
    boxes = boxes.withColumn("k", F.row_number().over(page)).withColumn("dy", F.col("y") - F.lag("y").over(page))
    boxes = boxes.withColumn("wide", F.col("dy") > 1.5 * F.min("dy").over(W.partitionBy("scan_id", "page"))).drop("_t")
    raw = results.select("scan_id", "page", F.posexplode(F.split("raw_text", "\n")).alias("at", "line"))
    full = W.partitionBy("scan_id", "page").orderBy("at")
    raw = raw.withColumn("gap", F.coalesce(F.lag(F.trim("line") == "").over(full), F.lit(False))).filter("trim(line) <> ''")
    raw = raw.withColumn("k", F.row_number().over(full)).groupBy("scan_id", "page", "k").agg(F.max("gap").alias("gap"))
    rows = lines.join(boxes, ["scan_id", "page", "line_id"], "left").join(raw, ["scan_id", "page", "k"], "left")
    order = W.partitionBy("scan_id", "page").orderBy("line_id")
    rows = materialise(rows.withColumn("ended", F.col("text").rlike(r"[.!?:।][\"'”)]*\s*$")).withColumn("n", F.row_number().over(order)))
    ends = rows.groupBy("scan_id", "page").agg(F.max(F.struct("line_id", "ended")).alias("e")).select("scan_id", "page", F.col("e.ended").alias("before"))
    rows = rows.join(_next_page(ends, ["before"], back=True), ["scan_id", "page"], "left")
    start = F.when(F.col("n") == 1, F.coalesce("before", F.lit(True))).otherwise(F.coalesce("gap", "wide", F.lit(False)))
    rows = rows.withColumn("start", F.when(start, 1).otherwise(0))
    # number of the paragraph: those begun on earlier pages and those begun on this one so far
    begun = rows.groupBy("scan_id", "page").agg(F.sum("start").alias("s"))
    earlier = W.partitionBy("scan_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    begun = begun.select("scan_id", "page", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("earlier"))
    rows = rows.join(begun, ["scan_id", "page"]).withColumn("para_no", F.col("earlier") + F.sum("start").over(order))
    part = F.when(F.col("hyphen"), F.regexp_replace(F.rtrim("fixed"), rf"[{HYPHENS}]$", "")).otherwise(F.concat(F.trim("fixed"), F.lit(" ")))
    whole = F.array_sort(F.collect_list(F.struct("page", "line_id", part.alias("p"))))
    return rows.groupBy("scan_id", "para_no").agg(F.min("page").alias("first_page"), F.trim(F.array_join(F.transform(whole, lambda x: x["p"]), "")).alias("text"))


def find_defects(blocks: DataFrame) -> DataFrame:
    """(scan_id, page, line_id, defect), defect being header, page_number, hyphen or misread.

    Null texts count as empty; see ``classify`` and ``repair_lines``."""
    lines = materialise(classify(blocks))
    edges = lines.filter("role <> 'body'").select("scan_id", "page", "line_id", F.col("role").alias("defect"))
    body = repair_lines(lines)
    kinds = F.filter(F.array(F.when(F.col("hyphen"), "hyphen"), F.when(F.col("misread"), "misread")), lambda x: x.isNotNull())
    return edges.unionByName(body.select("scan_id", "page", "line_id", F.explode(kinds).alias("defect")))
