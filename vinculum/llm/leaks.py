"""Evaluation passages inside a corpus, by Wu-Manber search for many strings at once.

A window of twenty successive words with at most one of them changed or dropped holds ten untouched successive words, and so
one of the passage's strings of eight words that begin at every third word. These strings, without case, punctuation and
spacing, are the patterns: block shift tables skip positions at which none can end, buckets by the hash of the last block
select patterns, direct comparison confirms them, and each occurrence is then extended over the passage's words.
"""

from __future__ import annotations

import bisect
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NOT_WORD = re.compile(r"[\W_]+")


def squeeze(text: str) -> str:
    """Text without case, punctuation and spacing."""
    return _NOT_WORD.sub("", text.casefold())


def passage_words(text: str) -> list[str]:
    return [w for w in map(squeeze, text.split()) if w]


class Searcher:
    """Shift and bucket tables over all passages.

    ``need`` words with at most one error must match; patterns have ``width`` words and begin at every ``stride``-th word,
    where width + stride - 1 <= need / 2 keeps every match findable. Passages of fewer than ``need`` words match nothing.
    """

    def __init__(self, passages: list[tuple[int, str]], need: int = 20, width: int = 8, stride: int = 3, block: int = 7):
        self.need, self.width = need, width
        if width + stride - 1 > need // 2:
            raise ValueError("a window could hold no pattern")
        self.items, patterns = {}, {}
        for item, text in passages:
            words = passage_words(text or "")
            if item is None or len(words) < need:
                continue
            starts = [0]
            for w in words:
                starts.append(starts[-1] + len(w))
            key = len(self.items)
            self.items[key] = (item, words, starts, "".join(words))
            for k in range(0, len(words) - width + 1, stride):
                patterns.setdefault("".join(words[k : k + width]), []).append((key, k))
        self.patterns = patterns
        self.m = min(map(len, patterns), default=0)
        self.block = max(1, min(block, self.m // 2))
        self.shift: dict[str, int] = {}
        self.buckets: dict[str, list[str]] = {}
        for p in patterns:
            for end in range(self.block, self.m + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.m), self.m - end)
            self.buckets.setdefault(p[self.m - self.block : self.m], []).append(p)
        self.skip = self.m - self.block + 1

    def find(self, text: str) -> set[int]:
        """Items of which ``text`` holds ``need`` words."""
        if not self.patterns:
            return set()
        s = squeeze(text)
        found, bounds = set(), None
        m, size, shift, skip, n = self.m, self.block, self.shift, self.skip, len(s)
        get = shift.get
        end = m
        while end <= n:
            step = get(s[end - size : end], skip)
            if step:
                end += step
                continue
            at = end - m
            for p in self.buckets[s[end - size : end]]:
                if s.startswith(p, at):
                    if bounds is None:
                        bounds = [0]
                        for w in passage_words(text):
                            bounds.append(bounds[-1] + len(w))
                    for key, k in self.patterns[p]:
                        if self.items[key][0] not in found and self.covered(key, k, s, at, at + len(p), bounds) >= self.need:
                            found.add(self.items[key][0])
            end += 1
        return found

    def covered(self, key: int, k: int, s: str, left: int, right: int, bounds: list[int]) -> int:
        """Most successive words of the passage around word ``k`` that ``s`` holds with at most one of them wrong or missing.

        A run of untouched words begins and ends at word bounds of the text; inside it spacing doesn't count.
        """
        words, edges = self.items[key][1], set(bounds)
        a, b, x, y = k, k + self.width, left, right  # words a..b-1 match s[x:y]
        while a > 0 and s.endswith(words[a - 1], 0, x):
            a -= 1
            x -= len(words[a])
        while b < len(words) and s.startswith(words[b], y):
            y += len(words[b])
            b += 1
        while a < b and x not in edges:
            x += len(words[a])
            a += 1
        while a < b and y not in edges:
            b -= 1
            y -= len(words[b])
        best = b - a
        if a > 0:  # word a - 1 is wrong, missing or merely the last of the quote
            before = bounds[max(0, bisect.bisect_left(bounds, x) - 1)]
            best = max(best, b - a + 1 + max(self._back(words, a - 1, s, p, edges) for p in (x, before)))
        if b < len(words):
            after = bounds[min(len(bounds) - 1, bisect.bisect_right(bounds, y))]
            best = max(best, b - a + 1 + max(self._on(words, b + 1, s, p, edges) for p in (y, after)))
        return best

    @staticmethod
    def _back(words, a, s, x, edges):
        n = best = 0
        while a > 0 and s.endswith(words[a - 1], 0, x):
            a, n = a - 1, n + 1
            x -= len(words[a])
            best = n if x in edges else best
        return best

    @staticmethod
    def _on(words, b, s, y, edges):
        n = best = 0
        while b < len(words) and s.startswith(words[b], y):
            y += len(words[b])
            b, n = b + 1, n + 1
            best = n if y in edges else best
        return best


_SEARCHERS: dict[tuple, Searcher] = {}


def _searcher(batch: str, need: int, passages: list[tuple]) -> Searcher:
    """The tables of a batch of items, built once in each Python process; only the latest are kept."""
    key = batch, need
    if key not in _SEARCHERS:
        if len(_SEARCHERS) >= 4:
            _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher(passages, need)
    return _SEARCHERS[key]


def find_leaks(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage",
    need: int = 20, most_items: int = 100_000,
) -> DataFrame:
    """(``doc``, ``item``): documents that hold ``need`` successive words of an item's passage, at most one of them wrong.

    Words are split at white space; case, punctuation and spacing don't count. Null and empty texts and passages, and passages
    of fewer words, match nothing. Rows are distinct; a null document id is kept as null; extra columns are not returned.
    The corpus is scanned, whole, once for each batch of items, without a shuffle before the final distinct. One batch holds
    them all up to ``most_items``; more are divided by hash into batches of about half as many, whose tables are broadcast in turn.
    """
    spark = documents.sparkSession
    kinds = documents.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    wanted = items.select(F.col(item).alias("_i"), F.col(passage).alias("_p")).filter("_i is not null and _p is not null").distinct()
    texts = documents.select(F.col(doc).alias("_d"), F.col(text).alias("_t")).filter("_t <> ''")
    count = wanted.count()
    batches = 1 if count <= most_items else -(-2 * count // most_items)
    found = None
    for k in range(batches):
        part = wanted if batches == 1 else wanted.filter(F.pmod(F.xxhash64("_i", "_p"), F.lit(batches)) == k)
        shared, name = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()]), uuid.uuid4().hex

        def scan(frames, shared=shared, name=name):
            import pandas as pd

            searcher = _searcher(name, need, shared.value)
            for f in frames:
                out = [(d, i) for d, t in zip(f["_d"], f["_t"]) for i in sorted(searcher.find(t))]
                yield pd.DataFrame({"_d": pd.Series([x[0] for x in out], dtype=object), "_i": pd.Series([x[1] for x in out], dtype=object)})

        one = texts.mapInPandas(scan, f"_d {kinds[0]}, _i {kinds[1]}")
        found = one if found is None else found.unionByName(one)
    return found.distinct().select(F.col("_d").alias(doc), F.col("_i").alias(item))
