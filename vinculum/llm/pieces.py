"""Oversized texts cut at natural boundaries by packing a structure tree.

Headings (with their depth), block markup, nested list items, fenced blocks, paragraphs and lines are parsed into a tree; lines
have sentences, words and tokens below them, which are looked for only where a line is too long. Sibling subtrees are merged to
the limit within their parent, and only nodes over the limit are descended into, so no part of an oversized node is glued to
what stands outside it. Sizes are tokens of a byte-level vocabulary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm import vocabulary

_TAG = re.compile(r"<(/?)(article|section|div|blockquote|ul|ol|li|table|tr|p|h[1-6])\b[^>]*>", re.I)
_HASHES = re.compile(r"(#{1,6})[ \t]")
_CAPITALS = re.compile(r"[A-Z][A-Z0-9 .,:&/\-]{5,79}$")
_NUMBERED = re.compile(r"(\d+(?:\.\d+)*)[.)]?[ \t]+[A-Z][^.!?]{0,60}$")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•]|\d+[.)]|[a-z][.)]|\([a-z0-9]{1,3}\))[ \t]+")
_FENCE = re.compile(r"[ \t]*(?:```|~~~)")
_FINER = {
    "paragraph": ("line", re.compile(r"(?<=\n)(?=[^\n])")),
    "line": ("sentence", re.compile(r"(?<=[.!?।])(?=\s+\S)|(?<=[.!?।][\"'”’)])(?=\s+\S)")),
    "sentence": ("word", re.compile(r"(?<=\S)(?=\s)")),
}


@dataclass
class Node:
    """Part start..end (characters) of a text; the children cover it without gaps, if there are any."""

    kind: str
    start: int
    end: int = 0
    children: list[Node] = field(default_factory=list)


def _depth_of_heading(line: str, following: str) -> int | None:
    """1 to 9: depth of the heading that a line is; lines in capitals stand above numbered ones."""
    m = _HASHES.match(line)
    if m:
        return len(m[1])
    if _CAPITALS.match(line):
        return 1
    m = _NUMBERED.match(line)
    if m and following.strip() and not _ITEM.match(following):
        return min(9, 2 + m[1].count("."))
    return None


def _blocks(text: str, start: int, end: int, parent: Node) -> None:
    """Append the blocks of text[start:end] to ``parent``: sections by headings, lists, fenced blocks and paragraphs."""
    sections: list[tuple[int, Node]] = [(0, parent)]
    items: list[tuple[int, Node]] = []
    paragraph: Node | None = None
    fence: Node | None = None
    lines = [(m.start(), m.group()) for m in re.compile(r"[^\n]*\n|[^\n]+$").finditer(text, start, end)]

    def add(kind: str, at: int, holder: Node) -> Node:
        node = Node(kind, at)
        holder.children.append(node)
        return node

    for k, (at, line) in enumerate(lines):
        bare = line.strip()
        if fence is not None:
            if _FENCE.match(line):
                fence = None
            continue
        if _FENCE.match(line):
            paragraph, fence = None, add("paragraph", at, sections[-1][1])
            items = []
            continue
        if not bare:
            paragraph = None
            continue
        depth = _depth_of_heading(line.rstrip("\r\n"), lines[k + 1][1] if k + 1 < len(lines) else "") if paragraph is None else None
        if depth:
            while sections[-1][0] >= depth:
                sections.pop()
            section = add("section", at, sections[-1][1])
            sections.append((depth, section))
            items = []
            paragraph = add("paragraph", at, section)  # the heading stays with what follows
            continue
        m = _ITEM.match(line)
        if m and (paragraph is None or items or line[: m.end()].strip()[0] in "-*+•"):
            indent = len(m[1].expandtabs(4))
            while items and items[-1][0] > indent:
                items.pop()
            if items and items[-1][0] == indent:
                holder = items.pop()[2]
            elif items:
                holder = add("list", at, items[-1][1])
            else:
                holder = add("list", at, sections[-1][1])
            item = add("item", at, holder)
            items.append((indent, item, holder))
            paragraph = add("paragraph", at, item)
            continue
        if paragraph is None:
            if items and not line[0].isspace():
                items = []
            paragraph = add("paragraph", at, items[-1][1] if items else sections[-1][1])


def _close(node: Node, end: int) -> None:
    """Set the ends: each child ends where the next begins, the first begins with its parent."""
    node.end = end
    if node.children:
        node.children[0].start = node.start
    for child, after in zip(node.children, [*(c.start for c in node.children[1:]), end]):
        _close(child, after)


def parse(text: str) -> Node:
    """The structure tree of a text. Block tags that are closed make nodes; what stands in them and around them is read by lines."""
    root = Node("text", 0)
    open_: list[tuple[str, Node]] = [("", root)]
    at = 0
    for m in _TAG.finditer(text):
        name = m[2].lower()
        if not m[1]:
            _blocks(text, at, m.start(), open_[-1][1])
            node = Node("markup", m.start())
            open_[-1][1].children.append(node)
            open_.append((name, node))
            at = m.start()
        elif any(n == name for n, _ in open_):
            _blocks(text, at, m.end(), open_[-1][1])
            while open_.pop()[0] != name:
                pass
            at = m.end()
    _blocks(text, at, len(text), open_[-1][1])
    _close(root, len(text))
    return root


class Places:
    """Token boundaries of a text by character."""

    def __init__(self, text: str, ids: list[int], path: str):
        self.text = text
        raw = text.encode()
        self.offsets = np.concatenate([[0], np.cumsum(vocabulary.byte_lengths(path)[ids])])
        data = np.frombuffer(raw, dtype=np.uint8)
        heads = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(raw)]])
        at = np.searchsorted(self.offsets, heads)
        at[self.offsets[np.minimum(at, len(self.offsets) - 1)] != heads] = -1
        self.token = at  # token that begins at each character, or -1

    def near(self, at: int) -> int | None:
        """The token boundary at character ``at`` or in the white space before it."""
        while self.token[at] < 0:
            if at == 0 or not self.text[at - 1].isspace():
                return None
            at -= 1
        return int(self.token[at])


def _parts(node: Node, text: str) -> list[Node]:
    """The children of a node; of one without, what the next finer kind of boundary makes of it."""
    if node.children:
        return node.children
    kind = node.kind if node.kind in _FINER or node.kind == "word" else "paragraph"
    while kind in _FINER:
        kind, pattern = _FINER[kind]
        cuts = [m.start() for m in pattern.finditer(text, node.start, node.end) if node.start < m.start() < node.end]
        if cuts:
            edges = [node.start, *cuts, node.end]
            return [Node(kind, a, b) for a, b in zip(edges, edges[1:])]
    return []


def pack(node: Node, places: Places, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """Token ranges of at most ``limit`` that cover start..end, the tokens of ``node``: merged siblings, and the parts of children that are too large."""
    if end - start <= limit:
        return [(start, end)]
    children = _parts(node, places.text)
    edges, kept = [], []
    for child in children:
        k = start if not edges else places.near(child.start)
        if k is None or edges and k <= edges[-1] or k >= end:  # no token begins there: it stays with the one before
            if kept:
                kept[-1] = Node(kept[-1].kind, kept[-1].start, child.end)
            continue
        edges.append(k)
        kept.append(child)
    if len(kept) < 2:
        return pack(kept[0], places, start, end, limit) if kept else _tokens(places, start, end, limit)
    edges.append(end)
    out: list[tuple[int, int]] = []
    open_ = False  # whether the last range may grow
    for child, a, b in zip(kept, edges, edges[1:]):
        if b - a > limit:
            out += pack(child, places, a, b, limit)
            open_ = False
        elif open_ and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
            open_ = True
    return out


def _tokens(places: Places, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """Ranges of ``limit`` tokens, or up to the last one before that at which a character begins."""
    heads = places.token[places.token >= 0]
    out = []
    while end - start > limit:
        k = int(heads[np.searchsorted(heads, start + limit, side="right") - 1])
        k = k if k > start else start + limit  # one character of more tokens than the limit
        out.append((start, k))
        start = k
    return [*out, (start, end)]


def cut(text: str, path: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first token, end token, first byte, end byte) of the pieces of ``text``.

    A text within the limit is one piece. Otherwise each piece but the first begins with the last ``overlap`` tokens of the
    one before, so its new content is at most limit - overlap. A shared part that begins inside a character is widened to the
    whole character in its bytes, not in its tokens. Pieces encoded anew keep the limit, too.
    """
    encoding = vocabulary.encoding(path)
    ids = encoding.encode_ordinary(text)
    raw = text.encode()
    if len(ids) <= limit:
        return [(0, len(ids), 0, len(raw))]
    places, tree = Places(text, ids, path), parse(text)
    room = limit - overlap
    while True:
        fresh = pack(tree, places, 0, len(ids), room)
        if fresh[0][1] < overlap:  # too short to be shared: the first takes in what follows, and what is then too long is cut below the structure
            stop = next((b for _, b in fresh if b >= overlap), len(ids))
            fresh = [*_tokens(places, 0, stop, room), *(r for r in fresh if r[0] >= stop)]
            if len(fresh) > 1 and fresh[0][1] < overlap:
                fresh[:2] = [(0, room), (room, fresh[1][1])]
        out = []
        for a, b in fresh:
            a = max(0, a - overlap)
            start, stop = int(places.offsets[a]), int(places.offsets[b])
            while start > 0 and raw[start] & 0xC0 == 0x80:
                start -= 1
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                stop += 1
            out.append((a, b, start, stop))
        over = max(len(encoding.encode_ordinary(raw[x:y].decode())) for _, _, x, y in out) - limit
        if over <= 0 or room - over < 2 * overlap or room - over < 1:
            return out
        room -= over


def split_oversized(
    df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2000, overlap: int = 100, path: str | None = None, with_text: bool = True, with_tokens: bool = True,
) -> DataFrame:
    """(``key``, piece_no, n_pieces, first_token, end_token, n_tokens, piece): the pieces of every row in order.

    Null texts give one piece with null text and no tokens, empty ones one with the empty text. Repeated keys are cut each for
    itself. Without ``with_text`` the column piece is left out, without ``with_tokens`` the three token columns; rows of at most
    ``limit`` bytes can't have more than ``limit`` tokens, so they then needn't be encoded. limit must be at least three times overlap.
    """
    if limit < 3 * overlap or overlap < 0:
        raise ValueError("limit must be at least three times overlap")
    path = path or vocabulary.default_path()
    kind = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    names = ["_k", "piece_no", "n_pieces", *(["first_token", "end_token", "n_tokens"] if with_tokens else []), *(["piece"] if with_text else [])]
    kinds = {"_k": kind, "piece": "string"}
    schema = ", ".join(f"{n} {kinds.get(n, 'int')}" for n in names)

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for k, t in zip(f["_k"], f["_t"]):
                parts = cut(t, path, limit, overlap) if t is not None else [(0, 0, 0, 0)]
                raw = t.encode() if with_text and t is not None else None
                for i, (a, b, x, y) in enumerate(parts):
                    rows.append((k, i, len(parts), *((a, b, b - a) if with_tokens else ()), *((raw[x:y].decode() if raw is not None else None,) if with_text else ())))
            yield pd.DataFrame(rows, columns=names).astype({n: object for n in names if n in kinds})

    if with_tokens:
        return base.mapInPandas(run, schema).withColumnRenamed("_k", key)
    long = F.octet_length("_t") > limit
    small = base.filter(F.coalesce(~long, F.lit(True))).select("_k", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), *([F.col("_t").alias("piece")] if with_text else []))
    return base.filter(long).mapInPandas(run, schema).unionByName(small).withColumnRenamed("_k", key)
