"""Problem 5: splitting oversized texts at natural boundaries, by packing a structure tree."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calamus.llm.records import once

SCHEMA = "work_id bigint, piece int, first_word int, n_words int, overlap int, ends_at string, work_words int, finest_cut string, text string"
LINE = re.compile(r"\r\n|\r|\n")
HEADING = re.compile(r"\s{0,3}(?:(#{1,6})\s|<h([1-6])\b)", re.IGNORECASE)
ITEM = re.compile(r"(\s*)(?:[-*+•·‣]\s|\(?\d{1,4}[.)]\s|\(?[a-z][.)]\s|<li\b)")
#: Headings have six ranks; lists set in more deeply than this stay on one level.
MAX_DEPTH = 40


@lru_cache(maxsize=1)
def sentence_patterns() -> tuple[re.Pattern, re.Pattern]:
    """What a word ends with at the end of a sentence, and what the next one then begins with."""
    by: dict[str, list[str]] = {}
    for code in range(sys.maxunicode + 1):
        by.setdefault(unicodedata.category(chr(code)), []).append(chr(code))
    quotes = "\"'"
    closing = "".join(map(re.escape, [*by["Pe"], *by["Pf"], *by["Pi"], *quotes]))
    opening = "".join(map(re.escape, [*by["Ps"], *by["Pi"], *by["Pf"], *quotes, "‚", "„"]))
    capital = "".join([*by["Lu"], *by["Lt"]])
    return re.compile(rf"[.!?…][{closing}]*\Z"), re.compile(rf"[{opening}{capital}]")


class Node:
    """A span of words [lo, hi) with its parts; a node without parts is cut between words. `level` is what it ends with."""

    __slots__ = ("hi", "level", "lo", "parts")

    def __init__(self, lo: int, hi: int, level: str, parts: list[Node] | None = None):
        self.lo, self.hi, self.level, self.parts = lo, hi, level, parts or []


#: What a piece may end with, coarsest first, and what that is called as the finest cut of a work.
LEVELS = ("section", "paragraph", "sentence", "line", "word")
CALLED = {"section": "paragraph", "paragraph": "paragraph", "sentence": "sentence", "line": "word", "word": "word"}


def _outline(blocks: list[tuple[Node, tuple[str, int] | None]], depth: int = 0) -> list[Node]:
    """Blocks in the order of the text as nested sections: a heading opens a section that lasts to the next heading of its
    rank or a higher one; an item of a list takes the deeper items that follow it as its parts."""
    out: list[Node] = []
    i = 0
    while i < len(blocks):
        node, mark = blocks[i]
        j = i + 1
        if mark and depth < MAX_DEPTH:
            kind, rank = mark
            while j < len(blocks) and not _closes(kind, rank, blocks[j][1]):
                j += 1
            if j > i + 1:
                inner = _outline(blocks[i + 1 : j], depth + 1)
                node = Node(node.lo, inner[-1].hi, "section" if kind == "heading" else "paragraph", [node, *inner])
        out.append(node)
        i = j
    return out


def _closes(kind: str, rank: int, other: tuple[str, int] | None) -> bool:
    if kind == "heading":
        return other is not None and other[0] == "heading" and other[1] <= rank
    return other is None or other[0] == "heading" or other[1] <= rank


def _mark(first_line: str) -> tuple[str, int] | None:
    """Whether a block is a heading (and of which rank) or an item of a list (and how far it is set in)."""
    if m := HEADING.match(first_line):
        return "heading", len(m[1]) if m[1] else int(m[2])
    if m := ITEM.match(first_line):
        return "item", len(m[1].expandtabs(4))
    return None


def structure(text: str) -> tuple[list[tuple[int, int]], Node]:
    """Word spans of the text (start, end), and its tree: work > sections, nested by the rank of their heading (`#` or `<h1>`)
    > paragraphs, items of lists nested by how far they are set in > sentences > lines. The beginning before any heading is a section."""
    end, begin = sentence_patterns()
    spans: list[tuple[int, int]] = []
    blocks: list[tuple[Node, tuple[str, int] | None]] = []
    at = 0
    start = 0  # first word of the paragraph
    lines: list[int] = []  # words at which its lines end
    first = ""  # its first line

    def close() -> None:
        nonlocal start
        if start == len(spans):
            return
        words = [text[a:b] for a, b in spans[start:]]
        ends = [start + i + 1 for i in range(len(words) - 1) if end.search(words[i]) and begin.match(words[i + 1])] + [len(spans)]
        sentences = []
        k = 0
        for a, b in zip([start, *ends[:-1]], ends, strict=True):
            breaks = []
            while k < len(lines) and lines[k] < b:
                if lines[k] > a:
                    breaks.append(lines[k])
                k += 1
            parts = [Node(x, y, "line") for x, y in zip([a, *breaks], [*breaks, b], strict=True)] if breaks else []
            sentences.append(Node(a, b, "sentence", parts))
        blocks.append((Node(start, len(spans), "paragraph", sentences), _mark(first)))
        lines.clear()
        start = len(spans)

    for m in [*LINE.finditer(text), None]:
        a, b = at, m.start() if m else len(text)
        before = len(spans)
        spans.extend((a + w.start(), a + w.end()) for w in re.finditer(r"\S+", text[a:b]))
        if len(spans) == before:
            close()
        else:
            if before == start:
                first = text[a:b]
            lines.append(len(spans))
        at = m.end() if m else b
    close()
    head = next((i for i, (_, mark) in enumerate(blocks) if mark and mark[0] == "heading"), len(blocks))
    level = "section" if head < len(blocks) else "paragraph"  # without a heading there are no sections
    top = []
    if head:
        opening = _outline(blocks[:head])
        top.append(Node(opening[0].lo, opening[-1].hi, level, opening))
    top += _outline(blocks[head:])
    return spans, Node(0, len(spans), level, top)


def pack(tree: Node, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(lo, hi, level at which it ends) of consecutive pieces, bottom-up: a subtree within the limit is one piece, a larger one
    is its parts' pieces, of which neighbours that are whole subtrees are merged up to the limit. So a piece joins siblings,
    never parts of different sections. Every piece but the first repeats `overlap` words, so its room is that much smaller."""

    def room(lo: int) -> int:
        return limit if lo == tree.lo else limit - overlap

    def whole(node: Node) -> bool:
        return node.hi - node.lo <= room(node.lo)

    def pieces(node: Node) -> list[tuple[int, int, str]]:
        if whole(node):
            return [(node.lo, node.hi, node.level)]
        out: list[tuple[int, int, str]] = []
        if not node.parts:
            lo = node.lo
            while node.hi - lo > room(lo):
                out.append((lo, lo + room(lo), "word"))
                lo += room(lo)
            out.append((lo, node.hi, node.level))
            return out
        open_ = False  # whether the last piece is made of whole siblings, so that it may grow
        for part in node.parts:
            if not whole(part):
                out += pieces(part)
                open_ = False
            elif open_ and part.hi - out[-1][0] <= room(out[-1][0]):
                out[-1] = (out[-1][0], part.hi, part.level)
            else:
                out.append((part.lo, part.hi, part.level))
                open_ = True
        lo, hi, _ = out[-1]
        out[-1] = (lo, hi, node.level)  # what ends with its parent ends as that does
        return out

    return pieces(tree) if tree.hi > tree.lo else []


def finest_cut(tree: Node, limit: int) -> str:
    """The finest level at which the packing cuts if nothing need be repeated: what the work cannot do without."""
    cuts = [level for _, _, level in pack(tree, limit, 0)[:-1]]
    return CALLED[max(cuts, key=LEVELS.index, default="section")]


def _cut(limit: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for work, text in zip(frame["_id"], frame["_text"], strict=True):
                spans, tree = structure(text)
                n = len(spans)
                if not n:
                    continue
                finest = finest_cut(tree, limit) if n > limit else None
                for k, (lo, hi, level) in enumerate(pack(tree, limit, overlap)):
                    back = min(overlap, lo)
                    rows.append((work, k + 1, lo, hi - lo + back, back, level, n, finest, text[spans[lo - back][0] : spans[hi - 1][1]]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def cut_works(works: DataFrame, limit: int = 1000, overlap: int = 50, id_col: str = "work_id", text_col: str = "text") -> DataFrame:
    """Consecutive pieces of at most `limit` words (separated by white space), each but the first beginning with the last
    `overlap` words of the one before, cut at the end of a section or paragraph, else of a sentence, of a line, else between words.

    Columns: work_id, piece (from 1), first_word (of what is new, from 0), n_words (with the overlap), overlap, ends_at
    (section, paragraph, sentence, line, word), work_words, finest_cut (NULL for a work within the limit), text.
    Defined results: NULL texts, blank texts and NULL ids give no row; a work within the limit is one piece; repeated records
    count once; other columns are ignored. Each text is read whole, by one Arrow-fed function; nothing else is in Python.
    """
    rows = once(works.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id")
    pieces = rows.select("_id", "_text").mapInPandas(_cut(limit, overlap), SCHEMA)
    return pieces if id_col == "work_id" else pieces.withColumnRenamed("work_id", id_col)


def needed_cuts(pieces: DataFrame, limit: int = 1000) -> DataFrame:
    """(work_id, finest_cut) of the works over the limit: read off their first pieces."""
    return pieces.where((F.col("piece") == 1) & (F.col("work_words") > limit)).select("work_id", "finest_cut")
