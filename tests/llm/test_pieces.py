import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calamus.llm import pieces

SCHEMA = "work_id bigint, file_name string, text string, lang string, piece string, _id bigint, _text string"


def works(spark, rows):
    return spark.createDataFrame([(i, None, t, None, "clash", 7, "clash") for i, t in rows], SCHEMA)


def check(text, limit, overlap):
    spans, tree = pieces.structure(text)
    words = text.split()
    assert [text[a:b] for a, b in spans] == words
    cuts = pieces.pack(tree, limit, overlap)
    assert [c[0] for c in cuts[1:]] == [c[1] for c in cuts[:-1]]
    if words:
        assert cuts[0][0] == 0 and cuts[-1][1] == len(words)
    assert all(hi - lo + min(overlap, lo) <= limit and hi > lo for lo, hi, _ in cuts)
    return cuts


TEXTS = st.lists(st.sampled_from(["een", "Twee", "drie.", "Vier!", 'vijf?"', "\n\n", "\n", "\r\n \r\n", "# Kop", "(Zes", "zeven…»"]), max_size=200).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(5, 30), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, overlap)


def test_sentences_and_paragraphs():
    _, tree = pieces.structure('Een twee. Drie "vier." Vijf. zes 3.5 zeven? (Acht) negen… Tien\n \t\nElf.')
    paragraphs = [p for s in tree.parts for p in s.parts]
    assert [p.hi - p.lo for p in paragraphs] == [11, 1]
    assert [s.hi - s.lo for s in paragraphs[0].parts] == [2, 2, 4, 2, 1]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("w " * 8 + "\n\n" + "w " * 8, "paragraph"), ("W w w w w w. " * 3, "sentence"), ("w " * 15, "word"), ("w " * 8 + "\n\n" + "w " * 11, "word"), ("w " * 10, None),
    ],
)
def test_finest_cut(spark, text, want):
    got = pieces.needed_cuts(pieces.cut_works(works(spark, [(1, text)]), 10, 2), 10).collect()
    assert [r["finest_cut"] for r in got] == ([want] if want else [])


def test_cuts_fall_on_boundaries():
    text = "\n\n".join(" ".join(["w"] * 9) for _ in range(10))
    assert {level for _, _, level in check(text, 30, 3)} == {"paragraph"}
    text = " ".join("W w w w w." for _ in range(40))
    assert {level for _, _, level in check(text, 30, 3)[:-1]} == {"sentence"}


def test_headings_keep_sections_together():
    text = "\n\n".join(["# A", "w " * 8, "w " * 4, "# B", "w " * 8, "w " * 4])
    assert check(text, 20, 2)[0][1] == 14


def test_nested_sections_lists_and_lines():
    text = "# A\n\nw w w\n\n## B\n\nx x\n\n- a a\n\n  - b b\n\n- c\n\n# C\n\nend."
    _, tree = pieces.structure(text)
    a, c = tree.parts
    assert [(n.lo, n.hi, n.level) for n in (a, c)] == [(0, 17, "section"), (17, 20, "section")]
    b = a.parts[-1]
    assert b.level == "section" and (b.lo, b.hi) == (5, 17)
    item = b.parts[2]
    assert len(item.parts) == 2 and (item.lo, item.hi) == (9, 15)  # an item and the one set in below it
    # Whole siblings are merged, parts of different sections never.
    assert pieces.pack(tree, 10, 1) == [(0, 5, "paragraph"), (5, 9, "paragraph"), (9, 17, "section"), (17, 20, "section")]
    _, tree = pieces.structure("1. x y\n2. z\n\n<h2>T</h2>\n\nfoo")
    assert [lvl for _, _, lvl in pieces.pack(tree, 3, 0)] == ["line", "section", "section"]


def test_table(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, "een twee"), (1, "een twee"), (2, None), (3, " \n\t "), (None, "x"), (4, long), (5, "﻿Een")]
    got = pieces.cut_works(works(spark, rows), 1000, 50).collect()
    assert {r["work_id"] for r in got} == {1, 4, 5} and sum(r["work_id"] == 1 for r in got) == 1
    mine = sorted((r for r in got if r["work_id"] == 4), key=lambda r: r["piece"])
    words = [w for r in mine for w in r["text"].split()[r["overlap"] :]]
    assert words == long.split() and all(r["n_words"] == len(r["text"].split()) <= 1000 for r in mine)
    for a, b in zip(mine, mine[1:], strict=False):
        assert b["overlap"] == 50 and b["text"].split()[:50] == a["text"].split()[-50:]
    assert pieces.cut_works(works(spark, [])).count() == 0


def naive(text):
    """The statement of the problem, written another way: what must be cut in a text of more than 1,000 words."""
    if len(text.split()) <= 1000:
        return None
    finest = "paragraph"
    for p in re.split(r"\n\s*?\n", text.replace("\r\n", "\n").replace("\r", "\n")):
        if len(p.split()) > 1000:
            ends = re.sub(r"""([.!?…][)\]}"'»”’›]*)\s+(?=[A-ZÀ-ÖØ-Þ("'«“‘„‚‹\[{])""", "\\1\x00", p)
            finest = "word" if any(len(s.split()) > 1000 for s in ends.split("\x00")) else ("sentence" if finest != "word" else finest)
            if finest == "word":
                return finest
    return finest


def test_real_works(spark, sf):
    df = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/raw_works.parquet")
    want = {r["work_id"]: naive(r["text"]) for r in df.collect() if r["text"]}
    got = {r["work_id"]: r["finest_cut"] for r in pieces.needed_cuts(pieces.cut_works(df)).collect()}
    assert got == {k: v for k, v in want.items() if v}
