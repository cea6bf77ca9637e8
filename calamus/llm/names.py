"""Problem 6: variant spellings of names typed by people, by pigeonhole segment joins."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calamus.session import broadcast_if_small, materialize

# Particles of Dutch surnames as they are written, written together, and shortened.
PARTICLES = frozenset("van von de den der ter ten te het 't vanden vander vande vd v d t vdr vdn".split())
GLUED = re.compile(r"^(vanden|vander|vande|van|den|der|de|ter|ten|te)$")
# Labels for a writer who is not known, letters only.
UNKNOWN = ("onbekend", "onbekent", "nietbekend", "anoniem", "anonymus", "anonym", "unknown", "onb", "nn", "nomennescio", "zondernaam", "naamloos", "geen", "")
READING = "given string, abbr boolean, surname string, sure boolean"
#: A string as read; the word before a full name that was taken for a title; its first two words and how many there are, how it
#: reads without the first, and the surname without the second.
PARSED = f"name string, {READING}, title string, first string, second string, initial boolean, n int, r_given string, r_abbr boolean, r_surname string, r_sure boolean, m_surname string"


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def is_unknown(text: str) -> bool:
    """Whether the string labels an unknown writer (numbers and signs aside; one letter may be mistyped in longer labels)."""
    letters = "".join(c for c in fold(text).lower() if c.isalpha())
    return letters in UNKNOWN or any(len(u) > 6 and close(letters, u) for u in UNKNOWN)


def close(a: str, b: str) -> bool:
    """Equal, or one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _words(name: str) -> tuple[list[tuple[str, str]], int]:
    """The words of a name, folded to lower-case letters, each beside how it is written; and how many stand before a comma."""
    text = re.sub(r"([^\W\d_])\.(?=[^\W\d_])", r"\1. ", fold(name))
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    words = [(w.rstrip(".,;:"), w) for w in re.split(r"[\s,]+", text.strip(" .,;")) if w.strip(".,;:")]
    words = [(re.sub(r"[^a-z]", "", bare.lower()) if bare.isascii() else "".join(c for c in bare.lower() if c.isalpha()), raw) for bare, raw in words]
    head = re.split(r",", text, maxsplit=1)[0] if "," in text else ""
    return [w for w in words if w[0]], len([w for w in re.split(r"\s+", head.strip()) if w.strip(".,;:")])


def _short(word: str, raw: str) -> bool:
    return len(word) <= 3 and raw.rstrip(",;:").endswith(".") or len(word) == 1


def _core(words: list[tuple[str, str]]) -> tuple[list[tuple[int, str, str]], list[bool]]:
    """The words that are no particles, with their places, and which words are. A single capital is an initial, the same
    letter in lower case a particle."""
    marks = [w in PARTICLES and len(words) > 1 and (i > 0 or len(w) > 1) and (len(w) > 1 or raw[0].islower()) for i, (w, raw) in enumerate(words)]
    return [(i, w, raw) for i, (w, raw) in enumerate(words) if not marks[i]], marks


def _read(words: list[tuple[str, str]], n_head: int = 0) -> tuple[str, bool, str, bool] | None:
    core, marks = _core(words)
    if not core:
        return None
    if 0 < n_head < len(words):
        last = [x for x in core if x[0] < n_head]
        first = [x for x in core if x[0] >= n_head]
        if last and first:
            return first[0][1], _short(*first[0][1:]), "".join(x[1] for x in last), True
    if len(core) == 1:
        return "", False, core[0][1], True
    a, b = core[0], core[1]
    rest = "".join(x[1] for x in core[1:])
    if _short(*a[1:]) and not _short(*b[1:]):
        return a[1], True, rest, True
    if _short(*b[1:]) and not _short(*a[1:]):
        return b[1], True, a[1], True
    if marks[-1]:
        return b[1], False, a[1], True
    return a[1], False, rest, any(marks)


def _untitled(words: list[tuple[str, str]], n_head: int) -> tuple[list[tuple[str, str]], int, str | None]:
    """The words without abbreviations that stand, with a dot and more than one letter, before two words of a name or more."""
    title = None
    while not n_head and len(_core(words)[0]) > 2 and words[0][1].endswith(".") and len(words[0][0]) > 1 and words[0][0] not in PARTICLES:
        title, words = words[0][0], words[1:]
    return words, n_head, title


def parse(name: str) -> tuple[str, bool, str, bool] | None:
    """(given, whether it is abbreviated, surname, whether order was certain), folded to lower-case letters; None for no name.

    Known forms: given [particles] surname; surname, given [particles]; surname given [particles]; surname alone; all of
    these with an abbreviated rank before, with blanks lost, and with the given name as initial or abbreviation.
    """
    words, n_head, _ = _untitled(*_words(name))
    return _read(words, n_head)


def _parse_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for name in f["name"]:
            if is_unknown(name):
                continue
            words, n_head, title = _untitled(*_words(name))
            plain = _read(words, n_head)
            if plain is None:
                continue
            core = _core(words)[0]
            first, second, initial, without, middle = None, None, False, (None, None, None, None), None
            if not n_head and len(core) > 1 and core[0][0] == 0:
                first, second, initial = core[0][1], core[1][1], _short(*core[1][1:])
                without = _read(words[1:]) or without
                middle = "".join(x[1] for x in core[2:]) or None
            rows.append((name, *plain, title, first, second, initial, len(core), *without, middle))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])


def _segments(text: Column, k: int, cut: int) -> Column:
    """The k + 1 even segments of a string as (no, start, text), boundaries moved on by `cut`."""
    n = F.length(text)
    bounds = [F.lit(0)] + [F.least(n, F.floor(n * i / (k + 1)).cast("int") + cut) for i in range(1, k + 1)] + [n]
    return F.array(*[F.struct(F.lit(i).alias("no"), bounds[i].alias("at"), F.substring(text, bounds[i] + 1, bounds[i + 1] - bounds[i]).alias("seg")) for i in range(k + 1)])


def _slices(starts: Column, length: Column) -> Column:
    return F.transform(starts, lambda p: F.substring(F.col("word"), p + 1, length))


def swapped(a: Column, b: Column) -> Column:
    """Whether b is a with two neighbouring letters changed over."""
    return (F.length(a) == F.length(b)) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )


def _titles(parsed: DataFrame, table: DataFrame, evidence: int = 2) -> DataFrame:
    """Parsed strings with ranks and middle names out of the way: (name, given, abbr, surname, sure).

    A first word that is no listed given name, before a listed one or an initial and a surname, is a title there; what is a
    title before `evidence` different surnames is one before any name. Of two listed given names the second is a middle name."""
    listed = lambda c: table.select(F.col("token").alias(c), F.lit(True).alias(f"_{c}"))
    x = parsed.join(listed("first"), "first", "left").join(listed("second"), "second", "left")
    rare = F.col("_first").isNull() & F.col("first").isNotNull() & (F.length("first") > 1)
    x = x.withColumn("titled", F.coalesce(rare & (F.col("n") > 2) & (F.col("initial") | F.col("_second").isNotNull()), F.lit(False)))
    x = materialize(x.withColumn("middle", F.coalesce((F.col("n") > 2) & F.col("_first") & F.col("_second"), F.lit(False))), "p6-read")
    seen = x.where("title is not null").select(F.col("title").alias("first"), "surname").unionByName(x.where("titled").select("first", F.col("r_surname").alias("surname")))
    known = seen.groupBy("first").agg(F.count_distinct("surname").alias("_before")).where(F.col("_before") >= evidence)
    x = x.join(broadcast_if_small(known), "first", "left")
    drop = F.col("titled") | rare & F.col("_before").isNotNull()
    pick = lambda c: F.when(drop & F.col("r_surname").isNotNull(), F.col(f"r_{c}")).otherwise(F.col(c)).alias(c)
    surname = F.when(F.col("middle") & F.col("m_surname").isNotNull(), F.col("m_surname")).otherwise(F.col("surname"))
    sure = F.col("middle") | F.col("sure")
    return x.withColumn("surname", surname).withColumn("sure", sure).select("name", *[pick(c) for c in ("given", "abbr", "surname", "sure")])


def _tops(up: DataFrame) -> DataFrame:
    """(node, root) from (node, parent): chains followed to their end by doubling; every step is a written table."""
    state = materialize(up.select("node", F.col("parent").alias("root")), "p6-tops")
    while True:
        above = state.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = materialize(state.join(above, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "p6-tops")
        state = jumped.select("node", "root")
        if jumped.where("_moved").isEmpty():
            return state


def edit_pairs(words: DataFrame, others: DataFrame, k: int = 1, least: int = 4) -> DataFrame:
    """(word, other): different strings within `k` edits, or one swap of neighbours.

    Strings within k edits share one of k + 1 segments, moved by at most k places. The segments of `others` are the
    inverted index, keyed by length, segment number and text; each word looks its substrings up there, once for every
    length, number and shift. A swap across a boundary breaks two segments, so the index holds a second cut one letter
    on. A banded edit distance decides. Strings shorter than `least` (k + 1 or more, so that no segment is empty) take no part.
    """
    o = others.where(F.length("other") >= least)
    cuts = F.array(*[F.struct(F.lit(cut).alias("cut"), _segments(F.col("other"), k, cut).alias("segs")) for cut in (0, 1)])
    index = o.select("other", F.length("other").alias("len"), F.explode(cuts).alias("c")).select("other", "len", F.col("c.cut").alias("cut"), F.explode("c.segs").alias("s"))
    index = index.select("other", "len", "cut", F.col("s.no").alias("no"), F.col("s.seg").alias("seg")).where("seg <> ''")
    tries = []
    for cut in (0, 1):
        for by in range(-k, k + 1):
            n = F.length("word") + by
            for no in range(k + 1):
                lo = F.least(n, F.floor(n * no / (k + 1)).cast("int") + (cut if no else 0))
                hi = F.least(n, F.floor(n * (no + 1) / (k + 1)).cast("int") + cut) if no < k else n
                at = F.sequence(F.greatest(lo - k, F.lit(0)), F.greatest(lo + k, F.lit(0)))
                tries.append(F.struct(n.alias("len"), F.lit(cut).alias("cut"), F.lit(no).alias("no"), F.array_distinct(_slices(at, hi - lo)).alias("segs")))
    asked = words.where(F.length("word") >= least).select("word", F.explode(F.array(*tries)).alias("t"))
    asked = asked.select("word", F.col("t.len").alias("len"), F.col("t.cut").alias("cut"), F.col("t.no").alias("no"), F.explode("t.segs").alias("seg")).where("seg <> ''")
    found = asked.join(index, ["len", "cut", "no", "seg"]).where("word <> other").select("word", "other").distinct()
    return found.where((F.levenshtein("word", "other", k) >= 0) | swapped(F.col("word"), F.col("other")))


def _most(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def _orders(parsed: DataFrame, table: DataFrame) -> DataFrame:
    """Uncertain pairs of words put in order: by how often each word is a given name or a surname where order is certain,
    and by the table of given names."""
    sure = parsed.where("sure")
    as_given = sure.where("not abbr and given <> ''").groupBy(F.col("given").alias("w")).agg(F.count_distinct("surname").alias("g"))
    as_last = sure.groupBy(F.col("surname").alias("w")).agg(F.count(F.lit(1)).alias("l"))
    known = table.select(F.col("token").alias("w"), F.lit(50).alias("t")).distinct()
    weight = as_given.join(as_last, "w", "full").join(known, "w", "full").select("w", (F.coalesce("g", F.lit(0)) + F.coalesce("t", F.lit(0)) - F.coalesce("l", F.lit(0))).alias("v"))
    weight = materialize(weight, "p6-weights")
    open_ = parsed.where("not sure")
    for c, v in (("given", "vg"), ("surname", "vs")):
        open_ = open_.join(weight.select(F.col("w").alias(c), F.col("v").alias(v)), c, "left")
    turn = F.coalesce("vs", F.lit(0)) > F.coalesce("vg", F.lit(0))
    fixed = open_.select("name", F.when(turn, F.col("surname")).otherwise(F.col("given")).alias("given"), "abbr", F.when(turn, F.col("given")).otherwise(F.col("surname")).alias("surname"))
    return sure.drop("sure").select("name", "given", "abbr", "surname").unionByName(fixed)


def _bigrams(name: str) -> Column:
    """Pairs of neighbouring letters of a name written by sound: double letters once, ij as i, c as k, ph as f."""
    sound = F.regexp_replace(F.regexp_replace(F.translate(F.regexp_replace(F.regexp_replace(name, "ph", "f"), "ij", "i"), "cyzq", "kisk"), r"(.)\1+", "$1"), "^$", "-")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(sound) - 1, F.lit(1))), lambda i: F.substring(sound, i, F.lit(2)))


def _compatible(a: Column, b: Column) -> Column:
    return (a == b) | a.startswith(b) | b.startswith(a)


def persons(names: DataFrame, given_names: DataFrame, min_families: int = 2, agreement: float = 0.9) -> DataFrame:
    """(name, person) for the distinct strings of column `name` that can be told to mean one person.

    1. Strings are parsed into given name and surname; labels of unknown writers are left out.
    2. Surnames of three letters or more within one edit are found by `edit_pairs`. One joins a better supported surname near
       it, first one with given names that agree. In one or two strings any support that is better will do; in more,
       however many, it takes twice the support and given names that (`agreement` of its strings) the other has as well:
       slips share their family's given names, other families do not. Slips of slips are followed to the end.
    3. Given names are brought to their full form: by the table of short forms, else to the nearest full or short form
       within one edit, first within the family, then in the table; a form missing from the table is learned where it
       keeps company with a full name that sounds like it (shared pairs of letters, same initial).
    4. A person is a full given name within a family. An initial or abbreviation goes to the only member it fits, a bare
       surname to the only member there is; where several fit, the string stays alone.

    Defined results: NULL, blank and letterless strings refer to nobody; equal strings count once, whatever table they come
    from; strings that differ in blanks or case only are different strings of one person; empty tables give no row.
    """
    strings = names.select("name").where(F.col("name").isNotNull()).distinct()
    low = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}]", "")
    pairs = given_names.where("full_name is not null").select(low(F.col("full_name")).alias("full"), low(F.coalesce("short_name", "full_name")).alias("short"))
    table = materialize(pairs.select("full", F.explode(F.array("full", "short")).alias("token")).where("token <> ''").groupBy("token").agg(F.min("full").alias("full")), "p6-table")
    parsed = materialize(strings.mapInPandas(_parse_all, PARSED), "p6-parsed")
    forms = _orders(_titles(parsed, table), table).where("surname <> ''")
    # The table is joined by its size: it doesn't grow with the names, and Spark broadcasts it only below its own bound.
    forms = forms.join(table.select(F.col("token").alias("given"), F.col("full").alias("_f")), "given", "left")
    forms = materialize(forms.select("name", "given", "abbr", "surname", F.when(F.col("abbr"), F.col("given")).otherwise(F.coalesce("_f", "given")).alias("key")), "p6-forms")
    # Families
    support = materialize(forms.groupBy("surname").agg(F.count(F.lit(1)).alias("n")), "p6-surnames")
    near = edit_pairs(support.select(F.col("surname").alias("word")), support.select(F.col("surname").alias("other")), least=3)
    near = near.join(support.select(F.col("surname").alias("word"), F.col("n").alias("nw")), "word").join(support.select(F.col("surname").alias("other"), F.col("n").alias("no")), "other")
    near = near.where("no >= 2 * nw or nw <= 2 and (no > nw or (no = nw and other < word))")
    each = materialize(forms.groupBy("surname", "key").agg(F.count(F.lit(1)).alias("kn")), "p6-keys")
    mine = each.select(F.col("surname").alias("word"), F.col("key").alias("kw"), "kn")
    theirs = each.select(F.col("surname").alias("other"), F.col("key").alias("ko"))
    agrees = _compatible(F.col("kw"), F.col("ko")) | (F.levenshtein("kw", "ko", 1) >= 0) & (F.length("kw") > 4)
    near = near.join(mine, "word").join(theirs, "other").groupBy("word", "other", "nw", "no", "kw", "kn").agg(F.max(agrees.cast("int")).alias("agree"))
    near = near.groupBy("word", "other", "nw", "no").agg(F.max("agree").alias("agree"), (F.sum(F.col("agree") * F.col("kn")) / F.sum("kn")).alias("share"))
    brief = F.least(F.length("word"), F.length("other")) < 5  # one edit is much of so short a name
    rare = (F.col("nw") <= 2) & ~brief & ((F.col("agree") == 1) | (F.col("no") > F.col("nw")))
    near = near.where(rare | (F.col("share") >= agreement) & (F.col("no") >= 2 * F.col("nw")))
    near = _most(near, ["word"], F.desc("agree"), F.desc("no"), F.col("other"))
    root = _tops(near.select(F.col("word").alias("node"), F.col("other").alias("parent"))).select(F.col("node").alias("surname"), F.col("root").alias("family"))
    forms = materialize(forms.join(root, "surname", "left").withColumn("family", F.coalesce("family", "surname")), "p6-families")
    # Given names
    full = forms.where("not abbr and given <> ''").groupBy("family", "given", "key").agg(F.count(F.lit(1)).alias("n"))
    full = materialize(full.join(table.select(F.col("token").alias("given"), F.lit(True).alias("listed")), "given", "left").withColumn("listed", F.coalesce("listed", F.lit(False))), "p6-given")
    words = full.where("not listed").select(F.col("given").alias("word")).distinct()
    others = full.select(F.col("given").alias("other")).unionByName(table.select(F.col("token").alias("other"))).distinct()
    spelled = materialize(edit_pairs(words, others), "p6-given-near")
    homes = full.groupBy("given").agg(F.count_distinct("family").alias("homes"))
    here = full.where("not listed").join(spelled, full["given"] == spelled["word"]).select("family", "given", "n", "other")
    inside = here.join(full.select("family", F.col("given").alias("other"), F.col("key").alias("to"), F.col("n").alias("m"), F.col("listed").alias("sure")), ["family", "other"])
    inside = inside.join(homes, "given").join(homes.select(F.col("given").alias("other"), F.col("homes").alias("oh")), "other")
    inside = inside.where("sure or oh > homes or (oh = homes and (m > n or (m = n and other < given)))")
    inside = _most(inside, ["family", "given"], F.desc("sure"), F.desc("oh"), F.desc("m"), F.col("to")).select("family", "given", F.col("to").alias("in_to"), F.lit(True).alias("slip"))
    wide = spelled.join(table.select(F.col("token").alias("other"), F.col("full").alias("to")), "other").groupBy("word").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
    # A form in one family only is a slip of the listed name near it; one in more families is if it is long enough for one
    # letter not to make another name, and the listed one is in ten times as many.
    usual = full.where("listed").groupBy(F.col("key").alias("lo")).agg(F.count_distinct("family").alias("used"))
    wide = wide.where("lo = hi").join(homes.withColumnRenamed("given", "word"), "word").join(usual, "lo", "left")
    wide = wide.where("homes = 1 or (length(word) > 4 and used >= 10 * homes)").select(F.col("word").alias("given"), F.col("lo").alias("out_to"))
    step = full.join(inside, ["family", "given"], "left").join(wide, "given", "left")
    step = materialize(step.select("family", "given", "listed", F.coalesce("in_to", F.when(~F.col("listed"), F.col("out_to")), "key").alias("to"), (F.col("listed") | F.coalesce("slip", F.lit(False)) | F.col("out_to").isNotNull()).alias("done")), "p6-step")
    # Forms the table lacks: the full name they keep company with.
    loose = step.where("not done").select("family", "given").distinct()
    spread = loose.groupBy("given").agg(F.count_distinct("family").alias("fams"))
    company = loose.join(step.select("family", F.col("to").alias("with")).distinct(), "family").where(F.col("given") != F.col("with"))
    alone = company.groupBy("family", "given").agg(F.count_distinct("with").alias("members"))
    company = company.join(alone, ["family", "given"]).groupBy("given", "with").agg(F.count_distinct("family").alias("co"), F.max(F.when(F.col("members") == 1, 1).otherwise(0)).alias("only"))
    company = company.join(spread, "given").join(spread.select(F.col("given").alias("with"), F.col("fams").alias("wf")), "with", "left")
    alike = F.substring("given", 1, 1) == F.substring("with", 1, 1)
    common = F.size(F.array_intersect(_bigrams("given"), _bigrams("with"))) / F.greatest(F.size(_bigrams("given")), F.lit(1))
    company = company.withColumn("alike", alike.cast("int")).withColumn("common", common)
    kin = (F.col("alike") == 1) | (F.col("common") >= 0.4)
    met = (F.col("common") >= 0.6) | (F.col("co") >= min_families) & (F.col("co") >= 0.5 * F.col("fams")) | (F.col("only") == 1)
    learned = _most(company.where((F.length("with") > F.length("given")) & kin & met), ["given"], F.desc(F.col("common") + 0.3 * F.col("alike")), F.desc("co"), F.col("with"))
    learned = learned.select("given", F.col("with").alias("nick"))
    step = step.join(learned, "given", "left").select("family", "given", F.when(F.col("done"), F.col("to")).otherwise(F.coalesce("nick", "to")).alias("member"))
    # A slip may have been led to a form that was learned to be another name's: follow it once.
    step = step.join(learned.select(F.col("given").alias("member"), F.col("nick").alias("_m")), "member", "left").select("family", "given", F.coalesce("_m", "member").alias("member"))
    step = materialize(step, "p6-members")
    members = step.select("family", "member").distinct()
    whole = forms.where("not abbr and given <> ''").join(step, ["family", "given"]).select("name", "family", "member")
    brief = forms.where("abbr and given <> ''").select("name", "family", "given")
    fits = brief.join(members, "family", "left").withColumn("fit", F.coalesce(F.col("member").startswith(F.col("given")), F.lit(False)))
    fits = materialize(fits.groupBy("name", "family", "given").agg(F.sum(F.col("fit").cast("int")).alias("k"), F.max(F.when(F.col("fit"), F.col("member"))).alias("member")), "p6-fits")
    one = fits.where("k = 1").select("name", "family", "member")
    none = fits.where("k = 0").withColumn("ini", F.substring("given", 1, 1))
    longest = none.groupBy("family", "ini").agg(F.max_by("given", F.struct(F.length("given"), F.col("given"))).alias("long"))
    none = none.join(longest, ["family", "ini"])
    split = none.groupBy("family", "ini").agg(F.min(F.col("long").startswith(F.col("given")).cast("int")).alias("agree"))
    none = none.join(split, ["family", "ini"]).where("agree = 1 or length(given) > 1")
    none = none.select("name", "family", F.concat(F.lit("~"), F.when(F.col("agree") == 1, F.col("ini")).otherwise(F.col("given"))).alias("member"))
    told = materialize(whole.unionByName(one).unionByName(none), "p6-told")
    sole = told.groupBy("family").agg(F.count_distinct("member").alias("k"), F.min("member").alias("member")).where("k = 1")
    every = forms.where("given = ''").select("name", "family").join(forms.groupBy("family").agg(F.count_distinct(F.when(F.col("given") != "", F.col("given"))).alias("g")), "family")
    bare = every.join(sole, "family").select("name", "family", "member")
    nameless = every.where("g = 0").select("name", "family", F.lit("").alias("member"))
    return told.unionByName(bare).unionByName(nameless).select("name", F.concat_ws("|", "family", "member").alias("person"))


def same_person(people: DataFrame) -> DataFrame:
    """(name_1, name_2): every pair of different strings of a person, smaller string first; a person has as many strings as
    there are ways to write the name, whatever the number of rows."""
    a = people.select("person", F.col("name").alias("name_1"))
    b = people.select("person", F.col("name").alias("name_2"))
    return a.join(b, "person").where("name_1 < name_2").select("name_1", "name_2")


def stored_names(letters: DataFrame, sailing: DataFrame) -> DataFrame:
    """The strings of both tables, once each, exactly as stored."""
    return letters.select(F.col("scribe").alias("name")).unionByName(sailing.select("name")).where("name is not null").distinct()
