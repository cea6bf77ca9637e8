import itertools
import random

import pytest

from calamus.llm import names, queries, stuffing

GIVEN = [("Gijsbertus", "Gijs"), ("Mauritius", "Mouris"), ("Wilhelmus", "Willem"), ("Albertus", "Bert"), (None, "x"), ("Nicolaas", None)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Gijsbertus van den Vastlunvok", ("gijsbertus", False, "vastlunvok")), ("Vastlunvok, G. van den", ("g", True, "vastlunvok")), ("Getburdrut W. ter", ("w", True, "getburdrut")),
        ("G.vandenVastlunvok", ("g", True, "vastlunvok")), ("Korp. Q. van Balbalsuk", ("q", True, "balbalsuk")), ("de Hekmurmur", ("", False, "hekmurmur")),
        ("sold. Rob Sinmolmerd", ("rob", False, "sinmolmerd")), ("T.Mamvastmerd", ("t", True, "mamvastmerd")), ("Adriaan t. Minkdopkat", ("adriaan", False, "minkdopkat")),
        ("Tanktankmol D.", ("d", True, "tanktankmol")), ("Guñkkemsest", ("", False, "gunkkemsest")), (" MAAS  TELVUPDIK. ", ("maas", False, "telvupdik")), ("Rutbitnap Thijs ter", ("thijs", False, "rutbitnap")),
    ],
)
def test_parse(text, want):
    assert names.parse(text)[:3] == want


@pytest.mark.parametrize("text", ["?", "N.N.", "ONBEKEND ", "onbekent", "onbekend 2", "Anoniem", "Onb.", "", "  ", "12"])
def test_unknown_writers(text):
    assert names.is_unknown(text)


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_pairs_against_brute_force(spark):
    rnd = random.Random(7)
    words = set()
    for _ in range(60):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randrange(4, 9)))
        words |= {w, w[:2] + rnd.choice("abc") + w[3:], w[:3] + w[4:], w[:3] + "b" + w[3:], w[:2] + w[3:4] + w[2:3] + w[4:]}
    words = [w for w in words if len(w) >= 4]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in names.edit_pairs(df, df.withColumnRenamed("word", "other")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and osa(a, b) <= 1}


def linked(spark, strings, given=GIVEN):
    df = spark.createDataFrame([(s, "clash") for s in strings], "name string, person string")
    table = spark.createDataFrame(given, "full_name string, short_name string")
    return {tuple(r) for r in names.same_person(names.persons(df, table)).collect()}


def groups(*sets):
    return {tuple(sorted(p)) for s in sets for p in itertools.combinations(s, 2)}


def test_variants_and_relatives(spark):
    g = ["Gijsbertus van den Vastlunvok", "Vastlunvok, Gijs van den", "G. van den Vastlunvok", "Gijsbertus van den Vastlnuvok", "GIJSBERTUS VAN DEN VASTLUNVOK", " Gijsbertus van den Vastlunvok", "Gijzbertus van den Vastlunvok"]
    m = ["Mauritius van den Vastlunvok", "M.vandenVastlunvok", "Vastlunvok Mouris van den"]
    w = ["Willem ter Getburdrut", "ter Getburdrut", "Korp. W. ter Getburdrut", "Wilhelmus ter Getburdrutt"]
    assert linked(spark, [*g, *m, *w, "van den Vastlunvok", "ONBEKEND", "N.N.", None, "", "?", g[0]]) == groups(g, m, w)


def test_forms_missing_from_the_table(spark):
    rows = [f"{x} {y}" for y in ("Deslakhust", "Kuldikmol", "Renkvuplep") for x in ("Godefridus", "Govert")] + ["Antonius Renkvuplep"]
    assert linked(spark, rows) == groups(*[[f"Godefridus {y}", f"Govert {y}"] for y in ("Deslakhust", "Kuldikmol", "Renkvuplep")])


def test_a_slip_in_several_strings_and_a_slip_of_a_slip(spark):
    right = [f"{x} Balbalsuk" for x in ("Gijsbertus", "Gijs", "G.", "GIJSBERTUS", " Gijsbertus", "gijsbertus", "Gijsbertus  ", "Gijs.")]
    slips = ["Gijsbertus Balbelsuk", "Gijs Balbelsuk", "Balbelsuk, Gijs", "Gijsbertus Balbeksuk"]
    other = [f"{x} Balbalsum" for x in ("Mauritius", "Mouris", "M.")]  # no slip: its given name is another
    assert linked(spark, [*right, *slips, *other]) == groups([*right, *slips], other)


def test_short_surnames(spark):
    assert linked(spark, ["Albertus Bios", "Bert Bios", "Bertus Bios", "Albertus Bos"][:2] + ["Albertus Bos"]) == groups(["Albertus Bios", "Bert Bios", "Albertus Bos"])


def test_titles_and_middle_names_without_a_list(spark):
    g = ["Adelborst Gijs van Balbalsuk", "Gijs van Balbalsuk", "Gijsbertus Balbalsuk", "Gijs Mauritius Balbalsuk"]
    m = ["Adelborst Mouris Deslakhust", "Mauritius Deslakhust", "Adelborst Deslakhust"]
    assert linked(spark, [*g, *m, "niet bekend", "Niet bekend."]) == groups(g, m)


def test_no_names(spark):
    assert linked(spark, []) == set() and linked(spark, [None, "?"], []) == set()


PROSE = "de man en de vrouw gaan naar het {a} in de {b} van de {c} en het is een {d} dat op de {e} ligt maar niet in het {f}"


def prose(rnd, n):
    out = []
    for _ in range(n):
        out.append(PROSE.format(**{k: "".join(rnd.choice(["ver", "land", "sluf", "kop", "rak", "mul", "dor", "hok"]) for _ in range(3)) for k in "abcdef"}).capitalize() + ".")
    return " ".join(out)


def pages(spark, rows):
    return spark.createDataFrame([(i, t, "nl", "clash", 1, 1) for i, t in rows], "doc_id bigint, text string, lang string, term string, passage int, n int")


def test_spam_and_genres(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, 12) + "\n\n" + prose(rnd, 6)) for i in range(60)]
    word = lambda: "".join(rnd.choice(["ver", "land", "sluf", "kop", "rak", "mul"]) for _ in range(4))
    stuffed = " ".join(f"de {rnd.choice(['goedkoop scriptie rakdor', 'korting online'])} en het {rnd.choice(['goedkoop scriptie rakdor', 'korting online'])}" for _ in range(40))
    links = "\n".join(f"https://www.{word()}.example/{word()}" for _ in range(60))
    tags = "Tags: " + ", ".join(word() for _ in range(80))
    hashes = " ".join("#" + word() for _ in range(50))
    spelled = " ~ ".join(rnd.choice(["*korting*", "k0rting", "kor-ting", "KORTING", "kortingg"]) for _ in range(90))
    spam = {100: stuffed, 101: links, 102: tags, 103: hashes, 104: spelled, 105: prose(rnd, 1) + "\n\n" + links}
    roll = "\n".join(f"{k}. Gerardus {word().capitalize()}, Ravum, {20 + k} j." for k in range(1, 30))
    refrain = "\n".join(prose(rnd, 1)[:-1] + ", mulrak verdor." for _ in range(12))
    fine = {200: roll, 201: refrain, 202: prose(rnd, 20) + "\n\n" + tags[:200], 203: "...", 204: None, 205: " \n\n ", 206: "[onleesbaar]", 207: prose(rnd, 3000)}
    got = {r["doc_id"] for r in stuffing.spam_pages(pages(spark, [*rows, *spam.items(), *fine.items()])).collect()}
    assert got == set(spam)


def test_prose_of_a_rare_language_is_no_spam(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, 8), "nl") for i in range(200)]
    other = ["kaj", "la", "estas", "en", "sed", "ne", "por", "kun"]
    rows += [(1000 + i, " ".join(rnd.choice(other) if k % 2 else "".join(rnd.choice("bdfgklmnprstv") + rnd.choice("aeiou") for _ in range(3)) for k in range(120)) + ".", "eo") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert stuffing.spam_pages(df).count() == 0


def test_long_page_in_one_block(spark):
    rnd = random.Random(6)
    rows = [(1, prose(rnd, 3000))] + [(2 + i, prose(rnd, 8)) for i in range(40)]
    parts = stuffing.passages(pages(spark, rows)).where("_id = 1").collect()
    assert sum(r["n_words"] for r in parts) == len(rows[0][1].split()) and max(r["n_words"] for r in parts) <= 120


def test_no_pages(spark):
    assert stuffing.spam_pages(pages(spark, [])).count() == 0
    assert stuffing.spam_pages(pages(spark, [(1, None), (None, "x y z")])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(name, spark, sf):
    df = queries.queries()[name](spark, sf)
    rows = df.collect()
    keys = [tuple(r) for r in rows]
    assert len(keys) == len({str(k) for k in keys})
