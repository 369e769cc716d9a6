import itertools
import unicodedata

import pyarrow as pa
import pytest

from lodestock.llm import glyphs
from lodestock.llm import lookalike as l
from lodestock.operators import joins

BASE = "Someone lost a café tray; naïve. I'd say Привет, камера"
SAME = [
    BASE,
    BASE.replace("a", "а"),
    BASE.replace("o", "ο").replace("e", "е"),
    BASE.replace("é", "é").replace("ï", "ï"),
    BASE.replace(" ", " "),
    BASE.replace(" ", " ").replace("o", "օ"),
    BASE.replace("tray", "t​r­a﻿y"),
    BASE.replace("tray", "ｔｒａｙ"),
    BASE.replace("камера", "кaмepa").replace("Привет", "Пpивeт"),
    BASE.replace("I'd", "Ι'ԁ"),
    BASE.replace("tray", "tra‍y"),
    BASE.replace("é", "е́"),
]
DIFFERENT = [
    BASE.lower(),
    BASE.replace("é", "e"),
    BASE.replace(";", ","),
    BASE.replace(" a ", "  a "),
    BASE + "\n",
    BASE + " 1",
    BASE + " ١",
    BASE.replace("tray", "<b>tray</b>"),
    BASE + "👨‍👩‍👧",
    BASE + "👨👩👧",
    BASE + "❤️",
    BASE + "❤",
    BASE + "　",
    BASE + " ё",
    BASE + " е",
]


def test_same_look_same_form():
    ways = {"Пpивeт": "Привет", "кaмepa": "камера", "I": "I", "d": "d", "a": "a"}
    assert {l.form(t, ways) for t in SAME} == {BASE}


def test_all_others_differ():
    forms = [l.form(t) for t in [BASE, *DIFFERENT]]
    assert len(set(forms)) == len(forms)


def test_every_twin_has_its_letters_look():
    for latin, others in glyphs.LOOK_ALIKES.items():
        assert {l._look(c) for c in others} == {latin}
        assert {glyphs.match_fold(c) for c in others} == {latin.lower()}


def test_scripts():
    assert l.mixed("соst") and not l.mixed("камера") and not l.mixed("café") and l.mixed("fɑx") and not l.mixed("日本カ")
    assert l.dominant("соst") == "latin" and l.dominant("кaмера") == "cyrillic" and l.dominant("日本") == "other"
    assert l.as_script("соsts", "latin") == "costs" and l.as_script("кaмepa", "latin") is None
    assert l.as_script("кaмepa", "cyrillic") == "камера" and l.as_script("нaшёл", "cyrillic") == "нашёл"


def test_unchanged_characters():
    for a, b in l.UNCHANGED:
        for c in map(chr, range(a, b + 1)):
            assert l.form("x" + c) == "x" + c and l.script(c) in ("latin", "other") and not unicodedata.combining(c)


def test_changing_texts():
    texts = {"abc": False, "café — “x”": False, "日本": False, "а": True, "x\u0301": True, "x\u00a0": True, "ｘ": True, "\u200b": True, "µ": True, "👍": True, "": False, None: False}
    assert l.changing(pa.array(list(texts))).tolist() == list(texts.values())


def test_forms_of_parts_equal_forms_of_texts():
    ways = {"кaмepa": "камера", "I": "I"}
    for t in [*SAME, *DIFFERENT, "a\u00a0b \u0301c  \u200d👍\u200d x\u202f", " кaмepa\nкамepa "]:
        whole = l._TOKEN.sub(lambda m: m[0] if m[0].isascii() else ways.get(l._look(m[0])) or (l._look(m[0]) if l.mixed(m[0]) else m[0]), glyphs.tidy(t))
        assert l.form(t, ways) == whole


def test_shows_matches_tidy():
    for t in SAME + DIFFERENT + ["a‍‍b❤️‍🔥️ x️"]:
        kept = "".join(c for c, k in zip(t, glyphs.shows(t)) if k)
        assert glyphs.tidy(kept) == glyphs.tidy(t)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, form int")


def pairs(spark, texts, **more):
    formed = l.forms(frame(spark, texts), "doc_id", "text", **more)
    return {tuple(r) for r in l.pairs(l.same_look(formed, "doc_id", "text"), "doc_id").collect()}


TEXTS = [*SAME, *DIFFERENT, None, None, "", "", " ", "​", " ", BASE, SAME[1]]


@pytest.mark.parametrize("limit", [l.BROADCAST_TOKENS, 0])
def test_pairs(spark, limit):
    want = set()
    for (a, x), (b, y) in itertools.combinations(enumerate(TEXTS), 2):
        if x and y and x.strip() and x != y and (x in SAME and y in SAME):
            want.add((a, b))
    assert pairs(spark, TEXTS, broadcast_tokens=limit) == want


def written(spark, texts):
    rows = l.forms(frame(spark, texts), "doc_id", "text").collect()
    assert len(rows) == len(texts)
    return [(r["form"], r["repaired"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_repairs_need_the_vocabulary(spark):
    texts = ["I bought а trаy", "the tray", "хylem соws", "no such word", "a b"]
    got = dict(map(tuple, l.ways_of(frame(spark, texts), "text").collect()))
    assert got == {"tray": "tray", "a": "a"}
    assert written(spark, texts) == [("I bought a tray", 1), ("the tray", 0), ("xylem cows", 0), ("no such word", 0), ("a b", 0)]


def test_the_vocabulary_decides_the_form(spark):
    """A mixed token becomes Cyrillic, Greek or Latin as the corpus writes it, and pure ones stay."""
    assert written(spark, ["cоp", "рос сор оса"]) == [("сор", 1), ("рос сор оса", 0)]
    assert written(spark, ["cоp", "cop", "рос"]) == [("cop", 1), ("cop", 0), ("рос", 0)]
    assert written(spark, ["cоp"]) == [("cop", 0)]
    assert written(spark, ["νοo", "νoо", "νοο"]) == [("νοο", 1), ("νοο", 1), ("νοο", 0)]
    # Both ways of one look are written: Latin first.
    assert written(spark, ["сор", "cop", "cоp"]) == [("cop", 0), ("cop", 0), ("cop", 1)]
    # Greek or Cyrillic: the script that most of the class' tokens mostly are in.
    assert {f for f, _ in written(spark, ["ТОР", "ΤΟΡ", "ТΟР", "ТОΡ"])} == {"ТОР"}
    assert {f for f, _ in written(spark, ["ТОР", "ΤΟΡ", "ΤОΡ", "ТΟΡ"])} == {"ΤΟΡ"}


def test_null_empty_and_long(spark):
    long = "tray " * 100_000
    rows = {r["doc_id"]: r["form"] for r in l.forms(frame(spark, [None, "", " \n", long.replace("a", "а"), "tray"]), "doc_id", "text").collect()}
    assert rows == {0: None, 1: "", 2: "", 3: long, 4: "tray"}
    assert pairs(spark, []) == set() and pairs(spark, [None, None]) == set()


def test_hot_look_is_spread_over_tasks(spark, monkeypatch):
    """A look that 90 % of the rows share, joined by salts: no task gets more than a small part."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    texts = [SAME[i % 3] if i % 10 else f"other {i}" for i in range(2000)]
    formed = l.forms(frame(spark, [t + f" {i % 400}" * (i % 10 == 0) for i, t in enumerate(texts)]), "doc_id", "text")
    got = l.same_look(formed, "doc_id", "text")
    assert got.count() == 1800 and {r["_n"] for r in got.collect()} == {1800}


def test_classes_of_copies_have_a_row_each(spark):
    texts = ["tray", "trаy", "tray", "tray", "other"]
    got = l.same_look(l.forms(frame(spark, texts), "doc_id", "text"), "doc_id", "text").collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3} and {r["_n"] for r in got} == {4}


def test_large_group_is_spread(spark, monkeypatch):
    monkeypatch.setattr(l, "PAIR_BLOCK", 7)
    texts = [SAME[i % 3] for i in range(60)]
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if texts[a] != texts[b]}
    assert pairs(spark, texts) == want
