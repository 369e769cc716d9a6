import pickle
import random
import time

import numpy as np
import pytest

from lodestock.llm import glyphs, leaks

ITEM = "In the year 7398, the people of Ratin learned to weave Quomi from tin and reed. It can't be measured."
SHORT = "Zugri has 6722 gates and one violet tower."


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    s = r.integers(0, r.integers(1, 6), r.integers(1, 400))
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert leaks.suffix_array(s).tolist() == want


@pytest.mark.parametrize("seed", range(5))
def test_wavelet_ranks(seed):
    r = np.random.default_rng(seed)
    s = r.integers(0, 37, 500)
    symbols, ends = r.integers(0, 37, 80), r.integers(0, 501, 80)
    got = leaks.WaveletMatrix(s, 6).rank(symbols, ends)[0]
    assert got.tolist() == [int((s[:e] == c).sum()) for c, e in zip(symbols, ends)]


@pytest.mark.parametrize("sample", [1, 4, 32])
def test_index_finds_every_place(sample):
    r = np.random.default_rng(sample)
    s = r.integers(1, 4, 600)
    index = leaks.FMIndex(s, sample)
    phrases = [s[i : i + n].tolist() for i, n in zip(r.integers(0, 580, 40), r.integers(1, 9, 40))] + [[3, 3, 3, 3, 3, 3, 3, 3, 3]]
    matrix = np.zeros((len(phrases), 9), np.int64)
    for row, p in enumerate(phrases):
        matrix[row, 9 - len(p) :] = p
    low, high = index.search(matrix)
    for p, a, b in zip(phrases, low, high):
        got = sorted(index.locate(np.arange(a, max(a, b))).tolist())
        assert got == [i for i in range(len(s) - len(p) + 1) if s[i : i + len(p)].tolist() == p]


def holds(text, item=ITEM):
    shard = leaks.Shard()
    shard.add(shard.read(text))
    return bool(list(shard.find(leaks.Phrases([(1, item)]))))


def found(docs, items, spark, **more):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    return leaks.find_leaks(d, "doc_id", "text", e, "item_id", "text", **more).collect()


SAME = [
    ITEM,
    ITEM.upper(),
    "> " + ITEM.replace(", ", ",\n> "),
    ITEM.replace(" ", " "),
    ITEM.replace("a", "а").replace("o", "ο"),
    "".join(c + "​" for c in ITEM),
    "<p>" + ITEM.replace("people", "<b>people</b>").replace(" of ", "<br/>of ") + "</p>",
    ITEM.replace("people", "[i]pe[u]op[/u]le[/i]").replace("year ", "[size=1]year [/size]"),
    ITEM.replace("'", "&#39;").replace("people", "peo&shy;ple").replace(" the ", "&nbsp;the&amp;nbsp;"),
    ITEM.replace("'", "’").replace(".", " ...").replace("_", "-"),
    "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in ITEM),
    "_" + ITEM.replace(" ", "_ _") + "_",
    "start " + " ".join(ITEM.split()[2:14]) + " end",
]
OTHER = ["", None, "nothing", " ".join(ITEM.split()[2:13]), ITEM.replace("Ratin", "Rattin").replace("tin", "lead"), "the people of Ratin learned to weave"]


@pytest.mark.parametrize("text", SAME)
def test_writing_makes_no_difference(text):
    assert holds(text)
    words, starts, ends = leaks.word_places(text)
    assert words == leaks.words(text)
    assert all(a < b for a, b in zip(starts, ends))


WHOLE = "In the year 7398, the people of Ratin learned"
PARTS = WHOLE.partition(" people ")


def between(a, b):
    """A short item with markup around a word."""
    return f"{PARTS[0]} {a}people{b} {PARTS[2]}"


MARKED = [
    *[between(f"<{n}>", f"</{n}>") for n in ("section", "figure", "article", "iframe", "main", "label", "cite", "dt", "dl><dt", "o:p class=x")],
    *[between(f"<a href='http://x.example/{'y' * n}'>", "</a>") for n in (5, 450, 50_000)],
    between('<a title="a > b" href=x>', "</a>"),
    between("<a title=it's>", "</a>"),
    between("<my-tag a=1>", " "),
    *[between(f"[quote={'x' * n}]", "[/quote]") for n in (5, 450, 50_000)],
    *[between(f"[{n}={'x' * 70}]", f"[/{n}]") for n in ("size", "color", "email", "url")],
    *[between(f"[{n}]", f"[/{n}]") for n in ("h1", "youtube x=1", "note", "Own")],
    *[between(f"[{n}]http://x.example/{'y' * 500}[/{n}] ", "") for n in ("img", "youtube", "IMG")],
    between("[img width=5]a.png[/img]", ""),
    between("", "{{" + "template " * 20 + "}}"),
    between("{{a\nb}}", ""),
    between("[", "](http://x.example/a_(b))"),
    between("![", '](http://x.example/a "a title")'),
    between("<!-- a\n<b> -->", ""),
    between("&amp;amp;lt;b&amp;amp;gt;", "&amp;#38;lt;/b&amp;AMP;gt;"),
    between("&#0000000032;", "&nbsp;"),
]
UNMARKED = [
    between("<y and z> ", ""),
    between("a < b and c > d ", ""),
    between("[sic] ", ""),
    between("[WARN] ", ""),
    between("<3 love> ", ""),
    between("[see](the note here) ", ""),
    between("<!-- not closed ", ""),
    between("{{ not closed ", ""),
    between("&foo ", ""),
    between("<user> ", ""),
]


@pytest.mark.parametrize("text", MARKED)
def test_markup_of_any_kind_and_length_makes_no_difference(text):
    assert holds(text, WHOLE)
    words, starts, ends = leaks.word_places(text)
    assert words == leaks.words(text) and all(a < b for a, b in zip(starts, ends))
    assert text[starts[words.index("people")] :].startswith("people")


@pytest.mark.parametrize("text", UNMARKED)
def test_what_only_looks_like_markup_stands_between_words(text):
    assert not holds(text, WHOLE)


@pytest.mark.parametrize("unit", ["<", "<a ", "<a '", '<a "', "[", "[a=", "[x](", "[img]", "{{", "<!--", "&", "&amp;", "&amp", "&#38;", "<b", "](", "[/a", "<a b=c "])
def test_reading_takes_time_in_proportion_to_length(unit):
    start = time.perf_counter()
    leaks.words(unit * 200_000)
    assert time.perf_counter() - start < 10


def test_folding_runs_equals_folding_texts():
    for text in [*SAME, *MARKED, "e\u0301te\u0301 \u0130I \u01c5 \ufb01ne 1\ufe0f\u20e3 a\u200d\U0001f468\u200db \u1100\u1161 x\u0308\u0323", "na\u00efve_\u0430b_\uff43"]:
        assert leaks.words(text) == leaks._RUN.findall(glyphs.match_fold(glyphs.to_latin(glyphs.tidy(leaks.plain(text)))))


def test_spans_nested_and_apart_are_merged():
    spans = [(0, 0, 5, 9), (0, 0, 0, 2), (0, 0, 2, 3), (0, 1, 8, 30), (0, 1, 10, 12), (0, 1, 31, 32), (2, 0, 40, 41), (0, 0, 8, 12)]
    got = leaks._merged(*(np.array(c) for c in zip(*spans))).T.tolist()
    assert got == [[0, 0, 0, 3], [0, 0, 5, 12], [0, 1, 8, 30], [0, 1, 31, 32], [2, 0, 40, 41]]
    assert leaks._merged(*np.zeros((4, 0), int)).shape == (4, 0)


def test_broadcast_size_of_many_items():
    """A block of items is some numbers a word, whatever the phrases share."""
    r = random.Random(1)
    items = [(i, " ".join(f"w{r.randrange(20_000)}" for _ in range(60))) for i in range(5000)]
    assert len(pickle.dumps(leaks.Phrases(items))) < 12 * sum(len(t) for _, t in items)


def test_found_and_spans(spark):
    docs = [f"before it. {t} after that" if t else t for t in SAME + OTHER]
    rows = found(docs, [ITEM, None, "", "!!!"], spark)
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(i, 0) for i in range(len(SAME))}
    for r in rows:
        text, (span,) = docs[r["doc_id"]], r["spans"]
        cut = leaks.words(text[span["start"] : span["end"]])
        full = leaks.words(ITEM)
        assert cut in (full, full[2:14])


def test_short_items_are_whole(spark):
    docs = [f"so: {SHORT.lower()}", " ".join(SHORT.split()[:-1]), SHORT.replace("gates", "red gates"), f"{SHORT} {SHORT}"]
    rows = found(docs, [SHORT], spark)
    assert {r["doc_id"]: len(r["spans"]) for r in rows} == {0: 1, 3: 1}


def test_no_phrase_spans_two_texts(spark):
    half = len(SHORT) // 2
    assert found([SHORT[:half], SHORT[half:]], [SHORT], spark) == []


def test_shared_passages_and_repeated_texts(spark):
    rows = found([ITEM, ITEM], [ITEM + " one", ITEM + " two"], spark)
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(d, i) for d in (0, 1) for i in (0, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    items = [" ".join(r.choice("abcd") for _ in range(r.choice([1, 3, 5, 20]))) for _ in range(12)]
    docs = [" ".join(r.choice("abcde") for _ in range(r.randrange(0, 60))) for _ in range(40)] + [items[0] + " x " + items[1]]
    n = 4
    want = set()
    for d, text in enumerate(docs):
        w = text.split()
        for i, item in enumerate(items):
            q = item.split()
            runs = [q[k : k + n] for k in range(max(1, len(q) - n + 1))]
            if any(w[k : k + len(run)] == run for run in runs for k in range(len(w))):
                want.add((d, i))
    for more in ({}, {"shard_words": 30}, {"shard_words": 7}, {"block_items": 5}):
        rows = found(docs, items, spark, phrase=n, **more)
        assert {(x["doc_id"], x["item_id"]) for x in rows} == want
        for x in rows:
            assert all(a["end"] < b["start"] for a, b in zip(x["spans"], x["spans"][1:]))


def test_very_long_text_and_nothing(spark):
    rows = found(["word " * 50_000 + ITEM], [ITEM], spark, shard_words=1000)
    assert [(r["doc_id"], len(r["spans"])) for r in rows] == [(0, 1)]
    assert found([], [ITEM], spark) == [] and found([ITEM], [], spark) == []


def test_merged():
    assert leaks.merged([(5, 9), (0, 2), (2, 3), (8, 12)]) == [(0, 3), (5, 12)]
