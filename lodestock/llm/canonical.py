"""Problem 1: map freely typed values to the entry of a reference list that was meant.

A symmetric-delete dictionary holds, for every surface form of every entry, the form's first letters with
up to d of them left out. A typed value is looked up by its own first letters with up to d left out, so
every form within d edits is found without comparing the value with the list. The forms found are ranked
by a weighted Damerau-Levenshtein distance (slips of the keyboard, doubled letters, swapped neighbours
and left-out vowels cost less than other edits, digits more); ties go to the entry more frequent among
values typed exactly, then to the lower id. Values above a distance in proportion to their length are
misses.

Surface forms of an entry: its name and aliases, written together, as plurals, with their words in
another order (any order of up to ORDERED words; of more words the rotations, and the sorted order, which
typed words are also compared in), with their vowels left out, cut short, and with a first word cut short.

A value is looked up with all its words first. Words that say nothing of what is meant are then left out,
at a cost: numbers, single letters, and fillers, which are given or else found in the values themselves:
words that stand beside the exact names of at least FILLER_ENTRIES different entries. A word that any
entry holds is never left out.

Null and empty values are not typed values: they get no row. A value of blanks or signs alone is a miss.
Repeated values get the same answer; extra columns pass through. An empty reference list makes every
value a miss. Values of any length are compared as a whole: one far longer than every form can't be near
any and is a miss by the length alone.

Different values are mapped once, and their answers joined back: broadcast if they are few, else spread
over tasks, however hot a value is. The dictionary is built once and broadcast as arrays if its size, as
estimated from the list, stays within DICTIONARY_BYTES. A longer list takes the other way: both sides'
keys are joined by a shuffle.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestock.llm.glyphs import bare
from lodestock.operators.columns import by_place, others, pick, place
from lodestock.operators.joins import member_join, spread_join
from lodestock.session import cut, fits

MISS = -1
OWN = ("class_id", "cost", "exact")
DICTIONARY_BYTES = 256 << 20
ANSWER_CHARS = 32 << 20
FILLER_ENTRIES = 3
FILLER_WORDS = 100_000
ORDERED = 4
PREFIX = 8
SHUFFLED_PREFIX = 12
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
VOWELS = frozenset("aeiou")
_WORD = regex.compile(r"[\p{L}\p{M}]+|\p{N}+")


def _neighbours() -> dict[str, str]:
    """Letters side by side on the keyboard, or on neighbouring rows."""
    near: dict[str, set[str]] = defaultdict(set)
    for r, row in enumerate(KEYBOARD):
        for i, c in enumerate(row):
            for row2, columns in ((r, (i - 1, i + 1)), (r + 1, (i - 1, i)), (r - 1, (i, i + 1))):
                if 0 <= row2 < len(KEYBOARD):
                    near[c] |= {KEYBOARD[row2][j] for j in columns if 0 <= j < len(KEYBOARD[row2])}
    return {c: "".join(sorted(n)) for c, n in near.items()}


NEAR = _neighbours()


@dataclass(frozen=True)
class Weights:
    """Costs of edits, and the distance allowed in proportion to the length of the form."""

    edit: float = 1.0
    digit: float = 2.7
    near: float = 0.8
    swap: float = 0.7
    doubled: float = 0.5
    vowel: float = 0.4
    left_out: float = 0.05
    reordered: float = 0.1
    plural: float = 0.3
    bones: float = 0.7
    cut: float = 0.25
    cut_letter: float = 0.12
    least: float = 1.0
    share: float = 0.21
    most: float = 2.6

    def allowed(self, length: int) -> float:
        return min(self.most, max(self.least, self.share * length))


DEFAULT = Weights()


def table_of(typed: str, form: str, w: Weights = DEFAULT, limit: float = 1e9) -> tuple[list[float], list[float]]:
    """Weighted Damerau-Levenshtein distances (neighbours swapped at most once) from the form that was
    meant to what was typed: of all starts of what was typed from the whole form, and of the whole of it
    from all starts of the form. Distances above `limit` may be given as any number above it."""
    before: list[float] = []
    last = [0.0]
    for j, b in enumerate(typed):
        cost = w.digit if b.isdigit() else w.doubled if j and b == typed[j - 1] else w.edit
        last.append(last[-1] + cost)
    column = [last[-1]]
    for i, a in enumerate(form, 1):
        digit, near = a.isdigit(), NEAR.get(a, "")
        left_out = w.digit if digit else w.vowel if a in VOWELS else w.edit
        if not digit and i > 1 and form[i - 2] == a:
            left_out = min(left_out, w.doubled)
        row = [last[0] + left_out]
        for j, b in enumerate(typed, 1):
            either = digit or b.isdigit()
            put_in = w.digit if b.isdigit() else w.doubled if b == a or (j > 1 and typed[j - 2] == b) else w.edit
            same = 0.0 if a == b else w.digit if either else w.near if b in near else w.edit
            best = min(last[j] + left_out, row[j - 1] + put_in, last[j - 1] + same)
            if i > 1 and j > 1 and a == typed[j - 2] and form[i - 2] == b and a != b:
                best = min(best, before[j - 2] + (w.digit if either else w.swap))
            row.append(best)
        column.append(row[-1])
        if min(row) > limit and min(last) > limit:
            rest = len(form) - i
            return [limit + 1] * len(row), column + [limit + 1] * rest
        before, last = last, row
    return last, column


def distance(typed: str, form: str, w: Weights = DEFAULT, limit: float = 1e9) -> float:
    """What table_of() says of the whole of both."""
    return table_of(typed, form, w, limit)[0][-1]


def words(value: str) -> list[str]:
    """The words and numbers of a value in a bare form."""
    return _WORD.findall(bare(value))


def deletes(text: str, depth: int) -> set[str]:
    """The text with up to `depth` letters left out."""
    level, every = {text}, {text}
    for _ in range(depth):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        every |= level
    return every


def skeleton(text: str) -> str:
    """The text without its vowels."""
    return "".join(c for c in text if c not in VOWELS)


WHOLE, ORDER, SHORT = 0, 1, 2


def forms_of(name: str, w: Weights = DEFAULT) -> dict[tuple[str, int], float]:
    """The surface forms of a name, with their kinds, and what each costs by itself. Plurals and cut names
    are no forms of their own: they are seen in the table of the whole form."""
    parts = words(name)
    forms: dict[tuple[str, int], float] = {}

    def put(text: str, kind: int, cost: float) -> None:
        forms[text, kind] = min(cost, forms.get((text, kind), cost))

    whole = "".join(parts)
    put(whole, WHOLE, 0.0)
    if len(bones := skeleton(whole)) > 4:
        put(bones, SHORT, w.bones)
    if len(parts) <= ORDERED:
        orders = itertools.islice(itertools.permutations(parts), 1, None)
    else:
        orders = [*(parts[i:] + parts[:i] for i in range(1, len(parts))), sorted(parts)]
    for order in orders:
        put("".join(order), ORDER, w.reordered)
    if len(parts) > 1:
        rest = "".join(parts[1:])
        for length in range(3, len(parts[0])):
            put(parts[0][:length] + rest, SHORT, w.cut + w.cut_letter * (len(parts[0]) - length))
    return {f: c for f, c in forms.items() if f[0]}


def forms_of_all(names: Iterable[str], w: Weights) -> dict[tuple[str, int], float]:
    """The forms of all names of one entry."""
    every: dict[tuple[str, int], float] = {}
    for name in names:
        for form, cost in forms_of(name, w).items():
            every[form] = min(cost, every.get(form, cost))
    return every


def depths(text: str) -> tuple[int, int]:
    """Edits to search for: by whole forms, and by forms without vowels."""
    return (1 if len(text) < 6 else 2 if len(text) < 10 else 3), (0 if len(text) < 6 else 1)


def keys_of(text: str, kind: int, prefix: int = PREFIX) -> set[int]:
    """Hashed dictionary keys of a form or (as WHOLE) a typed value; a short form is searched with one
    edit. Two texts within d edits have first letters that are equal after leaving out up to d of each."""
    deep, bones = depths(text)
    keys = {xxhash.xxh3_64_intdigest("=" + t) >> 1 for t in deletes(text[:prefix], min(deep, 1) if kind == SHORT else deep)}
    if kind != SHORT:
        keys |= {xxhash.xxh3_64_intdigest("~" + t) >> 1 for t in deletes(skeleton(text)[:prefix], bones) if len(t) > 2}
    return keys


def cut_lengths(form: str) -> range:
    """The lengths to which a whole form may be cut short: half of it and four letters at least, and no
    number is cut off."""
    numbers = max((i for i, x in enumerate(form, 1) if x.isdigit()), default=0)
    return range(max(4, (len(form) + 1) // 2, numbers), len(form))


def form_keys(form: str, kind: int, prefix: int = PREFIX) -> set[int]:
    """keys_of a form, and of what is left of it cut short, where that's shorter than the first letters."""
    keys = keys_of(form, kind, prefix)
    if kind == WHOLE:
        for length in cut_lengths(form):
            if length >= prefix:
                break
            keys |= keys_of(form[:length], SHORT, prefix)
    return keys


def cost_of(typed: str, form: str, kind: int, own: float, w: Weights) -> float | None:
    """The least cost at which a form was meant by what was typed; None if it's too far."""
    n, m = len(form), len(typed)
    most = w.allowed(n + 2)
    whole, starts = table_of(typed, form, w, most)
    costs = [own + whole[m]] * (whole[m] <= w.allowed(n))
    if kind == WHOLE:
        if typed.endswith("s") and whole[m - 1] <= w.allowed(n + 1):
            costs.append(own + w.plural + whole[m - 1])
        if typed.endswith("es") and whole[m - 2] <= w.allowed(n + 2):
            costs.append(own + w.plural + 0.1 + whole[m - 2])
        for length in cut_lengths(form):
            if starts[length] <= min(w.edit, w.allowed(length)):
                costs.append(own + w.cut + w.cut_letter * (n - length) + starts[length])
    best = min(costs, default=w.most + 1)
    return round(best, 6) if best <= w.most else None


class Words:
    """What the list and the values say of words: those that entries hold, and the fillers."""

    def __init__(self, names: Iterable[str], fillers: Iterable[str]) -> None:
        listed = [words(n) for n in names]
        self.held = frozenset(itertools.chain.from_iterable(listed))
        self.fillers = frozenset(fillers) - self.held
        self.longest = max((sum(map(len, n)) for n in listed), default=0)
        self.sorted = any(len(n) > ORDERED for n in listed)

    def texts(self, value: str, w: Weights) -> list[tuple[str, float]]:
        """The texts to look a value up by, each with what it costs."""
        every = words(value)
        kept = [x for x in every if x in self.held or not (x in self.fillers or x.isdigit() or len(x) == 1)]
        out: dict[str, float] = {}
        for own in (every, kept):
            cost = w.left_out * (len(every) - len(own))
            out.setdefault("".join(own), cost)
            if self.sorted:
                out.setdefault("".join(sorted(own)), cost + w.reordered)
        return [(t, c) for t, c in out.items() if 0 < len(t) <= 2 * self.longest + 2]


class Dictionary:
    """Symmetric-delete dictionary of a reference list: (class id, names, frequency). Its keys are one
    sorted array, and so are the forms of each."""

    def __init__(self, entries: Iterable[tuple[int, list[str], int]], weights: Weights = DEFAULT, fillers: Iterable[str] = ()) -> None:
        self.weights = weights
        self.forms: list[tuple[str, int, float, int, int]] = []  # form, kind, own cost, class id, frequency
        keys, at = [], []
        every_name: list[str] = []
        for class_id, names, frequency in entries:
            every_name += names
            for (form, kind), cost in forms_of_all(names, weights).items():
                own = np.fromiter(form_keys(form, kind), np.int64)
                keys.append(own)
                at.append(np.full(len(own), len(self.forms), np.int32))
                self.forms.append((form, kind, cost, class_id, frequency))
        self.words = Words(every_name, fillers)
        every = np.concatenate([*keys, np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.keys, start = np.unique(every[order], return_index=True)
        self.start = np.r_[start, len(every)].astype(np.int64)
        self.at = np.concatenate([*at, np.zeros(0, np.int32)])[order]

    def near(self, text: str) -> Iterable[tuple[str, int, float, int, int]]:
        asked = np.fromiter(keys_of(text, WHOLE), np.int64)
        place_ = np.searchsorted(self.keys, asked)
        place_ = place_[(place_ < len(self.keys)) & (self.keys[np.minimum(place_, len(self.keys) - 1)] == asked)] if len(self.keys) else place_[:0]
        if not len(place_):
            return []
        found = np.unique(np.concatenate([self.at[self.start[p] : self.start[p + 1]] for p in place_.tolist()]))
        return [self.forms[i] for i in found.tolist()]

    def find(self, value: str) -> tuple[int, float | None]:
        """(class id or MISS, its distance)."""
        return best_of(value, self.near, self.words, self.weights)


def best_of(value: str, near: object, known: Words, w: Weights) -> tuple[int, float | None]:
    """The best of the forms near a typed value: by cost, then frequency, then id."""
    best: tuple[float, int, int] | None = None
    for text, more in known.texts(value, w):
        for form, kind, own, class_id, frequency in near(text):
            if (cost := cost_of(text, form, kind, own, w)) is not None:
                rank = (round(cost + more, 6), -frequency, class_id)
                if best is None or rank < best:
                    best = rank
    return (best[2], best[0]) if best else (MISS, None)


def _entries(reference: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(class_id, names, frequency) of a list (class_id, class_name, aliases)."""
    names = F.filter(F.concat(F.array("class_name"), F.coalesce("aliases", F.array())), lambda x: x.isNotNull())
    return reference.join(frequencies, "class_name", "left").select(
        "class_id", names.alias("names"), F.coalesce("frequency", F.lit(0)).alias("frequency")
    )


def dictionary_bytes(entries: DataFrame) -> int:
    """What a dictionary of the entries takes at most, about: of each name its orders, or its rotations,
    and its first word cut short, each with its letters and its keys."""
    count = F.size(F.split(F.trim("name"), r"[^\p{L}\p{N}]+"))
    orders = F.when(count <= ORDERED, F.factorial(F.least(count, F.lit(ORDERED)))).otherwise(count)
    forms = orders + F.length("name") + 2
    each = forms * (F.length("name") * 4 + 12 * 100 + 150)
    return int(entries.select(F.explode("names").alias("name")).agg(F.sum(each)).first()[0] or 0)


def learned_fillers(values: DataFrame, entries: DataFrame, least: int = FILLER_ENTRIES) -> DataFrame:
    """(word): the words that stand beside an exact name, whatever the order of its words, of at least
    `least` different entries, and that no entry holds. values: (value) distinct."""
    names = entries.select("class_id", F.explode("names").alias("name"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, "") for name in batch.column(1).to_pylist() for w in words(name)]
            rows += [("", " ".join(sorted(words(name)))) for name in batch.column(1).to_pylist()]
            ids = [0] * (len(rows) - batch.num_rows) + batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(ids, pa.int32())], names=["word", "name", "class_id"])

    listed = cut(names.mapInArrow(held, "word string, name string, class_id int"))

    def each_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(v, w) for v in batch.column(0).to_pylist() for w in words(v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["value", "word"])

    in_list = listed.where("word <> ''").select("word").distinct()
    every = cut(values.mapInArrow(each_word, "value string, word string"))
    held_words, other = (member_join(every, in_list, "word", how) for how in ("left_semi", "left_anti"))
    marked = held_words.withColumn("held", F.lit(True)).unionByName(other.withColumn("held", F.lit(False)))
    per_value = marked.groupBy("value").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("held"), F.col("word")))), " ").alias("name"), F.collect_set(F.when(~F.col("held"), F.col("word"))).alias("more")
    )
    entries_of = listed.where("name <> ''").select(F.col("name").alias("_name"), "class_id").distinct()
    beside = spread_join(per_value.where(F.size("more") > 0), entries_of, "name", "_name").select(F.explode("more").alias("word"), "class_id")
    return beside.groupBy("word").agg(F.countDistinct("class_id").alias("n")).where(F.col("n") >= least).select("word")


def canonicalise(
    rows: DataFrame,
    value: str,
    reference: DataFrame,
    weights: Weights = DEFAULT,
    fillers: Iterable[str] | None = None,
    most_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """rows with `class_id` (int; MISS where no entry is meant), `cost` (double, null for a miss) and
    `exact` (boolean: the value is letter for letter a class_name).

    Only rows with a non-empty value come out. Columns of the input with these names are replaced.
    reference: (class_id, class_name, aliases array<string>). fillers: the words that may be left out; if
    not given, they are learned from the values.
    """
    kept = others(rows, OWN)
    at = place(rows, value)
    placed = by_place(rows).select(*[f"c{i}" for i in kept], *[f"c{at}"] * (at not in kept))
    typed = placed.where(F.col(f"c{at}").isNotNull() & (F.col(f"c{at}") != ""))
    answers = answers_of(typed, f"c{at}", pick(reference, "class_id", "class_name", "aliases"), weights, fillers, most_bytes)
    chars = answers.agg(F.sum(F.length("_value"))).first()[0] or 0
    mapped = spread_join(typed, answers, f"c{at}", "_value", limit=None if chars <= ANSWER_CHARS else 0)
    return mapped.select(*[f"c{i}" for i in kept], *OWN).toDF(*[rows.columns[i] for i in kept], *OWN)


def answers_of(typed: DataFrame, value: str, reference: DataFrame, weights: Weights, fillers: Iterable[str] | None, most_bytes: int) -> DataFrame:
    """(_value, class_id, cost, exact): the answer for each different value."""
    distinct = cut(typed.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n")))
    names = reference.select(F.col("class_name").alias("_name"), F.col("class_id").alias("_id"))
    exact = distinct.join(names, F.col("_value") == F.col("_name"), "left")
    frequencies = exact.where(F.col("_name").isNotNull()).select(F.col("_name").alias("class_name"), F.col("_n").alias("frequency"))
    entries = cut(_entries(reference, frequencies))
    matched = exact.where(F.col("_id").isNotNull()).groupBy("_value").agg(F.min("_id").cast("int").alias("class_id"))
    other = cut(exact.where(F.col("_id").isNull()).select("_value"))
    if fillers is None:
        learned = cut(learned_fillers(other, entries))
        if not fits(learned, FILLER_WORDS):
            raise ValueError(f"more than {FILLER_WORDS} words stand beside names of {FILLER_ENTRIES} entries: give the fillers")
        fillers = [r["word"] for r in learned.collect()]
    small = dictionary_bytes(entries) <= most_bytes
    found = (_by_broadcast if small else _by_shuffle)(other, entries, weights, fillers)
    every = matched.select("_value", "class_id", F.lit(0.0).alias("cost"), F.lit(True).alias("exact"))
    return cut(every.unionByName(found.withColumn("exact", F.lit(False))))


def _by_broadcast(values: DataFrame, entries: DataFrame, weights: Weights, fillers: Iterable[str]) -> DataFrame:
    listed = [(r["class_id"], r["names"], r["frequency"]) for r in entries.collect()]  # its size is checked by the caller
    shared = values.sparkSession.sparkContext.broadcast(Dictionary(listed, weights, fillers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary: Dictionary = shared.value
        for batch in batches:
            found = [dictionary.find(v) for v in batch.column(0).to_pylist()]
            ids, costs = pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, costs], names=["_value", "class_id", "cost"])

    spread = values.repartition(values.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, "_value string, class_id int, cost double")


def _by_shuffle(values: DataFrame, entries: DataFrame, weights: Weights, fillers: Iterable[str]) -> DataFrame:
    """For lists too long to broadcast: values and forms meet by their keys, and no step holds more of
    the list than one value's candidates, one at a time. Of the list itself, only the words that typed
    values could lose are known everywhere."""
    names = entries.select(F.explode("names").alias("name"))

    def name_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [words(n) for n in batch.column(0).to_pylist()]
            rows = [(w, sum(map(len, n)), len(n)) for n in listed for w in n]
            kinds = (pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["word", "letters", "words"])

    listed = cut(names.mapInArrow(name_words, "word string, letters int, words int"))
    longest, most = listed.agg(F.max("letters"), F.max("words")).first()
    # Of the list's words, those that could be left out otherwise: fillers, single letters, and numbers.
    losable = listed.where(F.col("word").isin(list(fillers)) | (F.length("word") == 1) | F.col("word").rlike(r"^\p{N}+$")).select("word").distinct()
    held = frozenset(r["word"] for r in losable.collect()) if fits(losable, FILLER_WORDS) else None
    known = Words([], fillers)
    known.longest, known.sorted = longest or 0, (most or 0) > ORDERED
    known.held = held if held is not None else _Numbers()
    known.fillers -= known.held if held is not None else frozenset()

    def keyed_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = [], [], [], []
            for value in batch.column(0).to_pylist():
                for text, more in known.texts(value, weights):
                    for key in keys_of(text, WHOLE, SHUFFLED_PREFIX):
                        out[0].append(key), out[1].append(value), out[2].append(text), out[3].append(more)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["k", "v", "t", "more"])

    def keyed_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for entry in batch.to_pylist():
                for (form, kind), cost in forms_of_all(entry["names"], weights).items():
                    out += [(k, form, kind, cost, entry["class_id"], entry["frequency"]) for k in form_keys(form, kind, SHUFFLED_PREFIX)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64())
            arrays = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "form", "kind", "own", "class_id", "frequency"])

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("t", "form", "kind", "own", "more"))
            cost = [None if (c := cost_of(t, form, kind, own, weights)) is None else round(c + more, 6) for t, form, kind, own, more in zip(*columns)]
            kept = pa.RecordBatch.from_arrays(
                [batch.column("v"), batch.column("class_id"), batch.column("frequency"), pa.array(cost, pa.float64())],
                names=["v", "class_id", "frequency", "cost"],
            )
            yield kept.filter(kept.column("cost").is_valid())

    keyed = values.mapInArrow(keyed_values, "k bigint, v string, t string, more double")
    forms = entries.mapInArrow(keyed_forms, "k bigint, form string, kind int, own double, class_id int, frequency bigint")
    met = keyed.join(forms, "k").select("v", "t", "more", "form", "kind", "own", "class_id", "frequency").distinct()
    ranked = met.mapInArrow(costs, "v string, class_id int, frequency bigint, cost double")
    rank = F.struct("cost", (-F.col("frequency")).alias("f"), "class_id")
    best = ranked.groupBy("v").agg(F.min(rank).alias("best")).select(F.col("v").alias("_v"), "best.class_id", "best.cost")
    return values.join(best, F.col("_value") == F.col("_v"), "left").select("_value", F.coalesce("class_id", F.lit(MISS)).cast("int").alias("class_id"), "cost")


class _Numbers:
    """Stands for the words of a list with so many numbers and letters that none is ever left out."""

    def __contains__(self, word: str) -> bool:
        return word.isdigit() or len(word) == 1


def misses(mapped: DataFrame, value: Column | str) -> DataFrame:
    """(value, rows): the typed values that mean no entry, with their rows."""
    name = F.col(value) if isinstance(value, str) else value
    return mapped.where(F.col("class_id") == MISS).groupBy(name.alias("label")).agg(F.count("*").alias("rows"))
