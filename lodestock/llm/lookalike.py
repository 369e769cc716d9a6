"""Problem 8: bring texts that look the same to one form.

1. Every text is made tidy: characters that show nothing go, letters and digits of full width and spaces
   that don't break become the ordinary ones, accents join their letters.
2. The corpus' vocabulary is that of its tokens (runs of letters) of one script. Tokens that look the
   same are a class, known by its look: the token with every look-alike letter as the Latin one.
3. A token of mixed script takes the way to write its class in one script that the vocabulary has. Where
   it has several, the Latin one goes first, then the one in the dominant script of most of the class'
   tokens: each token names the script of most of its letters.
4. Tokens of one script stay as they are, but for those that look like another token of one script (a
   Cyrillic "а" alone, codes in capitals), which no rule about mixed scripts can see: they take the same
   way to write their class. Mixed tokens that nobody wrote properly take their look.

So two texts have equal forms just when they look the same, and every form is written as the corpus
writes it, wherever it does.

Null texts have a null form; empty and blank ones an empty form, and are never pairs. Repeated texts have
equal forms and are no pair with each other, but each is one with every differing text of their look.
Texts of any length are taken whole. A text of characters that no step can change is passed on as it is,
within its Arrow batch; the others are read by their parts between spaces, equal parts once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.llm.glyphs import LOOK_ALIKES, tidy, to_latin
from lodestock.operators.columns import pick
from lodestock.operators.joins import spread_join
from lodestock.session import cut, fits

BROADCAST_TOKENS = 200_000
PAIR_BLOCK = 1_000
_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# Scripts that have letters like Latin ones, by code points. Latin letters made for
# phonetics are a script of their own here.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "cyrillic": ((0x400, 0x52F),),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "armenian": ((0x530, 0x58F),),
    "phonetic": ((0x250, 0x2AF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
}
# Ranges of characters that are tidy and of no other script that has look-alikes.
UNCHANGED = (
    (0x00, 0x7F),
    (0xA1, 0xAC),
    (0xAE, 0xB4),
    (0xB6, 0x24F),
    (0x2010, 0x2027),
    (0x2030, 0x205E),
    (0x20A0, 0x20BF),
    (0x2190, 0x22FF),
    (0x3001, 0x3029),
    (0x3041, 0x3096),
    (0x30A1, 0x30FE),
    (0x4E00, 0x9FFF),
)
_CHANGING = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in UNCHANGED) + "]"
REMEMBERED_PARTS = 500_000


@lru_cache(maxsize=100_000)
def script(letter: str) -> str:
    code = ord(letter)
    for name, ranges in SCRIPTS.items():
        if any(a <= code <= b for a, b in ranges):
            return name
    return "other"


def _twins() -> dict[str, dict[str, str]]:
    """Script to (Latin letter to the letter of that script that looks like it)."""
    out: dict[str, dict[str, str]] = {"latin": {latin: latin for latin in LOOK_ALIKES}}
    for latin, others in LOOK_ALIKES.items():
        for other in others:
            out.setdefault(script(other), {}).setdefault(latin, other)
    return out


TWINS = _twins()


def _letters(token: str) -> dict[str, int]:
    """Script to the letters of a token in it, of the scripts that may look alike."""
    count: dict[str, int] = {}
    for letter in token:
        if letter.isalpha() and (name := script(letter)) != "other":
            count[name] = count.get(name, 0) + 1
    return count


@lru_cache(maxsize=100_000)
def mixed(token: str) -> bool:
    """Whether a token has letters of more than one script that may look alike."""
    return not token.isascii() and len(_letters(token)) > 1


@lru_cache(maxsize=100_000)
def dominant(token: str) -> str:
    """The script of most of a token's letters, the first of SCRIPTS among equals; "other" for none."""
    count = _letters(token)
    return max(SCRIPTS, key=lambda s: count.get(s, 0)) if count else "other"


def as_script(token: str, name: str) -> str | None:
    """The token with all its letters in one script, or None where a letter has no twin there."""
    out = []
    for letter in unicodedata.normalize("NFD", to_latin(token)):
        if script(letter) == name or not letter.isalpha():
            out.append(letter)
        elif (twin := TWINS[name].get(letter)) is not None:
            out.append(twin)
        else:
            return None
    return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=200_000)
def _look(token: str) -> str:
    return to_latin(token)


class Former(dict):
    """The forms of the parts of texts between spaces. ways: look of a class to the way in which it's
    written. `repaired` has the parts in which the vocabulary repaired mixed tokens, and how many."""

    def __init__(self, ways: Mapping[str, str]) -> None:
        super().__init__()
        self.ways = ways
        self.repaired: dict[str, int] = {}

    def __missing__(self, part: str) -> str:
        if len(self) >= REMEMBERED_PARTS:
            self.clear()
        count = 0

        def one(m: regex.Match) -> str:
            nonlocal count
            if (token := m[0]).isascii():
                return token
            written = self.ways.get(look := _look(token))
            if not mixed(token):
                return written or token
            count += written is not None
            return written or look

        form = tidy(part)
        if not form.isascii():
            form = _TOKEN.sub(one, form)
        if count:
            self.repaired[part] = count
        self[part] = form
        return form

    def form(self, text: str) -> tuple[str, int]:
        """The form of a text, and how many of its mixed tokens the vocabulary repaired."""
        parts = text.split(" ")
        form = " ".join(map(self.__getitem__, parts))
        return form, sum(map(self.repaired.get, parts, repeat(0))) if self.repaired else 0


def form(text: str, ways: Mapping[str, str] | None = None) -> str:
    """The form of a text, with the ways to write its tokens that the vocabulary has."""
    return Former(ways or {}).form(text)[0]


def changing(texts: pa.Array) -> np.ndarray:
    """Which texts hold a character that some step may change or compare; null ones don't."""
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, _CHANGING), False))


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(look, token, script, single): the distinct tokens of each batch of texts."""
    for batch in batches:
        found: set[str] = set()
        for part in pc.unique(pc.list_flatten(pc.utf8_split_whitespace(batch.column(0)))).to_pylist():
            found.update(_TOKEN.findall(tidy(part)))
        rows = [(_look(t), t, dominant(t), not mixed(t)) for t in found]
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["look", "token", "script", "single"])


def ways_of(df: DataFrame, text: str) -> DataFrame:
    """(look, written): the classes of tokens of a corpus of which some are mixed and the vocabulary has a
    way to write them in one script, or has several; and that way. Every text's tokens count, reduced to
    distinct ones per batch before they move."""
    texts = pick(df, text).toDF("t").where(F.col("t") != "")
    every = texts.mapInArrow(_token_rows, "look string, token string, script string, single boolean").distinct()
    single = {s: F.max(F.when(F.col("single") & (F.col("script") == s), F.col("token"))) for s in SCRIPTS}
    votes = {s: F.count(F.when(F.col("script") == s, 1)) for s in SCRIPTS}
    classes = every.groupBy("look").agg(
        F.max(~F.col("single")).alias("mixed"), *[c.alias(s) for s, c in single.items()], *[c.alias(f"{s}_n") for s, c in votes.items()]
    )
    written = [F.struct(F.col(f"{s}_n").alias("n"), F.lit(-i).alias("first"), F.col(s).alias("w")) for i, s in enumerate(SCRIPTS)]
    best = F.array_max(F.filter(F.array(*written), lambda x: x["w"].isNotNull()))["w"]
    several = sum((F.col(s).isNotNull().cast("int") for s in SCRIPTS), F.lit(0)) > 1
    return classes.select("look", F.coalesce(F.col("latin"), best).alias("written"), (F.col("mixed") | several).alias("_")).where("_ and written is not null").drop("_")


def forms(df: DataFrame, key: str, text: str, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(key, text, form, repaired): `repaired` counts the mixed tokens that the vocabulary repaired."""
    base = pick(df, key, text)
    ways = cut(ways_of(base, text))
    fields = [base.schema[key], base.schema[text], T.StructField("form", T.StringType()), T.StructField("repaired", T.IntegerType())]
    schema = T.StructType(fields)
    if fits(ways, broadcast_tokens):
        shared = df.sparkSession.sparkContext.broadcast(dict(map(tuple, ways.collect())))
        return base.mapInArrow(_form_rows(lambda: shared.value), schema)
    # More classes than may be broadcast: each text gets its own, by a join on the looks.
    looks = _own_looks(base.where(F.col(text).isNotNull()), key, text)
    own = spread_join(looks, ways.withColumnRenamed("look", "_look"), "look", "_look", broadcast_tokens).groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("look", "written"))).alias("_ways"))
    joined = base.join(own, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, text, "_ways")
    return joined.mapInArrow(_form_rows(None), schema)


def _own_looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, look): the looks of the tokens of each text that aren't ASCII."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, content in enumerate(batch.column(1).to_pylist()):
                own = {_look(t) for t in _TOKEN.findall(tidy(content)) if not t.isascii()}
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["_key", "look"])

    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("look", T.StringType())])
    return df.select(key, text).mapInArrow(run, schema)


def _form_rows(ways: Callable[[], dict[str, str]] | None) -> object:
    """Forms of batches (key, text), with the same ways for all; or of (key, text, ways), each with its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former(ways()) if ways else None
        for batch in batches:
            texts = batch.column(1)
            changed = changing(texts)
            counts = np.zeros(batch.num_rows, np.int32)
            put = []
            for i in np.flatnonzero(changed).tolist():
                own = Former(dict(batch.column(2)[i].as_py() or [])) if former is None else former
                form, counts[i] = own.form(texts[i].as_py())
                put.append(form)
            forms_ = pc.replace_with_mask(texts, pa.array(changed), pa.array(put, texts.type))
            blank = pc.equal(pc.utf8_trim_whitespace(forms_), "")
            forms_ = pc.if_else(blank, pa.scalar("", texts.type), forms_)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, forms_, pa.array(counts)], names=[batch.schema.names[0], batch.schema.names[1], "form", "repaired"])

    return run


def same_look(formed: DataFrame, key: str, text: str) -> DataFrame:
    """(look, key, exact, _n): the rows whose form is shared by at least two different texts, and how many
    there are; `look` and `exact` are SHA-256 of form and text. One row per text, never pairs: this is the
    result for groups of any size. Groups are counted before any row moves."""
    rows = formed.where(F.col("form") != "").select(
        F.unhex(F.sha2("form", 256)).alias("look"), F.col(key), F.unhex(F.sha2(text, 256)).alias("exact")
    )
    rows = cut(rows)
    groups = rows.groupBy("look").agg(F.min("exact").alias("a"), F.max("exact").alias("b"), F.count("*").alias("_n"))
    several = cut(groups.where(F.col("a") != F.col("b")).select(F.col("look").alias("_look"), "_n"))
    return spread_join(rows, several, "look", "_look").select("look", key, "exact", "_n")


def pairs(members: DataFrame, key: str) -> DataFrame:
    """(<key>_a, <key>_b), a < b: the pairs of rows of one look but different texts. A large group is
    spread over as many tasks as it has blocks of PAIR_BLOCK rows."""
    members = cut(members)
    blocks = F.ceil(F.col("_n") / PAIR_BLOCK).cast("int")
    left = members.select("look", F.pmod(F.xxhash64(key), blocks).cast("int").alias("block"), F.col(key).alias("a"), F.col("exact").alias("ea"))
    right = members.select(
        F.col("look").alias("look_b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block_b"), F.col(key).alias("b"), F.col("exact").alias("eb")
    )
    met = left.join(right, (F.col("look") == F.col("look_b")) & (F.col("block") == F.col("block_b")))
    return met.where((F.col("a") < F.col("b")) & (F.col("ea") != F.col("eb"))).select(
        F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b")
    )
