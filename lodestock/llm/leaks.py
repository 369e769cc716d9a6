"""Problem 7: evaluation texts that leak into training texts.

The corpus is cut into shards of bounded size, each within a task. A shard's texts become one sequence
of word numbers. Of these, the runs of words that occur in items, and that are as long as the shortest
phrase, are put one after another with separators between; that becomes an FM-index: the Burrows-Wheeler
transform in a wavelet matrix, and every 32nd suffix position. A test phrase is searched backward, word
by word, each step two ranks in the matrix; all phrases advance together. The rows found are located by
walking to a sampled position, and the places of one item in one text are merged into spans for removal.

Phrases: every run of PHRASE words of an item, or the whole item if it's shorter. Words are runs of
letters or digits, after characters that look the same, case, entities and markup are taken away;
everything else is a gap without meaning. Markup, of any length: HTML tags and comments, BBCode,
addresses of Markdown links, and templates in double braces. A tag of a name that HTML or BBCode doesn't
have counts if it has an attribute with a value, or an end tag of its own in BBCode.

Null and empty texts and items, and items without words, hold nothing. Repeated texts are reported for
each of their rows. A text longer than a shard is searched in pieces that overlap by a phrase. Items that
share a passage are all reported. Items are broadcast in blocks of a bounded size, as word numbers; the
texts are read once, whatever the number of blocks, and a task holds one block at a time.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestock.llm.glyphs import HIDDEN, changes, match_fold, shows, tidy, to_latin
from lodestock.operators.columns import pick

PHRASE = 12
SHARD_WORDS = 400_000
SAMPLE = 32
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 20_000_000
SEARCHED_AT_ONCE = 200_000
LOCATED_AT_ONCE = 500_000

# The elements of HTML, past ones too.
HTML = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button"
    " canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset"
    " figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe image img"
    " input ins isindex kbd keygen label legend li link listing main map mark marquee menu menuitem meta meter nav nobr"
    " noembed noframes noscript object ol optgroup option output p param picture plaintext pre progress q rb rp rt rtc"
    " ruby s samp script search section select slot small source spacer span strike strong style sub summary sup svg"
    " table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xmp".split()
)
# The tags of BBCode that forums share.
BBCODE = frozenset(
    "* align attach attachment audio b big br center code color colour email flash font h1 h2 h3 h4 h5 h6 hide hr i"
    " image img indent justify left li list media mention ol p php post pre quote right s size small spoiler strike sub"
    " sup table tbody td th thead thread topic tr tt u ul url user video youtube".split()
)
# Tags that may stand within a word, so they leave no gap.
INLINE = frozenset("abbr acronym b bdi bdo big cite color colour del dfn em font i ins kbd mark s samp size small span strike strong sub sup tt u var wbr".split())
# BBCode whose content is an address or a number, not words.
_ADDRESSED = "img|image|youtube|video|media|audio|flash|attachment|attach"

_TAG = re.compile(r"""</?([A-Za-z][\w:.-]*+)(?:/?>|([\s/](?:(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^<>]*+>)))""")
_LINK = re.compile(r"""\[(?!/)[^\[\]]*+(\]\((?:[^()\s]|\([^()\s]*+\))*+(?:\s+"[^"\n]*+")?\s?\))""")
_ADDRESS = re.compile(rf"\[({_ADDRESSED})(?:[=\s][^\[\]]*+)?\]\s?[^\[\]\s]*+\s?\[/\1\]", re.I)
_BRACKET = re.compile(r"\[/?([A-Za-z][A-Za-z0-9]*+|\*)([=\s][^\[\]]*+)?/?\]")
_CLOSED = re.compile(r"\[/([A-Za-z][A-Za-z0-9]*+)\]")
_BRACES = re.compile(r"\{\{[^{}]*+\}\}")
_ESCAPED = r"(?:(?:[aA][mM][pP]|#0*38|#[xX]0*26);)"
_ENTITY = re.compile(rf"&{_ESCAPED}*+(?:#[0-9]++;|#[xX][0-9a-fA-F]++;|[a-zA-Z][a-zA-Z0-9]*+;)?")
_AMPERSANDS = re.compile(rf"&{_ESCAPED}*")
_MARKUP = re.compile(r"[&<\[{]")
_ACCENTED = regex.compile(r"(?s).\p{M}+")
_NOT_ASCII = regex.compile(r"[\p{L}--[a-zA-Z]][\p{L}\p{M}--[a-zA-Z]]*|[^\x00-\x7f]", regex.V1)
_RUN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")


# A place in a text, what stands there up to its end, and what takes its place.
Edits = Iterator[tuple[int, int, str]]


def _each(pattern: object, by: Callable[[object], str]) -> Callable[[str], Edits]:
    """The edits that put by(match) for each match of a pattern, or for its last group."""

    def edits(text: str) -> Edits:
        for m in pattern.finditer(text):
            group = m.lastindex or 0
            yield *m.span(group), by(m)

    return edits


def _unescaped(m: re.Match) -> str:
    """The character of an entity, however often its ampersand was escaped."""
    end = _AMPERSANDS.match(m[0]).end()
    return html.unescape("&" + m[0][end:]) if end < len(m[0]) else "&"


def _comments(text: str) -> Edits:
    start = text.find("<!--")
    while start >= 0 and (end := text.find("-->", start + 4)) >= 0:
        yield start, end + 3, " "
        start = text.find("<!--", end + 3)


def _tags(text: str) -> Edits:
    for m in _TAG.finditer(text):
        name = m[1].lower()
        if name in HTML or (m[2] and "=" in m[2]):
            yield *m.span(), "" if name in INLINE else " "


def _bbcode(text: str) -> Edits:
    own = {name.lower() for name in _CLOSED.findall(text)}
    for m in _BRACKET.finditer(text):
        name = m[1].lower()
        if name in BBCODE or name in own:
            yield *m.span(), "" if name in INLINE else " "


# The passes over a text, and the character without which each does nothing.
_ENTITIES = _each(_ENTITY, _unescaped)
_PASSES: list[tuple[str, Callable[[str], Edits]]] = [
    ("<", _comments),
    ("<", _tags),
    ("[", _each(_LINK, lambda m: " ")),
    ("[", lambda text: ((*m.span(), " ") for m in _ADDRESS.finditer(text))),
    ("[", _bbcode),
    ("{", lambda text: ((*m.span(), " ") for m in _BRACES.finditer(text))),
]


def _edited(text: str, edits: Edits) -> str:
    pieces, last = [], 0
    for a, b, put in edits:
        pieces += (text[last:a], put)
        last = b
    return "".join([*pieces, text[last:]]) if last else text


def plain(text: str) -> str:
    """Text in its look-alike form without entities and markup."""
    if changes(text):
        text = to_latin(tidy(text))
    if "&" in text:
        text = tidy(_edited(text, _ENTITIES(text)))
    for sign, edits in _PASSES:
        if sign in text:
            text = _edited(text, edits(text))
    return text


def _folded(part: str) -> list[str]:
    """The words of a part of a text between spaces."""
    return _RUN.findall(match_fold(to_latin(tidy(part))))


def parts(text: str) -> list[str]:
    """The parts of a text between spaces: no word reaches from one into another."""
    return (plain(text) if _MARKUP.search(text) else text).split()


def words(text: str) -> list[str]:
    """The words of a text, for comparison."""
    return [w for part in parts(text) for w in _folded(part)]


class Edited:
    """A text under a series of substitutions that remembers where its characters came from."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.steps: list[tuple[list[int], list[tuple[int, int, bool]]]] = []

    def apply(self, edits: Edits) -> None:
        pieces, marks, last, length = [], [(0, 0, False)], 0, 0
        for a, b, put in edits:
            pieces += (self.text[last:a], put)
            length += a - last
            if len(put) != b - a:
                # What was put in comes from the whole of what it replaces.
                marks += [(length, a, True)] * bool(put) + [(length + len(put), b, False)]
            length += len(put)
            last = b
        if last:
            self.text = "".join([*pieces, self.text[last:]])
        if len(marks) > 1:
            self.steps.append(([m[0] for m in marks], marks))

    def replace(self, pattern: object, by: Callable[[str], str]) -> None:
        self.apply((*m.span(), by(m[0])) for m in pattern.finditer(self.text))

    def markup(self) -> None:
        for sign, edits in _PASSES:
            if sign in self.text:
                self.apply(edits(self.text))

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """Where the characters from start to before end come from."""
        for starts, marks in reversed(self.steps):
            i = bisect_right(starts, start) - 1
            at, was, whole = marks[i]
            start = was if whole else was + start - at
            i = bisect_right(starts, end - 1) - 1
            at, was, whole = marks[i]
            end = marks[i + 1][1] if whole else was + end - at
        return start, end


def _located(text: str) -> Edited:
    """The text as words() reads it, step by step."""
    e = Edited(text)
    if not text.isascii():
        e.replace(HIDDEN, lambda x: "")
        e.replace(_ACCENTED, tidy)
        e.replace(_NOT_ASCII, lambda x: to_latin(tidy(x)))
    if "&" in e.text:
        e.apply(_ENTITIES(e.text))
        e.replace(HIDDEN, lambda x: "")
        e.replace(_ACCENTED, tidy)
        e.replace(_NOT_ASCII, tidy)
    e.markup()
    e.replace(_NOT_ASCII, match_fold)
    e.text = e.text.lower()  # the rest is ASCII
    return e


class Places:
    """Where the words of a text stand in it as it is. Made only for texts in which something was found."""

    def __init__(self, text: str) -> None:
        self.edited = _located(text)
        if _RUN.findall(self.edited.text) != words(text):  # some unusual composition
            self.edited = _each_character(text)
        self.at = [m.span() for m in _RUN.finditer(self.edited.text)]

    def span(self, first: int, last: int) -> tuple[int, int]:
        """The characters of the words from `first` to before `last`."""
        return self.edited.origin(self.at[first][0], self.at[last - 1][1])


def _each_character(text: str) -> Edited:
    """Like _located, for any text: each letter with what belongs to it is a step of its own."""
    e = Edited(text)
    shown = iter(shows(text))
    e.replace(regex.compile(r"(?s)."), lambda c: c if next(shown) else "")
    e.replace(regex.compile(r"(?s).\p{M}*"), lambda c: to_latin(tidy(c)))
    if "&" in e.text:
        e.apply(_ENTITIES(e.text))
        e.replace(HIDDEN, lambda x: "")
        e.replace(regex.compile(r"(?s).\p{M}*"), tidy)
    e.markup()
    e.replace(regex.compile(r"(?s).\p{M}*"), match_fold)
    return e


def word_places(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of a text, and where each begins and ends in the text as it is."""
    p = Places(text)
    spans = [p.span(i, i + 1) for i in range(len(p.at))]
    return [p.edited.text[a:b] for a, b in p.at], [a for a, _ in spans], [b for _, b in spans]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence, by doubling the length compared until all differ. A suffix
    that ends is less than one that goes on."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    n, width = len(rank), 1
    while True:
        second = np.zeros(n, np.int64)
        if width < n:
            second[:-width] = rank[width:]
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        ordered = both[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]])
        rank = new
        if width >= n or rank[order[-1]] == n:
            return order
        width *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one row of bits per bit of the symbols, highest first, each
    sequence sorted by the bits so far."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(symbols) - int(before[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbols: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """For each symbol, how often it occurs before each end."""
        at = [np.zeros(len(symbols), np.int64), *(e.astype(np.int64) for e in ends)]
        for i in range(self.bits):
            one = ((symbols >> (self.bits - 1 - i)) & 1).astype(bool)
            before, zeros = self.ones[i], self.zeros[i]
            for j, a in enumerate(at):
                ones = before[a]
                at[j] = np.where(one, zeros + ones, a - ones)
        return [a - at[0] for a in at[1:]]


class FMIndex:
    """Backward search and location of phrases in a sequence of symbols (all at least 1)."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.append(symbols, 0)  # the end, less than all
        order = suffix_array(text)
        self.bwt = text[order - 1]
        most = int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        self.matrix = WaveletMatrix(self.bwt, max(1, most.bit_length()))
        sampled = order % sample == 0
        self.sampled = sampled
        self.sample_at = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.length, self.most = len(text), most

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) rows of each phrase, right-aligned in a matrix whose unused places are 0."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.length, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column]
            going = symbol > 0
            step = live[going]
            if not len(step):
                break
            symbol = symbol[going]
            a, b = self.matrix.rank(symbol, low[step], high[step])
            low[step], high[step] = self.before[symbol] + a, self.before[symbol] + b
            live = step[low[step] < high[step]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of rows begin."""
        place = np.zeros(len(rows), np.int64)
        at, steps, todo = rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            done = self.sampled[at[todo]]
            ready = todo[done]
            place[ready] = self.samples[self.sample_at[at[ready]]] + steps
            todo = todo[~done]
            symbol = self.bwt[at[todo]]
            at[todo] = self.before[symbol] + self.matrix.rank(symbol, at[todo])[0]
            steps += 1
        return place


class Phrases:
    """The phrases of items: the words of items of different wording, numbered from 1, one after another,
    and where each phrase begins among them."""

    def __init__(self, items: Iterable[tuple[object, str | None]], length: int = PHRASE) -> None:
        same: dict[tuple[str, ...], list[object]] = {}
        for item, text in items:
            if w := tuple(words(text or "")):
                same.setdefault(w, []).append(item)
        self.items = [sorted(i, key=lambda x: (x is None, x)) for i in same.values()]
        self.numbers: dict[str, int] = {}
        numbers = [np.array([self.numbers.setdefault(x, len(self.numbers) + 1) for x in w], np.int32) for w in same]
        self.words = np.concatenate([*numbers, np.zeros(0, np.int32)])
        sizes = np.array([len(n) for n in numbers], np.int64)
        count = np.maximum(1, sizes - length + 1)
        self.group = np.repeat(np.arange(len(sizes), dtype=np.int32), count)
        first = np.repeat(np.cumsum(sizes) - sizes, count)
        self.start = (first + np.arange(len(self.group)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        self.size = np.repeat(np.minimum(sizes, length), count).astype(np.int32)
        self.least = int(self.size.min()) if len(self.size) else 0


class _Numbered(dict):
    """A part of a text to the numbers of its words, in one shard."""

    def __init__(self) -> None:
        super().__init__()
        self.words: dict[str, int] = {}

    def __missing__(self, part: str) -> list[int]:
        own = self[part] = [self.words.setdefault(w, len(self.words) + 1) for w in _folded(part)]
        return own


class Shard:
    """Texts of one shard as word numbers, a 0 after each, so no phrase spans two."""

    def __init__(self) -> None:
        self.numbered = _Numbered()
        self.parts: list[np.ndarray] = []
        self.starts: list[int] = []
        self.size = 0

    def read(self, text: str) -> np.ndarray:
        """The numbers of a text's words."""
        return np.array(list(chain.from_iterable(map(self.numbered.__getitem__, parts(text)))), np.int32)

    def add(self, numbers: np.ndarray) -> None:
        self.starts.append(self.size)
        self.parts += (numbers, np.zeros(1, np.int32))
        self.size += len(numbers) + 1

    def find(self, sought: Phrases) -> Iterator[tuple[int, int, int, int]]:
        """(text, group of items, first word, word after the last) of the spans found, merged, in order."""
        if not self.size or not len(sought.start):
            return
        number = np.zeros(len(self.numbered.words) + 1, np.int32)
        for word, own in self.numbered.words.items():
            number[own] = sought.numbers.get(word, 0)
        symbols = number[np.concatenate([*self.parts, np.zeros(1, np.int32)])]
        # Only runs of words that items have, each with the word after it as a separator.
        edges = np.flatnonzero(np.diff(np.r_[False, symbols > 0, False]))
        first, end = edges[::2], edges[1::2]
        long = end - first >= sought.least
        first, size = first[long], (end - first)[long] + 1
        if not len(first):
            return
        at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        # Numbered anew, by the words that are left: 0 is none, 1 the separator.
        left = np.unique(symbols[at])
        code = np.zeros(len(sought.numbers) + 1, np.int64)
        code[left] = np.arange(1, len(left) + 1)
        words_ = np.where(sought.words > 0, code[sought.words], 0)
        there = np.r_[0, np.cumsum(words_ > 0)]
        whole = np.flatnonzero(there[sought.start + sought.size] - there[sought.start] == sought.size)
        if not len(whole):
            return
        index = FMIndex(code[symbols[at]])
        starts = np.array(self.starts)
        found: list[np.ndarray] = []
        for a in range(0, len(whole), SEARCHED_AT_ONCE):
            phrases = whole[a : a + SEARCHED_AT_ONCE]
            begin, length = sought.start[phrases], sought.size[phrases]
            most = int(length.max())
            column = np.arange(most) - most
            place = begin[:, None] + length[:, None] + column
            matrix = np.where(column >= -length[:, None], words_[np.maximum(place, 0)], 0)
            low, high = index.search(matrix)
            count = np.maximum(high - low, 0)
            hits = np.flatnonzero(count)
            for block in np.split(hits, np.flatnonzero(np.diff(np.cumsum(count[hits]) // LOCATED_AT_ONCE)) + 1):
                n = count[block]
                rows = np.repeat(low[block] - np.cumsum(n) + n, n) + np.arange(n.sum())
                word = at[index.locate(rows)]
                text = np.searchsorted(starts, word, side="right") - 1
                phrase = phrases[np.repeat(block, n)]
                found.append(_merged(text, sought.group[phrase], word, word + sought.size[phrase]))
        if found:
            for t, g, a, b in _merged(*np.concatenate(found, axis=1)).T.tolist():
                yield t, g, a - self.starts[t], b - self.starts[t]


def _merged(text: np.ndarray, group: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(4, n) spans in order, those of one text and group that overlap or touch joined."""
    order = np.lexsort((first, group, text))
    text, group, first, end = text[order], group[order], first[order], end[order]
    other = np.r_[True, (text[1:] != text[:-1]) | (group[1:] != group[:-1])][: len(text)]
    base = np.cumsum(other) * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + base) - base  # the end of all that came before, of this text and group
    at = np.flatnonzero(other | np.r_[True, first[1:] > reach[:-1]][: len(text)])
    last = np.r_[at[1:], len(text)][: len(at)] - 1
    return np.stack([text[at], group[at], first[at], reach[last]]).astype(np.int64)


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks small enough to broadcast, by rows and by characters."""
    count, chars = items.agg(F.count("*"), F.sum(F.length(items.columns[1]))).first()
    blocks = max(1, -(-count // limit), -(-(chars or 0) // BLOCK_CHARS))
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64(items.columns[0]), F.lit(blocks)) == b)
        yield [tuple(r) for r in own.collect()]


def _release(shared: object) -> None:
    """Let a broadcast value go; it's read again from its file when next asked for."""
    shared.__dict__.pop("_value", None)


def find_leaks(
    documents: DataFrame,
    doc_id: str,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    phrase: int = PHRASE,
    shard_words: int = SHARD_WORDS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(doc_id, item_id, spans array<struct<start, end>>): each text with each item that leaked into it,
    and the characters of the text to remove, in order and without overlap."""
    documents, items = pick(documents, doc_id, text), pick(items, item_id, item_text)
    kinds = (documents.schema[doc_id].dataType, items.schema[item_id].dataType)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("doc_id", kinds[0]), T.StructField("item_id", kinds[1]), T.StructField("spans", span)])
    sought_items = items.select(item_id, item_text).where(F.col(item_text).isNotNull())
    corpus = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(doc_id, text)
    shared = []
    for block in _blocks(sought_items, block_items):
        shared.append(documents.sparkSession.sparkContext.broadcast(Phrases(block, phrase)))
        if len(shared) > 1:
            _release(shared[-2])
    return corpus.mapInArrow(_search(shared, phrase, shard_words, schema), schema)


def _search(shared: list, phrase: int, shard_words: int, schema: T.StructType) -> object:
    def rows(shard: Shard, held: list[tuple[object, str]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        """What a shard holds, block by block of the items; a held text may stand in several pieces."""
        for block in shared:
            sought: Phrases = block.value
            spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for t, group, a, b in shard.find(sought):
                spans.setdefault((t, group), []).append((a, b))
            if spans:
                yield _rows(spans, held, sought, arrow)
            if len(shared) > 1:
                _release(block)

    def in_pieces(shard: Shard, numbers: np.ndarray, key: object, content: str, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A text longer than a shard: pieces that overlap by a phrase less one word."""
        for block in shared:
            sought: Phrases = block.value
            spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for start in range(0, len(numbers), shard_words):
                piece = Shard()
                piece.numbered = shard.numbered
                piece.add(numbers[start : start + shard_words + phrase - 1])
                for _, group, a, b in piece.find(sought):
                    spans.setdefault((0, group), []).append((start + a, start + b))
            if spans:
                yield _rows({k: merged(v) for k, v in spans.items()}, [(key, content)], sought, arrow)
            if len(shared) > 1:
                _release(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        shard, held = Shard(), []
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = shard.read(content)
                if len(numbers) > shard_words:
                    yield from in_pieces(shard, numbers, key, content, arrow)
                    continue
                shard.add(numbers)
                held.append((key, content))
                if shard.size >= shard_words:
                    yield from rows(shard, held, arrow)
                    shard, held = Shard(), []
        if held:
            yield from rows(shard, held, arrow)

    return run


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rows(spans: dict[tuple[int, int], list[tuple[int, int]]], held: list[tuple[object, str]], sought: Phrases, arrow: pa.Schema) -> pa.RecordBatch:
    """A row for each text and each item of the groups found in it, with the characters of the spans."""
    out: list[tuple] = []
    now, places = None, None
    for (t, group), own in spans.items():  # in the order of the texts
        if t != now:
            now, places = t, Places(held[t][1])
        cut = [dict(zip(("start", "end"), places.span(a, b))) for a, b in own]
        out += [(held[t][0], item, cut) for item in sought.items[group]]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], names=arrow.names)
