"""Characters that look the same: the table, and the folds that problems 1, 7 and 8 build on it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import regex

# Letters that look like a Latin letter, by that letter. Upper-case letters have lines
# of their own, as a pair of cases needn't look alike in both (Cyrillic "В" does, "в" doesn't).
LOOK_ALIKES = {
    "a": "аɑ",
    "c": "сϲ",
    "d": "ԁ",
    "e": "е",
    "g": "ɡց",
    "h": "һհ",
    "i": "і",
    "j": "јϳ",
    "n": "ո",
    "o": "оοօ",
    "p": "р",
    "q": "ԛ",
    "s": "ѕ",
    "u": "ս",
    "v": "ѵ",
    "w": "ԝ",
    "x": "х",
    "y": "у",
    "A": "АΑⱭ",
    "B": "ВΒ",
    "C": "СϹ",
    "D": "Ԁ",
    "E": "ЕΕ",
    "G": "Ɡ",
    "H": "НΗҺ",
    "I": "ІΙ",
    "J": "ЈͿ",
    "K": "КΚ",
    "M": "МΜ",
    "N": "Ν",
    "O": "ОΟՕ",
    "P": "РΡ",
    "Q": "Ԛ",
    "S": "ЅՏ",
    "T": "ТΤ",
    "U": "Ս",
    "V": "Ѵ",
    "W": "Ԝ",
    "X": "ХΧ",
    "Y": "УΥҮ",
    "Z": "Ζ",
}
# Characters that show nothing, as ranges of code points. The joiner and the variation
# selectors change how an emoji looks, so they are kept beside one; see _LOOSE.
SHOWS_NOTHING = [
    (0x00AD, 0x00AD),
    (0x034F, 0x034F),
    (0x061C, 0x061C),
    (0x115F, 0x1160),
    (0x17B4, 0x17B5),
    (0x180B, 0x180F),
    (0x200B, 0x200C),
    (0x200E, 0x200F),
    (0x202A, 0x202E),
    (0x2060, 0x206F),
    (0x3164, 0x3164),
    (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0),
]
# Spaces that don't break a line.
FIXED_SPACES = "\u00a0\u2007\u202f"

TO_LATIN = {other: latin for latin, others in LOOK_ALIKES.items() for other in others}
WIDE = {code: code - 0xFEE0 for a, b in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for code in range(a, b + 1)}
_EMOJI = r"[\p{So}\p{Sk}\ufe0f\U0001F1E6-\U0001F1FF]"
# A joiner stays between emoji, a variation selector after one.
_LOOSE = regex.compile(rf"(?<!{_EMOJI})[\u200d\ufe0e\ufe0f]+|\u200d+(?!{_EMOJI})")
_HIDDEN = {code: None for a, b in SHOWS_NOTHING for code in range(a, b + 1)}
HIDDEN = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SHOWS_NOTHING) + "]+|" + _LOOSE.pattern)
_PLAIN = {**WIDE, **{ord(c): " " for c in FIXED_SPACES}, **_HIDDEN}
# Runs of letters that may look like Latin ones, with their accents; and whatever tidy() changes.
_FOREIGN = regex.compile(r"[\u00b5\u0251\u0261\u0370-\u058f\u1f00-\u1fff\u2c6d\ua7ac][\u00b5\u0251\u0261\u0300-\u058f\u1f00-\u1fff\u2c6d\ua7ac]*")
_UNTIDY = regex.compile("[" + "".join(f"\\U{c:08x}" for c in [*_PLAIN, 0x200D, 0xFE0E, 0xFE0F]) + "]")
_LATIN = {ord(other): latin for other, latin in TO_LATIN.items()}


def _class(codes: Iterable[int]) -> str:
    return "".join(f"\\U{c:08x}" for c in codes)


# Whatever tidy() or to_latin() may change, and some characters that they leave. For a quick look.
_CHANGES = re.compile(f"[{_class([*_PLAIN, 0x200D, 0xFE0E, 0xFE0F])}\u00b5\u0251\u0261\u0300-\u058f\u1100-\u11ff\u1f00-\u1fff\u2c6d\ua7ac]")


def changes(text: str) -> bool:
    """Whether tidy() or to_latin() may change a text."""
    return not text.isascii() and (_CHANGES.search(text) is not None or not unicodedata.is_normalized("NFC", text))


def tidy(text: str) -> str:
    """Text without what is surely only another way to write it: characters that show nothing, letters
    and digits of full width, spaces that don't break, and accents as characters of their own. Look-
    alike letters stay as they are."""
    if text.isascii():
        return text
    if not _UNTIDY.search(text):
        return unicodedata.normalize("NFC", text)
    text = text.translate(_PLAIN)
    if "\u200d" in text or "\ufe0f" in text or "\ufe0e" in text:
        text = _LOOSE.sub("", text)
    return unicodedata.normalize("NFC", text)


def shows(text: str) -> list[bool]:
    """For each character of a text, whether tidy() keeps it (perhaps as another one)."""
    kept = [ord(c) not in _HIDDEN for c in text]
    at = [i for i, k in enumerate(kept) if k]
    for m in _LOOSE.finditer("".join(text[i] for i in at)):
        for i in range(*m.span()):
            kept[at[i]] = False
    return kept


@lru_cache(maxsize=100_000)
def _latin_run(run: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", run).translate(_LATIN))


def to_latin(text: str) -> str:
    """A tidy text with every look-alike letter as the Latin one, also below an accent. Equal for two
    tidy texts just when they look the same."""
    return text if text.isascii() else _FOREIGN.sub(lambda m: _latin_run(m[0]), text)


def _closed_under_case() -> dict[int, str]:
    """Each character's representative when letters that look the same, in any case, are one."""
    group: dict[str, set[str]] = {}
    for other, latin in TO_LATIN.items():
        joined: set[str] = set()
        for c in {other, latin, other.lower(), other.upper(), latin.lower(), latin.upper()}:
            if len(c) == 1:
                joined |= group.get(c, {c})
        for c in joined:
            group[c] = joined
    name = {}
    for c, members in group.items():
        if len({m.lower() for m in members if m.isascii()}) > 1:
            raise AssertionError(f"{members} would make different Latin letters one")
        name[ord(c)] = min(members, key=lambda m: (not m.isascii(), not m.islower(), m))
    return name


_MATCH = _closed_under_case()


@lru_cache(maxsize=100_000)
def _match_run(run: str) -> str:
    parts = unicodedata.normalize("NFD", run).translate(_MATCH).casefold().translate(_MATCH)
    return unicodedata.normalize("NFC", parts)


def match_fold(text: str) -> str:
    """A coarse form of a tidy text for comparing words whatever their case and look: equal words stay
    equal, and a few different letters (such as Cyrillic "в" and Latin "b") become one."""
    if text.isascii():
        return text.casefold()
    return _FOREIGN.sub(lambda m: _match_run(m[0]), text).casefold()


def bare(text: str) -> str:
    """match_fold without any accents."""
    if text.isascii():
        return text.casefold()
    return "".join(c for c in unicodedata.normalize("NFD", match_fold(tidy(text))) if not unicodedata.combining(c))
