"""Built-in expressions only, so that they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the catalog's reports.
UNLABELED = "unlabeled"
ADDED = "added"
ALREADY_PRESENT = "already present"
UNKNOWN_SIZE = -1

# 64 hexadecimal digits that begin and end at a word's edge, with anything but letters and digits
# between them; a "0x" may precede them.
DIGEST_PATTERN = r"(?i)(?<![0-9a-z])(?:0x)?([0-9a-f](?:[^0-9a-z]*[0-9a-f]){63})(?![0-9a-z])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_key(label: Column | str) -> Column:
    """The reported label: null and '' report as `unlabeled`, every other text as it stands."""
    return F.coalesce(F.nullif(_col(label), F.lit("")), F.lit(UNLABELED))


def status_text(added: Column | str) -> Column:
    """The message of an import; null where the request held no digest to import."""
    c = _col(added)
    return F.when(c, ADDED).when(~c, ALREADY_PRESENT)


def content_digest(content: Column | str) -> Column:
    """SHA-256 of a text's UTF-8 bytes or of a binary value, as lowercase hexadecimal digits."""
    return F.sha2(_col(content), 256)


def content_size(content: Column | str) -> Column:
    """Size in bytes."""
    return F.octet_length(_col(content)).cast("bigint")


def known_size(size: Column | str) -> Column:
    """A size, or null where it is unknown (null or -1)."""
    return F.nullif(_col(size), F.lit(UNKNOWN_SIZE).cast("bigint"))


def digest_of(value: Column | str) -> Column:
    """The digest's 32 bytes, whatever the case of its digits and whatever stands around or between
    them; null for a value that doesn't hold all 64. Letters or digits that touch the 64 leave open
    which of them are meant ("sha256" directly before them, a 65th digit), so such a value holds none.
    A value of 64 characters needs no regular expression, and a shorter one has no digest."""
    c = _col(value)
    digits = F.regexp_replace(F.regexp_extract(c, DIGEST_PATTERN, 1), "[^0-9a-fA-F]", "")
    found = F.unhex(F.when(F.length(digits) == 64, digits))
    return F.when(F.length(c) == 64, F.unhex(c)).when(F.length(c) > 64, found)
