"""Column expressions."""

from lodestock.functions.expr import (
    content_digest,
    content_size,
    digest_of,
    known_size,
    label_key,
    status_text,
)

__all__ = ["content_digest", "content_size", "digest_of", "known_size", "label_key", "status_text"]
