"""Words of texts held as UTF-8 bytes."""

from __future__ import annotations

import re

#: Lower-cases A-Z; every ASCII sign that is neither a letter nor a digit becomes a space.
_ASCII_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Lower-cases A-Z only.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: The same words as places in a text, in either case.
WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ascii_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return text.translate(_ASCII_WORDS).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    return text.translate(_LOWER).split()
