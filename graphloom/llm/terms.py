"""Terms of whole texts, exact and at the speed of ``bytes.split``.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. In UTF-8 every byte of
a character beyond ASCII is a term byte, so one translation of bytes and one split give the terms, without a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes split at a time: a list of terms takes about ten times the bytes of its text.
SLICE = 1 << 20

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 32 for b in range(256))


def split(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists of a bounded number of bytes (a longer term stays whole)."""
    if not isinstance(text, str):
        return
    plain = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE) if len(plain) - at > SLICE else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def numbers(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The number of each term of a whole text; 0 for a term that the vocabulary lacks."""
    parts = [np.fromiter(map(vocabulary.get, some, (0,) * len(some)), np.int32, len(some)) for some in split(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)
