"""Terms of a text for search and audit: runs of letters (and digits), told apart on the bytes of UTF-8."""

from __future__ import annotations

_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]


def _table(kept: list[int]) -> bytes:
    """Each byte as itself, A-Z in lower case, and a space for what stands in no term."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in kept else 0x20 for b in range(256))


#: Terms of `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` and of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`; every character beyond ASCII belongs to terms, so bytes do.
WITH_DIGITS, LETTERS_ONLY = _table([*range(0x30, 0x3A), *_LETTERS]), _table(_LETTERS)


def terms(text: bytes | None, table: bytes) -> list[bytes]:
    """The terms of a whole text in order, with repeats; null has none."""
    return text.translate(table).split() if text else []
