"""Words of a text: A-Z lower-cased, runs of a-z, 0-9 and everything beyond ASCII."""

from __future__ import annotations

import pyarrow as pa

#: Bytes of UTF-8: letters and digits stay, A-Z become a-z, all else becomes a blank.
WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def as_bytes(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column, without copying."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
