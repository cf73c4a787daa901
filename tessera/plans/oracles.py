"""Parts of DuckDB SQL that several modules of plans use."""

from __future__ import annotations

_HMAC = "sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({text}))))"


def hmac_sql(key: bytes, text: str) -> str:
    padded = key.ljust(64, b"\0")
    return _HMAC.format(outer=bytes(b ^ 0x5C for b in padded).hex(), inner=bytes(b ^ 0x36 for b in padded).hex(), text=text)
