"""The CRC-32 of a string in DuckDB SQL, which has no function for it."""

from __future__ import annotations


def crc_table() -> str:
    """A table of one row with the 256 remainders, made from the polynomial."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: {step})) AS crc_of)"


def crc(text: str) -> str:
    """CRC-32 of an expression's UTF-8 bytes, in a query that also reads ``crc_table``."""
    octets = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: ('0x' || substring(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295)"
