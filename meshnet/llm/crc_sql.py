"""CRC-32 in DuckDB's SQL, which has no function of that name."""

from __future__ import annotations

#: The rule of the table: eight steps of the reflected polynomial for each byte.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
_TABLE = f"list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: {_STEP}))"


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of ASCII text, as Spark's ``crc32`` gives it."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)]))"
    return f"(SELECT xor({fold}, 4294967295::BIGINT) FROM (SELECT {_TABLE} AS crc_table))"
