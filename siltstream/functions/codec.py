"""The checksummed frame format as column expressions: everything stays inside generated JVM code.

A frame is a 16-byte header (magic, version, message type, durability, flags, payload length, CRC-32 of the first 12
bytes; little-endian), the payload, and the payload's CRC-32.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the wire format.
MAGIC = "57454952"
VERSION = 1
HEADER_BYTES = 16
CRC_BYTES = 4
MAX_PAYLOAD = 16 * 1024 * 1024
MESSAGE_TYPES = {"push": 1, "ack": 2, "nack": 3, "health_check": 4, "health_check_response": 5}
DURABILITIES = {"sync": 1, "batched": 2, "buffered": 3}
NACK_REASONS = {
    "bad_magic": 1,
    "version_mismatch": 2,
    "bad_header_crc": 3,
    "payload_too_large": 4,
    "bad_payload_crc": 5,
    "internal_error": 6,
    "empty_payload": 7,
    "unknown_message": 8,
    "reserved_flags_set": 9,
}
#: Nack of each decode verdict; a truncated frame or trailing bytes have none.
VERDICT_NACK = {
    "BadMagic": "bad_magic",
    "VersionMismatch": "version_mismatch",
    "HeaderCrcMismatch": "bad_header_crc",
    "UnknownMessageType": "unknown_message",
    "UnknownDurability": "unknown_message",
    "ReservedFlagsSet": "reserved_flags_set",
    "PayloadTooLarge": "payload_too_large",
    "PayloadCrcMismatch": "bad_payload_crc",
}


def mapped(value: Column, table: dict[str, object]) -> Column:
    """A closed lookup; null for anything else."""
    out = F.lit(None)
    for key, to in table.items():
        out = F.when(value == key, F.lit(to)).otherwise(out)
    return out


def _swapped(hex_text: Column, n: int) -> Column:
    """Reverse the n byte pairs of a hex text; the text is named once, which keeps the generated code small."""
    if n == 1:
        return hex_text
    return F.regexp_replace(hex_text, rf"\A{'(..)' * n}\z", "".join(f"${i}" for i in range(n, 0, -1)))


def le_bytes(value: Column, n: int) -> Column:
    """The lowest n bytes of a non-negative number, little-endian."""
    return F.unhex(_swapped(F.lpad(F.hex(value.cast("long")), 2 * n, "0"), n))


def le_number(data: Column, at: Column | int, n: int) -> Column:
    """The unsigned little-endian number of n bytes from 1-based position ``at``; null if the data end before."""
    start = F.lit(at) if isinstance(at, int) else at
    # Byte by byte from the highest: nothing is computed twice, and no pattern has to be matched.
    digits = F.concat(*[F.hex(F.substring(data, start + i, F.lit(1))) for i in reversed(range(n))])
    return F.when(F.octet_length(data) >= start + (n - 1), F.conv(digits, 16, 10).cast("long"))


def header(message_type: Column, durability: Column, payload_len: Column) -> Column:
    """16 header bytes.  message_type, durability: their numbers."""
    body = F.concat(
        F.unhex(F.lit(MAGIC)), le_bytes(F.lit(VERSION), 1), le_bytes(message_type, 1), le_bytes(durability, 1), le_bytes(F.lit(0), 1), le_bytes(payload_len, 4)
    )
    return F.concat(body, le_bytes(F.crc32(body), 4))


def frame(message_type: Column, durability: Column, payload: Column) -> Column:
    return F.concat(header(message_type, durability, F.octet_length(payload)), payload, le_bytes(F.crc32(payload), 4))


def _header_checks(data: Column, checks: list[tuple[Column, str]]) -> list[tuple[Column, str]]:
    byte = lambda at: le_number(data, at, 1)
    return checks + [
        (F.hex(F.substring(data, 1, 4)) != MAGIC, "BadMagic"),
        (byte(5) != VERSION, "VersionMismatch"),
        (le_number(data, 13, 4) != F.crc32(F.substring(data, 1, 12)), "HeaderCrcMismatch"),
        (~byte(6).isin(*MESSAGE_TYPES.values()), "UnknownMessageType"),
        (~byte(7).isin(*DURABILITIES.values()), "UnknownDurability"),
        (byte(8) != 0, "ReservedFlagsSet"),
    ]


def _first(checks: list[tuple[Column, str]], otherwise: Column) -> Column:
    out = otherwise
    for condition, name in reversed(checks):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def header_verdict(data: Column) -> Column:
    """Verdict on the first 16 bytes, which must be there: 'ok' or what is wrong first."""
    return _first(_header_checks(data, []), F.lit("ok"))


def frame_verdict(data: Column, cap: int = MAX_PAYLOAD) -> Column:
    """Verdict on a whole buffer: header, then cap, exact length and payload CRC, in that order; never null."""
    size = F.octet_length(data)
    length = le_number(data, 9, 4)
    total = length + HEADER_BYTES + CRC_BYTES
    payload = F.substring(data, F.lit(HEADER_BYTES + 1), length.cast("int"))
    checks = [(size < HEADER_BYTES, "TruncatedFrame")]
    checks = _header_checks(data, checks) + [
        (length > cap, "PayloadTooLarge"),
        (size < total, "TruncatedFrame"),
        (size > total, "TrailingBytes"),
        (le_number(data, (length + HEADER_BYTES + 1).cast("int"), 4) != F.crc32(payload), "PayloadCrcMismatch"),
    ]
    return F.coalesce(_first(checks, F.lit("ok")), F.lit("TruncatedFrame"))


def frame_payload(data: Column) -> Column:
    """The payload of a frame whose verdict is ok."""
    return F.substring(data, F.lit(HEADER_BYTES + 1), le_number(data, 9, 4).cast("int"))


def verdict_nack(verdict: Column) -> Column:
    return mapped(verdict, VERDICT_NACK).cast("string")


def nack_payload(reason: Column) -> Column:
    """[reason], and for a version mismatch the supported version too; null for an unknown label."""
    number = mapped(reason, NACK_REASONS).cast("int")
    one = le_bytes(number, 1)
    return F.when(reason == "version_mismatch", F.concat(one, le_bytes(F.lit(VERSION), 1))).otherwise(one)


def fixed_reply(kind: str) -> Column:
    """The constant frame of an ack or a health check response."""
    return frame(F.lit(MESSAGE_TYPES[kind]), F.lit(DURABILITIES["sync"]), F.lit(b""))


def leb128(n: Column) -> Column:
    """Unsigned varint of a number below 2**28."""
    n = n.cast("long")
    byte = lambda shift, more: le_bytes(F.shiftright(n, shift).bitwiseAND(F.lit(127)) + (128 if more else 0), 1)
    return (
        F.when(n < 1 << 7, byte(0, False))
        .when(n < 1 << 14, F.concat(byte(0, True), byte(7, False)))
        .when(n < 1 << 21, F.concat(byte(0, True), byte(7, True), byte(14, False)))
        .otherwise(F.concat(byte(0, True), byte(7, True), byte(14, True), byte(21, False)))
    )


def row_binary(payload: Column) -> Column:
    """One record of a RowBinary insert body."""
    return F.concat(leb128(F.octet_length(payload)), payload)
