import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstream.functions import codec


def _frame(payload, kind=1, tier=1, version=1, flags=0, length=None, magic=bytes.fromhex(codec.MAGIC)):
    head = magic + bytes([version, kind, tier, flags]) + (len(payload) if length is None else length).to_bytes(4, "little")
    return head + zlib.crc32(head).to_bytes(4, "little") + payload + zlib.crc32(payload).to_bytes(4, "little")


def _verdicts(spark, frames):
    rows = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(frames)], "i long, f binary")
    return [r[1] for r in sorted(rows.select("i", codec.frame_verdict(F.col("f"))).collect())]


def test_golden_frame(spark):
    want = "5745495201010100050000006 6ad7d3c68656c6c6f86a61036".replace(" ", "").upper()
    got = spark.range(1).select(F.hex(codec.frame(F.lit(1), F.lit(1), F.lit(b"hello")))).first()[0]
    assert got == want == _frame(b"hello").hex().upper()


def test_each_damage_has_its_verdict(spark):
    good = _frame(b"payload")
    cases = {
        "ok": good,
        "TruncatedFrame": good[:-1],
        "TrailingBytes": good + b"\0",
        "BadMagic": b"X" + good[1:],
        "VersionMismatch": good[:4] + b"\2" + good[5:],
        "HeaderCrcMismatch": good[:8] + b"\1" + good[9:],
        "UnknownMessageType": _frame(b"payload", kind=9),
        "UnknownDurability": _frame(b"payload", tier=0),
        "ReservedFlagsSet": _frame(b"payload", flags=1),
        "PayloadTooLarge": _frame(b"payload", length=codec.MAX_PAYLOAD + 1),
        "PayloadCrcMismatch": good[:-1] + bytes([good[-1] ^ 1]),
    }
    assert _verdicts(spark, list(cases.values())) == list(cases)
    # order of checks: version before header CRC, durability before flags, cap before length
    assert _verdicts(spark, [good[:4] + b"\7\0\0\0" + good[8:], _frame(b"p", tier=0, flags=1), good[:2]]) == ["VersionMismatch", "UnknownDurability", "TruncatedFrame"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=20, max_size=40))
def test_any_bytes_get_a_verdict_and_frames_round_trip(spark, blobs):
    assert all(_verdicts(spark, blobs))
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i long, p binary")
    back = rows.select("i", "p", codec.frame(F.lit(1), F.lit(2), F.col("p")).alias("f"))
    out = back.select("p", codec.frame_verdict(F.col("f")).alias("v"), codec.frame_payload(F.col("f")).alias("q")).collect()
    assert all(r.v == "ok" and r.p == r.q for r in out)


def test_varint_bounds(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1]

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", codec.leb128(F.col("n")).alias("b")).collect()
    assert all(bytes(r.b) == varint(r.n) for r in rows)
