import json
from pathlib import Path

import pytest

from lumenscan.functions import lms
from lumenscan.streaming.assignments import scan_to, text_stream


def test_lms_signatures_hold_and_break(spark):
    key = lms.LmsKey(5)
    rows = []
    for i in range(3):
        m = f"message {i}".encode()
        s = key.sign(m)
        assert lms.lms_verify(key.public, m, s) and not lms.lms_verify(key.public, m + b"!", s) and not lms.lms_verify(key.public, m, s[:-1])
        assert lms.hss_verify(b"\0\0\0\1" + key.public, m, b"\0\0\0\0" + s)
        rows += [(bytearray(key.public), bytearray(m), bytearray(s)), (bytearray(key.public), bytearray(m), bytearray(s[::-1])), (None, bytearray(m), bytearray(s))]
    df = spark.createDataFrame(rows, "p binary, m binary, s binary")
    assert [r[0] for r in df.select(lms.verified("p", "m", "s")).collect()] == [True, False, None] * 3
    low = lms.LmsKey(5)
    s = low.sign(b"x")
    assert lms.hss_verify(b"\0\0\0\2" + key.public, b"x", b"\0\0\0\1" + key.sign(low.public) + low.public + s)


def test_scan_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 'x signing_key = "9f8e7d6c5b4a" y'), ("b", "none")], "rel string, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        scan_to(text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [(r.file, r.name, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "signing_key", "9f8e7d6c5b4a")]


VECTORS = json.loads((Path(__file__).parent / "vectors" / "lms.json").read_text())


@pytest.mark.parametrize("v", VECTORS, ids=[v["case"] for v in VECTORS])
def test_vectors_of_the_rfcs(v):
    key, message, sig = (bytes.fromhex(v[x]) for x in ("pk", "m", "sig"))
    assert lms.hss_verify(key, message, sig)
    for at in range(0, len(sig), 97):
        assert not lms.hss_verify(key, message, sig[:at] + bytes((sig[at] ^ 1,)) + sig[at + 1 :])
    assert not lms.hss_verify(key, message + b"x", sig) and not lms.hss_verify(key, message, sig[:-1])


def test_lms_state_is_on_disk_first(tmp_path):
    key = lms.LmsKey.create(tmp_path / "lms.json", 5)
    first = key.sign(b"a")
    again = lms.LmsKey.load(tmp_path / "lms.json")
    second = again.sign(b"b")
    third = key.sign(b"c")
    assert [int.from_bytes(s[:4], "big") for s in (first, second, third)] == [0, 1, 2]
    assert all(lms.lms_verify(key.public, m, s) for m, s in ((b"a", first), (b"b", second), (b"c", third)))
    again.advance(32)
    with pytest.raises(ValueError):
        key.sign(b"d")
