import hashlib
import random
import zlib

import pytest

from larkspur.llm import audio


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 200_000])
def test_round_trip(n):
    text = random.Random(n).randbytes(n) if n != 5000 else b"\xff" * n
    media = audio.encode_bytes(text)
    payload, length = audio.decode_bytes(media)
    assert length == n and payload[:n] == text and set(payload[n:]) <= {255} and len(payload) % 576 == 0 and payload
    s = audio.parse(media)
    assert s.samples == len(payload) and s.rate == 16000 and s.skipped == 0 and s.wrong == 0
    assert s.table["frames"] == len(s.offsets) == s.checked == len(payload) // 576


def frame(index, fill=0, layer_rate=0xFB, mono=0xC0):
    h = bytes([255, layer_rate, index << 4, mono])
    return h + bytes([fill]) * (audio.header(h).bytes - 4)


def test_resynchronises_through_junk_and_bitrate_changes():
    tag = b"ID3\4\0\0\0\0\0\x0e" + b"TIT2\0\0\0\4\0\0\3abc"
    parts = [tag, b"junk\xff\xfbjunk", frame(9), frame(9), frame(5, 1), frame(12, 2), b"\xff\xff\0", frame(9, 3), frame(9, 4), b"TAG" + b"title".ljust(125, b"\0")]
    data = b"".join(parts)
    s = audio.parse(data)
    assert s.tags == {"TIT2": "abc"} and s.rate == 44100
    assert s.samples == 1152 * len(s.offsets)
    assert [data[o + 4] for o in s.offsets] in ([0, 0, 1, 3, 4], [0, 0, 1, 2, 3, 4])
    assert audio.parse(b"").samples == 0 and audio.parse(b"\xff" * 999).samples == 0


def test_damage_is_noticed():
    media = bytearray(audio.encode_bytes(b"x" * 3000))
    broken = media.copy()
    broken[-200] ^= 1
    with pytest.raises(ValueError):
        audio.decode_bytes(bytes(broken))
    start = int(audio.parse(bytes(media)).offsets[1])
    media[start + 4] ^= 1  # the stored checksum of a frame
    assert audio.parse(bytes(media)).wrong == 1


def test_column(spark):
    texts = [None, "", "é" * 300, "plain", "plain", "w " * 50_000]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id bigint, text string, media int")
    for r in audio.describe(audio.encode(df)).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.duration_samples == len(payload) and len(r.frame_offsets) == len(payload) // 576
    assert audio.describe(audio.encode(df.limit(0))).count() == 0
