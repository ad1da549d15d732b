import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import media

from .support import documents, empty


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400))
def test_wave_round_trip(samples):
    assert media.from_wave(media.to_wave(samples)) == (samples, media.RATE)


def test_wave_is_readable_elsewhere():
    import io
    import wave

    with wave.open(io.BytesIO(media.to_wave(b"abcdef"))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(6)) == (1, 1, media.RATE, b"abcdef")
    for bad in (b"", b"RIFF0000WAVE", b"nothing at all"):
        with pytest.raises(ValueError):
            media.from_wave(bad)


def test_resampling_equals_the_direct_sum_and_keeps_a_tone():
    rng = np.random.default_rng(2)
    x = rng.normal(size=96).astype(np.float32)
    bank, taps = media.phases(media.UP, media.DOWN, media.TAPS), media.TAPS
    padded = np.concatenate([np.zeros(taps // 2), x, np.zeros(taps)])
    direct = [padded[k * media.DOWN // media.UP :][:taps] @ bank[k * media.DOWN % media.UP] for k in range(64)]
    assert np.allclose(media.resample(x), direct, atol=1e-5)
    t = np.arange(6000) / media.RATE
    tone = np.sin(2 * np.pi * 500 * t).astype(np.float32)
    slow = media.resample(tone)
    expected = np.sin(2 * np.pi * 500 * np.arange(len(slow)) * media.DOWN / media.UP / media.RATE)
    lag = max(range(-3, 4), key=lambda d: np.dot(slow[100:-100], np.roll(expected, d)[100:-100]))
    assert np.corrcoef(slow[100:-100], np.roll(expected, lag)[100:-100])[0, 1] > 0.98


def test_blocks_of_frames_change_nothing(monkeypatch):
    x = np.random.default_rng(5).normal(size=20_000).astype(np.float32)
    whole = media.log_mel(x, 8000.0)
    monkeypatch.setattr(media, "BLOCK_FRAMES", 7)
    assert np.allclose(media.log_mel(x, 8000.0), whole, atol=1e-4)


def test_segments_follow_hysteresis():
    level = np.full((60, media.MELS), -5.0, np.float32)
    level[20:30] += 3
    level[30:35] += 0.3
    found = media.segments(level)
    assert found == [(20, 35)]
    assert media.segments(np.zeros((5, media.MELS), np.float32)) == []


def test_features_and_tensors():
    sound = (128 + 100 * np.sin(np.arange(30_000) / 3)).astype(np.uint8).tobytes()
    tensors, spans, _ = media.features(sound, media.RATE)
    assert tensors.shape[1:] == (media.WINDOW_FRAMES, media.MELS) and len(spans) == len(tensors)
    assert spans[0, 0] == 0 and (spans[:, 1] > spans[:, 0]).all()
    back, at = media.read_tensors(media.tensor_stream(tensors, spans))
    assert np.array_equal(back, tensors) and np.array_equal(at, spans)


def test_odd_rows(spark):
    docs = documents(spark)
    out = media.analyse(media.store(docs)).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(out) == 10
    for r in out:
        data = texts[r["doc_id"]]
        assert r["n_bytes"] == len(data) and len(r["payload"]) % 192 == 0 and len(r["payload"]) >= 192
        assert bytes(r["payload"]).rstrip(b" ") == data.rstrip(b" ") and bytes(r["payload"])[: len(data)] == data
    assert media.analyse(media.store(empty(spark))).count() == 0


def test_query_digests(spark):
    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in media.op6_audio_features(spark, path).collect():
        data = texts[r["doc_id"]].encode()
        data += b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        wave = media.to_wave(data)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(wave), hashlib.sha256(wave).hexdigest()) and r["feature"]
