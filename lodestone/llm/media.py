"""Audio columns: lossless 8-bit storage, and features as fixed-shape tensors with time spans.

A payload is stored as an 8-bit mono RIFF/WAVE file. Reading it back gives the samples, which go
through a polyphase resampler, overlapped log-mel filterbanks and a hysteresis energy segmentation.
Log-mel frames are cut into windows of a fixed shape, the last one padded with the floor, and stored
as Arrow fixed_shape_tensor values beside their time spans.

Edge cases: null and empty texts become one padded payload of spaces; sound without energy has no
segments; a stored value that is null or not such a file is an error, since it was written here; repeated rows
get equal values; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts_of

UNIT, PAD, TAIL = 192, b" ", 16
RATE, UP, DOWN, TAPS = 12_000, 2, 3, 24
FRAME, HOP, MELS, WINDOW_FRAMES, BLOCK_FRAMES = 256, 128, 16, 32, 4_096
FLOOR, ENTER_DB, LEAVE_DB, LEAST_FRAMES = 1e-6, 3.0, 1.0, 3


def payload_of(text: str) -> bytes:
    """The text's UTF-8 with spaces up to a positive multiple of UNIT."""
    data = text.encode("utf-8", "surrogatepass")
    return data + PAD * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples."""
    odd = len(samples) % 2
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples) + odd, b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * odd


def from_wave(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate; chunks other than fmt and data are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """A Hann-windowed sinc low-pass as `up` phases of `taps` taps, each phase of unit gain."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    h = np.sinc(n / max(up, down)) * np.hanning(up * taps + 2)[1:-1]
    h = h.reshape(taps, up).T
    return np.ascontiguousarray(h[:, ::-1] / h.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up / down: output k takes phase k * down mod up at input k * down // up."""
    bank, out = phases(up, down, taps), np.empty(-(-len(x) * up // down), np.float32)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for k in range(up):
        part = out[k::up]
        start = k * down // up
        part[:] = seen[start : start + down * len(part) : down][: len(part)] @ bank[k * down % up]
    return out


@lru_cache
def mel_bank(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangles that overlap by half, evenly spaced in mel, over the bins of a real transform."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """Frames by mels, in blocks of frames so that memory stays bounded; the tail is padded with zeros to a whole frame."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window, bank, out = np.hanning(FRAME).astype(np.float32), mel_bank(rate, FRAME, MELS), np.empty((n, MELS), np.float32)
    for at in range(0, n, BLOCK_FRAMES):
        spectrum = np.fft.rfft(frames[at : at + BLOCK_FRAMES] * window, axis=1)
        out[at : at + BLOCK_FRAMES] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + FLOOR)
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans of sound: one starts where the energy over its median passes ENTER_DB, and ends where it falls under LEAVE_DB."""
    energy = 10 / np.log(10) * np.logaddexp.reduce(mel, axis=1)
    above = energy - np.median(energy)
    marks = np.where(above >= ENTER_DB, 1, np.where(above < LEAVE_DB, 0, -1))
    marks[0] = max(marks[0], 0)
    last = np.maximum.accumulate(np.where(marks >= 0, np.arange(len(marks)), 0))
    on = np.concatenate([[0], marks[last], [0]])
    change = np.flatnonzero(np.diff(on))
    return [(int(a), int(b)) for a, b in zip(change[::2], change[1::2]) if b - a >= LEAST_FRAMES]


def features(samples: bytes, rate: int) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """Tensors (windows, WINDOW_FRAMES, MELS), their time spans in seconds, and the segments' time spans."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    slow = rate * UP / DOWN
    mel = log_mel(resample(x - x.mean() if len(x) else x), slow)
    windows = -(-len(mel) // WINDOW_FRAMES)
    tensors = np.full((windows * WINDOW_FRAMES, MELS), np.log(np.float32(FLOOR)), np.float32)
    tensors[: len(mel)] = mel
    step, at = HOP / slow, np.arange(windows) * WINDOW_FRAMES
    spans = np.stack([at * step, (np.minimum(at + WINDOW_FRAMES, len(mel)) - 1) * step + FRAME / slow], 1)
    return tensors.reshape(windows, WINDOW_FRAMES, MELS), spans, [(a * step, (b - 1) * step + FRAME / slow) for a, b in segments(mel)]


def tensor_stream(tensors: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow stream with columns tensor (fixed_shape_tensor), start_s and end_s."""
    batch = pa.record_batch([pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors)), pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["tensor", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What tensor_stream() wrote: tensors and time spans."""
    got = pa.ipc.open_stream(stream).read_all().combine_chunks()
    tensor = got.column("tensor").chunk(0).to_numpy_ndarray()
    return tensor, np.stack([got.column("start_s").to_numpy(), got.column("end_s").to_numpy()], 1)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = texts_of(b, "text")
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([to_wave(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def analyse(stored: DataFrame) -> DataFrame:
    """stored (doc_id, n_bytes, media) with payload (read back), tensors (an Arrow stream) and segments."""
    kind = dict(stored.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", most_bytes=2 << 20, most_rows=512):
            payloads, streams, spans = [], [], []
            for media in b.column("media").to_pylist():
                samples, rate = from_wave(media)
                tensors, at, found = features(samples, rate)
                payloads.append(samples)
                streams.append(tensor_stream(tensors, at))
                spans.append([{"start_s": s, "end_s": e} for s, e in found])
            extra = [pa.array(payloads, pa.binary()), pa.array(streams, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])))]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "n_bytes", "media")), *extra], ["doc_id", "n_bytes", "media", "payload", "tensors", "segments"])

    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, tensors binary, segments array<struct<start_s:double,end_s:double>>")


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyse(store(table(spark, sf_dir, "documents")))
    tail = F.substring("payload", -TAIL, TAIL)
    feature = F.concat_ws(":", F.substring(F.sha2("tensors", 256), 1, 32), F.size("segments"), F.round(F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["end_s"] - x["start_s"]), 3))
    return found.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


QUERIES = {"op6_audio_features": op6_audio_features}
ORACLES: dict[str, str] = {}
