"""Audio features of media columns.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, are 8-bit samples at 16 kHz, stored losslessly as WAV
bytes in a binary column. Features are made of the stored bytes read back:

* polyphase resampling by 2/3: each output phase is a short filter over every third sample, so nothing is computed at the
  common rate;
* log-mel filterbanks of 256-sample frames that overlap by half, as fixed-shape tensors of 48 frames x 16 bands in 16-bit
  floats (the last one padded with the floor), each with its time span;
* energy segments with hysteresis: a segment begins with a frame 1.5 dB above the text's mean level and ends with the first
  below the mean.

All steps are arrays over slices of a batch; texts are parted by silence that the filters can't reach across, so a text's
values depend on its bytes only. Spark has no tensor type, so a document's tensors are a binary column of Arrow data (an IPC stream of
start, stop and mel, the last of Arrow's fixed-shape tensor type); ``tensors`` reads them, and the query takes its number of tensors
and their last time from what it has read back.

Defined cases: null and empty texts are 576 samples of 255; equal texts get equal values; a null doc_id stays null; repeated
rows are computed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, saved
from ._encode import expand, pieces_of

UNIT, PAD, RATE = 576, 255, 16_000
UP, DOWN, TAPS = 2, 3, 16
FRAME, HOP, BANDS, LENGTH = 256, 128, 16, 48
ON_DB, OFF_DB, FLOOR = 1.5, 0.0, 1e-10
OUT_RATE = RATE * UP / DOWN
MEDIA = "doc_id bigint, n_bytes bigint, wav binary"
FEATURES = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "frames int, mel binary, segments array<struct<start:double,stop:double>>"
)


def wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(data: bytes) -> bytes:
    """The samples of a WAV file."""
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return b""


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, wav), saved."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces_of(b, "text")):
            n, out = [], []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                n.append(len(raw))
                out.append(wav(raw + bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "wav"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return saved(rows.mapInArrow(store, MEDIA), "media")


def prototype() -> np.ndarray:
    """Low-pass filter at the common rate, by output phase: (UP, TAPS)."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(UP * TAPS)
    return (h * UP / h.sum()).reshape(TAPS, UP).T


def resample(x: np.ndarray) -> np.ndarray:
    """x (a multiple of 3 long) at 2/3 of its rate."""
    h = prototype()
    groups = len(x) // DOWN
    padded = np.concatenate((np.zeros(TAPS), x, np.zeros(TAPS)))
    out = np.zeros((groups, UP))
    for phase in range(UP):
        shift = phase * DOWN // UP + TAPS // 2
        tap0 = phase * DOWN % UP
        for k in range(TAPS):
            start = TAPS + shift - k
            out[:, phase] += h[tap0, k] * padded[start : start + DOWN * groups : DOWN]
    return out.ravel()


def filterbank() -> np.ndarray:
    """Triangular mel filters: (bins, BANDS)."""
    bins = np.fft.rfftfreq(FRAME, 1 / OUT_RATE)
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + OUT_RATE / 2 / 700), BANDS + 2) / 2595) - 1)
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


TENSOR = pa.fixed_shape_tensor(pa.float16(), [LENGTH, BANDS])
STORED = pa.schema([("start", pa.float64()), ("stop", pa.float64()), ("mel", TENSOR)])


def packed(block: np.ndarray, start: np.ndarray, stop: np.ndarray) -> bytes:
    """Tensors and their time spans as an Arrow IPC stream."""
    storage = pa.FixedSizeListArray.from_arrays(pa.array(block.ravel(), pa.float16()), LENGTH * BANDS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STORED) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(start), pa.array(stop), pa.ExtensionArray.from_storage(TENSOR, storage)], schema=STORED))
    return sink.getvalue().to_pybytes()


def hysteresis(level: np.ndarray, first: np.ndarray, on: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each frame is in a segment; a text begins outside one."""
    turn = np.where(level >= on, 1, np.where(level < off, 0, -1))
    turn[first[turn[first] < 0]] = 0
    last = np.maximum.accumulate(np.where(turn >= 0, np.arange(len(turn)), 0))
    return turn[last] == 1


def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bank, window = filterbank(), np.hanning(FRAME)
    for batch in (x for b in batches for x in slices(b)):
        files = [x.as_buffer().to_pybytes() for x in batch.column("wav")]
        payloads = [samples(x) for x in files]
        size = np.fromiter(map(len, payloads), np.int64, len(payloads))
        frames = size * UP // DOWN // HOP
        start = np.cumsum(size + UNIT) - size - UNIT
        x = np.zeros(int((size + UNIT).sum()))
        raw = (np.frombuffer(b"".join(payloads), np.uint8).astype(float) - 128) / 128
        x[expand(start, size)] = raw
        y = resample(x)
        view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        cut = view[expand(start * UP // DOWN // HOP, frames)]
        first = np.cumsum(frames) - frames
        energy = np.einsum("ij,ij->i", cut, cut) / FRAME
        level = 10 * np.log10(energy + FLOOR)
        power = np.abs(np.fft.rfft(cut * window, axis=1)) ** 2
        mel = np.log(power @ bank + FLOOR)
        mean = np.add.reduceat(level, first) / frames
        whose = np.repeat(np.arange(len(size)), frames)
        inside = hysteresis(level, first, mean[whose] + ON_DB, mean[whose] + OFF_DB)
        bands = np.add.reduceat(mel, first, axis=0) / frames[:, None]
        half = mel.astype(np.float16)
        rows = {k: [] for k in ("sha", "crc", "msha", "text", "mel", "segments")}
        for i, (a, n) in enumerate(zip(first.tolist(), frames.tolist(), strict=True)):
            count = -(-n // LENGTH)
            block = np.full((count * LENGTH, BANDS), np.log(FLOOR), np.float16)
            block[:n] = half[a : a + n]
            edge = np.diff(np.concatenate(([0], inside[a : a + n].astype(np.int8), [0])))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            step = HOP / OUT_RATE
            rows["sha"].append(hashlib.sha256(payloads[i]).hexdigest())
            rows["crc"].append(zlib.crc32(payloads[i][-32:]))
            rows["msha"].append(hashlib.sha256(files[i]).hexdigest())
            rows["text"].append(f"frames={n};segments={len(begin)};active={int((end - begin).sum())};level={mean[i] + 0.0:.1f};mel=" + ",".join(f"{v + 0.0:.1f}" for v in bands[i]))
            times = np.arange(count + 1) * LENGTH
            rows["mel"].append(packed(block, times[:-1] * step, np.minimum(times[1:], n) * step))
            rows["segments"].append([{"start": p * step, "stop": q * step} for p, q in zip(begin.tolist(), end.tolist(), strict=True)])
        span = pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array(size), pa.array(rows["sha"]), pa.array(rows["crc"], pa.int64()), pa.array([len(x) for x in files], pa.int64()),
                pa.array(rows["msha"]), pa.array(rows["text"]), pa.array(frames.astype(np.int32)), pa.array(rows["mel"], pa.binary()), pa.array(rows["segments"], span),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "mel", "segments"],
        )
        release()


def slices(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of media."""
    data = batch.column("wav")
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    at = 0
    while at < len(batch):
        take = max(1, int(np.searchsorted(ends, int(ends[at]) + size)) - at)
        yield batch.slice(at, take)
        at += take


def features(docs: DataFrame) -> DataFrame:
    """Per document the stored form's figures, a summary, tensors and spans (``FEATURES``), saved."""
    return saved(media(docs).mapInArrow(compute, FEATURES), "features")


def tensors(data: bytes | pa.Buffer) -> pa.Table:
    """start, stop and mel (Arrow fixed-shape tensors, LENGTH x BANDS) of a stored document."""
    return pa.ipc.open_stream(data).read_all()


def digests(docs: DataFrame) -> DataFrame:
    """The figures without the arrays: FEATURES up to feature, n_segments, and n_tensors and seconds from the stored tensors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = [tensors(x.as_buffer()) for x in batch.column("mel")]
            made = [pa.array([x.num_rows for x in stored], pa.int64()), pa.array([x.column("stop")[-1].as_py() if len(x) else 0.0 for x in stored], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "n_tensors", "seconds"])

    kept = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_segments"]
    rows = features(docs).select(*kept[:-1], F.size("segments").alias("n_segments"), "mel")
    return rows.mapInArrow(read, FEATURES[: FEATURES.index(", frames")] + ", n_segments int, n_tensors bigint, seconds double")
