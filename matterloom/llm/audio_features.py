"""Media columns: audio features of 8-bit recordings.

A payload of bytes is stored losslessly as a WAV file of unsigned 8-bit samples (one byte a sample). The stored
bytes are read back and turned into features: polyphase resampling, overlapped log-mel filterbanks, and speech-like
segments by hysteresis on frame energy. Features are stored as an Arrow stream for each recording, whose column
``tensor`` has Arrow's fixed-shape tensor type, ``FRAMES x MELS`` float32, beside the time span of each piece
(``start_s``, ``end_s``); they are read back too before anything is told of them.

Everything happens inside one task per batch of rows, in blocks of samples, so memory does not grow with a recording
beyond the recording itself; nothing is shuffled.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal values, however they are
batched; repeated rows and null doc_ids keep one result row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, utf8, written

RATE = 16_000
UP, DOWN = 1, 2
WINDOW, HOP = 256, 128
MELS, FRAMES = 24, 64
#: A segment starts where a frame's level is above the first and lasts until it is below the second (dB under the recording's loudest frame).
ENTER_DB, LEAVE_DB = -6.0, -12.0
PAD = 64
BLOCK = 2048


def payload(text: bytes) -> bytes:
    """``text`` and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % PAD or (0 if text else PAD))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; an odd number of bytes gets the pad byte that RIFF asks for."""
    odd = len(samples) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(samples) + odd) + b"WAVE"
    form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + form + b"data" + struct.pack("<I", len(samples)) + samples + bytes(odd)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file as :func:`to_wav` makes it, whatever other chunks stand in it."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@cache
def polyphase(up: int = UP, down: int = DOWN, half: int = 8) -> np.ndarray:
    """Rows: the taps of each of the ``up`` phases of a windowed-sinc low-pass filter."""
    n = 2 * half * max(up, down) + 1
    t = np.arange(n) - n // 2
    cut = 1 / max(up, down)
    taps = up * cut * np.sinc(cut * t) * np.hamming(n)
    taps = np.pad(taps, (0, -n % up))
    return taps.reshape(-1, up).T[:, ::-1].copy()


def resample(x: np.ndarray, first: int, count: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Samples ``first`` to ``first + count`` of ``x`` at ``up / down`` times its rate; zeros stand before and after ``x``."""
    phases = polyphase(up, down)
    width = phases.shape[1]
    delay = (2 * 8 * max(up, down) + 1) // 2
    n = np.arange(first, first + count) * down + delay
    last, phase = n // up, n % up
    out = np.zeros(count)
    for p in range(up):
        mine = phase == p
        if not mine.any():
            continue
        ends = last[mine]
        lo, hi = int(ends[0]) - width + 1, int(ends[-1]) + 1
        part = np.zeros(hi - lo)
        a, b = max(lo, 0), min(hi, len(x))
        if a < b:
            part[a - lo : b - lo] = x[a:b]
        rows = np.lib.stride_tricks.sliding_window_view(part, width)[ends - int(ends[0])]
        out[mine] = rows @ phases[p]
    return out


@cache
def mel_bank(rate: int, mels: int = MELS, window: int = WINDOW) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, over the bins of the real spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(window // 2 + 1) * rate / window
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def log_mel(samples: bytes, rate: int = RATE, up: int = UP, down: int = DOWN) -> tuple[np.ndarray, np.ndarray]:
    """Per frame: log-mel energies, and the level in dB. Frames overlap by half, and the last is filled up with zeros, so that
    every sample is in one; a short recording has one."""
    x = np.frombuffer(samples, np.uint8)
    length = -(-len(x) * up // down)
    frames = max(1, 1 - (WINDOW - length) // HOP)
    bank, shape = mel_bank(rate * up // down), np.hanning(WINDOW)
    mels, levels = np.empty((frames, MELS), np.float32), np.empty(frames)
    for at in range(0, frames, BLOCK):
        n = min(BLOCK, frames - at)
        lo, hi = at * HOP * down // up, ((at + n) * HOP + WINDOW) * down // up
        pad = polyphase(up, down).shape[1] + 2
        lo = max(0, lo - pad) // down * down
        near = x[lo : hi + pad].astype(np.float64) - 128.0
        y = resample(near / 128.0, at * HOP - lo * up // down, (n - 1) * HOP + WINDOW, up, down)
        cut = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(cut * shape, axis=1)) ** 2
        mels[at : at + n] = np.round(np.log(power @ bank + 1e-6), 2)
        levels[at : at + n] = np.round(10 * np.log10((cut**2).mean(1) + 1e-9), 2)
    return mels, levels


def segments(levels: np.ndarray, enter: float = ENTER_DB, leave: float = LEAVE_DB) -> list[tuple[int, int]]:
    """Runs of frames that begin above ``enter`` and last until below ``leave``, relative to the loudest frame."""
    level = levels - levels.max()
    # Between the thresholds the state before goes on: carry the last decisive frame forward.
    state = np.where(level >= enter, 1, np.where(level < leave, 0, -1))
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), 0))
    on = np.r_[0, state[at] == 1, 0].astype(np.int8)
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Tensors of ``FRAMES x MELS`` (float32) and their time spans in seconds. Each segment is cut into pieces of
    ``FRAMES`` frames; the last is filled up with its floor value, and its span ends where the segment does."""
    mels, levels = log_mel(samples, rate)
    step = HOP * DOWN / (rate * UP)
    pieces = [(a, min(a + FRAMES, e)) for s, e in segments(levels) for a in range(s, e, FRAMES)]
    tensors = np.full((len(pieces), FRAMES, MELS), np.float32(np.log(1e-6)), np.float32)
    for k, (a, b) in enumerate(pieces):
        tensors[k, : b - a] = mels[a:b]
    spans = np.array([(a * step, (b - 1) * step + WINDOW * DOWN / (rate * UP)) for a, b in pieces], np.float64).reshape(-1, 2)
    return tensors, spans


TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
STREAM = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", TENSOR)])


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's payload as a WAV file."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = utf8(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(payload(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, f"doc_id {id_type}, n_bytes long, media binary")


def tensor_stream(tensors: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow stream of one batch: tensors and their time spans."""
    storage = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(tensors).reshape(-1)), FRAMES * MELS)
    batch = pa.record_batch([pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.ExtensionArray.from_storage(TENSOR, storage)], STREAM)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STREAM) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The tensors and spans of :func:`tensor_stream`."""
    batch = pa.ipc.open_stream(stream).read_next_batch()
    tensor = batch.column("tensor")
    shape = (len(tensor), *tensor.type.shape)
    return tensor.storage.flatten().to_numpy().reshape(shape), np.stack([batch.column("start_s").to_numpy(), batch.column("end_s").to_numpy()], 1)


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def extract(stored: DataFrame) -> DataFrame:
    """(doc_id, digests of the stored bytes, n_pieces, tensors): every recording's features as an Arrow stream."""
    id_type = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for cell in batch.column("media"):
                media = cell.as_py()
                data, rate = from_wav(media)
                tensors, spans = features(data, rate)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), len(spans), tensor_stream(tensors, spans)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_pieces", "tensors"]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return stored.mapInArrow(run, f"doc_id {id_type}, {DIGESTS}, n_pieces int, tensors binary")


def pieces(extracted: DataFrame) -> DataFrame:
    """(doc_id, piece, start_s, end_s, tensor): one row for each fixed-shape piece; ``tensor`` is row-major ``FRAMES x MELS``."""
    id_type = extracted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, stream in enumerate(batch.column("tensors")):
                tensors, spans = read_tensors(stream.as_py())
                n = len(spans)
                if n:
                    rows = pa.ListArray.from_arrays(np.arange(n + 1) * FRAMES * MELS, pa.array(tensors.reshape(-1)))
                    yield pa.record_batch([batch.column("doc_id").take(pa.array([i] * n)), pa.array(range(n), pa.int32()), pa.array(spans[:, 0]), pa.array(spans[:, 1]), rows], ["doc_id", "piece", "start_s", "end_s", "tensor"])

    return extracted.select("doc_id", "tensors").mapInArrow(run, f"doc_id {id_type}, piece int, start_s double, end_s double, tensor array<float>")


def digests(extracted: DataFrame) -> DataFrame:
    """The digest columns of every recording; ``feature`` is taken from the tensors and spans that are read back."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    id_type = extracted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tensors"):
            told = []
            for cell in batch.column("tensors"):
                tensors, spans = read_tensors(cell.as_py())
                feature = hashlib.sha256(np.ascontiguousarray(tensors, "<f4").tobytes())
                feature.update(np.ascontiguousarray(spans, "<f8").tobytes())
                told.append(f"{len(spans)}:{feature.hexdigest()}")
            yield pa.record_batch([*(batch.column(c) for c in ["doc_id", *names]), pa.array(told, pa.string())], ["doc_id", *names, "feature"])

    return extracted.drop("n_pieces").mapInArrow(run, f"doc_id {id_type}, {DIGESTS}, feature string")


def audio_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text's payload in the shared folder, read it back, store its tensors, and return digests of what is read back from both."""
    media = written(store(docs, doc_id, text), "media")
    tensors = written(extract(media), "tensors")
    drop(media)
    return digests(tensors)
