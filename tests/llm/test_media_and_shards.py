import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from matterloom.llm import audio_features as audio
from matterloom.llm import sharding

from .helpers import frame, texts


def test_digests_against_the_texts(spark):
    values = texts()
    got = {r.doc_id: r for r in audio.audio_features(frame(spark, values)).collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        raw = (v or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_bytes == 44 + len(data)
    assert got[5].feature == got[6].feature != got[7].feature
    assert audio.audio_features(frame(spark, ["a"]).limit(0)).collect() == []


def test_resampling_is_a_plain_convolution():
    x = np.random.default_rng(1).normal(size=501)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        phases = audio.polyphase(up, down)
        taps = phases[:, ::-1].T.reshape(-1)
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        full = np.convolve(stuffed, taps)
        delay = (2 * 8 * max(up, down) + 1) // 2
        want = full[delay::down][:200]
        np.testing.assert_allclose(audio.resample(x, 0, 200, up, down), want, atol=1e-12)
        np.testing.assert_allclose(audio.resample(x, 37, 100, up, down), want[37:137], atol=1e-12)


def test_a_tone_keeps_its_band_and_blocks_do_not_matter(monkeypatch):
    t = np.arange(60_000) / audio.RATE
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    mels, levels = audio.log_mel(tone)
    centre = np.argmax(audio.mel_bank(audio.RATE // 2)[round(1000 / 8000 * 256)])
    assert (mels[2:-2].argmax(1) == centre).all() and len(mels) == 1 + -(-(30_000 - 256) // 128)
    monkeypatch.setattr(audio, "BLOCK", 7)
    again = audio.log_mel(tone)
    np.testing.assert_allclose(again[0], mels, atol=0.011)
    np.testing.assert_allclose(again[1], levels, atol=0.011)


def test_segments_have_hysteresis():
    assert audio.segments(np.array([-20, -5, -8, 0, -11, -13, -8, -20, -3.0])) == [(1, 5), (8, 9)]


def test_tensors_and_spans(spark):
    tensors, spans = audio.features(bytes(range(256)) * 400)
    stream = audio.tensor_stream(tensors, spans)
    column = pa.ipc.open_stream(stream).read_all().column("tensor")
    assert column.type.shape == [audio.FRAMES, audio.MELS] and len(column) == len(spans)
    again = audio.read_tensors(stream)
    assert (again[0] == tensors).all() and (again[1] == spans).all()
    assert (spans[:, 1] > spans[:, 0]).all() and (np.diff(spans[:, 0]) > 0).all()
    rows = audio.pieces(audio.extract(audio.store(frame(spark, ["abc " * 5000, None])))).collect()
    assert {len(r.tensor) for r in rows} == {audio.FRAMES * audio.MELS} and {r.doc_id for r in rows} == {0, 1}


def plain_features(data):
    """The features by their definitions, one frame and one output sample at a time."""
    x = np.frombuffer(data, np.uint8).astype(float) / 128 - 1
    t = np.arange(33) - 16
    taps = 0.5 * np.sinc(t / 2) * np.hamming(33)
    frames = max(1, 1 + -(-(-(-len(x) // 2) - 256) // 128))
    y = np.array([sum(taps[k] * x[2 * i + 16 - k] for k in range(33) if 0 <= 2 * i + 16 - k < len(x)) for i in range(frames * 128 + 256)])
    bank, rows, levels = audio.mel_bank(8000), [], []
    for f in range(frames):
        cut = y[f * 128 : f * 128 + 256]
        bins = np.array([abs(sum(cut * np.hanning(256) * np.exp(-2j * np.pi * b * np.arange(256) / 256))) ** 2 for b in range(129)])
        rows.append(np.log(bins @ bank + 1e-6))
        levels.append(10 * np.log10((cut**2).mean() + 1e-9))
    on, kept = False, []
    for f, level in enumerate(np.round(levels, 2)):
        level -= np.round(max(levels), 2)
        on = level >= audio.ENTER_DB or on and level >= audio.LEAVE_DB
        kept += [f] if on else []
    return np.array(rows)[kept], kept


def test_features_against_their_definitions():
    for text in (b"some words of a short recording, louder AT the end ~~~~", bytes(range(256)) * 5, b"\x80" * 900 + b"loud \xff\x00\xff\x00" * 40):
        data = audio.payload(text)
        tensors, spans = audio.features(data)
        want, kept = plain_features(data)
        got = np.concatenate([x[: round((b - a) * 8000 - 256) // 128 + 1] for x, (a, b) in zip(tensors, spans, strict=True)])
        np.testing.assert_allclose(got, want, atol=0.011)
        assert spans[0][0] == kept[0] * 128 / 8000 and spans[-1][1] == pytest.approx((kept[-1] * 128 + 256) / 8000)


def test_table_is_even_and_keeps_most_slots_when_a_shard_goes():
    names = tuple(f"s{i}" for i in range(10))
    table = np.array(sharding.fill(names, 1009))
    assert set(np.bincount(table).tolist()) <= {100, 101}
    less = np.array(sharding.fill(names[:3] + names[4:], 1009))
    less = np.where(less >= 3, less + 1, less)
    kept = (less == table)[table != 3].mean()
    assert kept > 0.75
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_placement(spark):
    docs = frame(spark, ["a", "b", None, "d"], [1, 1, None, 4]).withColumn("shard", sharding.F.lit("old"))
    rows = sharding.place(docs).collect()
    table = sharding.fill()
    for r in rows:
        h = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16)
        assert (r.slot, r.shard) == (h % sharding.SIZE, sharding.SHARDS[table[h % sharding.SIZE]])
    assert len(rows) == 4 and sharding.place(docs.limit(0)).count() == 0
