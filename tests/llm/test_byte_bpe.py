import hashlib
import random
from functools import cache

import numpy as np
import public_tokenizers as P
import tiktoken

from matterloom.llm import byte_bpe

from .helpers import frame, texts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@cache
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def test_digests_are_the_librarys(spark):
    values, code = texts(150), library()
    got = {r.doc_id: r for r in byte_bpe.byte_bpe(frame(spark, values), PATH, P.PATTERN).collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        ids = code.encode_ordinary(v or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((v or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, repr(v)


def test_memory_of_words_is_bounded_and_does_not_matter(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    monkeypatch.setattr(byte_bpe, "GROUP", 40)
    code, values = byte_bpe.Coder(PATH, P.PATTERN), [t or "" for t in texts(40, 3)]
    for _ in range(2):
        for at in range(0, len(values), 9):
            part = values[at : at + 9]
            ids = code.encode(part)
            assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library().encode_ordinary(t) for t in part]
            assert code.decode(ids) == [t.encode() for t in part]


def test_windows_of_long_words(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(byte_bpe, "WIDE", 24)
    monkeypatch.setattr(byte_bpe, "OVER", 8)
    code = byte_bpe.Coder(PATH, P.PATTERN)
    for letters in ("ab", "abc", "etaoin", "etaoinshrdluöé", "漢字世界"):
        words = ["".join(r.choice(letters) for _ in range(r.randint(20, 400))) for _ in range(40)]
        for w, ids in zip(words, code.encode(words), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library().encode_ordinary(w), w
    assert np.frombuffer(code.encode(["x" * 999])[0], "<u4").tolist() == library().encode_ordinary("x" * 999)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = byte_bpe.byte_bpe(frame(spark, ["a b", "a b"], [None, None]), PATH, P.PATTERN).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert byte_bpe.byte_bpe(frame(spark, ["a"]).limit(0), PATH, P.PATTERN).collect() == []
    out = byte_bpe.encode_texts(frame(spark, ["Grüße, 世界"]), PATH, P.PATTERN).collect()[0]
    assert bytes(out.decoded).decode() == "Grüße, 世界"
