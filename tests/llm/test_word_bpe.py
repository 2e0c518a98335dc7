import hashlib
import random
from functools import cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from matterloom.llm import word_bpe

from .helpers import frame, texts

PATH = P.path("word_bpe_49k.json")
#: Letters that change in kind or number under NFC or lower-casing, marks, and letters whose lower case depends on what stands around them.
ODD = "İıſẞßΣςἈᾳǅŉ" + "".join(map(chr, [*range(0x958, 0x960), *range(0xFB1D, 0xFB4F), 0x301, 0x307, 0x323, 0x93C, 0x1100, 0x1161, 0x11A8, 0x2126, 0x212B, 0x1F600, 0x2EBF0, 0x85, 0xA0, 0x200B, 0x3000]))


@cache
def library():
    return Tokenizer.from_file(PATH)


def expected(text):
    ids = library().encode(text or "", add_special_tokens=False).ids
    return ids, library().decode(ids, skip_special_tokens=False)


def test_digests_are_the_librarys(spark):
    values = [*texts(150), "a<|endoftext|>b <|startoftext|><|STARTOFTEXT|> <|endoftext|", "ODYSSEUS ΟΔΥΣΣΕΥΣ. İ, İstanbul!", "x" * 3000]
    got = {r.doc_id: r for r in word_bpe.word_bpe(frame(spark, values), PATH).collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        ids, text = expected(v)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), repr(v)


@pytest.mark.parametrize("kept", [3, word_bpe.KEPT])
def test_fuzzed_texts_whatever_is_remembered(monkeypatch, kept):
    monkeypatch.setattr(word_bpe, "KEPT", kept)
    r, code = random.Random(11), word_bpe.Coder(PATH)
    letters = ODD + "abcdefghijklmnop THE of 's't're 0123456789.,!?;:-_<|>\n\t'\x1c" * 2
    values = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(6000)]
    for at in range(0, len(values), 500):
        part = values[at : at + 500]
        ids, offsets = code.encode(pa.array(part))
        decoded = code.decode(ids, offsets)
        for k, coded in enumerate(library().encode_batch(part, add_special_tokens=False)):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == coded.ids, repr(part[k])
            assert decoded[k].decode() == library().decode(coded.ids, skip_special_tokens=False), repr(part[k])


def test_merges_are_those_of_a_plain_search():
    r, code = random.Random(3), word_bpe.Coder(PATH)

    def plain(ids):
        while pairs := [(code.merges[p], k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (p := a * code.size + b) in code.merges]:
            found, k = min(pairs)
            ids = [*ids[:k], code.made[found], *ids[k + 2 :]]
        return ids

    for letters in ("ab", "ae", "etaoin", "etaoinshrdlu"):
        for _ in range(100):
            ids = [code.vocab[c] for c in (r.choice(letters) for _ in range(r.randint(1, 60)))]
            assert code.merge(list(ids)) == plain(ids)


def test_very_long_words_and_texts(spark):
    r = random.Random(5)
    values = ["".join(r.choice("etaoinshr") for _ in range(200_000)), "ha" * 100_000, " ".join(r.choice(["the", "of", "Ωmega", "tion's"]) for _ in range(400_000))]
    got = {x.doc_id: x for x in word_bpe.word_bpe(frame(spark, values), PATH).collect()}
    for i, v in enumerate(values):
        ids, text = expected(v)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = word_bpe.word_bpe(frame(spark, ["a b", "a b"], [None, None]), PATH).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert word_bpe.word_bpe(frame(spark, ["a"]).limit(0), PATH).collect() == []
    out = word_bpe.encode_texts(frame(spark, ["Grüße, 世界", None]), PATH)
    first, second = sorted(out.collect(), key=lambda x: x.doc_id)
    assert (np.frombuffer(first.ids, "<u4").tolist(), first.decoded) == expected("Grüße, 世界")
    assert (bytes(second.ids), second.decoded) == (b"", "")
    again = word_bpe.decode_ids(out.withColumnRenamed("decoded", "was"), PATH).collect()
    assert all(x.was == x.decoded for x in again)
    assert word_bpe.decode_ids(spark.createDataFrame([(None,)], "ids binary"), PATH).collect()[0].decoded is None


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        word_bpe.Coder(P.path("byte_bpe_50k.json"))
