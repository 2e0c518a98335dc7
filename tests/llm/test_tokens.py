import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matterloom.llm import token_counts, token_output

from .helpers import frame, texts


@pytest.mark.parametrize("hot", [0, 5, token_counts.HOT])
def test_counts_are_the_librarys(spark, hot):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    values = texts()
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, values), path, limit=20, hot=hot).collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        n = len(model.encode(v or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((v or "").encode()), n, n > 20), repr(v)


def test_counts_of_repeated_rows_and_empty_table(spark):
    path = P.path("piece_bpe_32k.model")
    rows = token_counts.count_tokens(frame(spark, ["a b", "a b", "a b"], [1, 1, None]), path).collect()
    assert [(r.doc_id, r.n_tokens) for r in sorted(rows, key=str)] == [(1, 2), (1, 2), (None, 2)]
    assert token_counts.count_tokens(frame(spark, ["a"]).limit(0), path).collect() == []


def test_output_reads_back_what_the_library_gives(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    values = texts()
    ids = [3 * i % 101 for i in range(len(values))]
    got = token_output.token_output(frame(spark, values, ids), path).orderBy("doc_id").collect()
    start = 0
    for row, (i, v) in zip(got, sorted(zip(ids, values, strict=True)), strict=True):
        want = [*library.encode(v or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens) == (i, start, len(want)), repr(v)
        assert row.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_ids_of_letters_that_change_in_kind():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path, r = P.path("word_bpe_49k.json"), random.Random(9)
    library, coder = Tokenizer.from_file(path), token_output.WordEncoder(path)
    # Every letter before a full stop, and texts of letters that fall apart, marks and stops.
    alone = [f"{chr(c)}. x{chr(c)}," for c in range(0x80, 0x30000) if chr(c).isalpha()]
    letters = "İıſẞΣς\u0301\u0307\u0323\u093c" + "".join(map(chr, [*range(0x958, 0x960), *range(0xFB1D, 0xFB4F)]))
    fuzzed = ["".join(r.choice(letters if r.random() < 0.4 else "abcde .,!?;:'s") for _ in range(r.randint(1, 40))) for _ in range(20_000)]
    for values in (alone, fuzzed):
        for at in range(0, len(values), 4000):
            part = values[at : at + 4000]
            got = coder(pa.array(part), 2).to_pylist()
            for v, raw, want in zip(part, got, library.encode_batch(part, add_special_tokens=False), strict=True):
                assert np.frombuffer(raw, coder.kind).tolist() == [*want.ids, 2], repr(v)


def test_output_of_null_ids_and_empty_table(spark):
    path = P.path("word_bpe_49k.json")
    got = token_output.token_output(frame(spark, ["a", "b c", "b c"], [5, None, None]), path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 3), (None, 3, 3), (5, 6, 2)]
    assert token_output.token_output(frame(spark, ["a"]).limit(0), path).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=80), st.integers(7, 18))
def test_lengths_are_a_full_code_within_the_limit(counts, top):
    counts = np.array(counts)
    bits = token_output.code_lengths(counts, top).astype(int)
    assert ((bits > 0) == (counts > 0)).all() and bits.max(initial=0) <= top
    if (counts > 0).sum() > 1:
        assert sum(2.0**-b for b in bits[bits > 0]) == 1


def test_lengths_cost_what_huffmans_tree_costs():
    import heapq

    counts = np.random.default_rng(3).zipf(1.3, 300) % 100_000 + 1
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert (counts * token_output.code_lengths(counts, 40)).sum() == cost


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=900), st.integers(1, 70))
def test_stream_round_trip(ids, step):
    ids = np.array(ids)
    lengths = token_output.code_lengths(np.bincount(ids), 9)
    stream, marks = token_output.encode_ids(ids, lengths, token_output.canonical_codes(lengths), step)
    table = token_output.decode_table(lengths)
    assert (token_output.decode_ids(stream, marks, len(ids), table, step) == ids).all()


def test_ids_of_other_types(spark):
    path = P.path("word_bpe_49k.json")
    docs = frame(spark, ["a", "b c", None], [5, -7, None])
    for kind in ("smallint", "decimal(12,2)", "string", "date"):
        cast = "date_add(date'2020-01-01', cast(doc_id as int))" if kind == "date" else f"cast(doc_id as {kind})"
        got = token_output.token_output(docs.selectExpr(f"{cast} as doc_id", "text"), path)
        assert got.schema["doc_id"].dataType.simpleString() == kind
        assert [r.n_tokens for r in got.orderBy("start").collect()] == ([1, 3, 2] if kind != "string" else [1, 3, 2])


def test_a_new_session_reads_the_file(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    values = texts(10)
    encoded = token_output.encode_documents(frame(spark, values), path, 2)
    token_output.write_file(encoded, token_output.code_lengths(token_output.count_ids(encoded, "<u2")), "<u2", f"file://{tmp_path}/ids", block=40, step=16)
    got = token_output.read_file(spark.newSession(), f"file://{tmp_path}/ids").collect()
    want = {r.doc_id: zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in encoded.collect()}
    assert {r.doc_id: r.ids_crc32 for r in got} == want and len(got) == len(values)


def test_many_blocks(spark, tmp_path):
    from pyspark.sql import functions as F

    path = P.path("word_bpe_49k.json")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word ', id, ' '), 1 + cast(id % 17 as int))").alias("text"))
    encoded = token_output.encode_documents(docs, path, 2)
    lengths = token_output.code_lengths(token_output.count_ids(encoded, "<u2"))
    token_output.write_file(encoded, lengths, "<u2", f"file://{tmp_path}/ids", block=50, step=8)
    assert spark.read.parquet(f"file://{tmp_path}/ids/blocks").count() > 20
    got = token_output.read_file(spark, f"file://{tmp_path}/ids").orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(300))
    for a, b in zip(got, got[1:], strict=False):
        assert a.start + a.n_tokens == b.start
