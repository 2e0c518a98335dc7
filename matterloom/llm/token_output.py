"""Token ids as binary files: canonical, length-limited Huffman codes from global counts, written in
independent blocks with bit-offset checkpoints, and decoded by table.

File format: a folder of two Parquet tables. ``blocks`` holds whole documents in ascending doc_id order (nulls first):
their ids, their numbers of ids, the number of ids in its part before it, the code stream, and the bit offset of every
``step``-th id. ``book`` is the code book, a code length for each id. :func:`read_file` needs the folder's path alone; any block can be
decoded by itself, and the checkpoints let one NumPy step decode one id in every lane of the block.

Plan: encode once and keep the ids in the shared folder; count ids with map-side sums (at most one row per
vocabulary entry reaches the driver); range-partition by doc_id; code and write; read back, decode, digest.

Defined results: null or empty text holds just the end id; repeated rows, ties and null doc_ids keep one
result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop, new_path, slices, written

STEP = 256
BLOCK = 1 << 18
MAX_BITS = 18
#: Words whose ids a worker remembers, in two generations.
KEPT_WORDS = 450_000


class WordEncoder:
    """Ids of whole texts by a tokenizers file whose pre-tokens never cross white space. Texts are cut at ASCII white
    space, each distinct word of a batch is looked up once, and a word goes through the library only when the worker
    has not met it lately. A full stop, comma or the like is looked up separately where it is a pre-token of its own, that is
    after a letter that stays a letter when the file normalises it (U+0130 leaves a mark, which joins what follows)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.wide = len(vocabulary) > 65_536
        self.kind, self.width = ("<u4", 4) if self.wide else ("<u2", 2)
        #: Tokens that end a pre-token.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._apart: dict[str, bool] = {}

    def apart(self, letter: str) -> bool:
        """Whether a full stop or the like after this letter is a pre-token of its own."""
        if (known := self._apart.get(letter)) is None:
            word = f"a{letter}."
            if self.library.normalizer is not None:
                word = self.library.normalizer.normalize_str(word)
            parts = self.library.pre_tokenizer.pre_tokenize_str(word)
            self._apart[letter] = known = letter.isalpha() and len(parts) == 2 and parts[1][0] == "."
        return known

    def _encode(self, words: list[str]) -> None:
        """Words of letters alone are one pre-token each, so many go through the library as one text, and are
        told apart by the tokens that end a word; should those be too many, or for other words, one by one."""
        letters = [w for w in words if w.isalpha()]
        groups = [letters[at : at + 1000] for at in range(0, len(letters), 1000)]
        for some, coded in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, np.int64)
            cut = np.flatnonzero(self.last[ids]) + 1
            if len(cut) == len(some):
                raw, ends = ids.astype(self.kind).tobytes(), (cut * self.width).tolist()
                self.new.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        rest = [w for w in words if w not in self.new]
        for w, x in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.new[w] = np.array(x.ids, self.kind).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.new) > KEPT_WORDS:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing: dict[str, None] = {}
        stems: dict[str, tuple[str, str]] = {}
        got = list(map(new.get, words))
        for w in [w for w, ids in zip(words, got, strict=True) if ids is None]:
            if (seen := old.get(w)) is not None:
                new[w] = seen
            elif len(w) > 1 and w[-1] in ".,!?;:" and self.apart(w[-2]):
                stems[w] = (w[:-1], w[-1])
            else:
                missing[w] = None
        for parts in stems.values():
            for p in parts:
                if p not in new:
                    if (seen := old.get(p)) is not None:
                        new[p] = seen
                    else:
                        missing[p] = None
        if missing:
            self._encode(list(missing))
        for w, (a, b) in stems.items():
            new[w] = new[a] + new[b]
        return [new[w] if ids is None else ids for w, ids in zip(words, got, strict=True)]

    def __call__(self, texts: pa.Array, end: int) -> pa.Array:
        """The packed ids of each text and ``end``; null is empty."""
        split = pa.compute.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        table = self.words(coded.dictionary.to_pylist()) + [np.array([end], self.kind).tobytes()]
        sizes = np.array([len(x) // self.width for x in table], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(table), self.kind)
        counts = np.diff(split.offsets.to_numpy())
        word = np.insert(coded.indices.to_numpy(), np.cumsum(counts), len(table) - 1)
        ends = np.cumsum(sizes[word])
        ids = flat[np.repeat(starts[word] - ends + sizes[word], sizes[word]) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.r_[0, ends[np.cumsum(counts + 1) - 1] * self.width].astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())]).cast(pa.binary())


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit in {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64 if counts.sum() > 2**53 else np.int64)
    n, weights, levels = len(order), leaves, []
    for _ in range(max_bits - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        weights = merged[by]
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    bits[: min(take, n)] += 1
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: ascending within a length, by id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        code <<= bits - before
        before = bits
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """The code stream of ``ids``, and the bit offset of every ``step``-th."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    word, shift = starts >> 5, (64 - bits - (starts & 31)).astype(np.uint64)
    window = codes[ids] << shift
    out = np.zeros(int(ends[-1] >> 5) + 2 if len(ids) else 0, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        at = word[first]
        out[at] += np.add.reduceat(window >> np.uint64(32), first)
        out[at + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), first)
    stream = out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8 if len(ids) else 0]
    return stream, starts[::step].astype(np.uint32 if len(ids) == 0 or ends[-1] < 2**32 else np.uint64)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every window of the longest code's bits: the id that it starts with, and that id's length."""
    top = int(lengths.max(initial=1))
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spans = np.left_shift(1, top - lengths[ids].astype(np.int64))
    symbols, sizes = np.repeat(ids, spans), np.repeat(lengths[ids].astype(np.int64), spans)
    pad = (1 << top) - len(symbols)
    return np.pad(symbols, (0, pad)).astype(np.uint32), np.pad(sizes, (0, pad), constant_values=1), top


def decode_ids(stream: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int], step: int = STEP) -> np.ndarray:
    """All ``n`` ids of a block; every round of the loop decodes one id from each checkpoint on."""
    symbols, sizes, top = table
    raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
    windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, mask = checkpoints.astype(np.int64), (1 << top) - 1
    out = np.zeros((len(at), step), np.uint32)
    last = len(windows) - 1
    for k in range(step):
        index = (windows[np.minimum(at >> 3, last)] >> (32 - top - (at & 7)).astype(np.uint32)) & mask
        out[:, k] = symbols[index]
        at = at + sizes[index]
    return out.reshape(-1)[:n]


def encode_documents(docs: DataFrame, path: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every text and the end id, packed little-endian in 2 bytes each, or 4 where the vocabulary needs them."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(path)
        for batch in slices(batches, "text", rows=10_000, size=12 << 20):
            yield pa.record_batch([batch.column("doc_id"), encode_texts(batch.column("text"), end)], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"doc_id {id_type}, ids binary")


def count_ids(encoded: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in the whole table; at most one row per vocabulary entry comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                n = np.bincount(np.frombuffer(x.as_buffer(), kind))
                if len(n) > len(total):
                    total, n = n, total
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.id for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


BLOCKS = "part int, block int, before long, n long, step int, doc_ids {ids}, sizes array<long>, stream binary, checkpoints array<long>"


def write_file(encoded: DataFrame, lengths: np.ndarray, kind: str, path: str, block: int = BLOCK, step: int = STEP) -> None:
    """Sort by doc_id over the whole table, code, and write blocks and code book below ``path``. Ties in doc_id order by the
    ids, and a doc_id that many rows share may span partitions."""
    spark = encoded.sparkSession
    book = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    arrow = pa.list_(to_arrow_type(encoded.schema["doc_id"].dataType))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = book.value
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, data, size = [], [], 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(data)
            stream, marks = encode_ids(flat, lengths, codes, step)
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([step], pa.int32()), pa.array([ids], arrow), pa.array([[len(x) for x in data]], pa.list_(pa.int64())), pa.array([stream], pa.binary()), pa.array([marks.astype(np.int64)], pa.list_(pa.int64()))],
                ["part", "block", "before", "n", "step", "doc_ids", "sizes", "stream", "checkpoints"],
            )

        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids.append(i)
                data.append(np.frombuffer(x.as_buffer(), kind))
                size += len(data[-1])
                if size >= block:
                    yield close()
                    number, before, ids, data, size = number + 1, before + size, [], [], 0
        if ids:
            yield close()

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    ordered = encoded.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(pack, BLOCKS.format(ids=f"array<{id_type}>")).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "id int, bits int").coalesce(1).write.parquet(f"{path}/book")


def read_book(spark: SparkSession, path: str) -> np.ndarray:
    """The code length of each id, 0 for those that don't occur; one row per vocabulary entry at most comes to the driver."""
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/book").collect()
    lengths = np.zeros(max([r.id for r in rows], default=-1) + 1, np.uint8)
    for r in rows:
        lengths[r.id] = r.bits
    return lengths


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the file that :func:`write_file` made at ``path``."""
    blocks = spark.read.parquet(f"{path}/blocks")
    table = spark.sparkContext.broadcast(read_book(spark, path))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    arrow = to_arrow_type(blocks.schema["doc_ids"].dataType.elementType)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = decode_table(table.value)
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r]  # noqa: B023, E731
                sizes = np.array(get("sizes").as_py(), np.int64)
                flat = decode_ids(get("stream").as_py(), np.array(get("checkpoints").as_py(), np.int64), get("n").as_py(), book, get("step").as_py())
                ends = np.cumsum(sizes)
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                starts = get("before").as_py() + ends - sizes
                yield pa.record_batch(
                    [pa.array([get("part").as_py()] * len(sizes), pa.int32()), get("doc_ids").values.cast(arrow), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    documents = blocks.mapInArrow(decode, f"part int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    # One row per part of the file: the ids that stand before it.
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return documents.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of every row's text to a file of blocks and return doc_id, start, n_tokens, ids_crc32 read from it."""
    kind = "<u4" if encoder(path).wide else "<u2"
    encoded = written(encode_documents(docs, path, end, doc_id, text), "ids")
    lengths = code_lengths(count_ids(encoded, kind))
    folder = new_path(docs.sparkSession, "token-ids")
    write_file(encoded, lengths, kind, folder)
    drop(encoded)
    return read_file(docs.sparkSession, folder)
