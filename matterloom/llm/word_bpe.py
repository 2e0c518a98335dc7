"""BPE with word ends: merges from a priority queue of ranks over a doubly linked list of symbols, and decoding by the
vocabulary's strings.

Encoding: a text is cut at the file's special strings and at ASCII white space, which no pre-token of such a file crosses; each
distinct word is normalised and cut into pre-tokens by the file's own rules, and each distinct pre-token is merged once.
Its symbols are a doubly linked list; every neighbouring pair that the merge table knows waits in a queue by rank and place. The
least entry is taken; it is stale, and skipped, where its symbol is gone or the pair at its place has another rank by now.
A merge takes the right symbol out of the list and queues the two new pairs, so a word of n symbols takes O(n log n) steps
however long it is. Decoding: the strings of the ids with a space between, as the library does for a file without a decoder.

Spark deals out the rows; nothing is shuffled and nothing is held together but a slice of some megabytes. A word's tokens do
not depend on its neighbours, so a worker remembers the words that it met last, up to a fixed number.

Defined results: null or empty text has 0 tokens and decodes to no bytes; repeated rows and null doc_ids keep one result row
each; an empty table gives an empty result; other columns are ignored. A file with a decoder, special strings that depend on
their surroundings, or another kind of model is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words that a worker remembers, and as many pre-tokens, in two generations.
KEPT = 200_000
#: Characters of a word or pre-token that is remembered.
SHORT = 64
#: Words that go through the file's rules as one text.
JOINED = 2000
WHITE = re.compile(r"\s")
#: Symbols from which on the list's links are packed.
LONG = 4096


class Coder:
    """Encodes and decodes by a tokenizers file with a BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("continuing_subword_prefix", "unk_token", "byte_fallback", "ignore_merges", "dropout")) or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path} is not a plain BPE file without a decoder")
        if any(t[k] for t in added for k in ("normalized", "single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has special strings that depend on their surroundings")
        library = Tokenizer.from_file(path)
        self._normal, self._cut = library.normalizer, library.pre_tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        #: The rank of each pair of symbols (the first times ``size``, and the second), and what the pair of a rank becomes.
        self.size = max(self.vocab.values()) + 1
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a] * self.size + self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in added}
        longest = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        by_id = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.strings = pa.array([f"{by_id.get(i, '')} ".encode() for i in range(max(by_id) + 1)], pa.large_binary())
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.parts: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def merge(self, ids: list[int]) -> list[int]:
        """What a sequence of symbols comes to by merging its least-ranked pair, the leftmost first, until none is known."""
        size, n = self.size, len(ids)
        rank_of, made = self.merges.get, self.made
        # An entry is a rank times the number of places, and a place.
        queue = [rank * n + at for at, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (rank := rank_of(a * size + b)) is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        if n > LONG:
            after, before = array("q", after), array("q", before)
        while queue:
            rank, at = divmod(heappop(queue), n)
            left, right = ids[at], after[at]
            if left < 0 or right == n or rank_of(left * size + ids[right]) != rank:
                continue
            ids[at] = new = made[rank]
            ids[right] = -1
            after[at] = end = after[right]
            if end < n:
                before[end] = at
                if (rank := rank_of(new * size + ids[end])) is not None:
                    heappush(queue, rank * n + at)
            if (start := before[at]) >= 0 and (rank := rank_of(ids[start] * size + new)) is not None:
                heappush(queue, rank * n + start)
        return [i for i in ids if i >= 0]

    def _part(self, part: str) -> bytes:
        """Ids of a pre-token."""
        new, old = self.parts
        if (ids := new.get(part)) is not None:
            return ids
        if (ids := old.get(part)) is None:
            symbols = [*part]
            symbols[-1] += self.suffix
            known = self.vocab
            ids = array("I", self.merge([known[s] for s in symbols if s in known])).tobytes()
        if len(part) <= SHORT:
            new[part] = ids
        return ids

    def _plain(self, word: str) -> bytes:
        if self._normal is not None:
            word = self._normal.normalize_str(word)
        return b"".join([self._part(part) for part, _ in self._cut.pre_tokenize_str(word)])

    def _word(self, word: str) -> bytes:
        """Ids of a word: what stands between special strings is normalised and cut by itself."""
        if self._special is None or not self._special.search(word):
            return self._plain(word)
        pieces = self._special.split(word)
        return b"".join([self.special[p].to_bytes(4, "little") if k % 2 else self._plain(p) for k, p in enumerate(pieces) if p])

    def _learnt(self, words: list[str]) -> list[bytes]:
        """Ids of words that this generation has not met. Words without special strings and white space go through the file's rules
        as one text, a space between, which no rule crosses; where that gives another number of words, one by one."""
        out = list(map(self.words[1].get, words))
        fresh = [k for k, ids in enumerate(out) if ids is None]
        alone = [k for k in fresh if WHITE.search(words[k]) or (self._special is not None and self._special.search(words[k]))]
        others = sorted(set(fresh) - set(alone)) if alone else fresh
        for at in range(0, len(others), JOINED):
            some = others[at : at + JOINED]
            text = " ".join([words[k] for k in some])
            if self._normal is not None:
                text = self._normal.normalize_str(text)
            pieces = text.split(" ")
            if len(pieces) != len(some):
                alone += some
                continue
            ends, end = [], -1
            for p in pieces:
                end += len(p) + 1
                ends.append(end)
            number, parts = 0, [[] for _ in some]
            for part, (_, stop) in self._cut.pre_tokenize_str(text):
                while stop > ends[number]:
                    number += 1
                parts[number].append(self._part(part))
            for k, x in zip(some, parts, strict=True):
                out[k] = b"".join(x)
        for k in alone:
            out[k] = self._word(words[k])
        self.words[0].update((w, ids) for w, ids in zip(words, out, strict=True) if len(w) <= SHORT)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and end; null is empty."""
        if len(self.words[0]) > KEPT:
            self.words = {}, self.words[0]
        if len(self.parts[0]) > KEPT:
            self.parts = {}, self.parts[0]
        split = pa.compute.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        table = list(map(self.words[0].get, words))
        if missing := [w for w, ids in zip(words, table, strict=True) if ids is None]:
            found = dict(zip(missing, self._learnt(missing), strict=True))
            table = [found[w] if ids is None else ids for w, ids in zip(words, table, strict=True)]
        sizes = np.array([len(x) // 4 for x in table], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat, word = np.frombuffer(b"".join(table), "<u4"), coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes[word])
        ids = flat[np.repeat(starts[word] - ends + sizes[word], sizes[word]) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.r_[0, ends][split.offsets.to_numpy()]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The text in UTF-8 of each sequence of ids: their strings with a space between."""
        taken = self.strings.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        data, at = memoryview(taken.buffers()[2]) if len(taken) else b"", ends[offsets].tolist()
        return [bytes(data[a : max(a, b - 1)]) for a, b in zip(at, at[1:], strict=False)]


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _mapped(docs: DataFrame, path: str, doc_id: str, text: str, schema: str, make) -> DataFrame:
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in slices(batches, "text", rows=4000, size=4 << 20):
            ids, offsets = code.encode(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), *make(code, ids, offsets)], names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, {schema}")


def _raw(ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    data, at = memoryview(ids.astype("<u4").tobytes()), (offsets * 4).tolist()
    return [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]


def encode_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids as little-endian unsigned 32-bit integers, and the text that they decode to."""

    def make(code: Coder, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array(_raw(ids, offsets), pa.binary()), pa.array(code.decode(ids, offsets), pa.binary()).cast(pa.string())]

    return _mapped(docs, path, doc_id, text, "ids binary, decoded string", make)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the text that their packed ids decode to; null ids give null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(decoded).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in slices(batches, ids):
            raw = batch.column(ids).to_pylist()
            offsets = np.cumsum([0, *(len(x or b"") // 4 for x in raw)])
            texts = code.decode(np.frombuffer(b"".join(x or b"" for x in raw), "<u4"), offsets)
            texts = [None if x is None else t for x, t in zip(raw, texts, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, decoded])

    return rows.drop(decoded).mapInArrow(run, f"{schema}, `{decoded}` string")


def word_bpe(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's text."""

    def make(code: Coder, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [
            pa.array(np.diff(offsets), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in _raw(ids, offsets)], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in code.decode(ids, offsets)], pa.string()),
        ]

    return _mapped(docs, path, doc_id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
