"""Byte-level BPE by DuckDB recursive queries, one database inside each worker.

Encoding: token-position rows of the words that a worker has not met lately join the merge table; a recursive query
contracts each word's leftmost pair of least rank until no pair of it is in the table; then the word's rows are marked
as done and leave the recursion. A word that is itself a token is that token. Decoding: the ids, one row a position, join the vocabulary, and an ordered aggregation strings their
bytes together.

Spark deals out the rows; nothing is shuffled. A word's tokens do not depend on its neighbours, so a worker
remembers the last words it encoded, up to a fixed number. Words are handed to the database in groups of bounded size.

A sequence of tokens is what contraction comes to exactly when each two neighbours are, so a very long word is
contracted in windows that overlap, and two windows are joined at a token that stands at the same place in both. Where
they share none, wider windows are taken, up to the whole word.

Defined results: null or empty text has 0 tokens and decodes to no bytes; repeated rows and null doc_ids keep one
result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings

#: A piece of text ends before a space that something else than white space follows; no match of the pattern crosses that.
PIECE = re.compile(r"(?= \S)")
ODD = re.compile(r" (?=\s|\Z)")
#: Stands between pieces while they are told apart; texts that hold it are cut by the pattern.
MARK = "\x00"
#: Pieces and words that a worker remembers, in two generations.
KEPT = 250_000
#: Bytes of the words that one recursive query takes, and the rows that its steps may come to.
GROUP, ROWS = 250_000, 3_000_000
#: Bytes of the windows of a word that is longer, and how far they overlap.
WIDE, OVER = 480, 96

ENCODE = """
WITH RECURSIVE t(w, p, tok, done) AS (
  SELECT w, p, tok, false FROM fresh
  UNION ALL
  (WITH pairs AS (SELECT w, p, tok, lead(w) OVER o AS next_w, lead(tok) OVER o AS next_tok, lead(p) OVER o AS next_p FROM t WHERE NOT done WINDOW o AS (ORDER BY p)),
        ranked AS (SELECT pairs.*, m.merged::BIGINT * 4294967296 + p AS key FROM pairs LEFT JOIN merges m ON m.a = tok AND m.b = next_tok AND next_w = w),
        best AS (SELECT w, min(key) AS key, arg_min(next_p, key) AS gone FROM ranked GROUP BY w)
   SELECT r.w, r.p, CASE WHEN r.key = best.key THEN (r.key >> 32)::INTEGER ELSE tok END, best.key IS NULL FROM ranked r JOIN best USING (w) WHERE r.p IS DISTINCT FROM best.gone))
SELECT w, list(tok ORDER BY p) AS ids FROM t WHERE done GROUP BY w ORDER BY w
"""
DECODE = "SELECT d, list(tok ORDER BY p) AS tokens FROM placed JOIN vocab USING (id) GROUP BY d ORDER BY d"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    """Encodes and decodes with the ranks of a file; whole texts fall apart by ``pattern``."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        kinds = pa.int32()
        self.merges = pa.table({"a": pa.array(left, kinds), "b": pa.array(right, kinds), "merged": pa.array(merged, kinds)})
        self.vocab = pa.table({"id": pa.array(list(self.ranks.values()), kinds), "tok": pa.array(list(self.ranks), pa.binary())})
        self._connect, self._db = duckdb.connect, None
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = [len(t) for t in self.ranks]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @property
    def db(self):
        """The worker's database with the merge table and the vocabulary."""
        if self._db is None:
            self._db = self._connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
            for name in ("merges", "vocab"):
                self._db.register("arrow", getattr(self, name))
                self._db.execute(f"CREATE TABLE {name} AS FROM arrow")
                self._db.unregister("arrow")
        return self._db

    def close(self) -> None:
        """Give the database's memory back; the next task opens it again."""
        if self._db is not None:
            self._db.close()
            self._db = None

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        out = self._contract([w for w in words if len(w) <= WIDE])[::-1]
        return [out.pop() if len(w) <= WIDE else self._long(w) for w in words]

    def _long(self, word: bytes) -> bytes:
        wide, over = WIDE, OVER
        while wide < len(word):
            starts = list(range(0, len(word) - over, wide - over))
            windows = [np.frombuffer(x, "<u4") for x in self._contract([word[s : s + wide] for s in starts])]
            ends = [s + np.cumsum(self.sizes[x]) for s, x in zip(starts, windows, strict=True)]
            kept, done = [], 0
            for k, (ids, at) in enumerate(zip(windows, ends, strict=True)):
                left = int(np.searchsorted(at, done, side="right"))
                if k + 1 == len(windows):
                    kept.append(ids[left:])
                    return np.concatenate(kept).astype("<u4").tobytes()
                # A token that begins and ends at the same places in both windows.
                spans = {(int(e - self.sizes[i]), int(e)) for i, e in zip(windows[k + 1], ends[k + 1], strict=True)}
                same = [j for j in range(left, len(ids)) if (int(at[j] - self.sizes[ids[j]]), int(at[j])) in spans]
                if not same:
                    break
                last = same[len(same) // 2]
                kept.append(ids[left : last + 1])
                done = int(at[last])
            wide, over = wide * 4, over * 4
        return self._contract([word])[0]

    def _contract(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        at = 0
        while at < len(words):
            end, size, rows = at + 1, len(words[at]), len(words[at]) ** 2
            while end < len(words) and size + len(words[end]) <= GROUP and rows + len(words[end]) ** 2 <= ROWS:
                size, rows = size + len(words[end]), rows + len(words[end]) ** 2
                end += 1
            flat = np.frombuffer(b"".join(words[at:end]), np.uint8)
            number = np.repeat(np.arange(at, end, dtype=np.int32), [len(w) for w in words[at:end]])
            self.db.register("fresh", pa.table({"w": number, "p": np.arange(len(flat), dtype=np.int64), "tok": self.bytes[flat]}))
            found = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("fresh")
            lists = found.column("ids").combine_chunks()
            ids, cut = lists.values.to_numpy().astype("<u4").tobytes(), (lists.offsets.to_numpy() * 4).tolist()
            for w, a, b in zip(found.column("w").to_pylist(), cut, cut[1:], strict=False):
                out[w] = ids[a:b]
            at = end
        return out

    def _learn(self, pieces: dict[str, None]) -> None:
        new, old = self.new, self.old
        parts = {}
        fresh: dict[str, None] = {}
        for piece in pieces:
            parts[piece] = words = self.pattern.findall(piece)
            for w in words:
                if w not in new and w not in fresh:
                    if (ids := old.get(w)) is not None:
                        new[w] = ids
                    elif (rank := self.ranks.get(w.encode())) is not None:
                        new[w] = rank.to_bytes(4, "little")
                    else:
                        fresh[w] = None
        if fresh:
            new.update(zip(fresh, self.encode_words([w.encode() for w in fresh]), strict=True))
        for piece, words in parts.items():
            if len(words) != 1 or words[0] != piece:
                new[piece] = b"".join([new[w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers. Each distinct piece of the texts is looked up once."""
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        cut = []
        for t in texts:
            if MARK in t or ODD.search(t):
                cut.append(None)
            else:
                cut.append(t.replace(" ", MARK + " "))
        lists = pa.compute.split_pattern(pa.array(cut, pa.string()).fill_null(""), MARK)
        coded = lists.flatten().dictionary_encode()
        odd = {k: [p for p in PIECE.split(texts[k]) if p] for k, c in enumerate(cut) if c is None}
        pieces = coded.dictionary.to_pylist()
        missing: dict[str, None] = {}
        for p in dict.fromkeys([*pieces, *(p for x in odd.values() for p in x)]):
            if p not in new:
                if (ids := old.get(p)) is not None:
                    new[p] = ids
                else:
                    missing[p] = None
        if missing:
            self._learn(missing)
        table = [new[p] for p in pieces]
        sizes = np.array([len(x) // 4 for x in table], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(table), "<u4")
        index = coded.indices.to_numpy()
        ends = np.cumsum(sizes[index])
        ids = flat[np.repeat(starts[index] - ends + sizes[index], sizes[index]) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = (np.r_[0, ends][lists.offsets.to_numpy()] * 4).tolist()
        out = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        for k, x in odd.items():
            out[k] = b"".join([new[p] for p in x])
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids."""
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        self.db.register("placed", pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), counts), "p": np.arange(len(flat), dtype=np.int64), "id": flat}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("placed")
        out = [b""] * len(ids)
        lists = found.column("tokens").combine_chunks()
        tokens, cut = lists.values, lists.offsets.to_numpy()
        if len(cut):
            ends = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1 + tokens.offset)[tokens.offset :]
            data = memoryview(tokens.buffers()[2]) if len(tokens) else b""
            for d, a, b in zip(found.column("d").to_pylist(), ends[cut[:-1]].tolist(), ends[cut[1:]].tolist(), strict=True):
                out[d] = bytes(data[a:b])
        return out


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def _mapped(docs: DataFrame, path: str, pattern: str, doc_id: str, text: str, schema: str, make) -> DataFrame:
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in slices(batches, "text", rows=4000, size=6 << 20):
            yield pa.record_batch([batch.column("doc_id"), *make(code, strings(batch.column("text")))], names)
        code.close()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, {schema}")


def encode_texts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids as little-endian unsigned 32-bit integers, and the bytes that they stand for."""

    def make(code: Coder, texts: list[str]) -> list[pa.Array]:
        ids = code.encode(texts)
        return [pa.array(ids, pa.binary()), pa.array(code.decode(ids), pa.binary())]

    return _mapped(docs, path, pattern, doc_id, text, "ids binary, decoded binary", make)


def byte_bpe(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's text."""

    def make(code: Coder, texts: list[str]) -> list[pa.Array]:
        ids = code.encode(texts)
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in code.decode(ids)], pa.string()),
        ]

    return _mapped(docs, path, pattern, doc_id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
