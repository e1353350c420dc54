"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

A word is held as its part boundaries and the rank of each adjacent pair of parts, in two parallel lists. The smallest
rank is found by scanning, its boundary is deleted and the two neighbouring ranks are refreshed from the bytes between
their boundaries; at the end the bytes between boundaries are looked up.
Words over LONG_WORD bytes take the same merges from a heap, so that a text without spaces stays near-linear.

Cases: a null text counts as empty and has no ids; empty texts have an empty list; unknown ids (null or out of range)
decode to nothing; repeated rows are encoded alike; very long texts are
encoded whole; other columns are passed through untouched, but one with the name of the new column is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpusflow.llm.common import give_back

#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 96
#: Entries that a worker keeps of the newer and of the older generation of encoded pieces.
CACHED_PIECES = 250_000
NO_RANK = 1 << 60


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary: ids of bytes, rank and result of each pair, bytes of each id, and whole-string added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.byte_ids = [0] * 256
        self.piece_bytes = [b""] * (max(vocab.values()) + 1)
        for token, number in vocab.items():
            self.piece_bytes[number] = bytes(letters[c] for c in token)
            if len(token) == 1:
                self.byte_ids[letters[token]] = number
        self.piece_ids = {piece: number for number, piece in enumerate(self.piece_bytes)}
        self.pairs, self.merges = {}, {}  # by ids, and by the bytes of both parts: rank, and where they meet
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left], vocab[right]] = rank, vocab[left + right]
            whole = self.piece_bytes[vocab[left + right]]
            if whole in self.merges:
                raise ValueError(f"two merges make {left + right!r}")
            self.merges[whole] = rank, len(self.piece_bytes[vocab[left]])
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        for content, number in self.added.items():
            self.piece_bytes += [b""] * (number + 1 - len(self.piece_bytes))
            self.piece_bytes[number] = content.encode()
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.find_words = regex.compile(PATTERN).findall
        self.uneven = re.compile(r"\s ").search
        self.pieces = Pieces(self)
        self.words = Words(self)

    def merge_short(self, raw: bytes) -> list[int]:
        """A part is what lies between two boundaries; ranks[i] is that of parts i and i + 1 together."""
        merges, ids = self.merges, self.piece_ids
        boundaries = list(range(len(raw) + 1))

        def rank(i: int) -> int:
            left, middle, right = boundaries[i : i + 3]
            found = merges.get(raw[left:right])
            return found[0] if found and found[1] == middle - left else NO_RANK

        ranks = [found[0] if (found := merges.get(raw[i : i + 2])) else NO_RANK for i in range(len(raw) - 1)]
        while ranks and (least := min(ranks)) < NO_RANK:
            at = ranks.index(least)
            del boundaries[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(at)
            if at:
                ranks[at - 1] = rank(at - 1)
        return [ids[raw[a:b]] for a, b in zip(boundaries, boundaries[1:])]

    def merge_long(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[pair][0], i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in pairs]
        heapq.heapify(heap)
        while heap:
            _, at, left, right = heapq.heappop(heap)
            nxt = after[at]
            if ids[at] != left or nxt >= n or ids[nxt] != right:
                continue
            ids[at], ids[nxt] = pairs[left, right][1], -1
            after[at] = after[nxt]
            if after[at] < n:
                before[after[at]] = at
                pair = ids[at], ids[after[at]]
                if pair in pairs:
                    heapq.heappush(heap, (pairs[pair][0], at, *pair))
            if before[at] >= 0:
                pair = ids[before[at]], ids[at]
                if pair in pairs:
                    heapq.heappush(heap, (pairs[pair][0], before[at], *pair))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.merge_short(raw) if len(raw) <= LONG_WORD else self.merge_long([self.byte_ids[b] for b in raw])
        return np.array(ids, np.int32).tobytes()

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text without added tokens. No word reaches over the gap before a single space, so pieces that
        begin at such a space can be encoded (and remembered) one by one; texts with other gaps are split as a whole."""
        if not text:
            return b""
        if self.uneven(text):
            return b"".join([self.words[w] for w in self.find_words(text)])
        first, *rest = text.split(" ")
        pieces = self.pieces
        return (pieces.alone(first) if first else b"") + b"".join([pieces[p] for p in rest])

    def encode(self, text: str | None) -> bytes:
        """The ids as 32-bit numbers."""
        if not text:
            return b""
        if self.split_added is None or not self.split_added.search(text):
            return self.encode_plain(text)
        return b"".join(np.int32(self.added[x]).tobytes() if x in self.added else self.encode_plain(x) for x in self.split_added.split(text))


class Generations(dict):
    """A bounded dictionary of computed values: when full, it becomes the old generation, of which used entries return."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= CACHED_PIECES:
            self.old = dict(self)
            self.clear()
        if len(key) <= LONG_WORD:
            self[key] = value
        return value


class Words(Generations):
    def compute(self, key: str) -> bytes:
        return self.bpe.encode_word(key)


class Pieces(Generations):
    """Keys are pieces without the space that they begin with."""

    def compute(self, key: str) -> bytes:
        return b"".join([self.bpe.encode_word(w) for w in self.bpe.find_words(" " + key)])

    def alone(self, text: str) -> bytes:
        return b"".join([self.bpe.encode_word(w) for w in self.bpe.find_words(text)])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def ids_of(bpe: Bpe, texts: pa.Array) -> pa.ListArray:
    found = [bpe.encode(t.as_py()) for t in texts]
    ends = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in found], out=ends[1:])
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def texts_of(bpe: Bpe, pieces: pa.Array, lists: pa.Array) -> pa.Array:
    """pieces: the bytes of each id, and none for an unknown one."""
    flat = np.asarray(lists.flatten().fill_null(-1)) if len(lists.flatten()) else np.zeros(0, np.int64)
    flat = np.where((flat >= 0) & (flat < len(bpe.piece_bytes)), flat, len(bpe.piece_bytes))
    sizes = np.fromiter((0 if x is None else x for x in lists.value_lengths().to_pylist()), np.int64, len(lists))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    lengths = np.fromiter(map(len, bpe.piece_bytes), np.int64, len(bpe.piece_bytes))
    lengths = np.concatenate([lengths, [0]])[flat]
    starts = np.concatenate([[0], np.cumsum(lengths)])[ends]
    raw = b"" if not len(flat) else _joined(pieces.take(pa.array(flat)))
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts, starts[1:])], pa.string())


def _mapped(df: DataFrame, added: list[T.StructField], change, without: tuple[str, ...] = ()) -> DataFrame:
    """df with further columns, of which change(batch) gives the arrays; they replace those of their name."""
    names = [f.name for f in added]
    kept = [f for f in df.schema.fields if f.name not in (*names, *without)]
    columns = [f.name for f in kept]

    def run(batches):
        give_back()
        for batch in batches:
            new = change(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns), *new], [*columns, *names])

    return df.mapInArrow(run, T.StructType([*kept, *added]))


def _ids_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType(), False), False)


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Append the ids (array of int) of each whole text. vocabulary: a tokenizer file that every executor has.
    Added tokens in a text count as tokens; none are put in. A null text has no ids."""
    return _mapped(df, [_ids_field(ids_col)], lambda batch: [ids_of(load(vocabulary), batch.column(text_col))])


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append the text of each list of ids; bytes that are no UTF-8 become U+FFFD. A null list gives an empty text."""
    added = [T.StructField(out_col, T.StringType(), False)]
    return _mapped(df, added, lambda batch: [texts_of(load(vocabulary), load_pieces(vocabulary), batch.column(ids_col))])


def encode_and_decode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The ids of each text and the text that they decode to in place of the text, in one pass: a task has one Python worker,
    not two."""

    def both(batch):
        ids = ids_of(load(vocabulary), batch.column(text_col))
        return [ids, texts_of(load(vocabulary), load_pieces(vocabulary), ids)]

    return _mapped(df, [_ids_field(ids_col), T.StructField(out_col, T.StringType(), False)], both, (text_col,))


@lru_cache(maxsize=2)
def load_pieces(path: str) -> pa.Array:
    return pa.array([*load(path).piece_bytes, b""], pa.binary())


def _joined(values: pa.Array) -> bytes:
    """All values' bytes, end to end: the buffer that they already share."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return values.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]


def token_digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text, for (doc_id, text) rows."""
    both = encode_and_decode(df.select("doc_id", "text"), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
