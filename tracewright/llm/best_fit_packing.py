"""Best-fit packing of token pieces into fixed-length sequences.

Documents are tokenised in parallel; longer ones are cut, the first piece taking what
is over. Pieces are dealt by a hash into shards of bounded size; each shard is packed by
best-fit decreasing, where a segment tree over remaining capacities gives the tightest
open sequence in logarithmic time. What a shard leaves in sequences that are not nearly
full is packed again together with that of other shards, until one shard is left.

Defined results: null text is empty and packs as its end id alone; an empty text likewise;
null ids are kept, and ids of all 64 bits come back as they are; repeated rows are packed
each; a very long text is cut like any other, and encoded as the library encodes the whole,
long runs of white space included;
pieces of equal length go by id and piece; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._common import cut, id_text, map_batches

#: How this family of byte-level vocabularies cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space (as the pattern has it) whose look-ahead would exhaust the pattern's stack.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
_TOKENIZERS: dict[str, Tokens] = {}


class Tokens:
    """Ids of a byte-level vocabulary file as the tokenizers library gives them with ``add_special_tokens=False``.

    The same merges run in tiktoken, several times faster; a token's id is its rank. Texts
    that hold an added token of the file go through the library itself, which finds such
    tokens in the text. It also encodes a few texts first, to make sure that the file is of
    this kind.
    """

    PROBES = ("Hello, world's end\n\n  x", "12 Äpfel und naïveté!\t", "...   ")

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        own, self.path, self.own = Tokenizer.from_file(path), path, None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        added = {t.content for t in own.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in own.get_vocab().items() if t not in added}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        for text in self.PROBES:
            if own.encode(text, add_special_tokens=False).ids != self.fast.encode_ordinary(text):
                raise ValueError(f"{path} is no byte-level vocabulary with ids in the order of merges")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self._of(t) for t in texts]

    def _of(self, text: str) -> np.ndarray:
        if self.added and self.added.search(text):
            if self.own is None:  # few tasks need it, and it is large
                from tokenizers import Tokenizer

                self.own = Tokenizer.from_file(self.path)
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")
        return np.concatenate([self._plain(p) if at % 2 == 0 else np.array(self.fast._encode_single_piece(p.encode()), "<u4") for at, p in enumerate(self._cut(text))])

    def _plain(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Stretches for the pattern and, between them, long runs of white space that it takes as one word.

        Of a run with something after it, the last character belongs to what follows.
        """
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += [text[at : run.start()], text[run.start() : end]]
            at = end
        return [*out, text[at:]]


def tokens(path: str) -> Tokens:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokens(path)
    return _TOKENIZERS[path]


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))]


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    end = np.array([end_id], "<u4")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        ids = batch.column("doc_id").to_pylist()
        for doc_id, raw in zip(ids, tokens(tokenizer_path).ids(batch.column("text").to_pylist()), strict=True):
            every = np.concatenate([raw, end])
            for piece, (start, length) in enumerate(cut_pieces(len(every), size)):
                for col, x in zip(out, (doc_id, piece, start, length, zlib.crc32(every[start : start + length].tobytes())), strict=True):
                    col.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(id_text(docs, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long", rows=1000)


class CapacityTree:
    """Segment tree over remaining capacities: which ones an open sequence has."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.used = bytearray(2 * self.leaves)

    def set(self, capacity: int, used: bool) -> None:
        i = self.leaves + capacity
        self.used[i] = used
        while i > 1:
            i >>= 1
            now = self.used[2 * i] | self.used[2 * i + 1]
            if self.used[i] == now:
                break
            self.used[i] = now

    def tightest(self, length: int) -> int:
        """Smallest capacity of at least ``length`` that is in use, or -1."""
        i = self.leaves + length
        if self.used[i]:
            return length
        while i > 1:
            if not i & 1 and self.used[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each item; the order among equal lengths is that of the input."""
    tree, open_by = CapacityTree(size), [[] for _ in range(size + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room < 0:
            at, room, n = n, size, n + 1
        else:
            at = open_by[room].pop()
            if not open_by[room]:
                tree.set(room, False)
        bins[i], offsets[i] = at, size - room
        if left := room - need:
            open_by[left].append(at)
            if len(open_by[left]) == 1:
                tree.set(left, True)
    return bins, offsets


def _pack_shard(shard: pa.Table, size: int) -> pa.Table:
    """One shard with sequence_id, offset, and how much of its sequence is filled."""
    order = pc.sort_indices(shard, sort_keys=[("doc_id", "ascending"), ("piece", "ascending")])
    shard = shard.take(order)
    lengths = shard.column("length").to_numpy().astype(np.int64)
    bins, offsets = best_fit_decreasing(lengths, size)
    filled = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
    first = shard.column("shard").to_numpy().astype(np.int64) << 32
    out = shard.drop_columns(["shard"])
    for name, values in (("sequence_id", first + bins), ("offset", offsets), ("filled", filled)):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out


def pack(pieces: DataFrame, size: int = 2048, shard_rows: int = 32_768, nearly: float = 0.98) -> DataFrame:
    """``pieces`` (with doc_id, piece and ``length``) plus sequence_id and offset.

    Pieces of sequences filled to less than ``nearly`` of ``size`` are dealt and packed
    anew, as long as that makes fewer shards. Needs the number of pieces, and row numbers
    that are the same whenever a task runs again, so ``pieces`` should be materialised.
    Dealing by a hash of id, piece and row number gives every shard about the same mixture,
    even where one id repeats.
    """
    given = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, filled long"
    at, used, done, rows = 0, 0, None, pieces
    shards = max(1, -(-pieces.count() // shard_rows))
    while True:
        dealt = rows.withColumn("shard", F.lit(used) + F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(at)), F.lit(shards)))
        packed = dealt.groupBy("shard").applyInArrow(lambda shard: _pack_shard(shard, size), schema)
        if shards == 1:
            return packed.drop("filled") if done is None else done.unionByName(packed.drop("filled"))
        packed = cut(packed)
        rest = packed.filter(F.col("filled") < int(nearly * size))
        fewer = max(1, -(-rest.count() // shard_rows))
        if fewer >= shards:
            return packed.drop("filled") if done is None else done.unionByName(packed.drop("filled"))
        full = packed.filter(F.col("filled") >= int(nearly * size)).drop("filled")
        done = full if done is None else done.unionByName(full)
        at, used, rows, shards = at + 1, used + shards, rest.select(*given), fewer


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(cut(token_pieces(docs, tokenizer_path, size, 0, id_col, text_col)), size)
