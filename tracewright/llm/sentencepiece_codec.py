"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The distinct words of a batch become one flat numpy array of symbols. A round looks up
the rank of every neighbouring pair, takes the smallest rank of each word (segmented
minimum), merges its occurrences from the left, all words at once, and compacts the
array; words without a pair left leave it. No vocabulary piece has a space mark after
another character, and none holds a line end, so words are independent.

Merging all occurrences at once equals the library's one-by-one order unless a merge
creates a pair of equal or better rank; such a word merges only its leftmost occurrence
in that round, which is always exact. Words of more than ``ROUNDS_UP_TO`` symbols (runs of
spaces, blobs without any) would need rounds in proportion to their length, each over all of
it: their leading run of one symbol is merged in closed form, and what is left from an agenda
of pairs by rank and place, which takes the length times its logarithm.

Defined results: null and empty texts have no ids and an empty decoded text; null ids are
kept; rows that repeat a document fare alike, each with a row of its own; of pairs of one
rank the leftmost merges first; an empty table gives no rows; other columns, whatever their
names, are ignored; texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm._common import id_text, map_batches

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_SHIFT = 21  # codes of symbols are below 2**21
_NONE = np.int32(2**31 - 1)
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LATIN = "A-Za-z\u00c0-\u024f\u1e00-\u1eff"
#: Where the kind of character changes; no merge reaches over it if no piece does.
_EDGES = re.compile(f"(?<=[{_LATIN}])(?=[^{_LATIN}])|(?<=[^{_LATIN}{MARK}])(?=[{_LATIN}])")
#: Symbols of a word that is merged in rounds, at most, and of a run worth the closed form, at least.
ROUNDS_UP_TO, RUN = 1024, 256
_CODECS: dict[str, Codec] = {}


class Codec:
    """Tables of one model file, and a bounded memory of words already encoded."""

    def __init__(self, model_path: str, remembered: int = 300_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size, self.remembered = model.get_piece_size(), remembered
        kind = lambda i: _UNKNOWN if model.is_unknown(i) else _CONTROL if model.is_control(i) else _BYTE if model.is_byte(i) else _NORMAL
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        kinds = [kind(i) for i in range(self.size)]
        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces of this model may span words")
        self.edges = None if any(_EDGES.search(p) for p in ids) else _EDGES
        code = lambda s: ids[s] if s in ids else self.size + ord(s) if len(s) == 1 else None
        scores = sorted({-model.get_score(i) for i in ids.values()})
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs = []
        for p, i in ids.items():
            for at in range(1, len(p)):
                if (a := code(p[:at])) is not None and (b := code(p[at:])) is not None:
                    pairs.append(((a << _SHIFT) | b, rank_of[-model.get_score(i)], i))
        pairs.sort()
        self.keys = np.array([k for k, _, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r, _ in pairs], np.int32)
        self.merged = np.array([m for _, _, m in pairs], np.int64)
        self.longest, self.width = max(map(len, ids), default=1), list(map(len, pieces))
        self.char_code = {p: i for p, i in ids.items() if len(p) == 1}
        self.bytes_of = [b" \xe2\x81\x87 " if k == _UNKNOWN else b"" if k == _CONTROL else bytes([int(p[1:-1], 16)]) if k == _BYTE else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.spelled = [str(i) for i in range(self.size)]
        self.piece_text = ["" if k == _BYTE else b.decode("utf-8") for b, k in zip(self.bytes_of, kinds, strict=True)]
        self.unknown = [k == _UNKNOWN for k in kinds]
        self.is_byte = [k == _BYTE for k in kinds]
        self.byte_id = {self.bytes_of[i][0]: i for i in range(self.size) if kinds[i] == _BYTE}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.parts: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}  # parts of before the last clearing

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``_NONE`` without one) and merged piece of each pair."""
        key = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def _symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        distinct, inverse = np.unique(points, return_inverse=True)
        return np.array([self.char_code.get(chr(c), self.size + c) for c in distinct.tolist()], np.int64)[inverse]

    def _one_pair(self, left: int, right: int) -> tuple[int, int]:
        rank, into = self._pair(np.array([left]), np.array([right]))
        return int(rank[0]), int(into[0])

    def _leading_run(self, sym: np.ndarray) -> np.ndarray:
        """``sym`` with the run of one symbol that it begins with merged as far as is certain.

        Up to the rank of the run's own pair, merges go from the left, and what forms depends
        only on the symbol before it. A short run shows it: where its second and third blocks are
        as the first, so are all. What follows the run reaches no further back into it than the
        longest piece.
        """
        while True:
            other = np.flatnonzero(sym != sym[0])
            n, a = int(other[0]) if len(other) else len(sym), int(sym[0])
            rank, _ = self._one_pair(a, a)
            if n < RUN + self.longest or rank == _NONE:
                return sym
            block, *next_ones = self._agenda(np.full(8 * self.longest, a, np.int64), rank)[:3]
            size = self.width[block] // self.width[a]
            blocks = (n - self.longest) // size - 2
            if blocks < 1 or next_ones != [block, block]:
                return sym
            sym = np.concatenate([np.full(blocks, block, np.int64), sym[blocks * size :]])

    def _agenda(self, symbols: np.ndarray, most: int = int(_NONE) - 1) -> list[int]:
        """Symbols left of one word; pairs of rank ``most`` or better merge by rank, then from the left."""
        n = len(symbols)
        rank, _ = self._ranks(symbols, np.zeros(n, np.int64), np.arange(n))
        first = np.flatnonzero(rank <= most)
        heap = np.sort((rank[first].astype(np.int64) << 32) | first).tolist()  # sorted is a heap
        sym, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[int, tuple[int, int]] = {}

        def pair(left: int, right: int) -> tuple[int, int]:
            key = (left << _SHIFT) | right
            if key not in known:
                known[key] = self._one_pair(left, right)
            return known[key]

        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            best, into = pair(sym[i], sym[j])
            if best != entry >> 32:
                continue  # of symbols that have merged since
            k = after[j]
            sym[i], sym[j], after[i] = into, -1, k
            if k < n:
                before[k] = i
                if (new := pair(into, sym[k])[0]) <= most:
                    heapq.heappush(heap, (new << 32) | i)
            if (h := before[i]) >= 0 and (new := pair(sym[h], into)[0]) <= most:
                heapq.heappush(heap, (new << 32) | h)
        return [s for s in sym if s >= 0]

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that begin at ``at``; the last symbol of a word begins none."""
        after = np.minimum(at + 1, len(sym) - 1)
        rank, into = self._pair(sym[at], sym[after])
        return np.where((word[at] == word[after]) & (after > at), rank, _NONE), into

    def merge(self, words: list[str]) -> list[list[int]]:
        """Symbols left of each word when no pair of its neighbours is a piece."""
        out: list[list[int]] = [[] for _ in words]
        for w in [w for w, text in enumerate(words) if len(text) > ROUNDS_UP_TO]:
            out[w] = self._agenda(self._leading_run(self._symbols(words[w])))
        lengths = np.array([len(w) if len(w) <= ROUNDS_UP_TO else 0 for w in words], np.int64)
        if not lengths.sum():
            return out
        sym = self._symbols("".join([w for w in words if len(w) <= ROUNDS_UP_TO]))
        word = np.repeat(np.arange(len(words)), lengths)
        rank, into = self._ranks(sym, word, np.arange(len(sym)))
        while len(sym):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            seg = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(sym))))
            least = np.minimum.reduceat(rank, start)[seg]
            done = least == _NONE
            if done.any():
                ended, syms = word[done], sym[done].tolist()
                cuts = np.flatnonzero(np.append(True, ended[1:] != ended[:-1])).tolist()
                for a, b, w in zip(cuts, [*cuts[1:], len(syms)], ended[cuts].tolist(), strict=True):
                    out[w] = syms[a:b]
                keep = ~done
                sym, word, rank, into, least = sym[keep], word[keep], rank[keep], into[keep], least[keep]
                if not len(sym):
                    break
            take = rank == least
            # overlapping occurrences: every second one of a run, counted from its left
            begins = take & ~np.append(False, take[:-1])
            run = np.maximum.accumulate(np.where(begins, np.arange(len(sym)), 0))
            take &= (np.arange(len(sym)) - run) % 2 == 0
            take = self._exact(sym, word, take, into, rank)
            sym = np.where(take, into, sym)
            keep = ~np.append(False, take[:-1])
            sym, word, rank, into, new = sym[keep], word[keep], rank[keep], into[keep], take[keep]
            stale = np.flatnonzero(new | np.append(new[1:], False))  # only pairs beside a merge are looked up again
            rank[stale], into[stale] = self._ranks(sym, word, stale)
        return out

    def _exact(self, sym: np.ndarray, word: np.ndarray, take: np.ndarray, into: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """``take`` without the later merges of words where an earlier one makes a pair as good."""
        at = np.flatnonzero(take)
        several = np.append(word[at][1:] == word[at][:-1], False) | np.append(False, word[at][1:] == word[at][:-1])
        at = at[several]
        if not len(at):
            return take
        after = np.where(take, into, sym)
        last = np.where(np.append(False, take[:-1]), np.arange(len(sym)) - 1, np.arange(len(sym)))  # where the symbol before ended up
        before = last[np.maximum(at - 1, 0)]
        left = (at > 0) & (word[before] == word[at])
        left &= self._pair(after[before], into[at])[0] <= rank[at]
        right_at = np.minimum(at + 2, len(sym) - 1)
        right = (at + 2 < len(sym)) & (word[right_at] == word[at])
        right &= self._pair(into[at], sym[right_at])[0] <= rank[at]
        bad = np.unique(word[at[left | right]])
        if not len(bad):
            return take
        spots = np.flatnonzero(take)
        later = np.append(False, word[spots][1:] == word[spots][:-1])
        take = take.copy()
        take[spots[later & np.isin(word[spots], bad)]] = False
        return take

    def ids_of(self, symbols: list[int]) -> list[int]:
        """Piece ids; characters that are no piece become the ids of their bytes."""
        if max(symbols) < self.size:
            return symbols
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                out.extend(self.byte_id[b] for b in chr(s - self.size).encode("utf-8", "replace"))
        return out

    def chunks(self, text: str) -> list[str]:
        """The text with a mark before it and for each space, cut before each run of marks."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return _CHUNKS.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK)).split(" ")

    def learn(self, chunks: list[list[str]]) -> dict[str, tuple[int, str, str]]:
        """Number of ids, ids joined by commas, and decoded text of every chunk."""
        if len(self.words) > self.remembered:
            self.words.clear()
        if len(self.parts) > self.remembered:
            self.parts, self.older = {}, self.parts
        known, parts, rare, whole = self.words, self.parts, {}, re.compile(f"[{MARK}]?[{_LATIN}]+")
        fresh = [c for c in set().union(*chunks) if c not in known]
        split = [[c] if not self.edges or whole.fullmatch(c) else self.edges.split(c) for c in fresh]
        unseen = {p for ps in split for p in ps if p not in parts}
        parts.update((p, self.older[p]) for p in unseen if p in self.older)
        self._learn_parts(sorted(p for p in unseen if p not in parts))
        for c, ps in zip(fresh, split, strict=True):
            got = [parts[p] for p in ps]
            (known if len(c) <= 48 else rare)[c] = got[0] if len(got) == 1 else (sum([g[0] for g in got]), ",".join([g[1] for g in got]), "".join([g[2] for g in got]))
        for p in [p for ps in split for p in ps if len(p) > 48]:
            parts.pop(p, None)
        return _Both(known, rare) if rare else known

    def _learn_parts(self, fresh: list[str]) -> None:
        at, most, spelled = 0, 1 << 19, self.spelled
        while at < len(fresh):  # a slice of so many symbols at a time
            part, n = [], 0
            while at < len(fresh) and (n < most or not part):
                part.append(fresh[at])
                n += len(fresh[at])
                at += 1
            for c, symbols in zip(part, self.merge(part), strict=True):
                ids = self.ids_of(symbols)
                self.parts[c] = (len(ids), ",".join([spelled[i] for i in ids]), self.text_of(ids))

    def text_of(self, ids: list[int]) -> str:
        """Text of ids inside a document: bytes that form no character become U+FFFD each."""
        if not any(map(self.is_byte.__getitem__, ids)):
            return "".join(map(self.piece_text.__getitem__, ids))
        out, run = [], bytearray()

        def flush() -> None:
            raw = bytes(run)
            run.clear()
            while raw:
                try:
                    out.append(raw.decode("utf-8"))
                    return
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode("utf-8") + "�")
                    raw = raw[e.start + 1 :]

        for i in ids:
            if self.is_byte[i]:
                run += self.bytes_of[i]
            else:
                flush()
                out.append(self.piece_text[i])
        flush()
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        known = self.learn([chunks])
        return [int(i) for c in chunks for i in known[c][1].split(",")]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: without the space that stands for the start of the text."""
        text = self.text_of(ids)
        return text[1:] if ids and self.piece_text[ids[0]].startswith(" ") and not self.unknown[ids[0]] else text


class _Both:
    def __init__(self, a: dict, b: dict) -> None:
        self.a, self.b = a, b

    def __getitem__(self, key: str) -> tuple[int, str, str]:
        return self.a[key] if key in self.a else self.b[key]


def codec(model_path: str) -> Codec:
    if model_path not in _CODECS:
        _CODECS[model_path] = Codec(model_path)
    return _CODECS[model_path]


def sentencepiece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model_path)
        docs_chunks = [own.chunks(t) for t in batch.column("text").to_pylist()]
        known = own.learn(docs_chunks)
        n, ids, decoded = [], [], []
        for chunks in docs_chunks:
            got = [known[c] for c in chunks]
            n.append(sum(g[0] for g in got))
            ids.append(hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest())
            decoded.append(hashlib.sha256("".join([g[2] for g in got]).removeprefix(" ").encode("utf-8")).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=1000)


def sentencepiece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model_path)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(id_text(docs, id_col, text_col), run, "doc_id long, ids array<int>", rows=500)


def sentencepiece_decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model_path)
        texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string", rows=500)
