"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of labelled
texts: of the windows of all whole texts that may be learned from, a bounded number of each
language, drawn by a hash (``SAMPLE_WINDOWS``). To predict, every whole text is cut into
windows of ``WINDOW`` bytes; a forward and a backward pass label every position, and the
position probabilities are pooled to one distribution per document.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for
all texts where no row can be learned from; null ids are predicted, and learned from (they
are not held out); rows that repeat each count; a very long text is read to its end;
equally likely languages go to the first in order of their names; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._common import held_out, map_batches

WINDOW = 96
#: Windows of each language that training sees at most.
SAMPLE_WINDOWS = 2000
_PAD = 256


@dataclass
class Network:
    """Weights of both directions stacked on the first axis; update and reset gates come halved, for tanh."""

    langs: list[str]
    inputs: np.ndarray  # (2, 257, 3h)
    recur: np.ndarray  # (2, h, 3h)
    out: np.ndarray  # (2h, k)
    bias: np.ndarray  # (k,)

    def states(self, codes: np.ndarray) -> np.ndarray:
        """(window length, 2, windows, h): states of both directions in reading order."""
        n, t = codes.shape
        h = self.recur.shape[1]
        both = np.stack([codes, codes[:, ::-1]])  # the second direction reads backwards
        state = np.zeros((2, n, h), np.float32)
        out = np.empty((t, 2, n, h), np.float32)
        gates, new = self.recur[:, :, : 2 * h], self.recur[:, :, 2 * h :]
        for i in range(t):
            x = np.stack([self.inputs[0].take(both[0, :, i], axis=0), self.inputs[1].take(both[1, :, i], axis=0)])
            zr = 0.5 + 0.5 * np.tanh(x[:, :, : 2 * h] + state @ gates)
            cand = np.tanh(x[:, :, 2 * h :] + (zr[:, :, h:] * state) @ new)
            state = state + zr[:, :, :h] * (cand - state)
            out[i, 0], out[t - 1 - i, 1] = state[0], state[1]
        return out

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """(windows, window length, languages): probabilities at every position."""
        s = self.states(codes)
        h = self.recur.shape[1]
        logits = s[:, 0] @ self.out[:h] + s[:, 1] @ self.out[h:] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        return (p / p.sum(axis=2, keepdims=True)).transpose(1, 0, 2)


def windows(raw: bytes) -> np.ndarray:
    """All bytes of a text as rows of ``WINDOW`` codes, the last one padded."""
    n = -(-len(raw) // WINDOW)
    codes = np.full(n * WINDOW, _PAD, np.int16)
    codes[: len(raw)] = np.frombuffer(raw, np.uint8)
    return codes.reshape(n, WINDOW)


def fit(sample: list[tuple[np.ndarray, str]], hidden: int = 8, steps: int = 240, batch: int = 256, seed: int = 7) -> Network | None:
    """From (window, language) pairs, by Adam on windows drawn equally from the languages."""
    langs = sorted({lang for _, lang in sample})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    per = [np.stack([w for w, lang in sample if lang == x]) for x in langs]
    k, h = len(langs), hidden
    w = {
        "inputs": rng.normal(0, 0.3, (2, 257, 3 * h)),
        "recur": rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)),
        "out": rng.normal(0, 0.3, (2 * h, k)),
        "bias": np.zeros(k),
    }
    w = {n: v.astype(np.float32) for n, v in w.items()}
    first, second = {n: np.zeros_like(v) for n, v in w.items()}, {n: np.zeros_like(v) for n, v in w.items()}
    for step in range(1, steps + 1):
        label = rng.integers(0, k, batch)
        codes = np.stack([per[y][rng.integers(0, len(per[y]))] for y in label])
        grad = _gradients(w, codes, label)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for n, g in grad.items():
            g = np.clip(g, -1, 1)
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g * g
            w[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-6)
    return Network(langs, w["inputs"], w["recur"], w["out"], w["bias"])


def _gradients(w: dict[str, np.ndarray], codes: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy of all positions that are no padding, by backpropagation through time."""
    n, t = codes.shape
    h = w["recur"].shape[1]
    both = np.stack([codes, codes[:, ::-1]])
    gates, new = w["recur"][:, :, : 2 * h], w["recur"][:, :, 2 * h :]
    states, kept = [np.zeros((2, n, h), np.float32)], []
    for i in range(t):
        x = np.stack([w["inputs"][d][both[d, :, i]] for d in (0, 1)])
        zr = 0.5 + 0.5 * np.tanh(x[:, :, : 2 * h] + states[-1] @ gates)
        cand = np.tanh(x[:, :, 2 * h :] + (zr[:, :, h:] * states[-1]) @ new)
        kept.append((zr, cand))
        states.append(states[-1] + zr[:, :, :h] * (cand - states[-1]))
    s = np.stack(states[1:])  # (t, 2, n, h) in the order of each direction
    forward, backward = s[:, 0], s[::-1, 1]
    logits = forward @ w["out"][:h] + backward @ w["out"][h:] + w["bias"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    real = (codes.T != _PAD).astype(np.float32)
    p[:, np.arange(n), label] -= 1
    p *= (real / max(real.sum(), 1))[:, :, None]
    grad = {m: np.zeros_like(v) for m, v in w.items()}
    grad["bias"] = p.sum(axis=(0, 1))
    grad["out"][:h] = np.einsum("tnh,tnk->hk", forward, p)
    grad["out"][h:] = np.einsum("tnh,tnk->hk", backward, p)
    ds = np.stack([p @ w["out"][:h].T, (p @ w["out"][h:].T)[::-1]], axis=1)  # (t, 2, n, h)
    carry = np.zeros((2, n, h), np.float32)
    for i in range(t - 1, -1, -1):
        g, (zr, cand), before = carry + ds[i], kept[i], states[i]
        z, r = zr[:, :, :h], zr[:, :, h:]
        dc = g * z * (1 - cand * cand)
        dz = g * (cand - before)
        drs = dc @ new.transpose(0, 2, 1)
        dzr = np.concatenate([dz, drs * before], axis=2) * 2 * zr * (1 - zr)
        carry = g * (1 - z) + drs * r + dzr @ gates.transpose(0, 2, 1)
        dx = np.concatenate([dzr, dc], axis=2)
        grad["recur"][:, :, : 2 * h] += before.transpose(0, 2, 1) @ dzr
        grad["recur"][:, :, 2 * h :] += (r * before).transpose(0, 2, 1) @ dc
        for d in (0, 1):
            np.add.at(grad["inputs"][d], both[d, :, i], dx[d])
    return grad


def training_windows(docs: DataFrame, most: int = SAMPLE_WINDOWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[np.ndarray, str]]:
    """(window, language): of each language the ``most`` windows with the smallest hashes, from all whole texts that may be learned from.

    A first pass counts each language's windows; in the second one, only about three times
    as many as are wanted leave the tasks, however large the table.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & ~held_out(F.col(id_col)))
    rows = known.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("place"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("n")).collect()
    limit = {r["lang"]: np.uint64(min(2**64 - 1, 3 * most * 2**64 // r["n"])) for r in counted}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        for place, text, lang in zip(*(batch.column(c).to_pylist() for c in ("place", "text", "lang")), strict=True):
            raw = text.encode("utf-8", "replace")
            hashes = _mix(np.uint64(place % 2**64) + np.arange(1, -(-len(raw) // WINDOW) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            if len(drawn := np.flatnonzero(hashes <= limit[lang])):
                out[0].extend([lang] * len(drawn))
                out[1].extend((hashes[drawn] >> np.uint64(1)).tolist())
                out[2].extend(c.tobytes() for c in windows(raw)[drawn])
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["lang", "place", "codes"])

    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "codes"))
    kept = map_batches(rows, run, "lang string, place long, codes binary", rows=500).withColumn("nth", nth).filter(F.col("nth") <= most).orderBy("lang", "nth")
    return [(np.frombuffer(r["codes"], np.int16), r["lang"]) for r in kept.collect()]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def identify_languages(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        wanted = [i for i, t in enumerate(texts) if network and t and any(map(str.isalpha, t))]
        if wanted:
            rows = [windows(texts[i].encode("utf-8", "replace")) for i in wanted]
            codes, owner = np.concatenate(rows), np.repeat(np.arange(len(wanted)), [len(r) for r in rows])
            pooled = np.zeros((len(wanted), len(network.langs)))
            for at in range(0, len(codes), block):
                part = codes[at : at + block]
                p = network.positions(part) * (part != _PAD)[:, :, None]
                np.add.at(pooled, owner[at : at + block], p.sum(axis=1, dtype=np.float64))
            pooled /= pooled.sum(axis=1, keepdims=True)
            for i, p in zip(wanted, pooled, strict=True):
                langs[i], scores[i] = network.langs[int(p.argmax())], float(min(1.0, p.max()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = map_batches(rows, run, "doc_id long, lang_pred string, score double", rows=500)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return identify_languages(docs, fit(training_windows(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)), id_col, text_col)
