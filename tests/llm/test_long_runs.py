"""Very long texts of long runs: equal to the libraries, and within seconds."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tracewright.llm import best_fit_packing as B
from tracewright.llm import sentencepiece_codec as SP
from tracewright.llm.queries import tokenizer_file

N, RNG = 2_000_000, random.Random(1)
TEXTS = {
    "spaces": " " * N,
    "spaces inside": "ab" + " " * N + "x y",
    "line ends": "\n" * N,
    "both": " \n" * (N // 2),
    "mixed": "".join(RNG.choices(" \n\t\r 　", k=N // 2)) + "end",
    "separators": "x" + "\x1c\x1f" * 10_000 + " y",
    "one letter": "a" * 300_000,
    "letters": "".join(RNG.choices("abcdefgh", k=300_000)),
    "syllables": "ha" * 100_000,
    "signs": "x" + "=" * 300_000 + "y",
    "runs and words": ("word" + " " * 5_000) * 40 + " " * 5_001,
}


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


@pytest.mark.parametrize("name", TEXTS)
def test_long_runs_equal_the_libraries(libraries, name):
    text, began = TEXTS[name], time.perf_counter()
    ids = B.tokens(tokenizer_file("byte_bpe_50k.json")).ids([text])[0]
    codec = SP.codec(tokenizer_file("piece_bpe_32k.model"))
    pieces = codec.encode(text)
    assert time.perf_counter() - began < 30
    assert ids.tolist() == libraries[0].encode(text, add_special_tokens=False).ids
    assert pieces == libraries[1].encode(text)
    assert codec.decode(pieces) == libraries[1].decode(pieces)


@pytest.mark.parametrize("seed", range(6))
def test_runs_in_closed_form_and_by_agenda(libraries, seed, monkeypatch):
    """Short and long words take the same way, whatever the limits are."""
    rng = random.Random(seed)
    monkeypatch.setattr(SP, "ROUNDS_UP_TO", (0, 5, 60)[seed % 3])
    monkeypatch.setattr(SP, "RUN", 1)
    codec = SP.Codec(tokenizer_file("piece_bpe_32k.model"))
    for _ in range(60):
        text = "".join(rng.choice((" ", "=", "-", "a", "the", "1", ".", "é", "\n", "▁", "ing")) * rng.choice((1, 1, 2, 7, 40, 90, 300)) for _ in range(rng.randint(1, 12)))
        assert codec.encode(text) == libraries[1].encode(text), repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_white_space_is_cut_as_the_pattern_cuts(libraries, seed, monkeypatch):
    import re

    rng = random.Random(seed)
    monkeypatch.setattr(B, "LONG_SPACE", re.compile(B.LONG_SPACE.pattern.replace("4096", "2")))
    own = B.tokens(tokenizer_file("byte_bpe_50k.json"))
    for _ in range(300):
        text = "".join(rng.choice((" ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "a", "'s", "12", "!", "é")) for _ in range(rng.randint(0, 14)))
        assert own.ids([text])[0].tolist() == libraries[0].encode(text, add_special_tokens=False).ids, repr(text)


def test_operators_on_long_runs(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS.values()) if len(t) <= N]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digests = {r.doc_id: r for r in SP.sentencepiece_digests(df, tokenizer_file("piece_bpe_32k.model")).collect()}
    pieces: dict = {}
    for r in B.token_pieces(df, tokenizer_file("byte_bpe_50k.json")).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        ids = libraries[1].encode(text)
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(libraries[1].decode(ids).encode()).hexdigest()
        every = np.array([*libraries[0].encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert sum(r.length for r in pieces[i]) == len(every)
        assert all(r.ids_crc32 == zlib.crc32(every[r.start : r.start + r.length].tobytes()) for r in pieces[i])


LONG_DOCS = [
    (1, " " * 1_000_000, "en", "a"),
    (2, "\n" * 1_000_000, "en", "b"),
    (3, "a" * 1_000_000, "de", "a"),
    (4, "word " * 250_000, "en", "c"),
    (5, " \n\t" * 300_000 + "end of it password = hunter2secret", "fr", "d"),
    (6, "A" * 600_000 + "==", "en", "e"),
    (7, "mit license " * 90_000, "en", "f"),
    (8, "<p>&amp;</p>%20\\n" * 60_000, "es", "g"),
    (9, "a short text of a few words", "en", "h"),
]


@pytest.fixture
def long_docs(spark):
    return spark.createDataFrame([(i, t, lang, src, len(t)) for i, t, lang, src in LONG_DOCS], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op5", "op6", "op9", "redacted"])
def test_every_operator_on_very_long_texts(spark, long_docs, name):
    from tracewright.llm import language_id, license_scan, line_dedup, ngram_jaccard_join, secret_scan
    from tracewright.llm.exact_dedup import exact_dedup

    operators = {
        "op1": ngram_jaccard_join.ngram_jaccard_join,
        "op3": language_id.language_id,
        "op4": exact_dedup,
        "op5": secret_scan.scan_secrets,
        "op6": license_scan.license_scan,
        "op9": line_dedup.line_dedup_report,
        "redacted": secret_scan.redact_secrets,
    }
    began = time.perf_counter()
    got = {r.doc_id: r for r in operators[name](long_docs).collect()}
    assert time.perf_counter() - began < 120
    assert set(got) == {i for i, *_ in LONG_DOCS}
    if name == "op1":
        assert {i: r.n_shingles for i, r in got.items()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 1, 7: 2, 8: 1, 9: 3}
    if name == "op5":
        assert [i for i, r in got.items() if r.n_assign] == [5] and not got[1].spans
    if name == "op6":
        assert got[7].n_base == 90_000 and got[4].n_words == 250_000 and got[1].n_words == 0
    if name == "redacted":
        assert got[5].text.endswith("[secret]") and got[1].text == LONG_DOCS[0][1]


def test_every_stage_on_very_long_texts(spark, long_docs, tmp_path):
    import corpus_pipeline

    rows = [(i, i % 2, 0) for i, *_ in LONG_DOCS]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    began = time.perf_counter()
    for name, stage in corpus_pipeline.STAGES:  # each on all documents, whatever the one before leaves
        assert stage(spark, long_docs, str(tmp_path)).count() >= (len(LONG_DOCS) if name in ("secrets", "packing") else 0)
    assert time.perf_counter() - began < 240
