"""What each filter of the license scan leaves out, and that nothing is lost by it."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewright.llm import license_scan as LS


def texts(seed, n=60):
    """Prose with words of the templates all over, single sentences in part, and whole notices."""
    rng = random.Random(seed)
    common = [w for _, ws in LS.TEMPLATES for w in ws]
    filler = [f"w{i}" for i in range(60)] + rng.sample(common, 40)
    out = []
    for i in range(n):
        words = rng.choices(filler, k=rng.randint(0, 900))
        for _ in range(rng.randint(0, 2)):
            _, notice = rng.choice(LS.TEMPLATES)
            part = [w for w in notice if rng.random() < rng.choice((0.5, 0.78, 0.84, 1.0))]
            at = rng.randint(0, len(words))
            words[at:at] = part
        out.append((i, rng.choice((" ", "\n", ", ")).join(words)))
    return out


@pytest.mark.parametrize("seed,threshold,whole_below", [(1, 0.8, 15), (2, 0.8, 0), (3, 0.6, 0)])
def test_filters_leave_out_and_lose_nothing(spark, seed, threshold, whole_below):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = LS._words(df, "doc_id", "text")
    index = LS.ranked(words, threshold, whole_below)
    scanned = LS.cut(LS._scanned(words, index).withColumn("row", F.monotonically_increasing_id()))
    every = LS.candidates(scanned, index, F.lit(True))
    rare = LS.candidates(scanned, index, LS.in_prefix())
    with_prefix = LS.cut(LS.bounded(scanned, index, rare))
    without = LS.cut(LS.bounded(scanned, index, every.withColumn("rarest", F.lit(0))))
    n_every, n_rare, n_bound, n_free = every.count(), rare.count(), with_prefix.count(), without.count()
    assert n_rare < 0.8 * n_every  # the prefix filter leaves out stretches,
    assert n_bound < 0.8 * n_rare and n_bound <= n_free  # the positional bound leaves out more, before any block is verified
    found = lambda blocks: {(r.row, r.label, round(r.share, 9)) for r in LS.verified(blocks).groupBy("row", "label").agg(F.max("share").alias("share")).collect()}
    assert found(with_prefix) == found(without) and found(with_prefix)


@pytest.mark.parametrize("seed,threshold,whole_below", [(4, 0.8, 15), (5, 0.8, 0), (6, 0.5, 0)])
def test_shares_against_brute_force(spark, seed, threshold, whole_below):
    rows = texts(seed, 25)
    got = {r.doc_id: r for r in LS.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), threshold, whole_below).collect()}
    for i, text in rows:
        words = LS.re.findall(r"[a-z0-9]+", text.lower())
        best, labels = 0.0, set()
        for label, notice in LS.TEMPLATES:
            own = set(notice)
            need = len(own) if len(own) < whole_below else -(-round(threshold * len(own) * 1000) // 1000)
            for at in range(len(words)):
                n = len(own & set(words[at : at + LS.run_length(len(notice))]))
                if n >= need:
                    best, labels = max(best, n / len(own)), labels | {label}
        named = set(got[i].base_labels.split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == labels | named
        assert got[i].score == pytest.approx(1.0 if named else best)


def test_rarest_words_come_first(spark):
    rows = [(i, "software the license " + "granted " * (i % 2)) for i in range(20)]
    index = LS.ranked(LS._words(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")).collect()
    for t in {r.template for r in index}:
        own = [r.word for r in sorted((r for r in index if r.template == t), key=lambda r: r.rank)]
        seen = [w for w in own if w in ("granted", "the", "software", "license")]
        assert own[len(own) - len(seen) :] == seen and (not {"granted", "the"} <= set(seen) or seen.index("granted") < seen.index("the"))


def test_a_megabyte_of_one_license(spark):
    """In proportion to the text, in whichever task it falls."""
    text = next(t for label, t in LS.NOTICES if label == "mit" and len(t) > 900)
    big = (text + "\n") * (1_000_000 // len(text))
    df = spark.createDataFrame([(1, big), (2, text)], "doc_id long, text string").coalesce(1)
    LS.license_scan(df.limit(0)).count()
    began = time.perf_counter()
    got = {r.doc_id: r for r in LS.license_scan(df).collect()}
    assert time.perf_counter() - began < 15
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[2].score == 1.0
