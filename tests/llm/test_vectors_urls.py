"""Whitening, vector codes and URL filters: brute force, hard inputs, invariants."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import embedding_whitening as EW
from tracewright.llm import url_filter as UF
from tracewright.llm import vector_codes as VC
from tracewright.llm._vectors import packed, unpacked

VECTORS = "vec_id long, embedding array<double>, label int, x int, code string, row int, salt int"
BAD = [(900, None), (901, []), (902, [None] + [1.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, [1.0] * 3), (None, None)]


def frame(spark, rows):
    """Vectors with further columns of names that the operators use themselves."""
    return spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], VECTORS)


def sample(seed, n=300, dim=8):
    """Clustered rows with copies, a repeated id, a null id and null labels."""
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (6, dim))[rng.integers(0, 6, n)] * rng.uniform(0.2, 3, dim) + rng.normal(0, 0.3, (n, dim))
    v[n // 2 : n // 2 + n // 3] = v[0]  # a third of all rows
    rows = [(int(i), [float(x) for x in v[i]], int(i) % 3 if i % 5 else None) for i in rng.permutation(n)]
    return [*rows, (0, [0.25] * dim, 1), (None, [-0.5] * dim, 1)]


def whole(rows):
    return np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)


# --- op11 -------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_whitening_against_plain_eigenvectors(spark, seed):
    rows = sample(seed)
    got = EW.whiten(frame(spark, rows + [(i, v, 1) for i, v in BAD])).collect()
    x = whole(rows)
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {len(fit)}
    assert max(r.identity_error for r in got) < 1e-12 and len({r.identity_error for r in got}) == 1
    key = lambda i, d: (i is None, i or 0, d)
    want_dev = ((len(fit) * x - fit.sum(axis=0)) ** 2).sum(axis=1).tolist()
    order = sorted(range(len(rows)), key=lambda k: key(rows[k][0], want_dev[k]))
    for c in range(4):
        own = sorted((r for r in got if r.component == c + 1), key=lambda r: key(r.vec_id, r.deviation))
        assert [(r.vec_id, r.deviation) for r in own] == [(rows[k][0], want_dev[k]) for k in order]
        want = ((x - fit.mean(axis=0)) @ vectors[:, c] / np.sqrt(values[c]))[order]
        z = np.array([r.whitened for r in own])
        assert np.allclose(z * np.sign(z @ want), want, atol=1e-9)
        assert own[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-12)


def test_whitening_of_few_dimensions(spark):
    flat = [(i, [float(i), 2.0 * i, 0.0, 1.0], 0) for i in range(9)]
    got = EW.whiten(frame(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and got[0].explained == pytest.approx(1)
    assert EW.whiten(frame(spark, flat[:1] * 3)).count() == 0  # one different vector has no spread
    assert EW.whiten(frame(spark, [])).count() == 0
    assert EW.whiten(frame(spark, [(i, v, 1) for i, v in BAD if v != [1.0] * 3])).count() == 0
    assert {r.component for r in EW.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 0), (3, [5.0, 5.0], 0)])).collect()} == {1, 2}


def test_deviation_beyond_64_bits_is_null(spark):
    far = [(1, [2.0**30, 0.0], 0), (2, [-(2.0**30), 1.0], 0), (3, [0.5, 2.0], 0)]
    got = {r.vec_id: r.deviation for r in EW.whiten(frame(spark, far), 1).collect()}
    assert got[1] is None and got[2] is None and got[3] is not None


@pytest.mark.parametrize("dim,near", [(3, False), (40, False), (120, False), (120, True)])
def test_lobpcg_finds_certified_pairs(dim, near):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    values = np.sort(rng.uniform(0.1, 9, dim))[::-1]
    if near:
        values[1] = values[0]  # a double eigenvalue
    m, calls = (q * values) @ q.T, []

    def product(w):
        calls.append(w.shape[1])
        assert np.abs(w.T @ w - np.eye(w.shape[1])).max() < 1e-10  # of orthonormal directions
        return m @ w

    got, vectors, norms = EW.lobpcg(product, dim, 4)
    assert np.allclose(got, values[:4], rtol=1e-12) and (norms <= EW.TOLERANCE * values[0]).all()
    assert np.abs(m @ vectors - vectors * got).max() < 1e-11
    assert max(calls) <= 3 * (4 + EW.GUARDS) and len(calls) < 200


def test_rows_as_bytes():
    x = np.array([[1, -2], [40_000, 3], [2**40, -1], [1, -2], [0, 0]], np.int64)
    rows = packed(x)
    assert rows[0] == rows[3] and [len(r) for r in rows] == [4, 8, 16, 4, 4]
    assert sorted(map(tuple, unpacked(rows, 2).tolist())) == sorted(map(tuple, x.tolist()))


# --- op12 -------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, whole([rows[k]])[0].tolist()))
    x = [[int(c) for c in v] for v in whole(rows)]
    sub = len(x[0]) // parts
    cut = [[v[p * sub : p * sub + sub] for p in range(parts)] for v in x]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda v: [min(range(len(books[p])), key=lambda e: (apart(v[p], books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        codes = [near(v) for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(cut, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    codes = [near(v) for v in cut]
    errors = [sum(apart(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes, strict=True)]
    per = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        per[label] = per.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e in c), err, per[label], sha) for (i, _, label), c, err in zip(rows, codes, errors, strict=True)]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("parts,entries,small", [(4, 16, True), (2, 64, True), (8, 5, False)])
def test_codes_against_brute_force(spark, parts, entries, small, monkeypatch):
    if not small:
        monkeypatch.setattr(VC, "small_enough", lambda *a: False)  # labels dealt over salts
    rows = sample(parts)
    df = frame(spark, rows + [(i, v, 1) for i, v in BAD]).repartition(5)
    got = VC.compress_vectors(df, parts, entries, 2)
    assert by_id(got.collect()) == by_id(brute_codes(rows, parts, entries, 2))


def test_codes_of_few_rows(spark):
    rows = sample(7, 12)[:5]
    assert by_id(VC.compress_vectors(frame(spark, rows), 4, 64).collect()) == by_id(brute_codes(rows, 4, 64, 2))
    assert VC.compress_vectors(frame(spark, [])).count() == 0
    assert VC.compress_vectors(frame(spark, [(1, [1.0] * 3, 0)]), 2).count() == 0  # no length that can be cut in two
    assert VC.compress_vectors(frame(spark, []).limit(0)).columns == VC.compress_vectors(frame(spark, rows), 4).columns
    with pytest.raises(ValueError):
        VC.compress_vectors(frame(spark, rows), 4, 257)


def test_codes_of_large_numbers():
    books = np.array([[[0], [2**29]]])
    codes, far = VC.nearest(np.array([[2**30, -(2**30), 2**28]]), books)
    assert codes.tolist() == [[1, 0, 0]] and far.tolist() == [[2**58, 2**60, 2**56]]


# --- op13 -------------------------------------------------------------------------------


PAGES = "page_id long, url string, html string, host string, row int, key string, owner string"
HARD_URLS = [
    None, "", "no scheme at all", "://", "http://", "http://NET", "http://net/", "https://a.NET/x", "http://anet/x", "http://.net/x", "http://net?x/", "http://net#/", "//a.net/", "ftp://u@a.net:80/x",
    "http://example.net/en/", "http://example.net/en", "http://example.net/EN/", "http://www.example.net/en/1?utm_source=a&b=2&a=1#f", "HTTPS://example.net:443/en/1?a=1&b=2", "http://x.example.com/de/", "http://example.com/dex",
    "http://example.org/fr/5", "http://example.org/fr/5/", "https://www.example.org/fr/5?ref=x", "http://example.org/es/5", "http://example.org/es/5?page=2&ref=x", "https://example.org/es/5//?page=2", "http://a..org/fr/", "http://é.org/fr/ü?ä", "http://org/fr/x\ny", "http://x.org://a.net/", "http://" + "a." * 40_000 + "net/" + "p/" * 40_000,
]


def page_frame(spark, rows):
    return spark.createDataFrame([(i, u, "h", "x", 1, "k", "o") for i, u in rows], PAGES)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(url, rules):
    """(rule, verdict) of the longest rule that fits, or (None, None)."""
    host, path = plain_parts(url)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, None)


def test_urls_against_plain_rules(spark):
    rows = [*enumerate(HARD_URLS), (None, "http://a.net/1"), (6, "http://net/"), (6, "http://net/")]
    df = page_frame(spark, rows)
    got = UF.filter_urls(df, UF.rules_frame(spark), UF.repeated_addresses(df)).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = [(i, *plain_parts(u), plain_rule(u, UF.RULES)[0]) for i, u in rows]
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in got], key=key) == sorted(want, key=key)
    by_row = {r.page_id: r for r in got}
    for i, u in enumerate(HARD_URLS):
        if verdict := plain_rule(u, UF.RULES)[1]:
            assert by_row[i].verdict == verdict
    at = {u: by_row[i] for i, u in enumerate(HARD_URLS)}
    assert at["http://example.org/es/5"].verdict == at["http://example.org/es/5?page=2&ref=x"].verdict == "allow"
    again = at["https://example.org/es/5//?page=2"]  # the second spelling of an address
    assert again.address == "example.org/es/5?page=2" and again.verdict == "block" and again.rule is None
    assert at["http://www.example.net/en/1?utm_source=a&b=2&a=1#f"].address == at["HTTPS://example.net:443/en/1?a=1&b=2"].address == "example.net/en/1?a=1&b=2"
    assert at[None].verdict == at[""].verdict == "allow" and at[None].address is None
    empty = page_frame(spark, [])
    assert UF.filter_urls(empty, UF.rules_frame(spark), UF.repeated_addresses(empty)).count() == 0
    assert {r.verdict for r in UF.filter_urls(df, UF.rules_frame(spark).limit(0), UF.repeated_addresses(df).limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("small", (True, False))  # both ways: verified keys broadcast, and dealt over salts
def test_urls_against_many_rules(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(UF, "small_enough", lambda *a: False)
    rng = random.Random(5)
    label = lambda: rng.choice("abcd")
    rules = [(rng.choice(("block", "allow")), ".".join(label() for _ in range(rng.randint(1, 3))), "".join(f"/{label()}" for _ in range(rng.randint(0, 2)))) for _ in range(150)]
    rules += [("block", "a", "/a"), ("allow", "a", "/a"), ("block", "a.a", ""), ("allow", "a", "/a/")]
    urls = [f"http://{'.'.join(label() for _ in range(rng.randint(1, 4)))}{''.join('/' + label() for _ in range(rng.randint(0, 4)))}" for _ in range(700)]
    urls += ["http://a.a/a/a"] * 300  # a hot address
    df = page_frame(spark, list(enumerate(urls)))
    listed = UF.repeated_addresses(df)
    got = {r.page_id: r for r in UF.filter_urls(df, UF.rules_frame(spark, tuple(rules)), listed).collect()}
    first = {}
    for i, u in enumerate(urls):
        first.setdefault(u.removeprefix("http://"), i)
    for i, u in enumerate(urls):
        rule, verdict = plain_rule(u, rules)
        assert got[i].rule == rule
        assert got[i].verdict == (verdict or ("allow" if first[u.removeprefix("http://")] == i else "block"))


def test_filter_misses_nothing_and_passes_little(spark):
    own = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    other = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    for blocks, most in ((20_000 * UF.BITS_A_KEY // 512, 0.01), (40, 1.0)):  # as built, and crowded
        bloom = UF.bloom_filter(own, blocks)
        assert bloom.count() <= blocks
        assert UF.possible_hits(own, bloom, blocks).count() == 20_000
        assert UF.possible_hits(other, bloom, blocks).count() <= most * 20_000


def test_a_crowded_filter_changes_nothing(spark, monkeypatch):
    df = page_frame(spark, [(i, f"http://h{i % 7}.org/p{i % 50}") for i in range(200)])
    ask = lambda: sorted(map(tuple, UF.filter_urls(df, UF.rules_frame(spark), UF.repeated_addresses(df)).collect()))
    whole_filter = ask()
    monkeypatch.setattr(UF, "BLOCKS", 1)
    assert ask() == whole_filter


def test_no_python_on_the_main_path(spark):
    df = page_frame(spark, [(1, "http://a.net/x")])
    plan = UF.filter_urls(df, UF.rules_frame(spark), UF.repeated_addresses(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
