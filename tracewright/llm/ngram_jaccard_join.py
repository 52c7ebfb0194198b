"""N-gram Jaccard join by vertical partitioning.

Sets of distinct 5-word shingles link when their Jaccard similarity is at least 0.8; the
result gives every document the smallest id of its connected component. Steps:

1. Equal sets are one class from the start, whatever their number.
2. An exact filter on a part of each set: of two linked sets, the first tokens in hash
   order share at least a known number. Sets whose tokens there are mostly their own
   leave; all later steps are on the few that remain.
3. A global order of the remaining tokens, rarest first, and its cut into fragments:
   every set becomes a few segments. A linked pair shares a token of its two prefixes.
4. Candidate pairs never come from whole posting lists at once. In the first rounds each
   list only pairs its members with its most central one (near copies mostly meet in it);
   components grow, and pairs inside a component need no check. The last round pairs
   whatever shares a prefix token across components, so no link between components is lost.
5. A pair's overlap is counted in every fragment apart and summed; the sum decides.
6. Components by hooking and pointer jumping, the least set of each as its root.

A token is known by a 64-bit hash, a set by two: where two sets agree in the first one and
not in the second, which is looked for, they go by the second.

Defined results: null and empty texts, and those without words, have size 0 and link with
nothing; one to four words make one shingle; a very long text is one set, made in parts;
null ids take part but never name a component (null where no other id is in it); repeated
rows are equal sets; a similarity of just the threshold links; other columns, whatever their
names, are ignored (and kept by ``one_of_each_group``); empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm._common import cut, id_text, settled, slices, small_enough, unused

WORDS = 5
#: Linked: PERCENT * size of the intersection's share of the union.
PERCENT = 80
#: Share of a set's tokens that the filter of step 2 looks at beyond the plain prefix.
EXTRA = 0.1
#: Where the fragments of the global order end: at tokens of so many sets; one more takes the rest.
TOPS = (2, 4, 8, 16, 32, 64, 128)
FRAGMENTS = len(TOPS) + 1
_SLICE = 1 << 21  # bytes of text handled at once
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _shingles(raw: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line number, hash) of every shingle of the lines of ``raw``, whose words are single-spaced."""
    codes = np.frombuffer(raw, np.uint8)
    ends = np.append(np.flatnonzero((codes == 32) | (codes == 10)), len(codes))
    starts = np.append(0, ends[:-1] + 1)
    line = np.append(0, np.cumsum(codes[ends[:-1]] == 10))
    real = ends > starts
    starts, ends, line = starts[real], ends[real], line[real]
    if not len(starts):
        return line, np.zeros(0, np.uint64)
    count = np.bincount(line)
    nth = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    own = count[line]
    begins = np.flatnonzero((nth + k <= own) | ((own < k) & (nth == 0)))
    last = np.minimum(begins + k - 1, begins + own[begins] - 1)
    s, e = starts[begins], ends[last]
    sums = np.append(np.uint64(0), np.cumsum(_VALUES[codes] * _powers(_BASE, len(codes))[:-1]))
    value = (sums[e] - sums[s]) * _powers(_INVERSE, len(codes))[s]
    return line[begins], _mix(value + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[str], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        line, value = _shingles(b"\n".join([r for _, r in held]), k)
        order = np.lexsort((value, line))
        line, value = line[order], value[order]
        fresh = np.append(True, (line[1:] != line[:-1]) | (value[1:] != value[:-1]))[: len(line)]
        line, value = line[fresh], value[fresh]
        bounds = np.searchsorted(line, np.arange(len(held) + 1))
        for j, (i, _) in enumerate(held):
            own = value[bounds[j] : bounds[j + 1]]
            out[i] = own if not len(out[i]) else np.union1d(out[i], own)
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z, and only \x20 and \x09-\x0d
        step = 200_000
        for at in range(0, max(1, len(words) - k + 1), step):  # parts of a very long text overlap by k - 1 words
            part = b" ".join(words[at : at + step + k - 1])
            held.append((i, part))
            size += len(part) + 1
            if size >= _SLICE:
                flush()
                size = 0
    if held:
        flush()
    return out


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit identities of a set."""
    sums = [_mix(tokens ^ np.uint64(c)).sum(dtype=np.uint64) for c in (0x5851F42D4C957F2D, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    parts = np.array([len(tokens), tokens.sum(dtype=np.uint64), *sums], np.uint64)
    mixed = _mix(_mix(parts + np.arange(1, 6, dtype=np.uint64)).cumsum(dtype=np.uint64)).view(np.int64)
    return int(mixed[2]), int(mixed[4])


def least_overlap(n: int, percent: int) -> int:
    """A set of ``n`` tokens shares at least so many with any that it links with."""
    return -(-percent * n // 100)


def filter_sizes(n: int, percent: int, extra: float) -> tuple[int, int]:
    """How many first tokens of a set of ``n`` to look at, and how many of them a linked set has among its own."""
    k = max(1, int(extra * n))
    k_other = max(1, int(extra * least_overlap(n, percent)))  # a smaller linked set looks at fewer
    return n - least_overlap(n, percent) + k, min(k, k_other)


def _batches(docs: DataFrame, make, schema: str, names: list[str], slice_rows: int = 1000) -> DataFrame:
    def run(batches):
        seen: set = set()
        for batch in batches:
            for part in slices(batch, slice_rows):
                if len(seen) > 1_000_000:
                    seen.clear()
                yield from (pa.RecordBatch.from_arrays(arrays, names) for arrays in make(part, seen) if len(arrays[0]))

    return docs.mapInArrow(run, schema)


def memberships(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, extra: float = EXTRA) -> DataFrame:
    """(doc_id, n, s, s2, looked_at array<long>): size, keys and first tokens (step 2) of every document's set.

    Within a task only the first of equal sets carries its tokens. A ``text_hash`` of ``docs`` is kept.
    """
    kept = [c for c in docs.columns if c == "text_hash"]

    def make(part, seen):
        sets = shingle_sets(part.column("text").to_pylist(), k)
        keys = [set_key(x) for x in sets]
        first = []
        for key, tokens in zip(keys, sets, strict=True):
            fresh = len(tokens) > 0 and key not in seen
            seen.add(key)
            first.append(tokens[: filter_sizes(len(tokens), percent, extra)[0]].view(np.int64) if fresh else None)
        both = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
        yield [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), *both, pa.array(first, pa.list_(pa.int64())), *(part.column(c) for c in kept)]

    return _batches(docs, make, ", ".join(["doc_id long, n long, s long, s2 long, looked_at array<long>", *(f"{c} long" for c in kept)]), ["doc_id", "n", "s", "s2", "looked_at", *kept])


def clashes(members: DataFrame) -> frozenset[int]:
    """First keys that different sets have in common: of n sets about n * n / 2^65, so three of ten thousand million."""
    both = members.filter("n > 0").groupBy("s").agg(F.min("s2").alias("lo"), F.max("s2").alias("hi")).filter("lo != hi")
    return frozenset(r["s"] for r in both.select("s").collect())


def _tokens(docs: DataFrame, k: int, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(s, token) of distinct sets. Sets repeat in different tasks only."""

    def make(part, seen):
        keys, parts = [], []
        for tokens in shingle_sets(part.column("text").to_pylist(), k):
            if len(tokens) and (key := set_key(tokens)) not in seen:
                seen.add(key)
                keys.append(key[1] if key[0] in clashing else key[0])
                parts.append(tokens)
        if keys:
            each = [len(p) for p in parts]
            yield [pa.array(np.repeat(keys, each), pa.int64()), pa.array(np.concatenate(parts).view(np.int64))]

    return _batches(docs, make, "s long, token long", ["s", "token"])


def surviving_sets(members: DataFrame, percent: int = PERCENT, extra: float = EXTRA) -> DataFrame:
    """(s): the sets that step 2 leaves, exact in that no linked set goes."""
    looked_at = members.select("s", F.explode("looked_at").alias("token"))
    # a token of two different sets: smallest and largest key differ. Aggregated before the
    # shuffle, a token in a third of all sets is a row a task; the join splits its rows (AQE)
    several = looked_at.groupBy("token").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter("lo != hi").select("token")
    shared = looked_at.join(several, "token", "left_semi").groupBy("s").agg(F.count("*").alias("shared")).join(_sizes(members), "s")
    least = F.ceil(F.col("n") * percent / 100)
    needed = F.greatest(F.lit(1), F.least(F.floor(F.col("n") * extra), F.floor(least * extra)))
    return shared.filter(F.col("shared") >= needed - 1e-9).select("s")


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("s").agg(F.min("n").alias("n"))


def _up_to(top: int) -> Column:
    # a second parameter of the lambda, even one with a default, would be given the place in the array
    return F.size(F.filter("x", lambda t: t["df"] <= top))


def ordered_sets(docs: DataFrame, members: DataFrame, survivors: DataFrame, k: int = WORDS, percent: int = PERCENT, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(s, n, own, central, tokens array<long>, ends array<int>): tokens of two sets or more, rarest first.

    ``own`` counts the tokens of this set alone, which come first in the global order;
    ``ends`` says where each fragment of ``tokens`` ends.
    """
    keyed = members.join(F.broadcast(survivors) if small_enough(survivors, 16) else survivors, "s", "left_semi")
    wanted = keyed.groupBy("s").agg(F.min("doc_id").alias("wanted_id")).select("wanted_id").distinct()
    if small_enough(wanted, 16):
        wanted = F.broadcast(wanted)
    rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    every = _tokens(rows, k, clashing)
    common = every.join(every.groupBy("token").agg(F.count("*").cast("int").alias("df")).filter("df > 1"), "token")
    sets = common.groupBy("s").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("x")).join(_sizes(members), "s")
    sets = sets.filter(F.size("x") >= F.ceil(F.col("n") * percent / 100).cast("int"))
    ends = F.array(*[_up_to(top) for top in TOPS], F.size("x"))
    weight = F.aggregate("x", F.lit(0.0), lambda acc, t: acc + F.log2(t["df"]))
    return sets.select("s", "n", (F.col("n") - F.size("x")).cast("int").alias("own"), (weight / F.col("n")).alias("central"), F.col("x.token").alias("tokens"), ends.alias("ends"))


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, s, n, at, central): posting of each prefix token, ``at`` its place in the global order of its set."""
    size = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("own")).cast("int")
    some = sets.withColumn("size", size).filter("size > 0")
    return some.select("s", "n", "own", "central", F.posexplode(F.slice("tokens", 1, F.col("size"))).alias("i", "token")).select("token", "s", "n", (F.col("own") + F.col("i")).alias("at"), "central")


def segments(sets: DataFrame) -> DataFrame:
    """(s, fragment, part array<long>): the vertical partitions."""
    begin = lambda f: F.when(f == 0, F.lit(0)).otherwise(F.get(F.col("ends"), f - 1))
    cut_up = F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda f: F.struct(f.alias("fragment"), F.slice(F.col("tokens"), begin(f) + 1, F.get(F.col("ends"), f) - begin(f)).alias("part")))
    return sets.select("s", F.explode(cut_up).alias("x")).select("s", "x.fragment", "x.part").filter(F.size("part") > 0)


def verified(pairs: DataFrame, parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, na, b, nb), the linked ones: overlaps of the fragments, counted apart and summed."""
    pairs = cut(pairs)
    few = small_enough(pairs, 40)
    met = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    parts = parts.join(F.broadcast(met) if few else met, "s", "left_semi")  # most sets meet no one
    left = parts.select(F.col("s").alias("a"), "fragment", F.col("part").alias("pa"))
    right = parts.select(F.col("s").alias("b"), "fragment", F.col("part").alias("pb"))
    met_left = left.join(F.broadcast(pairs) if few else pairs, "a")
    partial = met_left.join(right, ["b", "fragment"]).select("a", "na", "b", "nb", F.size(F.array_intersect("pa", "pb")).alias("common"))
    summed = partial.groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))
    return summed.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(s, root) of every end of an edge (a, b), ``root`` the least of its component.

    A round takes a root's root (pointer jumping), offers the least of the neighbours' ones to
    each end and to its present root (hooking), and keeps the least offer. So whole parts move at
    once, and the rounds of a long chain grow with the logarithm of its length.
    """
    both = settled(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy(F.col("a").alias("s")).agg(F.min("b").alias("least_b")).select("s", F.least("least_b", "s").alias("root")))
    while True:
        ahead = labels.join(labels.select(F.col("s").alias("root"), F.col("root").alias("next")), "root").select("s", "root", "next")
        near = both.join(ahead.select(F.col("s").alias("b"), "next"), "b").groupBy(F.col("a").alias("s")).agg(F.min("next").alias("near"))
        moves = ahead.join(near, "s").select("s", "root", F.least("next", "near").alias("to"))
        own, hooked = moves.select("s", F.col("root").alias("old"), "to"), moves.select(F.col("root").alias("s"), F.lit(None).cast("long").alias("old"), "to")
        after = settled(own.unionAll(hooked).groupBy("s").agg(F.max("old").alias("old"), F.min("to").alias("root")))
        labels = after.select("s", "root")
        if after.filter("root != old").limit(1).count() == 0:
            return labels


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) between sets whose components are those of all linked pairs."""
    posts, parts = prefixes(sets, percent), segments(sets)
    found = settled(verified(_with_center(posts.withColumn("root", F.col("s")), percent, False), parts, percent))
    for pairs_of in (lambda own: _with_center(own, percent, True), lambda own: _across(own, percent)):
        roots = components(found)
        if small_enough(roots, 16):
            roots = F.broadcast(roots)
        own = posts.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))
        found = settled(found.unionAll(verified(pairs_of(own), parts, percent)))
    return found


def _fits(na: Column, nb: Column, percent: int) -> Column:
    return (100 * F.least(na, nb)) >= percent * F.greatest(na, nb)


def _with_center(posts: DataFrame, percent: int, again: bool) -> DataFrame:
    """Each posting list paired with its most central member; ``again``: the most central one outside that one's component."""
    best = F.max(F.struct("central", "s", "n", "root")).alias("c")
    center = posts.groupBy("token").agg(best)
    if again:
        center = posts.join(center, "token").filter(F.col("root") != F.col("c.root")).groupBy("token").agg(best)
    pairs = posts.join(center, "token").filter((F.col("root") != F.col("c.root")) & _fits(F.col("n"), F.col("c.n"), percent))
    low = F.col("s") < F.col("c.s")
    return pairs.select(F.least("s", "c.s").alias("a"), F.when(low, F.col("n")).otherwise(F.col("c.n")).alias("na"), F.greatest("s", "c.s").alias("b"), F.when(low, F.col("c.n")).otherwise(F.col("n")).alias("nb")).distinct()


def _across(posts: DataFrame, percent: int) -> DataFrame:
    """All pairs of a posting list in different components that the length and positional filters leave."""
    mixed = posts.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("token")
    open_lists = posts.join(mixed, "token", "left_semi").select("token", "s", "n", "at", "root")
    x = open_lists.select("token", F.col("s").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("root").alias("ra"))
    y = open_lists.select("token", F.col("s").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("root").alias("rb"))
    left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    enough = (100 + percent) * left >= percent * (F.col("na") + F.col("nb"))
    pairs = x.join(y, "token").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _fits(F.col("na"), F.col("nb"), percent) & enough)
    return pairs.select("a", "na", "b", "nb").distinct()


def _grouped(rows: DataFrame, k: int, percent: int, extra: float) -> tuple[DataFrame, DataFrame]:
    """Size and set of every row, and (s, root) of the sets that link with others."""
    members = cut(memberships(rows, k, percent, extra))
    clashing = clashes(members)
    if clashing:
        members = members.withColumn("s", F.when(F.col("s").isin(*clashing), F.col("s2")).otherwise(F.col("s")))
    members = members.drop("s2")
    survivors = cut(surviving_sets(members, percent, extra))
    members = cut(members.drop("looked_at"))  # the tokens' checkpoint is not referenced any more and can be cleaned
    sets = cut(ordered_sets(rows, members, survivors, k, percent, clashing))
    return members, components(links(sets, percent))


def _with_least(members: DataFrame, roots: DataFrame, value: Column, salts: int) -> DataFrame:
    """``members`` with the least ``value`` of each component of several rows as ``least``, else null."""
    per_set = members.filter("n > 0").groupBy("s").agg(F.min(value).alias("least"), F.count("*").alias("copies"))
    per_set = per_set.join(roots, "s", "left").filter("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "s"))
    per_set = cut(per_set.select("s", "root", F.col("least").alias("own")))
    named = per_set.groupBy("root").agg(F.min("own").alias("least"))
    named = per_set.join(named, "root").select("s", "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = [F.coalesce("doc_id", F.lit(-1)), *(F.col(c) for c in members.columns if c == "text_hash")]
    return members.withColumn("salt", F.pmod(F.xxhash64(*dealt), F.lit(salts)).cast("int")).join(named, ["s", "salt"], "left")


def ngram_jaccard_join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, extra: float = EXTRA, salts: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row."""
    joined = _with_least(*_grouped(id_text(docs, id_col, text_col), k, percent, extra), F.col("doc_id"), salts)
    component = F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, null ids last.

    Documents are told apart by id and text, so those that share an id, or have none, fare
    each by its own text; where ids are equal the text of the smallest hash stays. Of rows
    that repeat an id with one text, one stays; other documents without words all stay.
    """
    rows = id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    members, roots = _grouped(rows, WORDS, PERCENT, EXTRA)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    found = _with_least(members, roots, first, salts)
    other = ~(F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("text_hash") == F.col("least.hash")))
    own_id, own_hash, text = (unused(n, docs.columns) for n in ("own_id", "own_hash", "text_hash"))
    key = [F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)]
    gone = cut(found.filter(F.col("least").isNotNull() & other).select(*key).distinct())
    twice = members.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).filter("rows > 1").select(*key)
    gone, twice = (F.broadcast(x) if small_enough(x, 24) else x for x in (gone, twice))
    named = docs.withColumn(text, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(text) == F.col(own_hash))
    kept = named.join(gone, same, "left_anti")
    once, several = kept.join(twice, same, "left_anti"), kept.join(twice, same, "left_semi")
    return once.unionByName(several.dropDuplicates([id_col, text])).drop(text)
