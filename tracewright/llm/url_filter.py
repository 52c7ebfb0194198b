"""URL filters: a blocked Bloom filter of listed keys, then an exact hash join, in DataFrame functions only.

Two lists decide. Rules name a host and the start of a path and hold for the host's subdomains;
of the rules that fit, the longest wins. Listed addresses are canonical URLs, each with the page
it belongs to. Both are entries of one table under one text key, and every page looks up a few
keys: its host's last labels with the first characters of its path, in each combination of
lengths that a rule has, and its canonical URL.

* The filter has blocks of 512 bits in eight words; a key sets one bit in each word of one
  block. ``bit_or`` by block builds it, with partial sums before the shuffle. Blocks are at most
  ``BLOCKS``, so that the broadcast filter has a bounded size however long the lists are; a
  crowded filter only passes more.
* Possible hits alone go on. Their different keys meet the entries in a hash join by the
  text, which removes false positives; what is verified goes back to the hits, broadcast where
  it was counted small, else with hot keys dealt over salts.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and
has no canonical URL; null ids are kept; rows that repeat a page fare alike, each with a row of
its own; of two rules of one length the one with the longer host wins, of equal rules that
block and allow, the one that blocks; very long URLs are read to their end; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._common import cut, small_enough

#: Blocks of the filter at most (about 100 bytes each), and bits for each key until then.
BLOCKS, BITS_A_KEY = 1 << 17, 16
WORDS = [f"w{i}" for i in range(8)]

#: Verdict, host and start of path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Parameters that do not tell addresses apart; beginnings of their names.
TRACKING = ("utm_", "ref=", "fbclid=", "gclid=")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows the path, all empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path, F.substring(after, F.length(path) + 1, F.length(after))


def canonical(host: Column, path: Column, tail: Column) -> Column:
    """Address without scheme, ``www.``, default port, closing slashes, tracking parameters and fragment; parameters in order. Null without a host."""
    plain = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    query = F.split(F.substring(F.regexp_extract(tail, r"^[^#]*", 0), 2, 1 << 30), "&")
    tracked = lambda q: F.exists(F.array(*map(F.lit, TRACKING)), lambda t: F.startswith(q, t))
    kept = F.array_join(F.array_sort(F.filter(query, lambda q: (q != "") & ~tracked(q))), "&")
    full = F.concat(plain, F.regexp_replace(path, r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(host != "", full)


def rules_frame(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    listed = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("verdict", "host", "path"), rule, strict=True)]) for rule in rules])
    return spark.range(1).select(F.inline(listed))


def repeated_addresses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(address, owner) of canonical URLs that several pages share; the owner is the page with the smallest id."""
    named = pages.select(F.col(id_col).alias("id"), canonical(*url_parts(F.col(url_col))).alias("address")).filter("address IS NOT NULL")
    return named.groupBy("address").agg(F.count("*").alias("n"), F.min("id").alias("owner")).filter("n > 1").select("address", "owner")


def _entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, host_size, blocks, owner): one row a key; rules have the key host and path, addresses one that begins with a blank."""
    fits = rules.filter("host != '' AND (path = '' OR path LIKE '/%')")
    named = fits.groupBy(F.concat("host", "path").alias("key")).agg(F.max(F.length("host")).alias("host_size"), F.max(F.col("verdict") == "block").alias("blocks"))
    known = listed.groupBy(F.concat(F.lit(" "), "address").alias("key")).agg(F.min("owner").alias("owner"))
    return named.withColumn("owner", F.lit(None).cast("long")).unionByName(known.select("key", F.lit(0).alias("host_size"), F.lit(True).alias("blocks"), F.col("owner").cast("long")))


def _bits(key: Column) -> list[Column]:
    """The bit of each word that ``key`` sets."""
    other = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, 6 * i).bitwiseAND(63).cast("int")) for i in range(8)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of a frame with ``key``; at most ``blocks`` rows."""
    marked = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[b.alias(w) for w, b in zip(WORDS, _bits(F.col("key")), strict=True)])
    return marked.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def possible_hits(asked: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``asked`` whose ``key`` may be in the filter; never misses one that is."""
    near = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(F.broadcast(bloom), "block")
    there = F.lit(True)
    for word, bit in zip(WORDS, _bits(F.col("key")), strict=True):
        there &= F.col(word).bitwiseAND(bit) == bit
    return near.filter(there).drop("block", *WORDS)


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", salts: int = 32) -> DataFrame:
    """(page_id, host, path, rule, verdict, address), one row per row of ``pages``.

    ``rules``: (verdict, host, path), whose paths are empty or begin with a slash. ``listed``:
    (address, owner); without a rule, a page on a listed address is blocked unless it is the
    address's owner, and other pages are allowed.
    """
    host, path, tail = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical(host, path, tail).alias("address"))
    rows = cut(parts.withColumn("row", F.monotonically_increasing_id()))
    entries = cut(_entries(rules, listed))
    blocks = min(BLOCKS, max(1, -(-entries.count() * BITS_A_KEY // 512)))
    # a row for each pair of lengths, however many rules there are
    labels, chars = F.size(F.split(F.col("host"), r"\.")), F.length("path")
    shapes = [(r[0], r[1]) for r in rules.filter("host != ''").select(labels, chars).distinct().collect()]
    keys = [F.when(F.length("path") >= c, F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, c))) for n, c in shapes]
    looked = F.array_compact(F.array_distinct(F.array(*[k.cast("string") for k in keys], F.concat(F.lit(" "), "address"))))
    asked = rows.select("row", F.explode(looked).alias("key"))
    hits = cut(possible_hits(asked, bloom_filter(entries, blocks), blocks))
    exact = hits.select("key").distinct().join(entries, "key")
    if small_enough(exact, 256):
        found = hits.join(F.broadcast(exact), "key")
    else:  # one address may hold any share of the pages
        salt = F.pmod(F.col("row"), F.lit(salts)).cast("int")
        found = hits.withColumn("salt", salt).join(exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["key", "salt"])
    of_rule = F.col("key").startswith(" ") == F.lit(False)
    best = F.max(F.when(of_rule, F.struct(F.length("key").alias("n"), "host_size", "blocks", "key"))).alias("best")
    per = found.groupBy(F.col("row").alias("found_row")).agg(best, F.max(~of_rule).alias("is_listed"), F.min("owner").alias("owner"))
    joined = rows.join(per, F.col("row") == F.col("found_row"), "left")
    is_listed = F.coalesce("is_listed", F.lit(False)) & ~F.col("owner").eqNullSafe(F.col("page_id"))
    blocked = F.coalesce(F.col("best.blocks"), is_listed)
    return joined.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), "address")


def oracle(rules: tuple[tuple[str, str, str], ...] = RULES) -> str:
    """The same rows by comparing every page with every rule, and counting addresses."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    tracked = " AND ".join(f"NOT starts_with(q, '{t}')" for t in TRACKING)
    return f"""
        WITH a AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        b AS (SELECT k, page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM a),
        c AS (SELECT k, page_id, translate(h, '{_UPPER}', '{_LOWER}') AS host, substr(r, length(h) + 1) AS r FROM b),
        d AS (SELECT k, page_id, host, regexp_extract(r, '^[^?#]*') AS path, r FROM c),
        e AS (SELECT *, list_sort(list_filter(string_split(substr(regexp_extract(substr(r, length(path) + 1), '^[^#]*'), 2), '&'), lambda q: q <> '' AND {tracked})) AS q FROM d),
        f AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www[.]', '') || regexp_replace(path, '/+$', '')
              || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS address FROM e),
        s AS (SELECT address, min(page_id) AS owner FROM f WHERE address IS NOT NULL GROUP BY address HAVING count(*) > 1),
        m AS (SELECT k, v.host || v.path AS rule, v.verdict, row_number() OVER (PARTITION BY k ORDER BY length(v.host || v.path) DESC) AS i
              FROM f JOIN (VALUES {values}) v(verdict, host, path) ON (f.host = v.host OR ends_with(f.host, '.' || v.host)) AND starts_with(f.path, v.path))
        SELECT page_id, f.host, path, m.rule, coalesce(m.verdict, CASE WHEN s.address IS NOT NULL AND s.owner IS DISTINCT FROM page_id THEN 'block' ELSE 'allow' END) AS verdict, f.address
        FROM f LEFT JOIN m ON f.k = m.k AND m.i = 1 LEFT JOIN s ON f.address = s.address"""
