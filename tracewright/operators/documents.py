"""JSON documents as variants: flattened to a row per path, and compared path by path.

A document is (doc_id, document variant). Paths are written ``a.b[0].c``, the root is the empty
path; keys stand as they are, so a key with a dot reads like two. Documents nest to any depth:
a loop takes one level of all documents at a time, and its levels are as many as the deepest
document has. Exploding a level moves no rows; only a comparison joins, by document and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.graph import shared_cut
from tracewright.operators.scenarios import Collected

#: Kinds of a value by the first character of its JSON text; all else is a number.
KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}


def kind_of(text: Column) -> Column:
    out = F.when(text.isNull(), None)
    for first, kind in KINDS.items():
        out = out.when(text.startswith(first), kind)
    return out.otherwise("number")


def parsed(df: DataFrame, column: str = "value") -> DataFrame:
    """``df`` with ``document`` instead of the text in ``column``; null where that is no JSON."""
    return df.withColumn("document", F.try_parse_json(F.col(column))).drop(column)


def _below(path: str) -> Column:
    """The path of a member: of an object by its key, of an array by its place."""
    at = F.coalesce(F.when(F.col(path) == "", F.col("key")).otherwise(F.concat(path, F.lit("."), "key")), F.concat(path, F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    return at.alias("path")


def _members(df: DataFrame, value: str) -> DataFrame:
    """Members of the containers in ``value``; a row without ``pos`` for what has none."""
    spark = df.sparkSession
    return df.lateralJoin(spark.tvf.variant_explode_outer(F.col(value).outer()).toDF("pos", "key", "member"))


def flattened(documents: DataFrame) -> DataFrame:
    """(doc_id, path, kind, text) of every value without members: scalars as text (strings without quotes), empty containers, JSON null.

    A document that is null has no rows.
    """
    at = shared_cut(documents.filter("document IS NOT NULL").select("doc_id", F.lit("").alias("path"), F.col("document").alias("value")))
    out = Collected()
    while True:
        step = shared_cut(_members(at, "value").select("doc_id", F.when(F.col("pos").isNull(), F.col("path")).otherwise(_below("path")).alias("path"), F.col("pos").isNull().alias("ends"), F.coalesce("member", "value").alias("value")))
        text = F.to_json("value")
        leaf = step.filter("ends").select("doc_id", "path", kind_of(text).alias("kind"), F.coalesce(F.expr("try_variant_get(value, '$', 'string')"), text).alias("text"))
        out.add(leaf)
        at = step.filter("NOT ends").select("doc_id", "path", "value")
        if at.isEmpty():
            return out.all()


def _same(a: Column, b: Column) -> Column:
    """Equal as JSON: the same text, or numbers of the same value however they are written."""
    numbers = (kind_of(a) == "number") & (kind_of(b) == "number") & (a.try_cast("decimal(38,12)") == b.try_cast("decimal(38,12)"))
    return a.eqNullSafe(b) | F.coalesce(numbers, F.lit(False))


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, path, what, first, second): where two documents of one id begin to differ.

    ``what``: ``missing in first``, ``missing in second`` (values as JSON text), ``length`` of two
    arrays (their lengths), or ``value``. Nothing is reported below a difference, and parts that
    are equal are not gone through. A document that one side lacks is missing at the root. Each
    side has a document of an id once at most.
    """
    side = lambda df, name: df.filter("document IS NOT NULL").select("doc_id", F.col("document").alias(name))
    at = side(first, "a").join(side(second, "b"), "doc_id", "full_outer").withColumn("path", F.lit(""))
    out = Collected()
    while True:
        a, b = F.to_json("a"), F.to_json("b")
        texts = shared_cut(at.withColumns({"x": a, "y": b}).filter(~_same(F.col("x"), F.col("y"))))
        kinds = texts.withColumns({"kx": kind_of(F.col("x")), "ky": kind_of(F.col("y"))})
        length = lambda c: F.expr(f"size(try_variant_get({c}, '$', 'array<variant>'))")
        sized = kinds.withColumns({"nx": F.when(F.col("kx") == "array", length("a")), "ny": F.when(F.col("ky") == "array", length("b"))})
        objects = F.coalesce((F.col("kx") == "object") & (F.col("ky") == "object"), F.lit(False))
        arrays = F.coalesce(F.col("nx") == F.col("ny"), F.lit(False))
        lengths = F.coalesce(F.col("nx") != F.col("ny"), F.lit(False))
        what = F.when(F.col("x").isNull(), "missing in first").when(F.col("y").isNull(), "missing in second").when(lengths, "length").otherwise("value")
        shown = lambda n, t: F.when(lengths, F.col(n).cast("string")).otherwise(F.col(t))
        out.add(sized.filter(~objects & ~arrays).select("doc_id", "path", what.alias("what"), shown("nx", "x").alias("first"), shown("ny", "y").alias("second")))
        deeper = sized.filter(objects | arrays).select("doc_id", "path", "a", "b")
        if deeper.isEmpty():
            return out.all()
        part = lambda c, name: _members(deeper.select("doc_id", "path", c), c).filter("pos IS NOT NULL").select("doc_id", _below("path"), F.col("member").alias(name))
        at = part("a", "a").join(part("b", "b"), ["doc_id", "path"], "full_outer")
