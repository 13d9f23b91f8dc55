"""Document fingerprints from closed syncmers over words, with SQL functions only.

A window of ``K`` words is chosen when its smallest word hash stands at its first or last
place. The choice depends on the window alone, so the same passage gives the same anchors
wherever it stands, and every change touches only the windows over it. The fingerprint is the
bottom sketch of the chosen windows: their ``SKETCH`` smallest distinct hashes. Two
fingerprints are compared by the Dice coefficient that their joint bottom sketch estimates
(exact when both have fewer windows).

The next document by descending doc_id is found without a one-task window and with one shuffle
of the texts: approximate quantiles of the ids cut the table into even buckets, a window runs
inside a bucket, and the first row of each bucket (at most ``BUCKETS`` rows, broadcast as ids)
is also given to the bucket before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, kept

K = 5
SKETCH = 128
SIDE = 64
BUCKETS = SIDE * SIDE


def with_syncmers(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted bottom sketch of a text's closed syncmers as an array of integers.

    Texts of fewer than ``K`` words have their single words in the sketch, empty ones nothing.
    """
    word = WORD.replace("\\", "\\\\")
    hashes = f"transform(regexp_extract_all({text}, '{word}', 0), w -> xxhash64(w))"
    at = [f"get(_h, i + {j})" if j else "get(_h, i)" for j in range(K)]
    low = f"least({', '.join(at)})"
    chosen = f"filter(sequence(0, size(_h) - {K}), i -> {low} IN ({at[0]}, {at[-1]}))"
    windows = f"transform({chosen}, i -> shiftright(xxhash64({', '.join(at)}), 32))"
    kmers = f"CASE WHEN size(_h) < {K} THEN transform(_h, x -> shiftright(x, 32)) ELSE {windows} END"
    sketch = f"slice(sort_array(array_distinct({kmers})), 1, {SKETCH})"
    return (
        df.withColumn("_h", F.expr(hashes))
        .withColumn(name, F.expr(f"transform({sketch}, x -> int(x))"))
        .drop("_h")
    )


def as_string(sketch: str) -> Column:
    """The sketch as text: eight hexadecimal digits per hash."""
    digits = "lower(lpad(hex(bigint(x) & 4294967295L), 8, '0'))"
    return F.expr(f"array_join(transform({sketch}, x -> {digits}), '')")


def likeness(a: str, b: str) -> Column:
    """Dice coefficient estimated from two bottom sketches, 0 to 1; two empty ones are alike."""
    joint = f"slice(sort_array(array_union({a}, {b})), 1, {SKETCH})"
    shared = f"size(array_intersect(array_intersect({joint}, {a}), {b}))"
    whole = f"size({joint})"
    return F.expr(
        f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D WHEN {whole} = 0 THEN 0D "
        f"ELSE 2D * {shared} / ({whole} + {shared}) END"
    )


def _order(doc_id: str, text_hash: str) -> Column:
    """Descending order of documents: by id, null ids last, equal ids by the text's hash."""
    return F.struct(
        F.col(doc_id).isNotNull().alias("known"),
        F.col(doc_id).alias("id"),
        F.shiftrightunsigned(text_hash, 11).alias("tie"),
        F.col(text_hash).alias("hash"),
    )


def _bucket() -> tuple[Column, Column]:
    """Bucket of ``_key``: how many ``_cuts`` are at most it, by coarse cuts (``_high``) first."""
    top = F.expr(f"transform(sequence(1, {SIDE - 1}), i -> get(_cuts, i * {SIDE} - 1))")
    high = F.size(F.filter(top, lambda c: c <= F.col("_key")))
    low = F.expr(f"slice(_cuts, _high * {SIDE} + 1, {SIDE - 1})")
    return high, F.col("_high") * SIDE + F.size(F.filter(low, lambda c: c <= F.col("_key")))


def _keyed(df: DataFrame) -> DataFrame:
    """A number that grows with the order, so that even rows of one id can be told apart."""
    tie = F.shiftrightunsigned("_hash", 11) / F.lit(float(1 << 53))
    key = F.when(F.col("_id").isNotNull(), F.col("_id").cast("double") + tie).otherwise(
        (tie - 4) * F.lit(1e19)
    )
    return df.withColumn("_key", key)


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Add ``next``: the ``carry`` columns of the next document by descending doc_id.

    After the last document comes the first. ``docs`` has doc_id and text; rows of one doc_id
    go by the hash of the text.
    """
    ids = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    slim = _keyed(kept(ids))
    shares = F.expr(f"array({', '.join(f'{i / BUCKETS!r}D' for i in range(1, BUCKETS))})")
    cuts = slim.agg(F.percentile_approx("_key", shares, F.lit(8 * BUCKETS)).alias("cuts")).scalar()

    def bucketed(df: DataFrame) -> DataFrame:
        high, bucket = _bucket()
        cut = df.withColumn("_cuts", cuts).withColumn("_high", high)
        return cut.withColumn("_bucket", bucket).drop("_cuts", "_high", "_key")

    heads = bucketed(slim).groupBy("_bucket").agg(F.max(_order("_id", "_hash")).alias("head"))
    down = W.orderBy(F.desc("_bucket"))
    whole = down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follow = F.coalesce(F.lead("head").over(down), F.first("head").over(whole))
    extra = heads.select(F.col("_bucket").alias("_to"), follow.alias("_follow"))
    rows = docs.withColumns({"_id": F.col("doc_id"), "_hash": F.xxhash64("text")})
    rows = bucketed(_keyed(rows)).withColumn("_order", _order("_id", "_hash")).drop("_id", "_hash")
    places = F.expr(
        "filter(array(named_struct('bucket', _bucket, 'extra', false), "
        "named_struct('bucket', _to, 'extra', true)), p -> p.bucket IS NOT NULL)"
    )
    dealt = (
        rows.join(F.broadcast(extra), F.col("_order") == F.col("_follow"), "left")
        .withColumn("_place", F.explode(places))
        .drop("_bucket", "_to", "_follow")
    )
    inside = W.partitionBy("_place.bucket").orderBy("_place.extra", F.desc("_order"))
    after = F.lead(F.struct(*carry)).over(inside)
    return (
        dealt.withColumn("next", after).where("NOT _place.extra").drop("_place", "_order")
    )


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. The edited text has its last half replaced by the start of the next document.
    Null texts are empty; equal texts have equal fingerprints; equal rows stay separate rows;
    a single document is its own next one; null ids come after all others. An empty table
    gives no rows, further columns are not read.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    marked = with_syncmers(slim, "text", "sketch")
    paired = with_next(marked, ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half)
    )
    both = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        edited.alias("edited"),
        "sketch",
        F.col("next.sketch").alias("next_sketch"),
    )
    both = with_syncmers(both, "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string("sketch").alias("fingerprint"),
        as_string("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
