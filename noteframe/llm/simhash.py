"""SimHash fingerprints and near-duplicate classes by multi-index hashing.

Two fingerprints of 64 bits that differ in at most ``radius`` bits agree well in at least one
of their segments: with three segments and radius 4, the first or second differs in at most
one bit or the third in none. So each fingerprint stands in three tables (its segments) and
looks up 23 + 22 + 1 keys (the Hamming balls of these radii); what it meets there is verified
over all 64 bits. Copies fold into one fingerprint first, so a group of equal texts costs one
row. A bucket that holds more than ``hot_bucket`` fingerprints is not paired: its members are
linked through all points within half the radius, which two fingerprints share exactly when
they lie within the radius. That is exact and grows with the members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, components, kept

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(text: str | None, size: int = 4) -> int:
    """SimHash of the ``size``-word shingles of a text, as an unsigned 64-bit integer.

    ASCII letters are lower-cased, words are runs between ASCII white space, shingles count
    as often as they occur. A bit is set where it is set in over half of the XXH64 values.
    Fewer words make one shingle; no word gives 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= size:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - size] + 1)).tolist()
    stops = ends[size - 1 :].tolist()
    shingles = [joined[a:b] for a, b in zip(starts, stops, strict=True)]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
    seen = np.bincount((octets + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256)
    over = (seen @ _BITS.astype(np.int64) * 2 > len(shingles)).ravel()
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            values = [fingerprint(texts[i].as_py()) for i in range(len(texts))]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(signed)], ["doc_id", "text_hash", "fp"]
            )

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").alias("text"),
    )
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long")


def segment_plan(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment: the search radii sum up so that none is missed."""
    width, more = divmod(64, segments)
    widths = [width + (i < more) for i in range(segments)]
    base, extra = divmod(radius, segments)
    shift, out = 0, []
    for i, w in enumerate(widths):
        out.append((shift, w, base if i <= extra else base - 1))
        shift += w
    return out


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` set."""
    return [
        sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _keys(fps: DataFrame, plan: list[tuple[int, int, int]], probe: bool) -> DataFrame:
    """(segment, key, fp) of the tables, or of the looked-up balls when ``probe``."""
    slots = ", ".join(
        f"named_struct('segment', {i}, 'shift', {shift}, 'low', {(1 << width) - 1}L, 'mask', {m}L)"
        for i, (shift, width, radius) in enumerate(plan)
        if radius >= 0
        for m in (ball(width, radius) if probe else [0])
    )
    return fps.select("fp", F.expr(f"inline(array({slots}))")).selectExpr(
        "segment", "(shiftrightunsigned(fp, shift) & low) ^ mask AS key", "fp"
    )


def near_links(
    fps: DataFrame, radius: int = 4, segments: int = 3, hot_bucket: int = 4096
) -> DataFrame:
    """(left, right) links that connect exactly the fingerprints within ``radius`` bits.

    ``fps`` has distinct longs in ``fp``. Outside hot buckets every pair within the radius is
    a link; members of hot buckets are linked through the smallest fingerprint at each shared
    point, which joins the same classes.
    """
    if radius % 2:
        raise ValueError("an even radius is needed: links of a crowd share a point halfway")
    plan = segment_plan(radius, segments)
    table, probe = _keys(fps, plan, False), _keys(fps, plan, True)
    hot = table.groupBy("segment", "key").count().where(F.col("count") > hot_bucket).drop("count")
    # a fingerprint makes 3, 46 or 2081 rows here, which Spark's size of an exploded table leaves
    # out: such tables are merged, as they could be broadcast at many times their estimate
    slots = ["segment", "key"]
    cold = table.join(hot, slots, "left_anti")
    left = probe.withColumnRenamed("fp", "left")
    right = cold.withColumnRenamed("fp", "right")
    apart = F.bit_count(F.col("left").bitwiseXOR(F.col("right")))
    paired = (
        left.join(right.hint("merge"), slots)
        .where((F.col("left") < F.col("right")) & (apart <= radius))
        .select("left", "right")
    )
    crowd = (
        table.join(hot, slots, "left_semi")
        .unionByName(probe.join(hot, slots, "left_semi"))
        .select("fp")
        .distinct()
    )
    masks = ", ".join(f"{_signed(m)}L" for m in ball(64, radius // 2))
    points = crowd.select("fp", F.expr(f"explode(array({masks})) AS mask")).selectExpr(
        "fp", "fp ^ mask AS point"
    )
    first = points.groupBy("point").agg(F.min("fp").alias("left"))
    through = points.join(first.hint("merge"), "point").select("left", F.col("fp").alias("right"))
    return paired.unionByName(through.where("left != right")).distinct()


def classified(docs: DataFrame, radius: int = 4, hot_bucket: int = 4096) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, copies, root and first (of its class).

    ``first`` is the smallest (doc_id, text_hash) of the class, null ids last.
    """
    marked = kept(fingerprints(docs))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = marked.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    roots = components(near_links(classes.select("fp"), radius, hot_bucket=hot_bucket))
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", "copies", F.coalesce("root", "fp").alias("root")
    )
    smallest = linked.groupBy("root").agg(F.min("first").alias("first"))
    named = linked.drop("first").join(smallest, "root")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, radius: int = 4, hot_bucket: int = 4096) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, copies.

    ``component_id`` is the smallest doc_id that links of at most ``radius`` bits reach, itself
    included; ``copies`` is the number of documents of the same fingerprint. Null and empty
    texts have fingerprint 0 and are linked like any other. Equal rows stay separate rows; a
    null doc_id takes part, and a class of only such rows has a null component_id. An empty
    table gives no rows, further columns are not read.
    """
    return classified(docs, radius, hot_bucket).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        "copies",
    )


def one_of_each(docs: DataFrame, radius: int = 4, hot_bucket: int = 4096) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate class.

    The document of the smallest doc_id stays (null ids last, then by the text's hash). Rows
    that repeat both doc_id and text fold into one. All columns are returned as they came.
    """
    firsts = classified(docs, radius, hot_bucket).select(
        F.struct("first.doc_id", "first.text_hash").alias("key")
    )
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    rows = docs.select(key.alias("key"), as_row(docs).alias("row")).dropDuplicates(["key"])
    return rows.join(firsts.distinct(), "key", "left_semi").select("row.*")
