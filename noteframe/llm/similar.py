"""SimHash near-dedup at a stated Jaccard similarity of word shingles.

A document is the set of its five-word shingles. For sets of similarity J the bits of two
SimHash fingerprints differ with probability arccos(2J / (1 + J)) / pi, 0.151 at 0.8, so 64 bits
are too few to find such pairs by close agreement of all. Here the fingerprint has 17 segments
of 26 bits. Within each segment both sides enumerate a small Hamming ball: the segment itself
and its six neighbours that flip one of the bits whose votes were closest. Documents that meet
at a point of a segment are candidates, verified over the complete distance of all 442 bits and
then by the exact similarity of their shingle sets.

By the normal approximation a pair meets in at least one segment with probability 0.966 at a
similarity of exactly 0.8, 0.997 at 0.85 and nearly 1 above 0.9; what meets is decided exactly.
A bit more of ``width`` for each doubling of the table keeps chance meetings per document even.

Groups of any size cost rows in proportion: first each document is compared with the smallest one
at each of its points, and only documents of a point that are still in different classes are
compared after that: as pairs at points of few documents, and in blocks within tasks at others,
where only links that join classes leave the task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import work_dir
from .common import as_row, components, kept
from .simhash import SEED

SHINGLE, SIMILARITY = 5, 0.8
SEGMENTS, WIDTH, FLIPS = 17, 26, 6
#: Members of a point that are paired one by one at most; beyond, they are compared in blocks.
CROWD, BLOCK = 16, 1024
#: Words of a set that a block has room for on average.
_WORDS = 1024
_CHUNK = 1 << 14
#: Bits of a filter of keys: 16 for each key, in maps of 32,768 bits, 4,096 maps (16 MB) at most.
_MAP_BITS, _MOST_MAPS = 32768, 4096
_MASK = (1 << 64) - 1
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread by multiplication and shifts."""
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _steps(n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers."""
    return np.array([((i + 1) * 0x9E3779B97F4A7C15 & _MASK) | 1 for i in range(n)], np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a whole text.

    ASCII letters are lower-cased, words are runs between ASCII white space. Fewer words make
    one shingle, no word none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    n = len(words) - size + 1
    if not words:
        return np.zeros(0, np.uint64)
    if n < 1:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for j, step in enumerate(_steps(size)):
        total += _mixed(hashes[j : j + n] ^ step) * step
    return np.unique(_mixed(total))


def votes(found: np.ndarray, bits: int) -> np.ndarray:
    """For each bit, how many more hashes have it set than not."""
    words = -(-bits // 64)
    seen = np.zeros((words * 8, 256), np.float32)
    places = np.arange(words * 8) * 256
    for at in range(0, len(found), _CHUNK):
        wide = _mixed(found[at : at + _CHUNK, None] + _steps(words))
        octets = wide.astype("<u8").view(np.uint8).astype(np.int64) + places
        seen += np.bincount(octets.ravel(), minlength=seen.size).reshape(seen.shape)
    return 2 * (seen @ _BITS).ravel()[:bits] - len(found)


def meeting_points(
    found: np.ndarray, segments: int = SEGMENTS, width: int = WIDTH, flips: int = FLIPS
) -> np.ndarray:
    """(1 + flips) x segments numbers: the fingerprint by segments, then its close neighbours."""
    margin = votes(found, segments * width).reshape(segments, width)
    base = (margin > 0) @ (1 << np.arange(width))
    close = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :flips]
    return np.concatenate([base[None], base[None] ^ (1 << close.T)]).astype(np.int32)


def farthest(bits: int, similarity: float) -> int:
    """Distance that pairs of the similarity exceed by chance once in 30,000 (four deviations)."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def _key() -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))


def sketches(docs: DataFrame, size: int, segments: int, width: int, flips: int) -> DataFrame:
    """(key, node, points): node is a hash of the whole set of shingles."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, each = batch.column(1), (1 + flips) * segments
            nodes, points = np.zeros(len(texts), np.uint64), np.zeros((len(texts), each), np.int32)
            for i in range(len(texts)):
                found = shingles(texts[i].as_py(), size)
                nodes[i] = xxh64_intdigest(found.astype("<u8").tobytes(), SEED)
                points[i] = meeting_points(found, segments, width, flips).ravel()
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * each)
            lists = pa.ListArray.from_arrays(ends, pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes.view(np.int64)), lists], ["key", "node", "points"]
            )

    slim = docs.select(_key().alias("key"), F.col("text").alias("text"))
    return slim.mapInArrow(
        run, "key struct<doc_id: long, text_hash: long>, node long, points array<int>"
    )


def _marked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, key, hit): ``hit`` holds for every row whose key is in ``keys``, and few others.

    A bitmap of the keys' hashes is broadcast, so rows without a hit need no shuffle. It has at
    most 16 MB; where that is too small for the keys, more rows hit and the result is the same.
    """
    count = keys.count()
    maps = max(1, min(_MOST_MAPS, -(-16 * count // _MAP_BITS)))
    place = F.pmod(F.xxhash64("key.doc_id", "key.text_hash"), F.lit(maps * _MAP_BITS))
    bitmap = (
        keys.select(place.alias("place"))
        .selectExpr(f"place div {_MAP_BITS} AS map", f"place % {_MAP_BITS} AS bit")
        .groupBy("map")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    )
    rows = docs.select(as_row(docs).alias("row"), _key().alias("key")).withColumn("place", place)
    at = rows.withColumn("map", F.expr(f"place div {_MAP_BITS}")).join(F.broadcast(bitmap), "map", "left")
    octet = f"conv(hex(substring(bits, cast(place % {_MAP_BITS} div 8 + 1 AS int), 1)), 16, 10)"
    hit = F.expr(f"coalesce(getbit(cast({octet} AS long), cast(place % 8 AS int)), 0) = 1")
    return at.select("row", "key", hit.alias("hit"))


def _sets(of: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, found): the sets of shingles of the nodes in ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sets = [shingles(texts[i].as_py(), size).view(np.int64) for i in range(len(texts))]
            lists = pa.array(sets, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "found"])

    wanted = of.select("node").distinct()
    keys = kept(nodes.select("node", F.col("first").alias("key")).join(wanted, "node", "left_semi"))
    hits = _marked(docs.select("doc_id", "text"), keys).where("hit")
    texts = hits.join(keys, "key").select("node", F.col("row.text").alias("text"))
    return kept(texts.dropDuplicates(["node"]).mapInArrow(run, "node long, found array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (left, right) pairs whose shingle sets have the similarity, by exact counts."""
    left = sets.select(F.col("node").alias("left"), F.col("found").alias("a"))
    right = sets.select(F.col("node").alias("right"), F.col("found").alias("b"))
    both = pairs.join(left, "left").join(right, "right")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= F.lit(similarity) * (F.size("a") + F.size("b") - common)).select(
        "left", "right"
    )


def _spanning(nodes: np.ndarray, roots: np.ndarray, similar: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what ``similar`` connects, beyond equal roots: fewer than the nodes."""
    _, top = np.unique(roots, return_inverse=True)
    left, right = [], []
    for i, j in np.argwhere(np.triu(similar, 1) & (top[:, None] != top)):
        if top[i] != top[j]:
            left.append(int(min(nodes[i], nodes[j])))
            right.append(int(max(nodes[i], nodes[j])))
            top[top == top[j]] = top[i]
    return left, right


def common_counts(flat: np.ndarray, ends: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of a block, some columns of its words at a time."""
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    _, word, times = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[word]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total = np.diag(np.diff(ends, prepend=0)).astype(np.float32)
    for at in range(0, int(place.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(place, [at, at + columns])
        has = np.zeros((len(ends), columns), np.float32)
        has[row[a:b], place[a:b] - at] = 1
        total += has @ has.T
    np.fill_diagonal(total, np.diff(ends, prepend=0))
    return total


def crowd_links(rows: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(left, right) links that connect all similar nodes of the same point, whatever its size.

    ``rows`` has point, node, root and size (members of the point). Members are dealt over blocks
    of about ``block``, of fewer where sets are large; a task compares two blocks as matrices
    and returns only the links that join classes, so rows do not grow with pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table["found"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy())
        both, sizes = common_counts(flat, ends), np.diff(ends, prepend=0)
        similar = both >= similarity * (sizes[:, None] + sizes - both)
        found = _spanning(table["node"].to_numpy(), table["root"].to_numpy(), similar)
        return pa.table({"left": pa.array(found[0], pa.int64()), "right": pa.array(found[1], pa.int64())})

    sizes = sets.select("node", F.size("found").alias("words"))
    words = F.sum("words").over(W.partitionBy("point"))
    parts = F.ceil(F.greatest(F.col("size") / block, words / (block * _WORDS)))
    sized = rows.join(sizes, "node").withColumn("parts", parts)
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn(
        "other", F.explode(F.expr("sequence(0L, parts - 1)"))
    )
    blocks = dealt.select(
        "point", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "root"
    )
    return (
        blocks.join(sets, "node")
        .groupBy("point", "i", "j")
        .applyInArrow(run, "left long, right long")
        .distinct()
    )


def _classes(links: DataFrame) -> DataFrame:
    """(of, root) of the linked nodes.

    Links are written as Parquet and read again: a checkpoint would hand on what the optimizer
    has inferred about their columns, which multiplies over the rounds of joins.
    """
    path = f"{work_dir(links.sparkSession)}/links-{uuid.uuid4().hex}"
    links.write.parquet(path)
    return components(links.sparkSession.read.parquet(path)).withColumnRenamed("node", "of")


def similar_links(
    nodes: DataFrame,
    docs: DataFrame,
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    segments: int = SEGMENTS,
    width: int = WIDTH,
    crowd: int = CROWD,
    block: int = BLOCK,
) -> DataFrame:
    """(left, right) links that connect the nodes of similar sets that meet at a point.

    ``nodes`` has node, first (key of one document) and points. Not every similar pair is a
    link, but what similar pairs connect is connected: each node is compared with the smallest
    one of each of its points, then members of a point that are still in different classes with
    each other, as pairs where they are at most ``crowd``, as blocks otherwise.
    """
    point = F.expr(f"shiftleft(cast(pos % {segments} AS long), {width}) | value").alias("point")
    met = nodes.select("node", F.posexplode("points").alias("pos", "value")).select("node", point)
    here = W.partitionBy("point")
    met = met.withColumns({"head": F.min("node").over(here), "last": F.max("node").over(here)})
    met = kept(met.where("head != last").drop("last"))
    fps = nodes.select("node", F.slice("points", 1, segments).alias("fp"))
    left = fps.select(F.col("node").alias("left"), F.col("fp").alias("a"))
    right = fps.select(F.col("node").alias("right"), F.col("fp").alias("b"))
    apart = F.expr(" + ".join(f"bit_count(a[{i}] ^ b[{i}])" for i in range(segments)))
    most = farthest(segments * width, similarity)

    # One pair for each row of ``met`` at most: a node and the smallest that it meets.
    heads = met.where("node != head").select(F.col("head").alias("left"), F.col("node").alias("right"))
    near = heads.distinct().join(left, "left").join(right, "right").where(apart <= most)
    stars = kept(near.select("left", "right", apart.alias("apart")))
    sets = _sets(_ends(stars), nodes, docs, size)
    best = stars.groupBy("right").agg(F.min(F.struct("apart", "left"))["left"].alias("left"))
    first = kept(_verified(best.select("left", "right"), sets, similarity))
    more = _across(stars, _classes(first)).select("left", "right")
    first = kept(first.unionByName(_verified(more, sets, similarity)))

    roots = _classes(first)
    named = met.where("node != head").join(roots, F.col("node") == F.col("of"), "left").select(
        "point", "node", F.coalesce("root", "node").alias("root")
    )
    named = named.withColumns(
        {"one": F.min("root").over(here), "other": F.max("root").over(here), "size": F.count("*").over(here)}
    )
    mixed = kept(named.where("one != other").drop("one", "other"))
    few = mixed.where(F.col("size") <= crowd).join(fps, "node")
    x = few.select("point", F.col("node").alias("left"), F.col("root").alias("rx"), F.col("fp").alias("a"))
    y = few.select("point", F.col("node").alias("right"), F.col("root").alias("ry"), F.col("fp").alias("b"))
    paired = x.join(y, "point").where((F.col("left") < F.col("right")) & F.expr("rx != ry") & (apart <= most))
    paired = paired.select("left", "right").distinct()
    rest = kept(paired.join(stars.select("left", "right"), ["left", "right"], "left_anti"))
    many = mixed.where(F.col("size") > crowd)
    sets = _sets(_ends(rest).unionByName(many.select("node")), nodes, docs, size)
    return first.unionByName(_verified(rest, sets, similarity)).unionByName(
        crowd_links(many, sets, similarity, block)
    )


def _ends(pairs: DataFrame) -> DataFrame:
    """(node) of all ends of the pairs."""
    return pairs.select(F.col("left").alias("node")).unionByName(pairs.select(F.col("right").alias("node")))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The (left, right) pairs whose ends are in different classes."""
    for end in ("left", "right"):
        named = roots.select(F.col("of").alias(end), F.col("root").alias(f"{end}_root"))
        pairs = pairs.join(named, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return pairs.where("left_root != right_root")


def one_of_each(
    docs: DataFrame,
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    segments: int = SEGMENTS,
    width: int = WIDTH,
    flips: int = FLIPS,
) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate class.

    Documents whose sets of ``size``-word shingles have at least the ``similarity`` are linked,
    over any number of steps (candidates as the module says). The document of the smallest
    doc_id stays, null ids last, then by the text's hash. Null texts are empty; texts without a
    word are one class. Rows that repeat both doc_id and text fold into one. All columns are
    returned as they came; an empty table gives no rows.
    """
    marked = kept(sketches(docs, size, segments, width, flips))
    order = F.struct(F.col("key.doc_id").isNull().alias("no_id"), "key")
    nodes = kept(
        marked.groupBy("node").agg(
            F.min(order)["key"].alias("first"),
            F.count("*").alias("copies"),
            F.any_value("points").alias("points"),
        )
    )
    links = similar_links(nodes, docs, size, similarity, segments, width)
    roots = _classes(links)
    linked = nodes.drop("points").join(roots, nodes["node"] == roots["of"], "left")
    linked = linked.select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("first.doc_id").isNull().alias("no_id"), "first"))["first"]
    classes = linked.groupBy("root").agg(first.alias("stays"), F.sum("copies").alias("rows"))
    crowd = linked.join(classes.where("rows > 1"), "root").select("node", "stays")
    members = kept(marked.select("key", "node").join(crowd, "node").select("key", "stays").distinct())
    # Read once: rows outside of classes pass as they lie, the others meet their class's verdict.
    rows = _marked(docs, members.select("key"))
    gone = members.where("key != stays").select("key")
    shared = rows.where("hit").select("key", "row").join(gone, "key", "left_anti").dropDuplicates(["key"])
    return rows.where("NOT hit").select("row.*").unionByName(shared.select("row.*"))
