"""Prefix trie of conversations, rolled up in depth bands.

A node is a distinct sequence of first turns and is named by a digest of that sequence. No
task needs a whole conversation for it: turns are cut into bands of ``height``, a band's
digest is that of its turns, the bands of a conversation are cut into bands of bands, and so
on; a prefix is named by the digests of its whole bands at every level and of the turns in its
last one.

Totals over subtrees follow the same bands. Inside a band every node explodes to its own
ancestors there, ``height`` at most. The completed total of a band goes to the node above it,
the band's root; these roots are the nodes of a trie of bands, which is rolled up likewise;
then the roots explode once to their ancestors inside their own band. So there are as many
rounds as levels, the logarithm of the depth, and no row explodes more than ``height`` times.

Positions inside a conversation come from even buckets, nodes are counted with partial
aggregation, and ids of the conversations that end in a node are joined in bounded chunks by
many tasks; a digest over the chunks is the only thing that is done one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import positions
from .common import kept, word_count

HEIGHT = 8
#: The root has no turns; every other name is 16 bytes.
_ROOT = "X''"


def _name(parts: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(parts, 256), 1, 32))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, digest, words): turns by ``turn``, nulls first, from position 1.

    Null roles and texts are empty; turns of one place go by their digest; rows without a
    conv_id are left out. A conversation of any length is spread over many tasks.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _name(said).alias("digest"),
        word_count(text).alias("words"),
    )
    placed = positions(turns, F.struct("turn", "digest"), by=["conv_id"], store=True)
    return placed.drop("turn")


def with_shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another one.

    Conversation c takes the first h = crc32(c) % ``most`` turns of conversation
    c - c % ``group``, then its own turns after its first h. Returns the turns (conv_id, idx
    from 0, digest, words) and the conversations (conv_id, n_turns), turnless ones included.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string")) % most).cast("int")
    first = turns.where((c % group == 0) & (F.col("position") < most))
    heads = first.groupBy(c.alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("position", "digest", "words"))).alias("head")
    )
    sized = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    shift = F.when(F.col("head").isNull(), 0).otherwise(F.least(F.size("head"), h)).cast("long")
    convs = kept(
        sized.withColumn("base", c - c % group)
        .join(heads, "base", "left")
        .select("conv_id", "n", F.slice("head", F.lit(1), h).alias("head"), shift.alias("shift"))
    )
    shared = convs.select("conv_id", F.posexplode("head").alias("idx", "turn")).select(
        "conv_id", F.col("idx").cast("long").alias("idx"), "turn.digest", "turn.words"
    )
    own = turns.where(F.col("position") > h).join(convs.select("conv_id", "shift"), "conv_id")
    own = own.select(
        "conv_id", (F.col("position") - 1 - h + F.col("shift")).alias("idx"), "digest", "words"
    )
    rebuilt = convs.select(
        "conv_id", (F.col("shift") + F.greatest(F.col("n") - h, F.lit(0))).alias("n_turns")
    )
    return shared.unionByName(own), rebuilt


def bands(items: DataFrame, deepest: int, height: int, level: int = 0) -> list[DataFrame]:
    """Levels of bands: (conv_id, band, keys, words, root) each.

    ``keys`` names the prefixes that end in the band, ``root`` the prefix before it (null for
    none). ``items`` is (conv_id, idx, digest, words); ``deepest`` is the largest idx. A
    prefix has the same name on every level.
    """
    band = F.floor(F.col("idx") / height).cast("long")
    part = F.sort_array(F.collect_list(F.struct("idx", "digest", "words")))
    rows = items.groupBy("conv_id", band.alias("band")).agg(part.alias("part"))
    higher = []
    if deepest >= height:
        rows = kept(rows)
        joined = F.expr("aggregate(part, X'', (a, p) -> concat(a, p.digest))")
        whole = rows.where(F.size("part") == height).select(
            "conv_id", F.col("band").alias("idx"), _name(joined).alias("digest"), F.lit(0).alias("words")
        )
        higher = bands(whole, (deepest + 1) // height - 1, height, level + 1)
        names = higher[0].select("conv_id", "band", F.posexplode("keys").alias("at", "key"))
        names = names.select("conv_id", (F.col("band") * height + F.col("at")).alias("band"), "key")
        rows = rows.join(names.withColumnRenamed("key", "last"), ["conv_id", "band"], "left").join(
            names.select("conv_id", (F.col("band") + 1).alias("band"), F.col("key").alias("root")),
            ["conv_id", "band"],
            "left",
        )
    else:
        nothing = F.lit(None).cast("binary")
        rows = rows.withColumns({"last": nothing, "root": nothing})
    above = f"concat(encode('{level}:', 'UTF-8'), coalesce(root, {_ROOT}))"
    upto = f"aggregate(slice(part, 1, r), {above}, (a, p) -> concat(a, p.digest))"
    keys = (
        f"transform(sequence(1, size(part)), r -> CASE WHEN r = {height} AND last IS NOT NULL "
        f"THEN last ELSE unhex(substring(sha2({upto}, 256), 1, 32)) END)"
    )
    done = rows.select("conv_id", "band", F.expr(keys).alias("keys"), F.expr("part.words").alias("words"), "root")
    return [kept(done), *higher]


def _sums(rows: DataFrame, by: str = "key") -> DataFrame:
    return rows.groupBy(by).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def rolled_up(nodes: DataFrame, levels: list[DataFrame], height: int) -> DataFrame:
    """(key, leaves, saved) summed over the subtree of every node, itself included.

    ``nodes`` is (key, conv_id, idx, leaves, saved) with conv_id any member and idx its place
    on the level that ``levels`` begins with.
    """
    r = (F.col("idx") % height + 1).cast("int")
    placed = nodes.withColumn("band", F.floor(F.col("idx") / height).cast("long")).join(
        levels[0].select("conv_id", "band", "keys", "root"), ["conv_id", "band"]
    )
    placed = placed.select(
        "key", "conv_id", "idx", "leaves", "saved", "root", F.slice("keys", F.lit(1), r).alias("line")
    )
    spread = placed.select(F.explode("line").alias("key"), "leaves", "saved")
    if len(levels) > 1:
        placed = kept(placed)
        spread = placed.select(F.explode("line").alias("key"), "leaves", "saved")
        below = _sums(placed.where(F.col("root").isNotNull()), "root").withColumnRenamed("root", "key")
        lowest = placed.where((F.col("idx") + 1) % height == 0)
        tops = lowest.select(
            "key", "conv_id", (F.floor((F.col("idx") + 1) / height) - 1).cast("long").alias("idx")
        ).join(below, "key", "left")
        full = rolled_up(tops.fillna(0, ["leaves", "saved"]), levels[1:], height)
        carried = lowest.select("key", "line").join(full, "key")
        spread = spread.unionByName(carried.select(F.explode("line").alias("key"), "leaves", "saved"))
    return kept(_sums(spread))


def joined_digests(members: DataFrame, chunk: int = 50_000) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids of each key, ascending and comma-joined.

    Ids are joined in chunks by tasks that share the sorted ids evenly; the chunks of a key
    then run through one digest, and memory holds one of them.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in batches:
            out = []
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= chunk):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(i)
            if out:
                yield _batch(out, [pa.binary(), pa.int64(), pa.string()], ["key", "low", "part"])
        if ids:
            out = [(key, ids[0], ",".join(map(str, ids)))]
            yield _batch(out, [pa.binary(), pa.int64(), pa.string()], ["key", "low", "part"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is not None and k == key:
                    state.update(b"," + part.encode())
                    continue
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(part.encode())
            if out:
                yield _batch(out, [pa.binary(), pa.string()], ["key", "ends_sha256"])
        if state is not None:
            yield _batch([(key, state.hexdigest())], [pa.binary(), pa.string()], ["key", "ends_sha256"])

    spread = members.select("key", "conv_id").repartitionByRange("key", "conv_id")
    chunks = spread.sortWithinPartitions("key", "conv_id").mapInArrow(
        pieces, "key binary, low long, part string"
    )
    dealt = chunks.repartition("key").sortWithinPartitions("key", "low")
    return dealt.mapInArrow(digests, "key binary, ends_sha256 string")


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
    )


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of conversations.

    ``turns`` is (conv_id, idx from 0 without gaps, digest, words), ``convs`` is (conv_id,
    n_turns). Returns conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. No conversation gives no node.
    """
    turns, convs = kept(turns), kept(convs)
    deepest = turns.agg(F.max("idx")).first()[0]
    levels = bands(turns, -1 if deepest is None else deepest, height)
    rows = levels[0].select("conv_id", "band", F.posexplode("keys").alias("at", "key"))
    idx = F.col("band") * height + F.col("at")
    counted = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max(idx).alias("idx"), F.count("*").alias("n_convs")
    )
    at = (F.col("idx") % height).cast("int")
    counted = counted.withColumn("band", F.floor(F.col("idx") / height).cast("long"))
    nodes = kept(
        counted.join(levels[0], ["conv_id", "band"]).select(
            "key",
            "conv_id",
            "idx",
            "n_convs",
            ((F.col("n_convs") - 1) * F.get("words", at)).alias("saved"),
            F.when(at > 0, F.get("keys", at - 1)).otherwise(F.col("root")).alias("parent"),
        )
    )
    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children"))
    known = kept(
        nodes.join(children.withColumnRenamed("parent", "key"), "key", "left")
        .fillna(0, ["n_children"])
        .withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    )
    totals = rolled_up(known.select("key", "conv_id", "idx", "leaves", "saved"), levels, height)
    last = levels[0].select("conv_id", "band", F.element_at("keys", -1).alias("key"))
    of = F.floor((F.col("n_turns") - 1) / height).cast("long")
    ended = convs.where("n_turns > 0").select("conv_id", of.alias("band")).join(last, ["conv_id", "band"])
    turnless = convs.where("n_turns = 0").select("conv_id", F.expr(_ROOT).alias("key"))
    ends = joined_digests(kept(ended.select("conv_id", "key").unionByName(turnless)))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    first = convs.agg(F.min("conv_id")).scalar()
    inner = (
        known.join(totals.select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "key")
        .join(parents, "parent", "left")
        .select(
            "key",
            "conv_id",
            (F.col("idx") + 1).alias("depth"),
            F.when(F.col("parent").isNull(), first).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
        )
    )
    whole = known.agg(
        F.struct(
            F.count_if(F.col("idx") == 0).alias("n_children"),
            F.greatest(F.coalesce(F.sum("leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"),
            F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"),
        )
    ).scalar()
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = top.withColumn("whole", whole).select(
        F.expr(_ROOT).alias("key"),
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        "whole.n_children",
        "whole.n_leaves",
        "whole.saved_tokens",
    )
    nothing = hashlib.sha256().hexdigest()
    return (
        inner.unionByName(root)
        .join(ends, "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
        .drop("key")
    )


def shared_head_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of ``conversations`` whose heads are shared as ``with_shared_heads`` says.

    Turns go by ``turn`` (nulls first), then by the digest of role and text; null roles and
    texts are empty; equal rows are turns of their own; rows without a conv_id take no part;
    an empty table gives no rows; further columns are not read.
    """
    return prefix_trie(*with_shared_heads(ordered_turns(conversations)), height)
