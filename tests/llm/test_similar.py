"""Near-duplicate classes at a stated similarity against brute force, with odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteframe.llm import similar

SCHEMA = "doc_id long, text string, key string, place long, hit int, node string, row string"


def plain(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_ids(rows, similarity=0.8):
    """Smallest ids of the classes, by comparing all sets with each other."""
    sets = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= similarity * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    classes = {}
    for i, (doc_id, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(math.inf if doc_id is None else doc_id)
    return sorted(min(c) for c in classes.values())


def _texts():
    rng = np.random.default_rng(8)
    names = [f"w{i}" for i in range(3000)]
    out = []
    for i in range(30):
        words = list(rng.choice(names, int(rng.integers(60, 900))))
        out.append(" ".join(words))
        for edits in (1, 1 + len(words) // 100, len(words) // 40, len(words) // 12):
            copy = list(words)
            for at in rng.choice(len(words), edits, replace=False):
                copy[at] = f"new{i}"
            out.append(" ".join(copy))
    crowd = list(rng.choice(names, 300))
    for i in range(80):
        copy = list(crowd)
        copy[int(rng.integers(300))] = f"x{i}"
        out.append(" ".join(copy))
    chain = list(rng.choice(names, 200))
    for at in range(0, 60, 2):
        chain[at] = "link"
        out.append(" ".join(chain))
    odd = [None, "", " \t\n", "one", "One", "two words", "Été  naïve x", "a b c d e", "A b\nc d E"]
    return out + odd + [out[0]] * 40 + [" ".join(rng.choice(names, 40000))] * 2


@pytest.fixture(scope="module")
def rows():
    rows = [(i * 7 % 1009, t) for i, t in enumerate(_texts())]
    return rows + [rows[3], rows[3], (None, rows[0][1]), (None, "alone without any id here")]


def _table(spark, rows):
    more = [(i, t, "k", 1, 0, "n", "r") for i, t in rows]
    return spark.createDataFrame(more, SCHEMA).repartition(4)


def test_classes_are_those_of_brute_force(spark, rows):
    docs = _table(spark, rows)
    got = similar.one_of_each(docs)
    assert got.columns == docs.columns
    found = [math.inf if r.doc_id is None else r.doc_id for r in got.collect()]
    expected = kept_ids(rows)
    assert len(found) == len(set(found)) and set(expected) <= set(found)
    folded = len({frozenset(plain(t)) for _, t in rows}) - len(expected)
    assert len(found) - len(expected) <= 0.02 * folded


def test_filter_that_is_too_small_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(similar, "_MAP_BITS", 8)
    monkeypatch.setattr(similar, "_MOST_MAPS", 1)
    docs = _table(spark, rows[-60:])
    keys = docs.select(similar._key().alias("key")).limit(30)
    marked = similar._marked(docs, keys)
    assert marked.count() == 60
    assert marked.join(keys.distinct(), "key", "left_semi").where("NOT hit").count() == 0


def test_empty_and_equal_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similar.one_of_each(empty).count() == 0
    same = _table(spark, [(4, None), (2, ""), (3, " "), (9, None), (9, None)])
    assert [r.doc_id for r in similar.one_of_each(same).collect()] == [2]
    alone = _table(spark, [(5, "a b c d e f"), (5, "g h i j k l"), (None, "m n")])
    assert similar.one_of_each(alone).where(F.col("text").isNotNull()).count() == 3


def test_votes_and_points_by_definition():
    text = " ".join(f"t{i}" for i in range(150))
    found = similar.shingles(text)
    assert len(found) == len(plain(text)) == 146 and (np.diff(found.astype(float)) > 0).all()
    wide = [int(x) for x in similar._mixed(found + similar._steps(2)[1])]
    margin = [sum(1 if x >> b & 1 else -1 for x in wide) for b in range(64)]
    assert similar.votes(found, 100)[64:].tolist() == margin[:36]
    points = similar.meeting_points(found)
    votes = similar.votes(found, 442).reshape(17, 26)
    assert points.shape == (7, 17)
    for s in range(17):
        base = sum(1 << b for b in range(26) if votes[s, b] > 0)
        close = sorted(range(26), key=lambda b: (abs(votes[s, b]), b))[:6]
        assert points[:, s].tolist() == [base, *(base ^ 1 << b for b in close)]


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.94), (0.85, 0.98), (0.9, 0.995)])
def test_share_of_pairs_that_meet(similarity, least):
    rng = np.random.default_rng(2)
    met = apart = 0
    for _ in range(600):
        n = int(rng.integers(30, 500))
        shared = round(n * 2 * similarity / (1 + similarity))
        pool = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
        a, b = (similar.meeting_points(x) for x in (pool[:n], pool[n - shared :]))
        met += any(set(a[:, s]) & set(b[:, s]) for s in range(similar.SEGMENTS))
        distance = sum(int(x ^ y).bit_count() for x, y in zip(a[0], b[0], strict=True))
        apart += distance > similar.farthest(442, similarity)
    assert met >= least * 600 and apart <= 6


def _group(n, words=300, most=14):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for at in rng.choice(words, int(rng.integers(1, most)), replace=False):
            copy[at] = f"e{i}x{at}"
        out.append((i, " ".join(copy)))
    return out


def test_large_group_is_not_paired(spark, monkeypatch):
    rows = _group(240)
    counts, verified = [], similar._verified

    def counted(pairs, *more):
        counts.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(similar, "_verified", counted)
    found = [r.doc_id for r in similar.one_of_each(_table(spark, rows)).collect()]
    expected = kept_ids(rows)
    assert set(expected) <= set(found) and len(found) <= len(expected) + 2
    assert sum(counts) <= 30 * len(rows)


@pytest.mark.parametrize("block", [7, 1000])
def test_crowd_links_connect_as_all_pairs_do(spark, block):
    rows = _group(50) + [(100 + i, t.replace("b", "c")) for i, t in _group(20)] + [(200, "a b c d e f")]
    sets = [(i, similar.shingles(t).view(np.int64).tolist()) for i, t in rows]
    crowd = spark.createDataFrame([(p, i, i, len(rows)) for i, _ in rows for p in (1, 2)], "point long, node long, root long, size long")
    links = similar.crowd_links(crowd, spark.createDataFrame(sets, "node long, found array<long>"), 0.8, block).collect()
    parent = {i: i for i, _ in rows}

    def find(v):
        return v if parent[v] == v else find(parent[v])

    exact = dict(sets)
    for left, right in links:
        both = len(set(exact[left]) & set(exact[right]))
        assert left < right and both >= 0.8 * (len(exact[left]) + len(exact[right]) - both)
        parent[max(find(left), find(right))] = min(find(left), find(right))
    assert sorted({find(i) for i in parent}) == kept_ids(rows)


def test_crowd_links_leave_classes_alone(spark):
    same = spark.createDataFrame([(1, i, 7, 3) for i in (7, 8, 9)], "point long, node long, root long, size long")
    sets = spark.createDataFrame([(i, [1, 2, 3]) for i in (7, 8, 9)], "node long, found array<long>")
    assert similar.crowd_links(same, sets, 0.8, 2).count() == 0
