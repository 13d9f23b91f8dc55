"""Near-duplicates, mixing, fingerprints and packing against brute force, with odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from noteframe.llm import matrices, mixing, packing, queries, simhash, syncmers
from noteframe.llm.common import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
SCHEMA = "doc_id long, text string, source string, lang string, fp long, size long, row string"


def _texts():
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(WORDS, 40)) for _ in range(12)]
    near = []
    for i in range(25):
        words = base[0].split()
        words[i % 40] = "odd"
        near.append(" ".join(words))
    long = " ".join(rng.choice(WORDS, 6000))
    odd = [None, "", " \t\n", "one", "One", "two words", "Été  naïve x", "x\x0by\x0cz w v"]
    return base + near + [base[1]] * 5 + odd + [long, long + " end"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(i * 3, t, [None, "b", "a"][i % 3], "en", i, -i, "r") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[2], "a", None, 0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _plain(text):
    data = (text or "").encode()
    words = [w.lower() for w in data.split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(values, radius=4):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    out = defaultdict(set)
    for v in parent:
        out[find(v)].add(v)
    return {frozenset(x) for x in out.values()}


@pytest.mark.parametrize("hot_bucket", [4096, 2])
def test_near_duplicates(docs, hot_bucket):
    rows = docs.select("doc_id", "text").collect()
    group = {v: c for c in _classes({_plain(r.text) for r in rows}) for v in c}
    first = {}
    for r in rows:
        if r.doc_id is not None:
            c = group[_plain(r.text)]
            first[c] = min(first.get(c, r.doc_id), r.doc_id)
    expected = Counter(
        (r.doc_id, f"{_plain(r.text):016x}", first.get(group[_plain(r.text)])) for r in rows
    )
    got = simhash.near_duplicates(docs, hot_bucket=hot_bucket).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
    assert any(len(c) > 1 for c in group.values())


def test_one_of_each_keeps_the_smallest_id(docs, empty):
    named = simhash.near_duplicates(docs).collect()
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({r.component_id for r in named})
    assert simhash.one_of_each(empty).count() == simhash.near_duplicates(empty).count() == 0


def test_segments_miss_nothing():
    rng = np.random.default_rng(1)
    plan = simhash.segment_plan(4, 3)
    assert sum(w for _, w, _ in plan) == 64
    for _ in range(2000):
        bits = rng.choice(64, 4, replace=False)
        apart = sum(1 << int(b) for b in bits)
        assert any((apart >> s & (1 << w) - 1).bit_count() <= r for s, w, r in plan)


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(40)]
    got = components(spark.createDataFrame(links, "left long, right long")).collect()
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in links:
        if a != b:
            parent[find(a)] = find(b)
    groups = defaultdict(set)
    for r in got:
        groups[r.root].add(r.node)
    expected = defaultdict(set)
    for v in list(parent):
        expected[find(v)].add(v)
    assert {frozenset(x) for x in groups.values()} == {frozenset(x) for x in expected.values()}


def test_mix_fills_targets(docs, empty):
    rows = mixing.curriculum_mix(docs).collect()
    total = sum(r["size"] for r in rows)
    sizes, weights = defaultdict(int), {}
    for r in rows:
        assert r["size"] == len((r["row"].text or "").encode().split())
        sizes[r["source"]] += r["size"]
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s))):
        weights[s] = (5, 2, 1)[i % 3]
    targets, open_ = {}, dict(weights)
    left = float(total)
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * level > 3 * sizes[s]]
        for s in over or list(open_):
            targets[s] = 3.0 * sizes[s] if over else open_[s] * level
            left -= targets[s] if over else 0
            del open_[s]
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(p.words for p in r["passes"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.5
    again = mixing.curriculum_mix(docs.repartition(5)).collect()
    shape = lambda x: sorted((str(r["row"]), r["taken"], str(r["passes"])) for r in x)
    assert shape(again) == shape(rows)
    assert mixing.curriculum_mix(empty).count() == 0


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, s) for i in range(3000) for s in ("a", "b", "c")]
    table = spark.createDataFrame([(3 * i + j, t, s) for j, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    mixed = mixing.curriculum_mix(table).select("source", F.explode("passes").alias("p"))
    share = mixed.groupBy("source").agg(F.avg((F.col("p.position") < 0.5).cast("double")).alias("x"))
    found = {r.source: r.x for r in share.collect()}
    assert found["a"] == pytest.approx(0.625, abs=0.01)
    assert found["b"] == pytest.approx(0.5, abs=0.01)
    assert found["c"] == pytest.approx(0.375, abs=0.01)


def test_training_order_repeats_and_cuts(docs):
    ordered = mixing.training_order(docs)
    assert ordered.columns == docs.columns
    taken = {}
    for r in mixing.curriculum_mix(docs).collect():
        key = (r["row"].doc_id, r["row"].source)
        taken[key] = taken.get(key, 0) + r["taken"]
    got = defaultdict(int)
    for r in ordered.collect():
        got[(r.doc_id, r.source)] += len(r.text.encode().split())
    assert got == {k: v for k, v in taken.items() if v}


def test_fingerprints(docs, empty, spark):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    rows = sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h % 2**64 >> 11), reverse=True)
    got = syncmers.document_fingerprints(docs).collect()
    expected = []
    for i, r in enumerate(rows):
        after = rows[(i + 1) % len(rows)].text
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after[:half]
        expected.append((r.doc_id, len(r.text), hashlib.sha256(edited.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(expected)
    by_text = {}
    text_of = {r.doc_id: r.text for r in rows}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
    long = next(r for r in got if r.n_chars > 20000)
    assert 0.3 < long.near_edited < 0.7
    assert syncmers.document_fingerprints(empty).count() == 0
    one = syncmers.document_fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert one.first().edited_sha256 == hashlib.sha256(b"a a").hexdigest()


def test_syncmers_are_context_free(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [passage, "x y z " + passage, passage + " q r s", "unlike " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(r.s) for r in syncmers.with_syncmers(df, "text", "s").orderBy("doc_id").collect()]
    assert sets[0] <= sets[1] and sets[0] <= sets[2] and not sets[0] & sets[3]
    assert 10 < len(sets[0]) < 40


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def test_chunked_ids_equal_whole_texts(encode):
    own = packing.ChunkTokenizer(queries.tokenizer_path(), limit=50)
    odd = "a<|endoftext|>b c.,d, İx. Σσς ’s don't the,. x'll,, é. 1. a1. ﬁ. Ⅷ, ... . ,"
    for text in [*_texts(), odd, odd.upper()]:
        assert own.ids(text).tolist() == encode(text)


@pytest.mark.parametrize("max_open", [4096, 3])
def test_packing_is_lossless(docs, encode, max_open):
    pieces = packing.pack_documents(docs, queries.tokenizer_path(), window=256, max_open=max_open).collect()
    ids = {(r.doc_id): [*encode(r.text), 1] for r in docs.collect()}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        whole = np.array(ids[p.doc_id], "<u4")
        assert p.doc_tokens == len(whole)
        assert p.ids == whole[p.start : p.start + p.length].tobytes() and p.length > 0
        by_doc[p.doc_id] += range(p.start, p.start + p.length)
        by_window[p.sequence_id] += range(p.offset, p.offset + p.length)
    copies = Counter(r.doc_id for r in docs.collect())
    for doc, at in by_doc.items():
        assert Counter(at) == {i: copies[doc] for i in range(len(ids[doc]))}
    assert set(by_doc) == set(ids)
    for at in by_window.values():
        assert sorted(at) == list(range(len(at)))
        assert len(at) == 256 or len(at).bit_count() == 1


def test_sum_of_squares_choice():
    packer = packing.Packer(10, 100)
    add = lambda n: packer.add(0, np.zeros(n, np.uint32))
    add(6)
    add(6)
    assert packer.count[6] == 2
    add(4)  # filling a window takes one from the count of level 6
    assert packer.count[6] == 1 and len(packer.take()) == 1
    add(25)
    assert len(packer.take()) == 2 and packer.count[5] == 1


def test_window_matrix(docs, empty):
    path = queries.tokenizer_path()
    pieces = packing.pack_documents(docs, path, window=256)
    rows = packing.window_matrix(pieces, 256).collect()
    assert sum(r.tokens for r in rows) == pieces.agg(F.sum("length")).first()[0]
    for r in rows:
        full = r.tokens if r.tokens.bit_count() == 1 else 256
        assert len(r.ids) == 4 * full and r.ends[-1] == r.tokens
    assert packing.pack_documents(empty, path).count() == 0


def test_digest_columns(docs):
    rows = queries.packed(docs).collect()
    assert all(0 <= r.ids_crc32 < 2**32 for r in rows)
    assert zlib.crc32(np.array([1], "<u4").tobytes()) in {r.ids_crc32 for r in rows if r.doc_tokens == 1}


def test_best_fit_decreasing():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 65, 500).tolist()
    rows, free = [], []
    for i in sorted(range(500), key=lambda i: -sizes[i]):
        fits = [(f, r) for r, f in enumerate(free) if f >= sizes[i]]
        if not fits:
            rows.append([])
            free.append(64)
        r = min(fits)[1] if fits else len(rows) - 1
        rows[r].append(i)
        free[r] -= sizes[i]
    got = matrices.best_fit(sizes, 64)
    fill = lambda x: sorted(sum(sizes[i] for i in r) for r in x)
    assert fill(got) == fill(rows) and sorted(i for r in got for i in r) == list(range(500))


@pytest.mark.parametrize("group", [4_000_000, 500])
def test_matrices_are_lossless(docs, empty, encode, group):
    path = queries.tokenizer_path()
    rows = matrices.token_matrices(docs, path, row=256, pad_id=7, group_tokens=group)
    ids = {r.doc_id: [*encode(r.text), 1] for r in docs.collect()}
    copies = Counter(r.doc_id for r in docs.collect())
    seen = defaultdict(Counter)
    for r in rows.collect():
        data, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(data) == len(positions) == 256
        low = 0
        for doc, start, total, high in zip(r.doc_ids, r.starts, r.doc_tokens, r.segment_ends, strict=True):
            assert data[low:high].tolist() == ids[doc][start : start + high - low]
            assert positions[low:high].tolist() == list(range(high - low)) and total == len(ids[doc])
            seen[doc].update(range(start, start + high - low))
            low = high
        assert (data[low:] == 7).all() and not positions[low:].any()
    assert seen == {d: Counter({i: copies[d] for i in range(len(x))}) for d, x in ids.items()}
    back = matrices.segments(rows).collect()
    assert all(s.ids == np.array(ids[s.doc_id][s.start : s.start + s.length], "<u4").tobytes() for s in back)
    assert matrices.token_matrices(empty, path).count() == 0


def test_exploded_fingerprints_are_never_broadcast(spark):
    fps = spark.range(3000).select(F.xxhash64("id").alias("fp")).union(spark.range(40).selectExpr("id * 1024 AS fp")).distinct()
    for hot_bucket in (4096, 8):  # all paired, and a crowd linked through points
        links = simhash.near_links(fps, hot_bucket=hot_bucket)
        rows = links.collect()
        assert rows and all((r["left"] ^ r["right"]).bit_count() <= 4 for r in rows)
        final = links._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # the buckets of many fingerprints are short and may be sent; what is joined with them is not
        joins = [v for v in final.split("\n") if "Join " in v and "Inner" in v]
        assert joins and all("SortMergeJoin" in v for v in joins)
