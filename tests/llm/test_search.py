"""Conversation trie, quality cascade and ranked search against brute force, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteframe.llm import cascade, lexical, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _conversations():
    rng = np.random.default_rng(7)
    rows = []
    for c in [*range(-3, 45), 60, 61, 400]:
        for turn in range(int(rng.integers(1, 7))):
            said = f"said {int(rng.integers(0, 2))} by turn {turn}"
            rows.append((c, turn, ("user", "assistant")[turn % 2], said))
    for c in (80, 81, 82, 83):  # deeper than several bands, and alike for most of it
        rows += [(c, turn, "user", f"long {turn}" + "!" * (turn > 30 + c % 3)) for turn in range(40)]
    rows += [(100, None, None, None), (100, 0, "user", ""), (101, 0, "", "a b"), (101, 0, "", "a b")]
    rows += [(None, 0, "user", "lost"), (120, 5, "user", "word " * 30_000), (121, 0, None, "only")]
    return rows


def _digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def _brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, _digest(role, text), role or "", text or ""))
    said = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    rebuilt = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        rebuilt[c] = tuple(said.get(base, [])[:h] + said[c][h:])
        for d in range(len(rebuilt[c]) + 1):
            nodes[rebuilt[c][:d]].append(c)
    children = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        cost = (len(members) - 1) * len(WORD.findall(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += cost
    out = Counter()
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(n))))
        parent = min(nodes[n[:-1]]) if n else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out[(min(members), len(n), parent, len(members), children[n], leaves[n], saved[n], sha)] += 1
    return out


@pytest.mark.parametrize("height", [2, 3, 8])
def test_trie(spark, height):
    rows = _conversations()
    schema = "conv_id long, turn long, role string, text string, key string, idx int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(5)
    got = Counter(tuple(r) for r in trie.shared_head_trie(df, height).collect())
    assert got == _brute_trie(rows)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(_conversations(), schema)
    assert trie.shared_head_trie(df.limit(0)).count() == 0
    assert trie.shared_head_trie(df.where("conv_id IS NULL")).count() == 0
    # a single turn that its head leaves out: only the root is left
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    one = spark.createDataFrame([(alone, 0, "user", "x")], schema)
    ends = hashlib.sha256(str(alone).encode()).hexdigest()
    assert [tuple(r) for r in trie.shared_head_trie(one).collect()] == [(alone, 0, None, 1, 0, 1, 0, ends)]


def test_digests_run_over_chunks(spark):
    members = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, b"a").otherwise(b"b").alias("key"), (F.col("id") - 500).alias("conv_id")
    )
    got = dict(map(tuple, trie.joined_digests(members.repartition(7), chunk=10).collect()))
    for key, rest in ((b"a", {0}), (b"b", {1, 2})):
        ids = ",".join(str(i - 500) for i in range(1000) if i % 3 in rest)
        assert got[key] == hashlib.sha256(ids.encode()).hexdigest()


def _documents():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) for _ in range(200)]
    rows = []
    for i in range(120):
        said = rng.choice(words, int(rng.integers(1, 90))).tolist()
        if i % 5 == 0:
            said += said[: int(rng.integers(8, 40))]
        rows.append((i, " ".join(said).replace(words[0], "\n")))
    lines = ["one line of words", "", "  ", "another line of words here"]
    rows += [(200, None), (201, ""), (202, "\n \t\x0b"), (203, "\n".join(lines * 6)), (204, "é\x85ü " * 30)]
    rows += [(205, "word " * 60_000), (206, "a| b# " * 30), (207, "LOUD WORDS! " * 12), (208, "… a...\n" * 20)]
    rows += [(209, " ".join(f"{w} {w} {w}" for w in words[:20])), (None, " ".join(words[:40])), rows[0], rows[0]]
    rows += [(210, " ".join(f"{w}{{}}" for w in words[:40])), (211, "\n".join(f"* {w} is" for w in words[:30]))]
    return rows


def _counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_cascade(spark):
    rows = _documents()
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, _lines string, kept int")
    got = cascade.judge_documents(df).collect()
    counts = Counter((r[0], *_counts(r[1])) for r in rows)
    assert Counter(tuple(r)[:6] for r in got) == counts
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in (200, 201, 202, 203, 204, 205, 206, 207, 208, 209, 210, 211))
    assert kept[None] and not any(r.kept and r.base_failed for r in got)
    good = cascade.good_documents(df)
    assert good.columns == df.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert cascade.judge_documents(df.limit(0)).count() == 0


def test_any_order_of_rules_gives_the_same_verdict(spark):
    df = cascade.with_counts(spark.createDataFrame(_documents(), "doc_id long, text string"))
    rules = list(cascade.RULES)
    orders = [rules, rules[::-1], rules[3:] + rules[:3]]
    verdicts = [cascade.cascade(o).isNull().alias(f"v{i}") for i, o in enumerate(orders)]
    for r in df.select(*verdicts).collect():
        assert r.v0 == r.v1 == r.v2


def test_each_rule_rejects_its_own(spark):
    base = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    texts = {
        "symbols": " ".join(f"{w}|" for w in base),
        "word_length": " ".join(w * 5 for w in base),
        "repeated_lines": "\n".join(["a short line", *base] + ["a short line"] * 30),
        "capitals": " ".join(base).upper(),
        "exclamations": " ".join(f"{w}!" for w in base),
        "braces": " ".join(f"{{{w}}}" for w in base),
        "letters": " ".join(f"{i}{i + 1}" for i in range(100, 140)),
        "stutter": " ".join(f"{w} {w} {w}" for w in base),
        "ellipses": "\n".join(f"{w} is..." for w in base),
        "bullets": "\n".join(f"* {w} is not it" for w in base),
    }
    rows = [(name, i, t) for i, (name, t) in enumerate(texts.items())] + [("none", 99, " ".join(base))]
    df = cascade.with_counts(spark.createDataFrame(rows, "name string, doc_id long, text string"), [F.col("name")])
    for rule in cascade.RULES:
        caught = {r.name for r in df.where(F.expr(rule.rejects)).collect()}
        assert rule.name in caught and "none" not in caught
        if rule.name not in ("symbols", "bullets"):
            assert caught == {rule.name} or rule.name == "repeated_lines"


def test_rules_go_by_rejections_per_cost():
    a, b, c, d = (cascade.Rule(n, "true") for n in "abcd")
    costs = {"a": 1.0, "b": 10.0, "c": 1.0, "d": 0.1}
    # bits: a = 1, b = 2, c = 4, d = 8; c rejects little that a does not reject
    patterns = {0: 100, 1: 50, 5: 60, 4: 5, 2: 400}
    order = cascade.cheapest_order([a, b, c, d], costs, patterns)
    assert [r.name for r in order] == ["a", "b", "c", "d"]
    assert [r.name for r in cascade.cheapest_order([a, b, c], costs, {})] == ["a", "c", "b"]


def test_sample_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert 60 <= cascade.sample_of(df, 100).count() <= 200
    assert cascade.sample_of(df.withColumn("doc_id", F.lit(1)), 100).count() <= 200
    assert cascade.sample_of(df.limit(0), 100).count() == 0


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute_ranks(docs, items, k=10):
    size = [len(_terms(t)) for _, t in docs]
    counts = [Counter(_terms(t)) for _, t in docs]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(t for c in counts for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for (doc, _), c, s in zip(docs, counts, size, strict=True):
            m = 25 + 75 * s * n // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in _terms(text) if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[(item, rank, doc, -score)] += 1
    return out


@pytest.mark.parametrize(("block", "batch"), [(50_000, 4_000_000), (7, 200)])
def test_ranked_search(spark, block, batch):
    rng = np.random.default_rng(5)
    words = [f"{x}{i}" for i in range(30) for x in ("Ab", "é", "Ünt", "漢字")]
    odds = 1 / np.arange(1, len(words) + 1)
    odds /= odds.sum()
    docs = [(i, "-".join(rng.choice(words, int(rng.integers(1, 60)), p=odds))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " .,;"), (None, docs[3][1]), docs[3], docs[3], (503, "ab1 " * 30_000)]
    items = [(i, " ".join(rng.choice(words, 12, p=odds))) for i in range(25)]
    items += [(90, None), (91, "?"), (92, "unknownword"), items[2], (None, "AB0 é0"), (93, "ab1 AB1 Ab1 É0 é0")]
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, item_id string")
    right = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = lexical.search(left.repartition(3), right, 10, block_docs=block, batch_bytes=batch)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == _brute_ranks(docs, items)
    if block > 7:
        assert lexical.search(left.limit(0), right).count() == lexical.search(left, right.limit(0)).count() == 0


def test_best_positions_stop_before_the_end():
    rng = np.random.default_rng(1)
    n, vocabulary = 4000, 40
    odds = 1 / np.arange(1, vocabulary + 1)
    term, count, sizes = [], [], []
    for _ in range(n):
        drawn = rng.choice(vocabulary, int(rng.integers(5, 200)), p=odds / odds.sum())
        t, c = np.unique(drawn, return_counts=True)
        term.append(t), count.append(c), sizes.append(len(drawn))
    holding = np.bincount(np.concatenate(term), minlength=vocabulary).tolist()
    stats = lexical.Collection(n, sum(sizes), holding)
    lists = lexical._block(list(range(n)), sizes, term, count, stats)
    for query in ([(5, 1), (20, 2)], [(39, 1)], [(3, 1), (11, 1), (30, 1), (38, 3)]):
        score = np.zeros(n, np.int64)
        for t, times in query:
            low, high = lists.first[t], lists.first[t + 1]
            score[lists.doc[low:high]] += times * stats.weight(t) * lists.impact[low:high]
        best = np.lexsort((np.arange(n), -score))[:10]
        assert lists.search(query, 10) == [(int(score[i]), int(i)) for i in best]
        whole = sum(holding[t] for t, _ in query)
        assert lists.read < whole / 2
        # a floor from earlier blocks lets the search stop sooner and loses nothing above it
        read, floor = lists.read, int(score[best[0]])
        assert lists.search(query, 10, floor=floor)[0] == (int(score[best[0]]), int(best[0]))
        assert lists.read <= read


def test_runs_give_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    from noteframe.llm import packing, queries

    path = queries.tokenizer_path()
    runs, whole = packing.ChunkTokenizer(path), Tokenizer.from_file(path)
    letters = list("abzABZİIıßẞÀéÉΣσςОжЖאبगक़中文字ญ日ŉǰΐﬁ0129.,!?-_'\"()$#<|>…。、 \t\ń̇　​ \x85🙂")
    rng = np.random.default_rng(0)
    texts = ["KENDİ.", "KENDİ, İ. İ,", "xİ.", "ΟΔΟΣ. ΟΔΟΣ,", ""]
    texts += ["".join(rng.choice(letters, int(rng.integers(1, 14)))) for _ in range(8000)]
    for text in texts:
        assert runs.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_toxicity_reads_no_column_but_its_own(spark):
    from noteframe.llm import toxicity

    rows = [(i, f"plain words number{i} " + ("clodpole dumbwit" if i % 4 == 0 else "table window")) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    odd = docs.selectExpr("*", "'x' id", "1 toxic", "2 text_hash", "3 row", "'y' evidence", "0 score", "1 `term`")
    plain = Counter(tuple(r) for r in toxicity.score_documents(docs, labels).collect())
    wide = labels.selectExpr("*", "'x' id", "'z' text", "1 held_out")
    assert Counter(tuple(r) for r in toxicity.score_documents(odd, wide).collect()) == plain
    left = toxicity.without_toxic(odd, wide)
    assert left.columns == odd.columns and left.count() == sum(n for r, n in plain.items() if not r[3])
