"""Web pages, conversations, top-k search, toxicity and the pipeline, with odd rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similar import kept_ids

import corpus_pipeline
from noteframe.llm import chat, queries, topk, toxicity, warc, wrapper
from noteframe.llm.common import read

SMALL = "/root/testdata/sf0.001"


def _page(i, comment="", notice="We use cookies."):
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><script>var a='</p><p>';</script></head><body>"
        f"<nav><ul><li><a href='/a'>Menu {i}</a></ul></nav><div class='ad'>Buy {i}</div>"
        f"<article><h1>Head {i} &amp; co</h1><div class='bar'>{notice}</div>"
        f"<p>One  <b>bo</b>ld{i}<br>line<p>Two &#8364; &lt;x&gt;<section class='comments'>{comment}</section>"
        f"</article><aside>Side {i}</aside><footer>&copy; {i}</footer>"
    )


def test_pages(spark):
    rows = [(i, f"http://Host.example/{i}", _page(i, f"Nice {i}"), "x") for i in range(8)]
    rows += [(50, None, None, "x"), (51, "nohost", "", "x"), (52, "http://b.example", "plain <i>te</i>xt", "x")]
    rows += [(53, "http://c.example/1", "<p>" + "word " * 50_000, "x"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = wrapper.main_texts(df).collect()
    texts = {r.page_id: r.text for r in got}
    for i in range(8):
        assert texts[i] == f"Head {i} & co One bold{i} line Two € <x>"
    assert texts[50] == texts[51] == ""
    assert texts[52] == "plain text"
    assert texts[53] == " ".join(["word"] * 50_000)
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    assert wrapper.main_texts(df.limit(0)).count() == 0


def _read(html):
    tree = wrapper.parse(html)
    return wrapper.Wrapper(wrapper.folded(tree)).read(tree)


def test_inline_boilerplate_ends_at_its_end_tag():
    assert _read('<p>Text <a class="share">x</a> more</p>') == "Text more"
    assert _read('<article><span class="ad">x</span><p>One</p><p>Two</p></article>') == "One Two"
    assert _read('<body><a id="menu"></a><a class="menu" href="#m">Skip</a><article><p>All</p></article>') == "All"
    assert _read('<a id="menu"/><article><p>All</p></article>') == "All"
    assert _read('<p>a <span class="ad">b <span>c</span> d <b>e</b></span> f <i>g</i></p>') == "a f g"
    assert _read('<p>a <a class="share">b <a href="/">c</a> d</p><p>e</p>') == "a c d e"
    assert _read('<p>a <span class="ad">b <em role="alert">c</span> d</p>') == "a d"
    assert _read('<article><span class="ad"><p>a <span>b</span> c</p></span><p>d</p></article>') == "d"


def _story(i, more=""):
    return f"<article><h1>Head {i}</h1><div class='bar'>We use cookies.</div><p>Text {i}</p>{more}</article>"


def test_copies_of_an_article_are_no_template(spark):
    same = [_story(99, "<ul><li>Own list</li></ul><blockquote>Own quote</blockquote>")] * 7
    same = [f"<nav>{i % 3}</nav>{html}" for i, html in enumerate(same)]
    few = [_story(i, "<table><tr><td>Some table</td></tr></table>") for i in range(5)]
    pages = same + few + [_story(i) for i in range(5, 20)]
    rows = [(i, f"http://a.example/{i}", html) for i, html in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    texts = {r.page_id: r.text for r in wrapper.main_texts(df).collect()}
    for i in range(7):
        assert texts[i] == "Head 99 Text 99 Own list Own quote"
    for i in range(20):
        assert texts[7 + i] == f"Head {i} Text {i}" + (" Some table" if i < 5 else "")


def test_digests_of_a_node_do_not_depend_on_the_order_of_merges():
    rng = np.random.default_rng(8)
    values = [int(x) for x in rng.integers(0, 1 << 40, 300)]
    expected = sorted(set(values))[: wrapper.SAMPLE]
    for _ in range(5):
        parts = [[v] for v in rng.permutation(values).tolist()]
        while len(parts) > 1:
            parts.append(wrapper._smallest(parts.pop(int(rng.integers(len(parts)))), parts.pop(0)))
        assert parts[0] == expected


def test_tree_matching():
    a, b = (wrapper.folded(wrapper.parse(_page(i, "c"))) for i in (1, 2))
    size = lambda n: 1 + sum(size(c) for c in n.children)
    assert wrapper.matched(a, b, {}) == size(a)
    c = wrapper.folded(wrapper.parse("<nav>x</nav><div>new</div><article><h1>y</h1></article>"))
    assert 0 < wrapper.matched(a, c, {}) < size(a)
    merged = wrapper.merge(a, c)
    keys = [x.key for x in merged.children]
    assert keys.index("nav") < keys.index("div") < keys.index("article")


def test_warc_derivatives(spark):
    rows = [(1, "http://a.example/1\r\nX: y", _page(1, "nice"), "r"), (2, None, None, "r"), (None, "u", "<p>é</p>" * 9000, "r")]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, record string")
    made = warc.responses(df).collect()
    got = warc.derived(warc.responses(df)).collect()
    assert len(made) == 4 and len(got) == 8
    sources = {warc.read_record(bytes(r.record))[0]["warc-record-id"]: bytes(r.record) for r in made}
    for r in got:
        named, block = warc.read_record(bytes(r.record))
        source, http = warc.read_record(sources[r.refers_to])
        body = http.partition(b"\r\n\r\n")[2]
        assert named["warc-type"] == r.type and named["warc-refers-to"] == source["warc-record-id"]
        assert named["warc-target-uri"] == source["warc-target-uri"] == r.target_uri
        assert named["warc-block-digest"] == warc.digest(block) == r.block_digest
        assert r.source_digest == source["warc-payload-digest"] == warc.digest(body)
        assert len(block) == r.content_length == int(named["content-length"])
        if r.type == "metadata":
            assert b"http-content-type: text/html; charset=utf-8\r\n" in block
            assert source["warc-block-digest"].encode() in block
        else:
            assert block.decode() == warc.plain_text(body.decode())
    text = warc.plain_text(_page(1))
    assert "var a" not in text and "One bold1 line\nTwo € <x>" in text
    assert warc.derived(warc.responses(df.limit(0))).count() == 0
    broken = spark.createDataFrame([(1, None), (2, b"WARC/1.1\r\nnothing")], "key long, record binary")
    assert warc.derived(broken).count() == 4


def _turns():
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said + "\\\n#\\#"), (2, 1, "assistant", None)]
    rows += [(2, 0, None, "é\U0001f600 </turn>\n### user\nx"), (2, None, "user", "first"), (None, 0, "odd\nrole:", "")]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "assistant", "long " * 40_000)]
    return rows + [(5, i, ("user", "assistant")[i % 2], f"turn {i} " * 30) for i in range(700)]


@pytest.mark.parametrize("part_bytes", [1 << 24, 20_000])
def test_conversations(spark, part_bytes):
    rows = _turns()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    formatted = chat.format_conversations(df, part_bytes=part_bytes)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        r = got[conv]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(learned)
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    parts = formatted.where("conv_id = 5").count()
    assert parts > 1 if part_bytes < 1 << 20 else parts == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.integers(-3, 4, (400, 6)) / 4).tolist()
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    rows += [(20, rows[20][1], 1), (20, rows[20][1], 1), (21, rows[0][1], 1)]
    rows += [(40, None, 0), (60, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (80, [math.nan] * 6, 0), (100, [math.inf] * 6, 0)]
    rows += [(1000, [1.0, 2.0], 0), (1001, [2.0, 2.0], 0), (None, [1.0] * 6, 0), (2000, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    whole = [
        (i, tuple(math.floor(1024 * x) for x in v)) for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    expected = Counter()
    for place, (i, v) in enumerate(whole):
        if i % 20 == 0:
            found = [
                (-sum(a * b for a, b in zip(v, w, strict=True)), j)
                for other, (j, w) in enumerate(whole) if other != place and len(w) == len(v)
            ]
            for rank, (s, j) in enumerate(sorted(found)[:10], 1):
                expected[(i, rank, j, -s)] += 1
    for block in (8192, 50):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, 10, vector_block=block, query_block=7)
        assert Counter(tuple(r) for r in got.collect()) == expected
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-1000, 1000, (5000, 3))
    lists = topk.Lists(np.arange(5000), vectors, np.ones(5000, np.int64))
    query = np.array([5, 0, -3])
    best = lists.search(query, -1, 5)
    scores = vectors @ query
    assert [s for s, _, _ in best] == sorted(scores.tolist(), reverse=True)[:5]


def test_kernel_tolerates_gaps():
    near = toxicity.gram(["idiot", "idxiot", "idioot", "iidiot", "random"], ["idiot"])[:, 0]
    assert near[0] == pytest.approx(1)
    assert (near[1:4] > 0.5).all() and near[4] < 0.2
    terms = ["idiot", "moron", "rabbit", "idol"]
    full = toxicity.gram(terms, terms)
    features = full @ toxicity.nystroem(terms)
    assert features @ features.T == pytest.approx(full, abs=1e-3)


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghklmnoprstu"), 6)) for _ in range(300)]
    insults = ["dumbwit", "stinkface", "clodpole"]
    rows, labels = [], []
    for i in range(600):
        said = rng.choice(words, 40).tolist()
        toxic = i % 5 == 0
        if toxic:
            for at in rng.choice(40, 4, replace=False):
                said[at] = insults[int(rng.integers(3))]
        rows.append((i, " ".join(said), "x"))
        labels.append((i, int(toxic), 0))
    rows += [(9000, None, ""), (9001, "", ""), (9002, "hey d u m b w i t and stinkkface you clodp-ole dumbwitt", "")]
    rows += [(9003, "quiet " * 30_000, ""), (None, "clodpole dumbwit stinkface", ""), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, held_out int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r for r in got}
    truth = dict((i, t) for i, t, _ in labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert score[9002].predicted == 1 and score[None].predicted == 1
    assert score[9000].predicted == score[9001].predicted == score[9003].predicted == 0
    left = toxicity.without_toxic(docs, marks)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in got if not r.predicted)
    assert toxicity.score_documents(docs.limit(0), marks.limit(0)).count() == 0
    assert {r.predicted for r in toxicity.score_documents(docs, marks.limit(0)).collect()} == {0}


def test_a_capped_sample_keeps_the_share_of_toxic_rows(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghklmnoprstu"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(3000):
        said = rng.choice(words, 30).tolist()
        toxic = i % 10 == 0
        if toxic or i % 10 < 3:  # a word that two of three times is clean
            said[3] = "dumbwit"
        if toxic and i % 3:
            said[7] = "clodpole"
        rows.append((i, " ".join(said)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, *rows[:50] * 40], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, *labels[:9]], "doc_id long, toxic int")
    known = toxicity.training_labels(marks)
    sample = toxicity.training_rows(docs, known, 100)
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert size == {0: 100, 1: 100}
    low, high = toxicity.row_weights(known, size, 100)
    truth = Counter(r.toxic for r in known.collect())
    assert high * 100 / 200 == pytest.approx(truth[1] / (truth[0] + truth[1])) and low + high == pytest.approx(2)
    assert toxicity.row_weights(known, dict(truth), 4000) == (1, 1)
    whole = {r.doc_id: r.score for r in toxicity.score_documents(docs, marks).collect()}
    capped = {r.doc_id: r.score for r in toxicity.score_documents(docs, marks, 200).collect()}
    mean = lambda scores: np.mean([scores[i] for i, _ in labels])
    assert mean(capped) == pytest.approx(mean(whole), abs=0.04)


def test_long_runs_are_scored_whole():
    names = ["dumbwit", "stinkface", "clodpole", "quiet", "green", "window", "table", "little"]
    mapping = toxicity.nystroem(names)
    weights = toxicity.svm(toxicity.gram(names, names) @ mapping, np.r_[np.ones(3), -np.ones(5)], np.full(8, 9.0))
    row, key, value = toxicity.subsequences(toxicity.encoded(names))
    table = np.zeros(toxicity.ALPHABET**3)
    np.add.at(table, key, value * (mapping @ weights[:-1])[row])
    scorer = toxicity.Scorer(toxicity.Model(table, float(weights[-1]), np.zeros(toxicity.EVIDENCE + 1)))
    clean = ["quiet", "green", "window", "table", "little"] * 40
    for mark in ("", ".", ",", "_", "\u00a0", "\u3000", "\u200b", "\u3002"):
        quiet = scorer.evidence(mark.join(clean))
        for insult in names[:3]:
            for at in (0, 15, 101, 200):
                said = mark.join([*clean[:at], insult, *clean[at:]])
                assert scorer.evidence(said)[0] > max(0.3, quiet[0] + 0.3), (mark, insult, at)
    for size in (49, 71, 72, 73, 500):
        run = "".join(chr(0x4E00 + i) for i in range(size))
        assert set("".join(toxicity.stretches(run))) == set(run)
        assert max(map(len, toxicity.stretches(run))) == 48
    assert toxicity.stretches("id-iot") == toxicity.pieces("id-iot") == ["id-iot"]


def test_pipeline(spark):
    docs = read(spark, SMALL, "documents")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SMALL))
        steps[-1] = spark.createDataFrame(steps[-1].toPandas(), steps[-1].schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "source_mix", "packing"]
    for df in steps[1:-1]:
        assert df.columns == docs.columns
    scores = toxicity.score_documents(docs, read(spark, SMALL, "labels")).collect()
    assert {r.doc_id for r in steps[1].collect()} == {r.doc_id for r in scores if not r.predicted}
    texts = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert sorted(r.doc_id for r in steps[2].collect()) == kept_ids(texts)
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(whole.columns) == sorted(steps[-1].columns)
    tokens = lambda df: Counter({r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()})
    assert tokens(whole) == tokens(steps[-1])


def test_every_query_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == [*range(1, 14)]
