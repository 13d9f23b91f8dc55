"""Toxicity by a gap-weighted subsequence string kernel and a support vector machine.

A term (a word, or a run of single letters written apart) is mapped to its subsequences of
three characters, gaps allowed: ``i..d..t`` weighs ``DECAY ** span``. The normalised kernel of
two terms is the cosine of these maps, so letters put in between or left out cost weight, not
the match. Landmark terms give the Nyström map, a squared-hinge support vector machine is
trained on it. A document's score is a logistic curve over the margins of its most toxic terms
and over how many it has. As the kernel is an explicit inner product, the trained machine folds into one table
of weights per subsequence; scoring is a lookup and exact, not an approximation of it.

The fit reads a bounded sample of labelled rows (``per_class`` of each label, by hash of the
id), weighted so that both labels have their share of all labelled rows; every document is scored, whole. Runs end at any white space; one of more letters than a
term may have is scored by its pieces between marks and by overlapping windows. Neither language, source, labels nor ids enter a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import kept

THRESHOLD = 0.3
SPAN = 6
DECAY = 0.7
ALPHABET = 96
_START, _END = 27, 28
_PAIRS = [(a, b) for a in range(1, SPAN) for b in range(a + 1, SPAN + 1)]
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_LENGTH = 48
#: Letters of the windows, a third apart, that a term of full length is also scored by.
_WINDOWS = (8, 12, 24)
#: Terms whose subsequences stand in memory at a time.
_BLOCK = 400


def letters(raw: str) -> str:
    """A run of text in lower case without anything but letters."""
    low = raw.lower().strip(".,;:!?\"'()")
    return low if low.isalpha() else "".join(c for c in low if c.isalpha())


def pieces(run: str) -> list[str]:
    """A run of more than ``_LENGTH`` letters cut at its marks and digits, others as they are.

    Combining marks (accents, Thai vowels) stay with their letters.
    """
    if len(run) <= _LENGTH or len(letters(run)) <= _LENGTH:
        return [run]
    return "".join(c if c.isalpha() or category(c)[0] == "M" else " " for c in run).split()


def stretches(run: str) -> list[str]:
    """The terms that a run is scored by, so that each letter is.

    Long runs give their pieces, and all letters in stretches of ``_LENGTH`` that overlap by
    half: words that marks or nothing at all stand between are met in their windows.
    """
    if len(run) <= _LENGTH or len(low := letters(run)) <= _LENGTH:
        return [run]
    starts = range(0, len(low) - _LENGTH // 2, _LENGTH // 2)
    return [x for x in pieces(run) if len(x) <= _LENGTH] + [
        low[min(i, len(low) - _LENGTH) :][:_LENGTH] for i in starts
    ]


def windows(term: str) -> list[str]:
    """A term, and if it has full length also all its windows."""
    if len(term) < _LENGTH:
        return [term]
    return [term] + [
        term[i : i + n] for n in _WINDOWS for i in [*range(0, len(term) - n, n // 3), len(term) - n]
    ]


def encoded(terms: list[str]) -> np.ndarray:
    """Character classes of terms between edge marks, padded with zeros."""
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    if sizes.max(initial=0) > _LENGTH:
        terms = [t[:_LENGTH] for t in terms]
        sizes = np.minimum(sizes, _LENGTH)
    out = np.zeros((len(terms), int(sizes.max(initial=0)) + 2), np.int64)
    codes = np.frombuffer("".join(terms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    plain = (codes >= 97) & (codes <= 122)
    place = np.arange(out.shape[1])[None, :] - 1
    out[(place >= 0) & (place < sizes[:, None])] = np.where(plain, codes - 96, 29 + codes % (ALPHABET - 29))
    out[:, 0] = _START
    out[np.arange(len(terms)), sizes + 1] = _END
    return out


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, value) of the unit-length kernel maps, equal subsequences summed."""
    n, width = codes.shape
    keys, values, rows = [], [], []
    index = np.arange(n, dtype=np.int64)
    for a, b in _PAIRS:
        if b >= width:
            continue
        x, y, z = codes[:, : width - b], codes[:, a : width - b + a], codes[:, b:]
        there = z > 0
        keys.append(((x * ALPHABET + y) * ALPHABET + z)[there])
        rows.append(np.broadcast_to(index[:, None], there.shape)[there])
        values.append(np.full(len(keys[-1]), DECAY ** (b + 1)))
    if not keys:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0)
    row, key, value = np.concatenate(rows), np.concatenate(keys), np.concatenate(values)
    both, back = np.unique(row * ALPHABET**3 + key, return_inverse=True)
    value = np.bincount(back, value, len(both))
    row, key = np.divmod(both, ALPHABET**3)
    norm = np.sqrt(np.bincount(row, value**2, n))
    return row, key, value / norm[row]


def gram(terms: list[str], landmarks: list[str], block: int = 500) -> np.ndarray:
    """Kernel values of terms against landmarks."""
    l_row, l_key, l_value = subsequences(encoded(landmarks))
    known, place = np.unique(l_key, return_inverse=True)
    table = np.zeros((len(known), len(landmarks)))
    np.add.at(table, (place, l_row), l_value)
    out = np.zeros((len(terms), len(landmarks)))
    for i in range(0, len(terms), block):
        part = terms[i : i + block]
        row, key, value = subsequences(encoded(part))
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[at] == key
        dense = np.zeros((len(part), len(known)), np.float32)
        dense[row[hit], at[hit]] = value[hit]
        out[i : i + len(part)] = dense @ table
    return out


def nystroem(landmarks: list[str]) -> np.ndarray:
    """The map from kernel values against landmarks to features: the inverse root of their Gram."""
    values, vectors = np.linalg.eigh(gram(landmarks, landmarks))
    keep = values > 1e-6
    return vectors[:, keep] / np.sqrt(values[keep])


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights (the bias last) of a squared-hinge support vector machine, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        a, c = x[active], cost[active]
        w = np.linalg.solve(ridge + a.T @ (a * c[:, None]), a.T @ (c * y[active]))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


@dataclass
class Model:
    """Weight per subsequence, bias, and the logistic weights from evidence to scores."""

    table: np.ndarray
    bias: float
    weights: np.ndarray

    def margins(self, terms: list[str]) -> np.ndarray:
        out = np.full(len(terms), self.bias)
        row, key, value = subsequences(encoded(terms))
        if len(row):
            out += np.bincount(row, self.table[key] * value, len(terms))
        return np.clip(out, -2, 2)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        x = np.hstack((evidence, np.ones((len(evidence), 1)))) @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


#: What a document's score is read from: the margins of its three most toxic terms, how many
#: terms are toxic, and how many per thousand words.
EVIDENCE = 5


class Scorer:
    """Evidence of texts; each distinct run between white space is computed once per worker.

    A term's margin is the largest of its windows. The memory of runs is bounded: at ``limit``
    it starts anew.
    """

    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit, self.seen = model, limit, {}

    def learn(self, runs: list[str]) -> None:
        """Margins of runs; those that differ in marks and capitals only are computed once."""
        of = {r: letters(r) for r in runs}
        cores = list(dict.fromkeys(of.values()))
        margin: dict[str, float] = {}
        for i in range(0, len(cores), 4_000):
            part = cores[i : i + 4_000]
            parts = [windows(c) for c in part]
            terms = [t for x in parts for t in x]
            blocks = [self.model.margins(terms[j : j + _BLOCK]) for j in range(0, len(terms), _BLOCK)]
            first = np.cumsum([0, *map(len, parts[:-1])])
            margins = np.maximum.reduceat(np.concatenate(blocks), first)
            margin.update(zip(part, margins.tolist(), strict=True))
        self.seen.update((r, margin[c]) for r, c in of.items())

    @staticmethod
    def counted(text: str | None) -> tuple[int, Counter]:
        """(words, times of each run) of a text."""
        text = text or ""
        words = text.split()
        words += [re.sub(r"\s", "", x) for x in _SPACED.findall(text)]
        if max(map(len, words), default=0) > _LENGTH:
            words = [x for w in words for x in stretches(w)]
        return len(words), Counter(words)

    def evidences(self, texts: list[str | None]) -> list[list[float]]:
        """Evidence of each text; what they hold that is new is learnt in one go."""
        counted = [self.counted(t) for t in texts]
        if len(self.seen) > self.limit:
            self.seen.clear()
        seen = self.seen
        if new := list(dict.fromkeys(r for _, runs in counted for r in runs if r not in seen)):
            self.learn(new)
        out = []
        for n, runs in counted:
            margins = np.fromiter(map(seen.__getitem__, runs), float, len(runs))
            times = np.fromiter(runs.values(), float, len(runs))
            toxic = float((times / (1 + np.exp(-6 * margins))).sum())
            top = np.sort(np.concatenate((margins, np.full(3, -2.0))))[:-4:-1]
            out.append([*top.tolist(), math.log1p(toxic), min(3.0, 100 * toxic / (n + 20))])
        return out

    def evidence(self, text: str | None) -> list[float]:
        return self.evidences([text])[0]


def _chunks(texts: pa.Array, most: int = 200_000) -> Iterator[list[str | None]]:
    """Texts in groups of about ``most`` characters, so that memory holds one group's runs."""
    part, size = [], 0
    for value in texts:
        part.append(value.as_py())
        size += len(part[-1] or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def training_labels(labels: DataFrame) -> DataFrame:
    """(id, toxic) of each labelled id that is not held out (crc32 of the id modulo 4 is 2)."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where(
        "id IS NOT NULL AND toxic IN (0, 1) AND crc32(encode(string(id), 'UTF-8')) % 4 != 2"
    )
    return known.groupBy("id").agg(F.max("toxic").alias("toxic"))


def training_rows(docs: DataFrame, known: DataFrame, per_class: int) -> DataFrame:
    """(toxic, text) of at most ``per_class`` labelled documents of each label.

    The ids are limited before the join, so the broadcast side has at most ``2 * per_class``
    rows whatever the size of the tables. Rows of one id fold into its smallest text.
    """
    order = [F.xxhash64("id"), F.col("id")]
    parts = [known.where(F.col("toxic") == x).orderBy(*order).limit(per_class) for x in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    rows = slim.join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).drop("id")


def row_weights(known: DataFrame, size: dict[int, int], per_class: int) -> tuple[float, float]:
    """Weights of a clean and a toxic sampled row: one on average, and by label as many rows as
    all labelled ids have; one each where no label has more than ``per_class``."""
    ids = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    stands = [max(1.0, ids.get(x, 0) / per_class) for x in (0, 1)]
    whole = sum(w * size.get(x, 0) for x, w in enumerate(stands))
    scale = sum(size.values()) / whole if whole else 1.0
    return stands[0] * scale, stands[1] * scale


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of either label that have the term.

    Near copies of a document count once: documents are told apart by the smallest hash of
    their terms. Over ``_LENGTH`` letters without any mark between them are no term.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for toxic, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = {letters(x) for w in (text or "").split() for x in pieces(w)}
                found = [w for w in found if 2 < len(w) <= _LENGTH]
                if not found:
                    continue
                mark = min(xxh64_intdigest(w.encode()) for w in found) >> 1
                out[0].extend(found)
                out[1].extend([toxic] * len(found))
                out[2].extend([mark] * len(found))
            types = (pa.string(), pa.int32(), pa.int64())
            arrays = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["term", "toxic", "mark"])

    found = rows.select(F.col("toxic").cast("int").alias("toxic"), F.col("text")).mapInArrow(
        terms, "term string, toxic int, mark long"
    )
    marks = found.groupBy("term", "toxic", "mark").count()
    return marks.groupBy("term").agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")
    )


def _tail(n: int, k: int, p: float) -> float:
    """Chance of at least ``k`` of ``n`` when each has chance ``p``."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def insult_terms(
    counts: DataFrame, share: float, most: int, weights: tuple[float, float] = (1.0, 1.0)
) -> list[tuple[str, int, int]]:
    """(term, toxic, clean) of terms in toxic documents more often than chance explains.

    ``share`` is the toxic one of all labelled rows, ``weights`` those of sampled clean and
    toxic rows. The chance of a term's count, times the number of terms seen as often, must be
    under one half: about half a term is expected to come in by chance. A term that has nothing
    to do with the label is toxic as often as rows of the sample are, so counts of the sample
    are held against the sample's share; how toxic a term is, is read from weighted counts.
    """
    seen = counts.withColumn("n", F.col("toxic") + F.col("clean")).where("toxic >= 3")
    sizes = {r["n"]: r["count"] for r in seen.groupBy("n").count().collect()}
    ratio = min(0.9, 3 * share)
    low, high = weights
    chance = share * low / (share * low + (1 - share) * high)
    found = []
    toxic, clean = high * F.col("toxic"), low * F.col("clean")
    likely = seen.where(toxic >= ratio * (toxic + clean))
    for r in likely.orderBy(F.desc("toxic"), "term").limit(20 * most).collect():
        rivals = sum(c for n, c in sizes.items() if n >= r["n"])
        if _tail(min(r["n"], 900), min(r["toxic"], 900), chance) * rivals < 0.5:
            found.append((r["term"], r["toxic"], r["clean"]))
    return found[:most]


def near_terms(counts: DataFrame, toxic: list[str], least: float, most: int) -> list[tuple[str, int]]:
    """(term, clean) of the clean terms that the kernel holds nearest to the toxic ones."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = gram(batch.column(0).to_pylist(), toxic).max(1)
            kept_rows = pa.array(np.flatnonzero(near >= least))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept_rows), batch.column(1).take(kept_rows),
                 pa.array(near).take(kept_rows)], ["term", "clean", "near"]
            )

    clean = counts.where("clean > 0").select("term", "clean")
    near = clean.mapInArrow(nearest, "term string, clean long, near double")
    order = [F.desc(F.col("near") * F.log1p("clean")), F.col("term")]
    return [(r["term"], r["clean"]) for r in near.orderBy(*order).limit(most).collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 4000,
    landmarks: int = 300,
    negatives: int = 20_000,
) -> Model:
    """Fit on at most ``per_class`` documents of each label.

    The driver receives at most ``landmarks`` toxic terms, twice ``negatives`` clean ones and
    five numbers per sampled document. Sampled rows are weighted to the labels' shares of all
    labelled rows, so a score does not move with the size of the table. Terms weigh as many documents as they stand in; a toxic
    term that clean documents also have counts on both sides. Without labels, or with none of
    a kind, every score is low.
    """
    known = kept(training_labels(labels))
    rows = kept(training_rows(docs, known, per_class))
    counts = kept(term_counts(rows))
    size = {int(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    low, high = row_weights(known, size, per_class)
    share = high * size.get(1, 0) / max(1, sum(size.values()))
    blank = np.zeros(ALPHABET**3, np.float32)
    toxic = insult_terms(counts, share, landmarks, (low, high))
    if not toxic:
        return Model(blank, -1.0, np.r_[np.zeros(EVIDENCE), -4.0])
    names = [t for t, _, _ in toxic]
    known = set(names)
    hard = [(t, n) for t, n in near_terms(counts, names, 0.3, negatives) if t not in known]
    fewer = high * F.col("toxic") <= low * F.col("clean")
    plain = counts.where("clean > 0").where(fewer).orderBy(F.xxhash64("term"), "term")
    plain = [(r["term"], r["clean"]) for r in plain.limit(negatives).collect()]
    clean = {t: n for t, n in [*hard, *plain] if t not in known}
    centres = names + [t for t, _ in hard[:200]]
    mapping = nystroem(centres)
    shared = [(t, b) for t, _, b in toxic if b]
    terms = [*names, *clean, *[t for t, _ in shared]]
    x = gram(terms, centres) @ mapping
    balance = min(8.0, (1 - share) / share)
    cost = np.r_[
        [high * balance * a for _, a, _ in toxic],
        [low * n for n in clean.values()],
        [low * b for _, b in shared],
    ].astype(float)
    y = np.r_[np.ones(len(names)), -np.ones(len(clean) + len(shared))]
    weights = svm(x, y, cost)
    row, key, value = subsequences(encoded(centres))
    table = np.zeros(ALPHABET**3)
    np.add.at(table, key, value * (mapping @ weights[:-1])[row])
    model = Model(table.astype(np.float32), float(weights[-1]), np.zeros(EVIDENCE + 1))
    seen = scored(rows, model, ["toxic"]).select("toxic", "evidence").collect()
    evidence = np.array([r["evidence"] for r in seen])
    label = np.array([r["toxic"] for r in seen], float)
    model.weights = logistic(evidence, label, np.where(label > 0, high, low))
    return model


def logistic(x: np.ndarray, label: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights (the bias last) of a lightly ridged logistic regression, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (cost * (label - p)) - 0.2 * w
        step = np.linalg.solve(x.T @ (x * (cost * p * (1 - p))[:, None]) + 0.2 * np.eye(len(w)), slope)
        w = w + step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
    return w


def scored(docs: DataFrame, model: Model, keep: list[str], inside: bool = False) -> DataFrame:
    """The ``keep`` columns with the evidence and score of every whole text.

    The text is the column ``text``, or the field of that name of the one struct that is kept
    (``inside``), so that it is handed over once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(0).field("text") if inside else batch.column(len(keep))
            evidence = [e for part in _chunks(texts) for e in scorer.evidences(part)]
            scores = scorer.model.scores(np.array(evidence).reshape(-1, EVIDENCE))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(evidence, pa.list_(pa.float64())), pa.array(scores)],
                [*keep, "evidence", "score"],
            )

    columns = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*columns).schema.add("evidence", ArrayType(DoubleType())).add(
        "score", DoubleType()
    )
    given = columns if inside else [*columns, F.col("text").alias("text")]
    return docs.select(*given).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Scores lie in [0, 1]. Null and empty texts score as texts without any toxic term. Equal
    texts have equal scores; rows stay as they are, repeated or with a null doc_id (held_out
    is then null). Labels with null ids or values are ignored, further columns not read.
    """
    model = fit(docs, labels, per_class)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return scored(slim, model, ["doc_id"]).select(
        "doc_id",
        F.expr("crc32(encode(string(doc_id), 'UTF-8')) % 4 = 2").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, all columns as they came."""
    model = fit(docs, labels, per_class)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return scored(rows, model, ["row"], inside=True).where(F.col("score") < THRESHOLD).select("row.*")
