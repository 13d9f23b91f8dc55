"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task reads its own documents once and keeps a level array: ``open_at[h]`` counts the
windows that are filled to level ``h``. A document of ``s`` tokens goes to the level whose
move ``h -> h + s`` adds least to the sum of squared counts of partially filled windows, a
new window being level 0. Documents longer than a window fill whole windows first and only
their rest is placed. When a task ends (or keeps ``max_open`` windows) the open windows are
topped up by cutting the emptiest ones; what is left at the end of the task, less than one
window, is cut into lengths that are powers of two, which need no padding.

No shuffle: a task packs the rows that it scans, so a lost executor repeats only its own
splits and gives the same windows again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)


class ChunkTokenizer:
    """Token ids of texts, with each distinct run between ASCII white space encoded once.

    The tokenizer drops white space and never joins over it, so the ids of a text are the ids
    of its runs in order. A run that ends in a single comma or full stop after a letter is the
    run before it and the mark, as letters and marks are separate pre-tokens. A letter whose
    lower case ends in a combining sign (U+0130) is none here, as the sign joins the mark. The
    memory of runs is bounded: at ``limit`` it starts anew.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        found = {m: self._encode([m])[0] for m in ",."}
        self.marks = {m: i + 1 for i, m in enumerate(found) if len(found[m]) == 1}
        self.mark_bytes = {ord(m): i for m, i in self.marks.items()}
        self.mark_ids = np.array([0, *[ids[0] for ids in found.values()]], np.uint32)
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.n = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _keep(self, runs: list[bytes], ids: list[int], sizes: np.ndarray) -> None:
        """Append the ids of new runs, all in one array, to ``flat`` and ``ends``."""
        low, n = int(self.ends[self.n]), len(runs)
        while low + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.n + n + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[low : low + len(ids)] = ids
        self.ends[self.n + 1 : self.n + n + 1] = low + np.cumsum(sizes)
        self.seen.update(zip(runs, range(4 * self.n, 4 * (self.n + n), 4), strict=True))
        self.n += n

    def _keep_each(self, runs: list[bytes]) -> None:
        found = self._encode([r.decode() for r in runs])
        self._keep(runs, [i for x in found for i in x], np.array([*map(len, found)], np.int64))

    def _keep_words(self, words: list[bytes]) -> None:
        """Runs of letters are one pre-token each, so many go through one call."""
        for i in range(0, len(words), 256):
            part = words[i : i + 256]
            found = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
            at = found.word_ids
            if None in at or not at or at[-1] + 1 != len(part):
                self._keep_each(part)
            else:
                self._keep(part, found.ids, np.bincount(at, minlength=len(part)))

    def _parted(self, raw: bytes) -> tuple[bytes, int, bool]:
        """(core, mark, whether the core is letters alone) of a run.

        Cores of letters are lower-cased; others may hold a special token and stay as they are.
        """
        if raw.isalpha():
            return raw.lower(), 0, True
        mark = self.mark_bytes.get(raw[-1], 0)
        if mark and raw[:-1].isalpha():
            return raw[:-1].lower(), mark, True
        core, text = raw, raw.decode()
        if mark and len(text) > 1 and text[-2].lower().isalpha():
            core, text = raw[:-1], text[:-1]
        else:
            mark = 0
        letters = text.isalpha() and text.lower().isalpha()
        return core.lower() if letters else core, mark, letters

    def _learn(self, runs: list[bytes]) -> None:
        """A run is known by the number of its core times 4, plus its mark."""
        seen, words, others = self.seen, {}, {}
        parted = [self._parted(raw) for raw in runs]
        for core, _, letters in parted:
            if core not in seen:
                (words if letters else others)[core] = None
        self._keep_words([*words])
        if others:
            self._keep_each([*others])
        seen.update((raw, seen[core] + mark) for raw, (core, mark, _) in zip(runs, parted, strict=True))

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one text as unsigned 32-bit integers; a null text has none."""
        runs = (text or "").encode().split()
        if not runs:
            return np.empty(0, np.uint32)
        if len(self.seen) > self.limit:
            self.clear()
        get = self.seen.get
        found = [get(r, -1) for r in runs]
        if -1 in found:
            self._learn(list(dict.fromkeys([r for r, i in zip(runs, found) if i < 0])))
            found = [i if i >= 0 else self.seen[r] for r, i in zip(runs, found)]
        codes = np.array(found)
        at, mark = codes >> 2, codes & 3
        low = self.ends[at]
        size = self.ends[at + 1] - low
        total = np.cumsum(size + (mark > 0))
        index = np.repeat(low + size - total, size + (mark > 0)) + np.arange(total[-1])
        # a mark follows its core: the slot after the core's ids is read from the marks
        marked = mark > 0
        index = index + np.repeat(marked.astype(np.int64), size + marked)
        last = total[marked] - 1
        index[last] = 0
        out = self.flat[index]
        out[last] = self.mark_ids[mark[marked]]
        return out


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The tokenizer of this worker process; its memory of runs serves all its tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


class Piece:
    """Tokens ``start .. start + len(ids)`` of a document."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, self.ids[:n], self.total)
        return head, Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Packer:
    """The level array of one task. Closed windows are lists of pieces in ``closed``."""

    def __init__(self, window: int, max_open: int):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.closed: list[list[Piece]] = []

    def add(self, doc, ids: np.ndarray) -> None:
        w, n = self.window, len(ids)
        whole = n - n % w
        for i in range(0, whole, w):
            self.closed.append([Piece(doc, i, ids[i : i + w], n)])
        if whole < n:
            self._place(Piece(doc, whole, ids[whole:], n))

    def _place(self, piece: Piece) -> None:
        w, s, count = self.window, len(piece.ids), self.count
        levels = np.flatnonzero(count[: w - s + 1])  # level 0 and full windows count nothing
        level = 0
        if len(levels):
            change = count[levels + s] - count[levels]
            best = len(levels) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest
            if change[best] <= count[s]:
                level = int(levels[best])
        if level:
            window = self.at[level].pop()
            count[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + s == w:
            self.closed.append(window)
            return
        self.at[level + s].append(window)
        count[level + s] += 1
        self.n_open += 1
        if self.n_open >= self.max_open:
            self.top_up()

    def top_up(self) -> None:
        """Fill the fullest open windows with pieces cut from the emptiest."""
        rows = [[h, x] for h in range(self.window, 0, -1) for x in self.at[h]]
        i, j = 0, len(rows) - 1
        while i < j:
            room = self.window - rows[i][0]
            if room == 0:
                self.closed.append(rows[i][1])
                i += 1
                continue
            piece = rows[j][1].pop()
            if len(piece.ids) > room:
                piece, rest = piece.cut(room)
                rows[j][1].append(rest)
            rows[i][1].append(piece)
            rows[i][0] += len(piece.ids)
            rows[j][0] -= len(piece.ids)
            if not rows[j][1]:
                j -= 1
        self.count[:] = 0
        self.at = [[] for _ in range(self.window + 1)]
        self.n_open = 0
        for h, x in rows[i : j + 1]:
            if h == self.window:
                self.closed.append(x)
            elif x:
                self.at[h].append(x)
                self.count[h] += 1
                self.n_open += 1

    def finish(self) -> None:
        """Close all windows; the last one is cut into lengths that are powers of two."""
        self.top_up()
        for left in [x for level in self.at for x in level]:
            total = sum(len(p.ids) for p in left)
            for bit in range(self.window.bit_length() - 1, -1, -1):
                size = 1 << bit
                if not total & size:
                    continue
                out = []
                while size:
                    piece = left.pop(0)
                    if len(piece.ids) > size:
                        piece, rest = piece.cut(size)
                        left.insert(0, rest)
                    out.append(piece)
                    size -= len(piece.ids)
                self.closed.append(out)

    def take(self) -> list[list[Piece]]:
        out, self.closed = self.closed, []
        return out


def _rows(windows: list[list[Piece]], first: int) -> pa.RecordBatch:
    pieces = [(first + i, p) for i, x in enumerate(windows) for p in x]
    size = np.array([len(p.ids) for _, p in pieces], np.int64)
    before = np.cumsum(size) - size
    window = np.array([i for i, _ in pieces], np.int64)
    starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    offset = before - np.repeat(before[starts], np.diff(np.r_[starts, len(window)]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p.doc for _, p in pieces], pa.int64()),
            pa.array([p.start for _, p in pieces], pa.int64()),
            pa.array(size),
            pa.array([p.ids.astype("<u4").tobytes() for _, p in pieces], pa.binary()),
            pa.array([p.total for _, p in pieces], pa.int64()),
            pa.array(window),
            pa.array(offset),
        ],
        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = 1,
    max_open: int = 4096,
    flush_tokens: int = 2_000_000,
) -> DataFrame:
    """Pieces of all documents, packed into windows of at most ``window`` tokens.

    Returns one row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset. A document is its token ids and ``end_id``, so an empty
    or null text is one token. Each id lies in exactly one piece and the pieces of a window
    lie without gaps from offset 0. Equal rows are separate documents, a null doc_id stays
    null, an empty table gives no rows and further columns are not read. ``sequence_id`` is
    the task's number times 2**40 and a running number.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer(tokenizer_path)
        end = np.array([end_id], np.uint32)
        packer = Packer(window, max_open)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        waiting = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc in enumerate(ids):
                tokens = np.concatenate((encode.ids(texts[i].as_py()), end))
                packer.add(doc, tokens)
                waiting += len(tokens)
                if waiting >= flush_tokens:
                    waiting = 0
                    if windows := packer.take():
                        yield _rows(windows, first)
                        first += len(windows)
        packer.finish()
        if windows := packer.take():
            yield _rows(windows, first)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return slim.mapInArrow(pack, SCHEMA)


def window_matrix(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """One row per window: padded ids, cumulative piece lengths and number of real tokens.

    Windows are padded to ``window`` tokens, except those whose fill is a power of two. A
    group holds the pieces of one window, so it is bounded by the window.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("tokens"))
    joined = F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))")
    full = F.expr(f"CASE WHEN tokens & (tokens - 1) = 0 THEN tokens ELSE {int(window)} END")
    one = int(pad_id).to_bytes(4, "little").hex()
    padding = F.unhex(F.repeat(F.lit(one), (full - F.col("tokens")).cast("int")))
    return rows.select(
        "sequence_id",
        "tokens",
        F.expr("transform(parts, p -> p.offset + p.length)").alias("ends"),
        F.concat(joined, padding).alias("ids"),
    )
