"""Operator 1: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Words (cut at ASCII white space, A-Z lower-cased) enter as a hashed word vector beside a character vector, the
mean of hashed byte n-gram vectors over the word and its edges. Two gated recurrent layers run over a window of
words from either side, attention pools their states, and a sigmoid gives the window's probability. Windows
of WINDOW words start every STRIDE words, so that they overlap; all windows of a text are scored and the text
has the largest of their probabilities.

Learned on the driver from at most MAX_TRAIN labelled rows per label (the least by a hash of their id), whole
texts, as multiple-instance learning: in each epoch the window that scores highest and one at random stand for a
text. A null or empty text is one window without words. Null labels are not used; with no labels the network
scores as initialised. Windows of fewer words are filled up with inputs of no word, so a score does not depend on what
is scored beside it. A very long text is scored in steps of STEP_WINDOWS windows. Repeated rows get equal scores; of rows
that share an id the least text is learnt from; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.bytescan import U64, Buffer
from veilspark.llm.common import forget, held_out, pieces, string_bytes
from veilspark.llm.quality import FOLDS, white

WORD_ROWS = 1 << 14
CHAR_ROWS = 1 << 13
WORD_DIM = 8
CHAR_DIM = 8
HIDDEN = 8
WINDOW = 24
STRIDE = 12  # half a window, so that any passage of half a window lies whole in one
CHAR_NGRAMS = (4, 5)
MAX_TRAIN = 700
EPOCHS = 16
STEP_WINDOWS = 4096
STEP_WORDS = 1 << 15
PIECE = 1 << 18  # bytes of texts that a task scores at once
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of some texts: which distinct word stands where, and each distinct word's inputs."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        flat = LOWER[flat]
        gap = white(flat)
        edge = np.zeros(len(flat) + 1, dtype=bool)
        edge[offsets] = True
        first = ~gap & (np.concatenate(([True], gap[:-1])) | edge[:-1]) if len(flat) else gap
        last = ~gap & (np.concatenate((gap[1:], [True])) | edge[1:]) if len(flat) else gap
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.cuts = np.searchsorted(starts, offsets)
        buf = Buffer(flat)
        hashes, one, self.index = np.unique(buf.hash(starts, ends), return_index=True, return_inverse=True)
        self.word_row = (hashes % U64(WORD_ROWS)).astype(np.int64)
        self.char_row, self.char_cut = _char_rows(flat, starts[one], ends[one])

    def some(self, ids: np.ndarray) -> "Words":
        """Only the distinct words ``ids``, for their inputs."""
        out = object.__new__(Words)
        many = np.diff(self.char_cut)[ids]
        out.char_cut = np.concatenate(([0], np.cumsum(many)))
        out.char_row = self.char_row[np.arange(out.char_cut[-1]) + np.repeat(self.char_cut[ids] - out.char_cut[:-1], many)]
        out.word_row = self.word_row[ids]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and text of every window, in order of texts."""
        n = np.diff(self.cuts)
        many = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), many)
        k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        start = self.cuts[text] + k * STRIDE
        return start, np.minimum(WINDOW, self.cuts[text + 1] - start), text


def _char_rows(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the byte n-grams of each word between two edge marks, all words laid end to end, and their cuts."""
    size = ends - starts + 2
    cut = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(len(size)), size)
    inside = np.arange(cut[-1]) - cut[word] - 1
    chars = np.full(cut[-1], 32, dtype=np.uint8)
    real = (inside >= 0) & (inside < size[word] - 2)
    chars[real] = flat[(starts[word] + inside)[real]]
    buf = Buffer(chars)
    at = np.arange(cut[-1])
    rows, owner = [], []
    for n in CHAR_NGRAMS:
        here = at[at + n <= cut[word + 1]]
        rows.append((buf.hash(here, here + n) % U64(CHAR_ROWS)).astype(np.int64))
        owner.append(word[here])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Parameters and passes. Gates of a direction lie side by side: update, reset, candidate."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        init = lambda *shape, by=0.3: rng.normal(0, by, shape).astype(np.float32)
        self.p = {"word": init(WORD_ROWS, WORD_DIM, by=0.1), "char": init(CHAR_ROWS, CHAR_DIM, by=0.1), "att": init(2 * HIDDEN), "out": init(2 * HIDDEN), "bias": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": init(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"u{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        """Input vectors of the distinct words."""
        out = np.empty((len(words.word_row), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"][words.word_row]
        for k in range(0, len(out), STEP_WORDS):  # in steps, since a word's n-grams take many times its input's room
            cut = words.char_cut[k : k + STEP_WORDS + 1]
            sums = np.zeros((cut[-1] - cut[0] + 1, CHAR_DIM))
            np.cumsum(self.p["char"][words.char_row[cut[0] : cut[-1]]], axis=0, dtype=np.float64, out=sums[1:])
            cut = cut - cut[0]
            out[k : k + len(cut) - 1, WORD_DIM:] = (sums[cut[1:]] - sums[cut[:-1]]) / np.maximum(1, np.diff(cut))[:, None]
        return out

    def _direction(self, d: str, gates: np.ndarray, keep: bool):
        """States over time for projected inputs ``gates`` (time, window, 3 HIDDEN)."""
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        u = self.p[f"u{d}"]
        uzr, uc = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
        states, kept = np.empty((*gates.shape[:2], HIDDEN), np.float32), []
        for t in range(len(gates)) if d == "f" else reversed(range(len(gates))):
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + h @ uzr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gates[t, :, 2 * HIDDEN :] + (r * h) @ uc)
            if keep:
                kept.append((t, h, z, r, c))
            h = h + z * (c - h)
            states[t] = h
        return states, kept

    def forward(self, inputs: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows whose words are ``at`` (time, window) where ``mask`` holds."""
        runs = {d: self._direction(d, self._projected(d, inputs)[at], keep) for d in "fb"}
        states = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
        e = np.where(mask, states @ self.p["att"], np.float32(-1e4))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        logits = pooled @ self.p["out"] + self.p["bias"]
        return (logits, (states, a, pooled, runs)) if keep else logits

    def _projected(self, d: str, inputs: np.ndarray) -> np.ndarray:
        """Gate inputs of each distinct word, and those of no word in the last row."""
        none = np.zeros((1, inputs.shape[1]), np.float32)
        return np.concatenate((inputs, none)) @ self.p[f"w{d}"] + self.p[f"c{d}"]

    def gradients(self, words: Words, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean log loss; of the tables, the touched rows and their gradients."""
        none = len(words.word_row)
        used, at = np.unique(at, return_inverse=True)
        at = at.reshape(mask.shape)
        if len(used) and used[-1] == none:
            used = used[:-1]
        words = words.some(used)
        inputs = self.inputs(words)
        logits, (states, a, pooled, runs) = self.forward(inputs, at, mask, keep=True)
        dlogit = ((_sigmoid(logits) - y) / len(y)).astype(np.float32)
        dpooled = dlogit[:, None] * self.p["out"]
        da = np.einsum("tbh,bh->tb", states, dpooled)
        de = a * (da - (a * da).sum(axis=0))
        g = {"bias": dlogit.sum(keepdims=True), "out": dlogit @ pooled, "att": np.einsum("tb,tbh->h", de, states)}
        dstates = a[:, :, None] * dpooled + de[:, :, None] * self.p["att"]
        padded = np.concatenate((inputs, np.zeros((1, inputs.shape[1]), np.float32)))
        order = np.argsort(at, axis=None, kind="stable")
        ids, firsts = np.unique(at.ravel()[order], return_index=True)
        dpadded = np.zeros_like(padded)
        for k, d in enumerate("fb"):
            u, dh = self.p[f"u{d}"], np.zeros((len(y), HIDDEN), np.float32)
            gu, gates = np.zeros_like(u), np.empty((*mask.shape, 3 * HIDDEN), np.float32)
            for t, h, z, r, c in reversed(runs[d][1]):
                dh = dh + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                here = gates[t] = np.concatenate((dz, dr, dc), axis=1)
                gu[:, : 2 * HIDDEN] += h.T @ here[:, : 2 * HIDDEN]
                gu[:, 2 * HIDDEN :] += (r * h).T @ dc
                dh = dh * (1 - z) + drh * r + here[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
            by_word = np.add.reduceat(gates.reshape(-1, 3 * HIDDEN)[order], firsts, axis=0)
            g |= {f"w{d}": padded[ids].T @ by_word, f"u{d}": gu, f"c{d}": by_word.sum(axis=0)}
            dpadded[ids] += by_word @ self.p[f"w{d}"].T
        dinputs = dpadded[:-1]
        g["word"] = _by_row(words.word_row, dinputs[:, :WORD_DIM])
        many = np.diff(words.char_cut)
        g["char"] = _by_row(words.char_row, np.repeat(dinputs[:, WORD_DIM:] / np.maximum(1, many)[:, None], many, axis=0))
        return g


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    ids, firsts = np.unique(rows[order], return_index=True)
    return ids, np.add.reduceat(values[order], firsts, axis=0) if len(ids) else values[:0]


def _layout(words: Words, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct-word indexes (time, window) and where there is a word; no word points at the last row."""
    steps = np.arange(WINDOW)[:, None]  # all windows alike, so that a score does not depend on what is scored beside it
    mask = steps < size
    none = len(words.word_row)
    if not len(words.index):
        return np.full(mask.shape, none), mask
    return np.where(mask, words.index[np.minimum(start + steps, len(words.index) - 1)], none), mask


def score_windows(net: Network, words: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    inputs, out = net.inputs(words), np.empty(len(start), np.float32)
    for k in range(0, len(start), STEP_WINDOWS):
        part = slice(k, k + STEP_WINDOWS)
        out[part] = net.forward(inputs, *_layout(words, start[part], size[part]))
    return out


def score_texts(net: Network, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The largest window probability of each text."""
    words = Words(flat, offsets)
    start, size, text = words.windows()
    best = np.full(len(offsets) - 1, -np.inf)
    np.maximum.at(best, text, score_windows(net, words, start, size))
    return 1 / (1 + np.exp(-best.astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.02, seed: int = 11) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(texts):
        return net
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    words = Words(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    start, size, text = words.windows()
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        chance = bounds[:-1] + (rng.random(len(texts)) * np.diff(bounds)).astype(np.int64)
        if epoch:
            scores = score_windows(net, words, start, size)
            top = bounds[:-1] + np.array([int(np.argmax(scores[a:b])) for a, b in zip(bounds, bounds[1:])])
            # a window at random stands for a text without the label only: in a toxic text it may be clean
            chosen = np.concatenate((top, chance[labels == 0]))
        else:
            chosen = np.concatenate((chance, bounds[:-1]))
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // batch)):
            at, mask = _layout(words, start[part], size[part])
            grads = net.gradients(words, at, mask, labels[text[part]].astype(np.float32))
            step += 1
            for k, g in grads.items():
                rows, g = g if isinstance(g, tuple) else (slice(None), g)  # of a table only touched rows move
                one = first[k][rows] = first[k][rows] + np.float32(0.1) * (g - first[k][rows])
                two = second[k][rows] = second[k][rows] + np.float32(0.01) * (g * g - second[k][rows])
                move = one / (1 - 0.9**step) / (np.sqrt(two / (1 - 0.99**step)) + 1e-6)
                net.p[k][rows] -= (rate * move).astype(np.float32)
    return net


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_TRAIN, id_column: str = "doc_id") -> Network:
    kept = labels.where(F.col(label).isNotNull() & ~held_out(id_column, FOLDS)).groupBy(id_column).agg(F.min(F.col(label).cast("int")).alias("_veil_label"))
    each = [kept.where(cond).orderBy(F.xxhash64(id_column), id_column).limit(limit) for cond in (F.col("_veil_label") > 0, F.col("_veil_label") <= 0)]
    chosen = F.broadcast(each[0].unionByName(each[1]))
    data = docs.select(id_column, "text").join(chosen, id_column).groupBy(id_column).agg(F.min("text").alias("text"), F.min("_veil_label").alias("_veil_label")).select("text", "_veil_label").toArrow()
    rows = sorted((r["_veil_label"] > 0, (r["text"] or "").encode()) for r in data.to_pylist())
    return train([t for _, t in rows], np.array([y for y, _ in rows], dtype=np.int64))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, limit=limit).p)

    def run(batches):
        forget()
        net = Network()
        net.p = shared.value
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                yield piece.filter(pa.array(score_texts(net, *string_bytes(piece.column("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", threshold: float = 0.5, limit: int = MAX_TRAIN) -> DataFrame:
    """Per row: id, held_out, score, predicted. Row-local; the fitted network is sent once to each executor."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, limit=limit, id_column=id_column).p)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        forget()
        net = Network()
        net.p = shared.value
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(score_texts(net, *string_bytes(piece.column(1))))], names=[id_column, "score"])

    scored = docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {id_type}, score double")
    return scored.select(id_column, held_out(id_column, FOLDS).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
