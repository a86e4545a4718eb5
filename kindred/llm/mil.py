"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 512 bytes. Every passage of the whole text is encoded by counts of
byte classes and of their pairs and by its words' lengths and repeats, then by a trained layer. Gated
attention, a = softmax(w . (tanh(V h) * sigmoid(U h))), learned from document labels only, weighs the
passages; the weighted sum of their encodings is scored by a logistic unit.

Training is on the driver, on at most ``most_labelled`` labelled documents of at most ``most_bytes`` of
whole text in all, taken in the order of a hash of the id (one that would go beyond the bytes is passed
over), from those outside the held-out fold (crc32 of the id as text, mod 5, not 0). Scoring reads every
row in Arrow batches.

Defined cases: a null or empty text is one passage of zeros and gets a score; without labels to learn
from every score is 0.5; a null id is never held out; of repeated labels of an id the mean counts,
from one half up as 1; of texts that repeat an id the first by hash is learned from, and each is scored;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import M1, Shelf, column_bytes, slices

PASSAGE = 512
BLOCK = PASSAGE * 2048
CLASSES = 16


def _classes() -> np.ndarray:
    """Class of each byte: white space, line feed, letters by case and kind, digits, signs, UTF-8 parts."""
    table = np.full(256, 11, np.int64)
    groups = (" \t\r\x0b\x0c", "\n", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", ".,;:", "!?", "#*$%&", "|<>", "", "'\"()[]{}-_/\\@=+~^`")
    for i, group in enumerate(groups):
        for c in group:
            table[ord(c)] = i
    table[128:192], table[192:224], table[224:] = 13, 14, 15
    return table


TABLE = _classes()
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
RANDOM = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64)
POWERS = np.cumprod(np.full(256, M1 | np.uint64(1), np.uint64), dtype=np.uint64)
WIDTH = CLASSES + CLASSES * CLASSES + 5


def _block(b: np.ndarray) -> np.ndarray:
    """Features of the passages of one block of bytes."""
    n = -(-len(b) // PASSAGE)
    pid = np.arange(len(b)) // PASSAGE
    cls = TABLE[b]
    size = np.bincount(pid, minlength=n).astype(np.float32)[:, None]
    ones = np.bincount(pid * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES) / size
    pairs = np.bincount(pid[1:] * 256 + cls[:-1] * 16 + cls[1:], minlength=n * 256).reshape(n, 256) / size
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :CLASSES] = np.sqrt(ones)
    out[:, CLASSES : CLASSES + 256] = np.sqrt(pairs)
    blank = IS_SPACE[b]
    first = ~blank & np.concatenate(([True], blank[:-1]))
    at = np.flatnonzero(first)
    if len(at):
        place = np.arange(len(b))
        start = np.maximum.accumulate(np.where(first, place, 0))
        value = np.where(blank, np.uint64(0), RANDOM[b] * POWERS[np.minimum(place - start, 255)])
        word = np.add.reduceat(value, at)
        wid = at // PASSAGE
        length = np.add.reduceat((~blank).astype(np.int64), at)
        count = np.maximum(np.bincount(wid, minlength=n), 1)
        before = np.concatenate(([np.uint64(0)], word[:-1]))
        before2 = np.concatenate(([np.uint64(0)] * min(2, len(word)), word[:-2]))[: len(word)]
        out[:, -5] = np.bincount(wid, length, n) / count / 10
        out[:, -4] = np.bincount(wid, word == before, n) / count
        out[:, -3] = np.bincount(wid, word == before2, n) / count
        out[:, -2] = np.bincount(wid, length >= 16, n) / count
        out[:, -1] = np.log1p(np.bincount(wid, minlength=n)) / 5
    return out


def passages(text: bytes) -> np.ndarray:
    if not text:
        return np.zeros((1, WIDTH), np.float32)
    b = np.frombuffer(text, np.uint8)
    return np.concatenate([_block(b[i : i + BLOCK]) for i in range(0, len(b), BLOCK)])


def bag(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all texts, and the number of the first passage of each."""
    parts = [passages(t) for t in texts]
    return np.concatenate(parts), np.cumsum([0, *(len(p) for p in parts[:-1])])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    def __init__(self, width: int = WIDTH, encode: int = 24, gate: int = 12, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {"E": draw(width, encode), "e": np.zeros(encode, np.float32), "V": draw(encode, gate), "U": draw(encode, gate), "w": draw(gate, 1)[:, 0], "c": draw(encode, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.trained = False

    def _forward(self, x: np.ndarray, starts: np.ndarray):
        w = self.w
        lengths = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ w["E"] + w["e"])
        a, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        s = (a * g) @ w["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), lengths))
        s = s / np.repeat(np.add.reduceat(s, starts), lengths)
        z = np.add.reduceat(s[:, None] * h, starts)
        return lengths, h, a, g, s, z, _sigmoid(z @ w["c"] + w["b"])

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags' labels, by weight."""
        w = self.w
        lengths, h, a, g, s, z, p = self._forward(x, starts)
        d = (p - y) / len(y)
        dz = np.repeat(d[:, None] * w["c"], lengths, axis=0)
        ds = s * ((h * dz).sum(axis=1))
        ds = ds - s * np.repeat(np.add.reduceat(ds, starts), lengths)
        dag = ds[:, None] * w["w"]
        da, dg = dag * g * (1 - a * a), dag * a * g * (1 - g)
        dh = (s[:, None] * dz + da @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ ds, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.01, decay: float = 1e-4) -> Attention:
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.02)
        x = (x - self.mean) * self.scale
        w, y = self.w, y.astype(np.float32)
        m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
        for t in range(1, rounds + 1):
            grads = self.gradients(x, starts, y)
            for k, grad in grads.items():
                grad = grad + decay * w[k] * (k != "b")
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.trained = True
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), 0.5)
        out, at = [], 0
        while at < len(texts):  # about 2 MB of text at once
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= 2 << 20:
                size += len(texts[to])
                to += 1
            x, starts = bag(texts[at:to])
            out.append(self._forward((x - self.mean) * self.scale, starts)[-1])
            at = to
        return np.concatenate(out).astype(float) if out else np.zeros(0)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_labelled: int = 3000, most_bytes: int = 32 << 20) -> Attention:
    """A model of at most ``most_labelled`` documents and ``most_bytes`` of their text, of the fold to learn from."""
    shelf = Shelf(docs.sparkSession, "labelled")
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    sample = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = shelf.put(found, "texts")
    chosen, left = [], most_bytes
    for doc_id, size in texts.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if size <= left:
            chosen.append(doc_id)
            left -= size

    def run(batches):
        for batch in slices(batches, 64):
            raw = [passages(t) for t in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.astype(np.float16).tobytes() for r in raw], pa.binary())], ["doc_id", "y", "x"])

    rows = texts.where(F.col("doc_id").isin(chosen)).select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x binary").toLocalIterator()
    bags = sorted(((doc_id, y, np.frombuffer(x, np.float16).reshape(-1, WIDTH)) for doc_id, y, x in rows), key=lambda b: b[0])
    shelf.drop_all()
    model = Attention()
    if bags:
        x = np.concatenate([own for *_, own in bags]).astype(np.float32)
        model.fit(x, np.cumsum([0, *(len(own) for *_, own in bags[:-1])]), np.array([y for _, y, _ in bags]))
    return model


def score(docs: DataFrame, model: Attention, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            found = np.round(shared.value.score(column_bytes(batch, "text")), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= cut).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
