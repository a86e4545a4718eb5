"""Cross-entropy difference: two matched bigram models over one vocabulary score each document.

The vocabulary is every word of all documents, so it is closed and both models give every text a
probability. (With ``most`` it is the so many most frequent words, and every other word is one of a few
word-shape classes.) The background model counts the bigrams of all documents, the target model those
of the target documents. Both smooth a bigram with the unigrams of their own counts, and those with an
even share, by the same constants. A document's score is its mean loss per token under the target model
less that under the background model: the lower, the more like the target. Neither model scores a document
that it has counted: the document's own counts are first taken from those of each model it is in.

No table of words or bigrams is collected or broadcast. Documents are put together in batches of about
``BATCH`` bytes of text. A batch asks once for each bigram and word it has, with its own counts, and the
questions are dealt by hash to buckets; a bucket sums the counts of all batches and answers each batch
with the sums, and a batch adds up the losses of its documents. A frequent bigram is
one question a batch, so buckets are even. Words and bigrams are told apart by 64-bit hashes.

Defined cases: a null or empty text has no tokens, a score of 0 and losses of 0; without target
documents the target model is the even one; a null id is in the background and is scored; rows that
repeat an id count and are scored each; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import STEP, Shelf, WordHashes, column_bytes, mix, slices

SHAPES = 48
MU, ALPHA = 50.0, 0.5
FLUSH = 400_000
BATCH, BUCKET = 4_000_000, 1_500_000
# The low bit of a key tells bigrams and words apart; words hold no spaces, so START is none of them.
PAIR, WORD = np.uint64(0), np.uint64(1)
START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))
COUNTS = ("target", "all", "target_ends", "all_ends")



def shape(word: bytes) -> int:
    """One of SHAPES classes: by length, and by the kinds of bytes."""
    length = min(len(word) // 4, 3)
    kind = 0
    if not word.isalpha():
        if word.isdigit():
            kind = 1
        elif any(c > 127 for c in word):
            kind = 2 if all(c > 127 or 65 <= c <= 90 or 97 <= c <= 122 for c in word) else 3
        elif word[:-1].isalpha() and word[-1:] in b".,;:!?":
            kind = 4
        elif word.isalnum():
            kind = 5
        else:
            kind = 6
    elif word.isupper():
        kind = 7
    elif word[:1].isupper():
        kind = 8
    return kind * 4 + length


class Vocabulary(WordHashes):
    """Hash of each word; with a closed list of words, those outside get the hash of their shape."""

    def __init__(self, words: list[bytes] | None):
        super().__init__(250_000)
        self.words = None if words is None else frozenset(words)

    def __missing__(self, word: bytes) -> int:
        if self.words is None or word in self.words:
            return super().__missing__(word)
        return xxhash.xxh3_64_intdigest(b" shape %d" % shape(word))


def word_counts(docs: DataFrame, most: int) -> list[bytes]:
    def run(batches):
        counts: Counter = Counter()

        def flushed():
            words, n = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for text in column_bytes(batch, "text"):
                counts.update(text.split())
                if len(counts) > FLUSH:
                    yield flushed()
        yield flushed()

    counted = docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r[0]) for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def packed(x: np.ndarray, size: int = 0) -> bytes:
    """The bytes of whole numbers, highest bytes of all first (these compress well), as wide as the largest needs."""
    size = size or (int(x.max(initial=1)).bit_length() + 7) // 8
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].T.tobytes()


def width(words: np.ndarray) -> int:
    return (len(words).bit_length() + 7) // 8


def unpacked(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        width = len(x) // n
        out[:, 8 - width :] = np.frombuffer(x, np.uint8).reshape(width, n).T
    return out.view(">u8").reshape(-1).astype(np.uint64)


def encode(docs: DataFrame, words: list[bytes] | None) -> DataFrame:
    """A row for each batch of documents: ids, numbers of tokens, target flags, word hashes, and the place of each token among these."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("target", pa.list_(pa.bool_())), *((n, pa.int64()) for n in ("n_all", "n_target", "docs_all", "docs_target", "n_keys")), ("words", pa.binary()), ("tokens", pa.binary())])

    def run(batches):
        vocabulary, at = Vocabulary(shared.value), TaskContext.get().partitionId() << 32
        ids, hashes, target, held = [], [], [], 0

        def closed():
            lengths = np.array([len(h) for h in hashes])
            own, tokens, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words have small numbers, which compress
            own, tokens = own[order], np.argsort(order)[tokens]
            small = pa.compress(packed(tokens, width(own)), "zstd", asbytes=True)
            some, good = lengths > 0, np.array(target)
            keys = len(np.unique(bigrams(own, tokens, lengths))) + len(own)
            row = [at, ids, lengths, target, lengths.sum(), lengths[good].sum(), some.sum(), (some & good).sum(), keys, own.tobytes(), small]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in slices(batches):
            for i, text, good in zip(batch.column(0).to_pylist(), column_bytes(batch, "text"), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                hashes.append(vocabulary.of(text.split()))
                target.append(good)
                held += len(text) + 100
                if held >= BATCH:
                    yield closed()
                    ids, hashes, target, held, at = [], [], [], 0, at + 1
        if ids:
            yield closed()

    return docs.mapInArrow(run, "batch long, ids array<long>, lengths array<int>, target array<boolean>, n_all long, n_target long, docs_all long, docs_target long, n_keys long, words binary, tokens binary")


def bigrams(own: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The key of the bigram that ends at each token."""
    after = own[tokens]
    before = np.roll(after, 1)
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
    return mix(before * STEP + after) & ~WORD | PAIR


class Opened:
    """Of a batch: keys of its bigrams, then of its words; by token, the place of its bigram among the former and of its word among the latter."""

    def __init__(self, row: dict):
        own = np.frombuffer(row["words"], np.uint64)
        self.lengths, self.target = np.array(row["lengths"], np.int64), np.array(row["target"], bool)
        n = int(self.lengths.sum())
        self.tokens = unpacked(pa.decompress(row["tokens"], n * width(own), "zstd", asbytes=True), n).astype(np.int64)
        pairs, self.pairs = np.unique(bigrams(own, self.tokens, self.lengths), return_inverse=True)
        self.n_pairs, self.keys = len(pairs), np.concatenate((pairs, mix(own + STEP) | WORD))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def counts(self) -> list[np.ndarray]:
        """By key, COUNTS of the batch: how often the bigram or word occurs, and the word ends a document."""
        out, n_words, some = [], len(self.keys) - self.n_pairs, self.lengths > 0
        good = np.repeat(self.target, self.lengths)
        for which in (good, slice(None)):
            out.append(np.concatenate((np.bincount(self.pairs[which], minlength=self.n_pairs), np.bincount(self.tokens[which], minlength=n_words))))
        for which in (some & self.target, some):
            out.append(np.concatenate((np.zeros(self.n_pairs, np.int64), np.bincount(self.tokens[self.ends[which] - 1], minlength=n_words))))
        return out

    def own(self) -> list[np.ndarray]:
        """By token, how often its own document has its bigram, its word, and the word before it with another behind (or a beginning)."""
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        out = []
        for x in (self.pairs, self.tokens):
            _, place, n = np.unique(doc * (int(x.max(initial=0)) + 1) + x, return_inverse=True, return_counts=True)
            out.append(n[place])
        some = self.lengths > 0
        last = np.repeat(self.tokens[self.ends[some] - 1], self.lengths[some])
        before = np.roll(out[1] - (self.tokens == last), 1)
        before[self.starts[some]] = 1
        return [*out, before]

    def dealt(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, places of its keys in their order)."""
        bucket = ((self.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(self.keys)
        return [(int(bucket[p[0]]), p) for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(p)]


def answers(encoded: DataFrame, buckets: int) -> DataFrame:
    """(batch, bucket, COUNTS of all batches for the batch's keys of the bucket); with a null batch, the number of words in place of the bucket."""
    counted = ", ".join(f"{c} binary" for c in COUNTS)

    def ask(batches):
        for batch in slices(batches, 1):
            batch = Opened(batch.to_pylist()[0]), batch.column(0)[0].as_py()
            counts = batch[0].counts()
            # a bucket is a range of keys, so their steps are shorter than the keys
            rows = [(batch[1], b, len(p), packed(np.diff(batch[0].keys[p], prepend=np.uint64(0))), *(packed(c[p]) for c in counts)) for b, p in batch[0].dealt(buckets)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, *[pa.binary()] * 5), strict=True)], ["batch", "bucket", "n", "keys", *COUNTS])

    def answer(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(unpacked(k, n), dtype=np.uint64) for k, n in zip(table["keys"].to_pylist(), table["n"].to_pylist(), strict=True)]
        cuts = np.cumsum([len(k) for k in parts])[:-1]
        keys, places = np.unique(np.concatenate(parts), return_inverse=True)
        columns = {}
        for name in COUNTS:
            own = np.concatenate([unpacked(c, len(k)) for c, k in zip(table[name].to_pylist(), parts, strict=True)])
            total = np.zeros(len(keys), np.uint64)
            np.add.at(total, places, own)
            columns[name] = pa.array([*(packed(c) for c in np.split(total[places], cuts)), None], pa.binary())
        n_words = int((keys & WORD).sum())
        return pa.table({"batch": pa.array([*table["batch"].to_pylist(), None], pa.int64()), "bucket": pa.array([*table["bucket"].to_pylist(), n_words], pa.int64()), **columns})

    asked = encoded.select("batch", "lengths", "target", "words", "tokens").mapInArrow(ask, f"batch long, bucket long, n long, keys binary, {counted}")
    return asked.groupBy("bucket").applyInArrow(answer, f"batch long, bucket long, {counted}")


def losses(pair: np.ndarray, after: np.ndarray, before: np.ndarray, total: np.ndarray) -> np.ndarray:
    """-log p(next | previous) of a model with these counts of the bigram, the next and the previous word."""
    return -np.log((pair + MU * (after + ALPHA) / total) / (before + MU))


@contextmanager
def freed_shuffles(spark):
    """Spark deletes the shuffle files of what is written to the shelf as soon as it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(docs: DataFrame, target_ids: DataFrame, most: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of each row; ``target_ids`` has the column doc_id."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "lm")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = None if most is None else word_counts(source.select("text"), most)
    ids = target_ids.select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct().select("key", F.lit(True).alias("known"), F.lit(True).alias("good"))
    # null ids match nothing and are dealt by their texts
    keyed = source.withColumn("key", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("known", F.col("doc_id").isNotNull())
    flagged = keyed.join(ids.hint("merge"), ["key", "known"], "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("target"))
    with freed_shuffles(spark):
        encoded = shelf.put(encode(flagged, words), "encoded")
    sums = encoded.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_target", "n_all", "docs_target", "docs_all", "n_keys"))).first()
    buckets = -(-sums[4] // BUCKET) or 1
    with freed_shuffles(spark):
        answered = shelf.put(answers(encoded, buckets), "answers")
    size = 1 + (SHAPES + len(words) if words is not None else answered.where("batch is null").agg(F.sum("bucket")).first()[0] or 0)
    totals, firsts = [n + ALPHA * size for n in sums[:2]], sums[2:4]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        batch = Opened(row)
        found = dict(zip(right["bucket"].to_pylist(), right.select(list(COUNTS)).to_pylist(), strict=True))
        counts = np.zeros((4, len(batch.keys)))
        for bucket, p in batch.dealt(buckets):
            for k, name in enumerate(COUNTS):
                counts[k, p] = unpacked(found[bucket][name], len(p))
        means, own = [], batch.own()
        for k in (0, 1):
            pair, word, end = counts[k, : batch.n_pairs], counts[k, batch.n_pairs :], counts[k + 2, batch.n_pairs :]
            before = np.roll((word - end)[batch.tokens], 1)
            before[batch.starts[batch.lengths > 0]] = firsts[k]
            inside = np.repeat(batch.target, batch.lengths) if k == 0 else 1
            less = [x * inside for x in (*own, np.repeat(batch.lengths, batch.lengths))]
            summed = np.concatenate(([0.0], np.cumsum(losses(pair[batch.pairs] - less[0], word[batch.tokens] - less[1], before - less[2], totals[k] - less[3]))))
            means.append((summed[batch.ends] - summed[batch.starts]) / np.maximum(batch.lengths, 1))
        columns = [np.round(x, 6) + 0.0 for x in (*means, means[0] - means[1])]
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": pa.array(batch.lengths, pa.int64()), **{c: pa.array(x, pa.float64()) for c, x in zip(("target_loss", "background_loss", "score"), columns, strict=True)}})

    asking = encoded.select("batch", "ids", "lengths", "target", "words", "tokens").groupBy("batch")
    return asking.cogroup(answered.where("batch is not null").groupBy("batch")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
