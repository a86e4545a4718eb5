"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by size: a partition has the items of one shingle length whose numbers of shingles
lie between two powers of two, u/2 and u. It keeps of each item the u - ceil(threshold * u) + 1 smallest hashes of its shingles
(a bottom-k MinHash sketch, k by partition), and is searched by itself: from a document it takes the
hashes up to the largest of its sketches, which is the document's sketch for that partition, and counts by
item how many it has in common. A document that holds the threshold's share of an item's shingles misses
at most e = n - ceil(threshold * n) of them, so it holds all but e of the sketch at least: fewer common
hashes rule an item out, and the search loses nothing at any document length. What is left is verified
on the shingles themselves.

Documents are read once for each block of the index; a block has at most about ``block`` bytes of item texts and sketches (one
block unless the benchmark is very large) and is shipped to the tasks: no shuffle. Words are lower-cased
and lose punctuation at their ends.

Defined cases: null or empty texts hold nothing and contain nothing; items with fewer words than a
shingle are one shingle of their whole sequence; equal items are each reported; repeated document rows
are each reported; a null id is returned as null; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import WordHashes, column_bytes, shingle_hashes, slices

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
BLOCK = 32 << 20
SCHEMA = "doc_id long, item_id long, n_shingles long, n_common long, containment double"


def clean(word: bytes) -> bytes:
    return EDGES.sub("", word.decode("utf-8", "replace")).lower().encode()


def words_of(text: bytes) -> list[bytes]:
    return [x for x in map(clean, text.split()) if x]


def shingles_of(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    k = min(k, len(words)) or 1
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def text_hashes(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    ids = hashes.of(text.split())
    return shingle_hashes(ids[ids != 0], k)


class Partition:
    """The sketches of items of one shingle length and size class."""

    def __init__(self, length: int, items: list[tuple[int, int, np.ndarray]], threshold: float):
        """``items`` has the number, the number of shingles and the sketch of each."""
        self.length = length
        hashes = np.concatenate([sketch for *_, sketch in items])
        owners = np.repeat(np.arange(len(items)), [len(sketch) for *_, sketch in items])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.bound = hashes[order], owners[order], hashes.max()
        self.items = np.array([i for i, *_ in items])
        self.least = np.array([max(1, len(sketch) - (n - needed(n, threshold))) for _, n, sketch in items])

    def candidates(self, own: np.ndarray) -> np.ndarray:
        """Numbers of the items that a text with these distinct sorted hashes may contain."""
        sketch = own[: np.searchsorted(own, self.bound, "right")]
        lo = np.searchsorted(self.hashes, sketch)
        hit = sketch[self.hashes[np.minimum(lo, len(self.hashes) - 1)] == sketch]
        if not len(hit):
            return self.items[:0]
        lo, hi = np.searchsorted(self.hashes, hit), np.searchsorted(self.hashes, hit, "right")
        common = np.bincount(np.concatenate([self.owners[a:b] for a, b in zip(lo, hi, strict=True)]), minlength=len(self.items))
        return self.items[common >= self.least]


def needed(n: int, threshold: float) -> int:
    """The least number of an item's n shingles that a text which contains it has."""
    return int(np.ceil(threshold * n - 1e-9))


class Index:
    """A block of items in partitions."""

    def __init__(self, items: list[tuple[int, bytes]], k: int, threshold: float):
        hashes = WordHashes(clean=clean)
        self.threshold, self.ids, self.texts, self.lengths = threshold, [], [], []
        classes: dict[tuple[int, int], list[tuple[int, int, np.ndarray]]] = {}
        for item_id, text in items:
            own = np.unique(text_hashes(text, k, hashes))
            if len(own):
                length = min(len(words_of(text)), k)
                u = sketched(len(own))
                classes.setdefault((length, u), []).append((len(self.ids), len(own), own[: u - needed(u, threshold) + 1]))
                self.ids.append(item_id)
                self.texts.append(text)
                self.lengths.append(length)
        self.partitions = [Partition(length, members, threshold) for (length, _), members in sorted(classes.items(), key=lambda x: x[0])]


def sketched(n: int) -> int:
    """The upper end of the size class of n shingles."""
    return 1 << (n - 1).bit_length()


class Reader:
    """Searches a block of the index."""

    def __init__(self, index: Index):
        self.index, self.hashes, self.sets = index, WordHashes(clean=clean), {}

    def found(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(number of the item, its shingles, those in the text) of each item that the text contains."""
        ids = self.hashes.of(text.split())
        ids = ids[ids != 0]
        own: dict[int, np.ndarray] = {}
        exact: dict[int, set] = {}
        for part in self.index.partitions:
            length = part.length
            if len(ids) < length:
                continue
            if length not in own:
                own[length] = np.unique(shingle_hashes(ids, length))
            for i in part.candidates(own[length]).tolist():
                if length not in exact:
                    exact[length] = shingles_of(text, length)
                if i not in self.sets:
                    self.sets[i] = shingles_of(self.index.texts[i], length)
                n, common = len(self.sets[i]), len(self.sets[i] & exact[length])
                if common >= needed(n, self.index.threshold):
                    yield i, n, common

    def contained(self, text: bytes) -> bool:
        return next(self.found(text), None) is not None


def indexes(items: DataFrame, k: int, threshold: float, block: int) -> Iterator[Index]:
    chunk, weight = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text")).orderBy("item_id", "text").toLocalIterator():
        text = (row[1] or "").encode()
        chunk.append((row[0], text))
        # a sketch has at most a hash and its owner for each word
        weight += len(text) + 16 * len(text.split()) + 64
        if weight >= block:
            yield Index(chunk, k, threshold)
            chunk, weight = [], 0
    if chunk:
        yield Index(chunk, k, threshold)


def search(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment) of each document and item it contains."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = spark.createDataFrame([], SCHEMA)
    for n, index in enumerate(indexes(items, k, threshold, block)):
        part = source.mapInArrow(_matches(spark.sparkContext.broadcast(index)), SCHEMA)
        found = found.unionByName(part) if n else part
    return found


def _matches(shared):
    def run(batches):
        reader = Reader(shared.value)
        for batch in slices(batches):
            rows = [(doc_id, reader.index.ids[i], n, common, common / n) for doc_id, text in zip(batch.column(0).to_pylist(), column_bytes(batch, "text"), strict=True) for i, n, common in reader.found(text)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "n_shingles", "n_common", "containment"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text contains no item, each judged by its own text; no join, no shuffle."""
    at = docs.columns.index(text_col)
    for index in indexes(items, k, threshold, block):
        docs = docs.mapInArrow(_clean_rows(docs.sparkSession.sparkContext.broadcast(index), at), docs.schema)
    return docs


def _clean_rows(shared, at: int):
    def run(batches):
        reader = Reader(shared.value)
        for batch in slices(batches):
            texts = column_bytes(batch.select([at]), batch.schema.names[at])
            yield batch.filter(pa.array([not reader.contained(t) for t in texts], pa.bool_()))

    return run
