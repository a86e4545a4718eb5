"""Near-duplicate search by min-max hashing.

Of every permutation both the least and the greatest hash are kept, so a signature of 2p values costs
p hash evaluations. Bands of r values are cut from the minima and from the maxima separately, so the
values of a band come from different permutations and each is unbiased for the Jaccard similarity.
``rows_per_band`` takes the largest r at which a pair right at the threshold shares no band with a
probability of at most 1e-5.

Candidates are confirmed on the full shingle sets (64-bit hashes of the shingles), in two rounds.
Documents with equal sets are one class. In each bucket of classes every member is
first compared with the smallest one, the pivot. Members in the pivot's component are then done with
it. A pivot's group are its members in other components, and those of its own that the triangle
inequality of the Jaccard distance leaves within reach of them. In the second round the groups are
compared within themselves, by blocks of bounded size: a task holds the sets of two blocks, counts all
their intersections at once (a product of membership matrices) and gives back a spanning forest of the
links it finds. So every candidate pair is judged or ruled out, a large group of near copies costs a
comparison a member, and the pairs of a group are never written out.

Defined cases: without words (or with a null text) a document's set is empty, and it is linked with
nothing. Rows are told apart by id and text, so rows of different texts under one id, or under none, are
each linked by their own text and returned each. A component's id is its smallest id that is not null,
null if it has none; kept are its rows of this id, or if it has none those of the first text by hash;
without words a row is its own component and kept. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import Shelf, WordHashes, column_bytes, mix, shingle_hashes, slices
from kindred.operators.graph import components

PERMUTATIONS = 126
MISS = 1e-5
MOST_BITS = 26
BLOCK, WIDE = 384, 4096


def rows_per_band(threshold: float, permutations: int = PERMUTATIONS, miss: float = MISS) -> int:
    fits = [r for r in range(1, permutations + 1) if (1 - threshold**r) ** (2 * (permutations // r)) <= miss]
    return max(fits, default=1)


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 2**63, count, dtype=np.uint64)[:, None]


def min_max(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = high = None
    for i in range(0, len(shingles), 2048):
        h = a * shingles[None, i : i + 2048] + b
        lo, hi = h.min(axis=1), h.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band, its number mixed in."""
    n = len(low) // rows
    both = np.concatenate([low[: n * rows].reshape(n, rows), high[: n * rows].reshape(n, rows)])
    key = np.arange(1, 2 * n + 1, dtype=np.uint64)
    for i in range(rows):
        key = mix(key + both[:, i])
    return key


def shingle_set(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(hashes.of(text.lower().split()), k))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _arrow(columns, types, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def sign(docs: DataFrame, k: int, rows: int) -> DataFrame:
    """(doc_id, h, n, d1, d2, bands): of each row (doc_id, h, text) size and digest of the shingle set and its band keys."""

    def run(batches):
        hashes = WordHashes()
        a, b = permutations(PERMUTATIONS)
        for batch in slices(batches):
            out = []
            for text in column_bytes(batch, "text"):
                own = shingle_set(text, k, hashes)
                keys = band_keys(*min_max(own, a, b), rows).astype(np.int64) if len(own) else np.zeros(0, np.int64)
                out.append((len(own), *digest(own), keys))
            n, d1, d2, keys = zip(*out, strict=True) if out else [()] * 4
            yield _arrow([batch.column(0), batch.column(1), n, d1, d2, list(keys)], [*[pa.int64()] * 5, pa.list_(pa.int64())], ["doc_id", "h", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(run, "doc_id long, h long, n long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, k: int, wanted: DataFrame, n: int) -> DataFrame:
    """(n, d1, d2, own) of the rows whose h is wanted (n rows), and of some others: h is first looked for in a
    hashed bitmap of at most 2**MOST_BITS bits, so that the texts are not shuffled."""
    bits = 1 << min(MOST_BITS, max(10, (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = wanted.select(place("h").alias("p")).select(F.shiftright("p", 5).alias("word"), F.expr("shiftleft(1L, CAST(p % 32 AS INT))").alias("bit"))
    bitmap = np.zeros(bits >> 5, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        bitmap[r.word] = r.bit
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.astype(np.uint32))

    def run(batches):
        hashes, known = WordHashes(), shared.value
        for batch in slices(batches):
            p = batch.column(1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((known[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1))
            own = [shingle_set(text, k, hashes) for text in column_bytes(batch, "text")]
            d = [digest(x) for x in own]
            yield _arrow([list(map(len, own)), [x[0] for x in d], [x[1] for x in d], [x.tobytes() for x in own]], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["n", "d1", "d2", "own"])

    return docs.select("text", place("h").alias("p")).mapInArrow(run, "n long, d1 long, d2 long, own binary")


def _compared(pairs: DataFrame) -> DataFrame:
    """Sizes of the intersection and the union of each pair's sets."""

    def run(batches):
        for batch in slices(batches):
            common, union = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                common.append(same)
                union.append(len(both) - same)
            yield _arrow([batch.column(0), batch.column(1), common, union], [pa.int64()] * 4, ["rep", "pivot", "common", "n_union"])

    return pairs.mapInArrow(run, "rep long, pivot long, common long, n_union long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """What tells rows apart: id, and a hash of id and text; and the text."""
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    return doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("h"), text.alias("text")


def judged_rows(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n, component_id, first) of each row: linked are documents of which
    100 * intersection >= percent * union holds for the sets of distinct k-word shingles; first are
    the rows equal to the first of their component in id and text."""
    shelf = Shelf(docs.sparkSession, "minhash")
    source = docs.select(*_rows(docs, id_col, text_col))
    rows = rows_per_band(percent / 100)
    signed = shelf.hold(sign(source, k, rows), "signed")
    # sizes of the tables that follow, in numbers
    bands, n_rows = 2 * (PERMUTATIONS // rows), signed.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "bands")).alias("x")
    found = signed.where("n > 0").groupBy("n", "d1", "d2").agg(first)
    # a class gets a number, which holds from here on since it is written
    classes = shelf.put(found.select("n", "d1", "d2", F.struct("x.none", "x.doc_id", "x.h").alias("first"), "x.bands", F.monotonically_increasing_id().alias("rep")), "classes", bands * n_rows)
    buckets = classes.select(F.explode("bands").alias("key"), "rep")
    several = buckets.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where(F.col("pivot") != F.col("last")).select("key", "pivot")
    members = shelf.hold(buckets.join(several, "key").where("rep != pivot").distinct(), "members")
    n_members = members.count()
    # sets are made once, of all classes that share a bucket
    ids = members.select("rep").union(members.select(F.col("pivot").alias("rep"))).distinct()
    wanted = shelf.hold(classes.select("rep", "n", "d1", "d2", F.col("first.h").alias("h")).join(ids, "rep", "left_semi"), "wanted")
    n_wanted, n_values = wanted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = _sets(source, k, wanted, n_wanted).join(wanted.select("rep", "n", "d1", "d2").hint("merge"), ["n", "d1", "d2"])
    sets = shelf.put(own.groupBy("rep").agg(F.any_value("own").alias("own")), "sets", n_values)
    pairs = members.select("rep", "pivot").distinct()
    compared = _compared(pairs.join(sets.hint("merge"), "rep").join(sets.select(F.col("rep").alias("pivot"), F.col("own").alias("other")).hint("merge"), "pivot").select("rep", "pivot", "own", "other"))
    judged = shelf.hold(compared, "judged")
    links = judged.where(100 * F.col("common") >= percent * F.col("n_union")).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    roots = components(links, shelf, "roots-0", values=2 * n_members)
    groups = shelf.hold(_groups(members, judged, roots, 1 - percent / 100 + 1e-9), "groups")
    if not groups.isEmpty():
        more = shelf.hold(_within_groups(groups, sets, percent), "links")
        if not more.isEmpty():
            roots = components(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), shelf, "roots-1", values=2 * n_members)
    shelf.drop("sets", "members", "wanted", "judged", "groups", "links")
    own = classes.select("n", "d1", "d2", "rep", "first").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).drop("rep", "node", "bands")
    heads = own.groupBy("root").agg(F.min("first").alias("head"))
    own = own.join(heads.hint("merge"), "root").select("n", "d1", "d2", "head")
    whole = signed.select("doc_id", "h", "n", "d1", "d2").join(own, ["n", "d1", "d2"], "left")
    empty = F.col("n") == 0
    return whole.select(
        "doc_id", "h", "n", F.when(empty, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (empty | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h")))).alias("first"),
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row, by ``judged_rows``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first"))
    return judged_rows(docs, k, percent, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def _groups(members: DataFrame, judged: DataFrame, roots: DataFrame, reach: float) -> DataFrame:
    """(pivot, rep) of the classes to compare within each pivot's group: see the module's text."""
    root = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    distance = judged.select("rep", "pivot", (1 - F.col("common") / F.col("n_union")).alias("d"))
    known = members.join(distance.hint("merge"), ["rep", "pivot"]).join(root("rep").hint("merge"), "rep", "left").join(root("pivot").hint("merge"), "pivot", "left")
    placed = known.withColumn("root", F.coalesce("rep_root", "rep")).withColumn("other", F.col("root") != F.coalesce("pivot_root", "pivot"))
    # buckets in which a link between two components is still possible, without the pivot
    ahead = placed.groupBy("key").agg(F.min(F.when(F.col("other"), F.col("d"))).alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    left = placed.join(ahead.select("key", "least").hint("merge"), "key").where(F.col("other") | (F.col("d") >= F.col("least") - reach))
    return left.select("pivot", "rep").distinct()


def _within_groups(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), a spanning forest for each pair of blocks of a group. Blocks are by hash and hold
    about BLOCK classes; a class goes to as many tasks as its group has blocks."""
    sizes = groups.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = groups.join(sizes.hint("merge"), "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("pivot", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "rep")
    rows = spread.join(sets.hint("merge"), "rep").select("pivot", "lo", "hi", "block", "rep", "own")

    def run(table: pa.Table) -> pa.Table:
        block, rep = table["block"].to_numpy(), table["rep"].to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in table["own"].to_pylist()]
        first = block == block.min()
        edges = forest(own, rep, first, ~first if (~first).any() else first, percent)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return rows.groupBy("pivot", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def forest(own: list[np.ndarray], ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the sets of ``rows`` and of ``columns`` (masks), as a spanning forest of their components."""
    left, right = np.flatnonzero(rows), np.flatnonzero(columns)
    size = np.array([len(x) for x in own])
    value = np.concatenate(own)
    who = np.repeat(np.arange(len(own)), size)
    _, place, count = np.unique(value, return_inverse=True, return_counts=True)
    kept = count[place] > 1
    place, who = place[kept], who[kept]
    _, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    place, who = place[order], who[order]
    common = np.zeros((len(left), len(right)), np.float32)
    at = np.full((2, len(own)), -1)
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    for i in range(0, int(place[-1]) + 1 if len(place) else 0, WIDE):
        lo, hi = np.searchsorted(place, (i, i + WIDE))
        m = [np.zeros((len(n), WIDE), np.float32) for n in (left, right)]
        for side in (0, 1):
            mine = at[side, who[lo:hi]]
            m[side][mine[mine >= 0], place[lo:hi][mine >= 0] - i] = 1
        common += m[0] @ m[1].T
    union = size[left][:, None] + size[right][None, :] - common
    hits = np.argwhere(100 * common.astype(np.float64) >= percent * union)
    parent = list(range(len(own)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i, j in hits.tolist():
        x, y = int(left[i]), int(right[j])
        p, q = find(x), find(y)
        if p != q and ids[x] != ids[y]:
            parent[p] = q
            edges.append((int(ids[x]), int(ids[y])))
    return edges


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group, the first by id (null last), then by a hash of id and text; of rows
    equal in both, the least by their columns. Rows without words all stay."""
    shelf = Shelf(docs.sparkSession, "first")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), *_rows(docs, id_col, text_col)[:2])
    found = judged_rows(docs, k, percent, id_col, text_col).where("n > 0").groupBy("doc_id", "h").agg(F.max("first").alias("first"), F.count("*").alias("copies"))
    # what is not simply kept: rows that go, and rows equal in id and text, of which one stays
    other = shelf.put(found.where("NOT first OR copies > 1"), "other").withColumnsRenamed({"doc_id": "own", "h": "own_h"})
    match = F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("h") == F.col("own_h"))
    kept = rows.join(other, match, "left_anti").select("row.*")
    repeated = other.where("first")
    if not repeated.isEmpty():
        one = rows.join(repeated, match).groupBy("doc_id", "h").agg(F.min("row").alias("row"))
        kept = kept.unionByName(one.select("row.*"))
    return kept


def oracle(k: int = 3, percent: int = 85, table: str = "documents") -> str:
    """DuckDB: the rows of near_duplicates, by a self-join on the shingles."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
    t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
    g AS (SELECT doc_id, n, i, x{"".join(f" || ' ' || coalesce(lead(x, {j}) OVER p, '')" for j in range(1, k))} AS g FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
    s AS (SELECT DISTINCT doc_id, g FROM g WHERE i <= greatest(1, n - {k - 1})),
    c AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1),
    m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM m JOIN c x ON a = x.doc_id JOIN c y ON b = y.doc_id WHERE 100 * m.c >= {percent} * (x.n + y.n - m.c)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r(i, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.i = e.a WHERE r.root < e.b),
    f AS (SELECT i, min(root) AS root FROM r GROUP BY i)
    SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, f.root AS component_id, d.doc_id = f.root AS kept FROM d LEFT JOIN c USING (doc_id) JOIN f ON f.i = d.doc_id"""
