"""A Merkle manifest of a dataset: a leaf per row, a subroot per language, one root, and a proof for each row.

A leaf is the hash of its fields, each ``-`` if null and else its number of UTF-8 bytes, ``:`` and the value.
Leaves of a language ascend by id; as long as several nodes remain, every ``fanout`` consecutive ones
become the hash of their concatenated digests (the last run may be shorter, a run of one included). The
subroots, in the order of languages, are reduced in the same way to the root.

Ranks come without a sort. ``ranked`` counts the rows of each bucket of a leading digit of the order's key; a
bucket of more than MOST rows is counted again by its next digit, and so on, only there. Buckets of one parent
are at most as many as a digit has values, so the first rank of a bucket is its parent's plus a sum over
few siblings, and the rows of a last bucket are numbered among themselves. The digits of a rank to the
base ``fanout`` are the way from the root to a leaf, so all nodes under one node have its digits as their prefix:
nodes are reduced in blocks of one prefix, BLOCK leaves at most, block by block up to the root. Downwards
each block is told the siblings above it, one row a block, and completes the proofs of its nodes.

Defined cases: rows without an id come before the others, rows of one id are ordered by their leaves; rows
equal in every field are interchangeable and get a place (and proof) each. A null language is a group of
its own, before the others, which are ordered by their UTF-8 bytes. A language of one row has its leaf as
subroot; a single language's subroot is the root. No rows, no result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import Shelf

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
BLOCK = 512
DIGIT_BITS = 12
MOST = 1 << DIGIT_BITS
SMALL = 200_000  # rows of a table of ranks that is sent to all tasks
SALTS = 16


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[f]) for f in FIELDS)), 256)


# -- ranks ----------------------------------------------------------------------------------------


def _attached(rows: DataFrame, table: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """A left join with a table of n rows that has a row a key; a key of many rows is split where the table is not sent to all."""
    if n <= SMALL:
        return rows.join(F.broadcast(table), keys, "left")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")


def ranked(rows: DataFrame, digits: Callable[[int], Column], order: list[str], shelf: Shelf, name: str, most: int = MOST) -> DataFrame:
    """``rows``, which have a column ``tree``, with their place (``idx``) in the order of their tree and the tree's size (``n``).

    digits(level) are whole numbers by which, level by level, the order's key ascends; ``order`` tells all rows
    of a tree apart and is the order within a bucket."""
    sizes = shelf.put(rows.groupBy("tree").agg(F.count("*").alias("n")), f"{name}-sizes")
    n_trees, largest = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    state = _attached(rows, sizes, ["tree"], order, n_trees).withColumns({"bucket": F.lit(0).cast("long"), "size": F.col("n")})
    level = 0
    while largest > most:
        # a bucket is known by its tree and first rank
        state = state.withColumn("digit", F.when(F.col("size") > most, digits(level)))
        counts = shelf.put(state.where("digit IS NOT NULL").groupBy("tree", "bucket", "digit").agg(F.count("*").alias("own")), f"{name}-{level}")
        n_buckets, largest = counts.agg(F.count("*"), F.coalesce(F.max("own"), F.lit(0))).first()
        before = F.sum("own").over(Window.partitionBy("tree", "bucket").orderBy("digit")) - F.col("own")
        state = _attached(state, counts.select("tree", "bucket", "digit", (F.col("bucket") + before).alias("next"), "own"), ["tree", "bucket", "digit"], order, n_buckets)
        state = state.withColumns({"bucket": F.coalesce("next", "bucket"), "size": F.coalesce("own", "size")}).drop("digit", "next", "own")
        level += 1
    within = F.row_number().over(Window.partitionBy("tree", "bucket").orderBy(*(F.asc_nulls_first(c) for c in order)))
    return state.withColumn("idx", F.col("bucket") + within - 1).drop("bucket", "size")


def id_digits(low: int, high: int) -> Callable[[int], Column]:
    """Digits of (doc_id, leaf, seq): of the bits in which ids differ, nulls first, then of the leaf and of seq."""
    bits = ((low ^ high) & (2**64 - 1)).bit_length()
    starts = [max(0, bits - DIGIT_BITS * (i + 1)) for i in range(max(1, -(-bits // DIGIT_BITS)))]

    def digit(level: int) -> Column:
        if level < len(starts):
            shifted = F.shiftright("doc_id", starts[level])
            if level:
                return F.coalesce(shifted.bitwiseAND((1 << (starts[level - 1] - starts[level])) - 1), F.lit(0).cast("long"))
            return F.coalesce(shifted, F.lit((low >> starts[0]) - 1).cast("long"))
        level -= len(starts)
        if level < 5:
            return F.conv(F.substring("leaf", 3 * level + 1, 3), 16, 10).cast("long")
        return F.shiftright("seq", max(0, 63 - DIGIT_BITS * (level - 4))).bitwiseAND((1 << DIGIT_BITS) - 1)

    return digit


def byte_digits(name: str) -> Callable[[int], Column]:
    """Digits of a string's UTF-8 bytes, three at a time; an end comes before any byte."""

    def digit(level: int) -> Column:
        read = F.hex(F.substring(F.col(name).cast("binary"), 3 * level + 1, 3))
        byte = lambda i: F.when(F.length(read) > 2 * i, F.conv(F.substring(read, 2 * i + 1, 2), 16, 10).cast("long") + 1).otherwise(F.lit(0).cast("long"))
        return (byte(0) * 257 + byte(1)) * 257 + byte(2)

    return digit


# -- trees ----------------------------------------------------------------------------------------


def height(n: int, fanout: int) -> int:
    """How often n nodes are reduced until one remains."""
    steps = 0
    while n > 1:
        n, steps = -(-n // fanout), steps + 1
    return steps


def block_levels(fanout: int, block: int = BLOCK) -> int:
    """Levels of a block: as many as leave at most ``block`` leaves under a node, one at least."""
    levels = 1
    while fanout ** (levels + 1) <= block:
        levels += 1
    return levels


def levels_of(nodes: list[str], steps: int, fanout: int) -> list[list[str]]:
    out = [nodes]
    for _ in range(steps):
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings_of(levels: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    """Of node i, level by level, the digests left and right of its way in the same run."""
    out = []
    for level in levels[:-1]:
        run = i // fanout
        out.append(("".join(level[run * fanout : i]), "".join(level[i + 1 : (run + 1) * fanout])))
        i = run
    return out


def packed(siblings: list[tuple[str, str]]) -> str:
    return ";".join(f"{a},{b}" for a, b in siblings)


def unpacked(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in text.split(";")] if text else []


def fold(node: str, siblings: list[tuple[str, str]]) -> str:
    """The root that a node leads to with these siblings."""
    for a, b in siblings:
        node = digest(a, node, b)
    return node


class Trees:
    """All trees of a table (tree, n, idx, h), reduced at once, block by block."""

    def __init__(self, nodes: DataFrame, largest: int, fanout: int, shelf: Shelf, name: str, block: int = BLOCK):
        self.fanout, self.shelf, self.name = fanout, shelf, name
        self.levels = block_levels(fanout, block)
        self.width = fanout**self.levels
        self.passes = [nodes]
        for i in range(max(1, -(-height(largest, fanout) // self.levels))):
            self.passes.append(shelf.put(self._up(self.passes[-1]), f"{name}-up-{i}"))
        self.roots = self.passes[-1].select("tree", "h")

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("idx") / self.width).cast("long"))

    def _up(self, nodes: DataFrame) -> DataFrame:
        most, fanout = self.levels, self.fanout

        def run(key: tuple, table: pa.Table) -> pa.Table:
            levels = _levels(table.sort_by("idx"), most, fanout)
            left = table["n"][0].as_py()
            for _ in levels[1:]:
                left = -(-left // fanout)
            return pa.table({"tree": [key[0].as_py()], "n": pa.array([left], pa.int64()), "idx": pa.array([key[1].as_py()], pa.int64()), "h": levels[-1]})

        return self._blocks(nodes.select("tree", "n", "idx", "h")).groupBy("tree", "block").applyInArrow(run, "tree string, n long, idx long, h string")

    def down(self, above: DataFrame, finish, schema: str) -> DataFrame:
        """What ``finish`` gives back of the nodes of a block (a table in the order of idx), their siblings within
        the block, and those above and what is ``told`` of the block. ``above``: (tree, above, told) of each root."""
        above = above.withColumn("block", F.lit(0).cast("long"))
        for i in range(len(self.passes) - 2, 0, -1):
            above = self._met(self.passes[i], above, _passed_on, "tree string, block long, above string, told string")
            above = self.shelf.put(above, f"{self.name}-down-{i}")
        return self._met(self.passes[0], above, finish, schema)

    def _met(self, nodes: DataFrame, above: DataFrame, finish, schema: str) -> DataFrame:
        most, fanout = self.levels, self.fanout

        def run(table: pa.Table, row: pa.Table) -> pa.Table:
            table = table.sort_by("idx")
            levels = _levels(table, most, fanout)
            ways = [siblings_of(levels, i, fanout) for i in range(table.num_rows)]
            return finish(table, ways, unpacked(row["above"][0].as_py()), row["told"][0].as_py())

        return self._blocks(nodes).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, schema)


def _levels(table: pa.Table, most: int, fanout: int) -> list[list[str]]:
    return levels_of(table["h"].to_pylist(), min(most, height(table["n"][0].as_py(), fanout)), fanout)


def _passed_on(table: pa.Table, ways: list, above: list, told: str) -> pa.Table:
    return pa.table({"tree": table["tree"], "block": table["idx"], "above": [packed(w + above) for w in ways], "told": [told] * len(ways)})


def prove(docs: DataFrame, changed: dict[str, Column] | None = None, fanout: int = FANOUT, columns: dict[str, str] | None = None, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``changed``: columns as found later (by field, of docs' columns); a row's leaf is made of these and folded with
    the siblings of the manifest. ``columns``: the names of the fields in docs where they differ."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "merkle")
    own = {f: F.col(f"`{(columns or {}).get(f, f)}`") for f in FIELDS}
    later = own | (changed or {})
    different = F.lit(False)
    for f in changed or {}:
        different = different | ~own[f].eqNullSafe(later[f])
    tree = F.when(own["lang"].isNull(), "-").otherwise(F.concat(F.lit("="), own["lang"]))
    found = docs.select(tree.alias("tree"), own["doc_id"].cast("long").alias("doc_id"), leaf(own).alias("leaf"), F.when(different, leaf(later)).alias("later"), F.monotonically_increasing_id().alias("seq"))
    leaves = shelf.put(found, "leaves")  # a row's seq holds from here on
    low, high = leaves.agg(F.min("doc_id"), F.max("doc_id")).first()
    nodes = ranked(leaves, id_digits(low or 0, high or 0), ["doc_id", "leaf", "seq"], shelf, "ranks", most)
    nodes = shelf.put(nodes.select("tree", "n", "idx", F.col("leaf").alias("h"), "doc_id", "later"), "nodes")
    largest = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    trees = Trees(nodes, largest, fanout, shelf, "leaves", block)
    # the subroots are the leaves of one more tree
    heads = trees.roots.select(F.substring("h", 1, 0).alias("tree"), F.col("tree").alias("key"), "h")
    heads = shelf.put(ranked(heads, byte_digits("key"), ["key"], shelf, "langs", most), "heads")
    top = Trees(heads, heads.count(), fanout, shelf, "langs", block)
    root = top.roots.first()
    root = root.h if root else None

    def to_langs(table: pa.Table, ways: list, above: list, told: str) -> pa.Table:
        return pa.table({"tree": table["key"], "above": [packed(w + above) for w in ways], "told": table["h"]})

    start = spark.range(1).select(F.lit("").alias("tree"), F.lit("").alias("above"), F.lit("").alias("told"))
    above = shelf.put(top.down(start if root else start.limit(0), to_langs, "tree string, above string, told string"), "above")

    def to_rows(table: pa.Table, ways: list, above: list, told: str) -> pa.Table:
        rest = "".join(a + b for a, b in above)
        proofs = [digest(*(x for pair in w for x in pair), rest) for w in ways]
        now = [later or h for later, h in zip(table["later"].to_pylist(), table["h"].to_pylist(), strict=True)]
        folded = [fold(fold(h, w), above) for h, w in zip(now, ways, strict=True)]
        return pa.table({"doc_id": table["doc_id"], "leaf": table["h"], "subroot": pa.array([told] * len(ways), pa.string()), "proof_sha256": proofs, "folded_root": folded})

    out = trees.down(above, to_rows, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def tampered(every: int = 7) -> dict[str, Column]:
    """n_chars grows by 1 where ``every`` divides the CRC-32 of the decimal id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def oracle(table: str = "documents", fanout: int = FANOUT, every: int = 7) -> str:
    """DuckDB: the rows of prove() with tampered(), fanout 2, by numbered levels. Ids must be unique."""
    assert fanout == 2, "the SQL pairs nodes"
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    hashed = lambda n: "sha256(" + " || ".join(part(n if f == "n_chars" else f) for f in FIELDS) + ")"
    # CRC-32 by its definition, a byte of the decimal id at a time
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
    WITH RECURSIVE crc(doc_id, rest, c, bits) AS (SELECT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT), 0 FROM {table} WHERE doc_id IS NOT NULL UNION ALL
        SELECT doc_id, CASE WHEN bits = 0 THEN substr(rest, 2) ELSE rest END, CASE WHEN bits = 0 THEN xor(c, CAST(unicode(rest) AS BIGINT)) ELSE {shift} END, (bits + 1) % 9 FROM crc WHERE bits > 0 OR rest <> ''),
    hit AS (SELECT doc_id FROM crc WHERE bits = 0 AND rest = '' AND xor(c, 4294967295) % {every} = 0),
    l AS (SELECT doc_id, lang, {hashed("n_chars")} AS h, {hashed("(n_chars + 1)")} AS h2, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM {table}),
    up AS (SELECT 0 AS level, lang, i, h, n FROM l UNION ALL
        SELECT level + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY level, lang, i // 2),
    s AS (SELECT lang, h AS subroot, level AS top FROM up WHERE n = 1),
    g AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM s),
    up2 AS (SELECT 0 AS level, j, subroot AS h, m FROM g UNION ALL SELECT level + 1, j // 2, sha256(string_agg(h, '' ORDER BY j)), (any_value(m) + 1) // 2 FROM up2 WHERE m > 1 GROUP BY level, j // 2),
    nodes AS (SELECT level, lang, i, h FROM up),
    sib AS (SELECT l.doc_id, l.lang, k.level, x.h, (l.i >> k.level) & 1 AS side FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang, unnest(range(0, g.top)) k(level)
            LEFT JOIN nodes x ON x.level = k.level AND x.lang IS NOT DISTINCT FROM l.lang AND x.i = xor(l.i >> k.level, 1)
        UNION ALL SELECT l.doc_id, l.lang, g.top + k.level, x.h, (g.j >> k.level) & 1 FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang, unnest(range(0, (SELECT max(level) FROM up2))) k(level)
            LEFT JOIN up2 x ON x.level = k.level AND x.j = xor(g.j >> k.level, 1)),
    way AS (SELECT doc_id, lang, list(coalesce(h, '') ORDER BY level) AS hs, list(side ORDER BY level) AS sides FROM sib GROUP BY doc_id, lang),
    f(doc_id, lang, k, h, hs, sides) AS (SELECT l.doc_id, l.lang, 1, CASE WHEN hit.doc_id IS NOT NULL AND h2 IS NOT NULL THEN h2 ELSE l.h END, coalesce(hs, []), coalesce(sides, [])
            FROM l LEFT JOIN hit ON l.doc_id = hit.doc_id LEFT JOIN way w ON w.doc_id IS NOT DISTINCT FROM l.doc_id AND w.lang IS NOT DISTINCT FROM l.lang
        UNION ALL SELECT doc_id, lang, k + 1, CASE WHEN sides[k] = 1 THEN sha256(hs[k] || h) ELSE sha256(h || hs[k]) END, hs, sides FROM f WHERE k <= len(hs)),
    r AS (SELECT h AS root FROM up2 WHERE m = 1)
    SELECT l.doc_id, l.h AS leaf, g.subroot, root, sha256(array_to_string(f.hs, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
    FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang JOIN f ON f.doc_id IS NOT DISTINCT FROM l.doc_id AND f.lang IS NOT DISTINCT FROM l.lang AND f.k = len(f.hs) + 1, r"""
