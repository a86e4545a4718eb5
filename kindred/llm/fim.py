"""Fill-in-the-middle: documents are cut at two line ends and put into prefix-suffix-middle or
suffix-prefix-middle order, for training.

The line ends of all texts of a batch are one packed bitvector over their bytes, with a directory of the
ones before each block (``Ranked``). The number of lines of a text is the difference of two ranks, and a
cut after r lines is the place of the r-th one after the text's start (select), so a text is never
split into lines. A second bitvector of the bytes that begin a character turns byte cuts into
numbers of code points. Texts are taken in pieces of about PIECE bytes (one text at least).

Which lines are cut at, whether and in which order the parts go, is drawn from a hash of seed and id.
``restore`` gives back the exact text.

Defined cases: a null text is an empty one; empty texts and texts that hold one of the marks stay as they
are (plain), with their number of lines. A null id is hashed as an empty string; rows of one id are cut
by the same numbers, each by its own lines. Only \\n ends a line. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 100, 50, 7
PIECE = 8 << 20
WORDS = 8  # of 64 bits in a block


class Ranked:
    """A packed bitvector with the number of ones before each block of WORDS words."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        room = -(-(len(bits) + 1) // (64 * WORDS)) * 8 * WORDS
        self.words = np.pad(packed, (0, room - len(packed))).view("<u8")
        ones = np.bitwise_count(self.words).reshape(-1, WORDS).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def _block(self, block: np.ndarray) -> np.ndarray:
        return self.words.reshape(-1, WORDS)[block]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, word, bit = at // (64 * WORDS), at // 64 % WORDS, (at % 64).astype(np.uint64)
        words = self._block(block)
        whole = np.where(np.arange(WORDS) < word[:, None], np.bitwise_count(words), 0).sum(axis=1, dtype=np.int64)
        part = words[np.arange(len(at)), word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, k from 1."""
        block = np.searchsorted(self.before, k, side="left") - 1
        words, left, own = self._block(block), k - self.before[block], np.arange(len(k))
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (upto < left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, upto[own, np.maximum(word, 1) - 1], 0)
        bits = np.unpackbits(words[own, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * 64 * WORDS + word * 64 + (np.cumsum(bits, axis=1, dtype=np.int64) < left[:, None]).sum(axis=1)


def cuts(data: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after another in ``data`` (ends: len + 1 offsets): the number of lines, both
    cuts as bytes from the start of data, and the code points of prefix and middle."""
    start, stop = ends[:-1], ends[1:]
    line_end = data == 10
    line_end[stop[stop > start] - 1] = True
    lines, chars = Ranked(line_end), Ranked((data & 0xC0) != 0x80)
    first = lines.rank(start)
    n = lines.rank(stop) - first
    a, b = h1 % (n + 1), h2 % (n + 1)

    def cut(r: np.ndarray) -> np.ndarray:
        out = start.copy()
        some = r > 0
        out[some] = lines.select(first[some] + r[some]) + 1
        return out

    one, two = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    at = [chars.rank(x) for x in (start, one, two)]
    return n, one, two, at[1] - at[0], at[2] - at[1]


def _pieces(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, side="right")) - 1)
        yield lo, hi
        lo = hi


def _hashes(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row; ``rate`` and ``spm_rate`` in percent."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches):
        for batch in batches:
            text = pc.fill_null(batch.column(5).cast(pa.large_binary()), b"")
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = text.buffers()[2]
            whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            h = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
            for lo, hi in _pieces(batch, ends):
                base, own = int(ends[lo]), ends[lo : hi + 1]
                data = whole[base : int(own[-1])]
                n, one, two, prefix, middle = cuts(data, own - base, h[0][lo:hi], h[1][lo:hi])
                data, forms, out = data.tobytes(), [], []
                for i, (s, a, b, e) in enumerate(zip((own[:-1] - base).tolist(), one.tolist(), two.tolist(), (own[1:] - base).tolist(), strict=True)):
                    t = data[s:e]
                    if not t or any(m in t for m in marks) or h[2][lo + i] % 100 >= rate:
                        forms.append("plain")
                        out.append(t)
                    elif h[3][lo + i] % 100 < spm_rate:
                        forms.append("spm")
                        out.append(b"".join((marks[1], data[b:e], marks[0], data[s:a], marks[2], data[a:b])))
                    else:
                        forms.append("psm")
                        out.append(b"".join((marks[0], data[s:a], marks[1], data[b:e], marks[2], data[a:b])))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    doc_id = F.col(f"`{id_col}`").cast("long")
    source = docs.select(doc_id.alias("doc_id"), *_hashes(doc_id, seed), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    prefix, suffix = (F.when(form == "psm", F.get(parts, F.lit(i))).otherwise(F.get(parts, F.lit(3 - i))) for i in (1, 2))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def digests(docs: DataFrame, **options) -> DataFrame:
    """transform() with hashes of the output and of the text restored from it in place of the output."""
    hashed = lambda c: F.sha2(c, 256)
    return transform(docs, **options).select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle(table: str = "documents", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> str:
    """DuckDB: the rows of digests(), by lists of lines."""
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM {table}),
    u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS l, {", ".join(f"CAST('0x' || substr(s, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
    c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
    p AS (SELECT *, array_to_string(l[1:a], '') AS x, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS y,
        CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || x || '{SUFFIX}' || y || '{MIDDLE}' || m ELSE '{SUFFIX}' || y || '{PREFIX}' || x || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
