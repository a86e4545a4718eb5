"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` adds whole-text counts, ``compile_rules`` turns the threshold table into boolean
columns in integer arithmetic (``100 * numerator`` against ``percent * denominator``, so that no
verdict hangs on a rounded quotient). Everything is per row: no shuffle, no Python.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged
alike; a null id is returned as null; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their there they this to was we were which who will with you",
    "fr": "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne on ou par pas plus pour qu que qui sa se ses son sur un une vous",
    "de": "als am an auch auf aus bei das dem den der des die ein eine einem einen einer es für hat ich im in ist mit nach nicht oder sich sie sind so und von war wie wird zu zum zur",
    "es": "al como con de del el ella en es esta este la las le lo los más me mi no o para pero por que se si sin sobre son su sus un una y ya",
}
WORDS_TO_STOP = sorted({w for line in STOP_WORDS.values() for w in line.split()})


@dataclass(frozen=True)
class Rule:
    """Fails when 100 * part is over (or under) percent * whole, for texts of at least ``least`` words."""

    name: str
    part: str
    whole: str
    sense: str  # ">" or "<"
    percent: int
    least: int = 0


BASE_WORDS = 50
BASE_RULES = (Rule("repeated_words", "n_repeat_words", "n_words", ">", 50),)
RULES = (
    Rule("long_words", "word_chars", "n_words", ">", 1400),
    Rule("short_words", "word_chars", "n_words", "<", 200),
    Rule("symbols", "n_symbols", "n_words", ">", 25),
    Rule("few_stop_words", "n_stop_words", "n_words", "<", 4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", ">", 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", ">", 90),
    Rule("cut_lines", "n_cut_lines", "n_lines", ">", 30),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bullet_lines", "n_cut_lines")
SPACES = " \t\n\x0b\x0c\r"


def _branches(words: list[str]) -> str:
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[0], []).append(word[1:])
    out = []
    for head, tails in sorted(heads.items()):
        longer = [x for x in tails if x]
        out.append(head + (f"(?:{_branches(longer)})" + "?" * ("" in tails) if longer else ""))
    return "|".join(out)


def stop_pattern(words: list[str]) -> str:
    """Whole words of the list in either case; a tree of prefixes, so that a word is read once."""
    return rf"(?iu)(?<![^\x20\x09-\x0D])(?:{_branches(words)})(?![^\x20\x09-\x0D])"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of MEASURES over the whole text, each a long."""
    long = lambda c: c.cast("long")
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bare = F.translate("t", SPACES, "")
    trimmed = F.btrim("t", F.lit(SPACES))
    split = text.select(
        "doc_id",
        long(F.length(bare)).alias("word_chars"),
        long(F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.regexp_count("t", F.lit(stop_pattern(WORDS_TO_STOP)))).alias("n_stop_words"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    windows = split.select(
        "doc_id", "word_chars", "n_symbols",
        F.size("w").alias("n"),
        "n_stop_words", long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.size(F.filter("lines", lambda x: F.ltrim(x).rlike(r"^[-*•]\s")))).alias("n_bullet_lines"),
        long(F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))).alias("n_cut_lines"),
        # 64-bit hash of each window; two different windows of a text meet with odds of 2**-64 a pair
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # only texts in which some window comes again are sorted
    ordered = windows.withColumn("z", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = ordered.withColumn(
        "at", F.filter("z", lambda z, i: F.coalesce(F.get("z", i - 1)["h"] == z["h"], F.lit(False)) | F.coalesce(F.get("z", i + 1)["h"] == z["h"], F.lit(False)))
    )
    covered = F.array_distinct(F.flatten(F.transform("at", lambda z: F.array(z["i"], z["i"] + 1, z["i"] + 2))))
    return again.select(
        "doc_id", long(F.col("n")).alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("at").isNull(), F.lit(0).cast("long")).otherwise(long(F.size(covered))).alias("n_repeat_words"),
        "n_lines", "n_stop_words", "n_bullet_lines", "n_cut_lines",
    )


def fails(rule: Rule) -> Column:
    part, whole = 100 * F.col(rule.part), rule.percent * F.col(rule.whole)
    return ((part > whole) if rule.sense == ">" else (part < whole)) & (F.col("n_words") >= rule.least)


def compile_rules(base=BASE_RULES, rules=RULES, least_words: int = BASE_WORDS) -> list[Column]:
    """base_failed, a boolean for each rule, and kept."""
    base_failed = F.col("n_words") < least_words
    for rule in base:
        base_failed = base_failed | fails(rule)
    bad = base_failed
    for rule in rules:
        bad = bad | fails(rule)
    return [base_failed.alias("base_failed"), (~bad).alias("kept"), *(fails(r).alias(f"fails_{r.name}") for r in rules)]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **table) -> DataFrame:
    """One row per row of docs: its measures, base_failed, kept and the rules that it fails."""
    return measures(docs, id_col, text_col).select("doc_id", *MEASURES, *compile_rules(**table))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # a filter would be pushed below the projections, each measure put into it anew; not past a row number
    scored = measures(whole.select("row", F.col(f"row.`{text_col}`").alias("text")), "row", "text").withColumn("at", F.monotonically_increasing_id())
    return scored.where(compile_rules()[1] & (F.col("at") >= 0)).select("doc_id.*")


def _sql_fails(rule: Rule) -> str:
    return f"(100 * {rule.part} {rule.sense} {rule.percent} * {rule.whole} AND n_words >= {rule.least})"


def oracle_cte(table: str = "documents") -> str:
    """DuckDB: CTEs up to ``judged``, which has a row per row of the table."""
    space = r"[\x20\x09-\x0D]"
    stops = ", ".join(f"'{w}'" for w in WORDS_TO_STOP)
    base = " OR ".join([f"n_words < {BASE_WORDS}", *map(_sql_fails, BASE_RULES)])
    bad = " OR ".join(map(_sql_fails, RULES))
    return f"""
    src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
    parts AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM src),
    seq AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM parts),
    wins AS (SELECT rid, i, x, lead(x, 1) OVER (PARTITION BY rid ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY rid ORDER BY i) AS z FROM seq),
    keyed AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM wins WHERE z IS NOT NULL),
    cover AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM keyed, (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY rid),
    counted AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
        CAST(len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]\\s'))) AS BIGINT) AS n_bullet_lines,
        CAST(len(list_filter(l, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) AS BIGINT) AS n_cut_lines
        FROM parts LEFT JOIN cover USING (rid)),
    based AS (SELECT *, ({base}) AS base_failed FROM counted),
    judged AS (SELECT *, NOT (base_failed OR {bad}) AS kept FROM based)"""
