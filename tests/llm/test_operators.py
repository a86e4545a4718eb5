import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("kindred.llm")
from pyspark.sql import functions as F

from kindred.llm import common, contain, curriculum, html_diff, lm_diff, mil, minhash, pii, quality_rules, queries, secrets_scan, warc
from tests_llm_support import brute_components, brute_targets, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, key string, kept string"
LONG = "one two three four five six seven " * 9000
ODD = [
    (1, None, "en", "a"), (2, "", "en", "b"), (3, LONG, "de", None), (4, "ab\ncd\tef\x0bgh", "en", "a"), (4, "ab\ncd\tef\x0bgh", "en", "a"),
    (None, "ab cd ef gh ij", "en", "a"), (None, None, None, None), (7, "été  naïve \U0001f600 mail a.b@c.de 10.0.0.1", "fr", "c"), (8, "x" * 3000 + " 4111 1111 1111 1111", "en", "c"), (9, "AB CD EF GH ij", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 5, 0.5, "k", "x") for i, t, g, s in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same_as_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    got = sorted(map(repr, (tuple(r[c] for c in want.columns) for r in found.collect())))
    assert got == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    same_as_oracle(spark, name)


def test_quality_rules_edges(spark, odd, empty):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.n_words for r in rows) == sorted(len(words(t)) for _, t, *_ in ODD)
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == 0


def test_repeated_words(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.measures(df).collect():
        w = words(texts[r.doc_id])
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert r.n_repeat_words == len(cover)


def test_keep_good_is_judge(docs):
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert kept == {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_brute(spark, docs, k, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    for i in range(40):  # a group whose members lie about the threshold of one another
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = f"z{i}"
        rows.append((10_000 + i, " ".join(copy)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    want = brute_components(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_in_few_files(spark, monkeypatch):
    # tables of a few numbers a row are not written in a file for each shuffle partition, and lose no rows by that
    rows = [(i, " ".join(f"w{i // 4}x{j}" for j in range(60)) + f" z{i % 2}") for i in range(1200)]
    conf, cores, files = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, spark.sparkContext.defaultParallelism, {}
    put = common.Shelf.put

    def counted(shelf, df, name, *more):
        out = put(shelf, df, name, *more)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(common.Shelf, "put", counted)
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in found} == {i: i // 4 * 4 for i, _ in rows} and len(found) == len(rows)
    several = [x for x in files if x.startswith("roots-0")]
    assert several and all(files[x] <= cores for x in ["classes", "sets", *several]), files
    assert not {"signed", "members", "wanted", "judged", "groups", "links"} & set(files)  # kept without files


def test_near_duplicates_edges(odd, empty):
    rows = minhash.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id is not None} == {(i, i) for i, *_ in ODD if i is not None}
    # of the null ids one has no words, and one has the words of id 9
    assert {(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None} == {(0, None, True), (3, 9, False)}
    assert minhash.near_duplicates(empty, 3, 85).count() == 0
    kept = minhash.keep_first(odd)
    # one of the two equal rows of id 4 goes, and the null id with the words of id 9
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (None, c), (None, c + " more"), (None, d), (4, d + " more"), (5, None), (5, None), (None, ""), (6, "A0"), (6, "a0")]
    docs = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, h long, first string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 5, 80).collect())
    assert got == Counter({(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (None, None, True): 2, (None, None, False): 1, (None, 4, False): 1, (4, 4, True): 1, (5, 5, True): 2, (6, 6, True): 2})
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    # both texts of id 1 stay, a text of the null ids, every row without words, and one of the equal sets of id 6
    assert {(1, a), (1, b), (4, d + " more"), (5, None), (None, "")} <= set(found) and len(found) == 8
    assert sum(i is None and t.startswith("c0") for i, t in found if t) == 1 and sum(i == 6 for i, _ in found) == 1


def test_min_max_is_unbiased():
    rng = np.random.default_rng(0)
    both, own = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    a, b = minhash.permutations(2000)
    x, y = minhash.min_max(np.concatenate([both, own[:100]]), a, b), minhash.min_max(np.concatenate([both, own[100:]]), a, b)
    for i in (0, 1):
        assert abs((x[i] == y[i]).mean() - 0.6) < 0.05


def test_containment_brute(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rng = random.Random(3)
    extra = []
    for n, r in enumerate(items.collect()):  # a part of the item in a long text
        own = r.text.split()
        part = own[: max(1, int(len(own) * (0.7 + 0.3 * rng.random())))]
        extra.append((50_000 + n, " ".join([f"u{rng.random()}" for _ in range(3000)] + part)))
    every = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    sets = {r.item_id: contain.shingles_of(r.text.encode(), 5) for r in items.collect()}
    want = set()
    for r in every.collect():
        own = contain.shingles_of(r.text.encode(), 5)
        want |= {(r.doc_id, i, len(s), len(s & own)) for i, s in sets.items() if len(s & own) >= 0.8 * len(s)}
    for block in (contain.BLOCK, 4000):
        found = contain.search(every, items, block=block)
        assert {(r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in found.collect()} == want
    assert len(want) > 10


def test_containment_edges(spark, odd, empty):
    items = spark.createDataFrame([(1, "cd EF"), (1, "cd EF"), (2, ""), (3, None), (None, "six seven one two three four")], "item_id long, text string")
    rows = contain.search(odd, items).collect()
    assert {r.item_id for r in rows if r.doc_id == 4} == {1} and {r.item_id for r in rows if r.doc_id == 3} == {None}
    assert contain.search(empty, items).count() == 0 and contain.search(odd, items.limit(0)).count() == 0
    # rows of a null id are judged by their own text
    kept = contain.drop_contaminated(odd, items).collect()
    assert kept[0].__fields__ == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((i or 0, t or "") for i, t, *_ in ODD if i not in (3, 4, 9) and t != "ab cd ef gh ij")
    assert contain.drop_contaminated(odd, items.limit(0)).count() == len(ODD)


def test_partitions_by_size():
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)).encode()) for i, n in enumerate((5, 6, 8, 12, 30, 31, 70, 300))]
    index = contain.Index(items, 5, 0.8)
    sizes = {i: len(t.split()) - 4 for i, t in items}
    assert len(index.partitions) == len({contain.sketched(n) for n in sizes.values()})
    for part in index.partitions:
        ends = {contain.sketched(sizes[i]) for i in part.items.tolist()}
        assert len(ends) == 1
        u = ends.pop()
        assert all(u / 2 < sizes[i] <= u for i in part.items.tolist()) and (np.bincount(part.owners) == np.minimum(u - contain.needed(u, 0.8) + 1, [sizes[i] for i in part.items.tolist()])).all()


def test_pii_base_brute(odd, empty, docs):
    luhn_ok = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def brute(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        cards = ((m, re.sub("[ -]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t))
        out += [(m.start(), 2, m.end()) for m, d in cards if 14 <= len(d) <= 19 and luhn_ok(d)]
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return [(s, e, pii.BASE[k]) for s, k, e in sorted(out)]

    rng = random.Random(6)
    made = ["".join(rng.choice("0123456789 .-@+a()\n") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts = made + [t or "" for _, t, *_ in ODD] + [r.text for r in docs.collect()]
    for t in texts:
        assert pii.base_spans(t, pii.marked_runs(t)) == brute(t)
    rows = pii.find(odd).collect()
    assert len(rows) == len(ODD) and pii.find(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].base_sha256 == hashlib.sha256(b"").hexdigest() and by[1].spans == ""
    assert by[7].n_email == by[7].n_ip == 1 and by[8].n_card == 1


def test_pii_field_held_out():
    field = pii.train(pii.labelled_rows())
    good = wrong = want = 0
    for text, spans in pii.labelled_rows(120, seed=99):
        found = set(pii.find_all([text], field)[0][1])
        good, wrong, want = good + len(found & set(spans)), wrong + len(found - set(spans)), want + len(spans)
    assert good >= 0.8 * want and wrong <= 0.05 * want


#: Written by hand, not by the rule that makes the labelled table; [kind|value] are its spans.
BY_HAND = """Please ring [phone|(415) 555-0132] after lunch and ask for Dana.
My cell is [phone|212-555-0198], the office closes at 17:30.
For help dial [phone|650.555.0117] or visit room 204 on floor 3.
Fax number: [phone|(303) 555-0145], invoices from 2019 and 2020.
Her extension changed, use [phone|702-555-0166] instead.
Text [phone|718 555 0123] if the parcel of 12 kg is late.
Patient SSN [ssn|078-05-1120], admitted 03/11/2021.
The form lists [ssn|219-09-9999] as the social security number.
Employee 4471 has SSN [ssn|457-55-5462] and badge 88.
taxpayer id [ssn|123-45-6789] filed in April
Wire the rent to [iban|DE89 3704 0044 0532 0130 00] before the 5th.
Her account [iban|FR14 2004 1010 0505 0001 31] was closed in 2018.
iban [iban|ES91 2100 0418 4502 0005 13] belongs to the shop
Refund goes to [iban|DE75 5121 0800 1245 1261 99] within 14 days.
The meeting on 2024-05-17 has 24 guests and costs 1,250 euros.
Chapter 12, pages 340-352, explains figure 7.3 in 3 steps.
Version 10.15.7 was built 1999 times by 42 people.
Flight 447 left gate 23 at 18:05 with 216 aboard.
The 100-200 range grew by 3.5% over 12 months.
Order 30211 of 2021/11/05 weighs 13.25 kg.
Room 101-102 seats 30, bus 9 leaves at 7:45.
ISBN 978-3-16-148410-0 sold 120,000 copies.""".splitlines()


def test_pii_field_on_sentences_written_by_hand():
    field = pii.train(pii.labelled_rows())
    added, right, wanted = 0, Counter(), Counter()
    for line in BY_HAND:
        text, spans = "", []
        for part in re.split(r"(\[\w+\|[^\]]+\])", line):
            kind, _, value = part[1:-1].partition("|") if part.startswith("[") else ("", "", part)
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value
        base, every = pii.find_all([text], field)[0]
        more = set(every) - set(base)
        added += len(more)
        for span in spans:
            wanted[span[2]] += 1
            right[span[2]] += span in more
    print(dict(right), dict(wanted), added)
    assert sum(right.values()) >= 0.7 * sum(wanted.values()) and sum(right.values()) >= 0.8 * added


def test_labelled_spans_are_checked():
    for bad in ([(0, 4, "name")], [(0, 4, "phone")]):
        with pytest.raises(ValueError, match="labelled span"):
            pii.train([("Anna called 555-0101", bad)], rounds=1)


def test_viterbi_and_marginals_brute():
    import itertools

    rng = np.random.default_rng(1)
    e, step = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    total = lambda p: sum(e[i, y] for i, y in enumerate(p)) + step[0, p[0]] + sum(step[a, b] for a, b in zip(p, p[1:])) + step[p[-1], 0]
    paths = list(itertools.product(range(3), repeat=4))
    assert tuple(pii.viterbi([e], step)[0]) == max(paths, key=total)
    z = np.array([np.exp(total(p)) for p in paths])
    post, _ = pii.forward_backward(e, step)
    for i in range(4):
        for y in range(3):
            assert np.isclose(post[i, y], z[[p[i] == y for p in paths]].sum() / z.sum())


def test_redact(odd):
    rows = pii.redact(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert "<EMAIL>" in by[7].text and "<IP>" in by[7].text and by[7].n_chars == len(by[7].text) and by[1].text is None and by[8].text.endswith("<CARD>")


def test_secrets(odd, empty, docs):
    scanner = secrets_scan.Scanner()
    hexes = re.compile(r"[0-9a-f]+")
    rng = random.Random(8)
    parts = ["password", "Secret", "api_key", "TOKEN", "=", ": ", '"', " ", "AKIA", "abc123", "0123456789abcdef" * 2, "ZZ99", "Key", "."]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in made + [r.text for r in docs.collect()]:
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in hexes.finditer(t) if len(m[0]) >= 24]
        assert secrets_scan.base_spans(t) == [(s, e, secrets_scan.BASE[k]) for s, k, e in sorted(want)]
    hit = Counter()
    for token, family in secrets_scan.labelled_credentials(40, seed=123):
        if len(token) >= 20:
            spans = scanner.find(f"a {token} b")[1]
            hit[family == "plain", any(k.startswith("format") for *_, k in spans) if family == "plain" else bool(spans)] += 1
    assert hit[False, True] >= 0.97 * (hit[False, True] + hit[False, False]) and hit[True, True] <= 0.02 * (hit[True, True] + hit[True, False])
    token = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
    assert scanner.find(f"use {token} now")[1] == [(4, 44, "format-github")]
    assert len(secrets_scan.find(odd).collect()) == len(ODD) and secrets_scan.find(empty).count() == 0


def test_secrets_inside_a_run():
    scanner = secrets_scan.Scanner()
    shares = Counter()
    for token, family in secrets_scan.labelled_credentials(30, seed=77):
        if family in ("github", "stripe", "slack", "google"):
            for before, after in (("auth=", ""), ("key=", ""), ("v1/keys/", ""), ("https://a.example.com/x?auth=", "&b=1")):
                start = len(before) + 4
                shares[family, any(s in (start, 4 if "/keys/" in before else start) and e == start + len(token) for s, e, _ in scanner.find(f"use {before}{token}{after} now")[1])] += 1
    for family in ("github", "stripe", "slack", "google"):
        assert shares[family, True] >= 0.9 * (shares[family, True] + shares[family, False]), shares


def walked(a, token):
    """Log-likelihood by the automaton's counts."""
    q, total = 0, 0.0
    for c in token:
        if q is None:
            total += secrets_scan.FLOOR / 2
            continue
        kind = next((k for k, members in secrets_scan.CLASSES.items() if c in members), None)
        to, n = a.next[q].get(c, a.next[q].get("any", (None, 0)) if kind else (None, 0))
        total += np.log(n / a.arrive[q]) if n else secrets_scan.FLOOR
        if n and c not in a.next[q]:
            assert sum(a.ranges[q].values()) == n
            total += np.log((a.ranges[q].get(kind, 0) + 5 * a.prior[kind]) / (n + 5) / len(secrets_scan.CLASSES[kind]))
        q = to
    return total + (np.log(a.ends[q] / a.arrive[q]) if q is not None and a.ends[q] else secrets_scan.FLOOR)


def test_every_candidate_is_scored_brute(spark):
    scanner = secrets_scan.Scanner()
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(90_000, "auth=ghp_" + "Ab3" * 12 + " and password: hunter22 then " + "lettersonly" * 3), (90_001, "x" * 30 + "/" + "0f" * 20), (90_002, None)]
    rows = rows.union(spark.createDataFrame(extra, rows.schema))
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    n = 0
    for r in secrets_scan.find(rows).collect():
        text = texts[r.doc_id]
        found = [x.rsplit(":", 3) for x in r.scored.split(",")] if r.scored else []
        assert r.n_scored == len(found)
        for family, start, end, score in found:
            token = text[int(start) : int(end)]
            ll = {k: walked(a, token) for k, a in scanner.families.items()}
            assert abs(float(score) - (ll[family] - walked(scanner.plain, token)) / len(token)) < 6e-4
            n += 1
        # each run of token characters and each base span has a score
        covered = [(int(s), int(e)) for _, s, e, _ in found]
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{20,}", text):
            assert any(s < m.end() and m.start() < e for s, e in covered)
        for s, e, _ in secrets_scan.base_spans(text):
            assert any(s <= a and b <= e for a, b in covered)
        if found:
            assert r.top_score == pytest.approx(max(float(x[3]) for x in found), abs=6e-4)
    assert n > 10


def test_automaton_keeps_frequencies():
    rng = random.Random(5)
    examples = ["".join(rng.choice("+-/_") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    # alpha 2 makes the bound nought: only states of equal frequencies are merged, which changes no likelihood
    a = secrets_scan.Automaton(examples, alpha=2.0)
    for x, n in Counter(examples).items():
        assert abs(a.loglik(x) - np.log(n / len(examples))) < 1e-9


def test_automata_know_their_formats():
    """Literal parts are kept as characters, and lengths in the states."""
    scanner, rng = secrets_scan.Scanner(), random.Random(31)
    drawn = lambda kind, n: "".join(rng.choices(secrets_scan.LETTERS[kind], k=n))
    for _ in range(40):
        for token in ("zzz_" + drawn("x", 36), "BQQC" + drawn("u", 16), "ghp_" + drawn("x", 22), "ghq_" + drawn("x", 36), "xoxz-" + drawn("d", 12) + "-" + drawn("d", 12) + "-" + drawn("x", 24)):
            assert scanner.find(f"use {token} now")[1] == [], token
        assert scanner.score("zzz_" + drawn("x", 36))[0] < secrets_scan.LEAST_SCORE
        for token, family in (
            ("eyJ" + drawn("w", 33) + ".eyJ" + drawn("w", 150) + "." + drawn("w", 342), "jwt"), ("xoxb-" + drawn("d", 11) + "-" + drawn("d", 11) + "-" + drawn("x", 24), "slack"), ("ghp_" + drawn("x", 36), "github"),
            ("sk_live_" + drawn("x", 40), "stripe"), ("AIza" + drawn("w", 35), "google"),
        ):
            assert scanner.find(f"use {token} now")[1] == [(4, 4 + len(token), f"format-{family}")], token


def test_secrets_of_another_making():
    """Tokens drawn from digests, not by the generator that labels the examples."""
    import base64

    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    raw = lambda i, n: b"".join(hashlib.sha512(f"{i}/{j}".encode()).digest() for j in range(n // 64 + 1))[:n]
    letters = lambda i, n, among=alphabet: "".join(among[b % len(among)] for b in raw(i, n))
    made = {
        "github": lambda i: "ghp_" + letters(i, 36),
        "access": lambda i: "AKIA" + letters(i, 16, alphabet[:36]),
        "stripe": lambda i: "sk_live_" + letters(i, 24),
        "slack": lambda i: f"xoxb-{letters(i, 12, '0123456789')}-{letters(i + 1, 12, '0123456789')}-{letters(i, 24)}",
        "google": lambda i: "AIza" + letters(i, 35, alphabet + "-_"),
        "aws": lambda i: base64.b64encode(raw(i, 30)).decode(),
        "jwt": lambda i: ".".join(("eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJ" + base64.urlsafe_b64encode(raw(i, 45)).decode(), base64.urlsafe_b64encode(raw(i, 32)).decode().rstrip("="))),
        "digest": lambda i: hashlib.sha1(b"%d" % i).hexdigest(),
    }
    scanner, hit = secrets_scan.Scanner(), Counter()
    for family, make in made.items():
        for i in range(100):
            token = make(i * 7)
            spans = scanner.find(f"the value {token} was set")[1]
            hit[family] += any(s < 10 + len(token) and 10 < e for s, e, _ in spans)
    print(dict(hit))
    assert all(hit[f] >= 90 for f in made if f != "jwt") and hit["jwt"] >= 50
    plain = ["electroencephalographically", "https://docs.example.org/guide/getting-started", "src/main/java/com/example/App.java", "snake_case_variable_name_of_old", "2024-05-17T10:22:31.000", "Donaudampfschifffahrtsgesellschaft", "v1.22.333-alpha.4.linux.amd64", "===========================", "one.two.three.four.five.six"]
    assert [x for x in plain if scanner.find(x)[1]] == []


def test_automaton_is_a_distribution():
    a = secrets_scan.Automaton(["ab1", "ab2", "a1", "b", "ab1"])
    for q in a.red:
        assert a.ends[q] + sum(n for _, n in a.next[q].values()) == a.arrive[q]


def test_mix(odd, empty, docs):
    rows = curriculum.mix(odd, keep=["doc_id"]).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r.size for r in rows)
    assert curriculum.mix(empty, keep=["doc_id"]).count() == 0
    by = {}
    for r in curriculum.mix(docs, keep=["doc_id", "source"]).collect():
        t = by.setdefault(r.row.source, [r.target, 0, 0])
        t[1] += r.taken
        t[2] = max(t[2], r.size)
    assert all(abs(t - k) <= big for t, k, big in by.values())
    order = [r.position for r in curriculum.training_order(docs).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    clash = curriculum.training_order(docs.selectExpr("*", "'mine' AS position", "1 AS key", "2 AS target", "3 AS row", "4 AS Epoch"))
    assert clash.columns == [*docs.columns, "key", "target", "row", "epoch", "position"] and [r.position for r in clash.collect()] == order
    flat = curriculum.mix(docs, named={"s": curriculum.Schedule(((0.0, 1.0), (1.0, 1.0)))}, turns=((1.0, ((0.0, 1.0), (1.0, 1.0))),), share=1.0)
    assert all(abs(r.target - r.source_size) < 1e-6 * r.source_size or r.target == 2 * r.source_size or r.target > 0 for r in flat.collect())


def test_targets_and_inverse(spark):
    rng = random.Random(3)
    for n in (3, 40):
        sizes = {f"s{i:02}": rng.choice((0, 1, 10, 1000, rng.randint(1, 9999))) for i in range(n)} | {None: 7}
        rows = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, s long, n long")
        got = {r.source: r.target for r in curriculum.goals(common.Shelf(spark, "goals"), rows, curriculum.TURNS, {"s01": curriculum.Schedule(((0.0, 0.0), (1.0, 6.0)))}, 1.5, 2.0).collect()}
        weights = {k: 3.0 if k == "s01" else (5.0, 2.0, 1.0)[i % 3] for i, k in enumerate(sorted(sizes, key=lambda k: (k is None, k)))}
        want = brute_targets(sizes, weights)
        assert got == pytest.approx(want)
    plan = curriculum.Schedule(((0.0, 1.5), (0.5, 0.5), (1.0, 2.0)))
    t, w, cum = [k[0] for k in plan.knots], [k[1] for k in plan.knots], plan.integrals()
    row = [float(x) for x in np.linspace(0, 1, 21)]
    df = spark.createDataFrame([(x, t, w, cum) for x in row], "x double, t array<double>, w array<double>, cum array<double>")
    grid = np.linspace(0, 1, 20001)
    dens = np.interp(grid, t, w)
    integral = np.concatenate([[0], np.cumsum((dens[1:] + dens[:-1]) / 2 * np.diff(grid))])
    for r in df.select("x", curriculum.inverse(F.col("x"), F.col("t"), F.col("w"), F.col("cum")).alias("at")).collect():
        assert abs(np.interp(r["at"], grid, integral) - r["x"] * cum[-1]) < 1e-6


def test_classifier(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mil.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in mil.score(docs, model).collect() if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    rows = mil.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and mil.score(empty, model).count() == 0
    assert {r.score for r in mil.score(odd, mil.train(docs, labels.limit(0))).collect()} == {0.5}


def test_training_is_bounded(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    twice = docs.union(docs.withColumn("text", F.concat("text", F.lit(" again"))))
    assert mil.train(twice, labels, most_labelled=20).trained and not mil.train(docs, labels, most_bytes=0).trained
    one, two = (mil.train(docs.orderBy(F.rand(i)), labels, most_bytes=100_000) for i in (1, 2))
    assert all((one.w[k] == two.w[k]).all() for k in one.w)


def test_attention_brute():
    """Forward by loops, bag by bag, and gradients by finite differences."""
    rng = np.random.default_rng(4)
    model = mil.Attention(width=6, encode=5, gate=4)
    model.w = {k: rng.normal(size=v.shape) for k, v in model.w.items()}
    x, starts, y = rng.normal(size=(11, 6)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0, 0.0])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def brute():
        w, out = model.w, []
        for lo, hi in zip(starts, [*starts[1:], len(x)]):
            h = [np.tanh(sum(x[i][a] * w["E"][a] for a in range(6)) + w["e"]) for i in range(lo, hi)]
            s = np.array([sum(w["w"][j] * np.tanh(v @ w["V"][:, j]) * sigmoid(v @ w["U"][:, j]) for j in range(4)) for v in h])
            weight = np.exp(s) / np.exp(s).sum()
            out.append(sigmoid(sum(a * v for a, v in zip(weight, h)) @ w["c"] + w["b"][0]))
        return np.array(out)

    assert np.allclose(model._forward(x, starts)[-1], brute())
    loss = lambda: -np.mean(y * np.log(brute()) + (1 - y) * np.log(1 - brute()))
    for k, grad in model.gradients(x, starts, y).items():
        for at in np.ndindex(grad.shape):
            kept = model.w[k][at]
            ends = []
            for step in (1e-5, -1e-5):
                model.w[k][at] = kept + step
                ends.append(loss())
            model.w[k][at] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - grad[at]) < 1e-6


def test_classifier_scores_brute(spark, docs):
    """Scores of the query's operator are the model's on whole texts, one by one."""
    model = mil.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    got = {r.doc_id: r for r in mil.score(docs, model).collect()}
    for i, t in texts:
        x = (mil.passages((t or "").encode()) - model.mean) * model.scale
        want = float(model._forward(x, np.array([0]))[-1][0])
        assert got[i].score == pytest.approx(want, abs=2e-6) and got[i].predicted == (got[i].score >= 0.3)


def test_attention_learns():
    rng = np.random.default_rng(2)
    x, starts, y = rng.normal(size=(300, mil.WIDTH)).astype(np.float32), np.arange(0, 300, 3), rng.integers(0, 2, 100)
    x[starts[y == 1], 0] += 6
    model = mil.Attention().fit(x, starts, y)
    p = model._forward((x - model.mean) * model.scale, starts)[-1]
    assert ((p > 0.5) == y).mean() > 0.95


def test_language_model_brute(spark, docs):
    ids = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    good = {r.doc_id for r in ids.collect()}
    rows = [(r.doc_id, [w.encode() for w in words(r.text)]) for r in docs.collect()]
    n = Counter(w for _, t in rows for w in t)
    top = [w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:300]]
    vocabulary = {w: lm_diff.SHAPES + i for i, w in enumerate(top)}
    size = lm_diff.SHAPES + 301
    tokens = {i: [vocabulary.get(w, lm_diff.shape(w)) for w in t] for i, t in rows}
    def counts(ids_of):
        c, into, out = Counter(), Counter(), Counter()
        for i in ids_of:
            for a, b in zip([size - 1, *tokens[i]], tokens[i]):
                c[a, b] += 1
                into[b] += 1
                out[a] += 1
        return c, into, out

    whole = [(ids_of, *counts(ids_of)) for ids_of in (good, set(tokens))]
    for r in lm_diff.score(docs, ids, most=300).collect():
        own, losses = tokens[r.doc_id], []
        mine = counts([r.doc_id])
        for ids_of, *model in whole:
            # a document is left out of the models that score it
            c, into, out = (lambda x, m=m, o=o: m[x] - o[x] * (r.doc_id in ids_of) for m, o in zip(model, mine))  # noqa: B023
            total = sum(model[1].values()) - len(own) * (r.doc_id in ids_of) + lm_diff.ALPHA * size
            steps = [-np.log((c((a, b)) + lm_diff.MU * (into(b) + lm_diff.ALPHA) / total) / (out(a) + lm_diff.MU)) for a, b in zip([size - 1, *own], own)]
            losses.append(np.mean(steps) if own else 0.0)
        assert r.n_tokens == len(own)
        assert np.allclose([r.target_loss, r.background_loss, r.score], [*losses, losses[0] - losses[1]], atol=2e-5)


def test_language_model_reads_every_word(spark):
    common = " ".join(f"w{i}" for i in range(2500)) + " "
    rows = [(i, common * 2) for i in range(3)] + [(10 + i, "zorda zordb zordc zordd") for i in range(2)] + [(20, "zorde zordf zordg zordh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_diff.score(docs, docs.where("doc_id = 10").select("doc_id")).collect()}
    # words of the same shape, all rarer than 2500 others: only the words themselves tell 11 from 20
    assert got[11].target_loss < got[20].target_loss - 0.5
    tokens = {i: [None, *t.split()] for i, t in rows}
    size = 1 + len({w for t in tokens.values() for w in t[1:]})
    for name, ids in (("target_loss", [10]), ("background_loss", list(tokens))):
        for i, t in tokens.items():
            c, into, out = Counter(), Counter(), Counter()
            for j in set(ids) - {i}:
                for a, b in zip(tokens[j], tokens[j][1:]):
                    c[a, b], into[b], out[a] = c[a, b] + 1, into[b] + 1, out[a] + 1
            total = sum(into.values()) + lm_diff.ALPHA * size
            want = np.mean([-np.log((c[a, b] + lm_diff.MU * (into[b] + lm_diff.ALPHA) / total) / (out[a] + lm_diff.MU)) for a, b in zip(t, t[1:])])
            assert abs(got[i][name] - want) < 2e-6


def test_language_model_edges(odd, empty, docs):
    rows = lm_diff.score(odd, odd.select("doc_id")).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows if r.doc_id in (1, 2)} == {0.0}
    assert lm_diff.score(empty, odd.select("doc_id")).count() == 0
    assert max(lm_diff.shape(w) for w in (b"Abc", b"ABC", b"a-b" * 9, "éé-".encode() * 9, b"abcd." * 9)) < lm_diff.SHAPES


def reference_article(page):
    article = re.sub(r"</?b>|<br>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    import html

    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(p for p in parts if p)


def test_page_texts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = html_diff.extract(pages).collect()
    assert {r.page_id: r.text for r in rows} == {k: reference_article(v) for k, v in html.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_page_differencing():
    body = lambda x: f"<div>Home</div><div>Shop</div><p>{x} &amp; more</p><p>same words</p><div>All rights</div>"
    got = html_diff.main_texts([("/a/1", body("One")), ("/a/2", body("Two"))])
    assert got == ["One & more", "Two & more"]
    inside = lambda x: f"<div>Home</div><main><p>{x}</p><p>same</p><form>f</form></main>"
    assert html_diff.main_texts([("/a/1", inside("One")), ("/a/2", inside("Two"))]) == ["One\n\nsame", "Two\n\nsame"]
    assert html_diff.main_texts([("/a", body("One")), ("/a", body("One")), ("/b", None)])[2] == ""
    lines = html_diff.lines_of('<div class="cookie-notice">We</div><header>H</header><p>x <b>y</b>z<p>q &lt;5 < 6<div role="search"><p>hi</p></div><span hidden>no</span>')
    assert lines == [("We", html_diff.FREE, ("div.cookie-notice#",)), ("x yz", html_diff.FREE, ("p",)), ("q <5 < 6", html_diff.FREE, ("p",))]
    assert [x[0] for x in html_diff.lines_of("<p>one<p>two</p>three<div id=x>four<span hidden>zz</span> five</div><script>a<b</script>")] == ["one", "two", "three", "four five"]
    # no class name is out by itself
    story = lambda x: f'<div class="side-story"><p>{x} of a long story</p></div><div class="box">{x}</div>'
    assert html_diff.main_texts([(f"/{x}", story(x)) for x in ("one", "two", "six")]) == ["one of a long story", "two of a long story", "six of a long story"]


def test_differencing_beside_an_article():
    page = lambda x: f"<div>Home</div><div><p>Text of {x}</p></div><article><p>Teaser {x}</p></article><div>All rights</div>"
    assert html_diff.main_texts([("/a/1", page("one")), ("/a/2", page("two"))]) == ["Text of one\n\nTeaser one", "Text of two\n\nTeaser two"]


def test_near_copies_keep_their_article():
    page = lambda i, x: f"<div class=top>Home {i}</div><div class=text><p>{x} first line {'of it ' * 20}</p><p>{x} second line of it</p></div><div class=end>All rights</div>"
    pages = [(f"/{i}", page(i, x)) for i, x in enumerate(("a", "a", "a", "b", "c"))]
    assert html_diff.main_texts(pages) == [f"{x} first line {'of it ' * 20}".strip() + f"\n\n{x} second line of it" for x in "aaabc"]


def brute_text(runs, at, path):
    """Main text of a page of the run of pages runs[at], by the rules, with a table for each alignment; (host, first path, last path, html)."""
    near, small = html_diff.NEAR, html_diff.SMALL
    lines = {i: html_diff.lines_of(runs[i][3] or "") for i in range(max(0, at - near), min(len(runs), at + near + 1))}

    def openings(x):
        """Texts, and before each the elements that it opens; -1 - the line for these."""
        out, last = [], None
        for n, (t, _, p) in enumerate(x):
            for d in range(1, len(p) + 1):
                if (last or ())[:d] != p[:d] or (d == len(p) and last == p):
                    out.append(("<", p[:d], -1))
            out.append((">" + t, p, n))
            last = p
        return out

    def lcs(a, b):
        whole = a, b = openings(a), openings(b)
        a, b = ([x[:2] for x in side] for side in whole)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        one, two, i, j = set(), set(), len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                one.add(i - 1)
                two.add(j - 1)
                i, j = i - 1, j - 1
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return *({side[k][2] for k in own if side[k][2] >= 0} for own, side in zip((one, two), whole, strict=True)), {whole[0][k][1] for k in one if whole[0][k][2] < 0}

    mine = lines[at]
    host = [i for i in lines if i != at and runs[i][0] == runs[at][0]]
    others = host if len(host) > 1 else [i for i in lines if i != at]
    pairs = {i: lcs(mine, lines[i]) for i in lines if i != at}
    often = Counter(n for i in others for n in pairs[i][0])
    cut, node = set(), ()
    while True:
        volume, places, deep = Counter(), {}, set()
        for i in (at, *others):
            for n, (t, _, p) in enumerate(lines[i]):
                if p[: len(node)] == node:
                    child = (*p, "")[: len(node) + 1]
                    own = n not in pairs[i][1] if i != at else 2 * often[n] < max(1, len(others))
                    volume[child] += len(t) * own
                    places.setdefault((i, child), []).append(n)
                    deep |= {child} if len(p) > len(node) + 1 else set()
        if not volume:
            break
        best = max(volume, key=lambda c: (volume[c], c))
        beside = lambda i, c: (i, c) in places and ((i, best) not in places or max(places[i, c]) < min(places[i, best]) or min(places[i, c]) > max(places[i, best]))  # noqa: E731, B023
        for c in {c for i, c in places if i == at} - {best}:
            votes = sum(c in pairs[i][2] for i in others)
            if c[-1] not in ("h1", "h2", "h3", "h4", "h5", "h6") and volume[c] <= small * volume[best] and beside(at, c) and votes and 2 * votes >= len(others):
                cut.add(c)
        node = best
        if best not in deep or {k for _, k, p in mine if p[: len(best)] == best} == {html_diff.BODY}:
            break
    held = {n for n, (_, _, p) in enumerate(mine) if (*p, "")[: len(node)] == node or (p[:-1] == node[:-1] and p and p[-1] in ("h1", "h2", "h3", "h4", "h5", "h6"))}
    size = lambda which: sum(len(mine[n][0]) for n in which)
    rivals = [(-html_diff.common_prefix(path, runs[i][2] if i < at else runs[i][1]), abs(i - at), i) for i in host if not held or size(held & pairs[i][0]) < html_diff.COPY * size(held)]
    gone = pairs[min(rivals)[2]][0] - held if rivals else set()
    gone |= {n for n in held if rivals and sum(n in pairs[i][0] for *_, i in rivals) >= html_diff.TEMPLATE * len(rivals)}
    return "\n\n".join(t for n, (t, k, p) in enumerate(mine) if k == html_diff.BODY or not (n in gone or any((*p, "")[:d] in cut for d in range(1, len(p) + 2))))


def test_differencing_brute(spark):
    rng = random.Random(4)
    page = lambda i: f"<div>Home</div><div class=m{i % 2}>Menu {i % 3}</div><p>own {i} and more words of it {i}</p><div>{rng.choice('ab')}</div><div class=ad>buy {i}</div>"
    # folders of one page, one path with many queries, runs of equal pages, hosts of one page, null urls
    rows = [(i, f"http://h.a/2024/{i % 12:02}/{i}/title", page(i)) for i in range(60)] + [(100 + i, f"http://h.a/index.php?id={i}", page(i)) for i in range(60)]
    rows += [(200 + i, f"http://h.b/x/{i:03}", page(7) if 10 < i < 40 else page(i)) for i in range(60)] + [(300 + i, None, page(i)) for i in range(30)]
    copy = page(5)
    rows += [(400 + i, f"http://h.c/{i:03}", copy if 2 < i < 40 else page(i)) for i in range(43)] + [(500 + i, f"http://h{i}.d/x", page(i)) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda u: ("", "") if u is None else ((u + "/").split("/")[2], u[len("http://" + u.split("/")[2]) :])
    ordered = sorted((*key(u), i, h) for i, u, h in rows)
    runs, of = [], []
    for host, path, _, h in ordered:
        if not runs or (runs[-1][0], runs[-1][3]) != (host, h):
            runs.append([host, path, path, h])
        runs[-1][2] = path
        of.append(len(runs) - 1)
    want = {i: brute_text(runs, at, path) for (_, path, i, _), at in zip(ordered, of, strict=True)}
    assert any("own" in t for t in want.values()) and not any("buy" in want[i] for i in range(60))
    for block in (4, 30, 256):
        assert {r.page_id: r.text for r in html_diff.extract(pages, block).collect()} == want


def test_differencing_does_the_work(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: reference_article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_diff.extract(pages).collect()}
    assert got == want
    # no page alone has its text right, and without any guard of the markup most pages still do
    assert not any(html_diff.main_texts([("", r.html)])[0] == want[r.page_id] for r in pages.limit(50).collect())
    bare = pages.withColumn("html", F.regexp_replace("html", "article>", "div>"))
    free = {r.page_id: r.text for r in html_diff.extract(bare, guard=False).collect()}
    assert sum(free[i] == want[i] for i in want) >= 0.99 * len(want)
    # with alignments that find nothing, no page has its text
    rows = sorted((r.url, r.html, r.page_id) for r in pages.collect())
    monkeypatch.setattr(html_diff.Page, "with_", lambda self, other: (set(), set(), set()))
    without = html_diff.main_texts([(u, h) for u, h, _ in rows])
    assert sum(t == want[i] for t, (*_, i) in zip(without, rows, strict=True)) <= 0.05 * len(want)


def test_common_subsequence_brute():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        for bits in (1 << 27, 8):
            html_diff.TABLE_BITS, whole = bits, html_diff.TABLE_BITS
            one, two = (sorted(x) for x in html_diff.shared(a, b))
            html_diff.TABLE_BITS = whole
            assert len(one) == table[-1][-1] and [a[i] for i in one] == [b[j] for j in two]


PAGES = [(1, "http://a.b/x", "<p>hi</p>"), (2, None, "<p>hi</p>"), (3, "http://a.b/y", None), (4, "http://a.b/z", ""), (5, "u\r\nv", "é" * 5000 + "\r\n\r\nWARC/1.1\r\n\r\n"), (5, "u\r\nv", "é" * 5000 + "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "<p>hi</p>"), (None, "n", "z" * 3000), (6, "big", "é" * 5000 + "\r\n\r\nWARC/1.1\r\n\r\n")]


def test_warc_edges(spark):
    import base64

    pages = spark.createDataFrame([(*p, "k", 1) for p in PAGES], "page_id long, url string, html string, digest string, n long")
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        ids = [p for p, _, x in PAGES if (x or "") == (h or "") and p is not None]
        first = min(ids, default=None)
        again = first is not None and i != first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    for chunk, rows in ((32 * 1024, 4096), (1000, 3)):
        found = [tuple(r) for r in warc.round_trip(pages, chunk, rows).collect()]
        assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.chunk_table(warc.with_types(pages), 1000).agg(F.max(F.octet_length("data"))).first()[0] == 1000


def test_warc_finds_changed_payloads(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/", "<p>first</p>"), (2, "http://b/", "x" * 900 + "y")], "page_id long, url string, html string")
    warc.write(warc.chunk_table(warc.with_types(pages), 400), str(tmp_path / "good"))
    assert warc.summaries(warc.read(spark, str(tmp_path / "good"))).count() == 2
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "good").glob("*.gz")))
    for n, (old, new) in enumerate(((b"first", b"fIrst"), (b"xy", b"xz"))):
        (tmp_path / f"bad{n}").mkdir()
        (tmp_path / f"bad{n}" / "a.gz").write_bytes(gzip.compress(raw.replace(old, new)))
        with pytest.raises(Exception, match="digest says"):
            warc.summaries(warc.read(spark, str(tmp_path / f"bad{n}"))).collect()


def test_page_edges(spark):
    pages = spark.createDataFrame([(*p, "k", 1) for p in PAGES], "page_id long, url string, html string, path string, block long")
    rows = html_diff.extract(pages).collect()
    assert len(rows) == len(PAGES) and all(r.text == "" for r in rows if r.page_id in (3, 4)) and html_diff.extract(pages.limit(0)).count() == 0


def test_word_split_is_the_contract():
    for text in ("a\x1cb\x85c d　e f\x0bg\x0ch\ri\n\tj", "", " \t", " x"):
        assert text.encode().split() == [w.encode() for w in words(text)]
    assert common.shingle_hashes(np.zeros(0, np.uint64), 3).size == 0
