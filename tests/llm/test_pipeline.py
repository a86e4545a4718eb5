from collections import Counter

import pytest

pytest.importorskip("kindred.llm")
import corpus_pipeline
from kindred.llm import contain, pii
from tests_llm_support import brute_components, brute_quality, brute_targets, words

SF = "/root/testdata/sf0.001"


def test_pipeline_brute(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [contain.shingles_of(r.text.encode(), 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: r for i, r in rows.items() if brute_quality(r.text)}
    roots = brute_components([(i, r.text) for i, r in kept.items()], 5, 80)
    kept = {i: r for i, r in kept.items() if roots[i][1] == i}
    kept = {i: r for i, r in kept.items() if not any(len(s & contain.shingles_of(r.text.encode(), 5)) >= 0.8 * len(s) for s in items)}
    field = pii.train(pii.labelled_rows())
    texts = {i: pii.redacted(r.text, pii.find_all([r.text], field)[0][1]) for i, r in kept.items()}
    sizes = Counter()
    for i, r in kept.items():
        sizes[r.source] += len(words(texts[i]))
    sources = sorted(sizes)
    goals = brute_targets(sizes, {s: (5.0, 2.0, 1.0)[n % 3] for n, s in enumerate(sources)})
    import hashlib
    import math

    want = Counter()
    at = Counter()
    for i, r in sorted(kept.items(), key=lambda x: hashlib.md5(f"{x[0]}:0".encode()).hexdigest()):
        n = len(words(texts[i]))
        if n:
            want[i] = max(0, min(2, math.ceil((goals[r.source] - at[r.source] - n / 2) / sizes[r.source])))
        at[r.source] += n
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in found) == +want
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in found)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "decontamination", "pii_redaction", "curriculum_mix"]


def test_pipeline_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (None, "the cat and the dog " * 3, "en", None, 9), (2, "", "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for n, part in enumerate((rows, [])):
        folder = tmp_path / str(n)
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "a b c d e")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(folder))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.run(spark, str(folder)).count() == 0
