"""The pipeline against its stages by plain loops, and the registered queries."""

import re
from pathlib import Path

import __spark_entry__ as contract
import corpus_pipeline
import numpy as np
import public_tokenizers
from brute import PATTERNS, groups, statistics, valid

from taxweave.llm import grams, outliers, pii, queries

SF_DIR = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "best_fit_packing"]
    assert {"pipeline", *queries.QUERIES} <= contract.queries().keys()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in outliers.keep(docs).collect()}
    failed = {i for i, *_, f in statistics(left) if f}
    assert not kept & failed and len(kept) > 0.75 * (len(left) - len(failed))
    steps = [[r for r in left if r[0] in kept]]
    steps.append([r for r, (i, _, c) in zip(steps[-1], groups(steps[-1])) if i == c])
    bare = lambda t: " " + " ".join(w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w) + " "
    steps.append([(i, t) for i, t in steps[-1] if not any(bare(x) in bare(t) for x in items)])
    # Base matches by the plain patterns, and the spans that the operator adds.
    found = {r.row.doc_id: r.spans for r in pii.spans(spark.createDataFrame(steps[-1], "doc_id long, text string"), ["doc_id"]).collect()}
    hidden = []
    for i, t in steps[-1]:
        base = {(m.start(), -m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])}
        every = {(s.start, -s.end, pii.KINDS[s.kind]) for s in found[i]}
        assert base == {(s.start, -s.end, pii.KINDS[s.kind]) for s in found[i] if s.base}
        spans = sorted(every, key=lambda s: (s[0], s[1], pii.KINDS.index(s[2])))
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [t[at:a], f"[{k.upper()}]"]
            at = max(at, -b)
        hidden.append((i, "".join(out) + t[at:]))
    steps.append(hidden)
    now = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES, steps):
        result = stage(spark, now, SF_DIR)
        assert result.columns == docs.columns
        result.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(expected), name
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in hidden}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {i: sum(r.length for r in rows if r.doc_id == i) for i in lengths} == lengths
    assert len({r.sequence_id for r in rows}) <= -(-sum(lengths.values()) // 2048) + 1


def test_bare_words_are_cut_at_marks():
    import pyarrow as pa

    found = [grams.hashed_words(*grams.buffer(pa.array([t])), grams.BARE).hash for t in ("It's (A) test-case.", "it s a TEST case")]
    assert np.array_equal(*found)


#: Queries that SQL can't express, and the tests that hold them against plain loops, the libraries or held-out rows.
WITHOUT_SQL = {
    "op1_katz_backoff": "test_katz",
    "op3_toxic_clauses": "test_toxicity_on_held_out_rows",
    "op5_page_wrappers": "test_articles_of_the_tables",
    "op6_weak_supervision": "test_personal_data",
    "op7_string_tiling": "test_reordered_items_are_caught",
    "op8_robust_outliers": "test_outliers_like_numpy",
    "op9_best_fit_packing": "test_packing",
    "op10_token_files": "test_token_files",
    "op11_prefix_trie": "test_query_of_encoding",
    "op12_lockstep_alignment": "test_aligned_table",
}


def test_every_query_has_sql_or_a_plain_version():
    tests = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    without = {name for name, (_, statement) in queries.QUERIES.items() if not statement}
    assert without == WITHOUT_SQL.keys()
    assert all(f"def {test}(" in tests for test in WITHOUT_SQL.values())
