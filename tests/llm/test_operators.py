"""Each operator against plain loops, on odd rows and on an empty table."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import groups, katz, personal, shingles, statistics, without_repeats
from pyspark.sql import functions as F

from taxweave.llm import common, graph, grams, jaccard, outliers, packing, passages, pii, tiling, token_files, tokens, toxicity
from taxweave.llm import katz as model
from taxweave.session import fresh_folder

SF_DIR = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def listed(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(odd, plain, order):
    train = ~common.in_class(F.col("doc_id"), 7, 2)
    got = sorted([tuple(r) for r in model.score(odd, train, order, block_bytes=20_000).collect()], key=repr)
    expected, sums = katz(plain, order)
    assert sums == pytest.approx([1.0] * len(sums))
    key = lambda r: (repr(r[:5]), round(r[5], 3))
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_good_turing_stays_on_with_uneven_counts(spark):
    of = [206_000, 60_000, 25_000, 14_300, 13_500, 7_100, *[int(100_000 * r**-1.9) for r in range(7, model.FIT + 1)]]  # like sf0.1: d of 4 is over 1
    found = model._discounts([370_000, 3_400_000, *of])
    assert found[0] == 0 and all(0 < a < b < 1 for a, b in zip(found[1:], found[2:]))
    assert all(abs(d - (1 - 0.5 / r)) > 0.01 for r, d in enumerate(found[1:3], 1))
    number = {1: 3000, 2: 700, 3: 300, 4: 180, 5: 250, 6: 110}
    words = {c: [f"w{c}x{k}" for k in range(n)] for c, n in number.items()}
    trained = " ".join(w for c, ws in words.items() for w in ws for _ in range(c))
    docs = spark.createDataFrame([(0, trained), (9, ""), (10, "never")] + [(c, ws[0]) for c, ws in words.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in model.score(docs, F.col("doc_id") == 0, 1).collect()}
    chance = {c: 10 ** (got[c].score - got[9].score) for c in [*number, 10]}
    discounts = {c: chance[c] * got[0].train_tokens / c for c in range(1, model.K + 1)}
    assert all(0 < discounts[c] < discounts[c + 1] < 1 for c in range(1, model.K)) and discounts[1] != pytest.approx(0.5, abs=0.01)
    assert sum(chance[c] * n for c, n in number.items()) + 10 ** got[9].score + chance[10] == pytest.approx(1)


def test_katz_without_rows_or_training(empty, odd):
    assert model.score(empty, F.lit(True)).collect() == []
    row = model.score(odd.filter("text = 'one'").limit(1), F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (2, 0, 0, 0.0)


@pytest.mark.parametrize("local", [jaccard.LOCAL_SHINGLES, 300])
def test_near_duplicates(odd, plain, local):
    got = listed(jaccard.near_duplicates(odd, local), "doc_id", "n_shingles", "component_id")
    assert got == sorted(groups(plain), key=repr)


def test_one_of_each_group_stays(odd, plain):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    expected = {c for i, _, c in groups(plain) if i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(expected)
    assert ids.count(None) == 2


def test_no_near_duplicates(empty):
    assert jaccard.near_duplicates(empty).collect() == []


def test_regions_lose_no_link():
    pick = np.random.default_rng(3)
    base = [pick.integers(0, 1 << 60, 120, dtype=np.uint64) for _ in range(4)]
    sets = []
    for k in range(160):  # chains: each one is near the one before, and far from the first
        old = sets[-4] if k >= 4 else base[k]
        new = old.copy()
        new[pick.integers(0, 120, pick.integers(1, 16))] = pick.integers(0, 1 << 60, 1, dtype=np.uint64)
        sets.append(new)
    sets = [np.unique(s) for s in sets]

    def parts(links):
        up = list(range(len(sets)))
        for a, b in links:
            a, b = (next(iter(_root(up, x))) for x in (a, b))
            up[max(a, b)] = min(a, b)
        return [next(iter(_root(up, x))) for x in range(len(sets))]

    every = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard.linked(jaccard.common(sets[a], sets[b]), len(sets[a]), len(sets[b]))]
    assert parts(jaccard.join_region(sets)) == parts(every)


def _root(up, x):
    while up[x] != x:
        x = up[x]
    yield x


def test_regions_of_many_unlinked_documents_end():
    pick = np.random.default_rng(5)
    template = pick.integers(0, 1 << 60, 17, dtype=np.uint64)
    sets = [np.unique(np.concatenate([template, pick.integers(0, 1 << 60, 3, dtype=np.uint64)])) for _ in range(20_000)]  # J = 17 / 23
    near = [np.unique(np.concatenate([s[1:], pick.integers(0, 1 << 60, 1, dtype=np.uint64)])) for s in sets[:40]]  # J = 19 / 21
    links = jaccard.join_region(sets + near)
    assert sorted((min(x), max(x)) for x in links) == [(k, 20_000 + k) for k in range(40)]


def test_prefixes_lose_no_link():
    pick = np.random.default_rng(9)
    template = pick.integers(0, 1 << 60, 30, dtype=np.uint64)
    sets = [np.unique(np.concatenate([template[: pick.integers(20, 31)], pick.integers(0, 12, pick.integers(1, 8)).astype(np.uint64)])) for _ in range(400)]
    sets += [np.unique(pick.integers(0, 40, pick.integers(6, 30)).astype(np.uint64)) for _ in range(200)]

    def parts(links):
        found = jaccard._Parts(len(sets))
        for a, b in links:
            found.join(a, b)
        return [found.find(k) for k in range(len(sets))]

    every = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard.linked(jaccard.common(sets[a], sets[b]), len(sets[a]), len(sets[b]))]
    assert parts(jaccard.join_region(sets)) == parts(every)


def test_components(spark):
    links = [(k + 1, k) for k in range(40)] + [(100 + k, 99) for k in range(1, 30)] + [(7, 7)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {99: 99} | {100 + k: 99 for k in range(1, 30)}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id")
    held_out = common.in_class(F.col("doc_id"), 5, 0)
    found = toxicity.learn(docs, labels.filter(~held_out), 300)
    scored = toxicity.score(rows.filter(held_out), found).select("toxic", "score").collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in scored]) > 0.95


def test_grammar_weighs_clauses():
    reader = toxicity.Reader({"idiot": 4.0})
    one = lambda t: reader.features(t)[0]
    assert one("you idiot.") > one("that idiot.") > one("that is not an idiot.") > one("he wrote that it is not an idiot.") > one("nothing here.") == 0
    assert one("I kill you.") > 0 == one("I kill time.")
    assert reader.features("") == (0.0, 0.0, 0.0, 0.0)


def test_toxicity_without_labels(odd, empty):
    found = toxicity.learn(empty, odd.limit(0).select("doc_id", F.lit(1).alias("toxic")))
    scored = toxicity.score(odd, found, "toxicity")
    assert scored.columns == [*odd.columns, "toxicity"]
    assert {round(r.toxicity, 6) for r in scored.select("toxicity").collect()} == {0.1}
    assert toxicity.score(empty, found, "toxicity").count() == 0


@pytest.mark.parametrize("block_bytes", [passages.BLOCK_BYTES, 9000])
def test_repeated_passages(odd, plain, empty, block_bytes, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_BYTES", block_bytes)
    got = listed(passages.remove_recurring(odd), "doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert got == sorted(without_repeats(plain), key=repr)
    assert passages.remove_recurring(empty).collect() == []


def test_personal_data(odd, plain, empty):
    found = pii.spans(odd, ["doc_id"]).withColumn("base", F.filter("spans", lambda s: s["base"]))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    counts = [of_kind(k) for k in range(4)]
    assert listed(found, "row.doc_id", *counts, F.sha2(pii.written(F.col("base")), 256)) == sorted(personal(plain), key=repr)
    assert pii.spans(empty).collect() == []


def test_redaction(spark, odd, empty):
    texts = ["mail a@b.cd or +1 (743) 555-3824!", None, "", "é 1.2.3.4"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, row string")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["mail [EMAIL] or [PHONE]!", None, "", "é [IP]"]
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    assert pii.redact(empty).count() == 0


def test_labelers_are_weighed():
    """Expectation-maximisation over counted vote patterns equals the same over single rows, by plain loops."""
    patterns = [(0, 1, 1, 1, 1, 1, 80), (0, -1, 0, 0, -1, -1, 15), (0, 1, 0, 0, 1, 1, 40), (0, -1, 0, 1, 1, -1, 3), (2, 1, -1, 0, 1, 1, 7), (2, -1, -1, 0, 0, 1, 30)]
    found = pii.estimate(patterns)
    assert found.keys() == {0, 2}
    for kind, (prior, chance) in found.items():
        rows = [p[1:-1] for p in patterns if p[0] == kind for _ in range(p[-1])]
        p, by = 0.5, [[{v: pii.FIRST[v] for v in (1, 0, -1)}, {v: pii.FIRST[-v] for v in (1, 0, -1)}] for _ in pii.LABELERS]
        for _ in range(pii.EM_STEPS):
            truth = []
            for votes in rows:
                yes, no = p, 1 - p
                for k, v in enumerate(votes):
                    yes, no = yes * by[k][0][v], no * by[k][1][v]
                truth.append(yes / (yes + no))
            p = (sum(truth) + 1) / (len(rows) + 2)
            for k in range(len(by)):
                for side, weight in ((0, truth), (1, [1 - t for t in truth])):
                    first = {v: pii.FIRST[v if side == 0 else -v] for v in (1, 0, -1)}
                    by[k][side] = {v: (sum(w for w, r in zip(weight, rows) if r[k] == v) + 10 * first[v]) / (sum(weight) + 10) for v in (1, 0, -1)}
        assert prior == pytest.approx(p)
        assert all(chance[k][side][v] == pytest.approx(by[k][not side][v]) for k in range(len(by)) for side in (True, False) for v in (1, 0, -1))


def test_the_classifier_learns_what_the_labelers_mean():
    b, w = pii.train([(5, 3, 0, 0, 0, 1, 1, 50, 0.95), (0, 0, 0, 0, 0, 1, 1, 50, 0.05), (5, 3, 2, 0, 0, 0, 1, 5, 0.2)])
    z = lambda *f: b + sum(x[k] for x, k in zip(w, f))
    assert z(5, 3, 0, 0, 0, 1, 1) > 0 > z(0, 0, 0, 0, 0, 1, 1) and z(5, 3, 2, 0, 0, 0, 1) < z(5, 3, 0, 0, 0, 1, 1)


#: Marked by hand: what is personal data beyond the base patterns, and texts that hold none.
MARKED = [
    ("reach me: jane.doe (at) mail (dot) com please", [("email", "jane.doe (at) mail (dot) com")]),
    ("joe[at]site.org wrote today", [("email", "joe[at]site.org")]),
    ("write to ann.lee {at} post {dot} fr soon", [("email", "ann.lee {at} post {dot} fr")]),
    ("tel. 0171 5553824 ab morgen", [("phone", "0171 5553824")]),
    ("call 743-555-3824 now", [("phone", "743-555-3824")]),
    ("my mobile (212) 555-0199 rings", [("phone", "(212) 555-0199")]),
    ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", [("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]),
    ("seen from fe80::1ff:fe23:4567:890a again", [("ip", "fe80::1ff:fe23:4567:890a")]),
    ("IBAN DE89 3704 0044 0532 0130 00 bitte", [("card", "DE89 3704 0044 0532 0130 00")]),
    ("card 4716 1234 8765 1093 was refused", [("card", "4716 1234 8765 1093")]),
    ("she paid by visa 5105-1728-4491-0367 then", [("card", "5105-1728-4491-0367")]),
    ("version 1.2.3 of 2020-10-11 at 12:30:45", []), ("order 1234 5678 with 90 parts", []), ("between 1990-2000 and 2001 it rose 3.14 %", []),
    ("look at the site map", []), ("ratio 16:9 or 4:3", []), ("call 911 or 112", []), ("the years 1998 1999 2000 2001", []), ("aa:bb is a pair", []), ("§ 12 34", []),
]


def test_spans_beyond_the_base_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    marked = spark.createDataFrame([(10**7 + k, t) for k, (t, _) in enumerate(MARKED)], "doc_id long, text string")
    found = {r.row.doc_id: r for r in pii.spans(docs.union(marked), ["doc_id", "text"]).collect()}
    got = {(k, pii.KINDS[s.kind], found[10**7 + k].row.text[s.start : s.end]) for k in range(len(MARKED)) for s in found[10**7 + k].spans if not s.base}
    wanted = {(k, *x) for k, (_, spans) in enumerate(MARKED) for x in spans}
    assert len(got & wanted) >= 0.8 * len(wanted) and len(got & wanted) >= 0.75 * len(got)
    assert len({g for g in got if not MARKED[g[0]][1]}) <= 1  # four years in a row look like a card
    added = [s for i, r in found.items() if i < 10**7 for s in r.spans if not s.base]
    assert 5 <= len(added) <= 60


def test_tiles():
    text, item = np.array([9, 1, 2, 3, 4, 5, 6, 8, 7, 7, 7, 7, 7, 1, 2], np.uint64), np.array([7, 7, 7, 7, 7, 0, 1, 2, 3, 4, 5, 6], np.uint64)
    assert tiling.tile(text, item) == [(6, 1, 6), (0, 8, 5)]
    assert tiling.tile(text[:4], item) == tiling.tile(text, item[:0]) == []


def test_reordered_items_are_caught(spark, odd, empty, monkeypatch):
    item = [f"q{k}" for k in range(40)]
    text = lambda ws: "before " + " ".join(ws) + " after"
    texts = [text(item), text(item[20:] + ["and", "so"] + item[:20]).upper(), text(item[:18]), text(item[::-1]), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd.select("doc_id", "text"))
    items = spark.createDataFrame([(5, " ".join(item) + "?"), (6, None), (7, "two words"), (8, "")], "item_id long, text string")
    for chars in (tiling.ITEM_CHARS, 40):
        monkeypatch.setattr(tiling, "ITEM_CHARS", chars)
        assert listed(tiling.leaks(docs, items), "doc_id", "item_id", "marked", "tiles") == [(0, 5, 40, 1), (1, 5, 40, 2)]
    assert tiling.decontaminate(odd, items).count() == odd.count() and tiling.decontaminate(odd, items).columns == odd.columns
    assert tiling.leaks(empty, items).collect() == [] == tiling.leaks(docs, items.limit(0)).collect()


def test_text_statistics(odd, plain, empty):
    found = outliers.assess(odd, ["doc_id"])
    columns = ["row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert listed(found, *columns) == sorted(statistics(plain), key=repr)
    assert found.filter("kept and base_failed").count() == 0
    assert outliers.assess(empty).collect() == []


def test_outliers_like_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("lang", F.lit("l")).withColumn("source", F.lit("s"))
    rows = [r for r in outliers.assess(docs, ["doc_id"]).collect() if not r.base_failed]
    x = np.array([[np.log1p(r.n_words), np.log(r.word_chars / r.n_words), np.log1p(100 * r.n_symbols / r.word_chars),
                   np.log1p(10 * r.n_dup_lines / r.n_lines), np.log1p(10 * r.n_repeat_words / r.n_words)] for r in rows])
    part, target = outliers.SHRINK, np.diag(x.var(axis=0))
    lower = lambda v, q: np.sort(v, axis=0)[int(np.ceil(q * len(v))) - 1]
    center = lower(x, 0.5)
    cov = (1 - part) * np.diag((1.4826 * lower(np.abs(x - center), 0.5)) ** 2) + part * target
    for _ in range(outliers.STEPS):
        d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
        near = x[d <= lower(d, outliers.KEPT_SHARE)]
        center, cov = near.mean(axis=0), (1 - part) * outliers.CONSISTENCY * np.cov(near.T, bias=True) + part * target
    d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
    assert np.allclose([r.d2 for r in rows], d, rtol=0.02, atol=0.02)
    assert np.mean([r.kept == (v <= outliers.CUTOFFS[5]) for r, v in zip(rows, d)]) > 0.995
    assert 0 < sum(not r.kept for r in rows) < 0.15 * len(rows)


def test_repeated_lines_are_outliers_where_none_repeat(spark):
    """The spread of a statistic that is the same all over a source comes from its language; one that never varies doesn't count."""
    pick = np.random.default_rng(5)
    prose = lambda n: "\n".join(" ".join(f"w{k}" for k in pick.integers(0, 5000, 12)) for _ in range(n))
    rows = [(k, prose(int(pick.integers(10, 40))), "aa", f"s{k % 3}") for k in range(300)]
    rows += [(1001 + k, "\n".join(f"{a} {b}" for a, b in zip(prose(12).split("\n"), ["#$%|<>*&" * 4] * 12)), "aa", "s1") for k in range(3)]
    lines = prose(10).split("\n")
    rows += [(1010, "\n".join(lines + [" ".join(reversed(x.split())) for x in lines[:1]] + ["a b c"] * 8), "aa", "s2")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in outliers.keep(frame).collect()}
    assert not kept & {1001, 1002, 1003, 1010}
    assert len(kept & set(range(300))) >= 299


def test_token_ids_are_the_library_s():
    from tokenizers import Tokenizer

    odd = ["a  b", "  x", " ", "", "\n foo\n\nbar  ", "é  x 's", "don't  stop\t\tnow ", "it's<|endoftext|> x", "Á B", "ab b., c's. 's. I'll, x²! 12. 1a. ...", "a  b ́ a", "ſtraße İx ΑΣ ", "x\n\ny\nZ z.\nNext"]
    for path in (WORD, BYTE):
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        for text in odd:
            assert np.frombuffer(tokens.Encoder(path).encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def expected_ids(rows, path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return [(i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in rows]


def test_token_files(spark, odd, plain, empty):
    folder = fresh_folder(spark, "tokens")
    token_files.write(odd, folder, BYTE)
    got = listed(token_files.read(spark, folder), "doc_id", "n_tokens", F.crc32("ids"))
    ids = expected_ids(plain, BYTE)
    assert got == sorted([(i, len(x), zlib.crc32(x.tobytes())) for i, x in ids], key=repr)
    at = 0
    for row in sorted(token_files.read(spark, folder).drop("ids").collect(), key=lambda r: r.start):
        assert row.start == at
        at += row.n_tokens
    known = {i: x for i, x in ids if i is not None and i < 60}
    row = token_files.read_document(spark, folder, 17).first()
    assert bytes(row.ids) == known[17].tobytes()
    assert token_files.read_document(spark, folder, 99_999).collect() == []
    folder = fresh_folder(spark, "tokens")
    token_files.write(empty, folder, BYTE)
    assert token_files.read(spark, folder).collect() == []


def test_packing(odd, plain, empty):
    pieces = packing.cut(odd, WORD)
    placed = packing.place(pieces).cache()
    expected = [(i, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(x[k : k + 2048].tobytes())) for i, x in expected_ids(plain, WORD) for k in range(0, len(x), 2048)]
    assert listed(placed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(expected, key=repr)
    by = defaultdict(list)
    for r in placed.collect():
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    some = packing.sequences(pieces.filter("doc_id < 60"), placed.filter("doc_id < 60"))
    assert all(len(r.ids) <= 4 * 2048 for r in some.collect())
    assert packing.place(packing.cut(empty, WORD)).collect() == []


def test_exact_complements_come_first():
    plan = packing.Plan({6: 3, 4: 3, 5: 2, 2: 1, 3: 1, 7: 1, 1: 4, 8: 1}, capacity=10)
    used = defaultdict(int)
    for lengths, times in plan.patterns:
        assert sum(lengths) <= 10
        for n in lengths:
            used[n] += times
    assert used == {6: 3, 4: 3, 5: 2, 2: 1, 3: 1, 7: 1, 1: 4, 8: 1}
    assert sum(t for _, t in plan.patterns) == 7


def test_hashes_follow_words():
    import pyarrow as pa

    texts = [None, "", "a b a", "x\ny  z", "é è", "long" * 30, "a b"]
    data, offsets = grams.buffer(pa.array(texts, pa.string()))
    expected = [(k, w) for k, t in enumerate(texts) for w in (t or "").encode().split()]
    for segment in (1 << 21, 37):
        grams.SEGMENT = segment
        found = grams.hashed_words(data, offsets)
        assert [(int(d), data[a:b].tobytes()) for d, a, b in zip(found.doc, found.start, found.end)] == expected
        names = dict(zip((w for _, w in expected), found.hash.tolist()))
        assert [names[w] for _, w in expected] == found.hash.tolist() and len(set(names.values())) == len(names)
    grams.SEGMENT = 1 << 21
    assert shingles("A b") == {(b"a", b"b")}


@pytest.mark.parametrize("operator", ["katz", "passages"])
def test_no_id_decides_a_block(spark, operator, monkeypatch):
    """With a third of the rows without id, and a third of one id, no block is much larger than the others."""
    texts = [f"{k} words of document {k * 7} and no more" for k in range(3000)]
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {}
    module = {"katz": model, "passages": passages}[operator]
    size = sum(map(len, texts))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-size // 9000)))
    sizes = sorted(r["count"] for r in docs.groupBy(block).count().collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    if operator == "katz":
        assert model.score(docs, F.col("doc_id").isNull(), 2, block_bytes=9000).count() == 3000
    else:
        monkeypatch.setattr(module, "BLOCK_BYTES", 9000)
        assert passages.remove_recurring(docs).count() == 3000


def test_one_labelled_id_with_many_rows_is_one_text(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    one = labels.select("doc_id").join(docs, "doc_id").limit(1)
    seen, lexicon = [], toxicity._lexicon
    monkeypatch.setattr(toxicity, "_lexicon", lambda toxic, clean, n, m: seen.append((n, m)) or lexicon(toxic, clean, n, m))
    plain, repeated = toxicity.learn(docs, labels), toxicity.learn(docs.union(one.crossJoin(spark.range(500)).select("doc_id", "text")), labels)
    assert seen[0] == seen[1] and plain.weights == pytest.approx(repeated.weights)


def test_token_files_of_one_id(spark):
    """Rows of one id, or of none, are dealt over the files."""
    rows = [(None if k % 3 == 0 else 7, f"some words of text {k}") for k in range(900)]
    folder = fresh_folder(spark, "tokens")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, BYTE)
    parts = {r.part: r.n for r in spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    assert len(parts) >= 3 and max(parts.values()) < 0.6 * sum(parts.values())
    read = token_files.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in read] == [None] * 300 + [7] * 600
    assert [r.start for r in read] == [0, *np.cumsum([r.n_tokens for r in read])[:-1].tolist()]


def test_phrases_that_both_repeat(monkeypatch):
    """Seeds by shift are the seeds by pairs, and a word repeated thousands of times takes no memory for all pairs."""
    pick = np.random.default_rng(8)
    cases = [(pick.integers(0, 3, n).astype(np.uint64), pick.integers(0, 3, m).astype(np.uint64)) for n, m in ((200, 60), (60, 200), (9, 4), (300, 300))]
    by_pairs = [tiling.tile(a, b) for a, b in cases]
    monkeypatch.setattr(tiling, "MOST_SEEDS", 0)
    assert [tiling.tile(a, b) for a, b in cases] == by_pairs
    monkeypatch.undo()
    assert tiling.tile(np.full(4000, 7, np.uint64), np.full(3000, 7, np.uint64)) == [(0, 0, 3000)]


def test_tables_and_shuffles_of_near_duplicates_go_when_they_are_read(spark, monkeypatch):
    """Seeds in several parts give the same groups; only the tables that the result reads are left, and texts aren't shuffled to lose few rows."""
    from taxweave.llm import common, jaccard

    copy = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(copy[:-1] + [f"end{k}"])) for k in range(5)] + [(10 + k, " ".join(f"t{k}x{i}" for i in range(40))) for k in range(30)]
    docs = spark.createDataFrame([*texts, (10, texts[5][1]), (None, "a b"), (99, None)], "doc_id long, text string")
    groups = lambda: sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=repr)
    before = common.settled(spark)
    whole = groups()
    monkeypatch.setattr(jaccard, "SEEDS_AT_ONCE", 1)
    assert groups() == whole and {r[2] for r in whole if r[0] is not None and r[0] < 5} == {0}
    left = [p for p in common.settled(spark) if p not in before]
    assert len(left) == 4 and not any(name in p for p in left for name in ("/sets-", "/seeds-", "/members-", "/classes-"))
    kept = jaccard.keep_one(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([0, *range(10, 40), 99, None], key=repr)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    kept = jaccard.keep_one(docs)
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([0, *range(10, 40), 99, None], key=repr)
