"""Encoding over tries, lockstep alignment and divergence of sources, against the libraries and plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from taxweave.llm import bpe, divergence, lockstep, queries

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SF_DIR = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def strange(n, seed):
    pick = random.Random(seed)
    letters = lambda: pick.choice([pick.randint(0, 0x250), pick.randint(0, 0xD7FF), 32, 32, pick.randint(0x1F300, 0x1F700), pick.randint(0xE000, 0x10FFFF)])
    out = ["".join(pick.choice("abcdeghinorst  'tTsé1.,\n-_") for _ in range(pick.randint(1, 80))) for _ in range(n)]
    out += ["".join(chr(letters()) for _ in range(pick.randint(1, 30))) for _ in range(n)]
    out += ["", " ", "  ", "a ", " a", "a  b \t\n c", " " * 300 + "x" + "-" * 500, "a" * 6000, "ab" * 3000 + " " + "é" * 3000, "\x1c\x1d x\x85y　z", "\x00\x00a"]
    out += ["<|endoftext|>a<|endoftext|> <|endoftext|>", "<s> <unk> <0x41> </s>", " ▁ ", "日本語テキスト 한국어", "don't we'll I'VE it's 's", "🙂🙂🏽 👨‍👩‍👧", "ﬁ Å é"]
    return out


# --- encoding over tries -----------------------------------------------------


def test_ids_are_the_librarys():
    texts, known, encoder = strange(1500, 3), library(), bpe.Encoder(BYTE)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [known.encode(t, add_special_tokens=False).ids for t in texts]
    plain = bpe.Encoder(BYTE, special_is_text=True).encode(["<|endoftext|> x"])
    known.encode_special_tokens = True
    assert np.frombuffer(plain[0], "<u4").tolist() == known.encode("<|endoftext|> x", add_special_tokens=False).ids


def test_decoding_is_the_librarys():
    pick, merges, known = random.Random(5), bpe.Merges(BYTE), library()
    ids = [[pick.randint(0, 50_256) for _ in range(pick.randint(0, 20))] for _ in range(2000)]
    assert [bpe.decode_ids(np.array(x, np.int64), merges) for x in ids] == [known.decode(x, skip_special_tokens=False) for x in ids]
    assert bpe.decode_ids(np.array([64, 60_000, 65]), merges) == known.decode([64, 65])


def test_a_shared_prefix_is_encoded_once(monkeypatch):
    merges, looked = bpe.Merges(BYTE), []
    state = merges.state
    monkeypatch.setattr(merges, "state", lambda path, states, depth: looked.append(bytes(path[:depth])) or state(path, states, depth))
    words = [b"undo", b"undone", b"undoing", b"under", b"u"]
    trie = bpe.Trie()
    for word in words:
        trie.insert(word)
    found = trie.encode(merges)
    assert sorted(looked) == sorted({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert found == {w: bpe.along(w, merges) for w in words}


def test_every_state_is_the_only_one():
    """No other token fits, which the method rests on."""
    merges = bpe.Merges(BYTE)
    for word in ["indivisible", " antidisestablishment", "aaaaaaaaaaaa", " the", "----------", "ééé", "0000123"]:
        path, states = bytearray(word.encode()), [-1]
        for depth in range(1, len(path) + 1):
            ends = [merges.token.get(bytes(path[k:depth])) for k in range(depth)]
            fit = [t for k, t in enumerate(ends) if t is not None and (k == 0 or merges.apart(states[k], t))]
            assert len(fit) == 1 and fit[0] == merges.state(path, states, depth)
            states.append(fit[0])


def test_stable_characters_have_the_librarys_classes():
    ranges = [(0, 0x52F), (0x2000, 0x206F), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    pre = library().pre_tokenizer
    for low, high in ranges:
        for code in range(low, high + 1):
            assert bpe.STABLE.fullmatch(chr(code)), hex(code)
            for text in (f"a{chr(code)}", f"1{chr(code)}", f"!{chr(code)} "):
                assert bpe.WORDS.findall(text) == [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)], hex(code)


def test_encoded_table(odd, plain, empty):
    known = library()
    both = bpe.round_trip(odd, BYTE)
    got = sorted([(r.row.doc_id, r.row.text, r.ids, r.decoded) for r in both.collect()], key=repr)
    expected = [(i, t, known.encode(t or "", add_special_tokens=False).ids) for i, t in plain]
    assert got == sorted([(i, t, x, known.decode(x, skip_special_tokens=False)) for i, t, x in expected], key=repr)
    apart = bpe.decode(bpe.encode(odd, BYTE, ["doc_id", "text"]), BYTE)
    assert sorted([(r.row.doc_id, r.row.text, r.ids, r.decoded) for r in apart.collect()], key=repr) == got
    assert set(both.select("row.*").columns) == set(odd.columns)
    assert bpe.round_trip(empty, BYTE).collect() == []


def test_query_of_encoding(spark):
    rows = queries.op11_prefix_trie(spark, SF_DIR).collect()
    known, texts = library(), {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(rows) == len(texts)
    for r in rows:
        ids = known.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(known.decode(ids, skip_special_tokens=False)))


# --- lockstep alignment ------------------------------------------------------


class Plain:
    """One document at a time, token by token."""

    def __init__(self):
        import sentencepiece

        self.a, self.b = library(), sentencepiece.SentencePieceProcessor(model_file=PIECE)
        self.a.encode_special_tokens = True
        self.spelt = bpe.Merges(BYTE).bytes

    def _b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, text):
        whole = f" {text}".encode()
        a, b = (self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)) if text else ([], [])
        sa, sb = [self.spelt[i] for i in a], [self._b(i) for i in b]
        if not text or b"".join(sa) != whole or b"".join(sb) != whole:
            return 0, 0, 0, 0, "", [], Counter()
        ends = lambda s: np.cumsum([len(x) for x in s]).tolist()
        ea, eb = ends(sa), ends(sb)
        links = [(i, k) for i in range(len(a)) for k in range(max(0, i - 400), len(b)) if ea[i] - len(sa[i]) < eb[k] and eb[k] - len(sb[k]) < ea[i]] if len(a) < 400 else None
        if links is None:
            links, k = [], 0
            for i in range(len(a)):
                while eb[k] <= ea[i] - len(sa[i]):
                    k += 1
                j = k
                while j < len(b) and eb[j] - len(sb[j]) < ea[i]:
                    links.append((i, j))
                    j += 1
        groups, i, k = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            x, y = ea.index(end, i) + 1, eb.index(end, k) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[k:y])))
            i, k = x, y
        return len(a), len(b), len(groups), len(links), ";".join(groups), links, Counter((a[i], b[k]) for i, k in links)


@pytest.mark.parametrize("every", [3, lockstep.LANE_TOKENS])
def test_walks_like_plain_loops(every):
    texts, known, plain = [None, *strange(300, 9)], lockstep.Sides(BYTE, PIECE), Plain()
    found = lockstep.align_texts(texts, known, every)
    ends = np.concatenate([[0], np.cumsum(found["n_links"])])
    for d, text in enumerate(texts):
        links = list(zip(*(found[c][ends[d] : ends[d + 1]].tolist() for c in ("link_a", "link_b"))))
        got = [int(found[c][d]) for c in lockstep.COUNTS]
        assert (*got, found["groups"][d], links) == plain(text)[:6], repr(text)


def test_aligned_table(odd, plain, empty):
    one, sides = Plain(), [(i, t) for i, t in plain]
    results = [(i, one(t)) for i, t in sides]
    hold = Counter(p for _, r in results for p in r[6])
    most = defaultdict(int)
    for (a, _), n in hold.items():
        most[a] = max(most[a], n)
    expected = []
    for i, r in results:
        best = sum(m for p, m in r[6].items() if hold[p] == most[p[0]])
        expected.append((i, *r[:5], r[5], best, sum(m * hold[p] for p, m in r[6].items())))
    aligned = lockstep.with_support(lockstep.align(odd, BYTE, PIECE))
    got = [(r.row.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, [tuple(x) for x in r.links], r.n_best, r.count_sum) for r in aligned.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert set(aligned.select("row.*").columns) == set(odd.columns)
    assert lockstep.with_support(lockstep.align(empty, BYTE, PIECE)).collect() == []


def test_support_of_many_pairs_is_joined(odd, monkeypatch):
    columns = "row.doc_id", "row.text", "n_links", "n_best", "count_sum"
    sent = lockstep.with_support(lockstep.align(odd, BYTE, PIECE, links=False)).select(*columns)
    monkeypatch.setattr(lockstep, "BROADCAST_PAIRS", 0)
    joined = lockstep.with_support(lockstep.align(odd, BYTE, PIECE, links=False)).select(*columns)
    assert sorted(sent.collect(), key=repr) == sorted(joined.collect(), key=repr)


def test_query_of_alignment(spark):
    plain = Plain()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.op12_lockstep_alignment(spark, SF_DIR).collect():
        found = plain(texts[r.doc_id])
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == found[:4]
        assert r.groups_sha256 == (hashlib.sha256(found[4].encode()).hexdigest() if found[4] else "")


# --- divergence of sources ---------------------------------------------------


def gaps(rows, least, most):
    lower = {c: c + 32 for c in range(65, 91)}
    hold, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        group = (lang or "", source or "")
        found = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add(group)
        count[group].update(found)
        hold[group[0]].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in hold[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(count[lang, s]) for s in sources}, share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:most]
            out += [(lang, s, part, o.decode(), -v, k + 1) for part, x in (("pair", pairs), ("term", terms)) for k, (v, o) in enumerate(x)]
    return sorted(out)


def strange_sources(spark):
    pick = random.Random(2)
    rows = [(f"l{k % 3}", f"s{k % 7}", " ".join(pick.choice(["Ab", "ab", "Über", "über", "x1y", "naïve", "zz", "q"]) + str(k) for _ in range(k % 9))) for k in range(200)]
    rows += [(None, None, "ab ab"), ("", None, "ab"), (None, "s", ""), ("", "s", None), ("only", "one", "ab"), ("l0", "without", "1 2 3"), ("l0", "without", None)]
    rows += [("l1", "long", "ab " * 50_000), ("l1", "long", "x" * 100_000)] + [("l2", "same", "ab zz")] * 40
    return spark.createDataFrame(rows, "lang string, source string, text string")


@pytest.mark.parametrize(("least", "tile"), [(30, (4096, 128)), (3, (2, 2)), (1, (3, 3)), (10_000, (4096, 128))])
def test_divergence_like_plain_loops(spark, monkeypatch, least, tile):
    monkeypatch.setattr(divergence, "TILE_TERMS", tile[0])
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile[1])
    frame = strange_sources(spark)
    clashing = frame.select("*", *[F.lit(1).alias(c) for c in ("words", "vector", "term", "at", "count", "rows", "p", "folder")])
    got = sorted(tuple(r) for r in divergence.audit(clashing, least, 5).collect())
    assert got == gaps([tuple(r) for r in frame.collect()], least, 5)


def test_divergence_of_nothing(empty):
    assert divergence.audit(empty).collect() == []


def test_shares_are_exact(spark):
    big = 9_000_000_000_000_000
    row = spark.range(1).select(divergence._share(F.lit(big), F.lit(3 * big + 1), F.lit(7).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 5) // (3 * big + 1 + 35)


def test_query_of_divergence_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    expected = con.execute(queries.QUERIES["op13_source_divergence"][1]).fetchall()
    assert sorted(tuple(r) for r in queries.op13_source_divergence(spark, SF_DIR).collect()) == sorted(expected)


def test_a_worker_gives_up_what_other_operators_kept():
    from taxweave.llm import common, tokens

    bpe.encoder(BYTE)
    tokens.encoder(BYTE)
    assert not bpe._encoders and tokens._encoders
    bpe.encoder(BYTE)
    common.begin("jaccard")
    assert not bpe._encoders and not tokens._encoders
