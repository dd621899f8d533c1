"""The registered query of each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxweave.llm import bpe, divergence, jaccard, katz, lockstep, outliers, packing, passages, pii, tiling, token_files, toxicity, wrappers
from taxweave.llm.common import LOWER, UPPER, in_class, tables
from taxweave.session import fresh_folder


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under a model of the documents that are not held out."""
    return katz.score(tables(spark, sf_dir, "documents"), ~in_class(F.col("doc_id"), 7, 2))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the group of near duplicates it is in."""
    return jaccard.near_duplicates(tables(spark, sf_dir, "documents"))


def op3_toxic_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labelled ones outside the held-out fifth."""
    docs, labels = (tables(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = in_class(F.col("doc_id"), 5, 0)
    model = toxicity.learn(docs, labels.filter(~held_out))
    scored = toxicity.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that recur."""
    kept = passages.remove_recurring(tables(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the wrapper of its host."""
    pages = tables(spark, sf_dir, "pages")
    texts = wrappers.main_text(pages, wrappers.infer(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the base matches, and all spans that are accepted."""
    docs = tables(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = pii.spans(docs, ["doc_id"]).withColumn("base", F.filter("spans", lambda s: s["base"]))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("row.doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, and how much of it."""
    return tiling.leaks(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and whether the quality rules keep it."""
    docs = tables(spark, sf_dir, "documents")
    found = outliers.assess(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"), ["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("row.doc_id", *counts, "base_failed", "kept", "d2")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    pieces = packing.cut(tables(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return packing.place(pieces)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back."""
    folder = fresh_folder(spark, "tokens")
    token_files.write(tables(spark, sf_dir, "documents"), folder, _tokenizer("byte_bpe_50k.json"))
    read = token_files.read(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _ids_only(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded over tries of words and decoded again."""
    both = bpe.round_trip(_ids_only(tables(spark, sf_dir, "documents")), _tokenizer("byte_bpe_50k.json"), ["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    digests = F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return both.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests)


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned, with how many documents hold its links."""
    a, b = _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")
    aligned = lockstep.align(_ids_only(tables(spark, sf_dir, "documents")), a, b, ["doc_id"], links=False)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    counted = lockstep.with_support(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source the other sources of its language by distance, and the terms it uses more than the language."""
    return divergence.audit(tables(spark, sf_dir, "documents"))


_DIVERGENCE = rf"""WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT doc, lang, source, unnest(found) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, kept.term, v, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) JOIN v USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (
  SELECT *, CAST(1 + 1000000000 * (CAST(n AS HUGEINT) + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p,
    CAST(1 + 1000000000 * (sum(n) OVER (PARTITION BY lang, term) + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS BIGINT) AS q FROM cell),
apart AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50"""

_WORDS = r"[^\x20\x09-\x0D]+"
_NEAR = rf"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORDS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""

_REPEATED = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
v AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
x AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM v),
twice AS (SELECT r, i FROM x WHERE g IN (SELECT g FROM x GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM twice),
k AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) a ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

QUERIES = {
    "op1_katz_backoff": (op1_katz_backoff, None),
    "op2_jaccard_join": (op2_jaccard_join, _NEAR),
    "op3_toxic_clauses": (op3_toxic_clauses, None),
    "op4_repeated_passages": (op4_repeated_passages, _REPEATED),
    "op5_page_wrappers": (op5_page_wrappers, None),
    "op6_weak_supervision": (op6_weak_supervision, None),
    "op7_string_tiling": (op7_string_tiling, None),
    "op8_robust_outliers": (op8_robust_outliers, None),
    "op9_best_fit_packing": (op9_best_fit_packing, None),
    "op10_token_files": (op10_token_files, None),
    "op11_prefix_trie": (op11_prefix_trie, None),
    "op12_lockstep_alignment": (op12_lockstep_alignment, None),
    "op13_source_divergence": (op13_source_divergence, _DIVERGENCE),
}
