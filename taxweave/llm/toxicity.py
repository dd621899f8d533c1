"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as classes: insult, threat, target, negation, report, other. Targets, negations, reports,
insults and threats each have a small automaton; their product is one machine that reads a clause word by
word and adds weights: an insult counts by its learned weight, more with a target near it, less
behind a negation or in reported speech; a threat counts with a target near it. A document is scored
by what its clauses gained, through a logistic curve fitted to labelled rows.

Insults are learned: words and beginnings of words that stand in toxic documents, each counted once
for each pair of neighbours, so that a text copied a thousand times counts as one. Learning takes a bounded
sample of labelled rows, at most SAMPLE ids of each class, chosen by the hash of the id.

Null and empty texts have no clause and get the score of the intercept. Rows of documents are scored
each for itself; of several labels for one id the highest counts. Without labels of both classes the
lexicon is empty and every score is (toxic rows + 1) / (labelled rows + 10). Texts of any length are read whole. An empty table
gives no rows. A score of 0.5 (a tie) counts as toxic in the query. Other columns are not looked at.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxweave.llm.common import settle

SAMPLE = 6000
STEMS = range(4, 8)
LEAST_CONTEXTS, LEAST_ODDS = 6, 3.0
MEMO_ENTRIES = 300_000

# Fixed word lists.
TARGETS = "you your yours yourself they them he she du dich dir dein deine ihr euch tu te toi ton vous votre tú ti usted ustedes vosotros"
THREATS = "kill hurt destroy beat shoot stab burn töten umbringen schlagen tuer frapper détruire matar golpear destruir"
NEGATIONS = "not no never none without isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás sin"
REPORTS = "said says wrote claimed reported quoted called sagte schrieb behauptete dit écrit déclaré dijo escribió afirmó"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLAUSE_END = 8  # added to the class of a word that ends its clause
MARKS = ".,;:!?\"'()[]{}<>*#%&$|-_…«»“”"
NEAR = 4  # words that a target, a negation, an insult or a threat reaches
FIXED = {w: c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws.split()}
FEATURES = ["most", "total", "insults", "threats"]


def near(kind: int) -> dict[tuple[int, int], int]:
    """Counts down from NEAR after a word of this class: above 0 it is near."""
    return {(s, c): NEAR if c == kind else max(0, s - 1) for s in range(NEAR + 1) for c in range(6)}


def seen(kind: int) -> dict[tuple[int, int], int]:
    """Whether a word of this class has come in the clause."""
    return {(s, c): int(bool(s) or c == kind) for s in range(2) for c in range(6)}


#: state of each automaton, in this order
PARTS = [near(TARGET), near(NEGATION), seen(REPORT), near(INSULT), near(THREAT)]


def compose(parts: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product machine from state 0: next state, what a word gains times its own weight, fixed gain."""
    states, queue, rows = {(0,) * len(parts): 0}, [(0,) * len(parts)], []
    for state in queue:
        target, negated, reported, insult, threat = state
        softened = (0.4 if negated else 1.0) * (0.6 if reported else 1.0)
        row = []
        for kind in range(6):
            after = tuple(part[s, kind] for part, s in zip(parts, state))
            if after not in states:
                states[after] = len(states)
                queue.append(after)
            by_weight = softened * (1.3 if target else 1.0) if kind == INSULT else 0.0
            fixed = softened * ((2.0 * bool(target)) if kind == THREAT else (0.5 * bool(insult) + 2.0 * bool(threat)) if kind == TARGET else 0.0)
            row.append((states[after], by_weight, fixed))
        rows.append(row)
    table = np.array(rows)
    return table[..., 0].astype(int), table[..., 1], table[..., 2]


NEXT, BY_WEIGHT, FIXED_GAIN = (t.tolist() for t in compose(PARTS))


class Reader(dict):
    """For a word as it stands in the text: its class, and whether it ends a clause."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.weights: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = [self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "~", 0.0) for n in STEMS if len(word) > n)]
        return max(found)

    def __missing__(self, token: str) -> int:
        word = token.strip(MARKS).lower()
        weight = self.weight(word)
        kind = INSULT if weight else FIXED.get(word, OTHER)
        if weight:
            self.weights[token] = weight
        code = kind + CLAUSE_END * (token[-1] in ".;!?…" and word != token)
        if weight or len(self) < MEMO_ENTRIES:
            self[token] = code
        return code

    def features(self, text: str) -> tuple[float, ...]:
        tokens = text.split()
        codes = bytes(map(self.__getitem__, tokens))
        if not any(c in codes for c in (INSULT, INSULT + CLAUSE_END, THREAT, THREAT + CLAUSE_END)):
            return 0.0, 0.0, 0.0, 0.0
        state, gained, clauses, insults, threats = 0, 0.0, [], 0, 0
        for token, code in zip(tokens, codes):
            kind = code & 7
            if kind == INSULT:
                insults += 1
                gained += BY_WEIGHT[state][kind] * self.weights[token]
            elif kind:
                threats += FIXED_GAIN[state][kind] >= 1
                gained += FIXED_GAIN[state][kind]
            state = NEXT[state][kind]
            if code & CLAUSE_END:
                clauses.append(gained)
                state, gained = 0, 0.0
        clauses.append(gained)
        return max(clauses), math.log1p(sum(clauses)), math.log1p(insults), math.log1p(threats)


class Model(NamedTuple):
    lexicon: dict[str, float]
    weights: list[float]
    intercept: float


def _stems(token: str) -> list[str]:
    word = token.strip(MARKS).lower()
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)] if len(word) > 2 else []


def _contexts(batches):
    """Distinct (word or beginning, hash of its neighbours) of texts."""
    for batch in batches:
        rows = set()
        for text in batch.column("text").to_pylist():
            tokens = ["", *(text or "").split(), ""]
            for before, token, after in zip(tokens, tokens[1:], tokens[2:]):
                context = xxhash.xxh64_intdigest(f"{before} {after}") >> 1
                rows.update((stem, context) for stem in _stems(token))
        entry, context = zip(*rows) if rows else ((), ())
        yield pa.record_batch([pa.array(entry, pa.string()), pa.array(context, pa.int64())], ["entry", "context"])


def _lexicon(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries with their log odds. The rows that come to the driver are bounded by the sample."""
    contexts = toxic.mapInArrow(_contexts, "entry string, context long").distinct()
    often = contexts.groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") >= max(LEAST_CONTEXTS, n_toxic // 500))
    candidates = {r.entry: r.n for r in often.toLocalIterator()}
    known = frozenset(candidates)

    def also(batches):
        for batch in batches:
            n: dict[str, int] = {}
            for text in batch.column("text").to_pylist():
                for token in (text or "").split():
                    for stem in _stems(token):
                        if stem in known:
                            n[stem] = n.get(stem, 0) + 1
            yield pa.record_batch([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["entry", "n"])

    in_clean = {r.entry: r.n for r in clean.mapInArrow(also, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).toLocalIterator()}
    odds = {e: math.log((n + 0.5) / (n_toxic + 1)) - math.log((in_clean.get(e, 0) + 0.5) / (n_clean + 1)) for e, n in candidates.items()}
    return {e: o for e, o in odds.items() if o >= LEAST_ODDS}


def _features(lexicon):
    def features(batches):
        reader = Reader(lexicon)
        for batch in batches:
            rows = [reader.features(text.as_py() or "") for text in batch.column("text")]
            columns = zip(*rows) if rows else [()] * len(FEATURES)
            yield pa.record_batch([batch.column("row"), *(pa.array(c, pa.float64()) for c in columns)], ["row", *FEATURES])

    return features


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From texts of docs (doc_id, text) with labels (doc_id, toxic).

    Of each class the `sample` ids of least hash are taken, so that no more than these
    are sent to where the texts are, and only the chosen texts are moved. Of an id's rows the greatest text counts.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (1, 0)]
    every = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    # One text an id, however many rows it has; equal ids are combined in the tasks that read them.
    rows = settle(every.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 1) / (n_toxic + n_clean + 10)
        return Model({}, [0.0] * len(FEATURES), math.log(share / (1 - share)))
    lexicon = _lexicon(rows.filter("toxic = 1"), rows.filter("toxic = 0"), n_toxic, n_clean)
    points = rows.select(F.struct("toxic").alias("row"), "text")
    points = points.mapInArrow(_features(lexicon), "row struct<toxic:int>, " + ", ".join(f"{f} double" for f in FEATURES))
    table = np.array([(*r[1:], r.row.toxic) for r in points.collect()], float)  # short rows, bounded by the sample
    *weights, intercept = _logistic(table[:, :-1], table[:, -1]).tolist()
    return Model(lexicon, weights, intercept)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All rows and columns of docs, and the score under `column`."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    schema = rows.drop("text").schema
    for feature in FEATURES:
        schema = schema.add(feature, "double")
    found = rows.mapInArrow(_features(model.lexicon), schema)
    z = sum((F.col(f) * w for f, w in zip(FEATURES, model.weights)), F.lit(model.intercept))
    return found.select("row.*", (1 / (1 + F.exp(-z))).alias(column))
