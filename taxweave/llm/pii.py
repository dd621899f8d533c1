"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides on spans.

Candidates are the matches of the base patterns, valid or not, and forms that these miss: national phone numbers and
numbers with 00, spelled-out mail addresses, IPv6 addresses, account numbers in groups. Five labelers vote on each for,
against or not at all: its shape, a gazetteer (domain endings, reserved networks, card issuers, country codes), its
context (words before it, or a sure span of another kind in the same text), its borders, and the variety of its
characters. None of them asks whether it is a base match. How often each combination of votes occurs, at most 243 for each
kind, goes to the driver, where expectation-maximisation estimates how often each labeler is right for each kind.

The posterior of every candidate is averaged over the combinations of its features (length, separators, characters before and
behind it, mix of letters and digits, context, gazetteer: FEATURES), at most 13,824 for each kind; on these a logistic classifier is
trained for each kind. Of the votes it sees context and gazetteer only. Spans that it accepts and that meet no valid base match are
added; valid base matches always stay.

Only DataFrame functions run on rows. Null and empty texts hold nothing; an empty table gives no rows. Texts of any length are read whole, in time in proportion
to them. Repeated rows are treated each for itself. Of candidates of a kind that overlap (ties) the first and longest is added. Positions
count code points, the end is exclusive. Other columns pass through in a struct.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxweave.llm.common import settle

KINDS = ["email", "ip", "card", "phone"]
# Fixed patterns. Possessive, and beginning only where a run begins or the last match ended, so that they
# match what the plain ones match and take time in proportion to the text.
MAIL_RUN = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{MAIL_RUN})){MAIL_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Forms that the base patterns miss: (kind, pattern, characters that a text must have).
MORE = [
    ("phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", None),
    ("phone", r"(?<![0-9+.-])00[1-9][0-9]{0,2}(?:[\x20./-]?[0-9]){7,12}+(?![0-9])", "00"),
    ("phone", r"(?<![0-9+.-])0[1-9][0-9]{1,4}[\x20/-][0-9]{3,8}(?:[\x20-][0-9]{2,4}){0,3}+(?![0-9])", "0"),
    ("email", r"(?i)\b[a-z0-9._-]{1,64}\x20?[(\[{]at[)\]}]\x20?[a-z0-9-]{1,63}(?:(?:\x20?[(\[{]dot[)\]}]\x20?|\.)[a-z0-9-]{2,24})++", "at"),
    ("ip", r"(?i)(?<![0-9a-z:.])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![0-9a-z:])", ":"),
    ("card", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
]

# Fixed lists.
ENDINGS = "com org net edu gov io co info de fr es uk it nl eu ch at us ca".split()
COUNTRY_CODES = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[4-7]|6(011|5|4[4-9])|[A-Z]{2}[0-9]{2})"
RESERVED = r"^(0|10|127|22[4-9]|2[345][0-9]|192\.168|169\.254)\."
WORDS_BEFORE = {
    "email": r"(mail|contact|write|kontakt|courriel|correo|contacto|reply)\W*$",
    "ip": r"(\bip|address|host|server|adresse|dirección)\W*$",
    "card": r"(card|visa|mastercard|amex|karte|carte|tarjeta)\W*$",
    "phone": r"(phone|tel|call|fax|mobile|telefon|téléphone|teléfono|llame)\W*$",
}
WORDS_AGAINST = r"(version|isbn|issn|invoice|order|serial|rechnung|facture|factura|§|#)\W*$"
BEFORE_CHARS = 24
LABELERS = ["shape", "gazetteer", "context", "borders", "variety"]
EM_STEPS, ACCEPT = 50, 0.5
#: Chances of a vote for, none and against, of a candidate that is personal data, before anything is seen.
FIRST = {1: 0.6, 0: 0.3, -1: 0.1}
#: Features of a span and how many values each has.
FEATURES = {"long": 6, "marks": 4, "behind": 4, "ahead": 4, "mix": 4, "word": 3, "listed": 3}


def _matches(text: Column, pattern: str, hint: Column) -> Column:
    """(start, value) of all matches, from the matches and what lies between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,value:string>>")
    placed = F.aggregate(
        F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value"))),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, m: F.struct(
            (a["at"] + m["gap"] + F.length(m["value"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + m["gap"]).alias("start"), m["value"].alias("value")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(hint, F.when(F.size(found) > 0, placed).otherwise(empty)).otherwise(empty)


def _luhn(digits: Column) -> Column:
    """Whether the digit sum with every second digit from the right doubled ends in 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":  # a part may have any number of leading zeros
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(value, r"\."), lambda p: F.right(p, F.lit(3)).cast("int") <= 255
        )
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote.when(no, -1) if no is not None else vote).otherwise(0)


def _gazetteer(kind: str, value: Column) -> Column:
    if kind == "email":
        ending = F.lower(F.regexp_extract(value, r"([A-Za-z]+)\W*$", 1))
        return _vote(ending.isin(ENDINGS))
    if kind == "ip":
        return _vote(~value.rlike(RESERVED), value.rlike(RESERVED))
    if kind == "card":
        return _vote(F.regexp_replace(value, "[^A-Z0-9]", "").rlike(ISSUERS), ~value.rlike(ISSUERS))
    return _vote(value.rlike(COUNTRY_CODES) | value.rlike("^00[1-9]"), value.rlike(r"^\+0"))


def _shape(kind: str, value: Column) -> Column:
    """Whether length and grouping are those of the kind."""
    n = F.length(_digits(value))
    if kind == "email":
        return _vote(value.rlike(r"(?i)[a-z].*(@|at).*[a-z]{2,24}[)\]}]?$"), value.rlike(r"[0-9]$"))
    if kind == "ip":
        groups = F.size(F.split(value, ":"))
        return _vote((groups == 8) | value.contains("::") | ((groups == 1) & ~value.rlike(r"(^|\.)0[0-9]")), (groups > 1) & (groups < 8))
    if kind == "card":
        return _vote(n.between(15, 16) | value.rlike("^[A-Z]{2}"), ~n.between(12, 24))
    return _vote(n.between(8, 14) & value.rlike(r"[\x20().-]"), ~n.between(7, 15))


def _variety(kind: str, value: Column) -> Column:
    """Few different characters are a filler or a rule, not a number that someone has."""
    different = F.size(F.array_distinct(F.split(F.regexp_replace(value, "[^A-Za-z0-9]", ""), "")))
    return _vote(different >= (3 if kind == "ip" else 5), different <= 2)


def _bucket(value: Column, bounds: list[int]) -> Column:
    return sum(((value >= b).cast("int") for b in bounds), F.lit(0))


def _side(char: Column) -> Column:
    """What stands beside a span: nothing or a blank, an end of a clause, a letter or digit, other."""
    return F.when(char.rlike(r"^[\s]*$"), 0).when(char.rlike(r"[.,;:!?()\"']"), 1).when(char.rlike(r"[\p{L}0-9_]"), 2).otherwise(3)


def _voted(text: Column, matches: Column, kind: str, strict: bool) -> Column:
    """Matches as candidates: kind, start, end, whether valid base, the votes and the features."""

    def candidate(m: Column) -> Column:
        value = m["value"]
        end = m["start"] + F.length(value)
        before = F.lower(text.substr(F.greatest(m["start"] - BEFORE_CHARS, F.lit(0)) + 1, F.least(m["start"], F.lit(BEFORE_CHARS))))
        left, right = F.right(before, F.lit(1)), text.substr(end + 1, F.lit(1))
        word = r"[\p{L}0-9_]"
        n_digits = F.length(_digits(value))
        marks = F.length(F.regexp_replace(value, r"[\p{L}0-9]", ""))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), end.alias("end"),
            (_valid(kind, value) if strict else F.lit(False)).alias("base"),
            _shape(kind, value).alias("shape"),
            _gazetteer(kind, value).alias("gazetteer"),
            _vote(before.rlike(WORDS_BEFORE[kind]), before.rlike(WORDS_AGAINST)).alias("context"),
            _vote(~(left.rlike(word) | right.rlike(word)), left.rlike(word) | right.rlike(word)).alias("borders"),
            _variety(kind, value).alias("variety"),
            _bucket(F.length(value), [7, 10, 13, 16, 20]).alias("long"),
            _bucket(marks, [1, 2, 4]).alias("marks"),
            _side(left).alias("behind"),
            _side(right).alias("ahead"),
            _bucket(4 * n_digits, [F.length(value), 2 * F.length(value), 3 * F.length(value)]).alias("mix"),
        )

    return F.transform(matches, candidate)


def candidates(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`row` (all or the named columns of docs) and the candidates of its text."""
    text = F.col("whole")
    base = docs.select(F.struct(*(columns or ["*"])).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("whole"))
    hints = {"email": text.contains("@"), "phone": text.contains("+")}
    digit = F.length(F.translate(text, "0123456789", "")) < F.length(text)
    found = base.withColumns({f"_{k}": _matches(text, p, hints.get(k, digit)) for k, p in PATTERNS.items()})
    wanted = {"at": F.lower(text).rlike(r"[(\[{]at[)\]}]"), None: digit}
    found = found.withColumns({f"_more{i}": _matches(text, p, wanted[w] if w in wanted else digit & text.contains(w)) for i, (_, p, w) in enumerate(MORE)})
    voted = [_voted(text, F.col(f"_{k}"), k, True) for k in PATTERNS]
    voted += [_voted(text, F.col(f"_more{i}"), k, False) for i, (k, _, _) in enumerate(MORE)]
    every = found.select("row", F.concat(*voted).alias("candidates"))
    # A sure span of another kind in the text speaks for a candidate without words before it.
    sure = F.array_distinct(F.transform(F.filter("candidates", lambda c: c["base"]), lambda c: c["kind"]))
    seen = every.withColumn("sure", sure)
    other = lambda c: F.exists("sure", lambda k: k != c["kind"])
    placed = F.transform("candidates", lambda c: c.withField("context", F.when((c["context"] == 0) & other(c), 1).otherwise(c["context"])))
    return seen.select("row", F.transform(placed, lambda c: c.withField("word", c["context"] + 1).withField("listed", c["gazetteer"] + 1)).alias("candidates"))


def estimate(patterns: list[tuple]) -> dict[int, tuple[float, list[dict[bool, dict[int, float]]]]]:
    """For each kind the share of personal data, and each labeler's chance of each vote on it and on others.

    From (kind, *votes, count), by expectation-maximisation with independent labelers. Chances are drawn towards FIRST
    by ten votes, so that the two classes can't trade places.
    """
    found = {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [(p[1:-1], p[-1]) for p in patterns if p[0] == kind]
        total = sum(n for _, n in rows)
        first = {True: FIRST, False: {v: FIRST[-v] for v in FIRST}}
        prior, chance = 0.5, [{side: dict(first[side]) for side in first} for _ in rows[0][0]]
        for _ in range(EM_STEPS):
            truth = [posterior(votes, prior, chance) for votes, _ in rows]
            prior = (sum(n * t for (_, n), t in zip(rows, truth)) + 1) / (total + 2)
            for k, by in enumerate(chance):
                for side in (True, False):
                    share = [(v[k], n * (t if side else 1 - t)) for (v, n), t in zip(rows, truth)]
                    size = sum(s for _, s in share)
                    by[side] = {vote: (sum(s for v, s in share if v == vote) + 10 * first[side][vote]) / (size + 10) for vote in (1, 0, -1)}
        found[kind] = prior, chance
    return found


def posterior(votes: tuple, prior: float, chance: list[dict[bool, dict[int, float]]]) -> float:
    yes, no = prior, 1 - prior
    for by, vote in zip(chance, votes):
        yes, no = yes * by[True][vote], no * by[False][vote]
    return yes / (yes + no)


def train(rows: list[tuple]) -> tuple[float, list[list[float]]]:
    """A logistic classifier's intercept and its weight of each value of each feature, from (*features, count, mean posterior)."""
    sizes = list(FEATURES.values())
    starts = np.cumsum([0, *sizes])
    x = np.zeros((len(rows), starts[-1]))
    for i, row in enumerate(rows):
        x[i, starts[:-1] + np.array(row[: len(sizes)])] = 1
    n, truth = (np.array([r[k] for r in rows], float) for k in (-2, -1))
    share = n / n.sum()
    b, w = 0.0, np.zeros(starts[-1])
    for _ in range(2000):
        off = (1 / (1 + np.exp(-np.clip(b + x @ w, -30, 30))) - truth) * share
        b -= 2 * off.sum()
        w -= 2 * (off @ x + 1e-3 * w)
    return float(b), [w[p:q].tolist() for p, q in zip(starts[:-1], starts[1:])]


def _log_odds(c: Column, prior: float, chance: list[dict[bool, dict[int, float]]]) -> Column:
    z = F.lit(math.log(prior / (1 - prior)))
    for name, by in zip(LABELERS, chance):
        vote = {v: math.log(by[True][v] / by[False][v]) for v in (1, 0, -1)}
        z += F.when(c[name] == 1, vote[1]).when(c[name] == -1, vote[-1]).otherwise(vote[0])
    return z


def spans(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`row` and its spans (kind, start, end, base), by kind, then start."""
    found = settle(candidates(docs, columns), "candidates")
    each = found.select(F.explode("candidates").alias("c"))
    votes = each.select("c.kind", *[f"c.{n}" for n in LABELERS]).groupBy("kind", *LABELERS).agg(F.count("*").alias("n"))
    learned = estimate([tuple(r) for r in votes.collect()])  # at most 243 rows a kind
    chance = F.lit(0.0)
    for kind, (prior, by) in learned.items():
        chance = F.when(F.col("c.kind") == kind, 1 / (1 + F.exp(-_log_odds(F.col("c"), prior, by)))).otherwise(chance)
    of = each.select("c.kind", *[f"c.{n}" for n in FEATURES], chance.alias("chance")).groupBy("kind", *FEATURES)
    rows = [tuple(r) for r in of.agg(F.count("*").alias("n"), F.avg("chance").alias("chance")).collect()]  # at most 13,824 a kind
    models = {kind: train([r[1:] for r in rows if r[0] == kind]) for kind in learned}

    def accepted(c: Column) -> Column:
        decision = F.lit(False)
        for kind, (b, weights) in models.items():
            z = F.lit(b)
            for name, w in zip(FEATURES, weights):
                z += F.element_at(F.array(*map(F.lit, w)), c[name] + 1)
            decision = F.when(c["kind"] == kind, 1 / (1 + F.exp(-z)) >= ACCEPT).otherwise(decision)
        return decision

    base = found.withColumn("sure", F.filter("candidates", lambda c: c["base"]))
    meets = lambda c: F.exists("sure", lambda s: (s["kind"] == c["kind"]) & (s["start"] < c["end"]) & (c["start"] < s["end"]))
    added = F.filter(F.filter("candidates", lambda c: ~c["base"] & accepted(c)), lambda c: ~meets(c))
    short = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))
    # Of added spans of a kind that overlap, the first and then the longest stays.
    lone = lambda a, c: F.when(F.exists(a, lambda s: (s["kind"] == c["kind"]) & (c["start"] < s["end"])), a).otherwise(F.concat(a, F.array(c)))
    by_place = F.array_sort(F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["end"]).alias("minus"))))
    kept = F.aggregate(
        F.transform(by_place, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["minus"]).alias("end"), F.lit(False).alias("base"))),
        F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean>>"), lone,
    )
    every = F.array_distinct(F.array_sort(F.concat(F.transform("sure", short), kept)))
    return base.select("row", every.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; of spans that overlap the first names it."""
    found = spans(docs)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    name = lambda s: F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), s["kind"] + 1)
    replaced = F.aggregate(
        by_place,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], -s["minus"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct((-s["minus"]).alias("at"), F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), name(s)).alias("out"))
        ),
        lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.greatest(F.length(text) - a["at"], F.lit(0)))),
    )
    new = F.when(F.size("spans") > 0, replaced).otherwise(F.col("row.text"))
    return found.withColumn("row", F.col("row").withField("text", new)).select("row.*")
