"""Quality rules: text statistics, and outliers among them by minimum covariance determinant.

For each language and source the center and spread of the documents' transformed statistics are estimated from the
75 % of documents that lie closest together: from medians and median deviations on, each step keeps the
documents below the 75 % quantile of the distances and takes their means and covariances. These are
regularised as in the minimum regularised covariance determinant: S becomes (1 - SHRINK) S + SHRINK T, T being the diagonal
of the variances over all documents of the language. So a statistic that is the same in the core of a source, as
the share of repeated lines often is, is measured by how much it varies in the language, and a source where nothing varies
isn't singular. A document is rejected when its squared Mahalanobis distance exceeds the chi-square quantile of
the statistics that vary in the language (CUTOFFS), or by the two fixed rules.

Documents that fail a fixed rule take no part in the estimates. Sources with less than LEAST_ROWS
documents of a language are pooled, then small pools of languages; a pool that is still smaller rejects nothing. Quantiles
come from a sketch (percentile_approx), means and covariances from all rows; every group is pre-aggregated.

Only DataFrame functions are used. Null and empty texts have no words and fail the first rule. Null languages
and sources are values of their own. Repeated rows are assessed each for itself. Texts of any length are read whole; a distance of exactly
the cutoff (a tie) is kept; an empty table gives no rows. Other columns pass through;
columns of the same names as the statistics are kept apart in a struct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxweave.llm.common import settle, words

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20

KEPT_SHARE, STEPS, LEAST_ROWS = 0.75, 3, 50
#: Estimates of so many pools are sent to all tasks, so that the documents of a hot pool stay where they are.
POOLS_SENT = 20_000
#: For 5 statistics: 0.75 / P(chi-square with 7 degrees <= 75 % quantile of that with 5).
CONSISTENCY = 1.412
#: Part of the language's variances in a pool's covariances.
SHRINK = 0.25
#: Tails of 1e-6 of the chi-square distributions with 0 to 5 degrees of freedom.
CUTOFFS = [0.0, 23.93, 27.63, 30.66, 33.38, 35.89]
#: The transformed statistics.
FEATURES = {
    "long": "ln(1 + n_words)",
    "wide": "ln(word_chars / n_words)",
    "symbols": "ln(1 + 100 * n_symbols / word_chars)",
    "lines": "ln(1 + 10 * n_dup_lines / n_lines)",
    "repeats": "ln(1 + 10 * n_repeat_words / n_words)",
}
NAMES = list(FEATURES)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def statistics(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`row` (all or the named columns of docs), lang, source and the statistics of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, BLANKS) != "")
    first = docs.select(
        F.struct(*(columns or ["*"])).alias("row"), "lang", "source", words(F.col("text")).alias("words"), lines.alias("lines"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    at = lambda i, k: F.get("words", i + k)
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = first.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    # Nearly no text repeats a window; only those that do are looked at by place.
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = hashed.withColumn("placed", F.when(repeats, placed))
    same = lambda e, k: F.coalesce(e["h"] == F.get("placed", k)["h"], F.lit(False))
    again = F.transform("placed", lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"]))
    places = sorted_.withColumn("places", F.array_sort(F.array_compact(again)))
    covered = F.aggregate(
        F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0))),
        F.struct(F.lit(WINDOW).alias("n"), F.get("places", F.lit(0)).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return places.select(
        "row", "lang", "source", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("places") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def _pools(passed: DataFrame) -> DataFrame:
    """lang, source and the pool whose estimates hold for them."""
    n = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") < LEAST_ROWS, F.col("n")).otherwise(0)
    pooled = F.sum(small).over(Window.partitionBy("lang"))
    own = F.to_json(F.struct(F.lit("source").alias("of"), "lang", "source"))
    language = F.to_json(F.struct(F.lit("language").alias("of"), "lang"))
    pool = F.when(F.col("n") >= LEAST_ROWS, own).when(pooled >= LEAST_ROWS, language).otherwise("all")
    return n.select("lang", "source", pool.alias("pool"))


def _distance(center: list[Column], factor: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance, by solving with the Cholesky factor from the top down."""
    solved: list[Column] = []
    for i, name in enumerate(NAMES):
        rest = reduce(lambda a, k: a - factor[i, k] * solved[k], range(i), F.col(name) - center[i])
        solved.append(rest / factor[i, i])
    return reduce(lambda a, z: a + z * z, solved, F.lit(0.0))


def _factored(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_k of the covariances s_i_k, entry by entry."""
    for i in range(len(NAMES)):
        for k in range(i + 1):
            entry = reduce(lambda a, j: a - F.col(f"l_{i}_{j}") * F.col(f"l_{k}_{j}"), range(k), F.col(f"s_{i}_{k}"))
            entry = F.sqrt(F.greatest(entry, F.lit(1e-9))) if i == k else entry / F.col(f"l_{k}_{k}")
            estimates = estimates.withColumn(f"l_{i}_{k}", entry)
    return estimates


def _sent(of_pools: DataFrame) -> DataFrame:
    """A short row for each pool, broadcast if they are few; else Spark picks the join."""
    return F.broadcast(of_pools) if of_pools.count() <= POOLS_SENT else of_pools


def _with_distance(points: DataFrame, estimates: DataFrame) -> DataFrame:
    keys = [(i, k) for i in range(len(NAMES)) for k in range(i + 1)]
    joined = points.join(_sent(_factored(estimates)), "pool", "left")
    distance = _distance([F.col(f"m_{i}") for i in range(len(NAMES))], {(i, k): F.col(f"l_{i}_{k}") for i, k in keys})
    return joined.select(*points.columns, "cutoff", distance.alias("d2"))


def _targets(points: DataFrame, pools: DataFrame) -> DataFrame:
    """For each pool the variances t_i over its languages' documents, and the cutoff for those that aren't 0."""
    spread = points.groupBy("lang").agg(*[F.var_pop(n).alias(f"t_{i}") for i, n in enumerate(NAMES)])
    of = pools.select("pool", "lang").distinct().alias("p").join(spread.alias("s"), F.col("p.lang").eqNullSafe(F.col("s.lang")))
    targets = of.groupBy("pool").agg(*[F.avg(f"t_{i}").alias(f"t_{i}") for i in range(len(NAMES))])
    varying = reduce(lambda a, i: a + (F.col(f"t_{i}") > 0).cast("int"), range(len(NAMES)), F.lit(1))
    return targets.withColumn("cutoff", F.element_at(F.array(*map(F.lit, CUTOFFS)), varying))


def _start(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Medians and median deviations of each pool, as centers and a diagonal covariance."""
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    centers = points.groupBy("pool").agg(*[median(n).alias(f"m_{i}") for i, n in enumerate(NAMES)])
    off = points.join(_sent(settle(centers, "centers")), "pool").groupBy("pool", *[f"m_{i}" for i in range(len(NAMES))])
    spread = off.agg(*[median(F.abs(F.col(n) - F.col(f"m_{i}"))).alias(f"mad_{i}") for i, n in enumerate(NAMES)])
    squares = [((1 - SHRINK) * F.pow(1.4826 * F.col(f"mad_{i}"), 2) + SHRINK * F.col(f"t_{i}")).alias(f"s_{i}_{i}") for i in range(len(NAMES))]
    zeros = [F.lit(0.0).alias(f"s_{i}_{k}") for i in range(len(NAMES)) for k in range(i)]
    return spread.join(targets, "pool").select("pool", "cutoff", *[f"m_{i}" for i in range(len(NAMES))], *squares, *zeros)


def _step(points: DataFrame, estimates: DataFrame, targets: DataFrame) -> DataFrame:
    """Means and covariances of the closest 75 % under the estimates so far."""
    far = _with_distance(points, estimates)
    limits = far.groupBy("pool").agg(F.percentile_approx("d2", KEPT_SHARE, 1000).alias("limit"))
    close = far.join(_sent(settle(limits, "limits")), "pool").filter(F.col("d2") <= F.col("limit")).groupBy("pool")
    means = [F.avg(n).alias(f"m_{i}") for i, n in enumerate(NAMES)]
    pairs = [(i, k) for i in range(len(NAMES)) for k in range(i + 1)]
    spreads = [((1 - SHRINK) * CONSISTENCY * F.covar_pop(NAMES[i], NAMES[k])).alias(f"c_{i}_{k}") for i, k in pairs]
    regular = [(F.col(f"c_{i}_{k}") + (SHRINK * F.col(f"t_{i}") if i == k else 0.0)).alias(f"s_{i}_{k}") for i, k in pairs]
    names = [f"m_{i}" for i in range(len(NAMES))]
    return close.agg(*means, *spreads).join(targets, "pool").select("pool", "cutoff", *names, *regular)


def assess(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`row`, the statistics, base_failed, d2 (null for base_failed and small pools) and kept."""
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    stats = settle(statistics(docs, columns).withColumn("base_failed", base_failed), "statistics")
    values = [F.when(~F.col("base_failed"), F.expr(f)).alias(n) for n, f in FEATURES.items()]
    passed = stats.filter(~F.col("base_failed"))
    pools = settle(_pools(passed), "pools")
    on = F.col("a.lang").eqNullSafe(F.col("p.lang")) & F.col("a.source").eqNullSafe(F.col("p.source"))
    points = settle(passed.alias("a").join(pools.alias("p"), on).select("a.lang", "pool", *values), "points")
    targets = settle(_targets(points, pools), "targets")
    estimates = settle(_start(points, targets), "estimates")
    for _ in range(STEPS):
        estimates = settle(_step(points, estimates, targets), "estimates")
    large = points.groupBy("pool").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS).select("pool")
    estimates = settle(estimates.join(large, "pool"), "estimates")
    every = stats.alias("a").join(pools.alias("p"), on, "left").select("a.*", "pool", *values)
    found = _with_distance(every, estimates)
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= F.col("cutoff"), F.lit(True))).drop("pool", "cutoff", *NAMES)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    return assess(docs).filter("kept").select("row.*")
