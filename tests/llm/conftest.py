import random

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
CLASHING = ["row", "found", "words", "lines", "block", "kind", "hash", "n", "score", "spans", "candidates", "pool", "whole", "region", "id"]


def odd_rows():
    """Nulls, empty and short texts, ties, repeated rows, one row of a long text, and all kinds of personal data."""
    pick = random.Random(7)
    vocabulary = ["the", "of", "and", "Überfall", "x", "naïve", "end.", "a,b", "word"] + [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    long, base = text(6000), text(120).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (10, 60, 100)]
    passage = text(60)
    rows = [None, "", " \t\n", "one", "one", "ONE", "a b c d", "a b c d", "a b c d e", "a  b\tc\nd e f", long, long, " ".join(base), *near]
    rows += [f"{text(30)} {passage} {text(20)}", f"{passage}\n{passage}", "same " * 80, "line one\nline one\nline two\n\n \nline one"]
    rows += [
        "mail a.b@c.de.fr, x@y.z@q.w.e and (at) joe (at) mail (dot) com", "1.2.3.4 1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.0",
        "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 40, "+1 (743) 555-3824 +12 +49 30 1234567-- call 743-555-3824 now", "@" * 50 + "a@b" * 9,
        "# * $ % & | < > " * 10, "é    x\u0085y \U0001f600 " * 6,
    ]
    return [(100_000 + k, t) for k, t in enumerate(rows)] + [(None, "no id here at all in this row"), (None, None), (100_000, None), (100_010, long)]


@pytest.fixture(scope="session")
def odd(spark):
    """Some documents of the tables with the odd rows, and columns of all clashing names."""
    rows = spark.createDataFrame([(i, t, None if i is None else "xx", "odd", 0) for i, t in odd_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("doc_id < 60").union(rows)
    return docs.select("*", *[F.lit(n).alias(n) for n in CLASHING]).cache()


@pytest.fixture(scope="session")
def plain(odd):
    return [tuple(r) for r in odd.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
