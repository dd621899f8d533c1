import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxweave.functions.money import grouped_label, vat_inside


def by_integers(c, percent=7):
    size = (2 * percent * abs(c) + 100 + percent) // (2 * (100 + percent))
    return -size if c < 0 else size


@given(st.integers(min_value=-(10**11), max_value=10**11))
def test_rule_equals_the_float_formula(c):
    baht = c / 100
    assert by_integers(c) == round(round(baht * 0.07 / 1.07, 2) * 100)


def test_column_equals_the_rule(spark):
    random.seed(7)
    amounts = [0, 1, -1, 107, -107, 10**15] + [random.randint(-(10**12), 10**12) for _ in range(2000)]
    frame = spark.createDataFrame([(a,) for a in amounts], "c long")
    rows = frame.select("c", vat_inside(F.col("c")).alias("v"), vat_inside(F.col("c"), 10).alias("w")).collect()
    assert all(r.v == by_integers(r.c) and r.w == by_integers(r.c, 10) for r in rows)


def test_grouped_label(spark):
    frame = spark.createDataFrame([(123456,), (-5,), (0,), (100000000,)], "c long")
    assert [r[0] for r in frame.select(grouped_label(F.col("c"))).collect()] == ["1,234.56", "-0.05", "0.00", "1,000,000.00"]
