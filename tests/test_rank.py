import math
import random
import statistics

import pytest

from martlib.operators import rank as R


@pytest.mark.parametrize("enough", [1, 7, 100_000])
def test_equals_a_sort(spark, enough):
    r = random.Random(enough)
    frames = [
        [r.gauss(0, 1) for _ in range(500)],
        [r.choice([1.0, 2.0, 5.0]) for _ in range(401)],
        [10.0 ** r.randint(-200, 300) * r.choice([-1, 1]) for _ in range(200)] + [1.7e308, -1.7e308],
        [3.0] * 50,
        [5e-324, 0.0, 1e-323],
        [1.0, 1.0 + 2**-52, 2.0, 4.0],
        [7.0],
    ]
    for values in frames:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "x double").repartition(3)
        assert R.exact_median(df, "x", enough) == statistics.median(values)


def test_nothing_to_rank(spark):
    assert R.exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None
