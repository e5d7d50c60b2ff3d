import numpy as np

from heddle.llm import bloom


def test_never_misses_and_rarely_errs(spark):
    random = np.random.default_rng(3)
    inside, outside = random.integers(-(2**63), 2**63, 5_000), random.integers(-(2**63), 2**63, 5_000).view(np.uint64)
    hashes = spark.createDataFrame([(int(x),) for x in inside], "h long")
    for most, share in ((30, 0.001), (16, 0.1), (11, 1.0)):
        made = bloom.of(hashes, "h", most)
        assert made.power <= most and made.may_hold(inside.view(np.uint64)).all()
        assert made.may_hold(outside).mean() <= share
    assert made.may_hold(outside).mean() > 0.9  # full


def test_of_nothing(spark):
    assert not bloom.of(spark.createDataFrame([], "h long"), "h").may_hold(np.arange(1, 9, dtype=np.uint64)).any()
