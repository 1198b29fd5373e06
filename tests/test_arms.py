"""Arms on planted features: what is new and useful shows, noise does not, and all arms see the same rows."""

import numpy as np
import pytest

from tidegauge.operators import arms

SMALL = {"model": "M2", "trees": 10, "depth": 4}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(3000):
        a, b, noise = rng.normal(size=3)
        ret = 0.01 * (a + 2 * b) + rng.normal(0, 0.005)
        rows.append((k, float(a), float(b) if k % 50 else None, float(noise), float(ret), float(ret > 0.003)))
    d = spark.createDataFrame(rows, "id long, a double, b double, noise double, l2 double, l1 double")
    return d.filter("id < 2000"), d.filter("id >= 2000")


def test_new_feature_adds_value(planted):
    got = {r.arm: r for r in arms.incremental(*planted, ["a"], ["b"], "l1", "l2", "id", 0.003, reps=200, **SMALL).collect()}
    assert {r.n_test for r in got.values()} == {980}  # rows without b are left out of every arm
    assert (got["BASE"].n_features, got["NEW"].n_features, got["FULL"].n_features) == (1, 1, 2)
    assert got["FULL"].delta_lo > 0 and got["FULL"].passed and got["BASE"].delta_mean is None and not got["BASE"].passed
    assert all(0 <= r.least <= r.most <= 1 for r in got.values())


def test_noise_adds_none(planted):
    got = {r.arm: r for r in arms.incremental(*planted, ["a"], ["noise"], "l1", "l2", "id", 0.003, reps=200, **SMALL).collect()}
    assert not got["NEW"].passed and not got["FULL"].passed and got["FULL"].n_test == 1000


def test_leave_one_out(planted):
    train, test = planted

    def features(stay):
        return tuple(d.withColumn("x", d["b"] if "good" in stay else d["noise"]) for d in (train, test))

    got = {r.left_out: r for r in arms.leave_one_out(["good", "bad"], features, ["a"], ["x"], "l1", "l2", "id", 0.003, **SMALL).collect()}
    assert set(got) == {"good", "bad"} and got["bad"].pss > got["good"].pss


def test_nothing_to_learn_from(planted):
    train, test = planted
    assert arms.incremental(train.filter("l1 = 0"), test, ["a"], ["b"], "l1", "l2", "id", 0.003, reps=20, **SMALL).collect() == []
