"""Boosted trees: splits and contributions against brute force, nulls and categories, and what is done with a model."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.operators import boosting


def gain(rows, left, l2):
    part = lambda keep: sum(g for g, _, k in rows if keep(k)) ** 2 / (sum(h for _, h, k in rows if keep(k)) + l2)
    return part(lambda k: k in left) + part(lambda k: k not in left) - part(lambda k: True)


@pytest.mark.parametrize("seed", range(6))
def test_splits_against_all_splits(seed):
    """Rows with a bin each (4 is missing): for a number all prefixes of bins with and without what is missing, for a category all sets."""
    r = random.Random(seed)
    rows = [(r.gauss(0, 1), r.uniform(0.1, 1), r.randrange(5 if seed % 2 else 4)) for _ in range(30)]
    sums = np.zeros((3, 1, 5))
    for g, h, k in rows:
        sums[:, 0, k] += (g, h, 1)
    numbers = [set(range(k + 1)) | extra for k in range(4) for extra in (set(), {4})]
    sets = [set(c) for n in range(1, 5) for c in itertools.combinations(range(5), n)]
    for category, l2, ways in ((False, 1.0, numbers), (True, 0.0, sets)):
        want = max(gain(rows, left, l2) for left in ways if 0 < sum(k in left for *_, k in rows) < len(rows))
        got, f, goes = boosting.best_split(*sums, np.array([category]), l2, 1)
        left = {k for k in range(5) if goes[k]}
        assert f == 0 and math.isclose(got, want) and math.isclose(gain(rows, left, l2), want)
    assert boosting.best_split(*sums, np.array([False]), 1.0, 16) is None  # no side would have half of the rows and one more


def expected(tree, codes, known, node=0):
    """A tree's value where only the known features tell the way; elsewhere the children's shares of the rows."""
    if tree.feature[node] < 0:
        return tree.value[node]
    f, children = tree.feature[node], (tree.left[node], tree.right[node])
    if f in known:
        return expected(tree, codes, known, children[not tree.goes_left[node][codes[f]]])
    return sum(tree.cover[c] / tree.cover[node] * expected(tree, codes, known, c) for c in children)


def test_contributions_against_all_subsets():
    rng, width, bins = np.random.default_rng(1), 4, 5
    trees = []
    for _ in range(3):
        tree, open_ = boosting.Tree(), [0]
        tree.cover[0] = 1000.0
        for _ in range(4):  # features come again on the way
            deeper = []
            for node in open_:
                share = rng.uniform(0.2, 0.8) * tree.cover[node]
                deeper += tree.split(node, int(rng.integers(width)), rng.random(bins + 1) < 0.5, [(rng.normal(), share), (rng.normal(), tree.cover[node] - share)])
            open_ = deeper[: len(deeper) - 1]
        trees.append(tree)
    model = boosting.BoostedTrees([f"c{i}" for i in range(width)], {}, {}, bins, 0.3, trees)
    codes = rng.integers(0, bins + 1, (20, width)).astype(np.uint8)
    phi = model.contributions(codes)
    for row, own in zip(codes, phi, strict=True):
        for f in range(width):
            rest = [x for x in range(width) if x != f]
            want = sum(math.factorial(n) * math.factorial(width - n - 1) / math.factorial(width) * sum(expected(t, row, {*s, f}) - expected(t, row, set(s)) for t in trees) for n in range(width) for s in itertools.combinations(rest, n))
            assert abs(own[f] - want) < 1e-9
    assert np.allclose(phi.sum(axis=1) + model.expected(), model.margin(codes), atol=1e-9)


@pytest.fixture(scope="module")
def vehicles(spark):
    """A breakdown shows in low voltage, in no voltage at all, and in two of six makers; in nothing else."""
    r = random.Random(4)
    rows = []
    for i in range(3000):
        volts, maker, heat = r.choice([None, float("nan"), *[r.uniform(9, 15)] * 4]), r.choice("abcdef"), r.random()
        odds = (volts is None or volts != volts) * 2 + (volts is not None and volts < 11) * 2 + (maker in "be") * 1.5 - 2.5
        rows.append((i, volts, maker if r.random() > 0.05 else None, heat, int(r.random() < 1 / (1 + math.exp(-odds))), i % 3 == 0))
    return spark.createDataFrame(rows, "id long, volts double, maker string, heat double, y int, held boolean").repartition(4)


COLUMNS = ["volts", "maker", "heat"]


def test_what_is_missing_tells(spark, vehicles, tmp_path):
    model = boosting.fit(vehicles, COLUMNS, "y", ["maker"], held="held", iterations=30)
    assert [c for c, _ in boosting.gain_ranking(model)][:2] in (["volts", "maker"], ["maker", "volts"])
    test = vehicles.where("held")
    told = boosting.scored(test, model).select("volts", "maker", "y", (1 / (1 + F.exp(-F.col("margin")))).alias("p")).collect()
    assert rank_area([(r.p, r.y) for r in told]) > 0.75
    gone = lambda r: r.volts is None or r.volts != r.volts
    for some in ([r for r in told if gone(r)], [r for r in told if not gone(r) and r.volts > 11], [r for r in told if r.maker in ("b", "e")]):
        assert len(some) > 100 and abs(np.mean([r.p for r in some]) - np.mean([r.y for r in some])) < 0.06
    model.save(f"{tmp_path}/m")
    again = boosting.BoostedTrees.load(f"{tmp_path}/m")
    want = {r.id: r.margin for r in boosting.scored(test, model).select("id", "margin").collect()}
    told = boosting.explained(test, again).collect()
    assert all(abs(sum(r.contributions) + again.expected() - want[r.id]) < 1e-9 for r in told) and len(told) == len(want)
    assert all(not {x.feature for x in r.factors} - set(COLUMNS) and all(x.contribution >= 0 for x in r.factors) and len(r.factors) <= 2 for r in boosting.factors(test, again, 2).collect())


def rank_area(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_models_of_nothing(spark, vehicles):
    for rows, base in ((vehicles.where("y = 0"), -30.0), (vehicles.where("y = 1"), 30.0), (vehicles.limit(0), -30.0)):
        model = boosting.fit(rows, COLUMNS, "y", ["maker"])
        assert not model.trees and model.base == base and {r.margin for r in boosting.scored(vehicles.limit(5), model).collect()} == {base}
    odd = spark.createDataFrame([(1, None, "never seen", None), (2, float("inf"), None, -1e300)], "id long, volts double, maker string, heat double")
    model = boosting.fit(vehicles, COLUMNS, "y", ["maker"], iterations=9)  # margins are written anew after eight trees
    assert len(model.trees) == 9 and boosting.scored(odd, model).where("margin is null").count() == 0 and boosting.scored(odd.limit(0), model).count() == 0


def test_training_rows_are_made_once(spark, sf, monkeypatch):
    """The passes of the training read written rows, not the events with all that makes features and splits of them."""
    from roadloom.operators import learning
    from roadloom.plans import learning as plans

    read = []
    train = learning.train_risk
    monkeypatch.setattr(learning, "train_risk", lambda features, *a, **k: read.extend(features.inputFiles()) or train(features, *a, **k))
    assert plans.risk_scores_trained(spark, sf).count() and read and not any("events" in f for f in read)


def test_held_rows_end_the_training(spark, sf, monkeypatch):
    """The queries' trainings go on until the held rows gain no more, or as far as the original's would, not for a handful of trees."""
    from roadloom.operators import learning
    from roadloom.plans import learning as plans
    from roadloom.plans import service

    asked = []
    fit = boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda *a, **k: asked.append((k["iterations"], k["patience"])) or fit(*a, **{**k, "iterations": 1}))
    for q in (plans.risk_scores_trained, service.scoring_run_scores, service.feature_gains):
        q(spark, sf)
    assert asked == [(450, 23)] * 3


def test_equal_rows_are_one_row_with_a_weight(spark, vehicles):
    """Three copies of each row, with three times the bounds, give the trees of the rows alone."""
    thrice = vehicles.crossJoin(spark.range(3).select(F.lit(1)))
    one = boosting.fit(vehicles, COLUMNS, "y", ["maker"], held="held", iterations=3)
    three = boosting.fit(thrice, COLUMNS, "y", ["maker"], held="held", iterations=3, l2=3.0, least_rows=15)
    assert one.edges == three.edges and [t.feature for t in one.trees] == [t.feature for t in three.trees] and [t.goes_left for t in one.trees] == [t.goes_left for t in three.trees]
    for a, b in zip(one.trees, three.trees, strict=True):
        assert np.allclose(a.value, b.value) and np.allclose(np.array(a.cover) * 3, b.cover)


def test_group_of_a_key(spark):
    """The hash as a number, for groups that divide a power of 16 and others, and null for null."""
    import hashlib

    from roadloom.functions.hashing import sha_group

    rows = spark.range(50).select("id", *[sha_group(F.col("id"), g).alias(f"g{g}") for g in (7, 10, 16, 1000003)], sha_group(F.nullif(F.col("id"), F.col("id"))).alias("none"))
    for r in rows.collect():
        h = int(hashlib.sha256(str(r.id).encode()).hexdigest(), 16)
        assert (r.g7, r.g10, r.g16, r.g1000003, r.none) == (h % 7, h % 10, h % 16, h % 1000003, None)
