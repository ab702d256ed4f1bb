import itertools
import random

import numpy as np

from pagemill.operators.diff import diff_copies, min_cost_assignment

DDL = "k long, kind string, n int, cells array<array<string>>, at timestamp, extra string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def make(spark, data):
    return spark.createDataFrame([(*r, None, "x") if len(r) == 4 else (*r, "x") for r in data], DDL)


def run(spark, a, b, **kw):
    return rows(diff_copies(make(spark, a), make(spark, b), ["k", "kind"], ["n"], "cells", **kw))


def test_assignment_matches_brute_force():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (2, 4), (4, 2), (5, 5), (3, 6)]:
        for _ in range(20):
            c = rng.integers(0, 5, (n, m)).astype(float)
            got = min_cost_assignment(c)
            assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m)
            small = c if n <= m else c.T
            best = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
            assert sum(c[i, j] for i, j in got) == best


def test_fields_nulls_and_missing(spark):
    a = [(1, "x", 3, [["a", None], ["b"]]), (2, "x", None, None), (None, "x", 1, [["q"]]), (4, None, 1, [["a"]])]
    b = [(1, "x", None, [["a", "c"], ["B", "z"], ["w"]]), (2, "x", None, [["a"]]), (None, "x", 1, [["q"]]), (5, "x", 1, [])]
    assert run(spark, a, b) == sorted([(1, "x", "cell", 0, 1), (1, "x", "cell", 1, 0), (1, "x", "cells_shape", -1, -1), (1, "x", "n", -1, -1), (2, "x", "cells_shape", -1, -1), (4, None, "only_a", -1, -1), (5, "x", "only_b", -1, -1)], key=repr)


def test_code_points_count(spark):
    assert run(spark, [(1, "x", 1, [["é"]])], [(1, "x", 1, [["é"]])]) == [(1, "x", "cell", 0, 0)]


def test_empty_copies(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "x", 1, None), (1, "x", 1, None), (1, "x", 2, None)], []) == [(1, "x", "only_a", -1, -1)]


def test_multiplicity_and_assignment(spark):
    a = [(1, "x", 1, [["a"]])] * 2 + [(1, "x", 2, [["b", "c"]]), (1, "x", 3, [["d", "e"]])]
    b = [(1, "x", 1, [["a"]]), (1, "x", 3, [["d", "f"]]), (1, "x", 9, [["b", "c"]])]
    assert run(spark, a, b) == sorted([(1, "x", "extra_a", -1, -1), (1, "x", "cell", 0, 1), (1, "x", "n", -1, -1)], key=repr)


def test_latest_counts_and_repeats_do_not(spark):
    from datetime import datetime as t

    a = [(1, "x", 1, None, t(2020, 1, 1)), (1, "x", 5, None, t(2020, 1, 2)), (1, "x", 5, None, t(2020, 1, 2)), (1, "x", 7, None, None)]
    b = [(1, "x", 5, None, t(2021, 1, 1)), (1, "x", 1, None, t(2020, 1, 1))]
    assert run(spark, a, b, latest_by="at") == []
    twice = [(1, "x", 6, [["q"]], t(2022, 1, 1))] * 2
    assert run(spark, a + [(1, "x", 7, [["p"]], t(2022, 1, 1))] * 2, b + twice, latest_by="at") == [(1, "x", "cell", 0, 0), (1, "x", "n", -1, -1)]


def test_large_group_pairs_everything(spark):
    random.seed(5)
    a = [(1, "x", i, [[str(i)]]) for i in range(120)]
    b = [(1, "x", i, [[str(i) if i % 3 else "new"]]) for i in range(100)]
    random.shuffle(b)
    exact, spread = run(spark, a, b, small_group=1000), run(spark, a, b, small_group=5)
    count = lambda got: {k: sum(r[2] == k for r in got) for k in ("cell", "n", "extra_a", "extra_b")}
    assert count(exact) == {"cell": 34, "n": 0, "extra_a": 20, "extra_b": 0}
    assert count(spread)["extra_a"] == 20 and count(spread)["extra_b"] == 0 and count(spread)["cell"] >= 34


def cost(p, q):
    g = lambda x, y: int((x is None) != (y is None)) if x is None or y is None else abs(len(x) - len(y)) + sum(abs(len(u) - len(v)) + sum(s != t for s, t in zip(u, v)) for u, v in zip(x, y))  # noqa: B905, E731
    return int(p[2] != q[2]) + g(p[3], q[3])


def test_nulls_in_keys_and_fields_against_brute_force(spark):
    rng = random.Random(11)
    draw = lambda: (rng.choice([None, 1]), rng.choice([None, "x", "y"]), rng.choice([None, 1, 2]), rng.choice([None, [["a", None]], [[None, "a"]], [["b", "c"]]]))
    for _ in range(4):
        a, b = [draw() for _ in range(24)], [draw() for _ in range(22)]
        got = run(spark, a, b)
        want = 0
        for key in {r[:2] for r in a + b}:
            x, y = [r for r in a if r[:2] == key], [r for r in b if r[:2] == key]
            for r in list(x):
                if r in y:
                    x.remove(r)
                    y.remove(r)
            mine = [r for r in got if tuple(r[:2]) == key]
            if not [r for r in a if r[:2] == key] or not [r for r in b if r[:2] == key]:
                assert len(mine) == 1 and mine[0][2] in ("only_a", "only_b")
                continue
            assert sum(r[2] in ("extra_a", "extra_b") for r in mine) == abs(len(x) - len(y))
            c = np.array([[cost(p, q) for q in y] for p in x], float).reshape(len(x), len(y))
            least = sum(c[i, j] for i, j in min_cost_assignment(c))
            grid_null = sum(r[2] == "cells_shape" for r in mine)  # here shapes differ only where one is null
            assert sum(r[2] in ("n", "cell") for r in mine) + grid_null == least


def test_rows_are_not_paired_across_null_keys(spark):
    a, b = [(1, None, 1, None), (None, "1", 2, None)] * 2, [(1, None, 2, None), (None, "1", 1, None)] * 2
    assert [r[2] for r in run(spark, a, b)] == ["n"] * 4


def test_hot_key_stays_near_the_least_total(spark):
    rng = random.Random(3)
    a = [(1, "x", i, [[str(rng.random()), str(rng.random())], ["u", "v"]]) for i in range(300)]
    b = [(k, x, n + (rng.random() < 0.1) * 1000, [[c if rng.random() > 0.1 else "z" for c in r] for r in g]) for k, x, n, g in a]
    rng.shuffle(b)
    assert run(spark, a, b, small_group=1000) == run(spark, a, b, small_group=25)  # copies with damage: the least total
    a, b = ([(1, "x", rng.randint(0, 40), [[rng.choice("abcdefgh"), rng.choice("abcdefgh")]]) for _ in range(200)] for _ in range(2))
    exact, spread = run(spark, a, b, small_group=1000), run(spark, a, b, small_group=25)
    assert len(exact) <= len(spread) <= 1.7 * len(exact)  # rows without any counterpart: above it


def test_group_of_thousands(spark):
    a = [(1, "x", i, [[str(i), "k"]]) for i in range(5000)]
    b = [(1, "x", i, [[str(i), "k" if i % 2 else "j"]]) for i in range(5000)]
    assert {(r[2], *r[3:]) for r in run(spark, a, b)} == {("cell", 0, 1)} and len(run(spark, a, b)) == 2500


def test_many_fields_need_few_rounds():
    from pagemill.operators.diff import _agreeing

    assert len(_agreeing(["a", "b", "c"])) == 6 and len(_agreeing([str(i) for i in range(12)])) == 24
