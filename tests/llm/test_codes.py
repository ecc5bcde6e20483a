import hashlib
import math
import random

import numpy as np
import pytest

from authscope.llm.codes import exact_dots, limbs, nearest, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, id string, whole string, code string"


def coded(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    return [tuple(r) for r in vector_codes(df, **options).collect()]


def brute(rows, parts=4, entries=256, rounds=4):
    """The contract in Python integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))
    d = len(whole[0]) // parts
    cut = [[w[p * d : (p + 1) * d] for p in range(parts)] for w in whole]
    books = [[cut[i][p][:] for i in order[:entries]] for p in range(parts)]

    def best(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(best(c[p], books[p])[1], []).append(c[p])
            for e, vs in of.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(x[0] for x in f) for f in found]
    totals = {}
    for r, e in zip(kept, errors, strict=True):
        totals[r[2]] = totals.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [
        (r[0], "".join(f"{x[1]:02x}" for x in f), e, totals[r[2]], sha) for r, f, e in zip(kept, found, errors, strict=True)
    ]


def test_limbs_give_the_number_back():
    v = np.array([0, 1, -1, 4095, 4096, -4096, -4097, 2**40, -(2**40), 2**62, -(2**62)], np.int64)
    for width in (5, 12, 24):
        got = limbs(v, width)
        assert [sum(int(x[i]) << (width * j) for j, x in enumerate(got)) for i in range(len(v))] == v.tolist()
        assert all(np.abs(x).max() < 2**width for x in got)


@pytest.mark.parametrize("bits", [4, 13, 26, 29])
def test_dots_are_exact(bits):
    rng = np.random.default_rng(bits)
    a, b = (rng.integers(-(2**bits), 2**bits, (7, 16)) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert exact_dots(a, b).tolist() == want


def test_ties_go_to_the_lower_entry():
    entry, distance = nearest(np.array([[0, 0], [2, 0]]), np.array([[1, 0], [-1, 0], [1, 0]]))
    assert entry.tolist() == [0, 0] and distance.tolist() == [1, 1]


def test_codes_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], r.choice([None, 0, 1])) for i in range(120)]
    rows += [(200, rows[3][1], 1), (7, rows[4][1], 0), (None, [0.5] * 8, 2)]  # equal vectors, an equal key, no key
    rows += [(300, [100000.0 * r.random() for _ in range(8)], 5), (301, [-0.0001] * 8, 5)]  # several limbs; floors go down
    for entries, rounds in ((16, 4), (256, 2)):
        got = coded(spark, rows, entries=entries, rounds=rounds)
        assert sorted(got, key=repr) == sorted(brute(rows, entries=entries, rounds=rounds), key=repr)


def test_rows_that_cannot_be_coded(spark):
    good = [(i, [float(i), 1.0, 2.0, 3.0], 0) for i in range(5)]
    bad = [
        (10, None, 0),
        (11, [], 0),
        (12, [1.0, None, 2.0, 3.0], 0),
        (13, [1.0, float("nan"), 2.0, 3.0], 0),
        (14, [1.0, float("inf"), 2.0, 3.0], 0),
        (15, [3e38, 0.0, 0.0, 0.0], 0),
        (16, [1.0] * 8, 0),  # another length
        (17, [1.0] * 3, 0),  # no four parts
    ]
    got = coded(spark, good + bad)
    assert sorted(got) == sorted(brute(good))
    assert coded(spark, bad[:6]) == [] and coded(spark, []) == []


def test_order_and_partitions_do_not_matter(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], 0) for i in range(60)]
    df = spark.createDataFrame([(*x, "", "", "") for x in rows], VECTORS)
    one = {tuple(x) for x in vector_codes(df.coalesce(1), entries=8).collect()}
    assert one == {tuple(x) for x in vector_codes(df.repartition(13), entries=8).collect()}
