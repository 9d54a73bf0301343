from fractions import Fraction

import numpy as np
import pytest

from factlake.llm import bit_whitening as bw
from factlake.llm.queries import op13_bit_whitening

SF = "/root/testdata/sf0.01"
NAMES = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(vectors):
    """Everything with Python integers and one dense covariance."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(dim)]
    d = [[n * r[i] - s[i] for i in range(dim)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n ** 3)) for j in range(dim)] for i in range(dim)])
    return n, d, v


def same(rows, vectors, ids, k=8):
    n, d, v = plain(vectors)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, len(values))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * k
    w = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    own = np.array(d, dtype=float) / n @ axes[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        sign = np.sign((own[:, c] * w[:, c]).sum())
        assert np.abs(own[:, c] * sign - w[:, c]).max() < 1e-6
    for i, line in zip(ids, d, strict=True):
        r = got[i, 1]
        assert r.n == n and int(r.deviation) == sum(a * a for a in line)
    assert [got[ids[0], c + 1].explained for c in range(k)] == pytest.approx(values[:k] / np.trace(v), rel=1e-9)
    error = {r.identity_error for r in rows}
    assert len(error) == 1 and error.pop() < 1e-9
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-9


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = op13_bit_whitening(spark, SF)
    assert got.columns == ["vec_id", *NAMES, "deviation_exact"] and dict(got.dtypes)["deviation"] == "bigint"
    same(got.collect(), [r.embedding for r in table], [r.vec_id for r in table])


def test_cases(spark):
    rng = np.random.default_rng(8)
    nan, inf = float("nan"), float("inf")
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, [1.0, 2.0, 3.0]), (42, [1.0, 2.0, 3.0]), (43, [-90.5, 2e3, 1e-9])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [nan, 1.0, 2.0]), (53, [inf, 1.0, 2.0]), (54, [1.0, -inf, 2.0]), (55, [1.0]), (56, [])]
    df = spark.createDataFrame([(*r, "x", [1.5]) for r in good + bad], "vec_id long, embedding array<double>, v string, k0 array<double>")
    rows = bw.whiten(df, ["vec_id", "v", "k0"], "embedding").collect()
    assert {(r.v, tuple(r.k0)) for r in rows} == {("x", (1.5,))}
    same(rows, [v for _, v in good], [i for i, _ in good])
    assert bw.whiten(df.filter("vec_id >= 50 AND vec_id <> 55 AND vec_id <> 56"), ["vec_id"], "embedding").count() == 0
    assert bw.whiten(df.filter("false"), ["vec_id"], "embedding").count() == 0
    with pytest.raises(ValueError):
        bw.whiten(df.withColumnRenamed("v", "whitened"), ["whitened"], "embedding")
    # Repeated rows count each time, also those without an id.
    twice = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = bw.whiten(twice, ["vec_id"], "embedding").collect()
    assert len(rows) == 6 and {r.n for r in rows} == {3} and sum(r.vec_id is None for r in rows) == 4
    assert all(r.whitened == 0 and r.explained == 0 for r in rows if r.component == 2), "on a line there is no second direction"
    one = bw.whiten(twice.filter("vec_id = 1"), ["vec_id"], "embedding").collect()
    assert [(int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(0, 0, 0, 0)] * 2
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    rows = bw.whiten(huge, ["vec_id"], "embedding", 1).collect()
    assert [abs(r.whitened) for r in rows] == pytest.approx([1, 1]) and int(rows[0].deviation) == (2 * 2 ** 53) ** 2 + 1024 ** 2


@pytest.mark.parametrize("top", [1, 2, 37, 10 ** 6, 2 ** 40, 2 ** 54])
def test_products_are_exact(top):
    rng = np.random.default_rng(top % 1000)
    for rows in (1, 63, 64, 65, 300):
        values = rng.integers(0, top, (rows, 5), dtype=np.uint64)
        values[:, 3] = 0
        want = [[sum(int(a) * int(b) for a, b in zip(values[:, i], values[:, j], strict=True)) for j in range(5)] for i in range(5)]
        assert bw.cross_products(values).tolist() == want
        low = rng.integers(-top, top, 5)
        x = values.astype(np.int64) + low
        total = bw.Sums(5)
        total.add(x[:rows // 2 + 1])
        if rows > 1:
            total.add(x[rows // 2 + 1:])
        assert total.cross.tolist() == [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(5)] for i in range(5)]
        assert total.sums.tolist() == [sum(map(int, x[:, i])) for i in range(5)]
    for value in (0, 1, -1, 2 ** 110 + 7, -2 ** 110 - 7):
        assert sum(part << bw.LIMB * m for m, part in enumerate(bw._limbs(value))) == value
