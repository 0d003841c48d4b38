"""Nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm.neighbours import nearest_neighbours
from ledgerlight.llm.queries import op13_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, rank string, score int"
ASKS = "vec_id % 20 = 0"


def exact(rows, k=20):
    """query_id -> [(vec_id, score)], all candidates tried; rows are (id, vector) of usable vectors."""
    ids = np.array([i for i, _ in rows])
    v = np.array([np.array(x, dtype=np.float32) for _, x in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], "x", 1) for i, x in rows], SCHEMA).repartition(3)


def test_recall_of_descent_and_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 24))
    rows = [(i, (centres[i % 8] + rng.normal(size=24)).astype(np.float32)) for i in range(3000)]
    want = exact(rows)
    got = result(nearest_neighbours(table(spark, rows), F.expr(ASKS), block=128, deals=4, beam=80, opened=32))
    assert recall(got, want) >= 0.95
    assert all(len(x) == 20 for x in got.values()) and len(got) == 150
    near = {q: dict(w) for q, w in want.items()}
    assert all(s == pytest.approx(near[q][i], abs=1e-9) for q, x in got.items() for i, s in x if i in near[q])


def test_a_third_of_near_copies(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=16)
    rows = [(i, hot + rng.normal(size=16) * 0.01 if i % 3 == 0 else rng.normal(size=16)) for i in range(1500)]
    rows = [(i, x.astype(np.float32)) for i, x in rows]
    assert recall(result(nearest_neighbours(table(spark, rows), F.expr(ASKS), block=64, deals=6)), exact(rows)) >= 0.9


def test_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1, 0, 0, 0]) for i in range(0, 400)] + [(i, rng.normal(size=4).astype(np.float32) * 0.1) for i in range(400, 500)]
    want = exact(rows)
    got = result(nearest_neighbours(table(spark, [*rows, rows[0], rows[40]]), F.expr(ASKS)))
    assert {q: [i for i, _ in x] for q, x in got.items() if q < 400} == {q: [i for i, _ in x] for q, x in want.items() if q < 400}
    assert recall(got, want) == 1


def test_odd_vectors_take_no_part(spark):
    good = [(i, [i + 1, 1]) for i in range(0, 45, 5)]
    odd = [(60, None), (80, []), (100, [0, 0]), (120, [1, None]), (140, [float("nan"), 1]), (160, [float("inf"), 1]), (180, [1, 2, 3]), (None, [1, 2])]
    got = result(nearest_neighbours(table(spark, good + odd), F.expr(ASKS)))
    want = exact(good)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(len(x) == 8 for x in got.values())


def test_few_rows(spark):
    assert nearest_neighbours(table(spark, []), F.expr(ASKS)).count() == 0
    assert nearest_neighbours(table(spark, [(20, [1, 2])]), F.expr(ASKS)).count() == 0
    assert result(nearest_neighbours(table(spark, [(20, [1, 2]), (21, [1, 2])]), F.expr(ASKS))) == {20: [(21, 5.0)]}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = op13_nearest_neighbours(spark, sf)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert recall(result(got), exact(rows)) >= 0.95
