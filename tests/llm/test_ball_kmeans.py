"""Ball k-means against comparing every vector with every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from graphloom.llm import ball_kmeans

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, seed, dims):
    kept = [(i, np.array([math.floor(1024 * x) for x in v], np.int64)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))
    points, centres = np.array([v for _, v in kept]), np.array([v for _, v in order[:k]])
    apart = lambda: ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        mine = apart().argmin(axis=1)
        for j in range(len(centres)):
            if (mine == j).any():
                centres[j] = points[mine == j].sum(axis=0) // int((mine == j).sum())
    far = apart()
    mine = far.argmin(axis=1)
    own = far[np.arange(len(points)), mine]
    return sorted(((i, int(c), int(d), int(own[mine == c].sum()), int(own.sum()), centres[c].tolist()) for (i, _), c, d in zip(kept, mine, own, strict=True)), key=str)


@pytest.mark.parametrize("kind", ["spread", "ties", "hard"])
def test_equals_plain_k_means(spark, kind):
    rng = random.Random(kind)
    if kind == "spread":
        rows = [(i, [rng.gauss(i % 5, 0.3) for _ in range(6)]) for i in range(300)]
    elif kind == "ties":
        rows = [(i, [float(rng.randint(-1, 1)) for _ in range(6)]) for i in range(200)] + [(i, [0.0] * 6) for i in range(30)]
    else:
        rows = [(1, [0.5] * 6), (1, [0.5] * 6), (2, None), (3, [1.0] * 5), (4, [float("nan")] + [0.0] * 5), (5, [float("inf")] + [0.0] * 5), (6, [None] + [0.0] * 5), (None, [-0.3] * 6), (7, [])]
    got = ball_kmeans.cluster(spark.createDataFrame(rows, SCHEMA), 8, 5, 3, 6)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 8, 5, 3, 6)


def test_empty_and_too_large(spark):
    assert ball_kmeans.cluster(spark.createDataFrame([], SCHEMA), 8, 2, 3, 6).count() == 0
    with pytest.raises(Exception, match="too large"):
        ball_kmeans.cluster(spark.createDataFrame([(1, [1e9] * 6)], SCHEMA), 8, 2, 3, 6)
    clash = spark.createDataFrame([(1, [0.5, 0.25], 3, "n")], "vec_id long, embedding array<float>, cluster_ int, number string")
    assert ball_kmeans.cluster(clash, 2, 2, 3, 2).count() == 1


def test_cores_aren_t_compared():
    """Points near their centroid are compared with no other one, and those in an annulus only with the nearer ones."""
    centres = np.array([[0, 0], [100, 0], [0, 1000]])
    balls = ball_kmeans.Balls(centres, [(60 * 60, 0), (40 * 40, 0), (0, 0)])
    assert [n.tolist() for n, _ in balls.neighbours] == [[1], [], []]
    points = np.array([[10, 0], [50, 0], [51, 0], [60, 0]])
    assert balls.assign(points, np.zeros(4, np.int64))[0].tolist() == [0, 0, 1, 1]
    # On the border the smaller number wins, also where the point comes from the greater one.
    assert balls.assign(np.array([[50, 0]]), np.ones(1, np.int64))[0].tolist() == [1]
    wide = ball_kmeans.Balls(centres, [None, None, None])
    assert wide.assign(np.array([[50, 0]]), np.ones(1, np.int64))[0].tolist() == [0]
