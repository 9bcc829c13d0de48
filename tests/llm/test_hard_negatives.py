"""Hard negatives against scoring all pairs."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import hard_negatives, queries


def expected(rows, anchors, scale=256, k=5, n=3, low=50, high=95):
    """Rows of (id, vector, label); ``anchors`` says which ids are."""
    whole = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in {(i, tuple(v), y) for i, v, y in whole if anchors(i)}:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in whole if len(w) == len(v)]
        for s, p, _ in sorted(t for t in scored if t[2] == y and t[1] != i)[:k]:
            hard = sorted((t, j) for t, j, z in scored if z != y and low * -s <= 100 * -t <= high * -s)[:n]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(hard, 1)]
    return sorted(out)


def clouds(rng, n, dim, labels=4):
    centres = rng.normal(size=(labels, dim)) + 0.6
    return [(int(i), (centres[i % labels] + rng.normal(size=dim)).astype(np.float32).tolist(), int(i % labels)) for i in range(n)]


def frame(spark, rows):
    clash = "id bigint, dim int, copy string, rank int, anchor string, cell int, _anchor int"
    return spark.createDataFrame([(*r, 1, 2, "c", 4, "a", 5, 6) for r in rows], f"vec_id bigint, embedding array<float>, label int, {clash}")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    made = clouds(rng, 300, 24) + [(1000 + i, v, y) for i, v, y in clouds(rng, 40, 5)]
    made += [(2000 + i, made[i % 3][1], i % 2) for i in range(30)]  # ties
    made += [made[0], made[20], (20, made[21][1], 3), (None, made[1][1], 1), (30, None, 1), (40, made[2][1], None)]
    made += [(50, [float("nan")] * 24, 1), (60, [float("inf")] + [0.0] * 23, 1), (70, [None] * 24, 1), (80, [0.0] * 24, 2), (90, [], 0), (91, [], 1), (92, [], 0), (95, [3.0], 1), (100, [2.0], 1)]
    return made


def results(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, rows, small, monkeypatch):
    if small:
        for name, value in (("ANCHOR_ROWS", 3), ("BLOCK_BYTES", 4096), ("BLOCKS_PER_CELL", 2), ("PAIRS_AT_ONCE", 50)):
            monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.mine(frame(spark, rows).repartition(4), F.col("vec_id") % 10 == 0)
    want = expected(rows, lambda i: i % 10 == 0)
    assert results(got) == want and len(want) > 100


def exchanged(plan):
    """Nodes of an adaptive plan that has run, and the bytes of its exchanges."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return exchanged(plan.executedPlan())
    if name.endswith("QueryStage"):
        return exchanged(plan.plan())
    below = [exchanged(plan.children().apply(i)) for i in range(plan.children().size())]
    return [(name, plan.metrics().apply("dataSize").value() if name == "Exchange" else 0), *(x for b in below for x in b)]


@pytest.mark.parametrize("least", [1, 6])
def test_nothing_is_broadcast_and_blocks_are_sent_for_many_groups(spark, rows, least, monkeypatch):
    """Each block and group is sent to a row or column of cells, by way of no driver; a broadcast would hold every copy there."""
    for name, value in (("ANCHOR_ROWS", 4), ("BLOCK_BYTES", 16384), ("BLOCKS_PER_CELL", 2), ("LEAST_CELLS", least)):
        monkeypatch.setattr(hard_negatives, name, value, raising=False)
    made, keep = {}, hard_negatives.staged

    def stage(df, name):
        made[name] = (df, keep(df, name))
        return made[name][1]

    monkeypatch.setattr(hard_negatives, "staged", stage)
    got = hard_negatives.mine(frame(spark, rows).repartition(2), F.col("vec_id") % 5 == 0)
    assert results(got) == expected(rows, lambda i: i % 5 == 0)
    blocks, anchors = made["vector-blocks"][1], made["anchors"][1]
    block_bytes = sum(sum(map(len, r[2:])) for r in blocks.collect())
    last = exchanged(got._jdf.queryExecution().executedPlan())
    assert anchors.count() > 60 and not any("Broadcast" in name for name, _ in last)
    assert "Broadcast" not in made["anchors-positives"][0]._jdf.queryExecution().executedPlan().toString()
    # Of the 18 groups or more, a block is sent for six or more at once; the anchors are the lesser part.
    assert block_bytes < max(size for _, size in last) < 6 * block_bytes


def test_parameters(spark, rows):
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 25 == 0, scale=10, positives=2, negatives=1, low=20, high=100)
    assert results(got) == expected(rows, lambda i: i % 25 == 0, 10, 2, 1, 20, 100)


def test_empty(spark, rows):
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_too_large():
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.whole_numbers(np.full((1, 4), 1e30), 256)


@pytest.mark.parametrize(("dim", "levels"), [(1, 1), (5, 2), (64, 1), (64, 4), (100, 3), (200, 4)])
def test_scores_lie_in_their_intervals(dim, levels):
    rng = np.random.default_rng(dim)
    rows, anchors = (rng.integers(-400, 400, (n, dim)) * (rng.random((n, dim)) < 0.7) for n in (400, 20))
    low, high = hard_negatives.intervals(hard_negatives.prepare(anchors, levels), hard_negatives.encode(rows, levels))
    exact = anchors @ rows.T
    assert (low <= exact).all() and (exact <= high).all()


def test_levels_narrow_the_intervals():
    rng = np.random.default_rng(1)
    rows, anchors = rng.normal(size=(500, 64)) * 256, rng.normal(size=(20, 64)) * 256
    width = []
    for levels in (1, 2, 4):
        low, high = hard_negatives.intervals(hard_negatives.prepare(anchors, levels), hard_negatives.encode(rows, levels))
        width.append((high - low).mean())
    assert width[2] < 0.45 * width[1] < 0.45 * width[0]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.execute(queries.SQL["op11_hard_negatives"]).fetchall()
    assert results(queries.QUERIES["op11_hard_negatives"](spark, folder)) == sorted(want)
