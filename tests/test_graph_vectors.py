import random

import numpy as np

from pyspark.sql import functions as F

from codelake import session
from codelake.operators import graph as G
from codelake.operators import vectors as V
from codelake.plans import load_all
from codelake.plans.registry import Tables
from conftest import SMALL, rows


def sweep(nodes, deps):
    """The order by repeated alphabetical sweeps."""
    out, left = [], sorted(nodes)
    moved = True
    while moved:
        moved = False
        for n in left:
            if n not in out and deps.get(n, set()) <= set(out):
                out.append(n)
                moved = True
    return out, [n for n in left if n not in out]


def test_order_equals_sweeps(spark):
    rnd = random.Random(2)
    nodes = [f"n{i:02d}" for i in range(25)]
    deps = {}
    for _ in range(28):
        a, b = rnd.sample(nodes, 2)
        deps.setdefault(a, set()).add(b)
    edges = [(a, b) for a, bs in deps.items() for b in bs]
    got = G.dependency_order(spark.createDataFrame([(n,) for n in nodes], "node string"),
                             spark.createDataFrame(edges + [("n00", "n00"), ("n00", "foreign")], "node string, dep string")).collect()
    order, cyclic = sweep(nodes, deps)
    assert [r.node for r in sorted((r for r in got if not r.cyclic), key=lambda r: (r["pass"], r.node))] == order
    assert sorted(r.node for r in got if r.cyclic) == cyclic


def test_cycle_goes_last(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("Leaf",)], "node string")
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "Leaf")], "node string, dep string")
    assert G.has_cycle(nodes, edges).first()[0] is True
    assert rows(G.cyclic_nodes(nodes, edges)) == [("A",), ("B",)]


def test_orders_of_deep_and_cyclic_graphs(spark):
    """Chains, trees, ladders, rings and what hangs on them, against sweeps; a chain of 300 takes few rounds."""
    rnd = random.Random(7)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(300)] + [(f"d{i + 1:03d}", f"d{i:03d}") for i in range(120)]
    edges += [(f"l{i:02d}", f"l{i + k:02d}") for i in range(20) for k in (1, 2)] + [(f"t{i:03d}", f"t{(i - 1) // 2:03d}") for i in range(1, 80)]
    edges += [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("q1", "r3"), ("q2", "q1"), ("q2", "t001"), ("k1", "k2"), ("k2", "k1"), ("k2", "k3"), ("k3", "k1")]
    for _ in range(6):
        names = [f"x{_}{i:02d}" for i in range(20)]
        edges += [tuple(rnd.sample(names, 2)) for _ in range(24)]
    nodes = sorted({x for e in edges for x in e})
    deps = {}
    for a, b in edges:
        deps.setdefault(a, set()).add(b)
    frame = spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "node string, dep string")
    written, G.checkpoint = [], lambda df, plain=G.checkpoint: written.append(1) or plain(df)
    try:
        got = G.dependency_order(*frame).collect()
    finally:
        G.checkpoint = session.checkpoint
    order, cyclic = sweep(nodes, deps)
    assert [r.node for r in sorted((r for r in got if not r.cyclic), key=lambda r: (r["pass"], r.node))] == order
    assert sorted(r.node for r in got if r.cyclic) == cyclic and cyclic
    assert len(written) < 3 * 26


def test_closure_of_a_long_chain_takes_few_rounds(spark):
    n = 1000
    df = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    written, G.checkpoint = [], lambda df, plain=G.checkpoint: written.append(1) or plain(df)
    try:
        got = G.closure(df, spark.createDataFrame([(0,), (990,)], "src bigint"))
    finally:
        G.checkpoint = session.checkpoint
    assert rows(got) == sorted([(0, k) for k in range(n + 1)] + [(990, k) for k in range(990, n + 1)], key=repr)
    assert len(written) <= 2 + 2 * 11


def test_components_and_clusters(spark):
    edges = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)] + [("x", "y"), ("y", "z"), ("s", "s")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = dict(rows(G.components(df)))
    assert got == {**{f"c{i:02d}": "c00" for i in range(13)}, "x": "x", "y": "x", "z": "x"}
    files = spark.createDataFrame([(n, n if n < "x" else "f" + n) for n in got], "node string, path string")
    assert [(r.component, r.files) for r in G.clusters(df, files).collect()] == [("x", ["fx", "fy", "fz"])]


def test_closure_ends_on_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    starts = spark.createDataFrame([("d",), ("q",)], "src string")
    assert rows(G.closure(df, starts)) == [("d", "a"), ("d", "b"), ("d", "c"), ("d", "d"), ("q", "q")]


def test_ann_recall_and_query_blocks(spark):
    t = Tables(spark, SMALL)
    q = t.chunks.filter(F.col("vec_id") < 60).select(F.col("vec_id").alias("query_id"), "embedding")
    types = ["DOCUMENTATION", "SOURCE_CODE"]
    exact = set(rows(V.vector_topk(q, t.chunks, 5, types, "p1"), "query_id", "vec_id"))
    assert exact == set(rows(V.vector_topk(q, t.chunks, 5, types, "p1", block=20), "query_id", "vec_id"))
    near = set(rows(V.ann_topk(q, t.chunks, 5, nlist=8, nprobe=4, types=types, project="p1"), "query_id", "vec_id"))
    assert len(exact & near) / len(exact) > 0.6
    full = set(rows(V.ann_topk(q, t.chunks, 5, nlist=8, nprobe=8, types=types, project="p1"), "query_id", "vec_id"))
    assert full == exact


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    QUERIES = load_all().QUERIES
    text = plan(QUERIES["flt2_time_range"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text and "props" not in text
    text = plan(QUERIES["flt5_summary_view"](spark, SMALL))
    assert "text:string" not in text
    # Ranked selections keep their few rows per key before the shuffle.
    assert "WindowGroupLimit" in plan(QUERIES["wn7_retry_context"](spark, SMALL))
    for name in ("wn8_failure_streak", "jn15_match_paths", "jn3_prefix_lookup", "cp4_search", "wn13_rolling_failure"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def recall(spark, rows_, queries, k=10, nlist=32, nprobe=8):
    df = spark.createDataFrame(rows_, "vec_id bigint, doc_type string, project_id string, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id bigint, embedding array<float>")
    cells = V.build_cells(df, nlist)
    exact = set(rows(V.vector_topk(q, cells, k, ["D"]), "query_id", "vec_id"))
    near = set(rows(V.ann_topk(q, cells, k, nlist, nprobe, ["D"]), "query_id", "vec_id"))
    return cells, q, exact, len(exact & near) / max(1, len(exact))


def test_stored_cells(spark):
    """Exact search equals numpy, approximate recall is at least 0.9, crowded cells and many queries are dealt out."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = (centres[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors[:5] = 0
    vectors[5:9] = vectors[9]
    kept = [(k, "D" if k % 3 else "E", "p" if k % 7 == 0 else None, v.tolist()) for k, v in enumerate(vectors)] + [(9000, "D", None, None)]
    asked = [(k, (vectors[k * 10 + 7] + 0.2 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(200)] + [(500, None), (501, [0.0] * 16)]
    cells, q, exact, share = recall(spark, kept, asked)
    assert share >= 0.9
    seen = np.array([k for k in range(3000) if k % 3 and k % 7 and k >= 5])
    unit = vectors[seen].astype(float) / np.linalg.norm(vectors[seen].astype(float), axis=1, keepdims=True)
    want = set()
    for i, v in asked[:200]:
        s = unit @ (np.array(v) / np.linalg.norm(v))
        want |= {(i, int(seen[j])) for j in np.lexsort((seen, -s))[:10]}
    assert len(exact) == 2000 and len(exact ^ want) <= 4  # ties by rounding
    every = set(rows(V.ann_topk(q, cells, 10, 32, 32, ["D"]), "query_id", "vec_id"))
    assert every == exact
    sliced, V.SLICE_ROWS = V.SLICE_ROWS, 20
    try:
        assert set(rows(V.vector_topk(q, cells, 10, ["D"], block=3), "query_id", "vec_id")) == exact
    finally:
        V.SLICE_ROWS = sliced
    few = V.vector_topk(q, cells, 10, ["D", "E"], "p")
    assert few.count() == 2000
    assert set(rows(V.vector_topk(q, V.open_cells(spark, cells.path), 10, ["D"]), "query_id", "vec_id")) == exact
    more = spark.createDataFrame([(7000 + k, "D", None, v) for k, (_, v) in enumerate(asked[:3])], "vec_id bigint, doc_type string, project_id string, embedding array<float>")
    best = rows(V.vector_topk(q, cells.add(more), 1, ["D"]).filter("query_id < 3"), "query_id", "vec_id")
    assert best == [(0, 7000), (1, 7001), (2, 7002)]


def test_search_reads_only_probed_cells(spark):
    t = Tables(spark, SMALL)
    cells = V.build_cells(t.chunks, 16)
    q = t.chunks.filter("vec_id = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = V.ann_topk(q, cells, 5, 16, 2, ["DOCUMENTATION", "SOURCE_CODE"])
    hits.collect()
    text = plan(hits)
    assert "dynamicpruning" in text and "PartitionFilters: [isnotnull(cell" in text
    assert "PushedFilters: [In(doc_type" in text


def test_no_neighbours_without_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, doc_type string, project_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    assert V.vector_topk(q, df, 3, ["D"]).count() == 0
