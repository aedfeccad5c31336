"""Vector retrieval over stored cells, exact and approximate, with provenance.

An index is a folder of inverted lists: every chunk is written under the cell of its
nearest centre with its angle to it.  Centres are fitted on a bounded sample; all rows are
indexed.  Queries are a table too: each is sent to the cells it probes, and cells meet
their queries by an equi-join on (cell, slice, block), so neither side passes the driver
and a crowded cell or a cell that many queries ask is dealt out over tasks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.session import checkpoint, shared_folder

#: Vectors of a cell that one task scores, and queries that it scores them for.
SLICE_ROWS, MAX_QUERIES = 16_384, 1024
#: Rows that centres are fitted on, and the most bytes of centres; both bound what the driver holds.
SAMPLE_ROWS, CENTRE_BYTES = 20_000, 64 << 20
#: A cell's rows are numbered 0..SALTS-1 by hash, which allows as many slices.
SALTS = 1 << 16
#: Rounding of two cosines that would be equal.
EPSILON = 1e-9


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, np.nan, norm)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def visible(chunks: DataFrame, types: Sequence[str], project: str | None) -> DataFrame:
    """Chunks of the given types that are shared or belong to the project."""
    mine = F.col("project_id").isNull()
    if project is not None:
        mine = mine | (F.col("project_id") == project)
    return chunks.filter(F.col("doc_type").isin(list(types)) & mine)


# ---- the index -------------------------------------------------------------------------


def fit_centres(vectors: np.ndarray, nlist: int, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """Unit centres of at most ``nlist`` cells over unit rows, by spherical k-means."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(vectors, axis=0)
    centres = distinct[rng.choice(len(distinct), min(nlist, len(distinct)), replace=False)]
    for _ in range(rounds):
        cell = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


@dataclass
class Cells:
    """A stored index: ``path`` holds rows by cell and the centres."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    id_type: str = "bigint"

    def __post_init__(self):
        fields = f"vec_id {self.id_type}, doc_type string, project_id string, embedding array<double>, angle double, salt int, cell int"
        self.rows = self.spark.read.schema(fields).parquet(f"{self.path}/rows")
        # one row a cell, as many as there are centres
        held = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach")).collect()
        self.stats = self.spark.createDataFrame([(r["cell"], r["n"]) for r in held], "cell int, n bigint")
        self.reach = np.full(len(self.centres), -np.inf)
        for r in held:
            self.reach[r["cell"]] = r["reach"]
        self.shared = self.spark.sparkContext.broadcast(self.centres)

    def add(self, chunks: DataFrame) -> Cells:
        """The index with more chunks, each in the cell of its nearest stored centre; only new files are written."""
        _write_rows(chunks, self.shared, f"{self.path}/rows")
        return Cells(self.spark, self.path, self.centres, self.id_type)


def _write_rows(chunks: DataFrame, shared, path: str) -> None:
    known = chunks.filter("embedding IS NOT NULL").select("vec_id", "doc_type", "project_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches):
        centres = shared.value
        for batch in batches:
            if not len(batch):
                continue
            cosine = np.nan_to_num(_unit_rows(_matrix(batch.column("embedding"))) @ centres.T, nan=-1.0)
            cell = np.argmax(cosine, axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    id_type = known.schema["vec_id"].dataType.simpleString()
    placed = known.mapInArrow(run, f"vec_id {id_type}, doc_type string, project_id string, embedding array<double>, cell int, angle double")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    # ranges of (cell, salt): a crowded cell is written by several tasks, a task writes few cells
    placed.repartitionByRange("cell", "salt").sortWithinPartitions("cell").write.mode("append").partitionBy("cell").parquet(path)


def build_cells(chunks: DataFrame, nlist: int = 100, seed: int = 7, path: str | None = None, sample_rows: int = SAMPLE_ROWS) -> Cells:
    """Fit centres on at most ``sample_rows`` rows, those of least id hash, and write all chunks by cell.

    Without ``path`` the index goes to the session's shared folder.  A null vector isn't
    indexed; a zero vector is, though nothing is near it.
    """
    spark = chunks.sparkSession
    sample = chunks.filter("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sample = sample.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    vectors = _unit_rows(_matrix(sample.column("embedding"))) if len(sample) else np.zeros((0, 1))
    vectors = vectors[np.isfinite(vectors).all(axis=1)]
    if nlist * max(1, vectors.shape[1]) * 8 > CENTRE_BYTES:
        raise ValueError("so many centres are too large to broadcast")
    centres = fit_centres(vectors, nlist, seed) if len(vectors) else np.ones((1, max(1, vectors.shape[1]))) / math.sqrt(max(1, vectors.shape[1]))
    path = path or f"{shared_folder(spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    spark.createDataFrame(list(enumerate(centres.tolist())), "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _write_rows(chunks, spark.sparkContext.broadcast(centres), f"{path}/rows")
    return Cells(spark, path, centres, chunks.schema["vec_id"].dataType.simpleString())


def open_cells(spark: SparkSession, path: str) -> Cells:
    """A stored index; its centres are within the bound that ``build_cells`` checked."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
    id_type = spark.read.parquet(f"{path}/rows").schema["vec_id"].dataType.simpleString()
    return Cells(spark, path, _matrix(centres.column("centre")), id_type)


# ---- search ----------------------------------------------------------------------------


def _routes(queries: DataFrame, index: Cells, first: int, last: int, floor: bool = False) -> DataFrame:
    """(query_id, unit, cell): the cells of each query from place ``first`` to before ``last`` in the order of their angles.

    With ``floor``, only cells that may hold a score of at least the query's ``floor``: no
    vector of a cell is nearer to the query than the cell's reach allows.
    """
    reach, shared = index.reach, index.shared

    def run(batches):
        for batch in batches:
            if not len(batch) or not np.isfinite(reach).any():
                continue
            unit = _unit_rows(_matrix(batch.column("embedding")))
            cosine = np.nan_to_num(unit @ shared.value.T, nan=-1.0)
            order = np.argsort(-cosine, axis=1, kind="stable")[:, first:last]
            takes = np.isfinite(reach)[order]
            if floor:
                angle = np.arccos(np.clip(np.take_along_axis(cosine, order, 1), -1, 1))
                best = np.cos(np.maximum(0, angle - reach[order]))
                least = np.array([-np.inf if v is None else v for v in batch.column("floor").to_pylist()])
                takes &= best >= least[:, None] - EPSILON
            takes &= np.isfinite(unit).all(axis=1)[:, None]
            row, place = np.nonzero(takes)
            cell = order[row, place].astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * unit.shape[1]), pa.array(unit[row].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), flat, pa.array(cell)], names=["query_id", "unit", "cell"])

    id_type = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInArrow(run, f"query_id {id_type}, unit array<double>, cell int")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest finite scores, ties by id."""
    at = np.flatnonzero(np.isfinite(scores))
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _scored(routes: DataFrame, index: Cells, k: int, types: Sequence[str], project: str | None, block: int) -> DataFrame:
    """(query_id, vec_id, score): at most k for each query and slice of a cell."""
    asked = routes.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).filter("asked > 0")
    parts = lambda n, each: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(each))).cast("int")
    # one row for each cell that is probed: at most as many as there are centres
    deal = F.broadcast(asked.join(F.broadcast(index.stats), "cell").select("cell", F.least(parts("n", SLICE_ROWS), F.lit(SALTS)).alias("slices"), parts("asked", block).alias("blocks")))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = routes.join(deal, "cell").select("query_id", "unit", "cell", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), upto("slices").alias("slice"))
    rows = visible(index.rows, types, project).join(deal, "cell").select("vec_id", "embedding", "cell", (F.col("salt") % F.col("slices")).alias("slice"), upto("blocks").alias("block"))
    schema = f"query_id {routes.schema['query_id'].dataType.simpleString()}, vec_id {index.rows.schema['vec_id'].dataType.simpleString()}, score double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, vs, scores = [], [], []
        if len(left) and len(right):
            units, ids = _matrix(left.column("unit")), right.column("vec_id").to_numpy()
            vectors = _unit_rows(_matrix(right.column("embedding")))
            for a in range(0, len(left), 128):
                # rows before columns, as in one product over all of them
                part = vectors @ units[a : a + 128].T
                for q in range(part.shape[1]):
                    at = _best(part[:, q], ids, k)
                    qs += [a + q] * len(at)
                    vs.append(ids[at])
                    scores.append(part[at, q])
        found = lambda parts: np.concatenate(parts) if parts else []
        query_ids = left.column("query_id").take(pa.array(qs, pa.int64()))
        return pa.table([query_ids, pa.array(found(vs), right.schema.field("vec_id").type), pa.array(found(scores), pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["cell", "slice", "block"]
    return asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(score, schema)


def _rank(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))


FIRST_PROBES = 2


def vector_topk(queries: DataFrame, chunks: DataFrame | Cells, k: int, types: Sequence[str],
                project: str | None = None, block: int = MAX_QUERIES, nlist: int = 16) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k visible chunks with the least cosine distance, exactly.

    The nearest cells give each query its k-th score so far.  Then only cells that may hold
    a better one are read; a query with fewer than k hits reads all of them.  ``chunks`` is
    a stored index, or a table that is indexed first.
    """
    index = chunks if isinstance(chunks, Cells) else build_cells(chunks, nlist)
    asked = _asked(queries)
    first = _rank(_scored(checkpoint(_routes(asked, index, 0, FIRST_PROBES)), index, k, types, project, block), k)
    first = checkpoint(first.drop("rank"))
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    routes = checkpoint(_routes(asked.join(floors, "query_id", "left"), index, FIRST_PROBES, len(index.centres), floor=True))
    return _rank(first.unionByName(_scored(routes, index, k, types, project, block)), k)


def ann_topk(queries: DataFrame, chunks: DataFrame | Cells, k: int, nlist: int, nprobe: int,
             types: Sequence[str], project: str | None = None, block: int = MAX_QUERIES) -> DataFrame:
    """Approximate top k: only the ``nprobe`` nearest cells of a query are read and scored."""
    index = chunks if isinstance(chunks, Cells) else build_cells(chunks, nlist)
    routes = checkpoint(_routes(_asked(queries), index, 0, nprobe))
    return _rank(_scored(routes, index, k, types, project, block), k)


def retrieve(queries: DataFrame, chunks: DataFrame, k: int, exclude: str, types: Sequence[str],
             project: str | None = None, index: Cells | None = None) -> DataFrame:
    """Fetch 3k, drop chunks whose path or URL has the marker, keep the first k of the rest."""
    hits = vector_topk(queries, index or chunks, 3 * k, types, project)
    located = chunks.select("vec_id", F.lower(F.coalesce("path", F.lit(""))).alias("_p"),
                            F.lower(F.coalesce("source_url", F.lit(""))).alias("_u"))
    kept = (
        hits.join(located, "vec_id")
        .filter(~F.col("_p").contains(exclude.lower()) & ~F.col("_u").contains(exclude.lower()))
        .select("query_id", "vec_id", "score")
    )
    return _rank(kept, k)


SNIPPET_CHARS = 400


def provenance(hits: DataFrame, texts: DataFrame, snippet_chars: int = SNIPPET_CHARS) -> DataFrame:
    """Per query the ranked list of {path, url, snippet}; a list has at most k entries."""
    snippet = F.when(
        F.length("text") > snippet_chars, F.concat(F.substring("text", 1, snippet_chars), F.lit("..."))
    ).otherwise(F.coalesce("text", F.lit("")))
    return (
        hits.join(texts, "vec_id", "left")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct(
            "rank", F.coalesce("path", F.lit("doc")).alias("path"), F.coalesce("source_url", F.lit("")).alias("url"),
            snippet.alias("snippet")))).alias("sources"))
    )
