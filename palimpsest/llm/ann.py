"""Nearest neighbours by blocks of matrix products, measured exactly in double precision.

The nearest vectors in Euclidean distance are found for all rows, whatever their distribution.  The index is dealt out in parts of about BLOCK_BYTES, whatever
the partitions of the input are.  A task holds one part and one batch of queries: a matrix product of both, centred on the part's median, gives each squared
distance within a bound of its rounding errors, and all vectors that may be among the k + 1 nearest by that bound are measured component by component, in
the order in which SQL sums them.  Values that over- or underflow have no such bound, and are measured all.  Each part gives the k + 1 nearest of each query.

Equal vectors are one class in the index: a class holds its k + 1 smallest ids, which is all that a result can name, so a
vector that a third of all rows repeat is measured once.  Queries are read batch by batch from the shared folder: neither side is broadcast.

Defined results: vectors that are null, empty, zero, of another length than the most frequent one, or hold null or non-finite
components take no part; components count as doubles, and a float is the double that it equals; equal distances go to smaller ids; a repeated (id, vector) row counts once;
with fewer candidates than k all are returned; an empty table has no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, tidy, written

#: Bytes of the doubles of one part of the index, of the distances of a query batch to it, and of the differences that are measured at once.
BLOCK_BYTES = 16 << 20
#: Squared distances between these have neither lost bits below nor overflown.
LEAST, MOST = 1e-280, 1e290


def valid(vector: Column) -> Column:
    """Whether a vector takes part, its length aside."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _measured(x: np.ndarray, q: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (x[at], q[of]), components summed in their order."""
    out = np.empty(len(at))
    step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
    for begin in range(0, len(at), step):
        part = slice(begin, begin + step)
        square = (x[at[part]] - q[of[part]]) ** 2
        total = np.zeros(len(square))
        for column in square.T:
            total += column
        out[part] = total
    return out


def block_nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of q its place, and ids and distances of the `width` nearest rows of x, ties to smaller ids."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        width = min(width, len(x))
        centre = np.median(x[:: max(1, len(x) // 1000)], axis=0)
        a, b = x - centre, q - centre
        aa, bb = (a**2).sum(1), (b**2).sum(1)
        near = aa - 2 * (b @ a.T)
        near += bb[:, None]
        # of the products, the sums, the centring and the measuring itself
        error = (np.sqrt(aa) + np.sqrt(bb)[:, None]) ** 2
        error *= 8 * (x.shape[1] + 16) * 2.0**-53
        near += error
        limit = np.partition(near, width - 1, axis=1)[:, width - 1]
        error *= 2
        near -= error
        # not(>), as a value that isn't a number has no bound
        of, at = np.nonzero(~(near > limit[:, None]))
        square = _measured(x, q, at, of)
        ends = np.searchsorted(of, np.arange(len(q) + 1))
        for j in range(len(q)):
            own, found = at[ends[j] : ends[j + 1]], square[ends[j] : ends[j + 1]]
            last = np.partition(found, width - 1)[width - 1] if len(found) >= width else np.nan
            if not LEAST <= last <= MOST and len(own) < len(x):
                own = np.arange(len(x))
                found = _measured(x, q, own, np.full(len(x), j))
            score = np.sqrt(found)
            best = np.lexsort((ids[own], score))[:width]
            yield j, ids[own[best]], score[best]


def _scan(reps: DataFrame, folder: str, width: int) -> DataFrame:
    """(query, rep, score): for each query of the files in folder the `width` nearest of each partition of reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        parts = [(batch.column(0).to_numpy(), _matrix(batch.column(1))) for batch in batches if batch.num_rows]
        if not parts:
            return
        ids, x = (np.concatenate(columns) for columns in zip(*parts, strict=True))
        del parts
        rows = max(1, BLOCK_BYTES // (8 * max(x.shape)))
        store, root = fs.FileSystem.from_uri(folder)
        for name in sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")):
            with store.open_input_file(name) as stream:
                for part in pq.ParquetFile(stream).iter_batches(rows, columns=["rep", "vector"]):
                    queries = part.column(0).to_numpy()
                    found = list(block_nearest(ids, x, _matrix(part.column(1)), width))
                    if found:
                        query = np.concatenate([np.full(len(near), queries[j]) for j, near, _ in found])
                        near, score = (np.concatenate([f[n] for f in found]) for n in (1, 2))
                        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(near, pa.int64()), pa.array(score, pa.float64())], names=["query", "rep", "score"])

    return reps.select("rep", "vector").mapInArrow(tidy(run), "query long, rep long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query row, itself left out.

    is_query is a condition over the column `id`.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & valid(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    rows = rows.filter(F.size("vector") == sizes[0]["d"])
    # -0.0 and 0.0 are one value; equal vectors are one class of at most k + 1 kept ids
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    per_class = Window.partitionBy("vector").orderBy("id")
    ids = rows.distinct()
    kept = ids.withColumn("rn", F.row_number().over(per_class)).filter(F.col("rn") <= k + 1)
    kept = written(kept.withColumn("rep", F.min("id").over(Window.partitionBy("vector"))))
    reps = kept.filter("rn = 1").select("rep", "vector")
    asked = written(ids.filter(is_query).join(reps, "vector").select(F.col("id").alias("query_id"), "rep", "vector"))

    folder = shared_dir(spark)
    asked.select("rep", "vector").dropDuplicates(["rep"]).write.parquet(folder)
    block = max(1, BLOCK_BYTES // (8 * sizes[0]["d"]))
    measured = _scan(reps.repartition(-(-reps.count() // block)), folder, k + 1)
    near = Window.partitionBy("query").orderBy("score", "rep")
    classes = measured.withColumn("rn", F.row_number().over(near)).filter(F.col("rn") <= k + 1).select("query", "rep", "score")
    members = classes.join(kept.select("rep", F.col("id").alias("vec_id")), "rep")
    per_query = members.join(asked.select("query_id", F.col("rep").alias("query")), "query").filter(F.col("vec_id") != F.col("query_id"))
    ranked = per_query.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
