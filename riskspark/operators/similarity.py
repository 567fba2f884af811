"""Nearest neighbours by cosine for any number of query vectors against a large store, exact or by hashing.

Both sides are rows; nothing goes through the driver. Exact: store and queries are dealt into blocks by hash, every query
block meets every store block in a task of its own, and one matrix product per pair gives the best rows of the block.
Hashed: random projections of unit vectors give buckets; a query looks into its own bucket of each table and into those
next to it, and what it meets there is compared exactly. Either way the blocks' best rows are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of the store and queries in a block, and queries per matrix product.
STORE_BLOCK, QUERY_BLOCK, TILE = 32_768, 8_192, 256
#: Rows of a bucket that the number of projections aims at; buckets of more than a block are cut.
BUCKET_ROWS, TABLES, PROBES, SEED = 400, 12, 12, 20_240_131
FOUND = "query_id bigint, case_id bigint, score double"


def _unit(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """(n, dimensions) with unit rows; a zero vector stays zero."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    lengths = np.linalg.norm(flat, axis=1)
    lengths[lengths == 0] = 1.0
    return flat / lengths[:, None]


def _best(k: int):
    """The k best store rows per query of one pair of blocks; of equal scores the smaller id, as in the final ranking."""

    def work(key: tuple, store: pa.Table, queries: pa.Table) -> pa.Table:
        n, m = store.num_rows, queries.num_rows
        out = []
        if n and m:
            ids = store.column("case_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], _unit(store.column("vector"), n)[order]
            asked, names = _unit(queries.column("vector"), m), queries.column("query_id").to_numpy()
            for start in range(0, m, TILE):
                scores = np.round(asked[start:start + TILE] @ vectors.T, 6)
                if n > k:
                    # Rows at or above the k-th best score; of its ties the first, in order of ids.
                    least = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
                    above, level = scores > least, scores == least
                    room = k - above.sum(1, keepdims=True)
                    row, place = np.nonzero(above | (level & (np.cumsum(level, 1) <= room)))
                else:
                    row, place = np.nonzero(np.ones(scores.shape, bool))
                out.append((names[start + row], ids[place], scores[row, place]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, float)]
        return pa.table(columns, names=["query_id", "case_id", "score"])

    return work


def _dealt(name: str, blocks: int | Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "case_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_similar(store: DataFrame, queries: DataFrame, k: int = 5, store_block: int = STORE_BLOCK,
                query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, case_id, score, rank): the k stored cases nearest to each query, exactly; ties go to the smaller id.

    `store` holds case_id and vector, `queries` query_id and vector, both ids unique and all vectors of one length. A store
    row is sent once per query block and a query once per store block; only k rows per query and block leave a task.
    """
    store_blocks = max(1, -(-store.count() // store_block))
    query_blocks = max(1, -(-queries.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kept = store.select("case_id", "vector", _dealt("case_id", store_blocks).alias("s"), every(query_blocks).alias("q"))
    asked = queries.select("query_id", "vector", _dealt("query_id", query_blocks).alias("q"), every(store_blocks).alias("s"))
    return _merged(kept.groupBy("s", "q").cogroup(asked.groupBy("s", "q")).applyInArrow(_best(k), FOUND), k)


def _hashed(rows: DataFrame, key: str, planes: np.ndarray, probes: int) -> DataFrame:
    """(key, vector, table, bucket): the signs of a vector's projections as bits, per table; with probes, also the buckets
    reached by turning the sign of one of the smallest projections, or of the two smallest."""
    tables, bits, _ = planes.shape
    flat = planes.reshape(tables * bits, -1)
    weight = 1 << np.arange(bits, dtype=np.int64)

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            projected = (_unit(pa.chunked_array([batch.column("vector")]), n) @ flat.T).reshape(n, tables, bits)
            own = ((projected > 0) * weight).sum(2)
            buckets = [own]
            if probes:
                weak = np.argsort(np.abs(projected), axis=2)
                turned = weight[weak]
                buckets += [own ^ turned[:, :, j] for j in range(min(bits, probes))]
                if bits > 1:
                    buckets.append(own ^ turned[:, :, 0] ^ turned[:, :, 1])
            listed = np.stack(buckets, 2).reshape(n, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * listed.shape[1], pa.int32()), pa.array(listed.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("vector"), lists], [key, "vector", "buckets"])

    each = probes and min(bits, probes) + 1 + (bits > 1) or 1
    wide = rows.select(key, F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
        work, f"{key} bigint, vector array<double>, buckets array<bigint>")
    return wide.select(key, "vector", F.posexplode("buckets").alias("_p", "bucket")).select(
        key, "vector", F.floor(F.col("_p") / each).cast("int").alias("table"), "bucket")


def similar_by_hash(store: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES,
                    bucket_rows: int = BUCKET_ROWS, block: int = STORE_BLOCK) -> DataFrame:
    """Like `top_similar`, but a query is compared only with what shares a bucket with it in one of `tables` tables: most of
    its nearest cases, not surely all. A query that meets fewer than k cases gets fewer rows.

    The number of projections grows with the logarithm of the store, so buckets stay about `bucket_rows` large where
    vectors spread evenly. A bucket that holds more than a block is cut into blocks, and its queries are sent to each.
    """
    n = store.count()
    bits = min(max(1, round(math.log2(max(n / bucket_rows, 2)))), 40)
    first = store.select(F.size("vector").alias("n")).first()
    if first is None:
        return _merged(store.sparkSession.createDataFrame([], FOUND), k)
    planes = np.random.default_rng(SEED).normal(size=(tables, bits, first.n))
    kept, asked = _hashed(store, "case_id", planes, 0), _hashed(queries, "query_id", planes, probes)
    cuts = kept.groupBy("table", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts")).where("cuts > 1")
    several = F.coalesce("cuts", F.lit(1))
    keys = ["table", "bucket", "part"]
    kept = kept.join(cuts, ["table", "bucket"], "left").withColumn("part", _dealt("case_id", several))
    asked = asked.join(cuts, ["table", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), several - 1)))
    found = kept.drop("cuts").groupBy(*keys).cogroup(asked.drop("cuts").groupBy(*keys)).applyInArrow(_best(k), FOUND)
    return _merged(found.distinct(), k)
