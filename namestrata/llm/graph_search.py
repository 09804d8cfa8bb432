"""Approximate nearest neighbours: a robust-pruned graph for each shard, beam search in every shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from namestrata.llm.batches import schema_of
from namestrata.llm.pruned_graph import NONE, beam_search, build, lifted
from namestrata.session import cut_lineage

#: Distinct vectors of a shard on average, queries searched by a task at once, and the beam.
SHARD, BLOCK, BEAM = 16_384, 8_192, 160
#: Parts that the ids of one vector are first ranked in.
SALTS = 256

INDEX = "dim int, shard int, node int, ids array<bigint>, vector binary, edges binary, entry boolean"
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and finite components of which at least
    one is not zero. Of rows with one id the smallest vector counts."""
    vector = F.col("embedding").cast("array<float>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(dim, vector, ids): equal vectors once, with their k + 1 smallest ids.

    No answer can hold a larger id: k smaller ones with the same score come before it, whichever
    of them the query is. Ids are ranked in parts by a hash first, so that a vector with very many
    copies is no single task's.
    """
    key = F.struct(F.xxhash64("vector").alias("a"), F.xxhash64("vector", F.lit("b")).alias("b"))
    rows = rows.withColumn("key", key)
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    ids = rows.select("key", "vec_id", salt.alias("salt"))
    for by in (("key", "salt"), ("key",)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
        ids = ids.withColumn("place", place).where(F.col("place") <= k + 1)
    ids = ids.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    first = rows.select("vec_id", "vector").join(ids.select(F.get("ids", F.lit(0)).alias("vec_id"), "ids"), "vec_id")
    return first.select(F.size("vector").alias("dim"), "vector", "ids")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """A row per distinct vector: shard, ids, vector, edges (row numbers as 32-bit numbers)."""
    shard = F.pmod(F.xxhash64("vector", F.lit("shard")), F.lit(shards)).cast("int")
    kind = schema_of(INDEX)

    def graph_of(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        own = matrix(table.column("vector"), dim)
        graph, entry = build(lifted(own))
        binary = lambda m: [r.tobytes() for r in m]
        columns = {
            "dim": table.column("dim"),
            "shard": table.column("shard"),
            "node": np.arange(len(own)),
            "ids": table.column("ids"),
            "vector": binary(own.astype("<f4")),
            "edges": binary(graph.astype("<i4")),
            "entry": np.arange(len(own)) == entry,
        }
        return pa.Table.from_pydict(columns, schema=to_arrow_schema(kind))

    return distinct.withColumn("shard", shard).groupBy("dim", "shard").applyInArrow(graph_of, kind)


def search_shard(index: pa.Table, queries: pa.Table, k: int, beam: int) -> pa.Table:
    """The k best of one shard for a block of queries, scores in double precision."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not index.num_rows or not queries.num_rows:
        return schema.empty_table()
    # Edges are row numbers; the shuffle may have changed the order of rows.
    index = index.sort_by("node")
    dim = index.column("dim")[0].as_py()
    points = np.frombuffer(b"".join(index.column("vector").to_pylist()), dtype="<f4").reshape(-1, dim)
    graph = np.frombuffer(b"".join(index.column("edges").to_pylist()), dtype="<i4").reshape(len(points), -1)
    entry = index.column("entry").to_pylist().index(True)
    asked = matrix(queries.column("vector"), dim)
    wide = np.concatenate([asked, np.zeros((len(asked), 1), np.float32)], axis=1)
    ids, query_ids = index.column("ids").to_pylist(), queries.column("query_id").to_pylist()
    lifted_points, graph = lifted(points), graph.astype(np.int64)
    out: list[tuple[int, int, float]] = []
    for i in range(0, len(asked), 512):
        nodes, _, _ = beam_search(lifted_points, graph, entry, wide[i : i + 512], beam)
        for row, query, query_id in zip(nodes, asked[i : i + 512], query_ids[i : i + 512]):
            row = row[row != NONE]
            scores = points[row].astype(np.float64) @ query.astype(np.float64)
            best = []
            for at in np.argsort(-scores, kind="stable"):
                # Nodes of one score may come in any order; beyond them nothing better follows.
                if len(best) >= k and scores[at] < best[-1][0]:
                    break
                best += [(float(scores[at]), v) for v in ids[row[at]] if v != query_id]
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[k:]
            out += [(query_id, v, s) for s, v in best]
    columns = list(zip(*out)) or [[], [], []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with an id divisible by ``every`` its ``k``
    nearest other rows by inner product, nearest first, ties to the smaller id.

    ``vectors`` has vec_id and embedding; other columns are ignored. Vectors that are null, zero
    or hold null or non-finite components take no part; neither do rows without an id; only
    vectors of one length are compared. Every vector is in the index. Each shard of about SHARD
    distinct vectors has a graph of its own, built by one task and stored; every query goes
    through all shards, a block of queries and a shard to a task.
    """
    rows = cut_lineage(usable(vectors), "vectors")
    distinct = cut_lineage(distinct_vectors(rows, k), "distinct")
    shards = max(1, -(-distinct.count() // SHARD))
    index = cut_lineage(build_index(distinct, shards), "graphs")
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(
        F.size("vector").alias("dim"),
        F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"),
        F.col("vec_id").alias("query_id"),
        "vector",
        spread(shards).alias("shard"),
    )
    held = index.select("*", spread(blocks).alias("block"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_shard(left, right, k, beam)

    by = "dim", "shard", "block"
    found = held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(answer, schema_of(FOUND))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
