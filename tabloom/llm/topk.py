"""Exact top-k inner products of integer vectors.

Vectors are written once in descending order of their length, cut into ranges of it.
A first step multiplies every query with the HEAD longest vectors, which gives each a
worst score that it has to beat.  Then queries go out in pieces of bounded size, a
piece to all ranges at a time: a task reads its range block by block in order.  The
block's right singular vectors rotate vectors and queries so that the leading
coordinates carry most of the length; the inner product of those, plus the product of
the residual lengths (Cauchy-Schwarz), bounds the whole.  A slice of a block is left
out for all queries whose worst kept score exceeds the product of lengths, and a
vector is multiplied out in integers only if its bound reaches the query's worst kept
score.  A task returns at most k rows a query, from which a window takes the k best.

A vector that is null or has a null or non-finite component takes no part, nor
does one with a null id.  Equal scores go to the smaller id.  Vectors of another
dimension only meet those of their own.  Rows with the same id exclude each other as
"own"; each row of queries has its own ranks, also where ids repeat.  A vector so long
that products might leave 64 bits (a squared length of 2 ** 62 after scaling) is an
error.  Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import dense_index
from .common import save, spread

#: Rows that a task takes at a time, longest vectors that give the first worst scores, and rows of a range.
BLOCK, HEAD, RANGE = 8192, 4096, 200_000
#: Numbers of the queries that are sent to all tasks at once.
PIECE = 1 << 22
LEAD = 16


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (longs), dim and norm of the rows that take part."""
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * 1024).cast("long"))
    some = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite & (F.size(vec_col) > 0))
    some = some.select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("vec"), F.size(vec_col).alias("dim"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return some.withColumn("norm", F.sqrt(F.when(square < 2.0**62, square).otherwise(F.raise_error(F.lit("a vector is too long for exact products")).cast("double"))))


class Best:
    """Queries of one dimension, and the k best of what they have met."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, vectors, k
        self.floats = vectors.astype(np.float64)
        self.norms = np.linalg.norm(self.floats, axis=1)
        self.worst = np.full(len(ids), -np.inf) if worst is None else worst.astype(np.float64)
        self.rows, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, v_ids: np.ndarray, v: np.ndarray) -> None:
        vf = v.astype(np.float64)
        order = np.lexsort((v_ids, -np.einsum("ij,ij->i", vf, vf)))
        v_ids, v, vf = v_ids[order], v[order], vf[order]
        norms = np.linalg.norm(vf, axis=1)
        if not self._open(norms[0]).any():
            return
        _, rotate = np.linalg.eigh(vf.T @ vf)
        rotate = rotate[:, ::-1][:, : min(LEAD, v.shape[1])]
        v_lead, q_lead = vf @ rotate, self.floats @ rotate
        # rounding of the rotated sums stays far below one part in 1e9 of the lengths
        v_rest = np.sqrt(np.maximum(norms**2 - np.einsum("ij,ij->i", v_lead, v_lead), 0)) + 1e-6 * norms
        q_rest = np.sqrt(np.maximum(self.norms**2 - np.einsum("ij,ij->i", q_lead, q_lead), 0)) + 1e-6 * self.norms
        for at in range(0, len(v), 512):
            open_ = np.flatnonzero(self._open(norms[at]))
            if not len(open_):
                break
            to = min(at + 512, len(v))
            for i in range(0, len(open_), 4096):
                some = open_[i : i + 4096]
                bound = q_lead[some] @ v_lead[at:to].T + q_rest[some, None] * v_rest[None, at:to]
                slack = 1e-9 * self.norms[some, None] * norms[None, at:to] + 1e-6
                a, b = np.nonzero(bound + slack >= self.worst[some, None])
                self._keep(some[a], b + at, v_ids, v)

    def _open(self, norm: float) -> np.ndarray:
        return self.worst <= self.norms * norm * (1 + 1e-9) + 1e-6

    def _keep(self, a: np.ndarray, b: np.ndarray, v_ids: np.ndarray, v: np.ndarray) -> None:
        other = self.ids[a] != v_ids[b]
        a, b = a[other], b[other]
        new = [np.einsum("ij,ij->i", self.q[a[i : i + 65536]], v[b[i : i + 65536]]) for i in range(0, len(a), 65536)]
        if not new:
            return
        score = np.concatenate(new)
        enough = score >= self.worst[a]
        rows, found, scores = (np.concatenate(x) for x in ((self.rows, a[enough]), (self.found, v_ids[b[enough]]), (self.scores, score[enough])))
        keep = np.lexsort((found, -scores, rows))
        rows, found, scores = rows[keep], found[keep], scores[keep]
        first = np.searchsorted(rows, np.arange(len(self.ids) + 1))
        best = np.arange(len(rows)) - first[rows] < self.k
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.worst[full] = np.maximum(self.worst[full], scores[first[full] + self.k - 1])
        self.rows, self.found, self.scores = rows[best], found[best], scores[best]


def block_topk(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's k best in one block, ties to smaller ids."""
    best = Best(q_ids, q, k)
    best.meet(v_ids, v)
    return best.rows, best.found, best.scores


def _by_dim(batch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, vectors) of the rows of each dimension of a batch with dim and vec."""
    dim, vec = (batch.column(batch.schema.get_field_index(c)) for c in ("dim", "vec"))
    dim, flat, at = dim.to_numpy(), vec.flatten().to_numpy(), np.asarray(vec.offsets)
    for d in np.unique(dim).tolist():
        rows = np.flatnonzero(dim == d)
        yield d, rows, flat[(at[rows] - at[0])[:, None] + np.arange(d)]


def _numbers(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _worst(head: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """(number, vec_id, dim, vec) with worst: the k-th best score among the head's, or null."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, worst = _numbers(batch, "vec_id"), np.full(batch.num_rows, -np.inf)
            for d, rows, q in _by_dim(batch):
                best = Best(ids[rows], q, k)
                best.meet(*head[d])
                worst[rows] = best.worst
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(worst, mask=np.isneginf(worst))], names=[*batch.schema.names, "worst"])

    return run


def _scan(piece: dict[int, tuple[np.ndarray, ...]], k: int):
    """Vectors in order of length to the k best rows of each query of the piece: number, query_id, vec_id, score."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        best = {d: Best(ids, q, k, worst) for d, (_, ids, q, worst) in piece.items()}
        held: dict[int, list] = {d: [] for d in piece}

        def meet(d: int) -> None:
            best[d].meet(*(np.concatenate(x) for x in zip(*held[d], strict=True)))
            held[d] = []

        for batch in batches:
            ids = _numbers(batch, "vec_id")
            for d, rows, v in _by_dim(batch):
                if d in piece:
                    held[d].append((ids[rows], v))
                    if sum(len(x) for x, _ in held[d]) >= BLOCK:
                        meet(d)
        for d in piece:
            if held[d]:
                meet(d)
            b, (number, own, _, _) = best[d], piece[d]
            if len(b.rows):
                yield pa.RecordBatch.from_arrays([pa.array(number[b.rows]), pa.array(own[b.rows]), pa.array(b.found), pa.array(b.scores)], names=["number", "query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for every usable row of queries against all usable vectors."""
    spark = vectors.sparkSession
    v = usable(vectors, id_col, vec_col)
    v = save(v.repartitionByRange(spread(vectors.select(id_col), RANGE), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"), "vectors")
    q = save(usable(queries, id_col, vec_col).withColumn("n", F.monotonically_increasing_id()), "queries")
    schema = "number long, query_id long, vec_id long, score long"
    parts = []
    dims = [r["dim"] for r in q.select("dim").distinct().orderBy("dim").collect()]  # few: dimensions, not rows
    for d in dims:
        # at most HEAD vectors
        longest = v.filter(F.col("dim") == d).orderBy(F.desc("norm"), "vec_id").limit(HEAD).select("vec_id", "dim", "vec").toArrow().combine_chunks()
        if not longest.num_rows:
            continue
        batch = longest.to_batches()[0]
        head = {d: (_numbers(batch, "vec_id"), next(_by_dim(batch))[2])}
        own = dense_index(q.filter(F.col("dim") == d), "n", "number").select("number", "vec_id", "dim", "vec")
        ready = save(own.mapInArrow(_worst(head, k), "number long, vec_id long, dim int, vec array<long>, worst double"), "queries")
        total, rows = ready.count(), max(1, PIECE // d)
        for at in range(0, total, rows):
            # at most PIECE numbers
            one = ready.filter((F.col("number") >= at) & (F.col("number") < at + rows)).toArrow().combine_chunks().to_batches()[0]
            worst = one.column(4).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            sent = spark.sparkContext.broadcast({d: (_numbers(one, "number"), _numbers(one, "vec_id"), next(_by_dim(one))[2], worst)})
            found = v.filter(F.col("dim") == d).select("vec_id", "dim", "vec").mapInArrow(lambda batches, sent=sent: _scan(sent.value, k)(batches), schema)
            parts.append(save(found.withColumn("dim", F.lit(d)), "found"))
            sent.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    part = parts[0]
    for more in parts[1:]:
        part = part.unionByName(more)
    by = Window.partitionBy("dim", "number").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark, sf_dir):
    from .common import table

    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
