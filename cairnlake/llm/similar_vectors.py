"""The k most similar vectors of the same model for every vector, by cosine.

Vectors are made unit length and put into the cells of a coarse quantizer in two levels, cells of cells: k-means
centroids fitted on a bounded sample, as many on the first level as there are in each group of the second. Relative to a cell's centroid a vector becomes a one-bit code: its residual, randomly
rotated, keeps only the signs, packed into 64-bit words, beside three correction scalars (residual length
over code quality, product with the centroid, error bound). Codes go to the `probes` nearest cells of a
vector, the vector itself only to the nearest, where it searches the codes: bit counts of the code against the
bit planes of the 4-bit rotated query give an unbiased estimate of the inner product with a known error. Every
vector whose upper bound reaches the k-th best lower bound (and the least cosine asked for) is reranked
with the exact cosine in double precision.

Plan. A vector is compared with the first level and with the groups under the `BEAM` nearest of it, so placing one costs
the square root of the number of cells. Only codes (16 bytes at 128 dimensions) are copied to several cells. Cells over `block_rows` are split in
blocks, queries against codes, so no task holds a whole hot cell. Equal vectors are one item during the
search; their members come back at the end through the k + 1 smallest keys of each group.

Defined results
- null vectors or keys, vectors with nulls, NaN or infinities, all-zero vectors and those whose length is not the
  model's (given, or the most frequent) have no neighbours and are nobody's.
- repeated rows count once; of different vectors under one (model, key) the greatest holds.
- ties are broken by key, the smaller first. A null model is a model of its own. Extra columns are ignored.
- an empty table, or a model with one vector, gives no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from cairnlake.session import durable

#: About so many vectors, of all models together, are taken to the driver for the centroids, whatever the size of the tables; so many of them
#: make a cell at least.
SAMPLE_ROWS, CELL_SAMPLE, CELL_ROWS, PROBES, BEAM, BLOCK_ROWS = 32_768, 4, 192, 14, 10, 8192
EPSILON, QUERY_BITS = 1.9, 4


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """Random orthogonal matrix of the padded dimension, the first dim columns."""
    padded = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((padded, padded)))
    return (q * np.sign(np.diag(r)))[:, :dim].astype(np.float32)


def centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(sample)))
    c = sample[rng.choice(len(sample), cells, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i:i + 4096] @ c.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-9, sums / np.maximum(n, 1e-9), sample[rng.integers(0, len(sample), cells)]).astype(np.float32)
    # centroids are means, not unit vectors: shrink each to the mean of its members
    near = np.concatenate([np.argmax(sample[i:i + 4096] @ c.T, axis=1) for i in range(0, len(sample), 4096)])
    sums, n = np.zeros_like(c), np.bincount(near, minlength=cells)[:, None]
    np.add.at(sums, near, sample)
    return np.where(n > 0, sums / np.maximum(n, 1), c).astype(np.float32)


class Cells:
    """Two levels of centroids: the leaves of group g are first[g]:first[g + 1]."""

    def __init__(self, sample: np.ndarray, cells: int):
        cells = max(1, min(cells, len(sample) // CELL_SAMPLE or 1))
        self.top = centroids(sample, math.ceil(math.sqrt(cells)))
        near = np.concatenate([np.argmax(scores(sample[i:i + 4096], self.top), axis=1) for i in range(0, len(sample), 4096)])
        groups = [sample[near == g] for g in range(len(self.top))]
        leaves = [centroids(m, max(1, round(cells * len(m) / len(sample)))) if len(m) else self.top[g:g + 1] for g, m in enumerate(groups)]
        self.first = np.cumsum([0, *map(len, leaves)])
        self.leaves = np.concatenate(leaves)

    def nearest(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaves near each row, the nearest); fewer than `probes` are filled up with -1."""
        tops = scores(x, self.top)
        beam = min(BEAM, len(self.top))
        chosen = np.argpartition(-tops, beam - 1, axis=1)[:, :beam]
        width = int(np.diff(self.first).max())
        near = np.full((len(x), beam, width), -np.inf, np.float32)
        for g in np.unique(chosen):
            rows, k = np.nonzero(chosen == g)
            near[rows, k, :self.first[g + 1] - self.first[g]] = scores(x[rows], self.leaves[self.first[g]:self.first[g + 1]])
        near = near.reshape(len(x), -1)
        p = min(probes, near.shape[1])
        best = np.argpartition(-near, p - 1, axis=1)[:, :p] if p < near.shape[1] else np.tile(np.arange(p), (len(x), 1))
        found = np.take_along_axis(near, best, axis=1)
        leaf = self.first[np.take_along_axis(chosen, best // width, axis=1)] + best % width
        home = leaf[np.arange(len(x)), np.argmax(found, axis=1)]
        return np.where(np.isfinite(found), leaf, -1), home


def scores(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Greater the nearer; by distance, centroids being no unit vectors."""
    return x @ c.T - 0.5 * np.einsum("ij,ij->i", c, c)[None, :]


def encode(x: np.ndarray, c: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, and per vector: factor of the estimate, product with the centroid, error factor."""
    r = x - c
    norm = np.linalg.norm(r, axis=1)
    o = (r / np.maximum(norm, 1e-9)[:, None]) @ rot.T
    dim = o.shape[1]
    t = np.maximum(np.abs(o).sum(axis=1) / math.sqrt(dim), 1e-6)
    codes = np.packbits(o > 0, axis=1, bitorder="little").view(np.uint64)
    err = norm * np.sqrt(np.maximum(1 - t * t, 0)) / t * EPSILON / math.sqrt(dim - 1)
    return codes, (norm / (t * math.sqrt(dim))).astype(np.float32), np.einsum("ij,ij->i", x, c).astype(np.float32), err.astype(np.float32)


def estimate(q: np.ndarray, c: np.ndarray, rot: np.ndarray, codes: np.ndarray, factor: np.ndarray, xc: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated products of the queries q (rows) with the coded vectors (columns), and the error bound of each."""
    r = q - c
    rq = r @ rot.T
    dim = rq.shape[1]
    low, high = rq.min(axis=1, keepdims=True), rq.max(axis=1, keepdims=True)
    step = np.maximum(high - low, 1e-9) / (2 ** QUERY_BITS - 1)
    level = np.rint((rq - low) / step).astype(np.uint8)
    inner = np.zeros((len(q), len(codes)), np.int32)
    for j in range(QUERY_BITS):
        plane = np.packbits((level >> j) & 1, axis=1, bitorder="little").view(np.uint64)
        count = np.zeros_like(inner, dtype=np.uint16)
        for w in range(codes.shape[1]):
            count += np.bitwise_count(plane[:, w, None] & codes[None, :, w])
        inner += count.astype(np.int32) << j
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.float32)
    dot = 2 * (step * inner + low * ones[None, :]) - rq.sum(axis=1, keepdims=True)
    est = factor[None, :] * dot + xc[None, :] + (q @ c - c @ c)[:, None]
    # three standard deviations of the rounding of the query, and the bound of the code
    rounding = 3 * 2 * step * math.sqrt(dim / 2 / 12)
    return est, err[None, :] * np.linalg.norm(r, axis=1)[:, None] + rounding * factor[None, :]


def _assign(model_data, probes: int):
    """One row per (vector, near cell): its code; the nearest also as a query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = model_data.value
        for b in batches:
            names = b.column("model").to_pylist()
            ids = b.column("rid").to_numpy(zero_copy_only=False)
            vec = b.column("vec")
            for m in dict.fromkeys(names):
                rows = np.flatnonzero([n == m for n in names])
                cells, rot = data[m]
                x = np.asarray(vec.take(pa.array(rows)).flatten(), np.float32).reshape(len(rows), -1)
                x = x.astype(np.float64)
                x = (x / np.abs(x).max(axis=1, keepdims=True))
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                near, home = cells.nearest(x, probes)
                for k in range(near.shape[1]):
                    some = np.flatnonzero(near[:, k] >= 0)
                    if not len(some):
                        continue
                    codes, factor, xc, err = encode(x[some], cells.leaves[near[some, k]], rot)
                    width = codes.shape[1] * 8
                    payload = pa.Array.from_buffers(pa.binary(width), len(some), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())
                    yield _cell_rows(m, near[some, k], ids[rows[some]], False, payload, factor, xc, err)
                raw = pa.Array.from_buffers(pa.binary(4 * x.shape[1]), len(rows), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
                zero = np.zeros(len(rows), np.float32)
                yield _cell_rows(m, home, ids[rows], True, raw, zero, zero, zero)
    return run


CELL_SCHEMA = "model string, cell int, rid bigint, is_query boolean, payload binary, factor float, xc float, err float"


def _cell_rows(model, cell, rid, is_query, payload, factor, xc, err) -> pa.RecordBatch:
    n = len(rid)
    return pa.RecordBatch.from_arrays(
        [pa.array([model] * n, pa.string()), pa.array(cell, pa.int32()), pa.array(rid, pa.int64()), pa.array(np.full(n, is_query)), payload,
         pa.array(factor, pa.float32()), pa.array(xc, pa.float32()), pa.array(err, pa.float32())],
        names=["model", "cell", "rid", "is_query", "payload", "factor", "xc", "err"])


def _search(model_data, k: int, least: float):
    """Candidates for reranking in one block of one cell."""
    def run(table: pa.Table) -> pa.Table:
        data = model_data.value
        model, cell = table.column("model")[0].as_py(), table.column("cell")[0].as_py()
        cells, rot = data[model]
        c = cells.leaves[cell]
        is_q = table.column("is_query").to_numpy(zero_copy_only=False)
        rid = table.column("rid").to_numpy()
        payload = table.column("payload").combine_chunks()
        qi, xi = np.flatnonzero(is_q), np.flatnonzero(~is_q)
        out_a, out_b = [], []
        if len(qi) and len(xi):
            q = np.frombuffer(b"".join(payload.take(pa.array(qi)).to_pylist()), np.float32).reshape(len(qi), -1)
            codes = np.frombuffer(b"".join(payload.take(pa.array(xi)).to_pylist()), np.uint64).reshape(len(xi), -1)
            factor, xc, err = (table.column(n).to_numpy()[xi] for n in ("factor", "xc", "err"))
            qid, xid = rid[qi], rid[xi]
            step = max(1, 400_000 // len(xi))
            for i in range(0, len(qi), step):
                est, bound = estimate(q[i:i + step], c, rot, codes, factor, xc, err)
                same = qid[i:i + step, None] == xid[None, :]
                low = np.where(same, -np.inf, est - bound)
                floor = np.full(len(est), least, np.float32)
                if len(xi) > k:
                    floor = np.maximum(floor, np.partition(low, len(xi) - k, axis=1)[:, len(xi) - k])
                a, b = np.nonzero((est + bound >= floor[:, None]) & ~same)
                out_a.append(qid[i:i + step][a])
                out_b.append(xid[b])
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})
    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact cosine in double precision of vectors that lie side by side."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.diff(b.column("va").offsets.to_numpy())
        out = np.zeros(b.num_rows)
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            x, y = (np.asarray(b.column(n).take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), d) for n in ("va", "vb"))
            x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
            out[rows] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out)], names=["a", "b", "cosine"])


def valid_vectors(rows: DataFrame, model: str, key: str, vector: str, dims: dict[str, int] | None) -> DataFrame:
    """(model, key, vec), one row per (model, key)."""
    v = F.col("vec")
    r = rows.select(F.col(model).cast("string").alias("model"), F.col(key).cast("string").alias("key"), F.col(vector).cast("array<float>").alias("vec"))
    r = r.filter(F.col("key").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
                 & F.exists(v, lambda x: x != 0))
    r = r.withColumn("dim", F.size("vec"))
    if dims is not None:
        allowed = F.lit(False)
        for m, d in dims.items():
            allowed = allowed | (F.col("model").eqNullSafe(m) & (F.col("dim") == d))
        r = r.filter(allowed)
    else:  # one row per model; only counts are shuffled
        sizes = r.groupBy("model", "dim").agg(F.count("*").alias("n")).groupBy("model").agg(F.max(F.struct("n", "dim")).alias("most"))
        r = r.alias("r").join(F.broadcast(sizes).alias("s"), F.col("r.model").eqNullSafe(F.col("s.model")) & (F.col("r.dim") == F.col("s.most.dim"))).select("r.model", "key", "vec")
    return r.groupBy("model", "key").agg(F.max("vec").alias("vec"))


def neighbours(rows: DataFrame, *, model: str = "embedding_model", key: str = "content_hash", vector: str = "embedding", k: int = 5, least: float = -1.0,
               dims: dict[str, int] | None = None, probes: int = PROBES, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(model, key, other, cosine, rank): for each key its k most similar others with a cosine of at least `least`."""
    spark = rows.sparkSession
    items = valid_vectors(rows, model, key, vector, dims)
    same = W.partitionBy("model", "h1", "h2").orderBy("key")
    base = durable(items.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}), "vectors")
    # of a group of equal vectors only the k + 1 smallest keys are ranked; the limit cuts a hot group before it is shuffled
    heads = base.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    reps = durable(heads.filter("n = 1").select(F.monotonically_increasing_id().alias("rid"), "model", "h1", "h2", "vec"), "items")

    counts = {r["model"]: r["n"] for r in reps.groupBy("model").agg(F.count("*").alias("n")).collect()}
    # one row per model, all samples in one pass
    most = max(1, sample_rows // max(1, len(counts)))
    share = F.lit(0)
    for m, n in counts.items():
        share = F.when(F.col("model").eqNullSafe(m), int(min(1.0, most / n) * (1 << 30))).otherwise(share)
    picked = reps.filter(F.pmod(F.xxhash64(F.lit(3), "h1"), F.lit(1 << 30)) < share).select("model", "vec").toArrow() if counts else None
    learned = {}
    for m, n in counts.items():
        got = picked.column("vec").filter(pc.is_null(picked.column("model")) if m is None else pc.equal(picked.column("model"), m))
        if not len(got):
            got = reps.filter(F.col("model").eqNullSafe(m)).limit(1).select("vec").toArrow().column("vec")
        x = np.asarray(got.combine_chunks().flatten(), np.float64).reshape(len(got), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        learned[m] = (Cells(x, -(-n // cell_rows)), rotation(x.shape[1]))
    model_data = spark.sparkContext.broadcast(learned)

    placed = durable(reps.select("model", "rid", "vec").mapInArrow(_assign(model_data, probes), CELL_SCHEMA), "codes")
    # at most one row per cell, cells being no more than the sample holds
    big = placed.groupBy("model", "cell").agg(F.count_if("is_query").alias("nq"), F.count_if(~F.col("is_query")).alias("nx"))
    big = big.select("model", "cell", F.ceil(F.col("nq") / block_rows).cast("int").alias("bq"), F.ceil(F.col("nx") / block_rows).cast("int").alias("bx")).filter("bq > 1 or bx > 1")
    p = placed.alias("p").join(F.broadcast(big).alias("g"), F.col("p.model").eqNullSafe(F.col("g.model")) & (F.col("p.cell") == F.col("g.cell")), "left")
    bq, bx = F.coalesce(F.greatest("bq", F.lit(1)), F.lit(1)), F.coalesce(F.greatest("bx", F.lit(1)), F.lit(1))
    mine = F.pmod(F.xxhash64("rid"), F.when(F.col("is_query"), bq).otherwise(bx))
    blocks = p.select("p.*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.when(F.col("is_query"), bx).otherwise(bq) - 1)).alias("other"))
    blocks = blocks.withColumn("block", F.when(F.col("is_query"), F.struct(F.col("mine").cast("int").alias("q"), F.col("other").alias("x")))
                               .otherwise(F.struct(F.col("other").alias("q"), F.col("mine").cast("int").alias("x"))))
    found = blocks.groupBy("model", "cell", "block").applyInArrow(_search(model_data, k, least), "a bigint, b bigint").distinct()

    left = reps.select(F.col("rid").alias("a"), F.col("vec").alias("va"))
    right = reps.select(F.col("rid").alias("b"), F.col("vec").alias("vb"))
    exact = found.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(_cosines, "a bigint, b bigint, cosine double").filter(F.col("cosine") >= least)
    exact = durable(exact, "pairs")
    both = exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    # cosine desc; among equals the order of the groups' smallest keys, which only decides between whole groups of ties
    best = both.withColumn("r", F.rank().over(W.partitionBy("a").orderBy(F.desc("cosine")))).filter(F.col("r") <= k).drop("r")

    ids = reps.select("rid", "model", "h1", "h2")
    def with_id(rows: DataFrame) -> DataFrame:
        m = rows.alias("m").join(ids.alias("i"), (F.col("m.h1") == F.col("i.h1")) & (F.col("m.h2") == F.col("i.h2")) & F.col("m.model").eqNullSafe(F.col("i.model")))
        return m.select("i.rid", "m.model", "m.key", *(["m.n"] if "n" in rows.columns else []))
    members = with_id(base.select("model", "h1", "h2", "key"))
    ranked_heads = with_id(heads.select("model", "h1", "h2", "key", "n"))
    first = ranked_heads.select("rid", F.col("key").alias("other"))
    near = best.join(first.withColumnRenamed("rid", "b"), "b").select(F.col("a").alias("rid"), "other", "cosine")
    own = ranked_heads.filter("n = 2").select("rid").join(first, "rid").withColumn("cosine", F.lit(1.0))
    # the k others of a group of equal vectors are the same for all members, but for themselves: k + 1 are enough
    top = (near.unionByName(own).withColumn("r", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("cosine"), "other")))
           .filter(F.col("r") <= k + 1).drop("r"))
    ranked = members.join(top, "rid").filter(F.col("key") != F.col("other"))
    return (ranked.withColumn("rank", F.row_number().over(W.partitionBy("rid", "key").orderBy(F.desc("cosine"), "other")))
            .filter((F.col("rank") <= k) & (F.col("cosine") >= least)).select("model", "key", "other", "cosine", "rank"))
