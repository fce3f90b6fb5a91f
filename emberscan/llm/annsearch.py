"""Approximate nearest neighbours by cosine: inverted file with product quantisation.

Equal vectors become one row with their k + 1 smallest ids, so that a vector which
many rows share costs nothing.  Unit vectors go to coarse cells, about as many as the square root of the
rows: the nearest of some centroids, and within it the nearest of a second set of
centroids of residuals, shared by all first cells, once the sample is too small
for that many of one kind.  The rest, divided by its first cell's root mean square
so that tight and loose cells share one codebook, is product quantised to one
byte for about every two dimensions.  Inside a block of a cell one asymmetric
distance table per query gives approximate cosines of all rows by gathers; all
rows that the known quantisation error could still lift into the best k are
reranked with exact cosines of the original vectors.

Centroids and codebooks come from a hash sample of at most ``SAMPLE_BYTES`` of
vectors; every row is indexed.  What is probed is measured, not set: with
sample rows as queries, the exact neighbours within the sample must lie in the
probed cells with a share of ``TARGET`` (neighbours in all rows are nearer still).
That fixes a number of cells, or a distance below the best cell's inner product,
which suits each query by itself; of the two, what probes fewer cells.  Queries for
which these cells hold fewer than k ids are searched again in all cells.  The
same holds at every size; ``Quantiser.report`` tells cells and probes.

Cells are cut into blocks of ``BLOCK_BYTES`` of vectors, and the queries of a cell into
groups of about ``QUERY_BLOCK``, so no cell, however hot, is one task's load.

Defined results: vectors that are null or zero, hold null or non-finite
components, have a null id, or another length than most take no part; a query's
own id is no candidate; an id met several times counts once, as a candidate with
its best vector, as a query with its smallest; ties go to the smaller id; fewer
candidates than k give them all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, drop_checkpoint, small_batches

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
#: Cells at most, and sample rows for each centroid.
MAX_LISTS, ROWS_PER_CENTROID = 1 << 16, 20
BLOCK_BYTES, QUERY_BLOCK = 512 << 10, 2048
TARGET, PROBE_QUERIES, SIGMAS = 0.98, 400, 4.0


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<float>) of the rows that take part."""
    v = F.col(vec_col)
    good = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    rows = df.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (most["n"] if most else 0))


def matrix(col) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # keeps very large and very small vectors in range
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of q with the rows of x; each from its own row alone, so equal rows tie."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        for j in range(x.shape[1]):
            total[:, j] = np.bincount(near, weights=x[:, j], minlength=len(c))
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ c.T).argmin(axis=1)
    return out


class Quantiser:
    """Centroids of two levels, scales, codebooks (parts, 256, width) and what to probe.

    Cell ``i * n2 + j`` has the centroid ``first[i] + spread[i] * second[j]``.
    """

    def __init__(self, x: np.ndarray, n_lists: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        x = unit(x)
        d = x.shape[1]
        most = max(1, len(x) // ROWS_PER_CENTROID)
        self.first = kmeans(x, min(n_lists, most), 8, rng)
        n1 = len(self.first)
        near = nearest(x, self.first)
        rest = x - self.first[near]
        self.spread = self._mean(rest, near, n1)
        n2 = min(most, -(-n_lists // n1))
        self.second = kmeans(rest / self.spread[near, None], n2, 8, rng) if n2 > 1 else np.zeros((1, d))
        self.scale = np.ones(n1)
        cell, rest = self._place(x)
        self.scale = self._mean(rest, cell // len(self.second), n1)
        self.parts = min(32, max(1, d // 2))
        self.bounds = np.linspace(0, d, self.parts + 1).astype(int)
        scaled = (rest / self.scale[cell // len(self.second), None])[:10_000]
        self.books = []
        for a, b in zip(self.bounds[:-1], self.bounds[1:]):
            book = kmeans(scaled[:, a:b], 256, 6, rng)
            self.books.append(np.vstack([book, np.zeros((256 - len(book), b - a))]))
        self._measure(x, cell)

    @staticmethod
    def _mean(rest: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
        """Root mean square of the residuals of each cell."""
        square = np.bincount(cell, weights=(rest * rest).mean(axis=1), minlength=n)
        count = np.bincount(cell, minlength=n)
        mean = max(float((rest * rest).mean()), 1e-12)
        return np.sqrt(np.where(count > 1, square / np.maximum(count, 1), mean) + 1e-12)

    @property
    def n_lists(self) -> int:
        return len(self.first) * len(self.second)

    def centroid(self, cell: int) -> np.ndarray:
        i, j = divmod(cell, len(self.second))
        return self.first[i] + self.spread[i] * self.second[j]

    def _place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, residual) of unit vectors."""
        i = nearest(x, self.first)
        rest = x - self.first[i]
        j = nearest(rest / self.spread[i, None], self.second)
        return i * len(self.second) + j, rest - self.spread[i, None] * self.second[j]

    def cell_scores(self, q: np.ndarray) -> np.ndarray:
        """(queries, cells) inner products with the centroids."""
        both = (q @ self.first.T)[:, :, None] + self.spread[None, :, None] * (q @ self.second.T)[:, None, :]
        return both.reshape(len(q), -1)

    def _measure(self, x: np.ndarray, cell: np.ndarray) -> None:
        """What to probe so that TARGET of the sample's neighbours are found."""
        ranks, gaps, scores = [], [], []
        for i in range(min(len(x), PROBE_QUERIES)):
            sim = x @ x[i]
            sim[i] = -2
            top = np.argpartition(-sim, min(5, len(sim) - 1))[:5]
            top = top[top != i]
            s = self.cell_scores(x[i : i + 1])[0]
            order = np.empty(len(s), int)
            order[np.argsort(-s, kind="stable")] = np.arange(len(s))
            ranks.extend(order[cell[top]])
            gaps.extend(s.max() - s[cell[top]])
            scores.append(s)
        self.probes = min(self.n_lists, int(1.1 * np.quantile(ranks, TARGET)) + 2) if ranks else self.n_lists
        self.gap = 1.05 * float(np.quantile(gaps, TARGET)) + 1e-9 if gaps else 0.0
        by_gap = float(np.mean([(s >= s.max() - self.gap).sum() for s in scores])) if scores else 0.0
        self.by_gap = by_gap < self.probes
        self.mean_probes = by_gap if self.by_gap else float(self.probes)

    def report(self) -> dict:
        """Cells, cells probed by a query on average, and by which rule."""
        return {"cells": self.n_lists, "probed": self.mean_probes, "rule": "distance" if self.by_gap else "number"}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, error of the reconstruction) of unit vectors."""
        cell, rest = self._place(x)
        scale = self.scale[cell // len(self.second)]
        rest = rest / scale[:, None]
        codes = np.empty((len(x), self.parts), np.uint8)
        lost = np.zeros(len(x))
        for j, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:])):
            codes[:, j] = k = nearest(rest[:, a:b], self.books[j])
            lost += ((rest[:, a:b] - self.books[j][k]) ** 2).sum(axis=1)
        return cell, codes, np.sqrt(lost) * scale

    def probe(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of every cell to look into."""
        owner, cells = [], []
        step = max(1, (1 << 22) // self.n_lists)
        for at in range(0, len(q), step):
            s = self.cell_scores(q[at : at + step])
            if self.by_gap:
                who, cell = np.nonzero(s >= s.max(axis=1, keepdims=True) - self.gap)
            else:
                cell = np.argsort(-s, axis=1, kind="stable")[:, : self.probes]
                who, cell = np.repeat(np.arange(len(s)), cell.shape[1]), cell.ravel()
            owner.append(who + at)
            cells.append(cell)
        return np.concatenate(owner), np.concatenate(cells)

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """(queries, rows) of cosines from one distance table per query."""
        out = np.zeros((len(q), len(codes)))
        for j, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:])):
            table = q[:, a:b] @ self.books[j].T
            out += table[:, codes[:, j]]
        return out * self.scale[cell // len(self.second)] + (q @ self.centroid(cell))[:, None]


def vectors(col, kind) -> np.ndarray:
    """A binary Arrow column of equal lengths as a matrix of its own kind."""
    data = b"".join(col.to_pylist())
    return np.frombuffer(data, kind).reshape(len(col), -1)


def _search_block(index: Quantiser, k: int, kind):
    def run(key, rows, queries):
        found: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            x, q = (vectors(t.column("v"), kind).astype(np.float64) for t in (rows, queries))
            asked = queries.column("query_id").to_numpy()
            lists = rows.column("ids").combine_chunks()
            ids, count = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            of, first = np.repeat(np.arange(len(x)), count), np.concatenate([[0], np.cumsum(count)])
            codes = vectors(rows.column("codes"), np.uint8)
            single = len(np.unique(ids)) == len(ids)  # else all rows of the block are reranked
            slack = SIGMAS * rows.column("error").to_numpy() / np.sqrt(x.shape[1])
            for i in range(0, len(q), 256):
                near = index.approximate(unit(q[i : i + 256]), int(key[0].as_py()), codes)
                low = near - slack
                # the k + 1 best, as one of them may be the query itself
                kth = np.partition(low, -k - 1, axis=1)[:, -k - 1] if single and len(x) > k else np.full(len(low), -np.inf)
                maybe = near + slack >= kth[:, None]
                for r in range(len(near)):
                    at = np.flatnonzero(maybe[r])
                    s = cosines(q[i + r], x[at])
                    flat = np.concatenate([np.arange(first[a], first[a + 1]) for a in at])
                    s = s[np.searchsorted(at, of[flat])]
                    mine = ids[flat]
                    seen: set[int] = {int(asked[i + r])}
                    for o in np.lexsort((mine, -s)):
                        c = int(mine[o])
                        if c not in seen:
                            seen.add(c)
                            found.append((int(asked[i + r]), c, float(s[o])))
                            if len(seen) == k + 1:
                                break
        return pa.table(
            {
                "query_id": pa.array([f[0] for f in found], pa.int64()),
                "vec_id": pa.array([f[1] for f in found], pa.int64()),
                "score": pa.array([f[2] for f in found], pa.float64()),
            }
        )

    return run


def _packed(kind):
    """Arrow batches (vec_id, v) -> (vec_id, v as bytes, two hashes)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = (matrix(b.column(1)) + 0.0).astype(kind)
            raw = [r.tobytes() for r in x]
            h = np.array([xxhash.xxh3_128_digest(r) for r in raw], "S16")
            h = np.frombuffer(h.tobytes(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["vec_id", "v", "h1", "h2"])

    return run


def distinct_vectors(rows: DataFrame, k: int, kind) -> DataFrame:
    """(h1, h2, v, ids): each different vector once, with its k + 1 smallest ids.

    Ids are counted out on hashes alone; a group's rows beyond the k + 1 smallest
    of a task are left out before the shuffle.
    """
    packed = rows.mapInArrow(_packed(kind), "vec_id long, v binary, h1 long, h2 long")
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = packed.select("h1", "h2", "vec_id").distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    ids = ids.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return packed.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(ids, ["h1", "h2"])


def build_index(base: DataFrame, n: int, width: int, kind) -> Quantiser:
    """Centroids and codebooks from a bounded sample of the ``n`` different vectors."""
    most = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    hashed = F.pmod(F.col("h1"), F.lit(1_000_000))
    chosen = base if n <= most else base.filter(hashed < int(1_200_000 * most / n) + 1)
    sample = chosen.orderBy(hashed, "h1", "h2").limit(most).select("v").toArrow()
    return Quantiser(vectors(sample["v"], kind).astype(np.float64), max(1, min(int(np.sqrt(n)), MAX_LISTS)))


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query.

    ``is_query``: condition on a column ``vec_id``.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = np.dtype("<f4" if df.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8")
    rows = usable(df, id_col, vec_col)
    base = checkpoint(distinct_vectors(rows, k, kind))
    n = base.count()
    if not n:
        return spark.range(0).selectExpr("id as query_id", "cast(id as int) as rank", "id as vec_id", "cast(id as double) as score")
    width = len(base.select("v").first()["v"]) // kind.itemsize
    index = spark.sparkContext.broadcast(build_index(base, n, width, kind))

    def encode(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cell, codes, error = index.value.encode(unit(vectors(b.column(1), kind).astype(np.float64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float32))],
                ["ids", "v", "cell", "codes", "error"],
            )

    coded = checkpoint(base.select("ids", "v").mapInArrow(encode, "ids array<long>, v binary, cell long, codes binary, error float"))
    drop_checkpoint(base)
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v")

    def probe(everything: bool):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column(1))
                if everything:
                    who, cells = np.repeat(np.arange(len(x)), index.value.n_lists), np.tile(np.arange(index.value.n_lists), len(x))
                else:
                    who, cells = index.value.probe(unit(x))
                at = pa.array(who)
                raw = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), raw.take(at), pa.array(cells)], ["query_id", "v", "cell"])

        return run

    def search(queries: DataFrame, everything: bool) -> DataFrame:
        probed = checkpoint(queries.mapInArrow(probe(everything), "query_id long, v binary, cell long"))
        # one row per cell on each side: at most about MAX_LISTS
        sizes = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        loads = probed.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
        cuts = F.broadcast(
            sizes.join(loads, "cell").select(
                "cell", F.ceil(F.col("n") * (width * kind.itemsize) / BLOCK_BYTES).cast("int").alias("blocks"),
                F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("groups"),
            )
        )
        left = coded.join(cuts, "cell").select(
            "cell", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("blocks")).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "ids", "v", "codes", "error",
        )
        right = probed.join(cuts, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int").alias("part"), "query_id", "v",
        )
        keys = ["cell", "block", "part"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_block_of(index, k, kind), "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = search(asked, False).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    best = checkpoint(best)
    enough = best.filter(F.col("rank") == k).select("query_id")
    short = checkpoint(asked.join(enough, "query_id", "left_anti"))
    if short.isEmpty():
        return best
    again = search(short, True).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return best.join(enough, "query_id", "left_semi").select("query_id", "rank", "vec_id", "score").unionByName(again)


def _search_block_of(index, k: int, kind):
    def run(key, rows, queries):
        return _search_block(index.value, k, kind)(key, rows, queries)

    return run
