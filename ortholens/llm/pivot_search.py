"""Exact top-k inner products by pivot tables.

Vectors get one more component that brings them all to the length of the longest; queries get a zero there. The highest inner
products are then the nearest vectors, and for every pivot |d(q, pivot) - d(x, pivot)| bounds d(q, x) from below. A table
holds each vector's distances to PIVOTS pivots; vectors are packed into blocks by their nearest pivot. A query first looks into
one block of its own cell for a score to beat, then meets every block once: candidates whose bound, the maximum over all
pivots, cannot reach that score are left out, the others are scored in order of their bounds, in growing steps, until the
k-th score found exceeds the next bound.

Pivots come from about SAMPLE rows, farthest first; they decide the speed only, every row is in the table. Blocks hold
BLOCK vectors at most and cells are salted, so a task's memory does not follow the size of a cell. Query blocks are sent to
each block's slice by an equality join; per query and block at most k rows come back.

Defined cases: vectors that are null or hold null or non-finite components take no part. A row never meets itself, but other
rows of its id; every query row gets its own ranks. Ties go to the smaller id, null ids last; a null id is no query. Missing
components of shorter vectors count as zeros. Components so large that a score may leave 64 bits raise an OverflowError. Fewer
than k candidates are all returned. Empty tables give no rows; columns beside vec_id and embedding are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ortholens.llm.common import stash
from ortholens.llm.vectors import extent, integers, usable

PIVOTS, SAMPLE = 32, 1_024
#: Vectors in a block (at least, at most), queries in a block, queries bounded at once, candidates in the first step.
FEW, BLOCK, QUERIES, ROWS, STEP = 256, 4_096, 1_024, 64, 64
#: What rounding may take from a bound, as a share of the squared lengths; distances are kept as 32-bit floats.
SLACK = 4e-6

_TABLE = "rid bigint, vec_id bigint, asks boolean, cell int, x binary, d binary"
_PACK = "cell int, n int, rid binary, id binary, named binary, x binary, d binary, least binary"


class _Pack:
    """A block's columns as arrays."""

    def __init__(self, row: dict, width: int, exact: bool):
        self.rid, self.id, self.named = np.frombuffer(row["rid"], np.int64), np.frombuffer(row["id"], np.int64), np.frombuffer(row["named"], bool)
        x = np.frombuffer(row["x"], np.int32).reshape(-1, width)
        self.x = x.astype(np.float64 if exact else np.int64)
        self.norm = np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))
        self.d = np.frombuffer(row["d"], np.float32).reshape(len(x), -1)
        self.least = np.frombuffer(row["least"], np.int64).copy()


def pivots_of(sample: np.ndarray, top: float, most: int) -> np.ndarray:
    """Rows of the sample, lifted to the length of the longest vector, each as far as can be from those before it."""
    x = np.concatenate([sample, np.sqrt(np.maximum(top - (sample**2).sum(1), 0))[:, None]], axis=1).astype(np.float64)
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(most, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray, top: float, asks: bool) -> np.ndarray:
    """Distances of rows to the pivots; the last component of queries is zero."""
    norm = (x**2).sum(1)
    lift = np.zeros(len(x)) if asks else np.sqrt(np.maximum(top - norm, 0))
    own = norm if asks else np.full(len(x), top)
    square = own[:, None] + top - 2 * (x @ pivots[:, :-1].T + lift[:, None] * pivots[None, :, -1])
    return np.sqrt(np.maximum(square, 0))


def best_of(q: _Pack, c: _Pack, k: int, top: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, candidates' places, scores): the k best candidates of a block that reach q.least, best first."""
    across = np.ascontiguousarray(c.d.T)
    for lo in range(0, len(q.rid), ROWS):
        near = np.zeros((min(ROWS, len(q.rid) - lo), len(c.rid)), dtype=np.float32)
        for p, d in enumerate(across):
            np.maximum(near, np.abs(q.d[lo : lo + ROWS, p, None] - d), out=near)
        base = q.norm[lo : lo + ROWS, None] + top
        bounds = (base - near.astype(np.float64) ** 2) / 2 + SLACK * base + 1
        for i, bound in enumerate(bounds, lo):
            least = q.least[i]
            left = np.flatnonzero((bound >= least) & (c.rid != q.rid[i]))
            left = left[np.argsort(-bound[left], kind="stable")]
            at, step, found, scores = 0, STEP, np.zeros(0, np.int64), np.zeros(0, np.int64)
            while at < len(left) and bound[left[at]] >= least:
                part = left[at : at + step]
                at, step = at + step, 2 * step
                s = (c.x[part] @ q.x[i]).astype(np.int64)
                found, scores = np.concatenate([found, part[s >= least]]), np.concatenate([scores, s[s >= least]])
                first = np.lexsort((c.id[found], ~c.named[found], -scores))[:k]
                found, scores = found[first], scores[first]
                if len(found) == k:
                    least = max(least, scores[-1])
            yield i, found, scores


def _packed(most: int):
    """Rows (cell, salt, ...) of one partition, sorted by cell and salt, to blocks of `most` rows at most."""

    def block(rows: list[dict]) -> dict:
        put = lambda name, kind, empty=0: np.array([empty if r[name] is None else r[name] for r in rows], dtype=kind).tobytes()
        return {
            "cell": rows[0]["cell"], "n": len(rows), "rid": put("rid", np.int64), "id": put("vec_id", np.int64), "named": np.array([r["vec_id"] is not None for r in rows]).tobytes(),
            "x": b"".join(r["x"] for r in rows), "d": b"".join(r["d"] for r in rows), "least": np.full(len(rows), np.iinfo(np.int64).min).tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("cell", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("rid", "id", "named", "x", "d", "least"))])
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) >= most or (r["cell"], r["salt"]) != (held[0]["cell"], held[0]["salt"])):
                    yield pa.RecordBatch.from_pylist([block(held)], kinds)
                    held = []
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pylist([block(held)], kinds)

    return run


def _blocks(table: DataFrame, most: int, even: int) -> DataFrame:
    """Blocks of table rows by cell, about `even` rows each and `most` at most; cells are salted by their counts."""
    counts = {r["cell"]: r["n"] for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = F.array(*(F.lit(max(1, -(-counts.get(c, 0) // even))) for c in range(PIVOTS)))
    dealt = table.withColumn("salt", F.pmod(F.xxhash64("rid"), salts[F.col("cell")]).cast("int"))
    return dealt.repartition("cell", "salt").sortWithinPartitions("cell", "salt").mapInArrow(_packed(most), _PACK)


def _met(width: int, exact: bool, k: int, top: float, seeds: bool):
    """Joined blocks (q_*, c_*): for seeds the query block with the k-th score found, else the rows found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                row = b.slice(n, 1).to_pylist()[0]
                q, c = (_Pack({x[2:]: v for x, v in row.items() if x[:2] == side}, width, exact) for side in ("q_", "c_"))
                if seeds:
                    for i, found, scores in best_of(q, c, k, top):
                        if len(found) == k:
                            q.least[i] = scores[-1]
                    own = {x[2:]: v for x, v in row.items() if x[:2] == "q_"} | {"least": q.least.tobytes()}
                    yield pa.RecordBatch.from_pylist([own], pa.schema([("cell", pa.int32()), ("n", pa.int32()), *((x, pa.binary()) for x in ("rid", "id", "named", "x", "d", "least"))]))
                    continue
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i, found, scores in best_of(q, c, k, top):
                    for col, v in zip(out, (np.full(len(found), q.rid[i]), np.full(len(found), q.id[i]), found, scores), strict=True):
                        col.append(v)
                rid, asked, found, scores = (np.concatenate(v).astype(np.int64) for v in out)
                ids = pa.array(c.id[found], pa.int64(), mask=~c.named[found])
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(asked), ids, pa.array(scores)], ["rid", "query_id", "vec_id", "score"])

    return run


def top_scores(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row whose id is divisible by `every`.

    Components are floor(scale * x); all other rows are candidates.
    """
    spark = vectors.sparkSession
    rows = stash(usable(vectors, F.col("vec_id").cast("bigint").alias("vec_id")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    n, width, most = extent(rows)
    if not n or not width:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score"))
    if max(2, width) * (scale * most + 1) ** 2 >= 2**63:
        raise OverflowError("scores do not fit in 64 bits")
    exact = width * (scale * most + 1) ** 2 < 2**53
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    top = rows.agg(F.max(square)).first()[0]
    drawn = rows if n <= sample else rows.sample(sample / n, seed=7).limit(2 * sample)
    pivots = pivots_of(integers(drawn.select("v").toArrow()["v"].combine_chunks(), scale, width).astype(np.float64), top, PIVOTS)

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("v"), scale, width)
            real = x.astype(np.float64)
            asks = np.asarray(b.column("asks").to_pylist(), dtype=bool)
            lifted = distances(real, pivots, top, False)
            cell = pa.array(lifted.argmin(1).astype(np.int32))
            d = np.where(asks[:, None], distances(real, pivots, top, True), lifted) if asks.any() else lifted
            cut = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("vec_id"), b.column("asks"), cell, cut(x.astype(np.int32)), cut(d.astype(np.float32))], ["rid", "vec_id", "asks", "cell", "x", "d"])

    own = rows.select("rid", "vec_id", F.lit(False).alias("asks"), "v")
    asking = own.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("asks", F.lit(True))
    even = min(BLOCK, max(FEW, n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    table = stash(own.unionByName(asking).mapInArrow(entered, _TABLE), "pivot-table")
    blocks = stash(_blocks(table.where("not asks"), BLOCK, even).withColumn("nr", F.monotonically_increasing_id()), "blocks")
    queries = _blocks(table.where("asks"), QUERIES, QUERIES)

    named = lambda df, side: df.withColumnsRenamed({c: f"{side}_{c}" for c in queries.columns})
    firsts = blocks.join(blocks.groupBy("cell").agg(F.min("nr").alias("nr")), ["cell", "nr"], "left_semi").drop("nr")
    seeded = named(queries, "q").join(named(firsts, "c"), F.col("q_cell") == F.col("c_cell"))
    seeded = stash(seeded.mapInArrow(_met(width, exact, k, top, True), _PACK), "queries")
    slices = max(1, blocks.count())
    sent = named(seeded.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), "q")
    # Merged, as Spark takes sent for as small as the queries before they are copied, and would broadcast all copies.
    met = sent.hint("merge").join(named(blocks.withColumn("slice", F.pmod(F.xxhash64("nr"), F.lit(slices)).cast("int")), "c").drop("nr"), "slice").drop("slice")
    found = met.mapInArrow(_met(width, exact, k, top, False), "rid bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
