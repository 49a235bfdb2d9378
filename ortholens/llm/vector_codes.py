"""Vectors as short codes: one codebook a part, fitted by Lloyd rounds over members that stay where their entry lives.

Blocks of parts are dealt by (position, entry, salt). In a round every owner assigns the members it holds: those that keep their
entry stay in its files, and only the others are dealt again, at the start of the next round. Each block carries its number of
members and their sums, so the new entries come from a few narrow columns; 128 sums and counts reach the driver, whatever the
number of vectors. Salts follow the counts of the last round, so that an entry with most members is spread over many owners.

Defined cases: vectors that are null or hold null or non-finite components are dropped. Shorter vectors end in zeros up to the
longest one, and all of them up to a multiple of the number of parts. Null ids come last, rows of one id in order of their
vectors, each row on its own. With fewer rows than entries a codebook has as many entries as rows. Components so large that a
squared distance leaves 64 bits raise an OverflowError. Empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholens.llm.common import discard, fresh_path, stash
from ortholens.llm.vectors import extent, integers, usable

#: Parts in one block, and parts that a task holds before it hands out what it has.
BLOCK, HELD = 4_096, 65_536

_BLOCK = "position int, entry int, nr bigint, n bigint, sums array<bigint>, parts binary"
_BLOCK_TYPE = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("nr", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("parts", pa.binary()), ("moved", pa.bool_())])


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance, ties to the lower entry."""
    best, at = None, np.zeros(len(x), dtype=np.int64)
    for k, entry in enumerate(book):
        far = x - entry
        far = np.einsum("ij,ij->i", far, far)
        if best is None:
            best = far
        else:
            at[far < best] = k
            best = np.minimum(best, far)
    return at, best


class _Blocks:
    """Parts gathered by (position, entry), handed out as blocks."""

    def __init__(self, moved: bool, part: int):
        self.moved, self.part, self.held, self.nr = moved, part, defaultdict(list), (part * 2_654_435_761) % 1_000_003

    def add(self, position: int, entry: int, x: np.ndarray) -> None:
        self.held[position, entry].append(x)

    def out(self) -> Iterator[pa.RecordBatch]:
        rows = []
        for (position, entry), found in sorted(self.held.items()):
            x = np.concatenate(found)
            for k in range(0, len(x), BLOCK):
                own, self.nr = x[k : k + BLOCK], self.nr + 1
                rows.append({"position": position, "entry": entry, "nr": self.nr, "n": len(own), "sums": own.sum(0).tolist(), "parts": own.astype(np.int32).tobytes(), "moved": self.moved})
        self.held.clear()
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[k : k + 64], _BLOCK_TYPE)


def _first(books: np.ndarray, scale: int):
    """Vectors to blocks of parts at their nearest entries, all of them yet to be dealt to owners."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, held = _Blocks(True, TaskContext.get().partitionId()), 0
        for b in batches:
            x = integers(b.column("v"), scale, parts * width)
            for j in range(parts):
                own = x[:, j * width : (j + 1) * width]
                at, _ = nearest(own, books[j])
                for k in np.unique(at).tolist():
                    gone.add(j, k, own[at == k])
            if (held := held + len(x) * parts) >= HELD:
                yield from gone.out()
                held = 0
        yield from gone.out()

    return run


def _again(books: np.ndarray):
    """Blocks of members to blocks of those that stay and blocks of those whose entry changes."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stay, gone, held = _Blocks(False, part), _Blocks(True, part), 0
        for b in batches:
            for j, entry, raw in zip(b.column("position").to_pylist(), b.column("entry").to_pylist(), b.column("parts"), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype=np.int32).reshape(-1, width).astype(np.int64)
                at, _ = nearest(x, books[j])
                for k in np.unique(at).tolist():
                    (stay if k == entry else gone).add(j, k, x[at == k])
                held += len(x)
            if held >= HELD:
                yield from stay.out()
                yield from gone.out()
                held = 0
        yield from stay.out()
        yield from gone.out()

    return run


def _updated(books: np.ndarray, members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The books with each used entry at the floor of its members' mean, and the members of each entry."""
    books, counts = books.copy(), np.zeros(books.shape[:2], dtype=np.int64)
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(books.shape[2])]
    for r in members.groupBy("position", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        counts[r["position"], r["entry"]] = r["n"]
        books[r["position"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(books.shape[2])]
    return books, counts


def fit(rows: DataFrame, books: np.ndarray, rounds: int, scale: int) -> np.ndarray:
    """The books (part, entry, component) after the rounds, over rows (v)."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(df: DataFrame) -> tuple[str, DataFrame]:
        path = fresh_path(spark, "members")
        df.write.partitionBy("moved").parquet(path)
        return path, spark.read.schema(f"{_BLOCK}, moved boolean").parquet(path)

    path, members = written(rows.select("v").mapInArrow(_first(books, scale), f"{_BLOCK}, moved boolean"))
    for k in range(rounds):
        old, (books, counts) = books, _updated(books, members)
        if k == rounds - 1 or (old == books).all():  # equal books assign, and so change, nothing any more
            break
        share = max(1, -(-int(counts.sum()) // (4 * n)))
        salts = F.array(*(F.lit(int(max(1, -(-c // share)))) for c in counts.ravel()))
        salt = F.pmod(F.col("nr"), salts[F.col("position") * counts.shape[1] + F.col("entry")])
        came = members.where("moved").withColumn("salt", salt).repartition("position", "entry", "salt").drop("salt")
        before = path
        path, members = written(members.where("not moved").unionByName(came).mapInArrow(_again(books), f"{_BLOCK}, moved boolean"))
        discard(spark, before)
    discard(spark, path)
    return books


def _coded(books: np.ndarray, scale: int):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("v"), scale, parts * width)
            found = [nearest(x[:, j * width : (j + 1) * width], books[j]) for j in range(parts)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            code = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), code, pa.array(sum(far for _, far in found))], ["vec_id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: each vector's nearest entries, part by part, as two hex digits each.

    Components are floor(scale * x). The books start as the parts of the rows with the least ids; `error` sums the squared
    distances to the final entries, `label_error` the errors of equal labels, nulls together.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries")
    rows = usable(vectors, "vec_id", "label")
    n, width, most = extent(rows)
    width = max(1, -(-width // parts))
    if parts * width * (2 * (scale * most + 1)) ** 2 >= 2**63:
        raise OverflowError("squared distances do not fit in 64 bits")
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    start = integers(least, scale, parts * width).reshape(-1, parts, width).transpose(1, 0, 2)
    books = fit(rows, start, rounds, scale) if n else start
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = stash(rows.mapInArrow(_coded(books, scale), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
