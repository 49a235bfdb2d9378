"""Helpers shared by the corpus operators: tables, the shared folder, words and spans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ortholens.sources.shared import shared_dir

#: One white-space character as the contracts define it, and a run of them.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = BLANK + "+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again.

    What was written survives lost executors, and its real size is known to later join planning.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what was written at path and is read no more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words_of(text: Column) -> Column:
    """Array of the runs of non-blank characters; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words, without building them twice: one more than the inner gaps of the trimmed text."""
    return F.size(words_of(text)).cast("long")


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body; an expression that a lambda captures is else evaluated per element."""
    return F.transform(F.array(value), body)[0]


#: Ids that may be broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text (the least, where rows repeat an id) of the documents whose id is in ids(n), written to the shared folder.

    ids is counted first: up to BROADCAST_IDS it is sent to the scan, beyond that both sides are shuffled.
    """
    ids = stash(ids.select("n").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    own = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("n"), "left_semi")
    return stash(own.groupBy("doc_id").agg(F.min("text").alias("text")), "texts")


def settled(df: DataFrame, condition: Column) -> DataFrame:
    """The rows of df that meet the condition on its computed columns, each computed once.

    A plain filter is pushed below the projection and takes a copy of all that it tests along. It stays where it is if the
    projection also numbers the rows and the filter looks at the number.
    """
    marked = df.select("*", F.monotonically_increasing_id().alias("__nr"))
    return marked.where(condition & (F.col("__nr") >= 0)).drop("__nr")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Matches of a text that one fold puts in place; more are placed in blocks.
FOLD = 48


def spans(text: Column, pattern: str, kind: str, rank: int, groups: tuple[int, ...] = ()) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, rank, kind, end, hit, g1..>>, offsets in code points.

    Matches come from regexp_extract_all, the gaps between them from split with the same pattern; their lengths add up
    to the offsets. Texts without a match pay for one scan only. A fold copies what it has for every match it adds, so n matches
    are cut into about sqrt(n) blocks: first the blocks' lengths are summed, then each block is folded from its own offset.
    """
    fields = "start int, rank int, kind string, end int, hit string" + "".join(f", g{g} string" for g in groups)
    none = F.array().cast(f"array<struct<{fields.replace(' int', ':int').replace(' string', ':string')}>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        hits.alias("hit"), gaps.alias("gap"), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups)
    )
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"),
            *(x[f"g{g}"].alias(f"g{g}") for g in groups),
        )
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    def folded(p: Column, at: Column) -> Column:
        return F.aggregate(p, F.struct(at.alias("at"), none.alias("out")), step)["out"]

    def begins(cut: Column) -> Column:
        total = lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + length(x))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(cut, start, lambda a, p: F.struct((a["at"] + total(p)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def blocks(p: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(p))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / width).cast("int")), lambda k: F.slice(p, k * width + 1, width))
        return let(cut, lambda c: F.flatten(F.zip_with(c, begins(c), folded)))

    placed = let(parts, lambda p: F.when(F.size(p) <= FOLD, folded(p, F.lit(0))).otherwise(blocks(p)))
    return F.when(text.rlike(pattern), placed).otherwise(none)


def spans_text(found: Column) -> Column:
    """kind:start:end, comma-joined; the array is sorted by (start, rank) first."""
    return F.array_join(
        F.transform(F.sort_array(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def bare(found: Column) -> Column:
    """Spans without what they matched."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
