"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholens.functions.seqs import wrap


def groups_wide(groups: DataFrame, species: list[str]) -> DataFrame:
    """#GroupID and one column a species, genes comma-joined in order."""
    cell = F.array_join(F.sort_array(F.collect_set(F.col("gene").cast("string"))), ", ")
    return groups.groupBy(F.col("group_id").alias("#GroupID")).pivot("spp", species).agg(cell)


def write_groups_wide(groups: DataFrame, path: str, species: list[str]) -> None:
    groups_wide(groups, species).write.csv(path, sep="\t", header=True, quote="", emptyValue="")


def group_lines(groups: DataFrame) -> DataFrame:
    """`id: g1, g2` lines."""
    genes = F.array_join(F.sort_array(F.collect_set(F.col("gene").cast("string"))), ", ")
    return groups.groupBy("group_id").agg(genes.alias("g")).select(F.concat_ws(": ", F.col("group_id").cast("string"), "g").alias("value"))


def write_group_lines(groups: DataFrame, path: str) -> None:
    group_lines(groups).write.text(path)


def write_partitioned(df: DataFrame, path: str, key: str, fmt: str = "csv") -> None:
    """One folder per key."""
    df.write.partitionBy(key).format(fmt).save(path)


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    """Rows (header, seq) as FASTA, sequences wrapped."""
    seqs.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), wrap(F.col("seq"), width)).alias("value")).write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A tab-separated report with a header."""
    df.write.csv(path, sep="\t", header=True)


def write_named(lines: DataFrame, folder: str, name: str) -> None:
    """Text lines (value) as files `<name>` of a folder: one for each partition, numbered where there are several.

    Spark names its own part files; they are renamed in place, so that readers that go by file names find theirs.
    """
    spark = lines.sparkSession
    part = f"{folder}/.{name}"
    lines.write.text(part)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(str(f.getPath()) for f in fs.listStatus(hadoop.Path(part)) if f.getPath().getName().startswith("part-"))
    stem, _, suffix = name.partition(".")
    for k, f in enumerate(found):
        fs.rename(hadoop.Path(f), hadoop.Path(f"{folder}/{name if len(found) == 1 else f'{stem}.{k}.{suffix}'}"))
    fs.delete(hadoop.Path(part), True)
