"""The stateless operators on file streams: the same joins with a static side, one micro-batch at a time.

Nothing here keeps state, so no watermark is needed; the sink's checkpoint makes restarts exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ortholens.operators.groups import filter_by_taxon, filter_og2genes


def stream_lines(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Tab-separated files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("sep", "\t").option("maxFilesPerTrigger", files_per_batch).csv(path)


def stream_og2genes(spark: SparkSession, path: str, og_ids: DataFrame, taxa: DataFrame) -> DataFrame:
    """og2genes rows of listed groups and taxa."""
    return filter_og2genes(stream_lines(spark, path, "og_id string, gene_id string"), og_ids, taxa)


def stream_genes(spark: SparkSession, path: str, taxa: DataFrame) -> DataFrame:
    """Gene rows of listed taxa."""
    schema = "gene_id string, taxon string, protein_id string, synonyms string, uniprot string, ensembl string"
    return filter_by_taxon(stream_lines(spark, path, schema), taxa)


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, as Parquet, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
