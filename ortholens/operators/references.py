"""Reference construction and id recoding: joins on gene, protein and isoform ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholens.functions import ids
from ortholens.sources.shared import counted


def build_reference(og2genes: DataFrame, genes: DataFrame, species: DataFrame) -> DataFrame:
    """group_id, spp, gene (composed ids), source, status: `mapped`, `missing id` or `not in map` for each og2genes row.

    genes: gene_id, taxon, protein_id, synonyms, uniprot, ensembl; species: taxon, spp.
    """
    g = genes.select(F.col("gene_id").alias("key"), "taxon", "protein_id", "synonyms", "uniprot", "ensembl")
    j = og2genes.join(g, F.col("gene_id") == F.col("key")).join(species, "taxon", "left")
    gene, source = ids.compose(ids.first_numeric(F.col("synonyms")), F.col("protein_id"), ids.strip_version(F.col("ensembl")), F.col("uniprot"))
    status = F.when(F.col("spp").isNull(), "not in map").when(gene.isNull(), "missing id").otherwise("mapped")
    return j.select(F.col("og_id").alias("group_id"), "spp", gene.alias("gene"), source.alias("source"), status.alias("status"))


def build_lookup(records: DataFrame) -> DataFrame:
    """spp, kind, id, gene: the first record's gene for each protein id and each numeric gene id, from CDS and gene records if
    records have a feature."""
    if "feature" in records.columns:
        records = records.where("feature in ('CDS', 'gene')")
    one = lambda col, kind: records.where(F.col(col).isNotNull()).select("spp", F.lit(kind).alias("kind"), F.col(col).alias("id"), "gene", "line_no")
    return one("protein_id", "protein_id").unionByName(one("numeric_id", "geneid")).groupBy("spp", "kind", "id").agg(F.min_by("gene", F.struct("line_no", "gene")).alias("gene"))


def build_lookup_counted(records: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """build_lookup, and n_records, n_missing (CDS without protein id), n_ignored (other features), counted in one pass."""
    kept, n = counted(
        records, "lookup", n_records=F.count(F.lit(1)), n_missing=F.count_if((F.col("feature") == "CDS") & F.col("protein_id").isNull()),
        n_ignored=F.count_if(~F.coalesce(F.col("feature").isin("CDS", "gene"), F.lit(False))),
    )
    return build_lookup(kept), n


def rename(ref: DataFrame, lookup: DataFrame) -> DataFrame:
    """group_id, spp, gene, source: the first of a row's ids that the lookup knows names the gene; others stay as they are.

    ref: row_id, group_id, spp, gene (comma list), source (comma list in step; a different length raises).
    """
    parts = F.arrays_zip(F.split("gene", ",").alias("id"), F.split("source", ",").alias("kind"))
    ok = F.assert_true(F.size(F.split("gene", ",")) == F.size(F.split("source", ",")), F.lit("ids and sources differ in number"))
    each = ref.withColumn("ok", ok).where("ok is null").select("row_id", "group_id", "spp", "gene", "source", F.posexplode(parts).alias("place", "x"))
    known = each.join(lookup.select("spp", "kind", "id", F.col("gene").alias("name")), (each["spp"] == lookup["spp"]) & (F.col("x.id") == F.col("id")) & (F.col("x.kind") == F.col("kind")), "left").drop(lookup["spp"])
    found = known.groupBy("row_id", "group_id", "spp", "gene", "source").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("place"))).alias("new"))
    return found.select("row_id", "group_id", "spp", F.coalesce("new", "gene").alias("gene"), F.when(F.col("new").isNotNull(), "renamed").otherwise(F.col("source")).alias("source"))


def recode(groups: DataFrame, id_map: DataFrame, genes: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """group_id, raw, gene, step: an id is tried in the map, among genes and in the extra map, then all three without version.

    step is 1 to 6, or 0 where the id stays as it is.
    """
    maps = [id_map.select(F.col("isoform").alias("id"), "gene"), genes.select(F.col("gene").alias("id"), "gene")]
    if extra is not None:
        maps.append(extra.select(F.col("isoform").alias("id"), "gene"))
    j = groups.withColumn("base", ids.strip_version(F.col("raw")))
    steps = []
    for key in ("raw", "base"):
        for k, m in enumerate(maps):
            name = f"{key}_{k}"
            one = m.groupBy("id").agg(F.min("gene").alias(name)).withColumnRenamed("id", f"id_{name}")
            j = j.join(one, F.col(key) == F.col(f"id_{name}"), "left")
            steps.append((3 * (key == "base") + k + 1, name))
    step = F.coalesce(*(F.when(F.col(n).isNotNull(), k) for k, n in steps), F.lit(0))
    return j.select("group_id", "raw", F.coalesce(*(F.col(n) for _, n in steps), F.col("raw")).alias("gene"), step.alias("step"))


def apply_low_certainty(assign: DataFrame, id_map: DataFrame) -> DataFrame:
    """group_id, gene: proteins of uncertain members by gene, or themselves."""
    m = id_map.groupBy("isoform").agg(F.min("gene").alias("gene"))
    return assign.join(m, F.col("protein") == F.col("isoform"), "left").select("group_id", F.coalesce("gene", "protein").alias("gene"))
