"""Hits, gene symbols and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholens.functions.ids import first_of_list, named
from ortholens.functions.maths import log_product


def for_groups(rows: DataFrame, groups: DataFrame, key: str = "query") -> DataFrame:
    """Rows (hits or sequences) of every member of a group, with group_id."""
    return rows.join(groups.select("group_id", F.col("gene").alias(key)).distinct(), key)


def group_matrix(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, gene_a, gene_b, best, same_group: best score of every cross-species pair of a group (0 without hit), and of
    hits between different groups. hits: gene_a, gene_b, score in either direction."""
    both = hits.select(F.least("gene_a", "gene_b").alias("gene_a"), F.greatest("gene_a", "gene_b").alias("gene_b"), "score")
    best = both.groupBy("gene_a", "gene_b").agg(F.max("score").alias("best"))
    x, y = groups.select("group_id", F.col("spp").alias("sa"), F.col("gene").alias("gene_a")), groups.select("group_id", F.col("spp").alias("sb"), F.col("gene").alias("gene_b"))
    own = x.join(y, "group_id").where("sa <> sb and gene_a < gene_b").join(best, ["gene_a", "gene_b"], "left")
    own = own.select("group_id", "gene_a", "gene_b", F.coalesce("best", F.lit(0.0)).alias("best"), F.lit(True).alias("same_group"))
    between = best.join(x, "gene_a").join(y.withColumnRenamed("group_id", "other"), "gene_b").where("sa <> sb and group_id <> other")
    return own.unionByName(between.select("group_id", "gene_a", "gene_b", "best", F.lit(False).alias("same_group")))


def both_duplicated(rbh: DataFrame, duplicated: DataFrame, gene_a: str, gene_b: str) -> DataFrame:
    """rbh with both_dup: both genes of the hit are in duplicated (gene)."""
    d = duplicated.select("gene").distinct()
    side = lambda c, flag: d.select(F.col("gene").alias(c), F.lit(True).alias(flag))
    j = rbh.join(side(gene_a, "__a"), gene_a, "left").join(side(gene_b, "__b"), gene_b, "left")
    return j.withColumn("both_dup", F.col("__a").isNotNull() & F.col("__b").isNotNull()).drop("__a", "__b")


def member_sequences(sequences: DataFrame, id_map: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, gene, seq_id, seq: the sequences of every member; id_map (isoform, gene) leads from sequence to gene."""
    m = id_map.select(F.col("isoform").alias("seq_id"), "gene").distinct()
    return for_groups(sequences.select("seq_id", "seq").join(m, "seq_id"), groups, "gene").select("group_id", "gene", "seq_id", "seq")


def length_regression(rbh: DataFrame, keys: list[str], length_a: str, length_b: str, score: str) -> DataFrame:
    """slope, intercept, r2 of log10(score) on log10 of the length product, per key (with both_dup among them: apart for those)."""
    x, y = log_product(F.col(length_a), F.col(length_b)), F.when(F.col(score) > 0, F.log10(score))
    return rbh.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2")
    )


def resolve_symbols(groups: DataFrame, homologs: DataFrame, first_org: str, second_org: str) -> DataFrame:
    """groups (group_id, org, gene, name) plus symbol: the own name, else that of first_org's homolog, else second_org's."""
    turned = homologs.select("org_a", "id_a", "name_a", "org_b", "id_b", "name_b").unionByName(
        homologs.select(F.col("org_b").alias("org_a"), F.col("id_b").alias("id_a"), F.col("name_b").alias("name_a"), F.col("org_a").alias("org_b"), F.col("id_a").alias("id_b"), F.col("name_a").alias("name_b"))
    )
    other = turned.groupBy(F.col("id_a").alias("gene")).agg(
        F.min(F.when(F.col("org_b") == first_org, named(F.col("name_b")))).alias("s1"), F.min(F.when(F.col("org_b") == second_org, named(F.col("name_b")))).alias("s2")
    )
    return groups.join(other, "gene", "left").select("group_id", "org", "gene", "name", F.coalesce(named(F.col("name")), "s1", "s2").alias("symbol"))


def symbols_per_group(groups: DataFrame) -> DataFrame:
    """group_id, symbols: distinct symbols, comma-joined in order."""
    return groups.groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"))


def term_counts(symbols: DataFrame, terms: DataFrame, namespace: str = "biological_process") -> DataFrame:
    """go_id, term, n: annotated groups per term; a group is represented by its first symbol."""
    s = symbols.select(first_of_list(F.col("symbols")).alias("symbol")).where("symbol <> ''")
    t = terms.where((F.col("namespace") == namespace) & (F.col("go_id") != ""))
    return s.join(t, "symbol").groupBy("go_id", "term").agg(F.count(F.lit(1)).alias("n"))
