"""Anchor pairs, tree clusters and chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ortholens.operators.annotation import overlapping


def contradictions(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """gene_a, gene_b, group_a, group_b, issue: anchor pairs whose genes are in different groups, or in none."""
    g = groups.groupBy("gene").agg(F.min("group_id").alias("g"))
    j = pairs.join(g.toDF("gene_a", "group_a"), "gene_a", "left").join(g.toDF("gene_b", "group_b"), "gene_b", "left")
    a, b = F.col("group_a"), F.col("group_b")
    issue = F.when(a.isNull() & b.isNull(), "both missing").when(a.isNull(), "a missing").when(b.isNull(), "b missing").when(a != b, "different groups")
    return j.withColumn("issue", issue).where("issue is not null").select("gene_a", "gene_b", "group_a", "group_b", "issue")


def contradiction_counts(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """file (null: all), n_pairs, different, a_missing, b_missing, both_missing over pairs (file, gene_a, gene_b)."""
    g = groups.groupBy("gene").agg(F.min("group_id").alias("g"))
    j = pairs.join(g.toDF("gene_a", "ga"), "gene_a", "left").join(g.toDF("gene_b", "gb"), "gene_b", "left")
    a, b = F.col("ga").isNull(), F.col("gb").isNull()
    return j.rollup("file").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("ga") != F.col("gb")).alias("different"), F.count_if(a & ~b).alias("a_missing"),
        F.count_if(~a & b).alias("b_missing"), F.count_if(a & b).alias("both_missing"),
    )


def tree_vs_pairs(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """org, gene, issues: per tree gene and partner, whether pairs lack the gene, the link, or link to another gene.

    tree: org, gene, partners array<struct<org, gene>>; pairs: org_a, gene_a, org_b, gene_b.
    """
    p = tree.select("org", "gene", F.explode("partners").alias("x")).select("org", "gene", F.col("x.org").alias("p_org"), F.col("x.gene").alias("p_gene"))
    link = pairs.groupBy(F.col("org_a").alias("org"), F.col("gene_a").alias("gene"), F.col("org_b").alias("p_org")).agg(F.collect_set("gene_b").alias("to"))
    seen = pairs.select(F.col("org_a").alias("org"), F.col("gene_a").alias("gene")).distinct().withColumn("seen", F.lit(True))
    j = p.join(link, ["org", "gene", "p_org"], "left").join(seen, ["org", "gene"], "left")
    issue = F.when(F.col("seen").isNull(), "missing gene").when(F.col("to").isNull(), "not linked").when(~F.array_contains("to", F.col("p_gene")), "other gene")
    bad = j.withColumn("issue", issue).where("issue is not null")
    text = F.concat_ws(" ", F.col("p_org").cast("string"), F.col("p_gene").cast("string"), F.col("issue"))
    return bad.groupBy("org", "gene").agg(F.array_join(F.sort_array(F.collect_list(text)), "; ").alias("issues"))


def alg_table(tree: DataFrame, n_orgs: int, min_keys: int = 5) -> DataFrame:
    """key, org, chrom, n_genes, total, n_clusters: clusters present in all orgs, merged by their set of org:chrom."""
    spot = F.concat_ws(":", F.col("org").cast("string"), F.col("chrom").cast("string"))
    per = tree.groupBy("cluster_id").agg(F.count_distinct("org").alias("k"), F.array_join(F.sort_array(F.collect_set(spot)), ",").alias("key")).where(F.col("k") == n_orgs)
    counted = per.groupBy("key").agg(F.count(F.lit(1)).alias("n_clusters")).where(F.col("n_clusters") >= min_keys)
    rows = tree.join(per.select("cluster_id", "key"), "cluster_id").join(counted, "key")
    out = rows.groupBy("key", "n_clusters", "org", "chrom").agg(F.count(F.lit(1)).alias("n_genes"))
    return out.select("key", "org", "chrom", "n_genes", F.sum("n_genes").over(Window.partitionBy("key")).alias("total"), "n_clusters")


def best_partner_chrom(pairs: DataFrame) -> DataFrame:
    """chrom_a, chrom_b, covered: per chromosome the partner with most summed anchor length, ties to the least name."""
    s = pairs.groupBy("chrom_a", "chrom_b").agg(F.sum(F.col("end_a") - F.col("start_a")).alias("covered"))
    best = F.min_by(F.struct("chrom_b", "covered"), F.struct(-F.col("covered"), "chrom_b")).alias("b")
    return s.groupBy("chrom_a").agg(best).select("chrom_a", "b.*")


def orientation(pairs: DataFrame) -> DataFrame:
    """chrom_a, chrom_b, n, slope, reversed: slope of start_b over start_a; no slope counts as forward."""
    s = pairs.groupBy("chrom_a", "chrom_b").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col("start_b").cast("double"), F.col("start_a").cast("double")).alias("slope"))
    return s.select("chrom_a", "chrom_b", "n", F.round("slope", 6).alias("slope"), F.coalesce(F.col("slope") < -1e-9, F.lit(False)).alias("reversed"))


def linear_coordinates(chroms: DataFrame) -> DataFrame:
    """Adds offset: summed length of longer chromosomes of the species before this one, ties by name."""
    w = Window.partitionBy("spp").orderBy(F.desc("length"), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    return chroms.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def chrom_pairs(pairs: DataFrame, chroms_a: DataFrame, chroms_b: DataFrame) -> DataFrame:
    """One row per pair of listed chromosomes: anchors, covered length, lengths, offsets, best partner, reversed."""
    a = linear_coordinates(chroms_a).select(F.col("chrom").alias("chrom_a"), F.col("length").alias("length_a"), F.col("offset").alias("offset_a"))
    b = linear_coordinates(chroms_b).select(F.col("chrom").alias("chrom_b"), F.col("length").alias("length_b"), F.col("offset").alias("offset_b"))
    kept = pairs.join(a.select("chrom_a"), "chrom_a", "left_semi").join(b.select("chrom_b"), "chrom_b", "left_semi")
    n = kept.groupBy("chrom_a", "chrom_b").agg(F.count(F.lit(1)).alias("n_anchors"), F.sum(F.col("end_a") - F.col("start_a")).alias("covered"))
    best = best_partner_chrom(kept).select("chrom_a", "chrom_b", F.lit(True).alias("best"))
    turned = orientation(kept).select("chrom_a", "chrom_b", "reversed")
    return n.join(a, "chrom_a").join(b, "chrom_b").join(best, ["chrom_a", "chrom_b"], "left").join(turned, ["chrom_a", "chrom_b"]).na.fill(False, ["best"])


def chain(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """Three genomes: rows of ab continued to bc through the best partners of b."""
    first = ab.where("best").select("chrom_a", "chrom_b", F.col("n_anchors").alias("n_ab"))
    return first.join(bc.select(F.col("chrom_a").alias("chrom_b"), F.col("chrom_b").alias("chrom_c"), F.col("n_anchors").alias("n_bc")), "chrom_b")


def te_in_windows(te: DataFrame, anchors: DataFrame, max_dist: int = 1_000_000) -> DataFrame:
    """Elements within max_dist of an anchor gene: te rows beside anchor rows (chrom, start, end, anchor)."""
    w = anchors.select("chrom", (F.col("start") - max_dist).alias("w_start"), (F.col("end") + max_dist).alias("w_end"), "anchor")
    return overlapping(te, w, max(2 * max_dist, 1))


def te_ortholog_pairs(te_a: DataFrame, te_b: DataFrame) -> DataFrame:
    """te_a, te_b, anchor, family: elements (te, anchor, order, family, start) of both species paired per anchor and family.

    An element belongs to its first anchor. The k-th of one side meets the k-th of the other; the surplus of the longer side
    attaches to the last of the shorter.
    """

    def placed(te: DataFrame) -> DataFrame:
        first = te.groupBy("te").agg(F.min_by(F.struct("anchor", "family", "start"), F.struct("order", "anchor")).alias("x")).select("te", "x.*")
        return first.withColumn("k", F.row_number().over(Window.partitionBy("anchor", "family").orderBy("start", "te")))

    def met(own: DataFrame, other: DataFrame, names: list[str], surplus: bool) -> DataFrame:
        """Each element beside the one of the other side whose rank it meets; one row an element."""
        n = other.groupBy("anchor", "family").agg(F.max("k").alias("n"))
        rank = own.join(n, ["anchor", "family"]).where("k > n" if surplus else "true").select("anchor", "family", F.col("te").alias(names[0]), F.least("k", "n").alias("k"))
        return rank.join(other.select("anchor", "family", "k", F.col("te").alias(names[1])), ["anchor", "family", "k"]).select("te_a", "te_b", "anchor", "family")

    a, b = placed(te_a), placed(te_b)
    return met(a, b, ["te_a", "te_b"], False).unionByName(met(b, a, ["te_b", "te_a"], True))
