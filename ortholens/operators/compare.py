"""Comparison of two groupings: labels from counts only, and the reasons of each missing gene from positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ortholens.functions.maths import pct
from ortholens.operators.bench import majority_groups
from ortholens.operators.groups import GENE, duplicate_classes, multigrouped, overlap, paralog_genes, profile, sizes

NEAR = 100


def classify_reference(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """group_id, label, n_genes, n_pred, missing, extra, misplaced.

    Extra genes are members of touched predicted groups that no reference group has; members of other reference groups are
    misplaced and do not make a superset.
    """
    n = overlap(ref, pred).select(F.col("group_a").alias("group_id"), F.col("group_b").alias("pred"), "n_shared", F.col("size_b").alias("np"))
    p = pred.select(F.col("group_id").alias("pred"), *GENE).distinct()
    strange = p.join(ref.select(*GENE), GENE, "left_anti").groupBy("pred").agg(F.count(F.lit(1)).alias("un"))
    hit = n.join(strange, "pred", "left").na.fill(0, ["un"]).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_pred"), F.sum("n_shared").alias("shared"), F.sum("un").alias("extra"), F.sum(F.col("np") - F.col("un") - F.col("n_shared")).alias("misplaced")
    )
    j = sizes(ref).join(hit, "group_id", "left").na.fill(0).withColumn("missing", F.col("n_genes") - F.col("shared"))
    parts = F.array_compact(F.array(
        F.when(F.col("n_pred") > 1, "Split"), F.when(F.col("missing") > 0, "Subset"), F.when(F.col("extra") > 0, "Superset")
    ))
    label = F.when(F.col("n_pred") == 0, "Absent").when(F.size(parts) == 0, "Equal").otherwise(F.array_join(parts, "+"))
    return j.select("group_id", label.alias("label"), "n_genes", "n_pred", "missing", "extra", "misplaced")


def classify_other(other: DataFrame, pred: DataFrame, n_spp: int | None = None) -> DataFrame:
    """group_id, label, n_genes, n_pred, n_shared, n_union, n_multi, paralogous, single_copy, duplicate (another group has the
    same members), resolved (pred has the same genes, in one group or several), n_lost (genes that pred lacks), n_extra (genes of
    the touched predicted groups that this one lacks) and n_strange (those in no other-group) per other-group."""
    strange = pred.select(F.col("group_id").alias("group_b"), *GENE).distinct().join(other.select(*GENE), GENE, "left_anti").groupBy("group_b").agg(F.count(F.lit(1)).alias("un"))
    hit = overlap(other, pred).join(strange, "group_b", "left").groupBy(F.col("group_a").alias("group_id")).agg(
        F.count(F.lit(1)).alias("n_pred"), F.sum("n_shared").alias("n_shared"), F.sum("size_b").alias("n_union"), F.sum(F.coalesce("un", F.lit(0))).alias("n_strange")
    )
    twice = duplicate_classes(other).select("group_id", F.lit(True).alias("duplicate"))
    many = multigrouped(other).select(*GENE)
    o = other.select("group_id", *GENE).distinct()
    multi = o.join(many, GENE, "left_semi")
    n_multi = multi.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_multi"))
    alone = multi.join(pred.select(*GENE), GENE, "left_anti").groupBy("group_id").agg(F.count(F.lit(1)).alias("multi_extra"))
    j = profile(other, n_spp).join(hit, "group_id", "left").join(n_multi, "group_id", "left").join(alone, "group_id", "left").na.fill(0)
    j = j.join(twice, "group_id", "left").na.fill(False, ["duplicate"])
    extra, all_in = F.col("n_genes") - F.col("n_shared"), F.col("n_union") == F.col("n_shared")
    label = (
        F.when(F.col("n_pred") == 0, "Missing")
        .when(all_in & (extra == 0), F.when(F.col("n_pred") > 1, "Split").otherwise("Equal"))
        .when(all_in & (extra == F.col("multi_extra")), "MultiGroups")
        .when(all_in, "Superset")
        .when(extra == 0, "Subset")
        .otherwise("Conflict")
    )
    return j.select(
        "group_id", label.alias("label"), "n_genes", "n_pred", "n_shared", "n_union", "n_multi", F.col("single_spp").alias("paralogous"), "single_copy",
        "duplicate", label.isin("Equal", "Split").alias("resolved"), extra.alias("n_lost"), (F.col("n_union") - F.col("n_shared")).alias("n_extra"), "n_strange",
    )


def classify_consensus(pred: DataFrame, merged: DataFrame) -> DataFrame:
    """group_id, relation, a_in_b, b_in_a, n_other: each predicted group against the merged groups that it touches."""
    hit = overlap(pred, merged).groupBy(F.col("group_a").alias("group_id")).agg(
        F.count(F.lit(1)).alias("n_other"), F.sum("n_shared").alias("shared"), F.max("size_b").alias("size_b")
    )
    j = sizes(pred).join(hit, "group_id", "left").na.fill(0)
    a_in, b_in = F.col("shared") == F.col("n_genes"), F.col("shared") == F.col("size_b")
    one = F.col("n_other") == 1
    relation = (
        F.when(F.col("n_other") == 0, "Not in merged").when(~one, "Split").when(a_in & b_in, "Equal").when(a_in, "Subset").when(b_in, "Superset").otherwise("Diff")
    )
    return j.select("group_id", relation.alias("relation"), (one & a_in).alias("a_in_b"), (one & b_in).alias("b_in_a"), "n_other")


def class_counts(labels: DataFrame, by: str = "label", second: str | None = None) -> DataFrame:
    """Counts by label, by label and second column, and in total, in one pass; nulls stand for 'all'. With percent of all."""
    cols = [by] if second is None else [by, second]
    total = labels.rollup(*cols).agg(F.count(F.lit(1)).alias("n"))
    return total.select("*", pct(F.col("n"), F.max("n").over(Window.partitionBy())).alias("percent"))


def nearest_member(rows: DataFrame, key: str = "group_id") -> DataFrame:
    """Adds distance: indices to the nearest other row of the same key, species and chromosome with is_member; null if none.

    Two window functions over the ordered positions instead of comparing each row with each member.
    """
    w = Window.partitionBy(key, "spp", "chrom").orderBy("idx", "gene")
    at = F.when(F.col("is_member"), F.col("idx"))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.select("*", F.least(F.col("idx") - before, after - F.col("idx")).alias("distance"))


def missing_reasons(groups: DataFrame, pred: DataFrame, positions: DataFrame, dist: int = NEAR, among: DataFrame | None = None) -> DataFrame:
    """group_id, spp, gene, reason, distance for every gene of groups that pred lacks.

    Multi-grouped are genes in several groups of `among`, the grouping that groups are taken from (groups itself, if not given).
    """
    many = multigrouped(groups if among is None else among).select(*GENE, F.lit(True).alias("many"))
    g = groups.select("group_id", *GENE).distinct()
    p = pred.select(*GENE).distinct().withColumn("has", F.lit(True))
    rows = g.join(p, GENE, "left").join(positions.select(*GENE, "chrom", "idx"), GENE, "left").withColumn("is_member", F.col("has").isNotNull())
    placed = nearest_member(rows)
    spp_has = F.max(F.col("is_member").cast("int")).over(Window.partitionBy("group_id", "spp")) == 1
    reason = (
        F.when(F.col("idx").isNull(), "Not in Annotation").when(F.col("many"), "Multi-Grouped").when(~F.col("spp_has"), "No Ortholog Detected")
        .when(F.col("distance").isNull(), "Different Chromosome").when(F.col("distance") <= dist, "Sequence Similarity").otherwise("Distance")
    )
    lost = placed.withColumn("spp_has", spp_has).where(~F.col("is_member")).join(many, GENE, "left").na.fill(False, ["many"])
    return lost.select("group_id", *GENE, reason.alias("reason"), F.when(F.col("idx").isNotNull() & F.col("spp_has"), F.col("distance")).alias("distance"))


def split_reasons(groups: DataFrame, pred: DataFrame, positions: DataFrame, dist: int = NEAR) -> DataFrame:
    """group_id, spp, gene, pred, majority, reason, distance of genes outside the predicted group that most genes of their
    species in the group are in; the distance is that to its nearest member."""
    m = groups.select("group_id", *GENE).distinct().join(pred.select(F.col("group_id").alias("pred"), *GENE).distinct(), GENE)
    best = majority_groups(m.withColumnRenamed("group_id", "ref")).select(F.col("ref").alias("group_id"), "spp", F.col("pred").alias("majority"))
    rows = m.join(best, ["group_id", "spp"]).join(positions.select(*GENE, "chrom", "idx"), GENE, "left")
    placed = nearest_member(rows.withColumn("is_member", F.col("pred") == F.col("majority"))).where("not is_member")
    reason = (
        F.when(F.col("idx").isNull(), "Not in Annotation").when(F.col("distance").isNull(), "Different Chromosome")
        .when(F.col("distance") <= dist, "Sequence Similarity").otherwise("Distance")
    )
    return placed.select("group_id", *GENE, "pred", "majority", reason.alias("reason"), F.when(F.col("idx").isNotNull(), F.col("distance")).alias("distance"))


def superset_detail(other: DataFrame, pred: DataFrame, positions: DataFrame, dist: int = NEAR) -> DataFrame:
    """group_id, the number of un-grouped genes by reason, and whether all, some or none of their species are missing."""
    sup = classify_other(other, pred).where("label = 'Superset'").select("group_id")
    r = missing_reasons(other.join(sup, "group_id", "left_semi"), pred, positions, dist, other)
    n = lambda text, name: F.count_if(F.col("reason") == text).alias(name)
    out = r.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_missing"), n("Not in Annotation", "not_in_annotation"), n("No Ortholog Detected", "spp_missing"),
        n("Different Chromosome", "different_chrom"), n("Sequence Similarity", "sequence_similarity"), n("Distance", "distance"), n("Multi-Grouped", "multi_grouped"),
    )
    tag = F.when(F.col("spp_missing") == F.col("n_missing"), "All Missing").when(F.col("spp_missing") > 0, "Partially Missing").otherwise("None Missing")
    return out.select("*", tag.alias("tag"))


def _extra_kinds(other: DataFrame, pred: DataFrame, label: str) -> DataFrame:
    """group_id, kind counts of the genes of touched predicted groups that the other-group lacks, for groups of a label."""
    chosen = classify_other(other, pred).where(F.col("label") == label).select("group_id")
    o = other.select("group_id", *GENE).distinct()
    touched = overlap(other.join(chosen, "group_id", "left_semi"), pred).select(F.col("group_a").alias("group_id"), F.col("group_b").alias("pred"))
    p = pred.select(F.col("group_id").alias("pred"), *GENE).distinct()
    extra = touched.join(p, "pred").join(o, ["group_id", *GENE], "left_anti")
    flag = lambda df, name: df.select(*GENE).distinct().withColumn(name, F.lit(True))
    single = profile(other).where("single_spp").select("group_id")
    f = (
        extra.join(flag(other.join(single, "group_id", "left_semi"), "para"), GENE, "left").join(flag(multigrouped(other), "multi"), GENE, "left")
        .join(flag(other, "grouped"), GENE, "left").na.fill(False)
    )
    c = lambda cond, name: F.count_if(cond).alias(name)
    para, multi, grouped = F.col("para"), F.col("multi"), F.col("grouped")
    return f.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_extra"), c(para & ~multi, "paralogous"), c(para & multi, "both"), c(multi & ~para, "multigrouped"),
        c(~grouped, "not_grouped"), c(grouped & ~para & ~multi, "another_group"),
    )


def _mix_label(all_: Column) -> Column:
    n = F.col("n_extra")
    return (
        F.when(F.col("paralogous") + F.col("both") == n, "all paralogs").when(F.col("multigrouped") + F.col("both") == n, "all multigrouped")
        .when(F.col("not_grouped") == n, "all ungrouped").otherwise(all_)
    )


def subset_detail(other: DataFrame, pred: DataFrame) -> DataFrame:
    """Kinds of the extra predicted genes of groups that are subsets, and one label."""
    return _extra_kinds(other, pred, "Subset").select("*", _mix_label(F.lit("mixed")).alias("detail"))


def conflict_detail(other: DataFrame, pred: DataFrame, positions: DataFrame, dist: int = NEAR) -> DataFrame:
    """For groups in conflict: kinds of extra predicted genes and reasons of missing ones."""
    extra = _extra_kinds(other, pred, "Conflict")
    missing = missing_reasons(other.join(extra.select("group_id"), "group_id", "left_semi"), pred, positions, dist, other)
    n = lambda text, name: F.count_if(F.col("reason") == text).alias(name)
    why = missing.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_missing"), n("Not in Annotation", "not_in_annotation"), n("No Ortholog Detected", "spp_missing"),
        n("Different Chromosome", "different_chrom"), n("Sequence Similarity", "sequence_similarity"), n("Distance", "distance"), n("Multi-Grouped", "multi_grouped_missing"),
    )
    return extra.join(why, "group_id", "left").na.fill(0).select("*", _mix_label(F.lit("mixed")).alias("detail"))


def split_cause(groups: DataFrame, positions: DataFrame, gap: int = 150) -> DataFrame:
    """group_id, n_multi_chrom, n_wide, cause: synteny if over one species has several chromosomes, or a gap over `gap`."""
    placed = groups.select("group_id", *GENE).distinct().join(positions.select(*GENE, "chrom", "idx"), GENE)
    w = Window.partitionBy("group_id", "spp", "chrom").orderBy("idx", "gene")
    step = placed.withColumn("gap", F.col("idx") - F.lag("idx").over(w))
    per = step.groupBy("group_id", "spp").agg(F.count_distinct("chrom").alias("n_chrom"), F.max("gap").alias("gap"))
    out = per.groupBy("group_id").agg(F.count_if(F.col("n_chrom") > 1).alias("n_multi_chrom"), F.count_if(F.col("gap") > gap).alias("n_wide"))
    return out.select("*", F.when((F.col("n_multi_chrom") > 1) | (F.col("n_wide") > 1), "synteny").otherwise("sequence").alias("cause"))


def missing_cause(groups: DataFrame, pred: DataFrame, positions: DataFrame, near: int = 150) -> DataFrame:
    """group_id, spp, gene, cause of placed genes that pred lacks: sequence if within `near` indices of the first or last gene
    of their group, species and chromosome that pred has, else synteny."""
    placed = groups.select("group_id", *GENE).distinct().join(positions.select(*GENE, "chrom", "idx"), GENE)
    has = placed.join(pred.select(*GENE), GENE, "left_semi")
    ends = has.groupBy("group_id", "spp", "chrom").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    lost = placed.join(pred.select(*GENE), GENE, "left_anti").join(ends, ["group_id", "spp", "chrom"], "left")
    close = F.least(F.abs(F.col("idx") - F.col("first")), F.abs(F.col("idx") - F.col("last"))) <= near
    return lost.select("group_id", *GENE, F.when(close, "sequence").otherwise("synteny").alias("cause"))


def two_method_report(pred: DataFrame, other: DataFrame) -> DataFrame:
    """group_id, relation, detail of each other-group against pred, with the cases of subsets and supersets told apart;
    n_paralogs: genes of its predicted groups that other keeps in one-species groups."""
    n = overlap(other, pred)
    hit = n.groupBy(F.col("group_a").alias("group_id")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n_shared").alias("shared"), F.sum("size_b").alias("union"), F.count_if(F.col("n_shared") == F.col("size_b")).alias("whole")
    )
    j = sizes(other).join(hit, "group_id", "left").join(paralogs_met(pred, other), "group_id", "left").na.fill(0)
    j = j.withColumn("missing", F.col("n_genes") - F.col("shared")).withColumn("rest", F.col("union") - F.col("shared"))
    k, missing, rest = F.col("k"), F.col("missing"), F.col("rest")
    relation = F.when(k == 0, "Absent").when((missing == 0) & (rest == 0), F.when(k == 1, "Equal").otherwise("Split")).when(rest == 0, "Superset").when(missing == 0, "Subset").otherwise("Mixed")
    detail = (
        F.when(k == 0, "no member").when((missing == 0) & (rest == 0), "same genes")
        .when(rest == 0, F.when(k == 1, "missing only").otherwise("split and missing"))
        .when(missing == 0, F.when(k == 1, "other has more").when(F.col("whole") == 0, "split with others").otherwise("split, some whole"))
        .when(rest < missing, "less remainder").when(rest > missing, "greater remainder").otherwise("equal remainder")
    )
    return j.select("group_id", relation.alias("relation"), detail.alias("detail"), k.alias("n_pred"), "missing", "rest", "n_paralogs")


def two_method_reasons(pred: DataFrame, other: DataFrame, positions: DataFrame, dist: int = 15) -> DataFrame:
    """group_id, relation, spp, gene, reason, distance: genes that pred lacks, with reasons at a short distance."""
    lost = missing_reasons(other, pred, positions, dist)
    return lost.join(two_method_report(pred, other).select("group_id", "relation"), "group_id").select("group_id", "relation", *GENE, "reason", "distance")


def paralogs_met(pred: DataFrame, other: DataFrame) -> DataFrame:
    """group_id, n_paralogs: for each other-group the genes that its predicted groups add and other keeps in a one-species group."""
    own = other.select("group_id", *GENE).distinct()
    touched = overlap(other, pred).select(F.col("group_a").alias("group_id"), F.col("group_b").alias("pred"))
    extra = touched.join(pred.select(F.col("group_id").alias("pred"), *GENE).distinct(), "pred").join(own, ["group_id", *GENE], "left_anti")
    return extra.join(paralog_genes(other).select(*GENE).distinct(), GENE, "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_paralogs"))


def pairwise_tables(pairs: DataFrame, pred: DataFrame) -> DataFrame:
    """spp_a, spp_b, n_rows, equal, split, partly_one, partly_many, absent, n_missing over rows (spp_a, spp_b, row_id, spp, gene)."""
    key = ["spp_a", "spp_b", "row_id"]
    p = pred.groupBy(*GENE).agg(F.min("group_id").alias("pred"))
    per = pairs.join(p, GENE, "left").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("pred").alias("found"), F.count_distinct("pred").alias("k"))
    whole, one = F.col("found") == F.col("n"), F.col("k") == 1
    c = lambda cond, name: F.count_if(cond).alias(name)
    return per.groupBy("spp_a", "spp_b").agg(
        F.count(F.lit(1)).alias("n_rows"), c(whole & one, "equal"), c(whole & ~one, "split"), c(~whole & one, "partly_one"), c(~whole & (F.col("k") > 1), "partly_many"),
        c(F.col("k") == 0, "absent"), F.sum(F.col("n") - F.col("found")).alias("n_missing"),
    )


def group_consistency(pred: DataFrame, merged: DataFrame) -> DataFrame:
    """pred, spp, gene, merged, main: members whose merged group is absent or not the one most members have (ties: least)."""
    m = merged.groupBy(*GENE).agg(F.min("group_id").alias("merged"))
    j = pred.select(F.col("group_id").alias("pred"), *GENE).distinct().join(m, GENE, "left")
    n = j.where("merged is not null").groupBy("pred", "merged").agg(F.count(F.lit(1)).alias("n"))
    main = n.groupBy("pred").agg(F.min_by("merged", F.struct(-F.col("n"), "merged")).alias("main"))
    return j.join(main, "pred").where("merged is null or merged <> main").select("pred", *GENE, "merged", "main")
