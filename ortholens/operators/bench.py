"""Benchmarks of a predicted grouping against a reference: pair precision and recall, and scores of curated groups.

Pairs are never listed. A group is first counted into cells (other group, species); pairs of cells carry the product of
their counts, so a group of a thousand genes costs the square of its cells, not of its genes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ortholens.functions.maths import f1, precision, ratio, recall
from ortholens.operators.groups import GENE, exclude_single_species, top_repeated

SUBSET_PURITY = 0.9


def mapped(pred: DataFrame, ref: DataFrame, col: str = "group_id") -> DataFrame:
    """pred, spp, gene, ref: each predicted gene with its reference group or null; a repeated gene has its least group."""
    r = ref.groupBy(*GENE).agg(F.min(col).alias("ref"))
    p = pred.groupBy(*GENE).agg(F.min("group_id").alias("pred"))
    return p.join(r, GENE, "left").select("pred", *GENE, "ref")


def main_groups(m: DataFrame) -> DataFrame:
    """pred, main, n_main, n_mapped, is_subset: the most frequent reference group, ties to that of the least gene."""
    n = m.where("ref is not null").groupBy("pred", "ref").agg(F.count(F.lit(1)).alias("n"), F.min("gene").alias("least"))
    return n.groupBy("pred").agg(
        F.min_by(F.struct("ref", "n"), F.struct(-F.col("n"), "least")).alias("x"), F.sum("n").alias("n_mapped")
    ).select("pred", F.col("x.ref").alias("main"), F.col("x.n").alias("n_main"), "n_mapped", (F.col("x.n") / F.col("n_mapped") > SUBSET_PURITY).alias("is_subset"))


def _cells(m: DataFrame, key: str, other: str) -> DataFrame:
    return m.groupBy(key, other, "spp").agg(F.count(F.lit(1)).alias("n"))


def _cell_pairs(cells: DataFrame, key: str, other: str) -> DataFrame:
    """Pairs of cells of one group with spp_a < spp_b: key, spp_a, spp_b, x, y, n."""
    a = cells.select(key, F.col(other).alias("x"), F.col("spp").alias("spp_a"), F.col("n").alias("na"))
    b = cells.select(key, F.col(other).alias("y"), F.col("spp").alias("spp_b"), F.col("n").alias("nb"))
    return a.join(b, key).where("spp_a < spp_b").select(key, "spp_a", "spp_b", "x", "y", (F.col("na") * F.col("nb")).alias("n"))


def _sum(cond: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long").alias(name)


def pair_benchmark(pred: DataFrame, ref: DataFrame, rescue: bool = False) -> DataFrame:
    """spp_a, spp_b, tp, fp, fn, skipped_pred, skipped_ref, rescued, precision, recall, f1 per species pair.

    A pair of genes of different species in one predicted group is true if their reference groups agree, or if the group is
    over 90 % one reference group and either gene is of that; pairs with a gene without reference group are skipped. Pairs of a
    reference group that no predicted group holds are false negatives, unless rescued: both groups are subsets of this one.
    """
    kept = exclude_single_species(ref).where("group_id is not null")
    m = mapped(pred, kept)
    main = main_groups(m)
    p = _cell_pairs(_cells(m, "pred", "ref"), "pred", "ref").join(main, "pred", "left")
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    true = (F.col("x") == F.col("y")) | (F.col("is_subset") & ((F.col("main") == F.col("x")) | (F.col("main") == F.col("y"))))
    found = p.groupBy("spp_a", "spp_b").agg(_sum(known & true, "tp"), _sum(known & ~true, "fp"), _sum(~known, "skipped_pred"))
    r = kept.groupBy(*GENE).agg(F.min("group_id").alias("ref")).join(pred.groupBy(*GENE).agg(F.min("group_id").alias("pred")), GENE, "left")
    q = _cell_pairs(_cells(r, "ref", "pred"), "ref", "pred")
    own = main.where("is_subset").select(F.col("pred").alias("s"), F.col("main").alias("sm"))
    q = (
        q.join(own.select(F.col("s").alias("x"), F.col("sm").alias("xm")), "x", "left")
        .join(own.select(F.col("s").alias("y"), F.col("sm").alias("ym")), "y", "left")
    )
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    apart = known & (F.col("x") != F.col("y"))
    saved = apart & F.coalesce((F.col("xm") == F.col("ref")) & (F.col("ym") == F.col("ref")), F.lit(False)) if rescue else F.lit(False)
    lost = q.groupBy("spp_a", "spp_b").agg(_sum(~known | (apart & ~saved), "fn"), _sum(~known, "skipped_ref"), _sum(saved, "rescued"))
    both = found.join(lost, ["spp_a", "spp_b"], "full").na.fill(0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return both.select(
        "spp_a", "spp_b", "tp", "fp", "fn", "skipped_pred", "skipped_ref", "rescued",
        F.round(precision(tp, fp), 6).alias("precision"), F.round(recall(tp, fn), 6).alias("recall"), F.round(f1(tp, fp, fn), 6).alias("f1"),
    )


def misplaced_genes(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """pred, spp, gene, ref, main: genes whose reference group is not the main one of their predicted group."""
    m = mapped(pred, exclude_single_species(ref).where("group_id is not null"))
    return m.join(main_groups(m).select("pred", "main"), "pred").where("ref <> main").select("pred", *GENE, "ref", "main")


def paralog_pairs(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """pred, spp, gene, orig_group, tp_pairs, fp_pairs: genes of single-species reference groups and what their pairs would be."""
    all_ = exclude_single_species(ref)
    m = mapped(pred, all_, "orig_group")
    main = main_groups(m)
    para = m.join(all_.where("group_id is null").select(*GENE).distinct(), GENE, "left_semi")
    cells = _cells(m.where("ref is not null"), "pred", "ref").select("pred", F.col("ref").alias("y"), F.col("spp").alias("spp_b"), "n")
    met = para.join(cells, "pred").where("spp <> spp_b").join(main, "pred")
    true = (F.col("ref") == F.col("y")) | (F.col("is_subset") & ((F.col("main") == F.col("ref")) | (F.col("main") == F.col("y"))))
    return met.groupBy("pred", *GENE, F.col("ref").alias("orig_group")).agg(_sum(true, "tp_pairs"), _sum(~true, "fp_pairs"))


def refog_scores(ref: DataFrame, uncertain: DataFrame, pred: DataFrame) -> DataFrame:
    """group_id, size, tp, fp, fn, exact, even_tp, even_fp, even_fn: scores of curated groups; groups of one gene are left out.

    Uncertain genes of a group count neither in it nor in the predictions that overlap it.
    """
    sure = ref.select("group_id", *GENE).distinct().join(uncertain.select("group_id", *GENE), ["group_id", *GENE], "left_anti")
    size = sure.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    p = pred.select(F.col("group_id").alias("pred"), *GENE).distinct()
    o = sure.join(p, GENE).groupBy("group_id", "pred").agg(F.count(F.lit(1)).alias("o"))
    psize = p.groupBy("pred").agg(F.count(F.lit(1)).alias("np"))
    unsure = uncertain.select("group_id", *GENE).distinct().join(p, GENE).groupBy("group_id", "pred").agg(F.count(F.lit(1)).alias("nu"))
    x = o.join(psize, "pred").join(unsure, ["group_id", "pred"], "left").na.fill(0, ["nu"]).withColumn("na", F.col("np") - F.col("nu"))
    per = x.groupBy("group_id").agg(
        F.sum(F.col("o") * (F.col("o") - 1) / 2).alias("tp"), F.sum(F.col("o") * (F.col("na") - F.col("o"))).alias("fp"),
        F.sum(F.col("o") * F.col("o")).alias("oo"), F.sum("o").alias("present"),
    )
    j = size.where("size > 1").join(per, "group_id", "left").na.fill(0)
    b, here = F.col("size"), F.col("present")
    fn = (b * here - F.col("oo") + (b - here) * (b - 1)) / 2
    k = j.select("group_id", "size", F.col("tp").cast("double").alias("tp"), F.col("fp").cast("double").alias("fp"), fn.cast("double").alias("fn"))
    even = lambda c: F.round(F.col(c) / (b - 1), 6).alias(f"even_{c}")
    return k.select("*", ((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"), even("tp"), even("fp"), even("fn"))


def refog_total(scores: DataFrame) -> DataFrame:
    """precision, recall, f1 in percent over all curated groups, evenly weighted."""
    t = scores.agg(*(F.sum(f"even_{c}").alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.select((100 * precision(tp, fp)).alias("precision"), (100 * recall(tp, fn)).alias("recall"), (100 * f1(tp, fp, fn)).alias("f1"))


def validate_groups(pred: DataFrame, genes: DataFrame) -> DataFrame:
    """check, n: extra and missing genes, genes in several groups, expected species without a gene, coverage in percent."""
    p, g = pred.select(*GENE).distinct(), genes.select(*GENE).distinct()
    many = pred.select("group_id", *GENE).distinct().groupBy(*GENE).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    share = g.join(p.withColumn("has", F.lit(1)), GENE, "left").agg(F.floor(100 * ratio(F.count("has"), F.count(F.lit(1)))).alias("n"))
    return (
        one(p.join(g, GENE, "left_anti"), "extra genes").unionByName(one(g.join(p, GENE, "left_anti"), "missing genes"))
        .unionByName(one(many, "genes in several groups"))
        .unionByName(one(g.select("spp").distinct().join(p.select("spp"), "spp", "left_anti"), "species without genes"))
        .unionByName(share.select(F.lit("coverage percent").alias("check"), "n"))
    )


def majority_groups(m: DataFrame) -> DataFrame:
    """ref, spp, pred: per reference group and species the predicted group with most genes, ties to the least."""
    n = m.where("ref is not null and pred is not null").groupBy("ref", "spp", "pred").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ref", "spp").orderBy(F.desc("n"), "pred")
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").select("ref", "spp", "pred")


def top_paralog_groups(pred: DataFrame, ref: DataFrame, k: int = 5) -> DataFrame:
    """The k predicted groups with most would-be false pairs of genes in single-species reference groups; ties by id."""
    per = paralog_pairs(pred, ref).groupBy("pred").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("tp_pairs").alias("tp_pairs"), F.sum("fp_pairs").alias("fp_pairs"))
    return per.orderBy(F.desc("fp_pairs"), "pred").limit(k)


def paralog_evidence(pred: DataFrame, ref: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds to paralog_pairs whether the gene's species already has a member of the group's main reference group (spp_in_main),
    whether a gene that it would truly pair with has its symbol (same_symbol), and whether its symbol is a placeholder (is_loc).

    symbols: spp, gene, symbol. Genes are compared by equality of symbols, not pair by pair.
    """
    m = mapped(pred, exclude_single_species(ref), "orig_group")
    main = main_groups(m).select("pred", "main")
    has = m.join(main, "pred").where("ref = main").select("pred", "spp").distinct().withColumn("spp_in_main", F.lit(True))
    named = symbols.groupBy(*GENE).agg(F.min("symbol").alias("symbol"))
    mates = m.where("ref is not null").join(named, GENE).select("pred", F.col("ref").alias("y"), F.col("spp").alias("spp_b"), "symbol").distinct()
    own = paralog_pairs(pred, ref).join(named, GENE, "left")
    met = own.join(mates, ["pred", "symbol"]).where("spp <> spp_b").join(main_groups(m), "pred")
    true = (F.col("orig_group") == F.col("y")) | (F.col("is_subset") & ((F.col("main") == F.col("orig_group")) | (F.col("main") == F.col("y"))))
    same = met.where(true).select("pred", *GENE).distinct().withColumn("same_symbol", F.lit(True))
    out = own.join(has, ["pred", "spp"], "left").join(same, ["pred", *GENE], "left")
    return out.withColumn("is_loc", F.coalesce(F.lower("symbol").startswith("loc"), F.lit(False))).na.fill(False, ["spp_in_main", "same_symbol"]).drop("symbol")


def paralog_summary(evidence: DataFrame) -> DataFrame:
    """n_genes, n_concordant (genes with a would-be true pair), and of those the shares with each kind of evidence."""
    true = F.col("tp_pairs") > 0
    part = lambda c: F.round(F.try_divide(F.count_if(true & F.col(c)), F.count_if(true)), 3)
    return evidence.agg(F.count(F.lit(1)).alias("n_genes"), F.count_if(true).alias("n_concordant"), part("same_symbol").alias("same_symbol"), part("spp_in_main").alias("spp_in_main"), part("is_loc").alias("is_loc"))


def paralog_species(evidence: DataFrame) -> DataFrame:
    """spp, n_genes, n_in_main, tp_pairs, fp_pairs: paralog_evidence by species."""
    return evidence.groupBy("spp").agg(
        F.count(F.lit(1)).alias("n_genes"), F.count_if("spp_in_main").alias("n_in_main"), F.sum("tp_pairs").alias("tp_pairs"), F.sum("fp_pairs").alias("fp_pairs")
    )


def assert_valid(pred: DataFrame, genes: DataFrame, least: float = 50.0, top: int = 10) -> None:
    """Raises if pred covers less than `least` percent of genes, or genes are in several groups (`top` of them are named)."""
    n = {r["check"]: r["n"] for r in validate_groups(pred, genes).collect()}
    if (n["coverage percent"] or 0) < least:
        raise ValueError(f"only {n['coverage percent'] or 0} percent of the genes are in groups")
    if n["genes in several groups"]:
        worst = ", ".join(f"{r['gene']} ({r['n_groups']})" for r in top_repeated(pred, top).collect())
        raise ValueError(f"{n['genes in several groups']} genes are in several groups: {worst}")
