"""Segmental duplications and ohnolog candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ortholens.functions.maths import pct
from ortholens.operators.groups import GENE


def block_sizes(segdups: DataFrame) -> DataFrame:
    """spp, size, n_blocks: each block once."""
    return segdups.select("spp", "block_id", "size").distinct().groupBy("spp", "size").agg(F.count(F.lit(1)).alias("n_blocks"))


def pair_block_sizes(segdups: DataFrame) -> DataFrame:
    """spp, spp_b, size, n_blocks: each block once for either direction of its species pair."""
    both = segdups.select("spp", "spp_b", "block_id", "size").unionByName(segdups.select(F.col("spp_b").alias("spp"), F.col("spp").alias("spp_b"), "block_id", "size"))
    return both.distinct().groupBy("spp", "spp_b", "size").agg(F.count(F.lit(1)).alias("n_blocks"))


def place_segmental(groups: DataFrame, segdups: DataFrame, retrogenes: DataFrame, min_spp: int = 2) -> DataFrame:
    """group_id, spp, gene, state: placed copies (`S`), and those that are not: `ambiguous` or `low support` without group.

    segdups: dup_id, spp, gene_id (source), spp_b, gene_b. A copy joins the one group that its source genes and other
    species' genes point to, if min_spp other species with a grouped gene support it.
    """
    g = groups.groupBy("gene").agg(F.min("group_id").alias("g"))
    copy = segdups.join(groups.select(F.col("gene").alias("dup_id")), "dup_id", "left_anti").join(retrogenes.select(F.col("gene").alias("dup_id")), "dup_id", "left_anti")
    j = copy.join(g.toDF("gene_id", "g_source"), "gene_id", "left").join(g.toDF("gene_b", "g_other"), "gene_b", "left")
    each = j.select("dup_id", "spp", F.explode(F.array("g_source", "g_other")).alias("g"), F.when(F.col("g_other").isNotNull() & (F.col("spp_b") != F.col("spp")), F.col("spp_b")).alias("support"))
    per = each.groupBy("dup_id", "spp").agg(F.count_distinct("g").alias("n_groups"), F.min("g").alias("g"), F.count_distinct("support").alias("n_support"))
    state = F.when(F.col("n_groups") != 1, "ambiguous").when(F.col("n_support") < min_spp, "low support").otherwise("S")
    return per.select(F.when(state == "S", F.col("g")).alias("group_id"), "spp", F.col("dup_id").alias("gene"), state.alias("state"))


def with_placed(groups: DataFrame, placed: DataFrame) -> DataFrame:
    """groups plus placed copies, with element and species counts made anew."""
    all_ = groups.select("group_id", *GENE).unionByName(placed.where("state = 'S'").select("group_id", *GENE)).distinct()
    n = all_.groupBy("group_id").agg(F.count(F.lit(1)).alias("element_count"), F.count_distinct("spp").alias("org_count"))
    return all_.join(n, "group_id")


def anchored_groups(groups: DataFrame, anchor: str, fish: list[str], assembled: str = "NC_") -> DataFrame:
    """group_id, off_chrom: groups with one anchor gene, every fish, and at most one non-tandem copy in each fish.

    groups: group_id, spp, gene, state, chrom; tandem copies have state T.
    """
    return _anchor_flags(groups, anchor, fish, assembled).where("met and few").select("group_id", "off_chrom")


def _anchor_flags(groups: DataFrame, anchor: str, fish: list[str], assembled: str) -> DataFrame:
    """group_id, met (one anchor gene, every fish), few (at most one own copy in each fish), off_chrom."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    spp = F.col("spp")
    per = groups.groupBy("group_id").agg(
        n(spp == anchor, "anchors"), *(n(spp == f, f"n_{k}") for k, f in enumerate(fish)),
        *(n((spp == f) & (F.coalesce(F.col("state"), F.lit("")) != "T"), f"own_{k}") for k, f in enumerate(fish)), n(~F.coalesce(F.col("chrom"), F.lit("")).startswith(assembled), "off"),
    )
    met, few = F.col("anchors") == 1, F.lit(True)
    for k in range(len(fish)):
        met, few = met & (F.col(f"n_{k}") > 0), few & (F.col(f"own_{k}") <= 1)
    return per.select("group_id", met.alias("met"), few.alias("few"), (F.col("off") > 0).alias("off_chrom"))


def ohnolog_pairs(groups: DataFrame, ref: DataFrame, anchor: str, fish: list[str], assembled: str = "NC_") -> DataFrame:
    """group_id, candidate, category, one_anchor: for each anchored group the other groups that share a reference group with its
    fish genes, have every fish, and whose shared fish genes are on assembled chromosomes that the anchored group does not use.

    Categories: 1 fish only, 2 other species without anchor, 3 with anchor. one_anchor: a shared reference group has one anchor
    gene, grouped or not.
    """
    single = ref.where(F.col("spp") == anchor).groupBy(F.col("group_id").alias("ref")).agg(F.count_distinct("gene").alias("n")).where("n = 1").select("ref", F.lit(True).alias("one"))
    base = anchored_groups(groups, anchor, fish, assembled).select("group_id")
    r = ref.groupBy(*GENE).agg(F.min("group_id").alias("ref"))
    fishes = groups.where(F.col("spp").isin(*fish)).join(r, GENE).select("group_id", *GENE, "chrom", "ref")
    own = fishes.join(base, "group_id", "left_semi").select(F.col("group_id").alias("a"), "ref").distinct()
    used = groups.join(base, "group_id", "left_semi").where(F.col("spp").isin(*fish)).select(F.col("group_id").alias("a"), F.col("spp").alias("us"), F.col("chrom").alias("uc")).distinct()
    met = own.join(single, "ref", "left").join(fishes, "ref").where("a <> group_id").groupBy("a", "group_id", *GENE, "chrom").agg(F.coalesce(F.bool_or("one"), F.lit(False)).alias("one"))
    same = (F.col("a") == F.col("ua")) & (F.col("spp") == F.col("us")) & (F.col("chrom") == F.col("uc"))
    flagged = met.join(used.withColumnRenamed("a", "ua"), same, "left")
    good = F.coalesce(F.col("chrom"), F.lit("")).startswith(assembled) & F.col("us").isNull()
    cand = flagged.groupBy("a", "group_id").agg(F.bool_and(good).alias("ok"), F.bool_or("one").alias("one_anchor")).where("ok")
    kinds = groups.groupBy("group_id").agg(
        F.max((F.col("spp") == anchor).cast("int")).alias("has_anchor"), F.max((~F.col("spp").isin(anchor, *fish)).cast("int")).alias("has_other"),
        *(F.max((F.col("spp") == f).cast("int")).alias(f"f{k}") for k, f in enumerate(fish)),
    )
    full = cand.join(kinds, "group_id").where(" and ".join(f"f{k} = 1" for k in range(len(fish))))
    category = F.when(F.col("has_anchor") == 1, 3).when(F.col("has_other") == 1, 2).otherwise(1)
    return full.select(F.col("a").alias("group_id"), F.col("group_id").alias("candidate"), category.alias("category"), "one_anchor")


def ohnolog_candidates(pairs: DataFrame) -> DataFrame:
    """group_id, candidate, category: the best of ohnolog_pairs, by category, then the least candidate id."""
    best = F.min_by(F.struct("candidate", "category"), F.struct("category", "candidate")).alias("x")
    return pairs.groupBy("group_id").agg(best).select("group_id", "x.*")


def ohnolog_funnel(groups: DataFrame, pairs: DataFrame, anchor: str, fish: list[str], assembled: str = "NC_") -> DataFrame:
    """stage, n, percent (of the anchored groups, from stage 5 on): how many groups pass each step, from one pass over flags.

    1 one anchor gene and every fish, 2 of these with too many copies, 3 anchored, 4 of these with a gene off the assembled
    chromosomes, 5 with a candidate, 6 with one without anchor, 7 with one of those by a reference group of one anchor gene, 8 and
    of fish only.
    """
    f = _anchor_flags(groups, anchor, fish, assembled)
    c = pairs.groupBy("group_id").agg(
        F.lit(True).alias("any"), F.bool_or(F.col("category") < 3).alias("free"), F.bool_or((F.col("category") < 3) & F.col("one_anchor")).alias("one"), F.bool_or((F.col("category") == 1) & F.col("one_anchor")).alias("fish")
    )
    j = f.join(c, "group_id", "left").na.fill(False)
    met = F.col("met")
    stages = [met, met & ~F.col("few"), met & F.col("few"), met & F.col("few") & F.col("off_chrom"), *(met & F.col("few") & F.col(x) for x in ("any", "free", "one", "fish"))]
    counts = j.agg(*(F.count_if(s).alias(f"s{k}") for k, s in enumerate(stages, 1)))
    long_ = counts.select("s3", F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), F.col(f"s{k}").alias("n")) for k in range(1, 9)))).alias("x"))
    return long_.select("x.stage", "x.n", F.when(F.col("x.stage") > 4, pct(F.col("x.n"), F.col("s3"))).alias("percent"))


def ohnolog_summary(groups: DataFrame, best: DataFrame, anchor: str, fish: list[str], assembled: str = "NC_") -> DataFrame:
    """category (0: none), n, percent of the anchored groups."""
    base = anchored_groups(groups, anchor, fish, assembled).join(best, "group_id", "left").select(F.coalesce("category", F.lit(0)).alias("category"))
    n = base.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return n.select("category", "n", pct(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("percent"))
