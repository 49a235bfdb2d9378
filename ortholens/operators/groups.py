"""Operators on one membership table, or on two without comparing groups: rows are (group_id, spp, gene)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ortholens.functions.maths import pct

GENE = ["spp", "gene"]


def sizes(groups: DataFrame) -> DataFrame:
    """group_id, n_genes: distinct genes per group."""
    return groups.select("group_id", *GENE).distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("n_genes"))


def size_distribution(groups: DataFrame, log: bool = False) -> DataFrame:
    """n_genes, n_groups: how many groups have each size; with log also ln of that number."""
    out = sizes(groups).groupBy("n_genes").agg(F.count(F.lit(1)).alias("n_groups"))
    return out.withColumn("ln_groups", F.round(F.log("n_groups"), 6)) if log else out


def profile(groups: DataFrame, n_spp: int | None = None) -> DataFrame:
    """group_id, n_genes, n_spp, single_spp, single_copy: single copy means one gene of each of n_spp species."""
    per = groups.select("group_id", *GENE).distinct().groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_genes"), F.count_distinct("spp").alias("n_spp")
    )
    full = F.lit(True) if n_spp is None else F.col("n_spp") == n_spp
    return per.select("*", (F.col("n_spp") == 1).alias("single_spp"), ((F.col("n_genes") == F.col("n_spp")) & full).alias("single_copy"))


def multi_species(groups: DataFrame, min_spp: int = 2) -> DataFrame:
    """Rows of groups with at least min_spp species."""
    kept = groups.groupBy("group_id").agg(F.count_distinct("spp").alias("n")).where(F.col("n") >= min_spp)
    return groups.join(kept, "group_id", "left_semi")


def exclude_single_species(ref: DataFrame) -> DataFrame:
    """Adds orig_group; genes of single-species groups lose their group_id."""
    few = Window.partitionBy("group_id")
    marked = ref.withColumn("one", F.min("spp").over(few) == F.max("spp").over(few))
    return marked.select("group_id", *GENE, "one").select(F.when(~F.col("one"), F.col("group_id")).alias("group_id"), *GENE, F.col("group_id").alias("orig_group"))


def species_counts(groups: DataFrame, min_spp: int = 2) -> DataFrame:
    """spp, n_genes: distinct genes of each species in groups of min_spp or more species."""
    return multi_species(groups, min_spp).select(*GENE).distinct().groupBy("spp").agg(F.count(F.lit(1)).alias("n_genes"))


def isoform_reduction(entries: DataFrame, n_spp: int) -> DataFrame:
    """group_id, n_entries, n_genes, kind: groups in which several entries are one gene; all species present or some."""
    per = entries.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_distinct(*GENE).alias("n_genes"), F.count_distinct("spp").alias("n_spp")
    )
    kind = F.when(F.col("n_spp") == n_spp, "all species").otherwise("partial")
    return per.where("n_entries > n_genes").select("group_id", "n_entries", "n_genes", kind.alias("kind"))


def multigrouped(groups: DataFrame) -> DataFrame:
    """spp, gene, n_groups: genes in two or more groups."""
    return groups.groupBy(*GENE).agg(F.count_distinct("group_id").alias("n_groups")).where("n_groups > 1")


def paralog_genes(groups: DataFrame) -> DataFrame:
    """group_id, spp, gene of single-species groups."""
    one = groups.groupBy("group_id").agg(F.count_distinct("spp").alias("n")).where("n = 1")
    return groups.join(one, "group_id", "left_semi").select("group_id", *GENE).distinct()


def missing_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """spp, gene of a that b lacks."""
    return a.select(*GENE).distinct().join(b.select(*GENE), GENE, "left_anti")


def missing_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """spp, n_missing, n_genes: genes of a that b lacks, by species."""
    gene = a.select(*GENE).distinct()
    seen = b.select(*GENE).distinct().withColumn("seen", F.lit(1))
    return gene.join(seen, GENE, "left").groupBy("spp").agg(F.count_if(F.col("seen").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_genes"))


def repeated_members(groups: DataFrame) -> DataFrame:
    """spp, gene, n_rows: genes listed more than once."""
    return groups.groupBy(*GENE).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def top_repeated(groups: DataFrame, k: int = 10) -> DataFrame:
    """The k genes in most groups; ties by species and gene."""
    return multigrouped(groups).orderBy(F.desc("n_groups"), *GENE).limit(k)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """group_a, group_b, n_shared, size_a, size_b: the contingency table of two groupings."""
    x = a.select(F.col("group_id").alias("group_a"), *GENE).distinct()
    y = b.select(F.col("group_id").alias("group_b"), *GENE).distinct()
    n = x.join(y, GENE).groupBy("group_a", "group_b").agg(F.count(F.lit(1)).alias("n_shared"))
    return n.join(sizes(a).toDF("group_a", "size_a"), "group_a").join(sizes(b).toDF("group_b", "size_b"), "group_b").select("group_a", "group_b", "n_shared", "size_a", "size_b")


def gene_overlap_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """scope, n_a, n_b, shared, only_a, only_b, pct_shared: gene sets with and without single-species groups."""

    def one(x: DataFrame, y: DataFrame, scope: str) -> DataFrame:
        flag = lambda df, name: df.select(*GENE).distinct().withColumn(name, F.lit(1))
        both = flag(x, "in_a").join(flag(y, "in_b"), GENE, "full")
        has_a, has_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
        n = both.agg(F.count_if(has_a).alias("n_a"), F.count_if(has_b).alias("n_b"), F.count_if(has_a & has_b).alias("shared"))
        return n.select(
            F.lit(scope).alias("scope"), "n_a", "n_b", "shared", (F.col("n_a") - F.col("shared")).alias("only_a"), (F.col("n_b") - F.col("shared")).alias("only_b"),
            pct(F.col("shared"), F.col("n_a") + F.col("n_b") - F.col("shared")).alias("pct_shared"),
        )

    return one(a, b, "all").unionByName(one(multi_species(a), multi_species(b), "multi-species"))


def member_key(groups: DataFrame) -> DataFrame:
    """group_id, n_genes, key: an order-free key of the member set, equal for equal sets."""
    g = groups.select("group_id", *GENE).distinct()
    h = F.xxhash64("spp", "gene")
    return g.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_genes"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("s")).select(
        "group_id", "n_genes", F.struct("n_genes", "x", "s").alias("key")
    )


def duplicate_groups(groups: DataFrame) -> DataFrame:
    """group_id, first_group, n_genes: groups whose member set equals that of an earlier group.

    Sets are compared by (count, two order-free hashes) and then member by member against the least group of the class.
    """
    keyed = member_key(groups)
    first = keyed.groupBy("key").agg(F.min("group_id").alias("first_group"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = keyed.join(first, "key").where("group_id <> first_group").select("group_id", "first_group", "n_genes")
    g = groups.select("group_id", *GENE).distinct()
    same = (
        pairs.join(g, "group_id").alias("p")
        .join(g.select(F.col("group_id").alias("first_group"), *GENE).alias("f"), ["first_group", *GENE])
        .groupBy("group_id", "first_group", "n_genes").agg(F.count(F.lit(1)).alias("same"))
    )
    return same.where("same = n_genes").select("group_id", "first_group", "n_genes")


def duplicate_classes(groups: DataFrame) -> DataFrame:
    """group_id, first_group, n_genes, type of all groups whose member set another group has too: `ortholog` or `paralog` (one
    species). The first group stands for its class, so that a set with very many copies costs one row a copy."""
    later = duplicate_groups(groups)
    firsts = later.groupBy("first_group", "n_genes").agg(F.count(F.lit(1)).alias("k")).select(F.col("first_group").alias("group_id"), "first_group", "n_genes")
    kind = groups.groupBy("group_id").agg(F.when(F.min("spp") == F.max("spp"), "paralog").otherwise("ortholog").alias("type"))
    return later.unionByName(firsts).join(kind, "group_id").select("group_id", "first_group", "n_genes", "type")


def duplicate_counts(groups: DataFrame) -> DataFrame:
    """type (`ortholog`, `paralog`, `both`), n_groups, n_genes of duplicated groups; `both`: genes in duplicates of either type."""
    of = duplicate_classes(groups)
    n = of.groupBy("type").agg(F.count(F.lit(1)).alias("n_groups"))
    genes = groups.select("group_id", *GENE).join(of.where("group_id = first_group").select("group_id", "type"), "group_id").groupBy(*GENE).agg(F.min("type").alias("type"), F.max("type").alias("last"))
    each = genes.select(F.explode(F.when(F.col("type") == F.col("last"), F.array("type")).otherwise(F.array("type", "last", F.lit("both")))).alias("type"))
    return each.groupBy("type").agg(F.count(F.lit(1)).alias("n_genes")).join(n, "type", "left").select("type", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), "n_genes")


def coverage(genes: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """spp (null: all), n_genes, in_a, in_b, paralogous_b, single_b (in_b but not paralogous), multigrouped_b, pct_a, pct_b:
    annotated genes that groupings hold; out_a, out_b: grouped genes that are not annotated."""
    flag = lambda df, name: df.select(*GENE).distinct().withColumn(name, F.lit(1))
    all_ = (
        genes.select(*GENE).unionByName(a.select(*GENE)).unionByName(b.select(*GENE)).distinct()
        .join(flag(genes, "fg"), GENE, "left").join(flag(a, "fa"), GENE, "left").join(flag(b, "fb"), GENE, "left")
        .join(flag(paralog_genes(b), "fp"), GENE, "left").join(flag(multigrouped(b), "fm"), GENE, "left")
    )
    known = F.col("fg").isNotNull()
    n = lambda c: F.count_if(known & F.col(c).isNotNull())
    out = all_.rollup("spp").agg(
        F.count("fg").alias("n_genes"), n("fa").alias("in_a"), n("fb").alias("in_b"), n("fp").alias("paralogous_b"),
        F.count_if(known & F.col("fb").isNotNull() & F.col("fp").isNull()).alias("single_b"), n("fm").alias("multigrouped_b"),
        F.count_if(~known & F.col("fa").isNotNull()).alias("out_a"), F.count_if(~known & F.col("fb").isNotNull()).alias("out_b"),
    )
    return out.select("*", pct(F.col("in_a"), F.col("n_genes")).alias("pct_a"), pct(F.col("in_b"), F.col("n_genes")).alias("pct_b"))


def filter_by_level(ogs: DataFrame, level: str, levels: DataFrame | None = None) -> DataFrame:
    """og_id of one level; with levels (level_id, name) the level is looked up by its name, whatever its case."""
    if levels is not None:
        ids = levels.where(F.lower("name") == level.lower()).select("level_id").distinct()
        return ogs.join(ids, "level_id", "left_semi").select("og_id")
    return ogs.where(F.col("level_id") == level).select("og_id")


def filter_og2genes(og2genes: DataFrame, og_ids: DataFrame, taxa: DataFrame) -> DataFrame:
    """Rows whose og_id and taxon (gene_id up to the colon) are both listed."""
    taxon = F.substring_index("gene_id", ":", 1)
    return og2genes.join(og_ids.select("og_id"), "og_id", "left_semi").withColumn("taxon", taxon).join(taxa.select("taxon"), "taxon", "left_semi").drop("taxon")


def filter_by_taxon(genes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Rows whose taxon is listed."""
    return genes.join(taxa.select("taxon"), "taxon", "left_semi")


def collapse_transcripts(groups: DataFrame, strip) -> DataFrame:
    """Isoform tags stripped, genes once per group, groups left with one gene dropped."""
    g = groups.select("group_id", "spp", strip(F.col("gene")).alias("gene")).distinct()
    kept = g.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.join(kept, "group_id", "left_semi")


def pattern_by_state(df: DataFrame, conditions: dict[str, tuple[str, ...]], at_most: tuple[str, str] | None = None) -> DataFrame:
    """group_id and <org>_state, <org>_count of groups whose orgs are those of conditions, each in one of its states.

    df rows are (group_id, org, state, count); `D` rows are ignored. orgs_by_count lists the orgs by falling count, top_count is
    the largest: the report's order is top_count, falling. at_most=(x, y) asks that x's count is at most y's.
    """
    kept = df.where("state <> 'D'")
    wide = kept.groupBy("group_id").pivot("org", sorted(conditions)).agg(F.min("state").alias("state"), F.max("count").alias("count"))
    n = kept.groupBy("group_id").agg(F.count_distinct("org").alias("n_orgs"))
    ok = F.col("n_orgs") == len(conditions)
    for org, states in conditions.items():
        ok = ok & F.col(f"`{org}_state`").isin(*states)
    if at_most:
        ok = ok & (F.col(f"`{at_most[0]}_count`") <= F.col(f"`{at_most[1]}_count`"))
    counts = F.array_sort(F.array(*(F.struct((-F.col(f"`{o}_count`")).alias("k"), F.lit(o).alias("org")) for o in sorted(conditions))))
    out = wide.join(n, "group_id").where(ok)
    return out.withColumns({"orgs_by_count": F.array_join(F.transform(counts, lambda x: x["org"]), ","), "top_count": -counts[0]["k"]})


def seeded_sample(df: DataFrame, key: str, n: int = 100, seed: int = 1234) -> DataFrame:
    """n rows, the same for the same seed whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def filter_groups(df: DataFrame, group_ids: list) -> DataFrame:
    """Rows of the listed groups."""
    return df.where(F.col("group_id").isin(*group_ids))
