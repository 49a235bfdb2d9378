"""Annotation records and gene positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ortholens.functions import seqs
from ortholens.functions.maths import pct
from ortholens.functions.seqs import CHUNK
from ortholens.operators.ranges import bucketed, carried, numbered
from ortholens.sources.shared import counted, rewritten


def gene_index(genes: DataFrame) -> DataFrame:
    """Adds idx: the 1-based place of each gene on its chromosome, by start and gene."""
    order = [c for c in ("start", "end", "gene") if c in genes.columns]
    return genes.withColumn("idx", F.row_number().over(Window.partitionBy("spp", "chrom").orderBy(*order)).cast("long"))


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins of `width` that [start, end] touches."""
    return F.sequence(F.floor(start / width), F.floor(end / width))


def lift_to_contigs(features: DataFrame, agp: DataFrame, width: int = 100_000) -> DataFrame:
    """features plus contig, new_start, new_end, new_strand: features (chrom, start, end, strand) that lie inside one contig.

    A bin-bucketed join: contigs in all bins they touch, features in the bin of their start; then the exact test. Features
    that cross contigs or lie in gaps are dropped.
    """
    spans = agp.select("chrom", F.col("beg").alias("c_beg"), F.col("end").alias("c_end"), "contig", "size", "orient", F.explode(bins(F.col("beg"), F.col("end"), width)).alias("bin"))
    at = features.withColumn("bin", F.floor(F.col("start") / width))
    inside = at.join(spans, ["chrom", "bin"]).where("start >= c_beg and end <= c_end")
    s0, e0 = F.col("start") - F.col("c_beg"), F.col("end") - F.col("c_beg") + 1
    back = F.col("orient") == "-"
    flipped = F.when(F.col("strand") == "+", "-").when(F.col("strand") == "-", "+").otherwise(F.col("strand"))
    return inside.select(
        *features.columns, "contig", F.when(back, F.col("size") - e0 + 1).otherwise(s0 + 1).alias("new_start"),
        F.when(back, F.col("size") - s0).otherwise(e0).alias("new_end"), F.when(back, flipped).otherwise(F.col("strand")).alias("new_strand"),
    )


def split_by_contigs(genes: DataFrame, children: DataFrame, agp: DataFrame, width: int = 100_000) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Genes and children inside one contig, lifted to it; a gene that is not takes its children along.

    Counts: n_genes, n_genes_dropped, n_children, n_children_dropped. Rows carry gene_id; genes are unique by it.
    """
    all_, n = counted(genes, "genes", n=F.count(F.lit(1)))
    lifted, k = counted(lift_to_contigs(all_, agp, width), "lifted", n=F.count(F.lit(1)))
    own = lifted.select("gene_id", F.lit(True).alias("__kept")).distinct()
    marked, m = counted(children.join(own, "gene_id", "left"), "children", n=F.count(F.lit(1)), dropped=F.count_if(F.col("__kept").isNull()))
    counts = {"n_genes": n["n"], "n_genes_dropped": n["n"] - k["n"], "n_children": m["n"], "n_children_dropped": m["dropped"]}
    return lifted, lift_to_contigs(marked.where("__kept").select(*children.columns), agp, width), counts


def overlapping(points: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Rows of points (chrom, start, end) beside windows (chrom, w_start, w_end, ...) that they touch, each pair once.

    Both sides stand in every bin they touch; a pair is kept in the bin where its common part begins.
    """
    p = points.withColumn("bin", F.explode(bins(F.col("start"), F.col("end"), width)))
    w = windows.withColumn("bin", F.explode(bins(F.col("w_start"), F.col("w_end"), width)))
    both = p.join(w, ["chrom", "bin"]).where("start <= w_end and end >= w_start")
    return both.where(F.col("bin") == F.floor(F.greatest("start", "w_start") / width)).drop("bin")


def merge(*annotations: DataFrame) -> DataFrame:
    """All records with order: genes by chromosome and place, children beside their gene. Rows carry gene_id and feature.

    Records of a gene with the same place and source stand exons first, then by feature, whatever order they are read in.
    """
    all_ = annotations[0]
    for a in annotations[1:]:
        all_ = all_.unionByName(a)
    own = Window.partitionBy("gene_id")
    g = all_.withColumn("g_start", F.min("start").over(own)).withColumn("g_end", F.max("end").over(own))
    kind = F.when(F.col("feature") == "gene", 0).when(F.col("feature") == "transcript", 1).otherwise(2)
    order = ["g_start", "g_end", "gene_id", "__kind", "start", "end", "source", "__rest", "feature"]
    ranked = g.withColumns({"__kind": kind, "__rest": F.col("feature") != "exon"})
    return numbered(ranked, ["chrom"], order, "place").drop("g_start", "g_end", "__kind", "__rest")


def fill_parent(records: DataFrame) -> DataFrame:
    """Records without gene_id take the last one seen before them in their file."""
    rows = bucketed(records.withColumnRenamed("gene_id", "__own"), ["file"], ["line_no"])
    return carried(rows, ["file"], ["line_no"], F.col("__own"), "gene_id").select(*records.columns)


def noncoding_genes(records: DataFrame) -> DataFrame:
    """gene_id of genes without a CDS record."""
    return records.groupBy("gene_id").agg(F.max((F.lower("feature") == "cds").cast("int")).alias("coding")).where("coding = 0").select("gene_id")


def noncoding_share(records: DataFrame) -> DataFrame:
    """n_genes, n_noncoding, percent."""
    n = records.groupBy("gene_id").agg(F.max((F.lower("feature") == "cds").cast("int")).alias("coding")).agg(F.count(F.lit(1)).alias("n_genes"), F.count_if(F.col("coding") == 0).alias("n_noncoding"))
    return n.select("*", pct(F.col("n_noncoding"), F.col("n_genes")).alias("percent"))


def splice(exons: DataFrame, genome: DataFrame, width: int = CHUNK) -> DataFrame:
    """transcript_id, seq: exons (transcript_id, chrom, start, end; 1-based, closed) cut from genome (chrom, chunk, piece), in order.

    An exon meets the chunks that it touches; only what it cuts from them moves on. Parts beyond the end of a sequence are empty,
    exons on chromosomes that the genome lacks are left out.
    """
    own = exons.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((F.col("end") - 1) / width))))
    at = F.col("chunk") * width
    part = seqs.subseq(F.col("piece"), F.greatest(F.col("start") - at, F.lit(1)), F.least(F.col("end") - at, F.lit(width)))
    cut = own.join(genome.select("chrom", "chunk", "piece"), ["chrom", "chunk"]).select("transcript_id", "start", "end", "chunk", part.alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("start", "end", "chunk", "part")))
    return cut.groupBy("transcript_id").agg(parts.alias("p")).select("transcript_id", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("seq"))


def gene_isoform_map(records: DataFrame, feature: str = "CDS", *more: str) -> DataFrame:
    """Distinct (gene_id, isoform, more columns) of the records of one feature."""
    return records.where(F.col("feature") == feature).select("gene_id", "isoform", *more).where("gene_id is not null and isoform is not null").distinct()


def longest_per_key(seqs: DataFrame, keys: list[str], seq: str, order: str) -> DataFrame:
    """The longest sequence per key; the first in order wins ties."""
    best = F.max_by(F.struct(*(c for c in seqs.columns if c not in keys)), F.struct(F.length(seq), -F.col(order)))
    return seqs.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def number_models(hits: DataFrame) -> DataFrame:
    """id, feature, kind, chrom, start, end: ncRNA-<kind>-<n> by place, as gene, transcript and exon records."""
    named = numbered(hits, ["kind"], ["chrom", "start", "end", "line"], "__n").withColumn("id", F.concat(F.lit("ncRNA-"), F.col("kind"), F.lit("-"), F.col("__n").cast("string")))
    return named.select("id", F.explode(F.array(F.lit("gene"), F.lit("transcript"), F.lit("exon"))).alias("feature"), "kind", "chrom", "start", "end")


def attach_parent(records: DataFrame) -> DataFrame:
    """Records (id, parent, gene_id, feature) with gene_id filled: the own one, else that of the nearest ancestor that has one.

    A gene is its own gene_id. A parent that no record has as id, or a topmost record that is no gene, is also looked up among the
    genes without version. Records of `unassigned_gene_` are left out; what no gene is found for, cycles too, stays null.
    Pointer jumping: a pointer that has met no gene is replaced by the pointer of its end, so that the number of rounds is the
    logarithm of the depth. Only open pointers are joined; rows that have a gene or no parent never are.
    """
    base = lambda c: F.substring_index(c, ".", 1)
    own = F.when(F.col("feature") == "gene", F.coalesce("gene_id", "id")).otherwise(F.col("gene_id"))
    rows = records.select("id", "parent", "feature", own.alias("own"))
    nodes = rewritten(rows.where("id is not null").groupBy("id").agg(F.min("parent").alias("up"), F.min("own").alias("g"), F.max(F.col("feature") == "gene").alias("gene")), "nodes")
    by_base = nodes.where("gene").groupBy(base(F.col("id")).alias("short")).agg(F.min("g").alias("sg"))

    unset = nodes.where("g is null")
    there = unset.where("up is not null").join(nodes.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up")
    ends = unset.join(there.select("id"), "id", "left_anti").select("id", base(F.coalesce("up", "id")).alias("short")).join(by_base, "short").select("id", F.col("sg").alias("g"))
    known = rewritten(nodes.where("g is not null").select("id", "g").unionByName(ends), "known")
    open_ = rewritten(there, "open")
    left = open_.count()
    while left:
        met = open_.join(known.select(F.col("id").alias("up"), "g"), "up", "left")
        ahead = open_.select(F.col("id").alias("up"), F.col("up").alias("next"))
        both = rewritten(met.join(ahead, "up", "left").select("id", "g", "next"), "jumps")
        known = known.unionByName(both.where("g is not null").select("id", "g"))
        open_ = both.where("g is null and next is not null").select("id", F.col("next").alias("up"))
        if (now := open_.count()) == left:  # what is left points in circles
            break
        left = now

    need = rows.where("own is null")
    key = need.withColumn("key", F.coalesce("id", "parent"))
    found = key.where("key is not null").join(known.toDF("key", "g"), "key", "left")
    found = found.withColumn("short", F.when(F.col("g").isNull() & F.col("id").isNull(), base(F.col("key"))))
    short = found.where("short is not null").join(by_base, "short", "left").select("id", "parent", "feature", F.col("sg").alias("gene_id"))
    full = found.where("short is null").select("id", "parent", "feature", F.col("g").alias("gene_id"))
    rest = key.where("key is null").select("id", "parent", "feature", F.col("own").alias("gene_id"))
    out = rows.where("own is not null").select("id", "parent", "feature", F.col("own").alias("gene_id")).unionByName(full).unionByName(short).unionByName(rest)
    return out.where(F.col("gene_id").isNull() | ~F.col("gene_id").startswith("unassigned_gene_"))


def noncoding_transcripts(records: DataFrame, genome: DataFrame, width: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Spliced sequences of the transcripts of genes without CDS, and the chromosomes that the genome lacks.

    records: gene_id, transcript_id, feature, chrom, start, end; genome: chrom, chunk, piece.
    """
    exons = records.where("feature = 'exon'").join(noncoding_genes(records), "gene_id", "left_semi")
    lost = records.select("chrom").distinct().join(genome.select("chrom"), "chrom", "left_anti")
    return splice(exons.select("transcript_id", "chrom", "start", "end"), genome, width), lost


def filter_by_ids(sequences: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sequences whose id, without version, is in wanted(isoform)."""
    keep = wanted.select(F.substring_index("isoform", ".", 1).alias("base")).distinct()
    return sequences.withColumn("base", F.substring_index("seq_id", ".", 1)).join(keep, "base", "left_semi").drop("base")
