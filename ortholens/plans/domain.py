"""Queries on annotations, ids, synteny, duplications, hits and file round trips, over views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ortholens.functions import attrs, ids, seqs
from ortholens.operators import annotation, dups, groups, hits, references, synteny
from ortholens.plans.views import lines, pred, ref, table, with_views
from ortholens.sources import readers, writers
from ortholens.sources.shared import shared_path


def _line(s, d):
    return table(s, d, "lineitem")


def _days(col: str = "l_shipdate"):
    return F.datediff(col, F.lit("1992-01-01").cast("date")).cast("long")


# -- annotation and sequences -------------------------------------------------------------------------------------------


def _gtf(s, d):
    """GTF attribute strings made of line items."""
    a = F.concat(
        F.lit('gene_id "G'), F.col("l_orderkey").cast("string"), F.lit('"; protein_id "P'), F.col("l_partkey").cast("string"), F.lit('"; protein_version "'),
        F.col("l_linenumber").cast("string"), F.lit('"; note "'), F.col("l_returnflag"), F.lit('"; note "'), F.col("l_linestatus"), F.lit('";'),
    )
    return _line(s, d).select(a.alias("attributes"))


def gtf_attributes(s, d):
    """Distinct gene and isoform, with the gene's number of records and its greatest note."""
    m = attrs.parsed(_gtf(s, d)).select("gene_id", "isoform", F.col("attrs")["note"].alias("note"))
    per = m.groupBy("gene_id", "isoform").agg(F.count(F.lit(1)).alias("n"), F.max("note").alias("note"))
    own = Window.partitionBy("gene_id")
    every = per.withColumn("n_records", F.sum("n").over(own)).withColumn("last_note", F.max("note").over(own)).withColumn("feature", F.lit("CDS"))
    return annotation.gene_isoform_map(every, "CDS", "n_records", "last_note")


def gff_to_gtf(s, d):
    a = F.concat(F.lit("ID=mRNA."), F.col("l_partkey").cast("string"), F.lit(";Name="), F.col("l_returnflag"), F.lit(";Parent=gene."), F.col("l_orderkey").cast("string"))
    r = _line(s, d).select(a.alias("attributes"), F.lit("mRNA").alias("feature"))
    gene = F.regexp_extract("attributes", "Parent=([^;]+)", 1)
    return r.select(attrs.gff_feature(F.col("feature")).alias("feature"), attrs.gff_to_gtf(F.col("feature"), F.col("attributes"), gene).alias("attributes")).groupBy("feature", "attributes").agg(F.count(F.lit(1)).alias("n"))


def _features(s, d):
    kind = F.when(F.col("l_linenumber") == 1, "gene").when(F.col("l_linenumber") == 2, "transcript").when(F.col("l_linenumber") < 6, "exon").otherwise("CDS")
    return _line(s, d).select(
        F.expr("l_orderkey % 25").alias("chrom"), F.col("l_orderkey").alias("gene_id"), kind.alias("feature"), _days().alias("start"), (_days() + F.col("l_quantity").cast("long")).alias("end"), F.col("l_returnflag").alias("source")
    )


def merge_annotations(s, d):
    f = _features(s, d)
    return annotation.merge(f.where("source = 'R'"), f.where("source <> 'R'"))


#: Letters in a piece of the queries' sequences: short, so that many exons span two.
_WIDTH = 1_000


def _genome(s, d, where="true"):
    """The letters of all texts as sequences, written as FASTA and read in pieces."""
    seq = table(s, d, "documents").where(where).select(F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(" text")).alias("header"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))
    path = shared_path(s, "genome")
    writers.write_fasta(seq.where("seq <> ''"), path)
    return readers.read_genome(s, path, _WIDTH)


def _exons(s, d):
    """Exons of 30 letters every 97 letters, over the whole length of each text; every third text has a CDS."""
    n = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    chrom = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    at = table(s, d, "documents").select(chrom.alias("chrom"), "doc_id", F.explode(F.sequence(F.lit(0), F.floor((n - 40) / 97))).alias("k"), n.alias("n")).where("n >= 40")
    feature = F.when((F.col("doc_id") % 3 == 0) & (F.col("k") == 0), F.array(F.lit("exon"), F.lit("CDS"))).otherwise(F.array(F.lit("exon")))
    return at.select("chrom", F.col("chrom").alias("gene_id"), F.concat("chrom", F.lit(".t")).alias("transcript_id"), F.explode(feature).alias("feature"), (F.col("k") * 97 + 11).alias("start"), (F.col("k") * 97 + 40).alias("end"))


def _digest(spliced):
    return spliced.select("transcript_id", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.length("seq").cast("long").alias("n"))


def splice_exons(s, d):
    exons = _exons(s, d).where("feature = 'exon'").select("transcript_id", "chrom", "start", "end")
    return _digest(annotation.splice(exons, _genome(s, d), _WIDTH))


def genome_chunks(s, d):
    """Every piece of every sequence."""
    return _genome(s, d).select("chrom", "chunk", F.md5(F.col("piece").cast("binary")).alias("piece_md5"), F.length("piece").cast("long").alias("n"))


def fill_parent(s, d):
    """All lines as one file of records, of which only the first line of an order names it."""
    line = _line(s, d).select(F.lit("all").alias("file"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_no"), F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("gene_id"))
    return annotation.fill_parent(line).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))


def _gff(s, d):
    """Genes, transcripts and exons that only name their parent."""
    line = _line(s, d).select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    g, t = F.concat(F.lit("g"), F.col("l_orderkey").cast("string")), F.concat_ws("-", F.lit("t"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    none = F.lit(None).cast("string")
    gene = line.select(F.concat(g, F.lit(".1")).alias("id"), none.alias("parent"), none.alias("gene_id"), F.lit("gene").alias("feature")).distinct()
    tx = line.select(t.alias("id"), g.alias("parent"), none.alias("gene_id"), F.lit("transcript").alias("feature")).distinct()
    exon = line.select(none.alias("id"), t.alias("parent"), F.when(F.col("l_returnflag") == "A", g).alias("gene_id"), F.lit("exon").alias("feature")).distinct()
    return gene.unionByName(tx).unionByName(exon)


def attach_parent(s, d):
    return annotation.attach_parent(_gff(s, d)).groupBy("feature", "gene_id").agg(F.count(F.lit(1)).alias("n"))


def deep_parents(s, d):
    """All lines of an order as a chain: each record names the line before it, the first one the gene."""
    line = _line(s, d).select("l_orderkey", "l_linenumber").distinct()
    o, before = F.col("l_orderkey").cast("string"), F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    up = line.withColumn("before", before)
    none = F.lit(None).cast("string")
    chain = up.select(F.concat_ws("-", F.lit("r"), o, F.col("l_linenumber").cast("string")).alias("id"), F.coalesce(F.when(F.col("before").isNotNull(), F.concat_ws("-", F.lit("r"), o, F.col("before").cast("string"))), F.concat(F.lit("g"), o)).alias("parent"), none.alias("gene_id"), F.lit("part").alias("feature"))
    genes = line.select(F.concat(F.lit("g"), o).alias("id"), none.alias("parent"), none.alias("gene_id"), F.lit("gene").alias("feature")).distinct()
    return annotation.attach_parent(chain.unionByName(genes)).select("id", "feature", "gene_id")


def _noncoding(s, d):
    return annotation.noncoding_transcripts(_exons(s, d), _genome(s, d, "doc_id % 5 <> 0"), _WIDTH)


def noncoding_transcripts(s, d):
    return _digest(_noncoding(s, d)[0])


def lost_chromosomes(s, d):
    """Chromosomes of the records that the genome lacks: every fifth text was not written."""
    return _noncoding(s, d)[1]


def filter_by_ids(s, d):
    p = table(s, d, "part")
    q = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".2")).alias("seq_id"), F.col("p_name").alias("seq"))
    return annotation.filter_by_ids(q, p.where("p_partkey % 3 = 0").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".7")).alias("isoform")))


def longest_per_key(s, d):
    t = table(s, d, "documents").select("source", "lang", "doc_id", "text")
    return annotation.longest_per_key(t, ["source", "lang"], "text", "doc_id").select("source", "lang", "doc_id", F.length("text").cast("long").alias("n"))


def fasta_roundtrip(s, d):
    t = table(s, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(" pep x gene:"), F.col("lang"), F.lit(".1 transcript:"), F.col("source"), F.lit(".2")).alias("header"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))
    path = shared_path(s, "fasta")
    writers.write_fasta(t.where("seq <> ''"), path)
    r = readers.read_fasta(s, path)
    return r.select("seq_id", seqs.header_gene(F.col("header")).alias("gene"), seqs.header_transcript(F.col("header")).alias("transcript"), F.col("length").cast("long").alias("length"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def wide_roundtrip(s, d):
    species = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    path = shared_path(s, "wide")
    writers.write_groups_wide(pred(s, d), path, species)
    return readers.read_groups_wide(s, path)


def loose_groups(s, d):
    path = shared_path(s, "loose")
    writers.write_group_lines(lines(s, d), path)
    known = lines(s, d).select(F.col("gene").cast("string").alias("gene"))
    return readers.read_loose_groups(s, path, known)


def partition_roundtrip(s, d):
    path = shared_path(s, "by-group")
    writers.write_partitioned(lines(s, d).select(F.col("gene").cast("string").alias("gene"), "group_id", "spp"), path, "spp", "csv")
    return s.read.csv(path, schema="gene string, group_id long, spp string").distinct()


def number_models(s, d):
    v = F.concat_ws(" ", F.concat(F.lit("c"), F.expr("cast(l_suppkey % 7 as string)")), F.lit("RF"), F.col("l_returnflag"), F.lit("1"), F.lit("9"), _days().cast("string"), (_days() + F.col("l_quantity").cast("long")).cast("string"), F.lit("-"), F.col("l_linestatus"))
    raw = _line(s, d).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("line"), v.alias("value"))
    return annotation.number_models(readers.parse_cmscan(raw).withColumn("kind", F.col("description")))


# -- intervals ----------------------------------------------------------------------------------------------------------


def _intervals(s, d):
    strand = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(".")
    return _line(s, d).select(F.col("l_suppkey").alias("chrom"), (_days() + 1).alias("start"), (_days() + 1 + F.col("l_quantity").cast("long")).alias("end"), strand.alias("strand"), F.col("l_orderkey").alias("gene_id"))


def lift_to_contigs(s, d):
    c = _line(s, d).select(F.col("l_suppkey").alias("chrom")).distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(13))).alias("k")
    agp = c.select("chrom", k).select(
        "chrom", (F.col("k") * 200 + 1).cast("long").alias("beg"), ((F.col("k") + 1) * 200).cast("long").alias("end"), F.concat(F.lit("ctg"), F.col("k").cast("string")).alias("contig"),
        F.lit(200).cast("long").alias("size"), F.when(F.col("k") % 2 == 1, "-").otherwise("+").alias("orient"),
    )
    return annotation.lift_to_contigs(_intervals(s, d), agp, 200)


def lift_counts(s, d):
    """Orders as genes from their first to their last ship day, lines as their children, contigs of 40 days."""
    own = _line(s, d).select(F.col("l_suppkey").alias("chrom"), _days().alias("start"), F.col("l_orderkey").alias("gene_id"))
    child = own.select(F.lit("all").alias("chrom"), (F.col("start") + 1).alias("start"), (F.col("start") + 1).alias("end"), F.lit("+").alias("strand"), "gene_id")
    gene = child.groupBy("chrom", "gene_id", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    k = F.col("id")
    agp = s.range(100).select(F.lit("all").alias("chrom"), (k * 40 + 1).alias("beg"), ((k + 1) * 40).alias("end"), F.concat(F.lit("ctg"), k.cast("string")).alias("contig"), F.lit(40).cast("long").alias("size"), F.lit("+").alias("orient"))
    _, _, n = annotation.split_by_contigs(gene, child, agp, 40)
    return s.createDataFrame([n], "n_genes long, n_genes_dropped long, n_children long, n_children_dropped long")


def window_overlap(s, d):
    w = _line(s, d).select(F.col("l_suppkey").alias("chrom"), (_days() - 5).alias("w_start"), (_days() + 5).alias("w_end"), F.col("l_orderkey").alias("anchor"))
    both = annotation.overlapping(_intervals(s, d), w, 64)
    return both.groupBy("chrom", "anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bp"))


def _te(s, d, flag: str):
    return _line(s, d).where(F.col("l_returnflag") == flag).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("te"), F.col("l_suppkey").alias("anchor"), F.col("l_suppkey").alias("order"), seqs.family(F.concat(F.col("l_linestatus"), F.expr("cast(l_partkey % 5 as string)"), F.lit("-7"))).alias("family"), F.lit(0).cast("long").alias("start")
    ).distinct()


def te_windows(s, d):
    te = _intervals(s, d).where("strand = '+'").select("chrom", "start", "end", F.col("gene_id").alias("te"))
    a = _intervals(s, d).where("strand = '-'").select("chrom", "start", "end", F.col("gene_id").alias("anchor"))
    return synteny.te_in_windows(te, a, 10).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("te").alias("n_te"))


# -- ids ----------------------------------------------------------------------------------------------------------------


def _odb(s, d):
    k = F.col("p_partkey")
    txt = k.cast("string")
    opt = lambda cond, v: F.when(cond, v)
    return table(s, d, "part").select(
        txt.alias("gene_id"), F.col("p_brand").alias("taxon"), opt(k % 3 == 0, F.concat(F.lit("NP_"), txt)).alias("protein_id"), opt(k % 2 == 0, F.concat(F.lit("X;"), txt)).otherwise("Y").alias("synonyms"),
        opt(k % 5 == 0, F.concat(F.lit("Q"), txt)).alias("uniprot"), opt(k % 7 == 0, F.concat(F.lit("ENSG"), txt, F.lit(".2;ENSG9"))).alias("ensembl"),
    )


def build_reference(s, d):
    og = _line(s, d).select(F.col("l_orderkey").alias("og_id"), F.col("l_partkey").cast("string").alias("gene_id"))
    species = table(s, d, "part").where("p_size % 2 = 0 or p_brand < 'Brand#4'").select(F.col("p_brand").alias("taxon"), F.lower("p_brand").alias("spp")).distinct()
    return references.build_reference(og, _odb(s, d), species).groupBy("group_id", "spp", "gene", "source", "status").agg(F.count(F.lit(1)).alias("n"))


def _records(s, d):
    return _line(s, d).select(F.col("l_returnflag").alias("spp"), F.concat(F.lit("NP_"), F.col("l_partkey").cast("string")).alias("protein_id"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey").cast("string")).alias("numeric_id"), F.concat(F.lit("G"), F.col("l_orderkey").cast("string")).alias("gene"), F.col("l_orderkey").alias("line_no"))


def build_lookup(s, d):
    return references.build_lookup(_records(s, d))


def lookup_counts(s, d):
    """The counts of one pass over records of three features, a third of whose CDS lack a protein id."""
    r = _records(s, d).withColumn("feature", F.when(F.col("line_no") % 3 == 0, "gene").when(F.col("line_no") % 3 == 1, "CDS").otherwise("exon"))
    lacks = (F.col("feature") == "CDS") & F.endswith("protein_id", F.lit("0"))
    _, n = references.build_lookup_counted(r.withColumn("protein_id", F.when(~lacks, F.col("protein_id"))))
    return s.createDataFrame([n], "n_records long, n_missing long, n_ignored long")


def level_by_name(s, d):
    levels = table(s, d, "orders").select(F.col("o_orderpriority").alias("level_id"), F.lower(F.substring("o_orderpriority", 3, 99)).alias("name")).distinct()
    return groups.filter_by_level(table(s, d, "orders").select(F.col("o_orderkey").alias("og_id"), F.col("o_orderpriority").alias("level_id")), "Urgent", levels)


def _to_rename(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("row_id"), F.expr("p_size").alias("group_id"), F.when(k % 2 == 0, "A").otherwise("R").alias("spp"), F.concat_ws(",", F.lit("99999999"), (k * 2).cast("string"), F.concat(F.lit("NP_"), k.cast("string"))).alias("gene"), F.lit("geneid,geneid,protein_id").alias("source"))


def rename_ids(s, d):
    return references.rename(_to_rename(s, d), references.build_lookup(_records(s, d)))


def recode_ids(s, d):
    k = F.col("p_partkey")
    p = table(s, d, "part")
    raw = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".1"))).otherwise(k.cast("string"))
    m = p.where("p_partkey % 3 = 0").select(k.cast("string").alias("isoform"), F.concat(F.lit("M"), k.cast("string")).alias("gene"))
    known = p.where("p_partkey % 5 = 0").select(k.cast("string").alias("gene"))
    extra = p.where("p_partkey % 4 = 0").select(F.concat(k.cast("string"), F.lit(".1")).alias("isoform"), F.concat(F.lit("E"), k.cast("string")).alias("gene"))
    return references.recode(p.select(F.col("p_size").alias("group_id"), raw.alias("raw")), m, known, extra)


def filter_og2genes(s, d):
    og = _line(s, d).select(F.col("l_orderkey").alias("og_id"), F.concat_ws(":", F.expr("cast(l_suppkey as string)"), F.expr("cast(l_partkey as string)")).alias("gene_id"))
    keep = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("og_id"), F.col("o_orderpriority").alias("level_id"))
    taxa = table(s, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").cast("string").alias("taxon"))
    return groups.filter_og2genes(og, groups.filter_by_level(keep, "1-URGENT"), taxa)


def filter_by_taxon(s, d):
    n = table(s, d, "nation").join(table(s, d, "region").where("r_name in ('ASIA', 'EUROPE')"), F.col("n_regionkey") == F.col("r_regionkey"))
    return groups.filter_by_taxon(table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("taxon"), "s_name"), n.select(F.col("n_nationkey").alias("taxon")))


# -- synteny and duplications -------------------------------------------------------------------------------------------


def _next_order(s, d, k: int = 1):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("gene_a"), F.col("o_orderpriority").alias("org_a"), F.lead("o_orderkey", k).over(w).alias("gene_b"), F.lead("o_orderpriority", k).over(w).alias("org_b"))
    return o.where("gene_b is not null")


def anchor_contradictions(s, d):
    return synteny.contradictions(_next_order(s, d), ref(s, d))


def contradiction_counts(s, d):
    pairs = _next_order(s, d).select(F.concat_ws("-", "org_a", "org_b").alias("file"), "gene_a", "gene_b")
    return synteny.contradiction_counts(pairs, ref(s, d))


def tree_vs_pairs(s, d):
    both = _next_order(s, d).unionByName(_next_order(s, d, 2))
    tree = both.groupBy(F.col("org_a").alias("org"), F.col("gene_a").alias("gene")).agg(F.collect_list(F.struct(F.col("org_b").alias("org"), F.col("gene_b").alias("gene"))).alias("partners"))
    return synteny.tree_vs_pairs(tree, _next_order(s, d).where("gene_a % 4 <> 0"))


def _anchors(s, d):
    line = _line(s, d)
    return line.select(F.expr("l_suppkey % 10").alias("chrom_a"), F.expr("l_partkey % 12").alias("chrom_b"), _days().alias("start_a"), (_days() + F.col("l_quantity").cast("long")).alias("end_a"), (F.col("l_partkey") + F.col("l_orderkey") % 100).alias("start_b"))


def _chroms(s, d, col: str, n: int):
    return _line(s, d).select(F.expr(f"{col} % {n}").alias("chrom")).groupBy("chrom").agg(F.count(F.lit(1)).alias("length")).where("chrom <> 3").withColumn("spp", F.lit(col))


def three_genomes(s, d):
    """Suppliers' chromosomes beside their best parts' ones, and those beside orders' ones."""
    line = _line(s, d)
    further = line.select(F.expr("l_partkey % 12").alias("chrom_a"), F.expr("l_orderkey % 9").alias("chrom_b"), _days().alias("start_a"), (_days() + F.col("l_quantity").cast("long")).alias("end_a"), F.col("l_orderkey").alias("start_b"))
    parts = _chroms(s, d, "l_partkey", 12)
    return synteny.chain(synteny.chrom_pairs(_anchors(s, d), _chroms(s, d, "l_suppkey", 10), parts), synteny.chrom_pairs(further, parts, _chroms(s, d, "l_orderkey", 9)))


def low_certainty(s, d):
    """Lines as uncertain members: the parts that the map knows are replaced by their gene."""
    assign = _line(s, d).select(F.col("l_orderkey").alias("group_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("protein"))
    known = table(s, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("isoform"), F.col("p_brand").alias("gene"))
    return references.apply_low_certainty(assign, known).groupBy("group_id", "gene").agg(F.count(F.lit(1)).alias("n"))


def alg_table(s, d):
    t = lines(s, d).select(F.expr("group_id").alias("cluster_id"), F.expr("substring(spp, 7, 1)").alias("org"), F.expr("gene % 2").alias("chrom"))
    return synteny.alg_table(t, 2, 2)


def place_segmental(s, d):
    o = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    dup = o.where("k % 11 = 0").select("o_custkey", F.col("k").alias("dup_id"), F.col("p").alias("spp"))
    own = dup.join(o.where("k % 11 <> 0"), "o_custkey").select("dup_id", "spp", F.lit(None).cast("long").alias("gene_id"), F.col("p").alias("spp_b"), F.col("k").alias("gene_b"))
    noise = dup.where("dup_id % 5 = 0").select("dup_id", "spp", (F.col("dup_id") + 1).alias("gene_id"), F.col("spp").alias("spp_b"), F.lit(None).cast("long").alias("gene_b"))
    retro = table(s, d, "orders").where("o_orderkey % 77 = 0").select(F.col("o_orderkey").alias("gene"))
    return dups.place_segmental(pred(s, d), own.unionByName(noise), retro)


def segdup_sizes(s, d):
    b = _line(s, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"), F.min("l_returnflag").alias("spp"))
    rows = _line(s, d).select("l_orderkey").join(b, "l_orderkey").select("spp", F.col("l_orderkey").alias("block_id"), "size")
    return dups.block_sizes(rows)


def pair_block_sizes(s, d):
    b = _line(s, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"), F.min("l_returnflag").alias("spp"), F.max("l_linestatus").alias("spp_b"))
    rows = _line(s, d).select("l_orderkey").join(b, "l_orderkey").select("spp", "spp_b", F.col("l_orderkey").alias("block_id"), "size")
    return dups.pair_block_sizes(rows)


def _fish_groups(s, d):
    o = table(s, d, "orders").where("o_orderkey % 11 <> 0")
    return o.select(F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("spp"), F.col("o_orderkey").alias("gene"), F.when(F.col("o_orderkey") % 3 == 0, "T").otherwise("O").alias("state"), F.concat(F.when(F.col("o_orderkey") % 9 == 0, "NW_").otherwise("NC_"), F.expr("cast(o_orderkey % 6 as string)")).alias("chrom"))


_FISH = ("1-URGENT", ["2-HIGH", "3-MEDIUM"])


def ohnolog_pairs(s, d):
    return dups.ohnolog_pairs(_fish_groups(s, d), ref(s, d), *_FISH)


def ohnolog_candidates(s, d):
    return dups.ohnolog_candidates(ohnolog_pairs(s, d))


def ohnolog_funnel(s, d):
    return dups.ohnolog_funnel(_fish_groups(s, d), ohnolog_pairs(s, d), *_FISH)


def ohnolog_summary(s, d):
    return dups.ohnolog_summary(_fish_groups(s, d), ohnolog_candidates(s, d), *_FISH)


# -- hits and symbols ---------------------------------------------------------------------------------------------------


def hits_for_groups(s, d):
    h = _line(s, d).select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("subject"), F.col("l_extendedprice").alias("score"))
    return hits.for_groups(h, pred(s, d)).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("best"), F.count_distinct("subject").alias("n_subjects"))


def group_matrix(s, d):
    h = table(s, d, "orders").select(F.col("o_orderkey").alias("gene_a"), F.explode(F.array(F.col("o_orderkey") + 1, F.col("o_orderkey") + 2, F.col("o_orderkey") * 2)).alias("gene_b"), F.col("o_totalprice").alias("score"))
    return hits.group_matrix(h.unionByName(_next_order(s, d).select("gene_a", "gene_b", F.lit(1.5).alias("score"))), pred(s, d))


def duplicated_regression(s, d):
    """Regression apart for lines whose order and part are both duplicated: orders of five lines or more, parts of even size."""
    big = _line(s, d).groupBy("l_orderkey").count().where("count >= 5").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("gene"))
    even = table(s, d, "part").where("p_size % 2 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("gene"))
    rbh = _line(s, d).select("l_quantity", "l_partkey", "l_extendedprice", F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    return hits.length_regression(hits.both_duplicated(rbh, big.unionByName(even), "a", "b"), ["both_dup"], "l_quantity", "l_partkey", "l_extendedprice")


def member_sequences(s, d):
    """Part names as sequences of isoforms of the genes that all lines group."""
    p = table(s, d, "part").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("seq_id"), F.col("p_name").alias("seq"), (F.col("p_partkey") - F.col("p_partkey") % 2).alias("gene"))
    g = lines(s, d).select("group_id", "gene").where("gene % 2 = 0")
    return hits.member_sequences(p.select("seq_id", "seq"), p.select(F.col("seq_id").alias("isoform"), "gene"), g)


def length_regression(s, d):
    return hits.length_regression(_line(s, d), ["l_returnflag", "l_linestatus"], "l_quantity", "l_partkey", "l_extendedprice")


def _symbols(s, d):
    k = F.col("p_partkey")
    p = table(s, d, "part").select(F.col("p_size").alias("group_id"), F.when(k % 2 == 0, "a").otherwise("b").alias("org"), k.alias("gene"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("LOC"), k.cast("string"))).otherwise(F.col("p_name")).alias("name"))
    x, y = p.select(F.col("org").alias("org_a"), F.col("gene").alias("id_a"), F.col("name").alias("name_a")), p.select(F.col("org").alias("org_b"), F.col("gene").alias("id_b"), F.col("name").alias("name_b"))
    return p, x.join(y, F.col("id_b") == F.col("id_a") + 1)


def symbol_fallback(s, d):
    p, h = _symbols(s, d)
    return hits.resolve_symbols(p, h, "a", "b")


def symbols_per_group(s, d):
    return hits.symbols_per_group(symbol_fallback(s, d))


def term_counts(s, d):
    sym = table(s, d, "events").select(F.concat_ws(",", F.col("event_type"), F.lit("z")).alias("symbols"))
    terms = table(s, d, "events").select(F.col("event_type").alias("symbol"), F.expr("concat('GO:', user_id % 5)").alias("go_id"), F.expr("concat('t', user_id % 5)").alias("term"), F.when(F.col("user_id") % 2 == 0, "biological_process").otherwise("molecular_function").alias("namespace")).distinct()
    return hits.term_counts(sym, terms)


QUERIES = {
    "gtf_attributes": gtf_attributes,
    "gff_to_gtf": gff_to_gtf,
    "merge_annotations": merge_annotations,
    "noncoding_genes": lambda s, d: annotation.noncoding_genes(_features(s, d)),
    "noncoding_share": lambda s, d: annotation.noncoding_share(_features(s, d)),
    "splice_exons": splice_exons,
    "attach_parent": attach_parent,
    "noncoding_transcripts": noncoding_transcripts,
    "lost_chromosomes": lost_chromosomes,
    "genome_chunks": genome_chunks,
    "fill_parent": fill_parent,
    "deep_parents": deep_parents,
    "filter_by_ids": filter_by_ids,
    "longest_per_key": longest_per_key,
    "fasta_roundtrip": fasta_roundtrip,
    "wide_roundtrip": wide_roundtrip,
    "loose_groups": loose_groups,
    "partition_roundtrip": partition_roundtrip,
    "number_models": number_models,
    "lift_to_contigs": lift_to_contigs,
    "window_overlap": window_overlap,
    "te_windows": te_windows,
    "te_ortholog_pairs": lambda s, d: synteny.te_ortholog_pairs(_te(s, d, "A"), _te(s, d, "R")),
    "build_reference": build_reference,
    "build_lookup": build_lookup,
    "rename_ids": rename_ids,
    "recode_ids": recode_ids,
    "filter_og2genes": filter_og2genes,
    "filter_by_taxon": filter_by_taxon,
    "collapse_transcripts": lambda s, d: groups.collapse_transcripts(
        lines(s, d).withColumn("gene", F.concat(F.expr("cast(gene div 40 as string)"), F.lit(".t"), F.expr("cast(gene % 40 as string)"))), ids.strip_transcript_tag
    ),
    "anchor_contradictions": anchor_contradictions,
    "tree_vs_pairs": tree_vs_pairs,
    "alg_table": alg_table,
    "three_genomes": three_genomes,
    "low_certainty": low_certainty,
    "partner_chrom": lambda s, d: synteny.best_partner_chrom(_anchors(s, d)),
    "orientation": lambda s, d: synteny.orientation(_anchors(s, d)),
    "chrom_pairs": lambda s, d: synteny.chrom_pairs(_anchors(s, d), _chroms(s, d, "l_suppkey", 10), _chroms(s, d, "l_partkey", 12)),
    "place_segmental": place_segmental,
    "with_placed": lambda s, d: dups.with_placed(pred(s, d), place_segmental(s, d)),
    "segdup_sizes": segdup_sizes,
    "ohnolog_pairs": ohnolog_pairs,
    "ohnolog_candidates": ohnolog_candidates,
    "ohnolog_funnel": ohnolog_funnel,
    "contradiction_counts": contradiction_counts,
    "lookup_counts": lookup_counts,
    "lift_counts": lift_counts,
    "pair_block_sizes": pair_block_sizes,
    "duplicated_regression": duplicated_regression,
    "member_sequences": member_sequences,
    "level_by_name": level_by_name,
    "ohnolog_summary": ohnolog_summary,
    "hits_for_groups": hits_for_groups,
    "group_matrix": group_matrix,
    "length_regression": length_regression,
    "symbol_fallback": symbol_fallback,
    "symbols_per_group": symbols_per_group,
    "term_counts": term_counts,
}

_DAYS = "date_diff('day', DATE '1992-01-01', l_shipdate::DATE)"
_FEATURES = f"""f AS (SELECT l_orderkey % 25 AS chrom, l_orderkey AS gene_id, CASE WHEN l_linenumber = 1 THEN 'gene' WHEN l_linenumber = 2 THEN 'transcript' WHEN l_linenumber < 6 THEN 'exon' ELSE 'CDS' END AS feature,
 {_DAYS} AS start, {_DAYS} + l_quantity::BIGINT AS "end", l_returnflag AS source FROM lineitem)"""
_INTERVALS = f"""iv AS (SELECT l_suppkey AS chrom, {_DAYS} + 1 AS start, {_DAYS} + 1 + l_quantity::BIGINT AS "end", CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '.' END AS strand, l_orderkey AS gene_id FROM lineitem)"""
_ANCHORS = f"""an AS (SELECT l_suppkey % 10 AS chrom_a, l_partkey % 12 AS chrom_b, {_DAYS} AS start_a, {_DAYS} + l_quantity::BIGINT AS end_a, l_partkey + l_orderkey % 100 AS start_b FROM lineitem)"""
_NEXT = "nx{k} AS (SELECT o_orderkey AS gene_a, o_orderpriority AS org_a, lead(o_orderkey, {k}) OVER w AS gene_b, lead(o_orderpriority, {k}) OVER w AS org_b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"
_TE = "(SELECT DISTINCT l_orderkey || '-' || l_partkey AS te, l_suppkey AS anchor, l_linestatus || (l_partkey % 5) AS family FROM lineitem WHERE l_returnflag = '{}')"
_SEG = """pd AS (SELECT o_custkey AS g, o_orderpriority AS spp, o_orderkey AS gene FROM orders WHERE o_orderkey % 11 <> 0),
c AS (SELECT o_custkey, o_orderkey AS dup_id, o_orderpriority AS spp FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 77 <> 0),
e AS (SELECT dup_id, c.spp, pd.g, CASE WHEN pd.spp <> c.spp THEN pd.spp END AS support FROM c JOIN pd ON pd.g = c.o_custkey
      UNION ALL SELECT dup_id, c.spp, pd.g, NULL FROM c LEFT JOIN pd ON pd.gene = dup_id + 1 WHERE dup_id % 5 = 0),
pl AS (SELECT CASE WHEN count(DISTINCT g) = 1 AND count(DISTINCT support) >= 2 THEN min(g) END AS group_id, spp, dup_id AS gene,
        CASE WHEN count(DISTINCT g) <> 1 THEN 'ambiguous' WHEN count(DISTINCT support) < 2 THEN 'low support' ELSE 'S' END AS state FROM e GROUP BY dup_id, spp)"""
_OHNO = """fg AS (SELECT o_custkey AS group_id, o_orderpriority AS spp, o_orderkey AS gene, o_orderkey % 3 = 0 AS tandem, CASE WHEN o_orderkey % 9 = 0 THEN 'NW_' ELSE 'NC_' END || (o_orderkey % 6) AS chrom FROM orders WHERE o_orderkey % 11 <> 0),
ag AS (SELECT group_id FROM fg GROUP BY group_id HAVING count(*) FILTER (spp = '1-URGENT') = 1 AND count(*) FILTER (spp = '2-HIGH') > 0 AND count(*) FILTER (spp = '3-MEDIUM') > 0
  AND count(*) FILTER (spp = '2-HIGH' AND NOT tandem) <= 1 AND count(*) FILTER (spp = '3-MEDIUM' AND NOT tandem) <= 1),
ff AS (SELECT fg.group_id, fg.spp, fg.gene, chrom, ref.group_id AS rg FROM fg JOIN ref USING (spp, gene) WHERE fg.spp IN ('2-HIGH', '3-MEDIUM')),
mt AS (SELECT DISTINCT x.group_id AS a, y.group_id AS b, y.spp, y.gene, y.chrom FROM ff x SEMI JOIN ag USING (group_id) JOIN ff y ON y.rg = x.rg AND y.group_id <> x.group_id),
cd AS (SELECT a, b FROM mt GROUP BY a, b HAVING bool_and(chrom LIKE 'NC!_%' ESCAPE '!' AND NOT EXISTS (SELECT 1 FROM fg u WHERE u.group_id = mt.a AND u.spp = mt.spp AND u.chrom = mt.chrom))),
kd AS (SELECT group_id AS b, bool_or(spp = '1-URGENT') AS ha, bool_or(spp NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS ho, bool_or(spp = '2-HIGH') AND bool_or(spp = '3-MEDIUM') AS both_fish FROM fg GROUP BY group_id),
oa AS (SELECT x.group_id AS a, y.group_id AS b, bool_or(x.rg IN (SELECT group_id FROM ref WHERE spp = '1-URGENT' GROUP BY 1 HAVING count(DISTINCT gene) = 1)) AS one_anchor
  FROM ff x SEMI JOIN ag USING (group_id) JOIN ff y ON y.rg = x.rg AND y.group_id <> x.group_id GROUP BY ALL),
op AS (SELECT a AS group_id, b AS candidate, (CASE WHEN ha THEN 3 WHEN ho THEN 2 ELSE 1 END)::INT AS category, one_anchor FROM cd JOIN kd USING (b) JOIN oa USING (a, b) WHERE both_fish),
oc AS (SELECT a AS group_id, b AS candidate, (CASE WHEN ha THEN 3 WHEN ho THEN 2 ELSE 1 END)::INT AS category FROM cd JOIN kd USING (b) WHERE both_fish
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY CASE WHEN ha THEN 3 WHEN ho THEN 2 ELSE 1 END, b) = 1)"""
_SYM = """p AS (SELECT p_size AS group_id, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS org, p_partkey AS gene, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'LOC' || p_partkey ELSE p_name END AS name FROM part),
nm AS (SELECT *, CASE WHEN name <> '' AND name NOT LIKE 'LOC%' THEN name END AS good FROM p),
sy AS (SELECT p.group_id, p.org, p.gene, p.name, coalesce(p.good,
  least(CASE WHEN u.org = 'a' THEN u.good END, CASE WHEN v.org = 'a' THEN v.good END), least(CASE WHEN u.org = 'b' THEN u.good END, CASE WHEN v.org = 'b' THEN v.good END)) AS symbol
  FROM nm p LEFT JOIN nm u ON u.gene = p.gene + 1 LEFT JOIN nm v ON v.gene = p.gene - 1)"""

_SPLICED = """SELECT 'D' || doc_id || '.t' AS transcript_id, md5(string_agg(substr(q, (97 * k + 11)::INT, 30), '' ORDER BY k)) AS seq_md5, sum(30)::BIGINT AS n
FROM (SELECT *, unnest(range(0, (length(q) - 40) // 97 + 1)) AS k FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS q FROM documents) WHERE length(q) >= 40) WHERE true"""

ORACLES = {
    "attach_parent": """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_returnflag AS f FROM lineitem)
SELECT 'gene' AS feature, 'g' || o || '.1' AS gene_id, 1::BIGINT AS n FROM (SELECT DISTINCT o FROM l)
UNION ALL SELECT 'transcript', 'g' || o || '.1', count(DISTINCT n) FROM l GROUP BY o
UNION ALL SELECT 'exon', g, count(*) FROM (SELECT DISTINCT o, n, CASE WHEN f = 'A' THEN 'g' || o ELSE 'g' || o || '.1' END AS g FROM l) GROUP BY g""",
    "noncoding_transcripts": f"{_SPLICED} AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 GROUP BY doc_id",
    "lost_chromosomes": "SELECT 'D' || doc_id AS chrom FROM documents WHERE doc_id % 5 = 0 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 40",
    "genome_chunks": f"""WITH q AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS q FROM documents), c AS (SELECT doc_id, chunk, substr(q, (chunk * {_WIDTH} + 1)::INT, {_WIDTH}) AS piece FROM (SELECT *, unnest(range(0, (length(q) + {_WIDTH} - 1) // {_WIDTH})) AS chunk FROM q))
SELECT 'D' || doc_id AS chrom, chunk, md5(piece) AS piece_md5, length(piece)::BIGINT AS n FROM c""",
    "fill_parent": "SELECT gene_id, count(*) AS n FROM (SELECT last_value(CASE WHEN l_linenumber = 1 THEN l_orderkey END IGNORE NULLS) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gene_id FROM lineitem) GROUP BY gene_id",
    "deep_parents": "SELECT DISTINCT 'r-' || l_orderkey || '-' || l_linenumber AS id, 'part' AS feature, 'g' || l_orderkey AS gene_id FROM lineitem UNION ALL SELECT DISTINCT 'g' || l_orderkey, 'gene', 'g' || l_orderkey FROM lineitem",
    "filter_by_ids": "SELECT p_partkey || '.2' AS seq_id, p_name AS seq FROM part WHERE p_partkey % 3 = 0",
    "gtf_attributes": """SELECT DISTINCT 'G' || l_orderkey AS gene_id, 'P' || l_partkey || '.' || l_linenumber AS isoform, count(*) OVER (PARTITION BY l_orderkey) AS n_records, max(l_linestatus) OVER (PARTITION BY l_orderkey) AS last_note FROM lineitem""",
    "gff_to_gtf": """SELECT 'transcript' AS feature, 'gene_id "' || l_orderkey || '"; transcript_id "' || l_partkey || '"; gene_name "' || l_returnflag || '";' AS attributes, count(*) AS n FROM lineitem GROUP BY ALL""",
    "merge_annotations": f"""WITH {_FEATURES} SELECT chrom, gene_id, feature, start, "end", source, row_number() OVER (PARTITION BY chrom ORDER BY gs, ge, gene_id, CASE feature WHEN 'gene' THEN 0 WHEN 'transcript' THEN 1 ELSE 2 END, start, "end", source) AS place
FROM (SELECT *, min(start) OVER (PARTITION BY gene_id) AS gs, max("end") OVER (PARTITION BY gene_id) AS ge FROM f)""",
    "noncoding_genes": f"WITH {_FEATURES} SELECT gene_id FROM f GROUP BY gene_id HAVING count(*) FILTER (feature = 'CDS') = 0",
    "noncoding_share": f"WITH {_FEATURES}, g AS (SELECT gene_id, count(*) FILTER (feature = 'CDS') AS c FROM f GROUP BY gene_id) SELECT count(*) AS n_genes, count(*) FILTER (c = 0) AS n_noncoding, round(count(*) FILTER (c = 0) / count(*)::DOUBLE * 100, 2) AS percent FROM g",
    "splice_exons": f"{_SPLICED} GROUP BY doc_id",
    "longest_per_key": "SELECT source, lang, doc_id, length(text)::BIGINT AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) = 1",
    "fasta_roundtrip": "SELECT 'D' || doc_id AS seq_id, lang AS gene, source AS transcript, length(q)::BIGINT AS length, md5(q) AS seq_md5 FROM (SELECT *, regexp_replace(text, '[^A-Za-z]', '', 'g') AS q FROM documents) WHERE q <> ''",
    "wide_roundtrip": with_views("pred") + " SELECT group_id::VARCHAR AS group_id, spp, gene::VARCHAR AS gene FROM pred",
    "loose_groups": with_views("lines") + " SELECT DISTINCT group_id::VARCHAR AS group_id, gene::VARCHAR AS gene FROM lines",
    "partition_roundtrip": with_views("lines") + " SELECT DISTINCT gene::VARCHAR AS gene, group_id, spp FROM lines",
    "number_models": f"""WITH h AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line, 'c' || (l_suppkey % 7) AS chrom, l_linestatus AS kind, {_DAYS} AS start, {_DAYS} + l_quantity::BIGINT AS "end" FROM lineitem),
n AS (SELECT *, 'ncRNA-' || kind || '-' || row_number() OVER (PARTITION BY kind ORDER BY chrom, start, "end", line) AS id FROM h)
SELECT id, feature, kind, chrom, start, "end" FROM n, (VALUES ('gene'), ('transcript'), ('exon')) AS v(feature)""",
    "lift_to_contigs": f"""WITH {_INTERVALS}, x AS (SELECT *, (start - 1) // 200 AS k FROM iv WHERE (start - 1) // 200 = ("end" - 1) // 200 AND (start - 1) // 200 <= 13)
SELECT chrom, start, "end", strand, gene_id, 'ctg' || k AS contig, CASE WHEN k % 2 = 1 THEN 200 - ("end" - k * 200) + 1 ELSE start - k * 200 END AS new_start,
 CASE WHEN k % 2 = 1 THEN 200 - (start - k * 200) + 1 ELSE "end" - k * 200 END AS new_end, CASE WHEN k % 2 = 1 THEN CASE strand WHEN '+' THEN '-' WHEN '-' THEN '+' ELSE strand END ELSE strand END AS new_strand FROM x""",
    "window_overlap": f"""WITH {_INTERVALS}, w AS (SELECT l_suppkey AS chrom, {_DAYS} - 5 AS ws, {_DAYS} + 5 AS we, l_orderkey AS anchor FROM lineitem)
SELECT chrom, anchor, count(*) AS n, sum("end" - start)::BIGINT AS bp FROM iv JOIN w USING (chrom) WHERE start <= we AND "end" >= ws GROUP BY ALL""",
    "te_windows": f"""WITH {_INTERVALS} SELECT t.chrom, count(*) AS n, count(DISTINCT t.gene_id) AS n_te FROM iv t JOIN iv a ON a.chrom = t.chrom AND t.strand = '+' AND a.strand = '-' AND t.start <= a."end" + 10 AND t."end" >= a.start - 10 GROUP BY t.chrom""",
    "te_ortholog_pairs": f"""WITH a0 AS (SELECT te, arg_min({{'a': anchor, 'f': family}}, anchor) AS x FROM {_TE.format('A')} GROUP BY te), b0 AS (SELECT te, arg_min({{'a': anchor, 'f': family}}, anchor) AS x FROM {_TE.format('R')} GROUP BY te),
a AS (SELECT te, x.a AS anchor, x.f AS family, row_number() OVER (PARTITION BY x.a, x.f ORDER BY te) AS k, count(*) OVER (PARTITION BY x.a, x.f) AS n FROM a0),
b AS (SELECT te, x.a AS anchor, x.f AS family, row_number() OVER (PARTITION BY x.a, x.f ORDER BY te) AS k, count(*) OVER (PARTITION BY x.a, x.f) AS n FROM b0)
SELECT a.te AS te_a, b.te AS te_b, anchor, family FROM a JOIN b USING (anchor, family) WHERE a.k = b.k OR (a.k > b.n AND b.k = b.n) OR (b.k > a.n AND a.k = a.n)""",
    "build_reference": """WITH s AS (SELECT DISTINCT p_brand AS taxon, lower(p_brand) AS spp FROM part WHERE p_size % 2 = 0 OR p_brand < 'Brand#4'),
g AS (SELECT p_partkey, p_brand AS taxon, nullif(concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR END,
   CASE WHEN p_partkey % 3 = 0 THEN 'NP_' || p_partkey WHEN p_partkey % 7 = 0 THEN 'ENSG' || p_partkey WHEN p_partkey % 5 = 0 THEN 'Q' || p_partkey END), '') AS gene,
   nullif(concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'geneid' END, CASE WHEN p_partkey % 3 = 0 THEN 'protein_id' WHEN p_partkey % 7 = 0 THEN 'ensembl' WHEN p_partkey % 5 = 0 THEN 'uniprot' END), '') AS source FROM part)
SELECT l_orderkey AS group_id, spp, gene, source, CASE WHEN spp IS NULL THEN 'not in map' WHEN gene IS NULL THEN 'missing id' ELSE 'mapped' END AS status, count(*) AS n FROM lineitem JOIN g ON l_partkey = p_partkey LEFT JOIN s USING (taxon) GROUP BY ALL""",
    "build_lookup": """SELECT l_returnflag AS spp, 'protein_id' AS kind, 'NP_' || l_partkey AS id, 'G' || min(l_orderkey) AS gene FROM lineitem GROUP BY l_returnflag, l_partkey
UNION ALL SELECT l_returnflag, 'geneid', l_partkey::VARCHAR, 'G' || min(l_orderkey) FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY l_returnflag, l_partkey""",
    "rename_ids": """WITH l AS (SELECT l_returnflag AS spp, l_partkey AS k, 'G' || min(l_orderkey) AS gene FROM lineitem GROUP BY ALL),
p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'R' END AS spp, '99999999,' || (p_partkey * 2) || ',NP_' || p_partkey AS ids FROM part)
SELECT p_partkey AS row_id, p_size AS group_id, p.spp, coalesce(a.gene, b.gene, ids) AS gene, CASE WHEN coalesce(a.gene, b.gene) IS NULL THEN 'geneid,geneid,protein_id' ELSE 'renamed' END AS source
FROM p LEFT JOIN l a ON a.spp = p.spp AND a.k = p_partkey * 2 LEFT JOIN l b ON b.spp = p.spp AND b.k = p_partkey""",
    "recode_ids": """SELECT p_size AS group_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '.1' ELSE p_partkey::VARCHAR END AS raw,
 CASE WHEN p_partkey % 4 = 0 THEN 'E' || p_partkey WHEN p_partkey % 3 = 0 THEN 'M' || p_partkey WHEN p_partkey % 5 = 0 THEN p_partkey::VARCHAR WHEN p_partkey % 2 = 0 THEN p_partkey || '.1' ELSE p_partkey::VARCHAR END AS gene,
 (CASE WHEN p_partkey % 4 = 0 THEN 3 WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 1 END WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 2 END ELSE 0 END)::INT AS step FROM part""",
    "filter_og2genes": "SELECT l_orderkey AS og_id, l_suppkey || ':' || l_partkey AS gene_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND s_nationkey < 5",
    "filter_by_taxon": "SELECT s_suppkey, s_nationkey AS taxon, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')",
    "collapse_transcripts": with_views("lines") + ", g AS (SELECT DISTINCT group_id, spp, (gene // 40)::VARCHAR AS gene FROM lines) SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY group_id) > 1",
    "anchor_contradictions": with_views("ref") + ", " + _NEXT.format(k=1) + """
SELECT gene_a, gene_b, a.group_id AS group_a, b.group_id AS group_b, CASE WHEN a.group_id IS NULL AND b.group_id IS NULL THEN 'both missing' WHEN a.group_id IS NULL THEN 'a missing' WHEN b.group_id IS NULL THEN 'b missing' ELSE 'different groups' END AS issue
FROM nx1 LEFT JOIN ref a ON a.gene = gene_a LEFT JOIN ref b ON b.gene = gene_b WHERE gene_b IS NOT NULL AND (a.group_id IS NULL OR b.group_id IS NULL OR a.group_id <> b.group_id)""",
    "tree_vs_pairs": f"""WITH {_NEXT.format(k=1)}, {_NEXT.format(k=2)},
t AS (SELECT org_a, gene_a, org_b, gene_b FROM nx1 WHERE gene_b IS NOT NULL UNION ALL SELECT org_a, gene_a, org_b, gene_b FROM nx2 WHERE gene_b IS NOT NULL),
q AS (SELECT * FROM nx1 WHERE gene_b IS NOT NULL AND gene_a % 4 <> 0),
i AS (SELECT t.*, CASE WHEN NOT EXISTS (SELECT 1 FROM q WHERE q.gene_a = t.gene_a AND q.org_a = t.org_a) THEN 'missing gene'
   WHEN NOT EXISTS (SELECT 1 FROM q WHERE q.gene_a = t.gene_a AND q.org_a = t.org_a AND q.org_b = t.org_b) THEN 'not linked'
   WHEN NOT EXISTS (SELECT 1 FROM q WHERE q.gene_a = t.gene_a AND q.org_a = t.org_a AND q.org_b = t.org_b AND q.gene_b = t.gene_b) THEN 'other gene' END AS issue FROM t)
SELECT org_a AS org, gene_a AS gene, string_agg(org_b || ' ' || gene_b || ' ' || issue, '; ' ORDER BY org_b || ' ' || gene_b || ' ' || issue) AS issues FROM i WHERE issue IS NOT NULL GROUP BY ALL""",
    "three_genomes": """WITH x AS (SELECT l_suppkey % 10 AS a, l_partkey % 12 AS b, l_orderkey % 9 AS c, l_quantity::BIGINT AS q FROM lineitem),
ab AS (SELECT a, b, count(*) AS n FROM x WHERE a <> 3 AND b <> 3 GROUP BY a, b QUALIFY row_number() OVER (PARTITION BY a ORDER BY sum(q) DESC, b) = 1),
bc AS (SELECT b, c, count(*) AS n FROM x WHERE b <> 3 AND c <> 3 GROUP BY ALL)
SELECT b AS chrom_b, a AS chrom_a, ab.n AS n_ab, c AS chrom_c, bc.n AS n_bc FROM ab JOIN bc USING (b)""",
    "low_certainty": "SELECT l_orderkey AS group_id, CASE WHEN p_size > 10 THEN p_brand ELSE 'p' || l_partkey END AS gene, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    "alg_table": with_views("lines") + """, t AS (SELECT group_id AS c, substr(spp, 7, 1) AS org, gene % 2 AS chrom FROM lines),
k AS (SELECT c, string_agg(DISTINCT org || ':' || chrom, ',' ORDER BY org || ':' || chrom) AS key FROM t GROUP BY c HAVING count(DISTINCT org) = 2),
n AS (SELECT key, count(*) AS n_clusters FROM k GROUP BY key HAVING count(*) >= 2)
SELECT key, org, chrom, count(*) AS n_genes, (sum(count(*)) OVER (PARTITION BY key))::BIGINT AS total, n_clusters FROM t JOIN k USING (c) JOIN n USING (key) GROUP BY key, n_clusters, org, chrom""",
    "partner_chrom": f"WITH {_ANCHORS} SELECT chrom_a, chrom_b, sum(end_a - start_a)::BIGINT AS covered FROM an GROUP BY chrom_a, chrom_b QUALIFY row_number() OVER (PARTITION BY chrom_a ORDER BY sum(end_a - start_a) DESC, chrom_b) = 1",
    "orientation": f"WITH {_ANCHORS} SELECT chrom_a, chrom_b, count(*) AS n, round(regr_slope(start_b, start_a), 6) AS slope, coalesce(regr_slope(start_b, start_a) < -1e-9, false) AS reversed FROM an GROUP BY ALL",
    "chrom_pairs": f"""WITH {_ANCHORS},
ca AS (SELECT l_suppkey % 10 AS chrom_a, count(*) AS length_a FROM lineitem WHERE l_suppkey % 10 <> 3 GROUP BY 1), cb AS (SELECT l_partkey % 12 AS chrom_b, count(*) AS length_b FROM lineitem WHERE l_partkey % 12 <> 3 GROUP BY 1),
oa AS (SELECT *, coalesce(sum(length_a) OVER (ORDER BY length_a DESC, chrom_a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_a FROM ca),
ob AS (SELECT *, coalesce(sum(length_b) OVER (ORDER BY length_b DESC, chrom_b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_b FROM cb),
n AS (SELECT chrom_a, chrom_b, count(*) AS n_anchors, sum(end_a - start_a)::BIGINT AS covered, coalesce(regr_slope(start_b, start_a) < -1e-9, false) AS reversed FROM an WHERE chrom_a <> 3 AND chrom_b <> 3 GROUP BY ALL)
SELECT n.chrom_a, n.chrom_b, n_anchors, covered, length_a, offset_a, length_b, offset_b, row_number() OVER (PARTITION BY n.chrom_a ORDER BY covered DESC, n.chrom_b) = 1 AS best, reversed FROM n JOIN oa USING (chrom_a) JOIN ob USING (chrom_b)""",
    "place_segmental": f"WITH {_SEG} SELECT * FROM pl",
    "with_placed": f"""WITH {_SEG}, a AS (SELECT g AS group_id, spp, gene FROM pd UNION SELECT group_id, spp, gene FROM pl WHERE state = 'S')
SELECT group_id, spp, gene, element_count, org_count FROM a JOIN (SELECT group_id, count(*) AS element_count, count(DISTINCT spp) AS org_count FROM a GROUP BY 1) USING (group_id)""",
    "segdup_sizes": "SELECT spp, size, count(*) AS n_blocks FROM (SELECT l_orderkey, count(*) AS size, min(l_returnflag) AS spp FROM lineitem GROUP BY 1) GROUP BY ALL",
    "ohnolog_pairs": with_views("ref") + f", {_OHNO} SELECT * FROM op",
    "ohnolog_funnel": with_views("ref") + f""", {_OHNO},
fl AS (SELECT group_id, count(*) FILTER (spp = '1-URGENT') = 1 AND count(*) FILTER (spp = '2-HIGH') > 0 AND count(*) FILTER (spp = '3-MEDIUM') > 0 AS met, group_id IN (SELECT group_id FROM ag) AS ok, bool_or(chrom NOT LIKE 'NC!_%' ESCAPE '!') AS off FROM fg GROUP BY group_id),
u AS (SELECT 1 AS stage, count(*) FILTER (met) AS n FROM fl UNION ALL SELECT 2, count(*) FILTER (met AND NOT ok) FROM fl UNION ALL SELECT 3, count(*) FILTER (ok) FROM fl UNION ALL SELECT 4, count(*) FILTER (ok AND off) FROM fl
  UNION ALL SELECT 5, count(DISTINCT group_id) FROM op UNION ALL SELECT 6, count(DISTINCT group_id) FROM op WHERE category < 3 UNION ALL SELECT 7, count(DISTINCT group_id) FROM op WHERE category < 3 AND one_anchor
  UNION ALL SELECT 8, count(DISTINCT group_id) FROM op WHERE category = 1 AND one_anchor)
SELECT stage, n, CASE WHEN stage > 4 THEN round(n / (SELECT n FROM u WHERE stage = 3)::DOUBLE * 100, 2) END AS percent FROM u""",
    "contradiction_counts": with_views("ref") + ", " + _NEXT.format(k=1) + """
SELECT org_a || '-' || org_b AS file, count(*) AS n_pairs, count(*) FILTER (a.group_id <> b.group_id) AS different, count(*) FILTER (a.group_id IS NULL AND b.group_id IS NOT NULL) AS a_missing,
 count(*) FILTER (a.group_id IS NOT NULL AND b.group_id IS NULL) AS b_missing, count(*) FILTER (a.group_id IS NULL AND b.group_id IS NULL) AS both_missing
FROM nx1 LEFT JOIN ref a ON a.gene = gene_a LEFT JOIN ref b ON b.gene = gene_b WHERE gene_b IS NOT NULL GROUP BY ROLLUP (org_a || '-' || org_b)""",
    "lookup_counts": "SELECT count(*) AS n_records, count(*) FILTER (l_orderkey % 3 = 1 AND l_partkey % 10 = 0) AS n_missing, count(*) FILTER (l_orderkey % 3 = 2) AS n_ignored FROM lineitem",
    "lift_counts": f"""WITH g AS (SELECT l_orderkey, min({_DAYS}) // 40 = max({_DAYS}) // 40 AS kept, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS n_genes, count(*) FILTER (NOT kept) AS n_genes_dropped, sum(n)::BIGINT AS n_children, coalesce(sum(n) FILTER (NOT kept), 0)::BIGINT AS n_children_dropped FROM g""",
    "pair_block_sizes": """WITH b AS (SELECT l_orderkey, count(*) AS size, min(l_returnflag) AS a, max(l_linestatus) AS b FROM lineitem GROUP BY 1)
SELECT spp, spp_b, size, count(*) AS n_blocks FROM (SELECT a AS spp, b AS spp_b, l_orderkey, size FROM b UNION SELECT b, a, l_orderkey, size FROM b) GROUP BY ALL""",
    "duplicated_regression": """WITH x AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) >= 5 AND p_size % 2 = 0 AS both_dup FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT both_dup, any_value(c) AS n, round(regr_slope(log10(l_extendedprice), log10(l_quantity * l_partkey)), 6) AS slope, round(regr_intercept(log10(l_extendedprice), log10(l_quantity * l_partkey)), 6) AS intercept,
 round(regr_r2(log10(l_extendedprice), log10(l_quantity * l_partkey)), 6) AS r2
FROM (SELECT *, count(*) OVER (PARTITION BY both_dup) AS c FROM x) WHERE l_partkey > 0 GROUP BY both_dup""",
    "member_sequences": "SELECT DISTINCT l_orderkey AS group_id, l_partkey AS gene, 'i' || p_partkey AS seq_id, p_name AS seq FROM lineitem JOIN part ON p_partkey - p_partkey % 2 = l_partkey",
    "level_by_name": "SELECT o_orderkey AS og_id FROM orders WHERE lower(substr(o_orderpriority, 3)) = 'urgent'",
    "ohnolog_candidates": with_views("ref") + f", {_OHNO} SELECT * FROM oc",
    "ohnolog_summary": with_views("ref") + f", {_OHNO}, x AS (SELECT coalesce(category, 0)::INT AS category FROM ag LEFT JOIN oc USING (group_id)) SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM x)::DOUBLE * 100, 2) AS percent FROM x GROUP BY category",
    "hits_for_groups": with_views("pred") + " SELECT group_id, count(*) AS n_hits, max(l_extendedprice) AS best, count(DISTINCT l_partkey) AS n_subjects FROM lineitem JOIN pred ON gene = l_orderkey GROUP BY group_id",
    "group_matrix": with_views("pred") + f""", {_NEXT.format(k=1)}, c AS (SELECT * FROM pred),
h AS (SELECT o_orderkey AS a, unnest([o_orderkey + 1, o_orderkey + 2, o_orderkey * 2]) AS b, o_totalprice AS s FROM orders UNION ALL SELECT gene_a, gene_b, 1.5 FROM nx1 WHERE gene_b IS NOT NULL),
m AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(s) AS s FROM h GROUP BY ALL)
SELECT x.group_id, x.gene AS gene_a, y.gene AS gene_b, coalesce(s, 0) AS best, true AS same_group FROM c x JOIN c y ON x.group_id = y.group_id AND x.spp <> y.spp AND x.gene < y.gene LEFT JOIN m ON m.a = x.gene AND m.b = y.gene
UNION ALL SELECT x.group_id, x.gene, y.gene, s, false FROM m JOIN c x ON x.gene = m.a JOIN c y ON y.gene = m.b WHERE x.spp <> y.spp AND x.group_id <> y.group_id""",
    "length_regression": """SELECT l_returnflag, l_linestatus, any_value(c) AS n, round(regr_slope(log10(l_extendedprice), log10(l_quantity * l_partkey)), 6) AS slope,
 round(regr_intercept(log10(l_extendedprice), log10(l_quantity * l_partkey)), 6) AS intercept, round(regr_r2(log10(l_extendedprice), log10(l_quantity * l_partkey)), 6) AS r2 FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS c FROM lineitem) WHERE l_partkey > 0 GROUP BY l_returnflag, l_linestatus""",
    "symbol_fallback": f"WITH {_SYM} SELECT * FROM sy",
    "symbols_per_group": f"WITH {_SYM} SELECT group_id, coalesce(string_agg(DISTINCT symbol, ',' ORDER BY symbol), '') AS symbols FROM sy GROUP BY group_id",
    "term_counts": """WITH t AS (SELECT DISTINCT event_type AS symbol, 'GO:' || (user_id % 5) AS go_id, 't' || (user_id % 5) AS term FROM events WHERE user_id % 2 = 0)
SELECT go_id, term, count(*) AS n FROM events JOIN t ON symbol = event_type GROUP BY ALL""",
}

