"""Readers: each returns a DataFrame of named columns. `#` lines and blank lines are skipped; gzip is chosen by suffix.

Where a rule depends on line order, rows carry (file, line_no): lines keep the order of the file's blocks and of the rows
within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ortholens.functions import attrs, ids, seqs
from ortholens.functions.seqs import CHUNK
from ortholens.operators.ranges import bucketed, carried, summed
from ortholens.sources.shared import counted


def text_lines(spark: SparkSession, path: str | list[str], comments: bool = False) -> DataFrame:
    """file, block, line_no, value; line_no grows within a file."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nr")
    )
    kept = raw if comments else raw.where("trim(value) <> '' and not startswith(value, '#')")
    return kept.select("file", F.struct("path", "block", "nr").alias("line_no"), "value")


def _cell(k: int) -> Column:
    """Column k of the tab-split line; null if missing or empty."""
    v = F.trim(F.get(F.col("cells"), F.lit(k)))
    return F.when(v != "", v)


def _cells(spark: SparkSession, path) -> DataFrame:
    return text_lines(spark, path).select("file", "line_no", F.split("value", "\t", -1).alias("cells"))


def _columns(spark: SparkSession, path, **places: int) -> DataFrame:
    return _cells(spark, path).select("file", *(_cell(k).alias(name) for name, k in places.items()))


def file_species(file: Column) -> Column:
    return F.substring_index(file, ".", 1)


LONG = ("group_id", "type", "element_count", "org_count", "org", "element_id", "name", "copy_state", "paralog_count", "chrom", "start_bp", "end_bp")


def read_groups_long(spark: SparkSession, path, drop_states: tuple[str, ...] = ()) -> DataFrame:
    """The 12- or 10-column membership; species are cut at the first dot and lower-cased. Other widths raise."""
    c = _cells(spark, path)
    width = F.size("cells")
    ok = F.assert_true(width.isin(10, 12), F.concat(F.lit("membership rows have 10 or 12 columns, not "), width.cast("string")))
    short = lambda k: k if k < 7 else k - 2
    cols = [F.when(width == 12, _cell(k)).when(F.lit(name not in ("copy_state", "paralog_count")), _cell(short(k))).alias(name) for k, name in enumerate(LONG)]
    rows = c.withColumn("ok", ok).where("ok is null").select(*cols)
    typed = rows.withColumns({n: F.expr(f"try_cast({n} as bigint)") for n in ("element_count", "org_count", "paralog_count", "start_bp", "end_bp")})
    typed = typed.withColumns({"spp": ids.canonical(F.col("org")), "gene": F.col("element_id")})
    return typed.where(F.col("copy_state").isNull() | ~F.col("copy_state").isin(*drop_states)) if drop_states else typed


def read_groups_wide(spark: SparkSession, path) -> DataFrame:
    """`#GroupID<TAB>spp...` with comma-joined cells, to (group_id, spp, gene)."""
    wide = spark.read.csv(path, sep="\t", header=True, quote="")
    first, *species = wide.columns
    named = wide.withColumnRenamed(first, "group_id")
    long = named.unpivot("group_id", species, "spp", "cell") if species else named.selectExpr("group_id", "'' as spp", "'' as cell")
    return long.select("group_id", "spp", F.explode_outer(F.split("cell", r",\s*")).alias("gene")).where("gene <> ''")


def read_group_table(spark: SparkSession, path, first_col: int = 1, id_map: DataFrame | None = None, on_missing: str = "error", strip: str = "mRNA.") -> DataFrame:
    """A caller's group table, genes from column first_col on; ids mapped as they are, then without version.

    on_missing: error raises on an id without gene, drop leaves it out, keep keeps it.
    """
    wide = spark.read.csv(path, sep="\t", header=True, quote="")
    cols = wide.columns
    long = wide.select(F.col(f"`{cols[0]}`").alias("group_id"), *(f"`{c}`" for c in cols[first_col:])).unpivot("group_id", cols[first_col:], "spp", "cell")
    g = long.select("group_id", "spp", F.explode_outer(F.split("cell", r",\s*")).alias("raw")).where("raw <> ''").withColumn("raw", F.regexp_replace("raw", "^" + strip.replace(".", r"\."), ""))
    if id_map is None:
        return g.withColumnRenamed("raw", "gene")
    m = id_map.groupBy("spp", "isoform").agg(F.min("gene").alias("mapped"))
    j = g.join(m.withColumnRenamed("isoform", "raw"), ["spp", "raw"], "left").withColumn("base", ids.strip_version(F.col("raw")))
    j = j.join(m.toDF("spp", "base", "by_base"), ["spp", "base"], "left")
    gene = F.coalesce("mapped", "by_base")
    if on_missing == "error":
        gene = F.coalesce(gene, F.raise_error(F.concat(F.lit("no gene for id "), F.col("raw"))).cast("string"))
    elif on_missing == "keep":
        gene = F.coalesce(gene, F.col("raw"))
    return j.select("group_id", "spp", gene.alias("gene")).where("gene is not null").distinct()


def read_group_lines(spark: SparkSession, path) -> DataFrame:
    """`id: spp|gene spp|gene` lines."""
    v = text_lines(spark, path).select(F.split("value", r":\s*", 2).alias("p"))
    m = v.select(F.trim(F.get("p", F.lit(0))).alias("group_id"), F.explode_outer(F.split(F.get("p", F.lit(1)), r"\s+")).alias("x")).where("x <> ''")
    return m.select("group_id", F.split_part("x", F.lit("|"), F.lit(1)).alias("spp"), F.regexp_replace("x", r"^[^|]*\|", "").alias("gene"))


def read_pair_tables(spark: SparkSession, path) -> DataFrame:
    """Files `table.A.faa-B.faa`, columns 2 and 3 hold `gene score` runs: (spp_a, spp_b, row_id, spp, gene)."""
    c = _cells(spark, path).where(~_cell(0).startswith("O"))
    name = F.regexp_extract_all("file", F.lit(r"([A-Za-z0-9_]+)\.faa"), F.lit(1))
    every = lambda k: F.filter(F.split(F.coalesce(_cell(k), F.lit("")), r"\s+"), lambda x, i: (i % 2 == 0) & (x != ""))
    r = c.select(F.get(name, F.lit(0)).alias("spp_a"), F.get(name, F.lit(1)).alias("spp_b"), _cell(0).alias("row_id"), every(2).alias("a"), every(3).alias("b"))
    side = lambda s: r.select("spp_a", "spp_b", "row_id", F.col(f"spp_{s}").alias("spp"), F.explode_outer(s).alias("gene")).where("gene is not null")
    return side("a").unionByName(side("b")).withColumn("gene", ids.strip_transcript_tag(F.col("gene")))


def read_group_dir(spark: SparkSession, path, prefix: str = "") -> DataFrame:
    """One gene a line, group id in the file name after prefix and before the suffix."""
    t = text_lines(spark, path)
    return t.select(F.regexp_replace(F.regexp_replace("file", "^" + prefix.replace(".", r"\."), ""), r"\.[^.]*$", "").alias("group_id"), F.trim("value").alias("gene"))


def read_loose_groups(spark: SparkSession, path, known: DataFrame) -> DataFrame:
    """Lines `name: g1, g2`, tabs or blanks; rows before the first that holds a known gene are header and dropped."""
    t = text_lines(spark, path)
    cut = F.when(F.col("value").contains(":"), F.regexp_replace("value", r"^[^:]*:\s*", "")).otherwise(F.regexp_replace("value", r"^\S+\s+", ""))
    name = F.regexp_extract("value", r"^([^:\s]+)", 1)
    g = t.select("file", "line_no", name.alias("group_id"), F.explode_outer(F.split(cut, r"[\s,]+")).alias("gene")).where("gene <> ''")
    first = g.join(known.select("gene").distinct(), "gene", "left_semi").groupBy("file").agg(F.min("line_no").alias("first"))
    return g.join(first, "file").where("line_no >= first").select("group_id", "gene")


def read_odb_genes(spark: SparkSession, path) -> DataFrame:
    return _columns(spark, path, gene_id=0, taxon=1, protein_id=2, synonyms=3, uniprot=4, ensembl=5)


def read_og2genes(spark: SparkSession, path) -> DataFrame:
    """og_id, gene_id; a malformed line raises."""
    c = _cells(spark, path)
    bad = F.assert_true(F.size("cells") >= 2, F.lit("malformed og2genes line"))
    return c.withColumn("ok", bad).where("ok is null").select(_cell(0).alias("og_id"), _cell(1).alias("gene_id"))


def read_ogs(spark: SparkSession, path) -> DataFrame:
    return _columns(spark, path, og_id=0, level_id=1, name=2).drop("file")


def read_ref_groups(spark: SparkSession, path, only_renamed: bool = True) -> DataFrame:
    r = _columns(spark, path, group_id=0, gene=1, spp=2, source=3).drop("file")
    return r.where("source = 'renamed'") if only_renamed else r


def read_ref_groups_counted(spark: SparkSession, path) -> tuple[DataFrame, dict[str, int]]:
    """The renamed rows, and n_rows, n_skipped (of any other source), counted while they are read."""
    r, n = counted(read_ref_groups(spark, path, only_renamed=False), "ref-groups", n_rows=F.count(F.lit(1)), n_skipped=F.count_if(~F.col("source").eqNullSafe("renamed")))
    return r.where("source = 'renamed'"), n


#: Suffixes of annotation files, the preferred first.
ANNOTATION_SUFFIXES = (".gtf", ".gtf.gz", ".gff", ".gff.gz")


def read_annotations(spark: SparkSession, path) -> DataFrame:
    """read_annotation over a folder of several formats, with `bad` for records of fewer than nine columns or without numeric ends.

    Of each species (the file's name up to the first dot) only the files with its best suffix are read: .gtf, .gtf.gz, .gff, .gff.gz.
    """
    r = read_annotation(spark, path, keep_bad=True)
    rank = F.coalesce(*(F.when(F.col("file").endswith(x), k) for k, x in enumerate(ANNOTATION_SUFFIXES)))
    files = r.select("file", "spp", rank.alias("rank")).where("rank is not null").distinct()
    best = files.groupBy("spp").agg(F.min("rank").alias("rank"))
    return r.join(files.join(best, ["spp", "rank"]).select("file"), "file", "left_semi")


def read_annotation(spark: SparkSession, path, keep_bad: bool = False) -> DataFrame:
    """Nine-column records with attrs (map), gene_id, isoform and species from the file name; others are left out or marked bad."""
    c = _cells(spark, path)
    c = c if keep_bad else c.where(F.size("cells") >= 9)
    names = ("chrom", "source", "feature", "start", "end", "score", "strand", "phase", "attributes")
    r = c.select("file", "line_no", *(_cell(k).alias(n) for k, n in enumerate(names)))
    r = r.withColumns({"start": F.expr("try_cast(start as bigint)"), "end": F.expr("try_cast(`end` as bigint)"), "spp": file_species(F.col("file"))})
    if keep_bad:
        r = r.withColumn("bad", F.col("attributes").isNull() | F.col("start").isNull() | F.col("end").isNull())
    return attrs.parsed(r)


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """file, header, seq_id, seq, length: records parted at `>`."""
    raw = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_name").alias("file"), "value").where("trim(value) <> ''")
    head = F.trim(F.substring_index("value", "\n", 1))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return raw.select("file", head.alias("header"), seqs.seq_id(head).alias("seq_id"), body.alias("seq"), F.length(body).alias("length"))


def read_genome(spark: SparkSession, path, width: int = CHUNK) -> DataFrame:
    """chrom, chunk, piece: sequences of any length in pieces of `width` letters, straight from the lines of FASTA files.

    The header above a line and the letters before it in its file are carried over range buckets of lines, so that one
    chromosome is read by many tasks; a line that spans two chunks is cut.
    """
    raw = text_lines(spark, path, comments=True).withColumn("value", F.trim("value")).where("value <> '' and not startswith(value, '#')")
    head = F.col("value").startswith(">")
    lines = bucketed(raw, ["file"], ["line_no"])
    at = summed(lines, ["file"], ["line_no"], F.when(head, 0).otherwise(F.length("value")).cast("long"), "at")
    named = carried(at, ["file"], ["line_no"], F.when(head, F.struct(seqs.seq_id(F.substring("value", 2, 1 << 30)).alias("chrom"), F.col("at").alias("begin"))), "head")
    body = named.where(~head & F.col("head").isNotNull()).select("file", "line_no", F.col("head.chrom").alias("chrom"), (F.col("at") - F.col("head.begin")).alias("off"), "value")
    cut = body.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("off") / width), F.floor((F.col("off") + F.length("value") - 1) / width))))
    first = F.greatest(F.col("chunk") * width - F.col("off"), F.lit(0))
    last = F.least((F.col("chunk") + 1) * width - F.col("off"), F.length("value"))
    part = F.struct("file", "line_no", seqs.subseq(F.col("value"), first + 1, last).alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), "")
    return cut.groupBy("chrom", "chunk").agg(joined.alias("piece"))


def read_agp(spark: SparkSession, path) -> DataFrame:
    r = _columns(spark, path, chrom=0, beg=1, end=2, comp_type=4, contig=5, size=7, orient=8).drop("file").where("comp_type not in ('N', 'U')")
    return r.withColumns({n: F.col(n).cast("bigint") for n in ("beg", "end", "size")})


def read_anchor_pairs(spark: SparkSession, path, layout: int = 16, first_org: str | None = None) -> DataFrame:
    """Anchor pairs of the 16- or the older 15-column layout, turned so that first_org is side a."""
    at = {"cluster_id": 1, "org_a": 2, "org_b": 3, "gene_a": 4, "chrom_a": 6, "start_a": 8, "end_a": 9, "gene_b": 10, "chrom_b": 12, "start_b": 14, "end_b": 15}
    r = _columns(spark, path, **{k: v - (layout == 15) for k, v in at.items()})
    r = r.withColumns({n: F.col(n).cast("bigint") for n in ("start_a", "end_a", "start_b", "end_b")})
    if first_org is None:
        return r
    turn = F.col("org_b") == first_org
    side = {f"{n}_{x}": F.when(turn, F.col(f"{n}_{'b' if x == 'a' else 'a'}")).otherwise(F.col(f"{n}_{x}")) for n in ("org", "gene", "chrom", "start", "end") for x in "ab"}
    return r.withColumns(side)


def read_segdups(spark: SparkSession, path) -> DataFrame:
    r = _columns(spark, path, block_id=0, size=1, spp=2, dup_id=3, name=4, chrom=5, start=7, end=8, gene_id=9, spp_b=15, gene_b=16)
    return r.withColumns({n: F.col(n).cast("bigint") for n in ("size", "start", "end")})


def read_chromosomes(spark: SparkSession, path, min_len: int = 1_000_000, layout: str = "new") -> DataFrame:
    k = 1 if layout == "new" else 0
    r = _columns(spark, path, spp=k, chrom=k + 1, length=k + 2).drop("file")
    return r.withColumn("length", F.col("length").cast("bigint")).where(F.col("length") >= min_len)


def read_tree_clusters(spark: SparkSession, path) -> DataFrame:
    c = _cells(spark, path)
    last = F.coalesce(F.get(F.col("cells"), F.size("cells") - 1), F.lit(""))
    part = lambda k: F.regexp_extract_all(last, F.lit(r"([^\s,]+) ([^,(]*)\(([^)]*)\)"), F.lit(k))
    partners = F.zip_with(part(1), part(3), lambda o, g: F.struct(o.alias("org"), g.alias("gene")))
    return c.select(_cell(0).alias("cluster_id"), _cell(2).cast("int").alias("org_count"), _cell(3).alias("org"), _cell(4).alias("chrom"), _cell(5).alias("gene"), _cell(6).alias("name"), partners.alias("partners"))


def read_homologs(spark: SparkSession, path) -> DataFrame:
    return _columns(spark, path, org_a=2, org_b=3, id_a=4, name_a=5, id_b=9, name_b=10)


def read_hits(spark: SparkSession, path) -> DataFrame:
    """Aligner output: query, subject, score (column 12) and the line."""
    t = text_lines(spark, path)
    c = F.split("value", "\t")
    return t.select(F.get(c, F.lit(0)).alias("query"), F.get(c, F.lit(1)).alias("subject"), F.expr("try_cast(get(split(value, '\t'), 11) as double)").alias("score"), F.col("value").alias("line"))


def read_rbh(spark: SparkSession, path) -> DataFrame:
    r = _columns(spark, path, spp1=0, gene1=1, len1=2, spp2=3, gene2=4, len2=5, bitscore=6).drop("file")
    return r.withColumns({"len1": F.col("len1").cast("int"), "len2": F.col("len2").cast("int"), "bitscore": F.col("bitscore").cast("double")})


def parse_cmscan(lines: DataFrame) -> DataFrame:
    """line, chrom, kind, start, end, strand, description from blank-separated rows `value`.

    The third and fourth of the row's integers are start and end; the text after the last dash describes the model.
    """
    w = F.split(F.trim("value"), r"\s+")
    ints = F.filter(w, lambda x: x.rlike("^[0-9]+$"))
    a, b = (F.get(ints, F.lit(k)).cast("bigint") for k in (2, 3))
    return lines.select(
        "line", F.get(w, F.lit(0)).alias("chrom"), F.get(w, F.lit(1)).alias("kind"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"),
        F.when(a > b, "-").otherwise("+").alias("strand"), F.trim(F.regexp_extract("value", r"-([^-]*)$", 1)).alias("description"),
    )


def read_cmscan(spark: SparkSession, path) -> DataFrame:
    return parse_cmscan(text_lines(spark, path).select(F.col("line_no").alias("line"), "value"))


def read_id_map(spark: SparkSession, path) -> DataFrame:
    return _columns(spark, path, gene=0, isoform=1).select(file_species(F.col("file")).alias("spp"), "gene", "isoform")


def read_list(spark: SparkSession, path) -> DataFrame:
    return text_lines(spark, path).select(F.trim("value").alias("id"))


def read_rename_map(spark: SparkSession, path) -> DataFrame:
    return _columns(spark, path, taxon=0, spp=1).drop("file")


def read_te_gff(spark: SparkSession, path, chroms: DataFrame) -> DataFrame:
    """Elements on listed chromosomes, family from the ID attribute."""
    r = _columns(spark, path, chrom=0, subfamily=2, start=3, end=4, strand=6, attributes=8)
    r = r.withColumns({"spp": file_species(F.col("file")), "family": seqs.family(F.regexp_extract("attributes", "(?i)ID=([^;]+)", 1))})
    return r.withColumns({n: F.col(n).cast("bigint") for n in ("start", "end")}).drop("file", "attributes").join(chroms.select("chrom").distinct(), "chrom", "left_semi")


def read_duplicates(spark: SparkSession, path) -> DataFrame:
    return _columns(spark, path, spp=1, gene=5).drop("file")


def in_file_order(df: DataFrame) -> DataFrame:
    """Adds nr, the place of each line in its file."""
    return df.withColumn("nr", F.row_number().over(Window.partitionBy("file").orderBy("line_no")))
