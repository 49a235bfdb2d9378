"""Readers, writers, functions and annotation operators on small files."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from ortholens.functions import attrs, ids, seqs
from ortholens.operators import annotation, ranges, references, synteny
from ortholens.sources import readers, writers
from ortholens.streaming import filters


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ('gene_id "A"; x "1";', "A"), ("ID=g1;Parent=p", "g1"), ("ID=g1;ID=g2", "g2"), ("lone", "lone"), ('gene_id "";x "y"', None), ("x 1; y 2", None),
])
def test_gene_id(spark, text, want):
    assert one(spark, attrs.gene_id(F.col("a")), a=text) == want


def test_attribute_map_keeps_the_last_and_skips_empty(spark):
    m = one(spark, attrs.to_map(F.col("a")), a='k "v1"; k "v2"; e ""; n=10;db_xref "GeneID:1"')
    assert m == {"k": "v2", "n": "10", "db_xref": "GeneID:1"}


def test_isoforms(spark):
    iso = attrs.isoform_id(attrs.to_map(F.col("a")))
    assert one(spark, iso, a='protein_id "NP_1"; protein_version "2"') == "NP_1.2"
    assert one(spark, iso, a='transcript_id "T"') == "T"
    assert one(spark, iso, a="Parent=p;x=1") == "p"


def test_ids(spark):
    c = F.col("a")
    assert one(spark, ids.strip_version(c), a="E1.2;E2.1") == "E1"
    assert [one(spark, ids.strip_transcript_tag(c, m), a=x) for m, x in (("suffix", "g.1.t3"), ("last", "g.txx"), ("digits", "g.7"))] == ["g.1", "g", "g"]
    assert one(spark, ids.first_numeric(c), a="X;12;7") == "12"
    assert one(spark, ids.first_numeric(c), a="X") is None
    assert one(spark, ids.unnamed(c), a="LOC12") is True
    gene, source = ids.compose(F.col("g"), F.col("p"), F.col("e"), F.col("u"))
    r = spark.createDataFrame([("1", None, "E", "U"), (None, None, None, None), ("", "P", "E", "")], "g string, p string, e string, u string").select(gene, source).collect()
    assert [tuple(x) for x in r] == [("1,E", "geneid,ensembl"), (None, None), ("P", "protein_id")]


def test_long_groups_of_both_widths(spark, tmp_path):
    p = put(tmp_path, "g.tsv", "#c\n1\tgene\t3\t2\tAAA.def\tg1\tABC\tR\t2\tNC\t100\t900\n1\tgene\t3\t2\tbbb\th1\tABC\tNC\t100\t900\n")
    assert rows(readers.read_groups_long(spark, p).select("spp", "gene", "copy_state", "chrom", "end_bp")) == [("aaa", "g1", "R", "NC", 900), ("bbb", "h1", None, "NC", 900)]
    assert readers.read_groups_long(spark, p, drop_states=("R",)).count() == 1
    bad = put(tmp_path, "bad.tsv", "1\t2\t3\n")
    with pytest.raises(Exception, match="10 or 12 columns"):
        readers.read_groups_long(spark, bad).count()


def test_wide_lines_dirs_and_gzip(spark, tmp_path):
    wide = put(tmp_path, "w.tsv", "#GroupID\taaa\tbbb\nOG1\tg1, g2\t\nOG2\t\th1\n")
    assert rows(readers.read_groups_wide(spark, wide)) == [("OG1", "aaa", "g1"), ("OG1", "aaa", "g2"), ("OG2", "bbb", "h1")]
    lines = put(tmp_path, "l.txt", "g1: aaa|x.t1 bbb|y|z\n")
    assert rows(readers.read_group_lines(spark, lines)) == [("g1", "aaa", "x.t1"), ("g1", "bbb", "y|z")]
    d = tmp_path / "refs"
    d.mkdir()
    (d / "Ref.001.txt").write_text("A\nB\n")
    with gzip.open(d / "Ref.002.txt.gz", "wt") as f:
        f.write("C\n")
    assert {r["gene"] for r in readers.read_group_dir(spark, f"file://{d}", "Ref.").collect()} == {"A", "B", "C"}


def test_caller_table_maps_ids(spark, tmp_path):
    t = put(tmp_path, "o.tsv", "Orthogroup\taaa\nOG1\tp1.1, mRNA.p2\n")
    m = spark.createDataFrame([("aaa", "G1", "p1"), ("aaa", "G2", "p2")], "spp string, gene string, isoform string")
    assert rows(readers.read_group_table(spark, t, 1, m)) == [("OG1", "aaa", "G1"), ("OG1", "aaa", "G2")]
    with pytest.raises(Exception, match="no gene for id"):
        readers.read_group_table(spark, t, 1, m.where("gene = 'G1'")).count()
    assert readers.read_group_table(spark, t, 1, m.where("gene = 'G1'"), on_missing="drop").count() == 1


def test_pair_tables(spark, tmp_path):
    p = put(tmp_path, "table.AAA.faa-BBB.faa", "OrtoID\tScore\ta\tb\n1\t250\tg1.t1 1.0 g2.t1 0.4\th1.t1 1.0\n")
    assert rows(readers.read_pair_tables(spark, p)) == [("AAA", "BBB", "1", "AAA", "g1"), ("AAA", "BBB", "1", "AAA", "g2"), ("AAA", "BBB", "1", "BBB", "h1")]


def test_loose_groups_skip_the_header(spark, tmp_path):
    p = put(tmp_path, "x.txt", "HOG\tOG\tGene\nOG1: A, B\nOG2\tC D\n")
    known = spark.createDataFrame([("A",)], "gene string")
    assert rows(readers.read_loose_groups(spark, p, known)) == [("OG1", "A"), ("OG1", "B"), ("OG2", "C"), ("OG2", "D")]


def test_fasta_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("a pep x gene:G.1 transcript:T.2", "ACGT" * 40), ("b", "AC")], "header string, seq string")
    out = f"file://{tmp_path}/fa"
    writers.write_fasta(s, out)
    assert max(len(x["value"]) for x in spark.read.text(out).collect()) <= 60
    assert rows(readers.read_fasta(spark, out).select("seq_id", "seq")) == [("a", "ACGT" * 40), ("b", "AC")]
    assert one(spark, seqs.header_gene(F.col("h")), h="a pep x gene:G.1 transcript:T.2") == "G"


def test_annotation_agp_anchors_and_tables(spark, tmp_path):
    gtf = put(tmp_path, "aaa.x.gtf", '#h\nNC_1\tx\tCDS\t10\t90\t.\t+\t0\tgene_id "A"; protein_id "NP"; protein_version "1";\n')
    assert rows(readers.read_annotation(spark, gtf).select("spp", "gene_id", "isoform", "start")) == [("aaa", "A", "NP.1", 10)]
    agp = put(tmp_path, "x.agp", "chr1\t1\t1000\t1\tW\tctg1\t1\t1000\t-\nchr1\t1001\t1100\t2\tN\t100\tgap\t1\t\nchr1\t1101\t1200\t3\tU\t100\tgap\t1\t\n")
    assert rows(readers.read_agp(spark, agp).select("contig", "orient")) == [("ctg1", "-")]
    row = ["f", "c1", "aaa", "bbb", "g1", "n", "NC1", "+", "5", "9", "h1", "n", "NC2", "+", "7", "8"]
    new, old = put(tmp_path, "new.tsv", "\t".join(row) + "\n"), put(tmp_path, "old.tsv", "\t".join(row[1:]) + "\n")
    want = [("aaa", "bbb", "g1", "h1", "NC1", "NC2", 5, 8)]
    cols = ["org_a", "org_b", "gene_a", "gene_b", "chrom_a", "chrom_b", "start_a", "end_b"]
    assert rows(readers.read_anchor_pairs(spark, new).select(cols)) == want == rows(readers.read_anchor_pairs(spark, old, layout=15).select(cols))
    assert rows(readers.read_anchor_pairs(spark, new, first_org="bbb").select(cols))[0][:4] == ("bbb", "aaa", "h1", "g1")
    tree = put(tmp_path, "t.tsv", "#Orgs 2\nc1\tx\t2\taaa\tNC\tg1\tn\tbbb nm(h1), ccc (k1)\n")
    assert [(p["org"], p["gene"]) for p in readers.read_tree_clusters(spark, tree).first()["partners"]] == [("bbb", "h1"), ("ccc", "k1")]
    te = put(tmp_path, "aaa.gff", "NC_1\tx\tLINE\t10\t80\t.\t+\t.\tID=L2-17\nNC_9\tx\tLINE\t1\t2\t.\t+\t.\tID=L2-18\n")
    assert rows(readers.read_te_gff(spark, te, spark.createDataFrame([("NC_1",)], "chrom string")).select("spp", "family", "start")) == [("aaa", "L2", 10)]
    chroms = put(tmp_path, "c.tsv", "x\taaa\tNC_1\t2000000\nx\taaa\tNC_2\t10\n")
    assert rows(readers.read_chromosomes(spark, chroms).select("chrom")) == [("NC_1",)]
    hits = put(tmp_path, "h.tsv", "\t".join(["q", "s", *"123456789", "77.5"]) + "\n")
    assert rows(readers.read_hits(spark, hits).select("query", "score"))[0][0] == "q"
    genes = put(tmp_path, "odb.tsv", "9606:1\t9606\tNP\tX;1\tQ\tE.2\n")
    assert rows(readers.read_odb_genes(spark, genes).select("gene_id", "ensembl")) == [("9606:1", "E.2")]
    with pytest.raises(Exception, match="malformed"):
        readers.read_og2genes(spark, put(tmp_path, "og.tsv", "only\n")).count()
    ref = put(tmp_path, "ref.tsv", "1\tA\thsap\trenamed\n1\tB\thsap\tgeneid\n")
    assert readers.read_ref_groups(spark, ref).count() == 1


def test_lines_keep_file_order(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        p = put(tmp_path, "big.txt", "".join(f"{k}\n" for k in range(3000)))
        got = readers.in_file_order(readers.text_lines(spark, p)).where("nr - 1 <> cast(value as int)").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == 0


def test_lifting(spark):
    agp = spark.createDataFrame([("c", 1, 1000, "x", 1000, "+"), ("c", 1001, 1500, "y", 500, "-")], "chrom string, beg long, end long, contig string, size long, orient string")
    f = spark.createDataFrame([("c", 1, 1000, "+", "whole"), ("c", 1001, 1010, "+", "rev"), ("c", 990, 1010, "+", "cross"), ("c", 1600, 1700, "+", "gap"), ("c", 1491, 1500, "-", "last")], "chrom string, start long, end long, strand string, gene_id string")
    got = {r["gene_id"]: (r["contig"], r["new_start"], r["new_end"], r["new_strand"]) for r in annotation.lift_to_contigs(f, agp, 100).collect()}
    assert got == {"whole": ("x", 1, 1000, "+"), "rev": ("y", 491, 500, "-"), "last": ("y", 1, 10, "+")}
    kids = spark.createDataFrame([("c", 1001, 1005, "+", "rev"), ("c", 990, 995, "+", "cross"), ("c", 1006, 1010, "+", "rev"), ("c", 1, 2, "+", "nobody")], f.schema)
    genes, children, n = annotation.split_by_contigs(f, kids, agp, 100)
    assert sorted(r["gene_id"] for r in genes.collect()) == ["last", "rev", "whole"]
    assert sorted((r["gene_id"], r["new_start"]) for r in children.collect()) == [("rev", 491), ("rev", 496)]
    assert n == {"n_genes": 5, "n_genes_dropped": 2, "n_children": 4, "n_children_dropped": 2}


def test_mixed_annotation_folder(spark, tmp_path):
    good, short, odd = "c\ts\tCDS\t1\t9\t.\t+\t.\tgene_id \"A\";", "c\ts\tCDS\t1\t9", "c\ts\tCDS\tx\t9\t.\t+\t.\tgene_id \"B\";"
    for name, lines in {"aaa.gtf": [good, short], "aaa.gff": [good], "bbb.v2.gff": [odd, "# note"], "notes.txt": [good]}.items():
        put(tmp_path, name, "\n".join(lines) + "\n")
    with gzip.open(tmp_path / "bbb.gff.gz", "wt") as f:
        f.write(good + "\n")
    got = readers.read_annotations(spark, f"file://{tmp_path}")
    assert sorted((r["file"], r["gene_id"] or "", r["bad"]) for r in got.collect()) == [("aaa.gtf", "", True), ("aaa.gtf", "A", False), ("bbb.v2.gff", "B", True)]
    assert readers.read_annotation(spark, f"file://{tmp_path}/aaa.gtf").count() == 1


def test_counters_of_one_pass(spark, tmp_path):
    ref, n = readers.read_ref_groups_counted(spark, put(tmp_path, "ref.tsv", "g\ta\tx\trenamed\ng\tb\tx\tkept\ng\tc\tx\n"))
    assert (ref.count(), n) == (1, {"n_rows": 3, "n_skipped": 2})
    rec = spark.createDataFrame([("x", "p", None, "G", 1, "CDS"), ("x", None, None, "G", 2, "CDS"), ("x", "q", "7", "H", 3, "exon"), ("x", "r", "8", "H", 4, None)], "spp string, protein_id string, numeric_id string, gene string, line_no int, feature string")
    look, n = references.build_lookup_counted(rec)
    assert rows(look) == [("x", "protein_id", "p", "G")] and n == {"n_records": 4, "n_missing": 1, "n_ignored": 2}
    pairs = spark.createDataFrame([("f", "a", "b"), ("f", "a", "c"), ("g", "y", "z"), ("g", "a", "z")], "file string, gene_a string, gene_b string")
    got = synteny.contradiction_counts(pairs, spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "group_id string, gene string"))
    assert {r["file"]: tuple(r)[1:] for r in got.collect()} == {"f": (2, 1, 0, 0, 0), "g": (2, 0, 0, 1, 1), None: (4, 1, 0, 1, 1)}


def test_longest_first_wins_ties(spark):
    s = spark.createDataFrame([("g", "AC", 1), ("g", "ACG", 2), ("g", "TTT", 3)], "gene string, seq string, nr int")
    assert annotation.longest_per_key(s, ["gene"], "seq", "nr").first()["seq"] == "ACG"


def test_parent_fill_splice_and_noncoding(spark, buckets):
    r = spark.createDataFrame([("f", 1, "g1", "gene"), ("f", 2, None, "exon"), ("f", 3, "g2", "gene"), ("f", 4, None, "CDS")], "file string, line_no int, gene_id string, feature string")
    full = annotation.fill_parent(r)
    assert [x["gene_id"] for x in full.orderBy("line_no").collect()] == ["g1", "g1", "g2", "g2"]
    assert rows(annotation.noncoding_genes(full)) == [("g1",)]
    ex = spark.createDataFrame([("t", "c", 5, 6), ("t", "c", 1, 2)], "transcript_id string, chrom string, start long, end long")
    pieces = spark.createDataFrame([("c", 0, "ABC"), ("c", 1, "DEF"), ("c", 2, "G")], "chrom string, chunk long, piece string")
    assert rows(annotation.splice(ex, pieces, 3)) == [("t", "ABEF")]
    ex = spark.createDataFrame([("t", "c", 2, 7), ("u", "c", 3, 4), ("v", "c", 6, 99), ("w", "x", 1, 2)], "transcript_id string, chrom string, start long, end long")
    assert rows(annotation.splice(ex, pieces, 3)) == [("t", "BCDEFG"), ("u", "CD"), ("v", "FG")]


@pytest.fixture
def buckets(spark):
    """Small tables, too, get several range buckets."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("width", [1, 4, 7, 1_000])
def test_genome_in_pieces(spark, tmp_path, width, buckets):
    """Lines shorter and longer than a piece, blank lines, two files, text before the first header."""
    seqs_ = {"c1": "ACGTNacgtn" * 13, "c2": "G", "c4": "TTTTT" * 9}
    (tmp_path / "a.fa").write_text("lost\n>c1 first\n" + "\n".join(seqs_["c1"][k : k + 11] for k in range(0, 130, 11)) + "\n\n>c2\nG\n>c3 empty\n")
    (tmp_path / "b.fa").write_text(">c4\n" + seqs_["c4"] + "\n")
    got = readers.read_genome(spark, str(tmp_path), width).collect()
    assert all(len(r["piece"]) == width or r["chunk"] == len(seqs_[r["chrom"]]) // width for r in got)
    assert {c: "".join(r["piece"] for r in sorted(got, key=lambda r: r["chunk"]) if r["chrom"] == c) for c in {r["chrom"] for r in got}} == seqs_


def test_genome_of_a_split_file(spark, tmp_path, buckets):
    text = "".join(">s%d\n" % k + ("ACGT" * k + "\n") * 20 for k in range(1, 40))
    (tmp_path / "g.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.read_genome(spark, str(tmp_path / "g.fa"), 500).groupBy("chrom").agg(F.sum(F.length("piece")).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["chrom"]: r["n"] for r in got} == {f"s{k}": 80 * k for k in range(1, 40)}


def test_running_values_over_buckets(spark, buckets):
    """One hot group over many buckets, a null group, ties and nulls."""
    rnd = random.Random(4)
    data = [(("hot" if k % 3 else rnd.choice(["a", None])), rnd.randrange(300), k, rnd.choice([None, k])) for k in range(900)]
    df = spark.createDataFrame(data, "g string, x int, id int, v int").repartition(5)
    want_n, want_v, want_s = {}, {}, {}
    for g in {d[0] for d in data}:
        last, total = None, 0
        for n, (_, x, i, v) in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: d[1:3]), 1):
            last = v if v is not None else last
            want_n[i], want_v[i], want_s[i], total = n, last, total, total + x
    assert {r["id"]: r["n"] for r in ranges.numbered(df, ["g"], ["x", "id"], "n").collect()} == want_n
    rows_ = ranges.bucketed(df, ["g"], ["x", "id"])
    assert rows_.where("g = 'hot'").select("bucket").distinct().count() > 1
    assert {r["id"]: r["last"] for r in ranges.carried(rows_, ["g"], ["x", "id"], F.col("v"), "last").collect()} == want_v
    assert {r["id"]: r["s"] for r in ranges.summed(rows_, ["g"], ["x", "id"], F.col("x").cast("long"), "s").collect()} == want_s
    assert ranges.numbered(df.limit(0), ["g"], ["x", "id"], "n").count() == 0


def test_parents_at_any_depth(spark):
    chain = [("g1", None, None, "gene"), *((f"c{k}", f"c{k - 1}" if k else "g1", None, "part") for k in range(5)), (None, "c4", None, "exon"), (None, "c4", "own", "exon")]
    deep = [("g2.3", None, "G2", "gene"), *((f"d{k}", f"d{k - 1}" if k else "g2.1", None, "part") for k in range(40)), (None, "d39", None, "exon"), (None, "g2.9", None, "exon")]
    odd = [("x", "y", None, "part"), ("y", "x", None, "part"), (None, "y", None, "exon"), (None, None, None, "exon"), (None, "nobody", None, "exon"), ("top", None, None, "part"), (None, "top", None, "exon")]
    odd += [("h", None, "unassigned_gene_1", "gene"), (None, "h", None, "exon"), ("mid", "c4", "G9", "part"), ("low", "mid", None, "part")]
    got = annotation.attach_parent(spark.createDataFrame(chain + deep + odd, "id string, parent string, gene_id string, feature string")).collect()
    by_id = {r["id"]: r["gene_id"] for r in got if r["id"]}
    assert all(by_id[f"c{k}"] == "g1" for k in range(5)) and all(by_id[f"d{k}"] == "G2" for k in range(40))
    assert (by_id["x"], by_id["y"], by_id["top"], by_id["mid"], by_id["low"]) == (None, None, None, "G9", "G9") and "h" not in by_id
    exons = sorted(((r["parent"] or "", r["gene_id"] or "") for r in got if r["id"] is None))
    assert exons == [("", ""), ("c4", "g1"), ("c4", "own"), ("d39", "G2"), ("g2.9", "G2"), ("nobody", ""), ("top", ""), ("y", "")]


def test_elements_meet_by_rank(spark):
    a = spark.createDataFrame([(f"a{k}", "n", 1, "f", k) for k in range(3)] + [("lone", "n", 1, "g", 1)], "te string, anchor string, order int, family string, start int")
    b = spark.createDataFrame([(f"b{k}", "n", 1, "f", k) for k in range(5)], "te string, anchor string, order int, family string, start int")
    pairs = lambda x, y: sorted((r["te_a"], r["te_b"]) for r in synteny.te_ortholog_pairs(x, y).collect())
    assert pairs(a, b) == [("a0", "b0"), ("a1", "b1"), ("a2", "b2"), ("a2", "b3"), ("a2", "b4")]
    assert pairs(b, a) == [("b0", "a0"), ("b1", "a1"), ("b2", "a2"), ("b3", "a2"), ("b4", "a2")]


def test_recode_steps(spark):
    g = spark.createDataFrame([("1", x) for x in ("m1", "k1", "e1", "m2.1", "k2.1", "e2.1", "none")], "group_id string, raw string")
    m = spark.createDataFrame([("m1", "M1"), ("m2", "M2")], "isoform string, gene string")
    k = spark.createDataFrame([("k1",), ("k2",)], "gene string")
    e = spark.createDataFrame([("e1", "E1"), ("e2", "E2")], "isoform string, gene string")
    got = {r["raw"]: (r["gene"], r["step"]) for r in references.recode(g, m, k, e).collect()}
    assert got == {"m1": ("M1", 1), "k1": ("k1", 2), "e1": ("E1", 3), "m2.1": ("M2", 4), "k2.1": ("k2", 5), "e2.1": ("E2", 6), "none": ("none", 0)}
    low = references.apply_low_certainty(spark.createDataFrame([("g", "m1"), ("g", "zz")], "group_id string, protein string"), m)
    assert rows(low) == [("g", "M1"), ("g", "zz")]


def test_rename_rejects_uneven_lists(spark):
    ref = spark.createDataFrame([(1, "g", "a", "x,y", "geneid")], "row_id int, group_id string, spp string, gene string, source string")
    look = spark.createDataFrame([], "spp string, kind string, id string, gene string")
    with pytest.raises(Exception, match="differ in number"):
        references.rename(ref, look).count()


def test_one_anchor_pair_is_forward(spark):
    p = spark.createDataFrame([("x", "y", 1, 5)], "chrom_a string, chrom_b string, start_a long, start_b long")
    assert rows(synteny.orientation(p)) == [("x", "y", 1, None, False)]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.tsv", "og1\tt1:g1\nog2\tt1:g2\n")
    put(tmp_path / "in", "b.tsv", "og1\tt2:g3\n")
    og, taxa = spark.createDataFrame([("og1",)], "og_id string"), spark.createDataFrame([("t1",)], "taxon string")
    q = filters.write_available(filters.stream_og2genes(spark, f"file://{tmp_path}/in", og, taxa), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    assert rows(spark.read.parquet(f"file://{tmp_path}/out").select("og_id", "gene_id")) == [("og1", "t1:g1")]


def test_writers(spark, tmp_path):
    g = spark.createDataFrame([("1", "a", "x"), ("1", "b", "y"), ("2", "a", "z")], "group_id string, spp string, gene string")
    assert rows(writers.groups_wide(g, ["a", "b"])) == [("1", "x", "y"), ("2", "z", "")] or writers.groups_wide(g, ["a", "b"]).count() == 2
    assert rows(writers.group_lines(g)) == [("1: x, y",), ("2: z",)]
    writers.write_report(g, f"file://{tmp_path}/r")
    assert spark.read.csv(f"file://{tmp_path}/r", sep="\t", header=True).count() == 3
