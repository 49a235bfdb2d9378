"""Round trips of the readers: the driver's tables are written in a reader's layout to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ortholens.plans.views import pred, table, with_views
from ortholens.sources import readers, writers
from ortholens.sources.shared import shared_path


def _written(s, d, source: str, places: dict[int, str]) -> str:
    """Path of a tab-separated file with the expressions of `places` in their columns, others empty."""
    cells = [F.coalesce(F.expr(f"cast({places[k]} as string)"), F.lit("")) if k in places else F.lit("") for k in range(max(places) + 1)]
    path = shared_path(s, "layout")
    table(s, d, source).select(F.concat_ws("\t", *cells).alias("value")).write.text(path)
    return path


def groups_long_file(s, d):
    at = {0: "o_custkey", 1: "'gene'", 2: "o_custkey % 9", 3: "5", 4: "concat(o_orderpriority, '.faa')", 5: "o_orderkey", 6: "concat('n', o_custkey % 50)", 7: "o_orderstatus", 8: "0", 9: "concat('chr', o_custkey % 20)", 10: "o_orderkey % 1000", 11: "o_orderkey % 1000 + 5"}
    r = readers.read_groups_long(s, _written(s, d, "orders", at), drop_states=("F",))
    return r.select("group_id", "spp", "gene", "name", "copy_state", "chrom", "element_count", "start_bp", "end_bp")


def group_table_file(s, d):
    path = shared_path(s, "group-table")
    writers.write_groups_wide(pred(s, d), path, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    o = table(s, d, "orders").where("o_orderkey % 3 <> 0")
    id_map = o.select(F.col("o_orderpriority").alias("spp"), F.col("o_orderkey").cast("string").alias("isoform"), F.expr("concat('G', o_orderkey div 2)").alias("gene"))
    return readers.read_group_table(s, path, 1, id_map, "drop")


def group_lines_file(s, d):
    member = F.expr("concat(replace(o_orderpriority, ' ', '_'), '|', o_orderkey)")
    path = shared_path(s, "group-lines")
    table(s, d, "orders").groupBy("o_custkey").agg(F.concat_ws(" ", F.collect_list(member)).alias("m")).select(F.concat_ws(": ", F.col("o_custkey").cast("string"), "m").alias("value")).write.text(path)
    return readers.read_group_lines(s, path)


def odb_genes_file(s, d):
    at = {0: "p_partkey", 1: "p_brand", 2: "CASE WHEN p_partkey % 3 = 0 THEN concat('NP_', p_partkey) END", 3: "p_name", 4: "p_type", 5: "concat('c', p_size)"}
    return readers.read_odb_genes(s, _written(s, d, "part", at)).drop("file")


def og2genes_file(s, d):
    return readers.read_og2genes(s, _written(s, d, "lineitem", {0: "l_orderkey", 1: "l_partkey"}))


def ogs_file(s, d):
    return readers.read_ogs(s, _written(s, d, "orders", {0: "o_orderkey", 1: "o_custkey % 7", 2: "concat('n', o_custkey % 50)"}))


def ref_groups_file(s, d):
    at = {0: "o_custkey", 1: "o_orderkey", 2: "lower(o_orderpriority)", 3: "CASE WHEN o_orderstatus = 'F' THEN 'renamed' ELSE 'kept' END"}
    return readers.read_ref_groups(s, _written(s, d, "orders", at))


def ref_groups_counts(s, d):
    """Rows of a curated table and those skipped as not renamed, from the pass that reads it."""
    at = {0: "o_custkey", 1: "o_orderkey", 2: "lower(o_orderpriority)", 3: "CASE WHEN o_orderstatus = 'F' THEN 'renamed' ELSE 'kept' END"}
    _, n = readers.read_ref_groups_counted(s, _written(s, d, "orders", at))
    return s.createDataFrame([n], "n_rows long, n_skipped long")


def annotations_folder(s, d):
    """One species in GTF and in GFF, of which GFF is not read, one in GFF only; every ninth record lacks its attributes."""
    path = shared_path(s, "annotations")
    line = table(s, d, "lineitem")
    fixed = [F.concat(F.lit("c"), F.col("l_suppkey").cast("string")), F.lit("src"), F.when(F.col("l_linenumber") == 1, "gene").otherwise("CDS"), F.col("l_partkey").cast("string"), (F.col("l_partkey") + 9).cast("string"), F.lit("."), F.lit("+"), F.lit(".")]
    gtf, gff = F.format_string('gene_id "g%d"; protein_id "p%d";', "l_orderkey", "l_partkey"), F.format_string("ID=g%d;protein_id=p%d", "l_orderkey", "l_partkey")
    for name, attributes, where in (("aaa.gtf", gtf, "l_returnflag = 'A'"), ("aaa.gff", gff, "l_returnflag <> 'A'"), ("bbb.gff", gff, "l_returnflag <> 'A'")):
        own = F.when(F.col("l_orderkey") % 9 == 0, F.concat_ws("\t", *fixed)).otherwise(F.concat_ws("\t", *fixed, attributes))
        writers.write_named(line.where(where).select(own.alias("value")), path, name)
    r = readers.read_annotations(s, path)
    return r.groupBy("spp", "feature", "bad", "gene_id").agg(F.count(F.lit(1)).alias("n"))


def pair_tables(s, d):
    """All lines as rows of three pair tables, named by their flags: an order on one side, its part and supplier on the other."""
    path = shared_path(s, "pairs")
    line = table(s, d, "lineitem")
    cells = F.concat_ws("\t", F.format_string("r%d.%d.%d", "l_orderkey", "l_linenumber", "l_partkey"), F.lit("9"), F.format_string("o%d 1.0", "l_orderkey"), F.format_string("p%d 1.0 s%d 0.5", "l_partkey", "l_suppkey"))
    for flag in "ANR":
        writers.write_named(line.where(F.col("l_returnflag") == flag).select(cells.alias("value")), path, f"table.o.faa-{flag}.faa")
    return readers.read_pair_tables(s, path).distinct()


def group_dir(s, d):
    """Parts as genes, one file a manufacturer's brand."""
    path = shared_path(s, "group-dir")
    part = table(s, d, "part")
    for k in range(1, 6):
        own = part.where(F.col("p_brand").startswith(f"Brand#{k}")).select(F.col("p_partkey").cast("string").alias("value"))
        writers.write_named(own.coalesce(1), path, f"og{k}.txt")
    return readers.read_group_dir(s, path, "og")


def agp_file(s, d):
    at = {0: "l_suppkey", 1: "l_partkey", 2: "l_partkey + 99", 3: "l_linenumber", 4: "CASE WHEN l_returnflag = 'A' THEN 'N' ELSE 'W' END", 5: "l_orderkey", 6: "1", 7: "100", 8: "CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END"}
    return readers.read_agp(s, _written(s, d, "lineitem", at))


def anchor_pairs_file(s, d):
    at = {1: "l_orderkey", 2: "l_returnflag", 3: "l_linestatus", 4: "l_partkey", 6: "l_suppkey", 8: "l_linenumber", 9: "l_linenumber + 10", 10: "l_partkey + 1", 12: "l_suppkey + 1", 14: "l_linenumber + 2", 15: "l_linenumber + 12"}
    return readers.read_anchor_pairs(s, _written(s, d, "lineitem", at), first_org="O").drop("file")


def segdups_file(s, d):
    at = {0: "l_orderkey", 1: "l_linenumber", 2: "l_returnflag", 3: "l_partkey", 4: "concat('m', l_suppkey % 4)", 5: "l_suppkey", 7: "l_linenumber * 3", 8: "l_linenumber * 5", 9: "l_partkey + 7", 15: "l_linestatus", 16: "l_suppkey + 7"}
    return readers.read_segdups(s, _written(s, d, "lineitem", at)).drop("file")


def chromosomes_file(s, d):
    return readers.read_chromosomes(s, _written(s, d, "part", {1: "p_brand", 2: "p_partkey", 3: "p_size * 100000"}))


def tree_clusters_file(s, d):
    at = {0: "l_orderkey", 2: "l_linenumber", 3: "l_returnflag", 4: "l_suppkey", 5: "l_partkey", 6: "concat('m', l_suppkey % 4)", 7: "concat('a x(', l_partkey + 1, '), b y(', l_suppkey + 1, ')')"}
    r = readers.read_tree_clusters(s, _written(s, d, "lineitem", at))
    return r.select("cluster_id", "org_count", "org", "chrom", "gene", "name", F.explode_outer("partners").alias("p")).select("*", F.col("p.org").alias("mate_org"), F.col("p.gene").alias("mate_gene")).drop("p")


def homologs_file(s, d):
    at = {2: "l_returnflag", 3: "l_linestatus", 4: "l_orderkey", 5: "concat('m', l_suppkey % 4)", 9: "l_partkey", 10: "concat('i', l_suppkey % 3)"}
    return readers.read_homologs(s, _written(s, d, "lineitem", at)).drop("file")


def hits_file(s, d):
    at = {0: "l_orderkey", 1: "l_partkey", 11: "l_linenumber * 10"}
    return readers.read_hits(s, _written(s, d, "lineitem", at)).select("query", "subject", "score")


def rbh_file(s, d):
    at = {0: "l_returnflag", 1: "l_orderkey", 2: "l_linenumber", 3: "l_linestatus", 4: "l_partkey", 5: "l_linenumber + 4", 6: "l_suppkey"}
    return readers.read_rbh(s, _written(s, d, "lineitem", at))


def id_map_file(s, d):
    """The species of an id map is its file's name, which Spark chooses here; so it is left out."""
    return readers.read_id_map(s, _written(s, d, "orders", {0: "o_custkey", 1: "o_orderkey"})).drop("spp")


def list_file(s, d):
    return readers.read_list(s, _written(s, d, "orders", {0: "concat(' ', o_orderkey, ' ')"}))


def rename_map_file(s, d):
    return readers.read_rename_map(s, _written(s, d, "part", {0: "p_partkey", 1: "p_brand"}))


def te_gff_file(s, d):
    at = {0: "l_suppkey", 2: "concat('m', l_suppkey % 4)", 3: "l_linenumber", 4: "l_linenumber + 50", 6: "'+'", 8: "concat('ID=T', l_partkey % 5, '-', l_orderkey, ';x=1')"}
    chroms = table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("chrom"))
    return readers.read_te_gff(s, _written(s, d, "lineitem", at), chroms).select("chrom", "subfamily", "start", "end", "strand")


def duplicates_file(s, d):
    return readers.read_duplicates(s, _written(s, d, "lineitem", {1: "l_returnflag", 5: "l_partkey"}))


def report_file(s, d):
    path = shared_path(s, "report")
    writers.write_report(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return s.read.csv(path, sep="\t", header=True, schema="n_nationkey long, n_name string, n_regionkey long")


QUERIES = {
    f.__name__: f
    for f in (
        groups_long_file, group_table_file, group_lines_file, odb_genes_file, og2genes_file, ogs_file, ref_groups_file, ref_groups_counts, annotations_folder, pair_tables, group_dir, agp_file, anchor_pairs_file, segdups_file,
        chromosomes_file, tree_clusters_file, homologs_file, hits_file, rbh_file, id_map_file, list_file, rename_map_file, te_gff_file, duplicates_file, report_file,
    )
}

ORACLES = {
    "groups_long_file": """SELECT o_custkey::VARCHAR AS group_id, lower(o_orderpriority) AS spp, o_orderkey::VARCHAR AS gene, concat('n', o_custkey % 50) AS name, o_orderstatus AS copy_state,
  'chr' || (o_custkey % 20) AS chrom, (o_custkey % 9)::BIGINT AS element_count, (o_orderkey % 1000)::BIGINT AS start_bp, (o_orderkey % 1000 + 5)::BIGINT AS end_bp FROM orders WHERE o_orderstatus <> 'F'""",
    "group_table_file": with_views("pred") + " SELECT DISTINCT group_id::VARCHAR AS group_id, spp, 'G' || (gene // 2) AS gene FROM pred WHERE gene % 3 <> 0",
    "group_lines_file": "SELECT o_custkey::VARCHAR AS group_id, replace(o_orderpriority, ' ', '_') AS spp, o_orderkey::VARCHAR AS gene FROM orders",
    "odb_genes_file": """SELECT p_partkey::VARCHAR AS gene_id, p_brand AS taxon, CASE WHEN p_partkey % 3 = 0 THEN 'NP_' || p_partkey END AS protein_id, p_name AS synonyms,
  p_type AS uniprot, concat('c', p_size) AS ensembl FROM part""",
    "og2genes_file": "SELECT l_orderkey::VARCHAR AS og_id, l_partkey::VARCHAR AS gene_id FROM lineitem",
    "ogs_file": "SELECT o_orderkey::VARCHAR AS og_id, (o_custkey % 7)::VARCHAR AS level_id, concat('n', o_custkey % 50) AS name FROM orders",
    "pair_tables": """SELECT DISTINCT 'o' AS spp_a, l_returnflag AS spp_b, 'r' || l_orderkey || '.' || l_linenumber || '.' || l_partkey AS row_id, x.spp, x.gene FROM lineitem,
 LATERAL (SELECT unnest([{'spp': 'o', 'gene': 'o' || l_orderkey}, {'spp': l_returnflag, 'gene': 'p' || l_partkey}, {'spp': l_returnflag, 'gene': 's' || l_suppkey}]) AS x)""",
    "group_dir": "SELECT substr(p_brand, 7, 1) AS group_id, p_partkey::VARCHAR AS gene FROM part WHERE substr(p_brand, 7, 1) BETWEEN '1' AND '5'",
    "ref_groups_counts": "SELECT count(*) AS n_rows, count(*) FILTER (o_orderstatus <> 'F') AS n_skipped FROM orders",
    "annotations_folder": """SELECT CASE WHEN l_returnflag = 'A' THEN 'aaa' ELSE 'bbb' END AS spp, CASE WHEN l_linenumber = 1 THEN 'gene' ELSE 'CDS' END AS feature, l_orderkey % 9 = 0 AS bad,
CASE WHEN l_orderkey % 9 <> 0 THEN 'g' || l_orderkey END AS gene_id, count(*) AS n FROM lineitem GROUP BY ALL""",
    "ref_groups_file": "SELECT o_custkey::VARCHAR AS group_id, o_orderkey::VARCHAR AS gene, lower(o_orderpriority) AS spp, 'renamed' AS source FROM orders WHERE o_orderstatus = 'F'",
    "agp_file": """SELECT l_suppkey::VARCHAR AS chrom, l_partkey::BIGINT AS beg, (l_partkey + 99)::BIGINT AS "end", 'W' AS comp_type, l_orderkey::VARCHAR AS contig, 100::BIGINT AS size,
  CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS orient FROM lineitem WHERE l_returnflag <> 'A'""",
    "anchor_pairs_file": """WITH x AS (SELECT *, l_linestatus = 'O' AS t FROM lineitem)
SELECT l_orderkey::VARCHAR AS cluster_id, CASE WHEN t THEN l_linestatus ELSE l_returnflag END AS org_a, CASE WHEN t THEN l_returnflag ELSE l_linestatus END AS org_b,
  (l_partkey + t::INT)::VARCHAR AS gene_a, (l_partkey + 1 - t::INT)::VARCHAR AS gene_b, (l_suppkey + t::INT)::VARCHAR AS chrom_a, (l_suppkey + 1 - t::INT)::VARCHAR AS chrom_b,
  (l_linenumber + 2 * t::INT)::BIGINT AS start_a, (l_linenumber + 10 + 2 * t::INT)::BIGINT AS end_a,
  (l_linenumber + 2 - 2 * t::INT)::BIGINT AS start_b, (l_linenumber + 12 - 2 * t::INT)::BIGINT AS end_b FROM x""",
    "segdups_file": """SELECT l_orderkey::VARCHAR AS block_id, l_linenumber::BIGINT AS size, l_returnflag AS spp, l_partkey::VARCHAR AS dup_id, concat('m', l_suppkey % 4) AS name, l_suppkey::VARCHAR AS chrom,
  (l_linenumber * 3)::BIGINT AS start, (l_linenumber * 5)::BIGINT AS "end", (l_partkey + 7)::VARCHAR AS gene_id, l_linestatus AS spp_b, (l_suppkey + 7)::VARCHAR AS gene_b FROM lineitem""",
    "chromosomes_file": "SELECT p_brand AS spp, p_partkey::VARCHAR AS chrom, (p_size * 100000)::BIGINT AS length FROM part WHERE p_size >= 10",
    "tree_clusters_file": """SELECT l_orderkey::VARCHAR AS cluster_id, l_linenumber::INT AS org_count, l_returnflag AS org, l_suppkey::VARCHAR AS chrom, l_partkey::VARCHAR AS gene, concat('m', l_suppkey % 4) AS name,
  m.o AS mate_org, CASE WHEN m.o = 'a' THEN l_partkey + 1 ELSE l_suppkey + 1 END::VARCHAR AS mate_gene FROM lineitem, (VALUES ('a'), ('b')) m(o)""",
    "homologs_file": "SELECT l_returnflag AS org_a, l_linestatus AS org_b, l_orderkey::VARCHAR AS id_a, concat('m', l_suppkey % 4) AS name_a, l_partkey::VARCHAR AS id_b, concat('i', l_suppkey % 3) AS name_b FROM lineitem",
    "hits_file": "SELECT l_orderkey::VARCHAR AS query, l_partkey::VARCHAR AS subject, (l_linenumber * 10)::DOUBLE AS score FROM lineitem",
    "rbh_file": """SELECT l_returnflag AS spp1, l_orderkey::VARCHAR AS gene1, l_linenumber::INT AS len1, l_linestatus AS spp2, l_partkey::VARCHAR AS gene2, (l_linenumber + 4)::INT AS len2,
  l_suppkey::DOUBLE AS bitscore FROM lineitem""",
    "id_map_file": "SELECT o_custkey::VARCHAR AS gene, o_orderkey::VARCHAR AS isoform FROM orders",
    "list_file": "SELECT o_orderkey::VARCHAR AS id FROM orders",
    "rename_map_file": "SELECT p_partkey::VARCHAR AS taxon, p_brand AS spp FROM part",
    "te_gff_file": """SELECT l_suppkey::VARCHAR AS chrom, concat('m', l_suppkey % 4) AS subfamily, l_linenumber::BIGINT AS start, (l_linenumber + 50)::BIGINT AS "end", '+' AS strand FROM lineitem WHERE l_suppkey % 2 = 0""",
    "duplicates_file": "SELECT l_returnflag AS spp, l_partkey::VARCHAR AS gene FROM lineitem",
    "report_file": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation",
}
