"""Queries on groupings: overlap, labels, reasons, benchmarks, consensus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ortholens.operators import bench, compare, consensus, groups
from ortholens.operators.annotation import gene_index
from ortholens.plans.views import genes, lines, multi, pred, ref, table, third, with_views


def pos(s, d):
    return gene_index(genes(s, d))


def _edges(s, d):
    """Orders beside the batches (part, supplier, quantity) of all their lines."""
    batch = F.concat_ws(".", F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    return table(s, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), batch.alias("b"))


def _ortholog_pairs(s, d):
    """All lines as pairs of an order and a batch of its return flag, and batches beside the next larger one of their kind."""
    kind = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_suppkey").cast("string"), F.lit("."))
    line = table(s, d, "lineitem").select(F.lit("O").alias("spp_a"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("gene_a"), F.col("l_returnflag").alias("spp_b"), kind.alias("kind"), F.col("l_quantity").cast("int").alias("q"))
    batch = line.select("spp_b", "kind", "q").distinct()
    after = F.lead("q").over(Window.partitionBy("spp_b", "kind").orderBy("q"))
    own = batch.withColumn("after", after).where("after is not null")
    at = lambda q: F.concat("kind", F.col(q).cast("string"))
    beside = own.select(F.col("spp_b").alias("spp_a"), at("q").alias("gene_a"), "spp_b", at("after").alias("gene_b"))
    return line.select("spp_a", "gene_a", "spp_b", at("q").alias("gene_b")).unionByName(beside)


def _uncertain(s, d):
    return ref(s, d).where("gene % 19 = 0")


def _pair_rows(s, d):
    """Reference groups seen as rows of species-pair tables."""
    r = ref(s, d).select("group_id", "spp", "gene")
    pairs = r.select("group_id", F.col("spp").alias("s")).distinct()
    x = pairs.select("group_id", F.col("s").alias("spp_a")).join(pairs.select("group_id", F.col("s").alias("spp_b")), "group_id").where("spp_a < spp_b")
    return x.join(r, "group_id").where("spp = spp_a or spp = spp_b").select("spp_a", "spp_b", F.col("group_id").alias("row_id"), "spp", "gene")


def _states(s, d):
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("org")).agg(F.min("o_orderstatus").alias("state"), F.count(F.lit(1)).alias("count"))

def _copies(s, d):
    """Orders with few distinct members, of one or two kinds: many have the same set."""
    g = F.col("gene") % 40
    return lines(s, d).select("group_id", F.when(g < 20, "x").otherwise("y").alias("spp"), g.alias("gene"))


def _symbols(s, d):
    """A placeholder for every third order, else the month of its date."""
    o = table(s, d, "orders")
    symbol = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("LOC"), F.expr("cast(o_orderkey % 7 as string)"))).otherwise(F.concat(F.lit("m"), F.month("o_orderdate").cast("string")))
    return o.select(F.col("o_orderpriority").alias("spp"), F.col("o_orderkey").alias("gene"), symbol.alias("symbol"))


def _evidence(s, d):
    return bench.paralog_evidence(pred(s, d), ref(s, d), _symbols(s, d))


QUERIES = {
    "pair_benchmark": lambda s, d: bench.pair_benchmark(pred(s, d), ref(s, d)),
    "pair_benchmark_rescue": lambda s, d: bench.pair_benchmark(pred(s, d), ref(s, d), rescue=True),
    "misplaced_genes": lambda s, d: bench.misplaced_genes(pred(s, d), ref(s, d)),
    "paralog_pairs": lambda s, d: bench.paralog_pairs(pred(s, d), ref(s, d)),
    "top_paralog_groups": lambda s, d: bench.top_paralog_groups(pred(s, d), ref(s, d)),
    "paralog_evidence": _evidence,
    "paralog_summary": lambda s, d: bench.paralog_summary(_evidence(s, d)),
    "refog_total": lambda s, d: bench.refog_total(bench.refog_scores(ref(s, d), _uncertain(s, d), pred(s, d))).select(*(F.round(c, 4).alias(c) for c in ("precision", "recall", "f1"))),
    "filter_groups": lambda s, d: groups.filter_groups(pred(s, d), [1, 2, 3, 100]),
    "refog_scores": lambda s, d: bench.refog_scores(ref(s, d), _uncertain(s, d), pred(s, d)),
    "validate_groups": lambda s, d: bench.validate_groups(multi(s, d), genes(s, d)),
    "classify_reference": lambda s, d: compare.classify_reference(ref(s, d), pred(s, d)),
    "classify_other": lambda s, d: compare.classify_other(multi(s, d), pred(s, d)),
    "classify_consensus": lambda s, d: compare.classify_consensus(pred(s, d), consensus.merge_methods(pred(s, d), ref(s, d), third(s, d))),
    "class_counts_rollup": lambda s, d: compare.class_counts(compare.classify_reference(ref(s, d), pred(s, d)).withColumn("split", F.col("n_pred") > 1), "label", "split"),
    "group_overlap": lambda s, d: groups.overlap(ref(s, d), pred(s, d)),
    "size_distribution": lambda s, d: groups.size_distribution(lines(s, d), log=True),
    "species_counts": lambda s, d: groups.species_counts(lines(s, d)),
    "group_profile": lambda s, d: groups.profile(lines(s, d)),
    "isoform_reduction": lambda s, d: groups.isoform_reduction(lines(s, d).withColumn("gene", F.expr("gene div 50")), 5),
    "multigrouped": lambda s, d: groups.multigrouped(lines(s, d)),
    "paralog_genes": lambda s, d: groups.paralog_genes(ref(s, d)),
    "coverage_rollup": lambda s, d: groups.coverage(genes(s, d), pred(s, d), multi(s, d)),
    "gene_overlap_summary": lambda s, d: groups.gene_overlap_summary(pred(s, d), ref(s, d)),
    "duplicate_groups": lambda s, d: groups.duplicate_groups(lines(s, d).withColumn("gene", F.expr("gene % 40")).withColumn("spp", F.lit("x"))),
    "duplicate_classes": lambda s, d: groups.duplicate_classes(_copies(s, d)),
    "duplicate_counts": lambda s, d: groups.duplicate_counts(_copies(s, d)),
    "missing_members": lambda s, d: groups.missing_in(pred(s, d), ref(s, d)),
    "missing_counts": lambda s, d: groups.missing_counts(ref(s, d), pred(s, d)),
    "repeated_members": lambda s, d: groups.repeated_members(lines(s, d)),
    "top_repeated": lambda s, d: groups.top_repeated(lines(s, d)),
    "seeded_sample": lambda s, d: groups.seeded_sample(pred(s, d), "gene"),
    "pattern_by_state": lambda s, d: groups.pattern_by_state(_states(s, d), {"1-URGENT": ("F", "O"), "2-HIGH": ("O",), "3-MEDIUM": ("F", "P"), "4-NOT SPECIFIED": ("F", "O", "P"), "5-LOW": ("F", "O")}, ("1-URGENT", "2-HIGH")),
    "gene_index": lambda s, d: pos(s, d),
    "nearest_member_reason": lambda s, d: compare.missing_reasons(ref(s, d), pred(s, d), pos(s, d)),
    "multi_grouped_reason": lambda s, d: compare.missing_reasons(multi(s, d), pred(s, d), pos(s, d)),
    "split_reasons": lambda s, d: compare.split_reasons(ref(s, d), pred(s, d), pos(s, d), 20),
    "missing_cause": lambda s, d: compare.missing_cause(ref(s, d), pred(s, d), pos(s, d), 20),
    "paralog_species": lambda s, d: bench.paralog_species(_evidence(s, d)),
    "superset_detail": lambda s, d: compare.superset_detail(ref(s, d), pred(s, d), pos(s, d)),
    "subset_detail": lambda s, d: compare.subset_detail(multi(s, d), pred(s, d)),
    "conflict_detail": lambda s, d: compare.conflict_detail(ref(s, d), pred(s, d), pos(s, d)),
    "split_cause": lambda s, d: compare.split_cause(ref(s, d), pos(s, d), 20),
    "two_method_report": lambda s, d: compare.two_method_report(pred(s, d), ref(s, d)),
    "two_method_reasons": lambda s, d: compare.two_method_reasons(pred(s, d), ref(s, d), pos(s, d)),
    "pairwise_tables": lambda s, d: compare.pairwise_tables(_pair_rows(s, d), pred(s, d)),
    "consensus_groups": lambda s, d: consensus.merge_methods(pred(s, d), ref(s, d), third(s, d)),
    "components": lambda s, d: consensus.components(_edges(s, d)),
    "contradictory_pairs": lambda s, d: consensus.contradictory(_edges(s, d)),
    "merged_pairs": lambda s, d: consensus.merge_pairs(_ortholog_pairs(s, d))[0],
    "open_contradictions": lambda s, d: consensus.merge_pairs(_ortholog_pairs(s, d))[1],
    "group_consistency": lambda s, d: compare.group_consistency(pred(s, d), third(s, d)),
}

_SIZES = "SELECT group_id, count(*) AS n_genes FROM (SELECT DISTINCT * FROM {}) GROUP BY group_id"

_PAIR = (
    with_views("pred", "ref")
    + """,
kept AS (SELECT * FROM ref WHERE group_id IN (SELECT group_id FROM ref GROUP BY group_id HAVING count(DISTINCT spp) > 1)),
m AS (SELECT p.group_id AS pred, p.spp, p.gene, k.group_id AS ref FROM pred p LEFT JOIN kept k USING (spp, gene)),
n AS (SELECT pred, ref, count(*) AS n, min(gene) AS g FROM m WHERE ref IS NOT NULL GROUP BY pred, ref),
mg AS (SELECT pred, ref AS main, n / (sum(n) OVER (PARTITION BY pred))::DOUBLE > 0.9 AS sub,
              row_number() OVER (PARTITION BY pred ORDER BY n DESC, g) AS k FROM n QUALIFY k = 1),
pp AS (SELECT a.spp AS spp_a, b.spp AS spp_b, a.ref AS x, b.ref AS y, mg.main, mg.sub
       FROM m a JOIN m b ON a.pred = b.pred AND a.spp < b.spp LEFT JOIN mg ON mg.pred = a.pred),
f AS (SELECT spp_a, spp_b,
        count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND (x = y OR (sub AND (main = x OR main = y)))) AS tp,
        count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND NOT (x = y OR (sub AND (main = x OR main = y)))) AS fp,
        count(*) FILTER (x IS NULL OR y IS NULL) AS skipped_pred FROM pp GROUP BY ALL),
rm AS (SELECT k.group_id AS ref, k.spp, k.gene, p.group_id AS pred FROM kept k LEFT JOIN pred p USING (spp, gene)),
rp AS (SELECT a.spp AS spp_a, b.spp AS spp_b, a.pred AS x, b.pred AS y,
              coalesce(ma.sub AND mb.sub AND ma.main = a.ref AND mb.main = a.ref, false) AS saved
       FROM rm a JOIN rm b ON a.ref = b.ref AND a.spp < b.spp LEFT JOIN mg ma ON ma.pred = a.pred LEFT JOIN mg mb ON mb.pred = b.pred),
l AS (SELECT spp_a, spp_b, count(*) FILTER (x IS NULL OR y IS NULL OR (x <> y AND NOT ({saved}))) AS fn,
             count(*) FILTER (x IS NULL OR y IS NULL) AS skipped_ref, count(*) FILTER (x <> y AND {saved}) AS rescued FROM rp GROUP BY ALL)
SELECT spp_a, spp_b, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(skipped_pred, 0) AS skipped_pred,
       coalesce(skipped_ref, 0) AS skipped_ref, coalesce(rescued, 0) AS rescued,
       round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1
FROM f FULL JOIN l USING (spp_a, spp_b)
"""
)

#: Labels of other-groups, for any two memberships named o and p.
_OTHER = """
os AS (SELECT group_id, count(*) AS n_genes, count(DISTINCT spp) AS n_spp FROM (SELECT DISTINCT * FROM o) GROUP BY group_id),
ps AS (SELECT group_id, count(*) AS n FROM (SELECT DISTINCT * FROM p) GROUP BY group_id),
om AS (SELECT spp, gene FROM o GROUP BY spp, gene HAVING count(DISTINCT group_id) > 1),
tc AS (SELECT o.group_id, p.group_id AS pg, count(*) AS c FROM (SELECT DISTINCT * FROM o) o JOIN (SELECT DISTINCT * FROM p) p USING (spp, gene) GROUP BY ALL),
h AS (SELECT tc.group_id, count(*) AS n_pred, sum(c)::BIGINT AS n_shared, sum(n)::BIGINT AS n_union FROM tc JOIN ps ON ps.group_id = tc.pg GROUP BY tc.group_id),
mu AS (SELECT group_id, count(*) AS n_multi, count(*) FILTER (NOT EXISTS (SELECT 1 FROM p WHERE p.spp = o.spp AND p.gene = o.gene)) AS multi_extra
       FROM (SELECT DISTINCT * FROM o) o SEMI JOIN om USING (spp, gene) GROUP BY group_id),
co AS (SELECT os.group_id, n_genes, coalesce(n_pred, 0) AS n_pred, coalesce(n_shared, 0) AS n_shared, coalesce(n_union, 0) AS n_union,
              coalesce(n_multi, 0) AS n_multi, n_spp = 1 AS paralogous, n_genes = n_spp AS single_copy, coalesce(multi_extra, 0) AS me
       FROM os LEFT JOIN h USING (group_id) LEFT JOIN mu USING (group_id)),
du AS (SELECT group_id, count(*) OVER (PARTITION BY k) > 1 AS duplicate FROM (SELECT group_id, list_sort(list(DISTINCT spp || ':' || gene)) AS k FROM o GROUP BY group_id)),
st AS (SELECT tc.group_id, sum(n)::BIGINT AS n_strange FROM tc JOIN (SELECT group_id AS pg, count(*) AS n FROM (SELECT DISTINCT * FROM p) p ANTI JOIN o USING (spp, gene) GROUP BY 1) USING (pg) GROUP BY tc.group_id),
lo AS (SELECT group_id, CASE WHEN n_pred = 0 THEN 'Missing'
              WHEN n_union = n_shared AND n_genes = n_shared THEN CASE WHEN n_pred > 1 THEN 'Split' ELSE 'Equal' END
              WHEN n_union = n_shared AND n_genes - n_shared = me THEN 'MultiGroups'
              WHEN n_union = n_shared THEN 'Superset' WHEN n_genes = n_shared THEN 'Subset' ELSE 'Conflict' END AS label,
              n_genes, n_pred, n_shared, n_union, n_multi, paralogous, single_copy,
              duplicate, n_pred > 0 AND n_union = n_shared AND n_genes = n_shared AS resolved, n_genes - n_shared AS n_lost, n_union - n_shared AS n_extra, coalesce(n_strange, 0) AS n_strange
       FROM co JOIN du USING (group_id) LEFT JOIN st USING (group_id))"""

_REF_LABELS = """
sz AS (SELECT group_id, count(*) AS n_genes FROM ref GROUP BY group_id),
t AS (SELECT r.group_id, p.group_id AS pg FROM ref r JOIN pred p USING (spp, gene) GROUP BY ALL),
u AS (SELECT t.group_id, count(*) FILTER (r.gene IS NULL) AS extra, count(*) FILTER (r.group_id <> t.group_id) AS misplaced,
             count(*) FILTER (r.group_id = t.group_id) AS shared, count(DISTINCT t.pg) AS n_pred
      FROM t JOIN pred p ON p.group_id = t.pg LEFT JOIN ref r ON r.spp = p.spp AND r.gene = p.gene GROUP BY t.group_id),
lr AS (SELECT group_id, CASE WHEN n_pred IS NULL THEN 'Absent' ELSE coalesce(nullif(concat_ws('+', CASE WHEN n_pred > 1 THEN 'Split' END,
              CASE WHEN n_genes > shared THEN 'Subset' END, CASE WHEN extra > 0 THEN 'Superset' END), ''), 'Equal') END AS label,
              n_genes, coalesce(n_pred, 0) AS n_pred, n_genes - coalesce(shared, 0) AS missing, coalesce(extra, 0) AS extra, coalesce(misplaced, 0) AS misplaced
       FROM sz LEFT JOIN u USING (group_id))"""

#: Reasons of genes of o that p lacks, with positions pos.
_REASON = """
g AS (SELECT DISTINCT o.group_id, o.spp, o.gene, p.gene IS NOT NULL AS member, pos.chrom, pos.idx,
             (o.spp, o.gene) IN (SELECT (spp, gene) FROM o GROUP BY spp, gene HAVING count(DISTINCT group_id) > 1) AS many
      FROM o LEFT JOIN (SELECT DISTINCT spp, gene FROM p) p USING (spp, gene) LEFT JOIN pos USING (spp, gene)),
nm AS (SELECT x.group_id, x.spp, x.gene, min(abs(x.idx - y.idx)) AS dist FROM g x JOIN g y
       ON x.group_id = y.group_id AND x.spp = y.spp AND x.chrom = y.chrom AND y.member AND NOT x.member GROUP BY ALL),
sm AS (SELECT DISTINCT group_id, spp FROM g WHERE member),
rs AS (SELECT g.group_id, g.spp, g.gene,
              CASE WHEN g.idx IS NULL THEN 'Not in Annotation' WHEN g.many THEN 'Multi-Grouped' WHEN sm.spp IS NULL THEN 'No Ortholog Detected' WHEN nm.dist IS NULL THEN 'Different Chromosome'
                   WHEN nm.dist <= 100 THEN 'Sequence Similarity' ELSE 'Distance' END AS reason,
              CASE WHEN g.idx IS NOT NULL AND sm.spp IS NOT NULL THEN nm.dist END AS distance
       FROM g LEFT JOIN sm ON sm.group_id = g.group_id AND sm.spp = g.spp LEFT JOIN nm ON nm.group_id = g.group_id AND nm.spp = g.spp AND nm.gene = g.gene WHERE NOT g.member)"""

_COUNT_REASONS = """count(*) FILTER (reason = 'Not in Annotation') AS not_in_annotation, count(*) FILTER (reason = 'No Ortholog Detected') AS spp_missing,
 count(*) FILTER (reason = 'Different Chromosome') AS different_chrom, count(*) FILTER (reason = 'Sequence Similarity') AS sequence_similarity,
 count(*) FILTER (reason = 'Distance') AS distance, count(*) FILTER (reason = 'Multi-Grouped') AS {}"""

_EXTRA = """
ch AS (SELECT group_id FROM lo WHERE label = '{label}'),
ex AS (SELECT DISTINCT tc.group_id, p.spp, p.gene FROM tc SEMI JOIN ch USING (group_id) JOIN p ON p.group_id = tc.pg
       WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.group_id = tc.group_id AND o.spp = p.spp AND o.gene = p.gene)),
pa AS (SELECT DISTINCT spp, gene FROM o WHERE group_id IN (SELECT group_id FROM os WHERE n_spp = 1)),
gr AS (SELECT DISTINCT spp, gene FROM o),
fl AS (SELECT ex.group_id, pa.gene IS NOT NULL AS para, om.gene IS NOT NULL AS mult, gr.gene IS NOT NULL AS gro
       FROM ex LEFT JOIN pa USING (spp, gene) LEFT JOIN om USING (spp, gene) LEFT JOIN gr USING (spp, gene)),
xt AS (SELECT group_id, count(*) AS n_extra, count(*) FILTER (para AND NOT mult) AS paralogous, count(*) FILTER (para AND mult) AS "both",
              count(*) FILTER (mult AND NOT para) AS multigrouped, count(*) FILTER (NOT gro) AS not_grouped, count(*) FILTER (gro AND NOT para AND NOT mult) AS another_group
       FROM fl GROUP BY group_id)"""

_DETAIL = """CASE WHEN paralogous + "both" = n_extra THEN 'all paralogs' WHEN multigrouped + "both" = n_extra THEN 'all multigrouped'
 WHEN not_grouped = n_extra THEN 'all ungrouped' ELSE 'mixed' END AS detail"""

_CONS = "cons AS (SELECT concat_ws('-', p.group_id, r.group_id, t.group_id) AS group_id, p.spp, p.gene FROM pred p JOIN ref r USING (spp, gene) JOIN third t USING (spp, gene) QUALIFY count(*) OVER (PARTITION BY p.group_id, r.group_id, t.group_id) > 1)"

_COPIES = """k AS (SELECT group_id, list_sort(list(DISTINCT gene % 40)) AS s FROM lines GROUP BY group_id),
dc AS (SELECT group_id, min(group_id) OVER w AS first_group, len(s)::BIGINT AS n_genes, CASE WHEN s[1] >= 20 OR s[-1] < 20 THEN 'paralog' ELSE 'ortholog' END AS type, s FROM k WINDOW w AS (PARTITION BY s) QUALIFY count(*) OVER w > 1)"""

_EDGES = "e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey || '.' || l_suppkey || '.' || l_quantity::INT AS b FROM lineitem)"

_MERGED = """WITH RECURSIVE l AS (SELECT 'O:o' || l_orderkey AS a, l_returnflag || ':p' || l_partkey || '.' || l_suppkey || '.' AS kind, l_quantity::INT AS q FROM lineitem),
bt AS (SELECT kind || q AS a, kind || lead(q) OVER (PARTITION BY kind ORDER BY q) AS b FROM (SELECT DISTINCT kind, q FROM l)),
x AS MATERIALIZED (SELECT DISTINCT least(a, kind || q) AS a, greatest(a, kind || q) AS b FROM l),
p AS (SELECT * FROM x UNION SELECT * FROM bt WHERE b IS NOT NULL), pb AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT a, a FROM p UNION SELECT b, b FROM p),
nb AS MATERIALIZED (SELECT a, list_sort(list(b)) AS s FROM pb GROUP BY a),
ct AS MATERIALIZED (SELECT x.a, x.b FROM x JOIN nb u ON u.a = x.a JOIN nb v ON v.a = x.b WHERE len(u.s) = len(v.s) AND u.s <> v.s),
k AS (SELECT * FROM x EXCEPT SELECT * FROM ct), kb AS MATERIALIZED (SELECT a, b FROM k UNION SELECT b, a FROM k),
g AS (SELECT a AS node FROM x UNION SELECT b FROM x),
r1(node, root) AS (SELECT node, node FROM g UNION SELECT kb.b, r1.root FROM r1 JOIN kb ON kb.a = r1.node),
c1 AS MATERIALIZED (SELECT node, min(root) AS root FROM r1 GROUP BY node),
t AS (SELECT DISTINCT u.root AS a, v.root AS b FROM ct JOIN c1 u ON u.node = ct.a JOIN c1 v ON v.node = ct.b WHERE u.root <> v.root),
tk AS (SELECT t.a, t.b FROM t JOIN nb u ON u.a = t.a JOIN nb v ON v.a = t.b WHERE NOT (len(u.s) = len(v.s) AND u.s <> v.s)), tb AS MATERIALIZED (SELECT a, b FROM tk UNION SELECT b, a FROM tk),
r2(node, root) AS (SELECT root, root FROM c1 UNION SELECT tb.b, r2.root FROM r2 JOIN tb ON tb.a = r2.node),
c2 AS MATERIALIZED (SELECT c1.node, m.root FROM c1 JOIN (SELECT node, min(root) AS root FROM r2 GROUP BY node) m ON m.node = c1.root),
sz AS (SELECT root, count(*) AS size FROM c2 GROUP BY root),
op AS MATERIALIZED (SELECT ct.a, ct.b, u.root AS ra, v.root AS rb FROM ct JOIN c2 u ON u.node = ct.a JOIN c2 v ON v.node = ct.b WHERE u.root <> v.root),
ag AS (SELECT a AS node, rb AS root FROM op UNION SELECT b, ra FROM op),
ja AS (SELECT node, min(ag.root) AS root FROM ag JOIN sz o ON o.root = ag.node AND o.size = 1 GROUP BY node HAVING count(DISTINCT ag.root) = 1),
ok AS (SELECT ja.* FROM ja JOIN sz USING (root) WHERE size > 1),
pl AS MATERIALIZED (SELECT c2.node, coalesce(ok.root, c2.root) AS root, ok.root IS NOT NULL AS late FROM c2 LEFT JOIN ok USING (node)),
lo AS (SELECT root, count(DISTINCT split_part(node, ':', 1)) = 1 AS lonely FROM pl GROUP BY root)
"""

ORACLES = {
    "seeded_sample": with_views("pred") + " SELECT group_id, spp, gene FROM pred ORDER BY md5('1234:' || gene), gene LIMIT 100",
    "pair_benchmark": _PAIR.replace("{saved}", "false"),
    "pair_benchmark_rescue": _PAIR.replace("{saved}", "saved"),
    "misplaced_genes": _PAIR[: _PAIR.index("pp AS (")].rstrip().rstrip(",") + "\nSELECT m.pred, spp, gene, ref, main FROM m JOIN mg USING (pred) WHERE ref <> main",
    "paralog_pairs": with_views("pred", "ref") + """,
a AS (SELECT *, group_id IN (SELECT group_id FROM ref GROUP BY group_id HAVING count(DISTINCT spp) = 1) AS para FROM ref),
m AS (SELECT p.group_id AS pred, p.spp, p.gene, a.group_id AS ref, coalesce(a.para, false) AS para FROM pred p LEFT JOIN a USING (spp, gene)),
n AS (SELECT pred, ref, count(*) AS n, min(gene) AS g FROM m WHERE ref IS NOT NULL GROUP BY pred, ref),
mg AS (SELECT pred, ref AS main, n / (sum(n) OVER (PARTITION BY pred))::DOUBLE > 0.9 AS sub, row_number() OVER (PARTITION BY pred ORDER BY n DESC, g) AS k FROM n QUALIFY k = 1)
SELECT x.pred, x.spp, x.gene, x.ref AS orig_group,
       count(*) FILTER (x.ref = y.ref OR (sub AND (main = x.ref OR main = y.ref))) AS tp_pairs,
       count(*) FILTER (NOT (x.ref = y.ref OR (sub AND (main = x.ref OR main = y.ref)))) AS fp_pairs
FROM m x JOIN m y ON x.pred = y.pred AND x.spp <> y.spp AND y.ref IS NOT NULL JOIN mg ON mg.pred = x.pred WHERE x.para GROUP BY ALL""",
    "refog_scores": with_views("pred", "ref") + """,
sure AS (SELECT * FROM ref WHERE gene % 19 <> 0), un AS (SELECT * FROM ref WHERE gene % 19 = 0),
sz AS (SELECT group_id, count(*) AS size FROM sure GROUP BY group_id HAVING count(*) > 1),
o AS (SELECT s.group_id, p.group_id AS pg, count(*) AS o FROM sure s JOIN pred p USING (spp, gene) GROUP BY ALL),
pn AS (SELECT group_id AS pg, count(*) AS np FROM pred GROUP BY group_id),
nu AS (SELECT u.group_id, p.group_id AS pg, count(*) AS nu FROM un u JOIN pred p USING (spp, gene) GROUP BY ALL),
x AS (SELECT o.group_id, o.o, np - coalesce(nu, 0) AS na FROM o JOIN pn USING (pg) LEFT JOIN nu ON nu.group_id = o.group_id AND nu.pg = o.pg),
s AS (SELECT group_id, sum(o * (o - 1) / 2.0) AS tp, sum(o * (na - o)) AS fp, sum(o * o) AS oo, sum(o) AS here FROM x GROUP BY group_id),
f AS (SELECT group_id, size, coalesce(tp, 0)::DOUBLE AS tp, coalesce(fp, 0)::DOUBLE AS fp,
             ((size * coalesce(here, 0) - coalesce(oo, 0) + (size - coalesce(here, 0)) * (size - 1)) / 2.0)::DOUBLE AS fn FROM sz LEFT JOIN s USING (group_id))
SELECT *, fp = 0 AND fn = 0 AS exact, round(tp / (size - 1), 6) AS even_tp, round(fp / (size - 1), 6) AS even_fp, round(fn / (size - 1), 6) AS even_fn FROM f""",
    "validate_groups": with_views("multi", "genes") + """,
p AS (SELECT DISTINCT spp, gene FROM multi), g AS (SELECT DISTINCT spp, gene FROM genes)
SELECT 'extra genes' AS "check", count(*) AS n FROM p ANTI JOIN g USING (spp, gene)
UNION ALL SELECT 'missing genes', count(*) FROM g ANTI JOIN p USING (spp, gene)
UNION ALL SELECT 'genes in several groups', count(*) FROM (SELECT spp, gene FROM multi GROUP BY ALL HAVING count(DISTINCT group_id) > 1)
UNION ALL SELECT 'species without genes', count(*) FROM (SELECT DISTINCT spp FROM g) x ANTI JOIN p USING (spp)
UNION ALL SELECT 'coverage percent', floor(100 * (SELECT count(*) FROM g SEMI JOIN p USING (spp, gene)) / (SELECT count(*) FROM g))::BIGINT""",
    "classify_reference": with_views("pred", "ref") + "," + _REF_LABELS + " SELECT * FROM lr",
    "classify_other": with_views("multi", "pred") + ", o AS (SELECT * FROM multi), p AS (SELECT * FROM pred)," + _OTHER + " SELECT * FROM lo",
    "classify_consensus": with_views("pred", "ref", "third") + f""", {_CONS},
cs AS (SELECT group_id, count(*) AS sb FROM cons GROUP BY group_id),
h AS (SELECT p.group_id, count(DISTINCT c.group_id) AS k, count(*) AS shared, max(sb) AS sb FROM pred p JOIN cons c USING (spp, gene) JOIN cs ON cs.group_id = c.group_id GROUP BY p.group_id),
j AS (SELECT group_id, n, coalesce(k, 0) AS k, coalesce(shared, 0) AS shared, coalesce(sb, 0) AS sb FROM (SELECT group_id, count(*) AS n FROM pred GROUP BY 1) LEFT JOIN h USING (group_id))
SELECT group_id, CASE WHEN k = 0 THEN 'Not in merged' WHEN k > 1 THEN 'Split' WHEN shared = n AND shared = sb THEN 'Equal' WHEN shared = n THEN 'Subset' WHEN shared = sb THEN 'Superset' ELSE 'Diff' END AS relation,
       k = 1 AND shared = n AS a_in_b, k = 1 AND shared = sb AS b_in_a, k AS n_other FROM j""",
    "class_counts_rollup": with_views("pred", "ref") + "," + _REF_LABELS + """
SELECT label, n_pred > 1 AS split, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lr), 2)::DOUBLE AS percent FROM lr GROUP BY ROLLUP (label, n_pred > 1)""",
    "group_overlap": with_views("pred", "ref") + """
SELECT r.group_id AS group_a, p.group_id AS group_b, count(*) AS n_shared, any_value(x.n) AS size_a, any_value(y.n) AS size_b FROM ref r JOIN pred p USING (spp, gene)
JOIN (SELECT group_id, count(*) AS n FROM ref GROUP BY 1) x ON x.group_id = r.group_id JOIN (SELECT group_id, count(*) AS n FROM pred GROUP BY 1) y ON y.group_id = p.group_id GROUP BY ALL""",
    "size_distribution": with_views("lines") + f" SELECT n_genes, count(*) AS n_groups, round(ln(count(*)), 6) AS ln_groups FROM ({_SIZES.format('lines')}) GROUP BY n_genes",
    "species_counts": with_views("lines") + " SELECT spp, count(DISTINCT gene) AS n_genes FROM lines WHERE group_id IN (SELECT group_id FROM lines GROUP BY 1 HAVING count(DISTINCT spp) > 1) GROUP BY spp",
    "group_profile": with_views("lines") + " SELECT group_id, count(DISTINCT gene) AS n_genes, count(DISTINCT spp) AS n_spp, count(DISTINCT spp) = 1 AS single_spp, count(DISTINCT gene) = count(DISTINCT spp) AS single_copy FROM lines GROUP BY group_id",
    "isoform_reduction": with_views("lines") + """ SELECT group_id, count(*) AS n_entries, count(DISTINCT (spp, gene // 50)) AS n_genes, CASE WHEN count(DISTINCT spp) = 5 THEN 'all species' ELSE 'partial' END AS kind
FROM lines GROUP BY group_id HAVING count(*) > count(DISTINCT (spp, gene // 50))""",
    "multigrouped": with_views("lines") + " SELECT spp, gene, count(DISTINCT group_id) AS n_groups FROM lines GROUP BY ALL HAVING count(DISTINCT group_id) > 1",
    "paralog_genes": with_views("ref") + " SELECT DISTINCT * FROM ref WHERE group_id IN (SELECT group_id FROM ref GROUP BY 1 HAVING count(DISTINCT spp) = 1)",
    "coverage_rollup": with_views("genes", "pred", "multi") + """,
u AS (SELECT spp, gene FROM genes UNION SELECT spp, gene FROM pred UNION SELECT spp, gene FROM multi),
f AS (SELECT g.spp, g.gene, EXISTS (SELECT 1 FROM genes p WHERE p.spp = g.spp AND p.gene = g.gene) AS k, EXISTS (SELECT 1 FROM pred p WHERE p.spp = g.spp AND p.gene = g.gene) AS a, EXISTS (SELECT 1 FROM multi p WHERE p.spp = g.spp AND p.gene = g.gene) AS b,
  (spp, gene) IN (SELECT (spp, gene) FROM multi WHERE group_id IN (SELECT group_id FROM multi GROUP BY 1 HAVING count(DISTINCT spp) = 1)) AS pa,
  (spp, gene) IN (SELECT (spp, gene) FROM multi GROUP BY spp, gene HAVING count(DISTINCT group_id) > 1) AS mu FROM u g)
SELECT spp, count(*) FILTER (k) AS n_genes, count(*) FILTER (k AND a) AS in_a, count(*) FILTER (k AND b) AS in_b, count(*) FILTER (k AND pa) AS paralogous_b,
  count(*) FILTER (k AND b AND NOT pa) AS single_b, count(*) FILTER (k AND mu) AS multigrouped_b, count(*) FILTER (a AND NOT k) AS out_a, count(*) FILTER (b AND NOT k) AS out_b,
  round(count(*) FILTER (k AND a) / count(*) FILTER (k)::DOUBLE * 100, 2) AS pct_a, round(count(*) FILTER (k AND b) / count(*) FILTER (k)::DOUBLE * 100, 2) AS pct_b FROM f GROUP BY ROLLUP (spp)""",
    "gene_overlap_summary": with_views("pred", "ref") + """,
x AS (SELECT 'all' AS scope, spp, gene, 'a' AS side FROM pred UNION ALL SELECT 'all', spp, gene, 'b' FROM ref
  UNION ALL SELECT 'multi-species', spp, gene, 'a' FROM pred WHERE group_id IN (SELECT group_id FROM pred GROUP BY 1 HAVING count(DISTINCT spp) > 1)
  UNION ALL SELECT 'multi-species', spp, gene, 'b' FROM ref WHERE group_id IN (SELECT group_id FROM ref GROUP BY 1 HAVING count(DISTINCT spp) > 1)),
y AS (SELECT scope, spp, gene, bool_or(side = 'a') AS a, bool_or(side = 'b') AS b FROM x GROUP BY ALL)
SELECT scope, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b,
  round(count(*) FILTER (a AND b) / count(*)::DOUBLE * 100, 2) AS pct_shared FROM y GROUP BY scope""",
    "duplicate_groups": with_views("lines") + """,
k AS (SELECT group_id, list_sort(list(DISTINCT gene % 40)) AS s FROM lines GROUP BY group_id)
SELECT group_id, first_group, len(s)::BIGINT AS n_genes FROM (SELECT group_id, s, min(group_id) OVER (PARTITION BY s) AS first_group FROM k) WHERE group_id <> first_group""",
    "duplicate_classes": with_views("lines") + ", " + _COPIES + " SELECT group_id, first_group, n_genes, type FROM dc",
    "duplicate_counts": with_views("lines") + ", " + _COPIES + """,
x AS (SELECT DISTINCT type, unnest(s) AS g FROM dc), y AS (SELECT type, g FROM x UNION ALL SELECT 'both', g FROM x GROUP BY g HAVING count(*) > 1)
SELECT type, (SELECT count(*) FROM dc WHERE dc.type = y.type) AS n_groups, count(*) AS n_genes FROM y GROUP BY type""",
    "missing_members": with_views("pred", "ref") + " SELECT DISTINCT spp, gene FROM pred ANTI JOIN ref USING (spp, gene)",
    "missing_counts": with_views("pred", "ref") + " SELECT spp, count(*) FILTER (NOT EXISTS (SELECT 1 FROM pred p WHERE p.spp = r.spp AND p.gene = r.gene)) AS n_missing, count(*) AS n_genes FROM (SELECT DISTINCT spp, gene FROM ref) r GROUP BY spp",
    "repeated_members": with_views("lines") + " SELECT spp, gene, count(*) AS n_rows FROM lines GROUP BY ALL HAVING count(*) > 1",
    "top_repeated": with_views("lines") + " SELECT spp, gene, count(DISTINCT group_id) AS n_groups FROM lines GROUP BY ALL HAVING count(DISTINCT group_id) > 1 ORDER BY n_groups DESC, spp, gene LIMIT 10",
    "pattern_by_state": """
WITH c AS (SELECT o_custkey AS group_id, o_orderpriority AS org, min(o_orderstatus) AS state, count(*) AS n FROM orders GROUP BY ALL)
SELECT a.group_id, a.state AS "1-URGENT_state", a.n AS "1-URGENT_count", b.state AS "2-HIGH_state", b.n AS "2-HIGH_count", c.state AS "3-MEDIUM_state", c.n AS "3-MEDIUM_count", d.state AS "4-NOT SPECIFIED_state", d.n AS "4-NOT SPECIFIED_count", e.state AS "5-LOW_state", e.n AS "5-LOW_count", 5::BIGINT AS n_orgs,
  list_aggregate(list_transform(list_sort([{'k': -a.n, 'o': '1-URGENT'}, {'k': -b.n, 'o': '2-HIGH'}, {'k': -c.n, 'o': '3-MEDIUM'}, {'k': -d.n, 'o': '4-NOT SPECIFIED'}, {'k': -e.n, 'o': '5-LOW'}]), lambda x: x.o), 'string_agg', ',') AS orgs_by_count, greatest(a.n, b.n, c.n, d.n, e.n) AS top_count
FROM c a JOIN c b ON a.group_id = b.group_id JOIN c ON c.group_id = a.group_id JOIN c d ON d.group_id = a.group_id JOIN c e ON e.group_id = a.group_id WHERE d.org = '4-NOT SPECIFIED' AND e.org = '5-LOW' AND e.state IN ('F', 'O') AND a.org = '1-URGENT' AND b.org = '2-HIGH' AND c.org = '3-MEDIUM'
  AND a.state IN ('F', 'O') AND b.state = 'O' AND c.state IN ('F', 'P') AND a.n <= b.n""",
    "gene_index": with_views("genes", "pos") + " SELECT * FROM pos",
    "nearest_member_reason": with_views("pred", "ref", "genes", "pos") + ", o AS (SELECT * FROM ref), p AS (SELECT * FROM pred)," + _REASON + " SELECT * FROM rs",
    "multi_grouped_reason": with_views("multi", "pred", "genes", "pos") + ", o AS (SELECT * FROM multi), p AS (SELECT * FROM pred)," + _REASON + " SELECT * FROM rs",
    "split_reasons": with_views("pred", "ref", "genes", "pos") + """,
m AS (SELECT r.group_id, r.spp, r.gene, p.group_id AS pred FROM ref r JOIN pred p USING (spp, gene)),
mn AS (SELECT group_id, spp, pred, count(*) AS n FROM m GROUP BY ALL),
mj AS (SELECT group_id, spp, pred AS majority FROM (SELECT *, row_number() OVER (PARTITION BY group_id, spp ORDER BY n DESC, pred) AS k FROM mn) WHERE k = 1),
x AS (SELECT m.*, majority, chrom, idx FROM m JOIN mj USING (group_id, spp) LEFT JOIN pos USING (spp, gene)),
y AS (SELECT a.group_id, a.spp, a.gene, a.pred, a.majority, a.idx, min(abs(a.idx - b.idx)) AS distance
  FROM x a LEFT JOIN x b ON a.group_id = b.group_id AND a.spp = b.spp AND a.chrom = b.chrom AND b.pred = b.majority WHERE a.pred <> a.majority GROUP BY ALL)
SELECT group_id, spp, gene, pred, majority, distance,
  CASE WHEN idx IS NULL THEN 'Not in Annotation' WHEN distance IS NULL THEN 'Different Chromosome' WHEN distance <= 20 THEN 'Sequence Similarity' ELSE 'Distance' END AS reason FROM y""",
    "missing_cause": with_views("pred", "ref", "genes", "pos") + """,
x AS (SELECT r.group_id, r.spp, r.gene, chrom, idx, (r.spp, r.gene) IN (SELECT (spp, gene) FROM pred) AS has FROM ref r JOIN pos USING (spp, gene)),
e AS (SELECT group_id, spp, chrom, min(idx) AS f, max(idx) AS l FROM x WHERE has GROUP BY ALL)
SELECT x.group_id, x.spp, x.gene, CASE WHEN abs(idx - f) <= 20 OR abs(idx - l) <= 20 THEN 'sequence' ELSE 'synteny' END AS cause
FROM x LEFT JOIN e ON e.group_id = x.group_id AND e.spp = x.spp AND e.chrom = x.chrom WHERE NOT has""",
    "superset_detail": with_views("pred", "ref", "genes", "pos") + ", o AS (SELECT * FROM ref), p AS (SELECT * FROM pred)," + _OTHER + "," + _REASON + f""",
c AS (SELECT group_id, count(*) AS n_missing, {_COUNT_REASONS.format("multi_grouped")} FROM rs SEMI JOIN (SELECT group_id FROM lo WHERE label = 'Superset') USING (group_id) GROUP BY group_id)
SELECT *, CASE WHEN spp_missing = n_missing THEN 'All Missing' WHEN spp_missing > 0 THEN 'Partially Missing' ELSE 'None Missing' END AS tag FROM c""",
    "subset_detail": with_views("multi", "pred") + ", o AS (SELECT * FROM multi), p AS (SELECT * FROM pred)," + _OTHER + "," + _EXTRA.format(label="Subset") + f" SELECT *, {_DETAIL} FROM xt",
    "conflict_detail": with_views("pred", "ref", "genes", "pos") + ", o AS (SELECT * FROM ref), p AS (SELECT * FROM pred)," + _OTHER + "," + _EXTRA.format(label="Conflict") + "," + _REASON + f""",
c AS (SELECT group_id, count(*) AS n_missing, {_COUNT_REASONS.format("multi_grouped_missing")} FROM rs GROUP BY group_id)
SELECT xt.*, coalesce(n_missing, 0) AS n_missing, coalesce(not_in_annotation, 0) AS not_in_annotation, coalesce(spp_missing, 0) AS spp_missing,
  coalesce(different_chrom, 0) AS different_chrom, coalesce(sequence_similarity, 0) AS sequence_similarity, coalesce(distance, 0) AS distance, coalesce(multi_grouped_missing, 0) AS multi_grouped_missing, {_DETAIL} FROM xt LEFT JOIN c USING (group_id)""",
    "split_cause": with_views("ref", "genes", "pos") + """,
s AS (SELECT r.group_id, r.spp, chrom, idx - lag(idx) OVER (PARTITION BY r.group_id, r.spp, chrom ORDER BY idx) AS gap FROM ref r JOIN pos USING (spp, gene)),
x AS (SELECT group_id, spp, count(DISTINCT chrom) AS c, max(gap) AS g FROM s GROUP BY ALL)
SELECT group_id, count(*) FILTER (c > 1) AS n_multi_chrom, count(*) FILTER (g > 20) AS n_wide, CASE WHEN count(*) FILTER (c > 1) > 1 OR count(*) FILTER (g > 20) > 1 THEN 'synteny' ELSE 'sequence' END AS cause FROM x GROUP BY group_id""",
    "two_method_report": with_views("pred", "ref") + """,
t AS (SELECT r.group_id, p.group_id AS pg, count(*) AS c FROM ref r JOIN pred p USING (spp, gene) GROUP BY ALL),
h AS (SELECT t.group_id, count(*) AS k, sum(c)::BIGINT AS sh, sum(n)::BIGINT AS un, count(*) FILTER (c = n) AS wh FROM t JOIN (SELECT group_id AS pg, count(*) AS n FROM pred GROUP BY 1) USING (pg) GROUP BY t.group_id),
j AS (SELECT group_id, coalesce(k, 0) AS n_pred, n - coalesce(sh, 0) AS missing, coalesce(un - sh, 0) AS rest, coalesce(wh, 0) AS wh FROM (SELECT group_id, count(*) AS n FROM ref GROUP BY 1) LEFT JOIN h USING (group_id))
SELECT group_id, CASE WHEN n_pred = 0 THEN 'Absent' WHEN missing = 0 AND rest = 0 THEN CASE WHEN n_pred = 1 THEN 'Equal' ELSE 'Split' END WHEN rest = 0 THEN 'Superset' WHEN missing = 0 THEN 'Subset' ELSE 'Mixed' END AS relation,
  CASE WHEN n_pred = 0 THEN 'no member' WHEN missing = 0 AND rest = 0 THEN 'same genes' WHEN rest = 0 THEN CASE WHEN n_pred = 1 THEN 'missing only' ELSE 'split and missing' END
    WHEN missing = 0 THEN CASE WHEN n_pred = 1 THEN 'other has more' WHEN wh = 0 THEN 'split with others' ELSE 'split, some whole' END
    WHEN rest < missing THEN 'less remainder' WHEN rest > missing THEN 'greater remainder' ELSE 'equal remainder' END AS detail, n_pred, missing, rest,
  (SELECT count(*) FROM (SELECT DISTINCT p.spp, p.gene FROM t JOIN pred p ON p.group_id = t.pg WHERE t.group_id = j.group_id) x ANTI JOIN (SELECT * FROM ref r WHERE r.group_id = j.group_id) y USING (spp, gene)
   SEMI JOIN (SELECT spp, gene FROM ref WHERE group_id IN (SELECT group_id FROM ref GROUP BY 1 HAVING count(DISTINCT spp) = 1)) z USING (spp, gene)) AS n_paralogs FROM j""",
    "pairwise_tables": with_views("pred", "ref") + """,
r AS (SELECT * FROM ref),
k AS (SELECT DISTINCT x.group_id, x.spp AS spp_a, y.spp AS spp_b FROM r x JOIN r y ON x.group_id = y.group_id AND x.spp < y.spp),
w AS (SELECT spp_a, spp_b, k.group_id, count(*) AS n, count(p.group_id) AS f, count(DISTINCT p.group_id) AS g FROM k JOIN r ON r.group_id = k.group_id AND r.spp IN (spp_a, spp_b) LEFT JOIN pred p ON p.spp = r.spp AND p.gene = r.gene GROUP BY ALL)
SELECT spp_a, spp_b, count(*) AS n_rows, count(*) FILTER (n = f AND g = 1) AS equal, count(*) FILTER (n = f AND g > 1) AS split, count(*) FILTER (n > f AND g = 1) AS partly_one,
  count(*) FILTER (n > f AND g > 1) AS partly_many, count(*) FILTER (g = 0) AS absent, sum(n - f)::BIGINT AS n_missing FROM w GROUP BY ALL""",
    "consensus_groups": with_views("pred", "ref", "third") + f", {_CONS} SELECT * FROM cons",
    "components": f"""WITH RECURSIVE {_EDGES}, b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT a, a FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""",
    "contradictory_pairs": f"""WITH {_EDGES}, b AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
n AS (SELECT a, list_sort(list(b)) AS s FROM b GROUP BY a)
SELECT e.a, e.b FROM e JOIN n x ON x.a = e.a JOIN n y ON y.a = e.b WHERE len(x.s) = len(y.s) AND x.s <> y.s""",
    "merged_pairs": _MERGED + """SELECT split_part(node, ':', 1) AS spp, split_part(node, ':', 2) AS gene, root AS group_id,
CASE WHEN lonely THEN 'one species' WHEN late THEN 'attached' ELSE 'component' END AS state FROM pl JOIN lo USING (root)""",
    "open_contradictions": _MERGED + "SELECT op.a AS gene_a, op.b AS gene_b FROM op JOIN pl u ON u.node = op.a JOIN pl v ON v.node = op.b WHERE u.root <> v.root",
    "group_consistency": with_views("pred", "third") + """,
j AS (SELECT p.group_id AS pred, spp, gene, t.group_id AS merged FROM pred p LEFT JOIN third t USING (spp, gene)),
m AS (SELECT pred, merged AS main, row_number() OVER (PARTITION BY pred ORDER BY count(*) DESC, merged) AS k FROM j WHERE merged IS NOT NULL GROUP BY pred, merged QUALIFY k = 1)
SELECT j.pred, spp, gene, merged, main FROM j JOIN m USING (pred) WHERE merged IS NULL OR merged <> main""",
}

ORACLES |= {
    "top_paralog_groups": f"""SELECT pred, count(*) AS n_genes, sum(tp_pairs)::BIGINT AS tp_pairs, sum(fp_pairs)::BIGINT AS fp_pairs FROM ({ORACLES["paralog_pairs"]}) GROUP BY pred ORDER BY fp_pairs DESC, pred LIMIT 5""",
    "paralog_evidence": ORACLES["paralog_pairs"].replace("\na AS (", "\nsy AS (SELECT o_orderpriority AS spp, o_orderkey AS gene, CASE WHEN o_orderkey % 3 = 0 THEN 'LOC' || (o_orderkey % 7) ELSE 'm' || month(o_orderdate) END AS symbol FROM orders),\na AS (").replace(
        "\nSELECT x.pred, x.spp, x.gene", """
SELECT x.pred, x.spp, x.gene, EXISTS (SELECT 1 FROM m z WHERE z.pred = x.pred AND z.spp = x.spp AND z.ref = any_value(mg.main)) AS spp_in_main, any_value(sx.symbol) LIKE 'LOC%' AS is_loc,
 coalesce(bool_or(sx.symbol = sz.symbol AND (x.ref = y.ref OR (sub AND (main = x.ref OR main = y.ref)))), false) AS same_symbol"""
    ).replace("JOIN mg ON mg.pred = x.pred WHERE x.para", "JOIN mg ON mg.pred = x.pred JOIN sy sx ON sx.spp = x.spp AND sx.gene = x.gene JOIN sy sz ON sz.spp = y.spp AND sz.gene = y.gene WHERE x.para").replace("GROUP BY ALL", "GROUP BY x.pred, x.spp, x.gene, x.ref"),
    "refog_total": f"""WITH t AS (SELECT sum(even_tp) AS tp, sum(even_fp) AS fp, sum(even_fn) AS fn FROM ({ORACLES["refog_scores"]}))
SELECT round(100 * tp / (tp + fp), 4) AS precision, round(100 * tp / (tp + fn), 4) AS recall, round(200 * tp / (2 * tp + fp + fn), 4) AS f1 FROM t""",
    "filter_groups": with_views("pred") + " SELECT * FROM pred WHERE group_id IN (1, 2, 3, 100)",
}
ORACLES["paralog_species"] = f"""SELECT spp, count(*) AS n_genes, count(*) FILTER (spp_in_main) AS n_in_main, sum(tp_pairs)::BIGINT AS tp_pairs, sum(fp_pairs)::BIGINT AS fp_pairs
FROM ({ORACLES["paralog_evidence"]}) GROUP BY spp"""
ORACLES["paralog_summary"] = f"""SELECT count(*) AS n_genes, count(*) FILTER (tp_pairs > 0) AS n_concordant, round(avg(same_symbol::INT) FILTER (tp_pairs > 0), 3) AS same_symbol,
round(avg(spp_in_main::INT) FILTER (tp_pairs > 0), 3) AS spp_in_main, round(avg(is_loc::INT) FILTER (tp_pairs > 0), 3) AS is_loc FROM ({ORACLES["paralog_evidence"]})"""
ORACLES["two_method_reasons"] = ORACLES["nearest_member_reason"].replace("nm.dist <= 100", "nm.dist <= 15").replace(" SELECT * FROM rs", f" SELECT rs.*, relation FROM rs JOIN ({ORACLES['two_method_report']}) USING (group_id)")
