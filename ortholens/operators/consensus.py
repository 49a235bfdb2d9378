"""Groups agreed by several methods, and connected components over pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholens.operators.groups import GENE
from ortholens.sources.shared import discard, rewritten


def merge_methods(*methods: DataFrame) -> DataFrame:
    """groups (joined ids), spp, gene: genes that all methods put together, in groups of two or more."""
    joined = None
    for k, m in enumerate(methods):
        one = m.groupBy(*GENE).agg(F.min("group_id").alias(f"g{k}"))
        joined = one if joined is None else joined.join(one, GENE)
    ids = [f"g{k}" for k in range(len(methods))]
    kept = joined.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return joined.join(kept, ids, "left_semi").select(F.concat_ws("-", *ids).alias("group_id"), *GENE)


def _led(df: DataFrame, col: str, to: DataFrame) -> DataFrame:
    """df with col replaced by the root that to (node, root) has for it, if any."""
    to = to.select(F.col("node").alias(col), F.col("root").alias("__root"))
    return df.join(to, col, "left").withColumn(col, F.coalesce("__root", col)).select(*df.columns)


def _jumped(hooks: DataFrame) -> DataFrame:
    """hooks (node, root) whose roots are no nodes of hooks any more, by pointer jumping; hooks is deleted."""
    while True:
        ahead = hooks.toDF("root", "next")
        both = hooks.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        both = rewritten(both, "components")
        discard(hooks)
        hooks = both.select("node", "root")
        if both.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """node, root over edges (a, b): the least node of each component, for nodes with an edge.

    Every node is hooked to its least smaller neighbour. Its edges to other smaller neighbours become edges between these and the
    least one, moved to the ends of the hooks; they are what the next step starts from. Two steps at least halve the nodes, and
    chains of hooks are followed by pointer jumping. Only nodes hooked from both sides are jumped, and only nodes with several
    smaller neighbours keep edges, so that most of the rows are read once. All is joins and aggregates, small tables are written
    before they are joined, so that Spark knows their size. What a step has written is deleted when it is read no more.
    """
    low = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    rest, steps = rewritten(low(edges), "components"), []
    while not rest.isEmpty():
        least = rest.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"), F.max("b").alias("last"))
        hooks = rewritten(least.select("node", "root", (F.col("root") != F.col("last")).alias("more")), "components")
        many = rewritten(hooks.where("more").select(F.col("node").alias("a"), "root"), "components")
        ends = rest.select(F.col("b").alias("node")).distinct()
        inner = rewritten(hooks.join(ends, "node", "left_semi").select("node", "root"), "components")
        if not inner.isEmpty():
            inner = _jumped(inner)
        left = rest.join(many, "a").where("b > root").select(F.col("root").alias("a"), "b")
        left = rewritten(low(_led(_led(left, "a", inner), "b", inner)).distinct(), "components")
        for old in (rest, many):
            discard(old)
        steps.append((hooks.select("node", "root"), inner))
        rest = left
    out = rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for hooks, inner in reversed(steps):
        later = out
        ahead = rewritten(_led(inner, "root", later).unionByName(later), "components")
        out = rewritten(_led(hooks, "root", ahead).unionByName(later), "components")
        for old in (hooks, inner, later, ahead):
            discard(old)
    done = rewritten(out.unionByName(out.select(F.col("root").alias("node"), "root").distinct()), "components")
    discard(out)
    return done


def _ends(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) from either end."""
    ends = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.explode(ends).alias("end")).select("end.*")


def _marks(both: DataFrame) -> DataFrame:
    """a, n, x, s: size and two order-free hashes of each node's neighbourhood (itself included) over pairs from either end (a, b),
    which are distinct but for those of a node with itself."""
    other = lambda x: F.when(~F.col("a").eqNullSafe(F.col("b")), x)
    short = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(1)), F.lit(1 << 40))
    own = both.groupBy("a").agg(F.count(other(F.lit(1))).alias("n"), F.bit_xor(other(F.xxhash64("b"))).alias("x"), F.sum(other(short("b"))).alias("s"))
    x, s = F.coalesce("x", F.lit(0)).bitwiseXOR(F.xxhash64("a")), F.coalesce("s", F.lit(0)) + short("a")
    return own.withColumns({"n": F.col("n") + 1, "x": x, "s": s})


def _marked(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """edges (a, b) with `cut`: their ends' neighbourhoods have the same size but differ."""
    x, y = marks.toDF("a", "na", "xa", "sa"), marks.toDF("b", "nb", "xb", "sb")
    return edges.join(x, "a").join(y, "b").select("a", "b", F.expr("na = nb and not (xa = xb and sa = sb)").alias("cut"))


def contradictory(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) whose neighbourhoods over pairs (the edges themselves, if none are given) have the same size but differ."""
    return _marked(edges, _marks(_ends(edges if pairs is None else pairs).distinct())).where("cut").select("a", "b")


#: Stands between species and gene in a node's name.
_SEP = "\x1f"
#: Cut pairs up to which they, and the genes at their ends, are broadcast.
FEW = 100_000


def merge_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups from ortholog pairs (spp_a, gene_a, spp_b, gene_b), and the contradictions that stay open.

    Pairs inside a species count as neighbours only. Pairs across species join their genes unless they are contradictory.
    Contradictory ones are tried once more between the least genes of what their ends have become. A gene still alone joins the
    component in which all genes lie that contradict it. First table: spp, gene, group_id (the least `spp:gene` of the
    component) and state: `component`, `attached`, or `one species` for components that are dropped. Second: gene_a, gene_b of
    pairs that were cut and whose genes ended in different groups. Neighbourhoods are compared by fingerprints, so that a gene
    with very many neighbours is one row. Only edges across species join genes, so that a component has one species only if it is
    one gene; such genes, like the cut pairs and the second components, are tables of their own, most often small ones, and all
    genes meet them in one pass at the end.
    """
    name = lambda s: F.concat_ws(_SEP, f"spp_{s}", f"gene_{s}")
    apart = F.coalesce(F.col("spp_a") != F.col("spp_b"), F.lit(False))
    named = pairs.select(F.least(name("a"), name("b")).alias("a"), F.greatest(name("a"), name("b")).alias("b"), apart.alias("apart"))
    all_ = rewritten(named.groupBy("a", "b").agg(F.max("apart").alias("apart")), "pairs")
    marks = rewritten(_marks(_ends(all_)), "marks")
    edges = rewritten(_marked(all_.where("apart").select("a", "b"), marks), "edges")
    discard(all_)
    cuts = rewritten(edges.where("cut").select("a", "b"), "cuts")
    found = components(edges.where("not cut").select("a", "b"))
    discard(edges)

    few = cuts.count() <= FEW
    near = lambda df: F.broadcast(df) if few else df

    def ends(of: DataFrame, roots: DataFrame) -> DataFrame:
        """Some of the cut edges with the roots of both ends, where they differ."""
        own = roots.join(near(_ends(of).select(F.col("a").alias("node")).distinct()), "node", "left_semi").select("node", "root")
        return of.join(own.toDF("a", "ra"), "a").join(own.toDF("b", "rb"), "b").where("ra <> rb")

    def without(nodes: DataFrame, others: DataFrame) -> DataFrame:
        """nodes (node) that others (node) lack, written; the few of others that are met are written first."""
        met = rewritten(others.select("node").join(near(nodes), "node", "left_semi"), "met")
        return rewritten(nodes.join(met, "node", "left_anti"), "alone")

    alone = without(rewritten(cuts.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends"), found)
    first = found.unionByName(alone.select("node", F.col("node").alias("root")))
    again = rewritten(ends(cuts, first).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "again")
    theirs = rewritten(marks.join(near(_ends(again).select("a").distinct()), "a", "left_semi"), "marks")
    second = components(_marked(again, theirs).where("not cut").select("a", "b"))
    discard(marks)
    roots = _led(first, "root", near(second))
    alone = without(alone, second)

    open_ = rewritten(ends(cuts, roots).select("a", "b", "ra", "rb"), "open")
    against = open_.select(F.col("a").alias("node"), F.col("rb").alias("root")).unionByName(open_.select(F.col("b").alias("node"), F.col("ra").alias("root")))
    one = against.join(alone, "node", "left_semi").groupBy("node").agg(F.min("root").alias("to"), F.max("root").alias("last")).where("to = last")
    late = rewritten(one.join(alone.withColumnRenamed("node", "to"), "to", "left_anti").select("node", "to"), "late")
    single = rewritten(alone.join(late, "node", "left_anti").select(F.col("node").alias("lone")), "single")
    placed = roots.join(near(late), "node", "left").select("node", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("late"))
    state = F.when(F.col("lone").isNotNull(), "one species").when(F.col("late"), "attached").otherwise("component")
    part = F.split("node", _SEP, 2)
    groups = placed.join(near(single), F.col("node") == F.col("lone"), "left").select(part[0].alias("spp"), part[1].alias("gene"), F.regexp_replace("root", _SEP, ":").alias("group_id"), state.alias("state"))
    last = ends(open_.select("a", "b"), placed.select("node", "root"))
    return groups, last.select(F.regexp_replace("a", _SEP, ":").alias("gene_a"), F.regexp_replace("b", _SEP, ":").alias("gene_b"))
