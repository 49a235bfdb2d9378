"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block quotas.

1. Every source gets a target number of words (weights, at most `max_repeat` times its size).
2. The words a source gives are cut into blocks of `block_words`; the quota of a source is its number of blocks.
3. A binary tree over the output shards splits the quota vector: a node hands its left half an exact number of blocks,
   drawn from the multivariate hypergeometric distribution, source by source. Leaves hold exact quotas that add up.
4. Documents of a source are permuted by a hash; laid end to end they form the line that blocks are cut from. Shards own
   disjoint runs of blocks, so each document knows which words go to which shard, and gets a local shuffle key there.

A permuted position needs a running sum over a source that may hold a third of all rows: hash prefixes divide every
source into about 2*sqrt(documents) buckets, sums per bucket are accumulated first, then rows inside their bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ortholens.llm.common import let, n_words_of, stash

#: Production parameters.
SHARDS = 32
BLOCK_WORDS = 2048
MAX_REPEAT = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, n_docs, weight, target from rows (source, size): one row per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A source stops at max_repeat times its size and the
    excess is shared again by weight: with sources in order of size/weight, those that stop are a prefix, the first
    prefix whose remaining share fits the next source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = total.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn(
        "cap", (F.col("source_size") * max_repeat).cast("double")
    )
    tight = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    r = (
        w.withColumn("all_words", F.sum("source_size").over(every).cast("double"))
        .withColumn("left_words", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("share", F.col("left_words") / F.col("left_weight"))
        .withColumn("fits", F.col("share") * F.col("weight") <= F.col("cap"))
    )
    first = r.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "share"))).over(every)["share"])
    return first.select(
        "source", "source_size", "n_docs", "weight",
        F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"),
    )


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked ones among `drawn` of `total`, by inversion from the mode outwards, 12 deviations to either side.

    Weights relative to the mode follow from the ratio of neighbouring probabilities, so no factorials are needed; what
    lies farther than 12 deviations weighs less than a double can tell.
    """
    n, k, d = (x.cast("double") for x in (total, marked, drawn))
    low, high = F.greatest(F.lit(0.0), d + k - n), F.least(k, d)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
    dev = F.sqrt(F.greatest(F.lit(0.0), d * k / F.greatest(n, F.lit(1.0)) * (1 - k / F.greatest(n, F.lit(1.0)))))
    reach = F.ceil(12 * dev + 12).cast("double")

    def draw(p: Column) -> Column:
        n, k, d, low, high, mode, reach, u = (p[f"c{i}"] for i in range(8))
        at_low, at_high = F.greatest(low, mode - reach), F.least(high, mode + reach)
        up = lambda x: (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))  # noqa: E731  weight of x+1 over that of x
        steps_up = F.sequence(F.lit(0), (at_high - mode).cast("int"))
        steps_down = F.sequence(F.lit(0), (mode - at_low).cast("int"))
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        sum_up = F.aggregate(
            steps_up, zero, lambda a, i: F.struct((a["w"] * F.when(mode + i < at_high, up(mode + i)).otherwise(0.0)).alias("w"), (a["s"] + a["w"]).alias("s"))
        )["s"]
        sum_down = F.aggregate(
            steps_down, zero, lambda a, i: F.struct((a["w"] * F.when(mode - i > at_low, 1 / up(mode - i - 1)).otherwise(0.0)).alias("w"), (a["s"] + a["w"]).alias("s"))
        )["s"]

        def pick(sums: Column) -> Column:
            goal = u * (sums["up"] + sums["down"] - 1)
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))
            passed = lambda s, g: F.when(s <= g, 1).otherwise(0)
            walk_up = F.aggregate(
                steps_up, start,
                lambda a, i: F.struct((a["w"] * F.when(mode + i < at_high, up(mode + i)).otherwise(0.0)).alias("w"), (a["s"] + a["w"]).alias("s"), (a["n"] + passed(a["s"] + a["w"], goal)).alias("n")),
            )["n"]
            walk_down = F.aggregate(
                steps_down, start,
                lambda a, i: F.struct((a["w"] * F.when(mode - i > at_low, 1 / up(mode - i - 1)).otherwise(0.0)).alias("w"), (a["s"] + a["w"]).alias("s"), (a["n"] + passed(a["s"] + a["w"], goal - sums["up"] + 1)).alias("n")),
            )["n"]
            return F.when(goal < sums["up"], F.least(mode + walk_up, at_high)).otherwise(F.greatest(mode - walk_down, at_low))

        return let(F.struct(sum_up.alias("up"), sum_down.alias("down")), pick)

    args = F.struct(*(x.alias(f"c{i}") for i, x in enumerate((n, k, d, low, high, mode, reach, u))))
    return let(args, draw).cast("long")


def split_tree(targets: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """source, first_block array<long>: shard k of a source owns blocks first_block[k] up to first_block[k + 1].

    One row per node carries the quota vector; each level splits every node in two without a shuffle. The vectors grow
    with the number of sources only.
    """
    quota = F.ceil(F.floor(F.col("target")) / F.lit(block_words)).cast("long")
    root = targets.select(F.struct("source", quota.alias("q")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("v"))
    node = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "v")
    all_blocks = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x["q"])
    node = node.select("lo", "hi", "v", all_blocks.alias("all"))
    upto = lambda k: F.floor(F.col("all") * k / F.lit(shards)).cast("long")
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        node = node.select("lo", "hi", "v", "all", mid.alias("mid")).select(
            "*", (upto(F.col("hi")) - upto(F.col("lo"))).alias("has"), (upto(F.col("mid")) - upto(F.col("lo"))).alias("gives")
        )
        start = F.struct(
            F.col("has").alias("n"), F.col("gives").alias("d"), F.array().cast("array<bigint>").alias("out")
        )

        def deal(a: Column, x: Column) -> Column:
            got = hypergeometric(a["n"], x["q"], a["d"], uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["source"]))
            return let(got, lambda g: F.struct((a["n"] - x["q"]).alias("n"), (a["d"] - g).alias("d"), F.concat(a["out"], F.array(g)).alias("out")))

        dealt = node.select("lo", "mid", "hi", "v", "all", F.aggregate("v", start, deal)["out"].alias("g"))
        with_q = lambda f: F.transform("v", lambda x, i: F.struct(x["source"].alias("source"), f(x["q"], F.get(F.col("g"), i)).alias("q")))
        left = F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), with_q(lambda q, g: g).alias("v"))
        right = F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), with_q(lambda q, g: q - g).alias("v"))
        kids = F.when(F.col("hi") - F.col("lo") > 1, F.array(left, right)).otherwise(
            F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), with_q(lambda q, g: q).alias("v")))
        )
        node = dealt.select("all", F.explode(kids).alias("k")).select("k.lo", "k.hi", "k.v", "all")
    leaves = node.select(F.col("lo").alias("shard"), F.explode("v").alias("x")).select("x.source", "shard", "x.q")
    per = leaves.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "q"))).alias("s"))
    ends = F.transform("s", lambda x, i: F.aggregate(F.slice("s", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["q"]))
    return per.select("source", F.concat(F.array(F.lit(0).cast("long")), ends).alias("first_block"))


def mix(
    docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, seed: str = SEED, with_text: bool = False
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, pieces, and text if asked for: one row per input row.

    pieces: array<struct<shard, from_word, words, place>>, the words of the document (from_word may lie beyond size for
    later repeats) that a shard takes and the document's place in the shard's local shuffle. Null text and texts without
    words have size 0 and take nothing; null sources are one source; repeated rows each count. An empty table gives no rows.
    """
    carried = ["text"] if with_text else []
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    sized = stash(
        docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"), *carried).select("*", key.alias("key")), "mix-sizes"
    )
    n_docs = sized.count()
    bits = max(1, math.ceil(math.log2(2 * math.sqrt(max(n_docs, 1)))))
    bucket = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - min(bits, 31))
    rows = sized.select("*", bucket.alias("bucket"))
    targets = stash(source_targets(sized, max_repeat), "mix-targets")
    tree = split_tree(targets, shards, block_words, seed).withColumnRenamed("source", "tree_source")
    sources = stash(targets.join(tree, F.col("source").eqNullSafe(F.col("tree_source"))).drop("tree_source"), "mix-tree")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    begin = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = sums.select("source", "bucket", begin.alias("begin")).join(
        sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s", "n_docs", "weight").select(F.coalesce("source", F.lit("")).alias("b_name"), F.col("source").isNull().alias("b_null"), F.col("bucket").alias("b_bucket"), "begin", "source_size", "target", "first_block")
    rows = rows.select("*", F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"))
    inside = Window.partitionBy("name", "none", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        buckets, (F.col("name") == F.col("b_name")) & (F.col("none") == F.col("b_null")) & (F.col("bucket") == F.col("b_bucket"))
    )
    line = placed.select(
        "doc_id", "source", "size", "source_size", "target", "key", "first_block", *carried,
        (F.col("begin") + F.col("before")).alias("at"), F.floor("target").cast("long").alias("goal"),
    )

    def of_pass(p: Column) -> Column:
        """The document's words [a, b) of the source's line in pass p, by the shards whose runs of blocks they touch."""
        a = p * F.col("source_size") + F.col("at")
        b = F.least(a + F.col("size"), F.col("goal"))

        def piece(i: Column, ends: Column) -> Column:
            lo = F.greatest(ends["a"], F.get("first_block", i) * block_words)
            hi = F.least(ends["b"], F.get("first_block", i + 1) * block_words)
            return F.struct(
                i.alias("shard"), (lo - ends["a"] + p * F.col("size")).alias("from_word"), (hi - lo).alias("words"),
                uniform(F.lit(seed), F.lit("place"), F.col("key"), i, p).alias("place"),
            )

        every = F.sequence(F.lit(0), F.lit(shards - 1))
        return let(
            F.struct(a.alias("a"), b.alias("b")),
            lambda ends: F.when(
                ends["a"] < ends["b"], F.filter(F.transform(every, lambda i: piece(i, ends)), lambda x: x["words"] > 0)
            ).otherwise(F.array().cast("array<struct<shard:int,from_word:bigint,words:bigint,place:double>>")),
        )

    pieces = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max_repeat - 1).cast("long")), of_pass))
    out = line.select("doc_id", "source", "size", "source_size", "target", pieces.alias("pieces"), *carried)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "pieces", *carried)
