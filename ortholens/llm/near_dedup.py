"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Shingles of five words weigh tf * idf. idf = 1 + DAMP * ln(df / N) / ln(rarest), rarest = max(RARE, LEAST_DF / N): from 1
   for a shingle of all documents to 1 + DAMP for one of RARE of them or fewer. DAMP keeps the few edited shingles of a near
   copy from outweighing what a group of copies that holds a third of all documents shares. Only shingles in at least RARE of
   the documents need a count; they are found exactly in two passes: what is frequent overall is frequent in some partition,
   candidates are then counted over all documents. There are at most (mean length / RARE) of them.
2. Every document draws SAMPLES consistent weighted samples; equal samples have the probability of the weighted Jaccard
   similarity. Bands of ROWS samples are bucket keys. Exact copies are one node throughout.
3. Stars: each bucket's members are compared with its fullest member (whose buckets hold most rows: the middle of a group of
   copies). One comparison a member and bucket, each pair once over all bands.
4. Members whose pair with the fullest one failed are compared with LEADS others of the bucket, all of them where the bucket
   has no more. Pairs whose two ends are linked to the same hub already are left out: the class stays the same.
5. Buckets with more members left are split by 1 + log2(members / leads) further samples at once, and go to 4 with four times
   as many leads. A level costs members * leads at most; members that differ part by the samples, so few come to the next one.
6. Steps 3 to 5 only join most copies at little cost (and look at pairs with POSSIBLE equal samples only). What they leave is
   looked at in full: of each bucket that still holds several classes, every pair of members of different classes is bounded
   by the weights of their shingles in BINS bins, which is never below the similarity; pairs whose bound reaches the least
   similarity are verified. Buckets are dealt in blocks, a pair of blocks at a time.
7. Every pair is verified by the exact weighted Jaccard similarity of the texts before it counts.
8. Connected components over verified pairs give classes.

A pair of similarity 0.8 shares a bucket with probability 0.9998 (0.8 ** ROWS a band); pairs that share one are in one class for
certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ortholens.llm.common import stash, texts_of
from ortholens.llm.shingles import mix, shingle_hashes, words_of_texts
from ortholens.operators.consensus import components

#: Production parameters.
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
RARE, LEAST_DF, DAMP = 0.001, 20, 0.25
POSSIBLE = 20 / 36  # share of equal samples from which a pair is verified before all others are bounded
LEADS = 4
BINS, BLOCK = 256, 512  # of a node's shingle weights; members of a bucket in one block
BROADCAST_SHINGLES = 3_000_000

_rng = np.random.RandomState(7)
_SALT = _rng.randint(1, 2**63 - 1, SAMPLES, dtype=np.int64).astype(np.uint64)
#: Gamma(2, 1) drawn by inversion at the midpoints of equal shares; a shingle's hash picks one.
_u = (np.arange(1 << 14) + 0.5) / (1 << 14)


def _gamma2(u: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), by Newton's method on 1 - (1 + x) exp(-x) = u, in logarithm for the upper tail."""
    lo, hi = np.zeros_like(u), np.full_like(u, 60.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_GAMMA = _gamma2(_u)
_LOG_GAMMA = np.log(_GAMMA)


def samples(shingles: np.ndarray, log_weights: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples of a weighted set, each as a 64-bit value (Ioffe's construction)."""
    out = np.empty(SAMPLES, np.uint64)
    for begin in range(0, SAMPLES, 12):
        x = mix(shingles[None, :] ^ _SALT[begin : begin + 12, None])
        r = _GAMMA[(x & np.uint64(0x3FFF)).astype(np.intp)]
        log_c = _LOG_GAMMA[((x >> np.uint64(14)) & np.uint64(0x3FFF)).astype(np.intp)]
        beta = (x >> np.uint64(28)).astype(np.float64) * 2.0**-36
        t = np.floor(log_weights[None, :] / r + beta)
        log_a = log_c - r * (t - beta + 1)
        best = np.argmin(log_a, axis=1)
        k = np.arange(len(best))
        out[begin : begin + 12] = mix(shingles[best] ^ (t[k, best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def _counted(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, words in words_of_texts(texts):
        yield i, *np.unique(shingle_hashes(words), return_counts=True)


def _texts(batches: Iterator[pd.DataFrame], size: int = 500) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k in range(0, len(b), size):
            yield b.iloc[k : k + size]


def rarest(n: int, rare: float = RARE) -> float:
    """The share of n documents from which on a shingle's own frequency counts."""
    return min(1.0, max(rare, LEAST_DF / max(n, 1)))


def frequent_shingles(docs: DataFrame, rare: float = RARE) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (sorted) and document frequencies of all shingles in at least `rare` of the documents; number of documents.

    A task of the first pass sees about 4 / rare documents or more, so that what is rare in it is no candidate.
    """
    spark = docs.sparkSession
    n = docs.count()
    rare = rarest(n, rare)
    texts = docs.select("text")
    first = texts.coalesce(max(1, int(rare * n / 4)))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # lossy counting: whatever is dropped had fewer than `rare` of the rows seen until then, and what comes (again)
        # after that has missed at most so many
        runs, held, seen, missed = [], 0, 0, 0.0
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merge() -> tuple[np.ndarray, np.ndarray]:
            h, c = np.concatenate([hashes, *runs]), np.concatenate([counts, np.ones(held, np.int64)])
            if not len(h):
                return h, c
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            h, c = h[first], np.add.reduceat(c, first)
            keep = c + missed >= rare * seen
            return h[keep], c[keep]

        for b in _texts(batches):
            for _, h, _c in _counted(b["text"].tolist()):
                runs.append(h)
                held += len(h)
                seen += 1
            if held > 3_000_000:
                hashes, counts = merge()
                runs, held, missed = [], 0, rare * seen
        yield pd.DataFrame({"h": merge()[0].view(np.int64)})

    # what reaches the driver comes as Arrow columns, 8 bytes a hash
    found = stash(first.mapInPandas(local, "h long").distinct(), "near-candidates")
    if found.count() <= BROADCAST_SHINGLES:
        sent = spark.sparkContext.broadcast(np.sort(found.toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64)))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = sent.value
            total = np.zeros(len(known), np.int64)
            for b in _texts(batches):
                for _, h, _c in _counted(b["text"].tolist()):
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        total[at[known[at] == h]] += 1
            full = np.flatnonzero(total)
            yield pd.DataFrame({"h": known[full].view(np.int64), "c": total[full]})

        counted = texts.mapInPandas(count, "h long, c long")
    else:

        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _texts(batches):
                h = [h for _, h, _c in _counted(b["text"].tolist())]
                u, c = np.unique(np.concatenate(h), return_counts=True) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pd.DataFrame({"h": u.view(np.int64), "c": c})

        counted = texts.mapInPandas(emit, "h long, c long").join(found, "h", "left_semi")
    # at most (mean distinct shingles of a document / rare) rows
    top = counted.groupBy("h").agg(F.sum("c").alias("df")).where(F.col("df") >= rare * n).toArrow()
    h = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["df"].to_numpy().astype(np.int64)[order], n


class Weights:
    """ln weight of shingles: tf * idf, idf from the frequent shingles' table."""

    def __init__(self, frequent: np.ndarray, df: np.ndarray, n: int, rare: float = RARE):
        self.frequent = frequent
        floor = np.log(rarest(n, rare))
        self.log_rare = float(np.log1p(DAMP)) if floor < 0 else 0.0
        share = np.log(np.maximum(df, 1) / max(n, 1)) / floor if floor < 0 else np.zeros(len(df))
        self.log_idf = np.log1p(DAMP * np.clip(share, 0, 1))

    def logs(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.log(counts.astype(np.float64)) + self.log_rare
        if len(self.frequent) and len(shingles):
            at = np.minimum(np.searchsorted(self.frequent, shingles), len(self.frequent) - 1)
            hit = self.frequent[at] == shingles
            out[hit] += self.log_idf[at[hit]] - self.log_rare
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets (sorted hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high > 0 else 0.0


def signatures(docs: DataFrame, sent) -> DataFrame:
    """doc_id, copy (hash of the text), sig array<int> (SAMPLES), keys array<long> (one a band); texts without words have none."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, band = sent.value, np.arange(BANDS, dtype=np.uint64)
        for b in _texts(batches):
            texts, ids, copies = b["text"].tolist(), b["doc_id"].tolist(), b["copy"].tolist()
            rows = []
            for i, h, c in _counted(texts):
                if len(h):
                    s = samples(h, weights.logs(h, c))
                    key = mix(s.reshape(BANDS, ROWS)[:, 0] * np.uint64(3) + band)
                    for r in range(1, ROWS):
                        key = mix(key ^ s.reshape(BANDS, ROWS)[:, r])
                    rows.append((ids[i], copies[i], (s & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), key.view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "copy", "sig", "keys"])

    held = docs.where("doc_id is not null").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("copy"), "text")
    return held.mapInPandas(sign, "doc_id long, copy string, sig array<int>, keys array<bigint>")


def alike(x: str, y: str) -> Column:
    """True where enough samples of two signatures are equal."""
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e)) >= int(POSSIBLE * SAMPLES)


def verified(likely: DataFrame, texts: DataFrame, sent, least: float = SIMILARITY) -> DataFrame:
    """a, b, similarity of the pairs (a, b) whose texts are at least that similar, written to the shared folder."""
    both = (
        stash(likely, "near-likely").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = sent.value
        kept: dict[int, tuple] = {}
        for x in _texts(batches, 200):
            sets = {i: (h, np.exp(weights.logs(h, c))) for i, h, c in _counted(x["text_a"].tolist())}
            todo = [k for k, b in enumerate(x["b"].tolist()) if b not in kept]
            fresh = dict(zip(x["b"].to_numpy()[todo].tolist(), todo, strict=True))
            if len(kept) > 300:
                kept = {}
                fresh = dict(zip(x["b"].tolist(), range(len(x)), strict=True))
            names, at = list(fresh), list(fresh.values())
            for i, h, c in _counted(x["text_b"].iloc[at].tolist()):
                kept[names[i]] = (h, np.exp(weights.logs(h, c)))
            s = [similarity(sets[k], kept[b]) for k, b in enumerate(x["b"].tolist())]
            yield pd.DataFrame({"a": x["a"].to_numpy(), "b": x["b"].to_numpy(), "similarity": np.array(s, float)})

    return stash(both.mapInPandas(compare, "a long, b long, similarity double").where(F.col("similarity") >= least), "near-edges")


def hubs(edges: DataFrame, weight: DataFrame) -> DataFrame:
    """node, hub of every node in weight(node, weight): the fullest node within two links that lead to fuller ones.

    Equal hubs mean the same class; unequal ones leave it open.
    """
    w = weight.select(F.col("node").alias("to"), F.col("weight"))
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    top = F.max(F.struct("weight", (-F.col("to")).alias("minus")))
    linked = both.join(w, "to").unionByName(w.select(F.col("to").alias("node"), "to", "weight"))
    one = stash(linked.groupBy("node").agg(top.alias("t")).select("node", (-F.col("t.minus")).alias("hub")), "near-hubs")
    return stash(one.join(one.select(F.col("node").alias("hub"), F.col("hub").alias("over")), "hub").select("node", F.col("over").alias("hub")), "near-hubs")


def histograms(texts: DataFrame, sent) -> DataFrame:
    """node, bins: the weights of each text's shingles, added up in BINS bins, as bytes of float32."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = sent.value
        for b in _texts(batches):
            ids, rows = b["doc_id"].tolist(), []
            for i, h, c in _counted(b["text"].tolist()):
                bins = np.bincount((h % np.uint64(BINS)).astype(np.intp), np.exp(weights.logs(h, c)), BINS)
                rows.append((ids[i], bins.astype(np.float32).tobytes()))
            yield pd.DataFrame(rows, columns=["node", "bins"])

    return texts.select("doc_id", "text").mapInPandas(fill, "node long, bins binary")


def runs(batches: Iterator[pd.DataFrame], by: int) -> Iterator[list[np.ndarray]]:
    """The columns of all consecutive rows that agree in the first `by` (number) columns."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not len(b):
            continue
        x = [b[c].to_numpy() for c in b.columns]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in x[:by]], axis=0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
            if held and any(held[0][k][0] != x[k][low] for k in range(by)):
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append([c[low:high] for c in x])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def in_blocks(rows: DataFrame, key: str, node: str, size: int) -> DataFrame:
    """rows (with n, the number of rows of the key) once for each pair of the key's blocks i <= j that theirs is in, sorted by these."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64(key, node), blocks).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    rest = [c for c in own.columns if c not in (key, "n")]
    dealt = own.select(key, F.explode(pair).alias("p"), *rest).select(key, "p.i", "p.j", *rest)
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def apart(shared: DataFrame, found: DataFrame, texts: DataFrame, sent, least: float) -> DataFrame:
    """a, b (a > b): all pairs of nodes that share a bucket of shared(key, node, n), are in different classes by found(a, b), and
    whose shingle weights by bins do not rule out the similarity."""
    roots = components(found.select("a", "b"))
    member = shared.select("key", "node", "n").join(roots, "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("root"))
    member = stash(member, "near-member")
    open_ = stash(member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"), "near-open")
    member = stash(member.join(open_, "key"), "near-apart")
    own = texts.join(member.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    dealt = in_blocks(member.join(stash(histograms(own, sent), "near-bins"), "node"), "key", "node", BLOCK)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for _, i, j, node, root, bins, block in runs(batches, 3):
            w = np.frombuffer(b"".join(bins), np.float32).reshape(-1, BINS)
            total = w.sum(axis=1)
            left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
            for k in left.tolist():
                # float32 sums may be off by a little
                y = right[(root[right] != root[k]) & (np.minimum(total[right], total[k]) >= (least - 1e-3) * np.maximum(total[right], total[k]))]
                if i[0] == j[0]:
                    y = y[node[y] < node[k]]
                if len(y):
                    low = np.minimum(w[y], w[k]).sum(axis=1)
                    y = y[low >= (least - 1e-3) * (total[y] + total[k] - low)]
                    a.append(np.maximum(node[y], node[k]))
                    b.append(np.minimum(node[y], node[k]))
            if len(a) > 10_000:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    columns = dealt.select("key", "i", "j", "node", "root", "bins", "block")
    return columns.mapInPandas(bound, "a long, b long").distinct()


def links(nodes: DataFrame, docs: DataFrame, sent, least: float = SIMILARITY) -> DataFrame:
    """a, b, similarity: verified pairs of nodes(node, sig, keys) found in the buckets; see the module's text.

    They join all nodes that share a bucket and are similar, directly or through others.
    """
    sigs = nodes.select("node", "sig")
    rows = nodes.select("node", F.posexplode_outer("keys").alias("band", "key")).where("key is not null")
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stash(rows.join(size, "key"), "near-shared")
    weight = stash(shared.groupBy("node").agg(F.sum("n").alias("weight")), "near-weight")
    members = stash(shared.join(weight.join(sigs, "node"), "node").withColumn("used", F.lit(ROWS)), "near-members")
    texts = texts_of(docs, weight.select(F.col("node").alias("n")))
    # the fullest member of each bucket and everyone else in it
    first = F.max(F.struct("weight", (-F.col("node")).alias("minus")))
    star = members.groupBy("key").agg(first.alias("l")).select("key", (-F.col("l.minus")).alias("star"))
    star = star.join(sigs.select(F.col("node").alias("star"), F.col("sig").alias("star_sig")), "star")
    met = stash(members.join(star, "key").where("node <> star").withColumn("alike", alike("sig", "star_sig")).drop("star_sig", "weight"), "near-met")
    found = verified(met.where("alike").select(F.col("node").alias("a"), F.col("star").alias("b")).distinct(), texts, sent, least)
    hub = hubs(found, weight)
    left = met.drop("alike").join(found.select(F.col("a").alias("node"), F.col("b").alias("star")), ["node", "star"], "left_anti")
    leads = LEADS
    while True:
        # buckets whose members all have one hub give no new class
        open_ = members.select("key", "node").join(hub, "node").groupBy("key").agg(F.min("hub").alias("low"), F.max("hub").alias("high")).where("low <> high").select("key")
        active = stash(left.join(hub, "node").join(open_, "key", "left_semi"), "near-active")
        if active.isEmpty():
            break
        slot = F.when(F.col("n") <= leads, F.col("node")).otherwise(F.pmod(F.xxhash64("key", "node"), F.lit(leads)))
        drawn = stash(
            members.select("key", "node", "n").join(active.select("key").distinct(), "key", "left_semi").groupBy("key", slot.alias("slot"))
            .agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node"))["node"].alias("node")).join(hub, "node").join(sigs, "node")
            .groupBy("key").agg(F.collect_list(F.struct("node", "hub", "sig")).alias("leads")),
            "near-drawn",
        )
        each = active.join(drawn, "key").select("node", "hub", "star", "sig", F.explode_outer("leads").alias("lead"))
        each = each.where("lead.node is not null and lead.node <> node and lead.hub <> hub and not (star <=> lead.node)").where(alike("sig", "lead.sig"))
        new = verified(each.select(F.greatest("node", "lead.node").alias("a"), F.least("node", "lead.node").alias("b")).distinct(), texts, sent, least)
        found = found.unionByName(new)
        rest = active.where(F.col("n") > leads).join(drawn.select("key", F.col("leads.node").alias("done")), "key").where(~F.array_contains("done", F.col("node")))
        more = (F.ceil(F.log2(F.col("n") / leads)) + 1).cast("int")
        ring = F.concat("sig", "sig", "sig")  # samples are used in the order that begins with the band's own
        begin = F.pmod(F.col("band") * ROWS + F.col("used"), F.lit(SAMPLES)).cast("int")
        key = F.xxhash64("key", F.slice(ring, begin + 1, F.least(more, F.lit(SAMPLES))))
        deeper = stash(rest.select(key.alias("key"), "band", "node", "sig", (F.col("used") + more).alias("used")), "near-deeper")
        members = stash(deeper.join(deeper.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"), "near-members")
        if members.isEmpty():
            break
        left, leads = members.withColumn("star", F.lit(None).cast("long")), 4 * leads
        if not new.isEmpty():
            hub = hubs(found, weight)
    return found.unionByName(verified(apart(shared, found, texts, sent, least), texts, sent, least))


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, is_first, links: one row per doc_id; class_id is the least doc_id of its near-duplicate class.

    links counts the verified pairs of the document's text with other texts that the search compared. Texts without words
    (null, empty, blank) are in no group: each is its own class. Rows with equal doc_id are one document, and join what their
    texts join. A null doc_id is left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Weights(*frequent_shingles(docs)))
    signed = stash(signatures(docs, sent), "near-signatures")
    nodes = stash(signed.groupBy("copy").agg(F.min("doc_id").alias("node"), F.min("sig").alias("sig"), F.min("keys").alias("keys")), "near-nodes")
    edges = links(nodes.select("node", "sig", "keys"), docs, sent, least)
    roots = components(edges.select("a", "b").unionByName(_same_id(signed, nodes)))
    linked = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    # written first: the join with it then comes straight from two shuffles, and AQE can split large groups of copies
    known = stash(roots.join(linked, "node", "left"), "near-roots")
    member = signed.select("doc_id", "copy").join(nodes.select("copy", "node"), "copy").select("doc_id", "node")
    found = member.join(known, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    every = docs.where("doc_id is not null").select("doc_id", F.lit(None).cast("long").alias("root"), F.lit(0).cast("long").alias("links"))
    return (
        found.unionByName(every).groupBy("doc_id").agg(F.min("root").alias("root"), F.max("links").alias("links"))
        .select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), (F.coalesce("root", "doc_id") == F.col("doc_id")).alias("is_first"), "links")
    )


def _same_id(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between nodes whose rows share a doc_id."""
    own = signed.join(nodes.select("copy", "node"), "copy").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a"))
    return own.where("a <> b").select("a", "b")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class stays, the one with the least doc_id, with all rows of that doc_id; rows without doc_id stay."""
    gone = stash(near_classes(docs).where(~F.col("is_first")).select(F.col("doc_id").alias("__gone")), "near-gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")

