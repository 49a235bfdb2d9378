"""Which sources of a language use its words differently: single-pass in-memory indexing, shard merges, pair corrections.

Every task over the documents gathers block postings, (lang, term) -> source -> count, until POSTINGS are held; then it spills
them as a run sorted by (shard, lang, term), cut into blocks of BLOCK terms. Blocks are dealt by shard and arrive in order of
their first term; a heap over the open blocks merges the runs of one shard, so that a task holds one block a run. A term of a
language is whole in its shard: its document count decides there whether it is kept.

The divergence of two sources over all kept terms is summed without touching absent terms: first as if both lacked every
term, then corrected for the counts that either has (by histograms of counts), then for the terms that both have (posting by
posting, in bounded pieces of pairs).

Defined cases: null text, lang and source count as ''. Every row is a document, repeated rows too. Texts are cut into pieces
between terms, so their length does not matter. A language without kept terms has value 0 for all its pairs. Empty tables give
no rows. Columns beside text, lang and source are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ortholens.llm.common import stash

#: Postings that a task holds before it spills a run, terms in one block of a run, bytes of text looked at once.
POSTINGS, BLOCK, PIECE = 1_000_000, 2_000, 1 << 20
#: Pairs of sources that a task corrects at once, and sums that it holds before it hands them out.
PAIRS, SUMS = 1_000_000, 500_000
#: Documents of a language that a kept term needs; ranks reported of part `term`.
LEAST_DOCS, TOP_TERMS = 3, 200

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUN = "shard int, lang string, first binary, terms binary, docs array<bigint>, sizes array<int>, names array<string>, sources array<int>, counts array<bigint>"
_FREQ = "lang string, term string, total bigint, sources array<string>, counts array<bigint>"
_RUN_TYPE = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("terms", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
_FREQ_TYPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of UTF-8 text, piece by piece: letters and all beyond ASCII, A-Z lower-cased."""
    text, at = text.translate(_LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def spilled(docs: Iterable[tuple[str, str, bytes]], shards: int, most: int = POSTINGS) -> Iterator[dict]:
    """Blocks of runs from rows (lang, source, text). The empty term lists the sources of a language, also those without terms."""
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    found: dict[str, Counter] = defaultdict(Counter)
    held = 0

    def run() -> Iterator[dict]:
        posted: dict[str, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        names: dict[str, list[str]] = defaultdict(list)
        for (lang, source), c in counts.items():
            own, code = posted[lang], len(names[lang])
            names[lang].append(source)
            own[b""] += code, 0
            for term, n in c.items():
                own[term] += code, n
        for lang, own in posted.items():
            seed, dealt, docs = zlib.crc32(lang.encode()), defaultdict(list), found[lang]
            for term in sorted(own):
                dealt[zlib.crc32(term, seed) % shards].append(term)
            for shard, terms in dealt.items():
                for k in range(0, len(terms), BLOCK):
                    part = terms[k : k + BLOCK]
                    flat = [own[t] for t in part]
                    both = list(chain.from_iterable(flat))
                    yield {
                        "shard": shard, "lang": lang, "first": part[0], "terms": b"\0".join(part), "docs": [docs[t] for t in part], "sizes": [len(x) // 2 for x in flat],
                        "names": names[lang], "sources": both[::2], "counts": both[1::2],
                    }
        counts.clear()
        found.clear()

    for lang, source, text in docs:
        own, seen, before = counts[lang, source], set(), len(counts[lang, source]) + len(found[lang])
        for words in terms_of(text):
            own.update(words)
            seen.update(words)
        found[lang].update(seen)
        held += len(own) + len(found[lang]) - before
        if held >= most:
            yield from run()
            held = 0
    yield from run()


def merged(blocks: Iterable[dict], least: int = LEAST_DOCS) -> Iterator[dict]:
    """Frequencies of the terms kept, from blocks in order of (shard, lang, first); the empty term always stays."""
    heap: list[tuple[bytes, int, Iterator[tuple], tuple]] = []
    place, now, docs, sums = None, None, 0, {}

    def entries(block: dict) -> Iterator[tuple[bytes, int, list[str], list[int]]]:
        names, at, counts = block["names"], 0, block["counts"]
        sources = [names[s] for s in block["sources"]]
        for term, n, size in zip(block["terms"].split(b"\0"), block["docs"], block["sizes"], strict=True):
            yield term, n, sources[at : at + size], counts[at : at + size]
            at += size

    def done() -> Iterator[dict]:
        if docs >= least or now == b"":
            yield {"lang": place[1], "term": now.decode(), "total": sum(sums.values()), "sources": list(sums), "counts": list(sums.values())}

    def taken(until: bytes | None) -> Iterator[dict]:
        nonlocal now, docs, sums
        while heap and (until is None or heap[0][0] < until):
            term, nr, rest, (_, n, sources, counts) = heap[0]
            if term != now:
                yield from done()
                now, docs, sums = term, n, dict(zip(sources, counts, strict=True))
            else:
                docs += n
                for s, c in zip(sources, counts, strict=True):
                    sums[s] = sums.get(s, 0) + c
            if (x := next(rest, None)) is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (x[0], nr, rest, x))

    for nr, block in enumerate(blocks):
        if (block["shard"], block["lang"]) != place:
            yield from taken(None)
            yield from done()
            place, now, docs = (block["shard"], block["lang"]), None, 0
        yield from taken(block["first"])
        rest = entries(block)
        heapq.heappush(heap, (block["first"], nr, rest, next(rest)))
    yield from taken(None)
    yield from done()


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch of runs; lists of numbers are cut from whole columns."""
    flat = {c: (batch.column(c).flatten().to_numpy().tolist(), batch.column(c).value_lengths().to_pylist()) for c in ("docs", "sizes", "sources", "counts")}
    at = dict.fromkeys(flat, 0)
    for k in range(batch.num_rows):
        row = {c: batch.column(c)[k].as_py() for c in ("shard", "lang", "first", "terms", "names")}
        for c, (values, lengths) in flat.items():
            row[c], at[c] = values[at[c] : at[c] + lengths[k]], at[c] + lengths[k]
        yield row


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def frequencies(docs: DataFrame, shards: int | None = None, postings: int = POSTINGS) -> DataFrame:
    """lang, term, total, sources, counts: each kept term with its count in each source that has it, written to the shared folder.

    The empty term lists all sources of a language. More shards than shuffle partitions even out what a partition gets.
    """
    shards = shards or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py()) for b in batches for k in range(b.num_rows))
        yield from _batches(spilled(rows, shards, postings), _RUN_TYPE, 64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(merged(r for b in batches for r in _blocks(b)), _FREQ_TYPE, 1_000)

    runs = own.mapInArrow(spill, _RUN).repartition("shard").sortWithinPartitions("shard", "lang", "first")
    return stash(runs.mapInArrow(merge, _FREQ), "frequencies")


def _p(n: Column, m: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / m), exact for any counts; null where m is 0."""
    up = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", up, F.nullif(m, F.lit(0)).cast("decimal(19,0)"))


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def corrected(postings: Iterable[list[tuple[np.ndarray, np.ndarray, np.ndarray]]], most: int = PAIRS, sums: int = SUMS) -> Iterator[list[tuple[int, int, int]]]:
    """(g, h, change) from batches of (sizes, ids, p, p of an absent term): what two sources that share a term change in their sum.

    The four values stand for both present, either absent, both absent; each sum of them is far below 2^63.
    """
    held: dict[tuple[int, int], int] = {}
    f = lambda p, q: (p - q) * (p - q) // q
    for sizes, ids, p, zero in postings:
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        each = np.repeat(sizes, sizes)
        ends = np.cumsum(each)
        names, code = np.unique(ids, return_inverse=True)
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            a = np.repeat(np.arange(lo, hi), each[lo:hi])
            b = np.arange(len(a)) - np.repeat(np.cumsum(each[lo:hi]) - each[lo:hi], each[lo:hi]) + first[a]
            a, b = a[a != b], b[a != b]
            change = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
            key = code[a] * len(names) + code[b]
            order = np.argsort(key, kind="stable")
            key, at = np.unique(key[order], return_index=True)
            if len(key):
                for k, v in zip(key.tolist(), np.add.reduceat(change[order], at).tolist(), strict=True):
                    pair = (int(names[k // len(names)]), int(names[k % len(names)]))
                    held[pair] = held.get(pair, 0) + v
            if len(held) >= sums:
                yield [(*k, v) for k, v in held.items()]
                held = {}
            lo = hi
    if held:
        yield [(*k, v) for k, v in held.items()]


def _correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def postings():
        for b in batches:
            col = b.column(0)
            flat, sizes = col.flatten(), np.diff(np.asarray(col.offsets)).astype(np.int64)
            yield sizes, *(np.asarray(x).astype(np.int64) for x in flat.flatten())

    for rows in corrected(postings()):
        for k in range(0, len(rows), 20_000):
            g, h, v = zip(*rows[k : k + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(h, pa.int64()), pa.array([str(x) for x in v])], ["g", "h", "v"])


def divergence(docs: DataFrame, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance from the others of its language, and its own terms.

    p of a term in a group is 1 + floor(10^9 * (count + 1) / (all counts + kept terms)), f = floor((p - q)^2 / q). Part `pair`
    sums f over all kept terms against each other source; part `term` has the terms that the source uses more than its
    language does, to rank top_terms. All arithmetic is on integers; sums over terms are decimals of 38 digits.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    freq = frequencies(docs)
    flat = freq.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    langs = freq.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("kept"), F.sum("total").alias("all"))
    groups = flat.groupBy("lang", "source").agg(F.sum("n").alias("own")).join(langs, "lang")
    m = F.col("own") + F.col("kept")
    groups = stash(
        groups.select("lang", "source", "kept", m.alias("m"), (F.col("all") + F.col("kept")).alias("lang_m"), _p(F.lit(0).cast("bigint"), m).alias("zero"), F.monotonically_increasing_id().alias("g")), "groups"
    )
    known = flat.where("term <> ''").join(groups, ["lang", "source"]).select("g", "lang", "source", "term", "n", "zero", "kept", _p(F.col("n"), F.col("m")).alias("p"), _p(F.col("total"), F.col("lang_m")).alias("q"))

    terms = known.where("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)

    other = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("zero").alias("zero_h"))
    pairs = groups.select("lang", "source", "g", "zero", "kept").join(other, "lang").where("g <> h")
    none = pairs.select("g", "h", wide(F.coalesce(F.col("kept") * wide(_f(F.col("zero"), F.col("zero_h"))), F.lit(0))).alias("v"))
    hist = known.groupBy("lang", "g", "zero", "n", "p").agg(F.count(F.lit(1)).alias("k")).join(other.drop("item"), "lang").where("g <> h")
    zero, zero_h, p = F.col("zero"), F.col("zero_h"), F.col("p")
    one = hist.groupBy("g", "h").agg(
        F.sum(F.col("k") * wide(_f(p, zero_h) - _f(zero, zero_h))).alias("there"), F.sum(F.col("k") * wide(_f(zero_h, p) - _f(zero_h, zero))).alias("back")
    )
    one = one.select(F.explode(F.array(F.struct("g", "h", wide(F.col("there")).alias("v")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), wide(F.col("back")).alias("v")))).alias("x")).select("x.*")
    shared = known.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "zero")).alias("x")).where("size(x) > 1").select("x")
    both = shared.mapInArrow(_correct, "g bigint, h bigint, v string").select("g", "h", wide(F.col("v")).alias("v"))
    value = none.unionByName(one).unionByName(both).groupBy("g", "h").agg(F.sum("v").cast("bigint").alias("value"))
    pairs = pairs.select("g", "h", "lang", "source", "item").join(value, ["g", "h"]).select("lang", "source", "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(terms, "term"))
