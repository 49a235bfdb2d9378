"""What the findings of round 4 are about, each on a case that failed before."""

from __future__ import annotations

import random

import pytest

from ortholens.operators import annotation, consensus


@pytest.mark.parametrize("rows", [("exon", "CDS", "UTR"), ("UTR", "CDS", "exon")])
def test_records_of_one_place_stand_alike_in_any_order(spark, rows):
    """exon and CDS of one gene, place and source were numbered as they happened to be read."""
    records = spark.createDataFrame([("c", 1, f, 5, 9, "R") for f in rows], "chrom string, gene_id long, feature string, start long, end long, source string").coalesce(1)
    got = {r["feature"]: r["place"] for r in annotation.merge(records.where("false"), records).collect()}
    assert got == {"exon": 1, "CDS": 2, "UTR": 3}


def test_stars_are_written_about_once_each(spark, monkeypatch):
    """every round wrote all edges four times over, also when nothing was left to do."""
    edges = spark.createDataFrame([(f"o{k // 4}", f"p{k}") for k in range(400)], "a string, b string")
    seen, write = [], consensus.rewritten

    def counting(df, name):
        out = write(df, name)
        seen.append(out.count())
        return out

    monkeypatch.setattr(consensus, "rewritten", counting)
    found = {r["node"]: r["root"] for r in consensus.components(edges).collect()}
    assert found == {f"p{k}": f"o{k // 4}" for k in range(400)} | {f"o{k}": f"o{k}" for k in range(100)}
    assert sum(seen) <= 4 * 400 + 100


@pytest.mark.parametrize("shape", ["chain", "zigzag", "tree", "hub", "random"])
def test_components_of_many_shapes(spark, shape):
    """the least node is found along chains, across hubs whose name is last, and where hooks stand on hooks."""
    rnd = random.Random(4)
    edges = {
        "chain": [(f"{k:03}", f"{k + 1:03}") for k in range(90)],
        "zigzag": [(f"a{k // 2:03}" if k % 2 else f"z{k // 2:03}", f"z{(k + 1) // 2:03}" if k % 2 else f"a{k // 2:03}") for k in range(80)],
        "tree": [(f"{k:03}", f"{k // 2:03}") for k in range(1, 90)],
        "hub": [("z", f"a{k}") for k in range(50)] + [("y", f"a{k}") for k in range(0, 90, 9)] + [(None, "q"), ("r", "r")],
        "random": [(str(rnd.randrange(150)), str(rnd.randrange(150))) for _ in range(100)],
    }[shape]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    got = consensus.components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in top)


PAIR = "spp_a string, gene_a string, spp_b string, gene_b string"


def test_pairs_are_read_once(spark):
    """the pairs were computed anew for both ends of each neighbourhood and for the edges."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([("A", f"a{k}", "B", f"b{k // 2}") for k in range(40)], PAIR)
    groups, left = consensus.merge_pairs(pairs.mapInArrow(seen, pairs.schema))
    assert groups.count() == 60 and left.count() == 0
    assert read.value == 40


def merged(pairs):
    """Groups and open pairs of merge_pairs, one step after the other; genes are (species, gene)."""
    near = {}
    for x, y in pairs:
        near.setdefault(x, {x}).add(y)
        near.setdefault(y, {y}).add(x)
    across = {tuple(sorted(p)) for p in pairs if p[0][0] != p[1][0]}
    cut = lambda x, y: len(near[x]) == len(near[y]) and near[x] != near[y]

    def rooted(nodes, edges):
        top = {x: x for x in nodes}
        for _ in nodes:
            for x, y in edges:
                top[x] = top[y] = min(top[x], top[y])
        return top

    cuts = {e for e in across if cut(*e)}
    first = rooted({x for e in across for x in e}, across - cuts)
    again = {tuple(sorted((first[x], first[y]))) for x, y in cuts if first[x] != first[y]}
    second = rooted(set(first.values()), {e for e in again if not cut(*e)})
    root = {x: second[r] for x, r in first.items()}
    size = {r: list(root.values()).count(r) for r in root.values()}
    open_ = {(x, y) for x, y in cuts if root[x] != root[y]}
    late = {}
    for x in (x for x in root if size[root[x]] == 1):
        to = {root[b if a == x else a] for a, b in open_ if x in (a, b)}
        if len(to) == 1 and size[min(to)] > 1:
            late[x] = min(to)
    end = {x: late.get(x, r) for x, r in root.items()}
    lonely = {r for r in end.values() if len({x[0] for x in end if end[x] == r}) == 1}
    return {(*x, ":".join(r), "one species" if r in lonely else "attached" if x in late else "component") for x, r in end.items()}, {(":".join(x), ":".join(y)) for x, y in open_ if end[x] != end[y]}


@pytest.mark.parametrize("few", [consensus.FEW, 0])
def test_merged_pairs_equal_one_step_after_the_other(spark, monkeypatch, few):
    """the same groups, states and open pairs as by the plain definition, over many small graphs."""
    monkeypatch.setattr(consensus, "FEW", few)
    groups, left, rows = set(), set(), []
    for seed in range(120):
        rnd = random.Random(seed)
        gene = lambda: (s := rnd.choice("ABC"), f"{s.lower()}{seed}.{rnd.randrange(4)}")  # noqa: B023, E731
        pairs = [(gene(), gene()) for _ in range(rnd.randrange(2, 16))]
        rows += [(*x, *y) for x, y in pairs]
        g, p = merged(pairs)
        groups, left = groups | g, left | p
    assert {s for *_, s in groups} == {"component", "attached", "one species"} and left
    got, open_ = consensus.merge_pairs(spark.createDataFrame(rows, PAIR))
    assert sorted(map(tuple, got.select("spp", "gene", "group_id", "state").collect())) == sorted(groups)
    assert sorted(map(tuple, open_.collect())) == sorted(left)
