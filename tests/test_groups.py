"""Group operators, labels and benchmarks on small cases worked out by hand, and properties."""

from __future__ import annotations

import itertools
import random

import pytest

from ortholens.operators import bench, compare, consensus, dups, groups
from ortholens.operators.annotation import gene_index


def table(spark, rows, cols="group_id string, spp string, gene string"):
    return spark.createDataFrame(rows, cols)


def members(text):
    """`g: a1 b2; h: ...` with the species as the letter."""
    return [(g.strip(), m[0], m) for part in text.split(";") for g, ms in [part.split(":")] for m in ms.split()]


def as_dict(df, key, *values):
    return {r[key]: tuple(r[v] for v in values) if len(values) > 1 else r[values[0]] for r in df.collect()}


def test_every_reference_label(spark):
    ref = table(spark, members("eq: a1 b1; sp: a2 b2; sub: a3 b3; sup: a4 b4; ss: a5 b5 c5; sps: a6 b6; subsup: a7 b7; all: a8 b8 c8; abs: a9 b9; mis: a10 b10"))
    pred = table(spark, members("1: a1 b1; 2: a2; 3: b2; 4: a3; 5: a4 b4 x4; 6: a5; 7: b5; 8: a6 x6; 9: b6; 10: a7 x7; 11: a8 x8; 12: b8; 13: a10 b10"))
    got = as_dict(compare.classify_reference(ref, pred), "group_id", "label")
    assert got == {
        "eq": "Equal", "sp": "Split", "sub": "Subset", "sup": "Superset", "ss": "Split+Subset", "sps": "Split+Superset",
        "subsup": "Subset+Superset", "all": "Split+Subset+Superset", "abs": "Absent", "mis": "Equal",
    }


def test_misplaced_members_do_not_make_a_superset(spark):
    ref = table(spark, members("x: a1 b1; y: a2 b2"))
    pred = table(spark, members("1: a1 b1 a2; 2: b2"))
    got = as_dict(compare.classify_reference(ref, pred), "group_id", "label", "misplaced")
    assert got["x"] == ("Equal", 1)
    assert got["y"] == ("Split", 2)


def test_other_labels(spark):
    other = table(spark, members("eq: a1 b1; spl: a2 b2; sup: a3 b3; sub: a4; con: a5 b5; mis: a6 b6; mg: a7 b7; mh: b7 c9"))
    pred = table(spark, members("1: a1 b1; 2: a2; 3: b2; 4: a3; 5: a4 b4; 6: a5 c5; 7: a7; 8: c9"))
    got = as_dict(compare.classify_other(other, pred), "group_id", "label")
    assert got == {"eq": "Equal", "spl": "Split", "sup": "Superset", "sub": "Subset", "con": "Conflict", "mis": "Missing", "mg": "MultiGroups", "mh": "MultiGroups"}


def test_a_grouping_against_itself(spark):
    g = table(spark, members("1: a1 b1 c1; 2: a2 b2; 3: c3 d3 a3 a4"))
    assert set(as_dict(compare.classify_reference(g, g), "group_id", "label").values()) == {"Equal"}
    assert all(r["f1"] == 1 and r["fp"] == r["fn"] == 0 for r in bench.pair_benchmark(g, g).collect())
    assert all(r["exact"] for r in bench.refog_scores(g, g.limit(0), g).collect())


def test_purity_decides_whether_mixed_pairs_are_true(spark):
    big = " ".join(f"{'ab'[k % 2]}{k}" for k in range(11))
    ref = table(spark, members(f"r: {big} c0; q: c1 d1"))
    over = bench.pair_benchmark(table(spark, members(f"1: {big} c1")), ref)  # 11 of 12 in one group: over 0.9
    assert as_dict(over.where("spp_a = 'a' and spp_b = 'c'"), "spp_a", "tp", "fp")["a"] == (6, 0)
    nine = " ".join(f"{'ab'[k % 2]}{k}" for k in range(9))
    ref = table(spark, members(f"r: {nine} c0; q: c1 d1"))
    at = bench.pair_benchmark(table(spark, members(f"1: {nine} c1")), ref)  # exactly 0.9 is no subset
    assert as_dict(at.where("spp_a = 'a' and spp_b = 'c'"), "spp_a", "tp", "fp")["a"] == (0, 5)


def test_main_group_ties_go_to_the_least_gene(spark):
    m = bench.mapped(table(spark, members("1: a1 b2 a3 b4")), table(spark, members("x: a3 b2; y: a1 b4")))
    assert as_dict(bench.main_groups(m), "pred", "main")["1"] == "y"


def test_rescue(spark):
    ref, pred = table(spark, members("r: a1 b1 c1 d1")), table(spark, members("1: a1 b1; 2: c1 d1"))
    plain = sum(r["fn"] for r in bench.pair_benchmark(pred, ref).collect())
    saved = bench.pair_benchmark(pred, ref, rescue=True).collect()
    assert plain == 4 and sum(r["fn"] for r in saved) == 0 and sum(r["rescued"] for r in saved) == 4


@pytest.mark.parametrize("seed", range(3))
def test_cells_equal_counting_pairs(spark, seed):
    rnd = random.Random(seed)
    genes = [(rnd.choice("abcd"), f"g{k}") for k in range(60)]
    pred = {g: rnd.randrange(8) for g in genes if rnd.random() < 0.9}
    ref = {g: rnd.randrange(8) for g in genes if rnd.random() < 0.9}
    spp = {}
    for (s, _), r in ref.items():
        spp.setdefault(r, set()).add(s)
    ref = {g: r for g, r in ref.items() if len(spp[r]) > 1}
    main = {}
    for p in set(pred.values()):
        n = {}
        for g in pred:
            if pred[g] == p and g in ref:
                n.setdefault(ref[g], []).append(g[1])
        if n:
            best = min(n, key=lambda r: (-len(n[r]), min(n[r])))
            main[p] = (best, len(n[best]) / sum(map(len, n.values())) > 0.9)
    tp = fp = fn = 0
    for x, y in itertools.combinations(genes, 2):
        if x[0] == y[0]:
            continue
        if x in pred and y in pred and pred[x] == pred[y] and x in ref and y in ref:
            m, sub = main[pred[x]]
            good = ref[x] == ref[y] or (sub and m in (ref[x], ref[y]))
            tp, fp = tp + good, fp + (not good)
        if x in ref and y in ref and ref[x] == ref[y] and not (x in pred and y in pred and pred[x] == pred[y]):
            fn += 1
    rows = lambda d: [(str(v), s, g) for (s, g), v in d.items()]
    got = bench.pair_benchmark(table(spark, rows(pred)), table(spark, rows(ref))).collect()
    assert (sum(r["tp"] for r in got), sum(r["fp"] for r in got), sum(r["fn"] for r in got)) == (tp, fp, fn)


def test_curated_scores(spark):
    ref = table(spark, members("x: a1 b1 c1; y: a2 b2; z: a3"))
    pred = table(spark, members("1: a1 b1 d9; 2: c1; 3: a2 u2 b2"))
    unsure = table(spark, [])
    got = as_dict(bench.refog_scores(ref, unsure, pred), "group_id", "tp", "fp", "fn")
    assert got == {"x": (1.0, 2.0, 2.0), "y": (1.0, 2.0, 0.0)}
    for r in bench.refog_scores(ref, unsure, pred).collect():
        assert r["tp"] + r["fn"] == r["size"] * (r["size"] - 1) / 2
    less = as_dict(bench.refog_scores(ref, table(spark, [("y", "b", "b2")]), pred), "group_id", "size")
    assert "y" not in less  # one gene is left


def test_nearest_member_edges(spark):
    rows = [("g", "a", "m", "c", 100, True), ("g", "a", "x", "c", 200, False), ("g", "a", "y", "c", 201, False), ("g", "a", "z", "d", 5, False), ("g", "b", "w", "c", 9, False), ("g", "a", "n", None, None, False)]
    df = spark.createDataFrame(rows, "group_id string, spp string, gene string, chrom string, idx int, is_member boolean")
    got = as_dict(compare.nearest_member(df), "gene", "distance")
    assert got == {"m": None, "x": 100, "y": 101, "z": None, "w": None, "n": None}
    pred = table(spark, [("p", "a", "m")])
    why = as_dict(compare.missing_reasons(df.select("group_id", "spp", "gene"), pred, df.where("idx is not null")), "gene", "reason")
    assert why == {"x": "Sequence Similarity", "y": "Distance", "z": "Different Chromosome", "w": "No Ortholog Detected", "n": "Not in Annotation"}


def test_duplicates_profile_and_multigrouped(spark):
    g = table(spark, members("1: a1 b1; 2: b1 a1; 3: a1 c1; 4: d4; 5: a1 a1 b1"))
    assert sorted(tuple(r) for r in groups.duplicate_groups(g).collect()) == [("2", "1", 2), ("5", "1", 2)]
    assert as_dict(groups.profile(g), "group_id", "single_spp")["4"]
    assert as_dict(groups.multigrouped(g), "gene", "n_groups") == {"a1": 4, "b1": 3}
    assert as_dict(groups.repeated_members(g), "gene", "n_rows") == {"a1": 5, "b1": 3}


def test_consensus_needs_all_methods(spark):
    a, b, c = (table(spark, members(t)) for t in ("1: a1 b1 c1 d1", "x: a1 b1 c1; y: d1", "p: a1 b1; q: c1 d1"))
    assert sorted(r["gene"] for r in consensus.merge_methods(a, b, c).collect()) == ["a1", "b1"]


def test_components_meet_and_stay_apart(spark):
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(20)]
    edges = spark.createDataFrame([*chain, ("z1", "z2"), ("z2", "z1"), ("s", "s")], "a string, b string")
    got = as_dict(consensus.components(edges), "node", "root")
    assert {v for k, v in got.items() if k.startswith("n")} == {"n00"} and got["z2"] == "z1" and "s" not in got
    assert consensus.components(edges.limit(0)).count() == 0


def test_contradictory_pairs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert sorted(tuple(r) for r in consensus.contradictory(edges).collect()) == [("b", "c")]


def test_merged_pairs_cut_try_again_attach_and_drop(spark):
    """O1 meets x and y; x has an own neighbour z, so that N(O1) and N(x) differ at equal size: x is cut, then attached."""
    rows = [("O", "1", "P", "x"), ("O", "1", "P", "y"), ("P", "x", "P", "z"), ("P", "y", "P", "v"), ("P", "y", "P", "w")]
    rows += [("O", "2", "P", "m"), ("O", "2", "P", "n"), ("P", "m", "P", "m2"), ("P", "n", "P", "n2")]  # both cut, all alone
    rows += [("O", "3", "P", "k"), ("O", "3", "P", "k"), ("P", "only", "P", "inner")]  # a repeated pair; genes of one species only
    groups, left = consensus.merge_pairs(spark.createDataFrame(rows, "spp_a string, gene_a string, spp_b string, gene_b string"))
    assert as_dict(groups, "gene", "group_id", "state") == {
        "1": ("O:1", "component"), "y": ("O:1", "component"), "x": ("O:1", "attached"), "3": ("O:3", "component"), "k": ("O:3", "component"),
        "2": ("O:2", "one species"), "m": ("P:m", "one species"), "n": ("P:n", "one species"),
    }
    assert sorted(map(tuple, left.collect())) == [("O:2", "P:m"), ("O:2", "P:n")]
    none, open_ = consensus.merge_pairs(spark.createDataFrame([], "spp_a string, gene_a string, spp_b string, gene_b string"))
    assert none.count() == 0 and open_.count() == 0


def test_merged_pairs_retry_joins_components(spark):
    """a-b is contradictory, but the least genes of their components have neighbourhoods of other sizes."""
    rows = [("A", "0", "B", "a"), ("A", "0", "B", "q"), ("A", "0", "C", "r"), ("B", "a", "C", "b"), ("C", "b", "D", "e")]
    groups, left = consensus.merge_pairs(spark.createDataFrame(rows, "spp_a string, gene_a string, spp_b string, gene_b string"))
    assert {r["group_id"] for r in groups.collect()} == {"A:0"} and left.count() == 0
    edges = spark.createDataFrame([("a", "b"), ("b", "e"), ("0", "a"), ("0", "q"), ("0", "r")], "a string, b string")
    assert [tuple(r) for r in consensus.contradictory(edges).collect()] == [("a", "b")]


def test_segmental_copies(spark):
    g = table(spark, members("1: a1 b1 c1; 2: a2 b2"))
    rows = [("d1", "d", "a1", "b", "b1"), ("d1", "d", None, "c", "c1"), ("d2", "d", "a1", "b", "b2"), ("d3", "d", None, "x", "nope"), ("d4", "d", "a1", "b", "b1"), ("a1", "a", "b1", "c", "c1"), ("r1", "d", "a1", "b", "b1")]
    seg = spark.createDataFrame(rows, "dup_id string, spp string, gene_id string, spp_b string, gene_b string")
    got = as_dict(dups.place_segmental(g, seg, spark.createDataFrame([("r1",)], "gene string")), "gene", "group_id", "state")
    assert got == {"d1": ("1", "S"), "d2": (None, "ambiguous"), "d3": (None, "ambiguous"), "d4": (None, "low support")}


def test_index_breaks_ties_by_gene(spark):
    g = spark.createDataFrame([("a", "g2", "c", 5), ("a", "g1", "c", 5), ("a", "g0", "c", 9)], "spp string, gene string, chrom string, start int")
    assert as_dict(gene_index(g), "gene", "idx") == {"g1": 1, "g2": 2, "g0": 3}


def test_plans_have_no_python_and_no_cartesian_product(spark):
    from ortholens.plans.core import QUERIES

    plan = QUERIES["pair_benchmark"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_groups_that_are_not_valid_raise(spark):
    from ortholens.operators.bench import assert_valid

    genes = spark.createDataFrame([("a", str(k)) for k in range(4)], "spp string, gene string")
    good = spark.createDataFrame([("g1", "a", "0"), ("g1", "a", "1"), ("g2", "a", "2")], "group_id string, spp string, gene string")
    assert_valid(good, genes)
    with pytest.raises(ValueError, match="percent"):
        assert_valid(good.where("gene = '0'"), genes)
    with pytest.raises(ValueError, match=r"several groups: 0 \(2\)"):
        assert_valid(good.union(spark.createDataFrame([("g2", "a", "0")])), genes)
    with pytest.raises(ValueError, match="percent"):
        assert_valid(good.limit(0), genes)


def test_duplicates_by_type(spark):
    g = table(spark, members("1: a1 b1; 2: a1 b1; 3: a1 a2; 4: a1 a2; 5: a1 a2; 6: c1 d1; 7: a1"))
    assert as_dict(groups.duplicate_classes(g), "group_id", "first_group", "type") == {"1": ("1", "ortholog"), "2": ("1", "ortholog"), "3": ("3", "paralog"), "4": ("3", "paralog"), "5": ("3", "paralog")}
    assert as_dict(groups.duplicate_counts(g), "type", "n_groups", "n_genes") == {"ortholog": (2, 2), "paralog": (3, 2), "both": (0, 1)}
    assert groups.duplicate_counts(g.limit(0)).count() == 0
    flags = as_dict(compare.classify_other(g, table(spark, members("p: a1 b1; q: c1 d1 e1"))), "group_id", "duplicate", "resolved", "n_lost", "n_extra", "n_strange")
    assert flags["1"] == (True, True, 0, 0, 0) and flags["6"] == (False, False, 0, 1, 1) and flags["3"] == (True, False, 1, 1, 0)


def test_multi_grouped_genes_have_a_reason(spark):
    g = table(spark, members("1: a1 b1; 2: a1 c1"))
    at = spark.createDataFrame([("a", "a1", "c", 1), ("b", "b1", "c", 2)], "spp string, gene string, chrom string, idx long")
    got = compare.missing_reasons(g, table(spark, members("p: z9")), at)
    assert sorted((r["group_id"], r["gene"], r["reason"]) for r in got.collect()) == [("1", "a1", "Multi-Grouped"), ("1", "b1", "No Ortholog Detected"), ("2", "a1", "Multi-Grouped"), ("2", "c1", "Not in Annotation")]
    only = compare.missing_reasons(g.where("group_id = '1'"), table(spark, members("p: z9")), at, among=g)
    assert {r["gene"]: r["reason"] for r in only.collect()}["a1"] == "Multi-Grouped"
