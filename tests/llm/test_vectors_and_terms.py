"""Exact search, vector codes and the divergence audit against brute force, on odd rows and at small block sizes."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ortholens.llm import divergence as dv
from ortholens.llm import pivot_search, vector_codes
from ortholens.llm.oracles import ORACLES
from ortholens.llm.queries import QUERIES
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
BASE = "vec_id long, embedding array<float>, label int"
#: Names that the operators use inside.
INNER = ("v", "rid", "cell", "salt", "n", "slice", "score", "rank", "position", "entry", "moved", "code", "of", "d", "x")


@pytest.mark.parametrize("name", ["op11_exact_top_k", "op12_source_divergence", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF).toPandas(), connect(SF).sql(ORACLES[name]).df())


def odd_vectors(n=400, width=16, seed=5):
    """Clusters, a third of equal vectors, short, null and broken vectors, repeated ids, null ids and labels."""
    rnd = np.random.default_rng(seed)
    hot = rnd.normal(size=width).astype(np.float32)
    mid = rnd.normal(size=(6, width))
    rows = [(k, (hot if k % 3 == 0 else (mid[k % 6] + 0.1 * rnd.normal(size=width)).astype(np.float32)).tolist(), k % 5 if k % 7 else None) for k in range(n)]
    rows += [(50, rows[50][1], 1), (50, rows[51][1], 2), (None, rows[3][1], None), (100, rows[1][1][: width // 2], 3)]
    rows += [(150, None, 1), (200, [*rows[0][1][:-1], None], 1), (250, [*rows[0][1][:-1], math.nan], 1), (300, [*rows[0][1][:-1], math.inf], 1), (-50, rows[2][1], 4)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *range(len(INNER))) for r in rows], BASE + "".join(f", `{c}` int" for c in INNER)).repartition(5)


def usable(rows, width, scale):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return ok, np.array([[math.floor(scale * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1])) for r in ok], dtype=np.int64)


def best(rows, k=5):
    ok, x = usable(rows, 16, 256)
    out = []
    for i, q in enumerate(ok):
        if q[0] is None or q[0] % 50:
            continue
        scored = sorted((-int(x[i] @ x[j]), c[0] is None, c[0] or 0) for j, c in enumerate(ok) if j != i)[:k]
        out += [(q[0], r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(scored)]
    return Counter(out)


@pytest.mark.parametrize(("few", "block", "queries"), [(256, 4096, 1024), (8, 16, 2)])
def test_top_scores_equal_brute_force(spark, monkeypatch, few, block, queries):
    for name, v in {"FEW": few, "BLOCK": block, "QUERIES": queries}.items():
        monkeypatch.setattr(pivot_search, name, v)
    rows = odd_vectors()
    got = pivot_search.top_scores(frame(spark, rows), sample=40)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == best(rows)


def test_top_scores_of_few_rows(spark):
    rows = odd_vectors()[:3]
    assert Counter(map(tuple, pivot_search.top_scores(frame(spark, rows)).collect())) == best(rows)
    assert pivot_search.top_scores(frame(spark, rows[:1])).count() == 0
    for none in ([], [(1, None, 1)], [(1, [], 1)]):
        assert pivot_search.top_scores(frame(spark, none)).collect() == []


@pytest.mark.parametrize("step", [64, 3])
def test_stopping_skips_what_cannot_reach_the_score(monkeypatch, step):
    """The bound of a far cell lies under the score to beat, so that its vectors are never scored."""
    monkeypatch.setattr(pivot_search, "STEP", step)
    x = np.concatenate([np.full((50, 4), 100), np.full((50, 4), -100)]).astype(np.float64)
    top = float((x**2).sum(1).max())
    pivots = pivot_search.pivots_of(x, top, 4)
    assert len(pivots) == 2

    class Rows(np.ndarray):
        looked: list[int] = []

        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                Rows.looked += at.tolist()
            return np.asarray(self)[at]

    def pack(of, asks):
        n = len(of)
        one = {"rid": np.arange(n) + 1000 * asks, "id": np.arange(n), "named": np.ones(n, bool), "x": of.astype(np.int32), "d": pivot_search.distances(of, pivots, top, asks).astype(np.float32), "least": np.full(n, 39_000)}
        return pivot_search._Pack({k: v.tobytes() for k, v in one.items()}, 4, True)

    q, c = pack(x[:2], True), pack(x, False)
    c.x = c.x.view(Rows)
    assert [scores.tolist() for _, _, scores in pivot_search.best_of(q, c, 5, top)] == [[40_000] * 5] * 2
    assert Rows.looked and max(Rows.looked) < 50


def lloyd(rows, parts=8, entries=16, rounds=6):
    ok, x = usable(rows, 16, 4096)
    order = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, ok[i][1]))
    p = x.reshape(len(ok), parts, -1)
    books = [[p[i, j].tolist() for i in order[:entries]] for j in range(parts)]

    def assign():
        far = np.array([[[((p[i, j] - np.array(e)) ** 2).sum() for e in books[j]] for j in range(parts)] for i in range(len(ok))])
        return far.argmin(2), far.min(2)

    for _ in range(rounds):
        at, _ = assign()
        for j in range(parts):
            for e in range(len(books[j])):
                if (own := p[at[:, j] == e, j]).size:
                    books[j][e] = [int(s) // len(own) for s in own.sum(0)]
    at, far = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error, by = far.sum(1), defaultdict(int)
    for r, e in zip(ok, error, strict=True):
        by[r[2]] += int(e)
    return Counter((r[0], "".join(f"{k:02x}" for k in a), int(e), by[r[2]], digest) for r, a, e in zip(ok, at, error, strict=True))


@pytest.mark.parametrize("held", [65_536, 40])
def test_vector_codes_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(vector_codes, "HELD", held)
    rows = odd_vectors()
    got = vector_codes.vector_codes(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == lloyd(rows)


def test_vector_codes_of_few_rows(spark):
    rows = odd_vectors()[:5]
    assert Counter(map(tuple, vector_codes.vector_codes(frame(spark, rows)).collect())) == lloyd(rows)
    for none in ([], [(1, None, 1)]):
        assert vector_codes.vector_codes(frame(spark, none)).collect() == []
    with pytest.raises(OverflowError):
        vector_codes.vector_codes(frame(spark, [(1, [1e30] * 16, 1)]))


DOC = "doc_id long, text string, lang string, source string"
TEXTS = ["Red fox, red DOG; blue fox", "ÄRGER ärger Straße red\x00dog 12x3", "dog dog dog blue-green", "", None, " 42 \n", "fox_fox a b c A B C", "naïve İstanbul fox"]


def odd_docs(n=240):
    rnd = random.Random(3)
    langs, sources = ["en", "de", None, "", "x y"], ["s0", "s0", "s0", "S1", "é", None, "", "z,\"'"]
    rows = [(k, " ".join(rnd.choice(TEXTS) or "" for _ in range(rnd.randrange(4))) if k % 9 else TEXTS[k % len(TEXTS)], rnd.choice(langs), rnd.choice(sources)) for k in range(n)]
    return rows + rows[:7] + [(900, "only once", "lone", "a"), (901, None, "lone", "b"), (902, "x " * 30 + "Long " * 300_000 + "fox", "en", "far")]


def audit(rows):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")) for _, text, lang, source in rows]
    docs = [(a, s, ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]) for a, s, words in docs]
    df, own = defaultdict(Counter), defaultdict(Counter)
    for a, s, words in docs:
        df[a].update(set(words))
        own[a, s].update(words)
    out = Counter()
    f = lambda p, q: (p - q) ** 2 // q
    ranked = lambda found: sorted(found, key=lambda x: (-x[1], x[0].encode()))
    for a in {d[0] for d in docs}:
        kept = [t for t, n in df[a].items() if n >= 3]
        groups = {s: {t: c[t] for t in kept} for (b, s), c in own.items() if b == a}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        ps = {s: p(c) for s, c in groups.items()}
        q = p({t: sum(c[t] for c in groups.values()) for t in kept})
        for s in groups:
            pair = ranked((o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in groups if o != s)
            term = ranked((t, f(ps[s][t], q[t])) for t in kept if groups[s][t] and ps[s][t] > q[t])
            out.update((a, s, part, item, v, k + 1) for part, found in (("pair", pair), ("term", term[:200])) for k, (item, v) in enumerate(found))
    return out


@pytest.mark.parametrize("postings", [1_000_000, 6])
def test_divergence_equals_brute_force(spark, monkeypatch, postings):
    """With six postings every document spills a run."""
    rows = odd_docs()
    monkeypatch.setattr(dv, "frequencies", lambda docs, f=dv.frequencies: f(docs, 7, postings))
    docs = spark.createDataFrame([(*r, *range(6)) for r in rows], DOC + ", n int, g int, term int, p int, total int, shard int").repartition(6)
    got = dv.divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == audit(rows)


def test_divergence_of_an_empty_table(spark):
    assert dv.divergence(spark.createDataFrame([], DOC)).collect() == []


def test_runs_are_sorted_and_merge_to_the_counts(monkeypatch):
    monkeypatch.setattr(dv, "BLOCK", 2)
    letter = "abcdefg".__getitem__
    docs = [("en", f"s{k % 3}", f"{letter(k % 5)} {letter(k % 7)} {letter(k % 5)}".encode()) for k in range(60)]
    blocks = list(dv.spilled(docs, 3, 8))
    assert len(blocks) > 20 and all(t == sorted(t) for t in (b["terms"].split(b"\0") for b in blocks))
    got = {r["term"]: dict(zip(r["sources"], r["counts"], strict=True)) for r in dv.merged(sorted(blocks, key=lambda b: (b["shard"], b["lang"], b["first"])))}
    want = defaultdict(Counter)
    for _, s, text in docs:
        for w in text.decode().split():
            want[w][s] += 1
    assert {t: c for t, c in got.items() if t} == want and got[""] == {"s0": 0, "s1": 0, "s2": 0}


def test_corrections_in_small_pieces():
    """Pairs cut into pieces of five and handed out early add up to what one piece gives."""
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 9, size=40)
    n = int(sizes.sum())
    ids, zero = np.concatenate([rnd.permutation(12)[:k] for k in sizes]), rnd.integers(1, 50, size=12)
    batch = (sizes, ids, rnd.integers(50, 10**9, size=n), zero[ids])

    def summed(*limits):
        out = Counter()
        for rows in dv.corrected([batch, batch], *limits):
            for g, h, v in rows:
                out[g, h] += v
        return out

    assert summed(5, 5) == summed()
    assert all(g != h for g, h in summed())


def test_terms_of_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(dv, "PIECE", 4)
    assert [w for part in dv.terms_of("Ab cde1fghijk ÉLAN  x".encode()) for w in part] == [w.encode() for w in ("ab", "cde", "fghijk", "Élan", "x")]
