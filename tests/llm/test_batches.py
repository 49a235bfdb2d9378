"""Operators with numpy inside tasks, archives, and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ortholens.llm import language_id, near_dedup, quality_knn, queries, shingles, substring_dedup, warc
from ortholens.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(k, t, langs[k] if langs else "en", f"s{k % 3}", len(t or ""), "x") for k, t in enumerate(texts)], DOCS)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 6))) for _ in range(n))


def edited(rnd, text, n):
    w = text.split()
    for k in rnd.sample(range(len(w)), n):
        w[k] = "zz" + w[k]
    return " ".join(w)


# -- shingles -----------------------------------------------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_place_or_pieces(monkeypatch):
    a, b = shingles.word_hashes("foo bar  baz\n".encode()), shingles.word_hashes("  baz\tfoo bar é".encode())
    assert a[0] == b[1] and a[1] == b[2] and a[2] == b[0] and len(b) == 4 and len(set(b)) == 4
    texts = ["one two three " * 50, None, "", "x", "four five " * 400]
    whole = [w.tolist() for _, w in shingles.words_of_texts(texts)]
    monkeypatch.setattr(shingles, "PIECE_BYTES", 100)
    assert [w.tolist() for _, w in shingles.words_of_texts(texts)] == whole
    assert [len(w) for w in whole] == [150, 0, 0, 1, 800]


def test_samples_agree_as_often_as_sets_are_similar():
    rnd = np.random.RandomState(0)
    agree, true = [], []
    for _ in range(60):
        h = rnd.randint(1, 2**62, 300).astype(np.uint64)
        a, b = np.sort(h[:250]), np.sort(h[30:280])
        w = {int(x): 0.5 + (int(x) % 100) / 50 for x in h}
        wa, wb = (np.array([w[int(x)] for x in s]) for s in (a, b))
        agree.append((near_dedup.samples(a, np.log(wa)) == near_dedup.samples(b, np.log(wb))).mean())
        true.append(near_dedup.similarity((a, wa), (b, wb)))
    assert abs(np.mean(agree) - np.mean(true)) < 0.03


# -- near duplicates ----------------------------------------------------------------------------------------------------


def test_classes_against_brute_force(spark):
    rnd = random.Random(2)
    base = [prose(rnd, rnd.randrange(60, 200)) for _ in range(40)]
    texts = base + [edited(rnd, t, 2) for t in base[:20]] + [base[0]] * 15 + [edited(rnd, base[1], 1) for _ in range(15)] + [None, "", " ", "", "one two"]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in near_dedup.near_classes(d).collect()}
    sets = [set(zip(*[(t or "").lower().split()[k:] for k in range(5)], strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    wrong = {k: (v["class_id"], find(k)) for k, v in got.items() if v["class_id"] != find(k)}
    assert len(got) == len(texts) and not wrong
    kept = near_dedup.keep_first(d)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(k) for k in range(len(texts))}) and kept.columns == d.columns


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    d = docs(spark, ["a b c d e f g", "a b c d e f g"])
    assert near_dedup.near_classes(d.limit(0)).count() == 0
    twice = d.unionByName(d).unionByName(d.withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((r["doc_id"], r["class_id"]) for r in near_dedup.near_classes(twice).collect()) == [(0, 0), (1, 0)]
    assert near_dedup.keep_first(twice).count() == 4  # both rows of 0 and the two without id


def test_one_bucket_of_unlike_nodes_stays_linear(spark, monkeypatch):
    """Nodes that share one bucket but nothing else meet the fullest one and a few leads, not each other."""
    judged = []
    real = near_dedup.verified

    def counted(likely, *args):
        judged.append(likely.count())
        return real(likely, *args)

    monkeypatch.setattr(near_dedup, "verified", counted)
    monkeypatch.setattr(near_dedup, "POSSIBLE", 0.0)
    rnd = random.Random(8)
    for n in (60, 240):
        judged.clear()
        d = docs(spark, [prose(rnd, 30) for _ in range(n)])
        rows = [(k, [rnd.randrange(1 << 30) for _ in range(near_dedup.SAMPLES)], [7] + [rnd.randrange(1 << 60) for _ in range(near_dedup.BANDS - 1)]) for k in range(n)]
        nodes = spark.createDataFrame(rows, "node long, sig array<int>, keys array<bigint>")
        sent = spark.sparkContext.broadcast(near_dedup.Weights(*near_dedup.frequent_shingles(d)))
        assert near_dedup.links(nodes, d, sent).count() == 0
        assert sum(judged) <= n * (1 + near_dedup.LEADS)


@pytest.mark.parametrize("block", [512, 16])
def test_every_pair_of_one_bucket_is_found(spark, monkeypatch, block):
    """One bucket of 70 unlike texts with 50 near copies among them, no equal samples: neither stars nor leads find the pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd = random.Random(31)
    texts = [prose(rnd, 150) for _ in range(70)]
    texts += [edited(rnd, t, 1) for t in texts[:50]]
    d = docs(spark, texts)
    rows = [(k, [rnd.randrange(1 << 30) for _ in range(near_dedup.SAMPLES)], [7] + [rnd.randrange(1 << 60) for _ in range(near_dedup.BANDS - 1)]) for k in range(120)]
    nodes = spark.createDataFrame(rows, "node long, sig array<int>, keys array<bigint>")
    sent = spark.sparkContext.broadcast(near_dedup.Weights(*near_dedup.frequent_shingles(d)))
    assert sorted((r["a"], r["b"]) for r in near_dedup.links(nodes, d, sent).collect()) == [(k + 70, k) for k in range(50)]


def test_pipeline_drops_every_near_copy_of_one_bucket(spark, monkeypatch):
    """The pipeline's stage, with signatures that share one bucket and no sample."""
    real = near_dedup.signatures
    other = lambda k, salt: F.xxhash64("copy", F.lit(salt + k))
    sig = F.array(*(F.pmod(other(k, 0), F.lit(1 << 30)).cast("int") for k in range(near_dedup.SAMPLES)))
    keys = F.array(F.lit(7).cast("long"), *(other(k, 100) for k in range(near_dedup.BANDS - 1)))
    monkeypatch.setattr(near_dedup, "signatures", lambda *args: real(*args).withColumn("sig", sig).withColumn("keys", keys))
    rnd = random.Random(32)
    texts = [prose(rnd, 150) for _ in range(50)]
    d = docs(spark, texts + [edited(rnd, t, 1) for t in texts[:40]])
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, d, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(50))


def test_large_groups_of_near_copies(spark):
    """Copies of one text with edits of their own: all that are similar to the text are in one class, whatever the group's size."""
    rnd = random.Random(12)
    hub = prose(rnd, 150)
    for n in (20, 150):
        texts = [hub] + [edited(rnd, hub, 1 + k % 2) for k in range(n)] + [prose(rnd, 60) for _ in range(30)]
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, texts)).collect()}
        assert all(got[k] == 0 for k in range(n + 1)) and all(got[k] == k for k in range(n + 1, len(texts)))


# -- passages -----------------------------------------------------------------------------------------------------------


def test_passages_whose_words_also_stand_elsewhere():
    rnd = np.random.RandomState(4)
    say = lambda n: rnd.randint(1, 2**62, n)
    got = lambda x, y: {p[:4] for p in substring_dedup.passages(*(shingles.shingle_hashes(w.astype(np.uint64)) for w in (x, y)))}
    p = say(60)
    # the first words of the passage stand earlier in b
    b = np.concatenate((p[:20], say(100), p, say(30)))
    assert got(np.concatenate((say(40), p, say(10))), b) == {(40, 100, 120, 180)}
    # b holds it three times
    b = np.concatenate((p, say(100), p, say(200), p))
    assert got(p, b) == {(0, 60, 0, 60), (0, 60, 160, 220), (0, 60, 420, 480)}
    # two passages in turn, without a gap in a, near one diagonal and far from it
    q = say(60)
    for n in (55, 300):
        assert {(x[0] // 50, x[2] // 50) for x in got(np.concatenate((p, q)), np.concatenate((p, say(n), q)))} == {(0, 0), (1, (60 + n) // 50)}
    # the second stands before the first
    assert len(got(np.concatenate((p, q)), np.concatenate((q, p)))) == 2
    line = say(10)
    assert got(np.tile(line, 300), np.tile(line, 500)) and got(np.zeros(20000, int), np.zeros(20000, int))
    assert got(say(200), say(200)) == set() and got(say(3), p) == set() == got(p, say(3))


def test_compact_windows_hold_each_subsequence_once():
    rnd = np.random.RandomState(1)
    v = rnd.permutation(60)
    for least in (1, 7):
        w = substring_dedup.compact_windows(v, least)
        for i in range(60):
            for j in range(i + least - 1, 60):
                own = [x for x in w if x[0] <= i <= x[1] <= j <= x[2]]
                assert len(own) == 1 and v[own[0][1]] == v[i : j + 1].min()


def test_compact_windows_of_few_values_are_those_of_the_tree():
    rnd = np.random.RandomState(3)

    def tree(v, l, r, least):
        if r - l < least:
            return []
        c = l + int(v[l:r].argmin())
        return [(l, c, r - 1), *tree(v, l, c, least), *tree(v, c + 1, r, least)]

    for n in (0, 1, 5, 40, 200):
        for kinds in (1, 2, 7, 1000):
            v = rnd.randint(0, kinds, n)
            for least in (1, 4, 46):
                assert sorted(substring_dedup.compact_windows(v, least)) == sorted(tree(v, 0, n, least))
    assert len(substring_dedup.compact_windows(np.ones(300_000), 46)) == 300_000 - 45


def test_likeness_is_the_jaccard_similarity_of_the_ranges():
    rnd = np.random.RandomState(5)
    for kinds in (2, 10, 500):
        a, b = (rnd.randint(0, kinds, n).astype(np.uint64) for n in (80, 60))
        pair = substring_dedup.Pair(a, b)
        for _ in range(40):
            i, k = rnd.randint(0, 79), rnd.randint(0, 59)
            j, m = rnd.randint(i + 1, 81), rnd.randint(k + 1, 61)
            x, y = set(a[i:j].tolist()), set(b[k:m].tolist())
            assert pair.likeness(i, j, k, m) == len(x & y) / len(x | y)


def test_stretches_without_a_chance_are_not_searched():
    """Words that are replaced often enough in both texts rule a passage out; no stretch with a passage is."""
    rnd = np.random.RandomState(9)
    say = lambda n: rnd.randint(1, 2**62, n).astype(np.uint64)
    kept = 0
    for every in (12, 20, 30, 60, 400):
        for _ in range(10):
            a = say(300)
            b = a.copy()
            b[5::every] = say(len(b[5::every]))
            h, index = shingles.shingle_hashes(a), substring_dedup.Index(shingles.shingle_hashes(b))
            own, hit = substring_dedup.Own(h, 46), np.isin(h, index.values)
            spans, may = substring_dedup.chances(own, index, hit, substring_dedup.stretches(hit, 46), 0.8)
            found = substring_dedup.passages(own, index)
            assert all(any(x <= p[0] and p[1] - shingles.WORDS + 1 <= y for x, y in spans) for p in found)
            assert not (may & ~hit).any() and (every < 400 or found) and (every > 12 or not spans)
            kept += bool(spans)
    assert 20 <= kept < 50


def _classes(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("of_table", [True, False])
def test_repeated_passages_against_all_pairs(spark, of_table):
    if of_table:
        d = table(spark, SF, "documents")
    else:  # one passage in many texts, some of them edited at one end, the other or both
        rnd = random.Random(21)
        core, texts = prose(rnd, 90), []
        for k in range(24):
            w = core.split()
            if k % 4 == 1:
                w[:20] = prose(rnd, 20).split()
            if k % 4 == 2:
                w[-20:] = prose(rnd, 20).split()
            if k % 4 == 3:
                w[k] = "zz"
            texts.append(prose(rnd, rnd.randrange(0, 60)) + " " + " ".join(w) + " " + prose(rnd, rnd.randrange(0, 60)))
        d = docs(spark, texts + [prose(rnd, 200) for _ in range(10)])
    rows = d.select("doc_id", "text").where("doc_id is not null").toPandas()
    hashes = {int(rows["doc_id"][i]): shingles.shingle_hashes(w) for i, w in shingles.words_of_texts(rows["text"].tolist())}
    ids = sorted(hashes)
    near = [(a, b) for a in ids for b in ids if a > b and len(np.intersect1d(hashes[a], hashes[b])) and substring_dedup.passages(hashes[a], hashes[b])]
    got = substring_dedup.repeated_passages(d).collect()
    linked = _classes((r["doc_id"], r["mate_doc_id"]) for r in got)
    assert set(linked) == {x for p in near for x in p} == {r["doc_id"] for r in got}
    assert all(linked[a] == linked[b] for a, b in near)
    assert all(r["class_id"] == min(x for x in linked if linked[x] == linked[r["doc_id"]]) for r in got)


@pytest.mark.parametrize("block", [2048, 4])
def test_passages_between_inner_documents_of_groups_are_found(spark, monkeypatch, block):
    """Texts that hold one common line, which is no passage; in the middle of the group, pairs share a passage around the line."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rnd = random.Random(41)
    line, texts = prose(rnd, 30), []
    for k in range(40):
        texts.append(prose(rnd, 60) + " " + line + " " + prose(rnd, 60))
    for k in range(10, 20):  # 14 words before and after the line: too little for a passage without it
        before, after = prose(rnd, 14), prose(rnd, 14)
        for j in (k, k + 10):
            texts[j] = prose(rnd, 60) + " " + before + " " + line + " " + after + " " + prose(rnd, 60)
    got = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    assert {(max(r["doc_id"], r["mate_doc_id"]), min(r["doc_id"], r["mate_doc_id"])) for r in got} == {(k + 10, k) for k in range(10, 20)}
    assert all(r["class_id"] == min(r["doc_id"], r["mate_doc_id"]) for r in got)


def test_shared_counts_are_exact():
    rng = np.random.RandomState(3)
    line = rng.choice(1 << 16, 30, replace=False)
    sets = [np.unique(np.concatenate((line[: rng.randint(31)], rng.choice(3000, rng.randint(0, 400))))) for _ in range(70)]
    for left, right in ((sets, sets), (sets[:9], sets[9:]), (sets[:1], sets[1:2])):
        got = np.array(list(substring_dedup.shared_counts(left, right)))
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]
    for n in (1, 50, 4000):
        h = np.unique(shingles.mix(np.arange(n, dtype=np.uint64)))
        data, same = substring_dedup.packed(h)
        assert substring_dedup.unpacked(data).tolist() == np.unique(h >> np.uint64(48)).tolist() and len(h) == same + len(substring_dedup.unpacked(data))


def test_distinct_counts_against_brute_force():
    rng = np.random.RandomState(5)
    for n, kinds in ((46, 3), (200, 1), (300, 40), (300, 10_000)):
        h = rng.randint(0, kinds, n).astype(np.uint64)
        assert substring_dedup.distinct_counts(h, 46).tolist() == [len(set(h[k : k + 46].tolist())) for k in range(n - 45)]


def test_long_texts_that_share_a_line_are_not_verified(spark, monkeypatch):
    """One line in long texts, which is no passage; bins of all their shingles would agree by chance. Copies are searched once."""
    real, judged = substring_dedup.verified, []

    def counted(pairs, *args):
        judged.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(substring_dedup, "verified", counted)
    rnd = random.Random(43)
    line, other = prose(rnd, 20), prose(rnd, 80)
    texts = [prose(rnd, 500) + " " + line + " " + prose(rnd, 500) for _ in range(30)] + [other + " " + prose(rnd, 30), prose(rnd, 30) + " " + other]
    got = substring_dedup.repeated_passages(docs(spark, texts + texts)).collect()
    assert judged[1] <= 20  # of 435 pairs of texts; 1 653 of documents
    assert {r["doc_id"] for r in got} == set(range(64))
    assert all(r["class_id"] == (30 if r["doc_id"] % 32 >= 30 else r["doc_id"] % 32) for r in got)
    whole = {r["doc_id"]: r for r in got if r["doc_id"] >= 32}
    assert all((r["start"], r["end"], r["mate_doc_id"], r["similarity"]) == (0, len(texts[k - 32].split()), k - 32, 1.0) for k, r in whole.items())


def test_repeated_passages_of_odd_rows(spark):
    rnd = random.Random(8)
    text, other = prose(rnd, 70), prose(rnd, 90)
    rows = [(1, text), (2, text), (None, text), (3, other), (3, other), (4, "a " * 30_000), (5, "a " * 20_000), (6, None), (7, " "), (2**60 + 1, text)]
    d = spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], "doc_id long, text string, a int, b int, v string, start string, n int")
    got = substring_dedup.repeated_passages(d).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 4, 5, 2**60 + 1}
    assert all(r["doc_id"] != r["mate_doc_id"] for r in got)


def test_passages_are_found_and_clean_texts_are_not(spark):
    rnd = random.Random(4)
    shared, other = prose(rnd, 55), prose(rnd, 80)
    texts = [prose(rnd, 100) for _ in range(20)]
    for k in (1, 4, 9):
        texts[k] = prose(rnd, rnd.randrange(5, 90)) + " " + shared + " " + prose(rnd, 40)
    texts[12], texts[13] = prose(rnd, 20) + " " + other, edited(rnd, other, 2) + " " + prose(rnd, 30)
    texts[15], texts[16] = prose(rnd, 60) + " " + " ".join(shared.split()[:30]), prose(rnd, 60)
    d = docs(spark, [*texts, None, "", texts[1]])
    got = substring_dedup.repeated_passages(d).collect()
    assert {r["doc_id"] for r in got} == {1, 4, 9, 12, 13, len(texts) + 2}
    for r in got:
        assert r["end"] - r["start"] >= 50 and r["similarity"] >= 0.8 and r["doc_id"] != r["mate_doc_id"]
    exact = next(r for r in got if {r["doc_id"], r["mate_doc_id"]} == {1, 4})
    assert texts[exact["doc_id"]].split()[exact["start"] : exact["end"]] == texts[exact["mate_doc_id"]].split()[exact["mate_start"] : exact["mate_end"]]
    assert substring_dedup.repeated_passages(d.limit(0)).count() == 0


# -- classifiers --------------------------------------------------------------------------------------------------------


def test_languages_on_held_out_rows(spark):
    d = table(spark, SF, "documents")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9 and got["score"].between(0, 1).all()


def test_language_edges(spark):
    d = docs(spark, [None, "", "123 !!", "ä" * 3, "the cat and the dog", "the bird and the tree"] + ["der Hund und die Katze"] * 4 + ["the man and the sea"] * 4, ["en"] * 6 + ["de"] * 4 + [None] * 4)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(d).collect()}
    assert len(got) == 14 and all(got[k] == ("und", 0.0) for k in (0, 1, 2)) and got[3][0] in ("en", "de")
    assert language_id.identify(d.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(d.limit(0)).count() == 0


def test_predictions_do_not_look_at_labels(spark):
    d = table(spark, SF, "documents")
    hidden = d.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang")))
    rows = lambda x: sorted(map(tuple, language_id.identify(x).collect()))
    assert rows(d) == rows(hidden)


def test_quality_on_held_out_rows(spark):
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality_knn.score(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["quality"] == got["predicted"]).mean() > 0.8
    edge = docs(spark, [None, "", "x" * 30_000])
    assert quality_knn.score(edge, labels).where("score between 0 and 1").count() == 3
    assert {r["score"] for r in quality_knn.score(edge, labels.limit(0)).collect()} == {0.5}


BIG = 1 << 60


def test_large_ids_beside_nulls(spark):
    texts = ["the cat and the dog", "der Hund und die Katze"] * 6
    d = docs(spark, texts, ["en", "de"] * 6).withColumn("doc_id", F.col("doc_id") + BIG + 1)
    d = d.unionByName(docs(spark, ["the bird", None]).withColumn("doc_id", F.lit(None).cast("long")))
    want = sorted(str(r["doc_id"]) for r in d.collect())
    labels = d.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    for got in (language_id.identify(d), quality_knn.score(d, labels)):
        assert sorted(str(r["doc_id"]) for r in got.collect()) == want and dict(got.dtypes)["doc_id"] == "bigint"


# -- archives -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("segment", [50, 333, 65_536])
def test_archives_round_trip(spark, tmp_path, segment):
    html = ["<p>ü" * 200, "<p>ü" * 200, "short", "short", "", None, "x" * 100, "x" * 100, "a\r\n\r\nWARC/1.1\r\n" * 40, "0\r\n\r\n" * 30, "😀" * 777]
    pages = spark.createDataFrame([(10 + k, None if k == 3 else f"http://e/{k}\n", h, "x") for k, h in enumerate(html)], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w{segment}"
    warc.write_warc(pages, path, segment, 64)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == len(html) and all(r["intact"] for r in got.values())
    for k, h in enumerate(html):
        r = got[10 + k]
        assert r["payload_bytes"] == len((h or "").encode())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9 + k) if k in (1, 7) else ("response", None))


def test_broken_segments_are_reported(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 400)], "page_id long, url string, html string")
    rows = warc.records(pages, 200, 64).where("not contains(value, 'WARC-Segment-Number: 3')")
    rows.write.option("lineSep", "\r\n\r\n").text(f"file://{tmp_path}/w")
    r = warc.read_warc(spark, f"file://{tmp_path}/w").first()
    assert r["page_id"] == 1 and not r["intact"] and r["payload_digest"] is None


def test_page_ids_stay_exact(spark, tmp_path):
    rows = [(BIG + k, "u", "z" * 300) for k in (1, 3, 5)] + [(None, "u", "q" * 50)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(p).collect()}
    assert got == {(BIG + 1, "response", None), (BIG + 3, "revisit", BIG + 1), (BIG + 5, "revisit", BIG + 1), (None, "response", None)}
    text = "".join(r["value"] for r in warc.records(p).collect())
    named = [x.split("<")[1].split(">")[0] for x in text.split("\r\n") if x.startswith("WARC-Refers-To")]
    assert len(named) == 2 and all(f"WARC-Record-ID: <{x}>" in text for x in named)


def test_chunks():
    assert warc.dechunk(b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == b"abcde"
    for bad in (b"3\r\nab", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunk(bad)
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def test_repeated_pages_and_empty_tables(spark, tmp_path):
    p = spark.createDataFrame([(1, "u", "y" * 200), (1, "u", "y" * 200), (2, "u", "y" * 200), (None, "u", "y" * 200)], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.round_trip(p).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("None", "revisit", 1)]
    assert warc.round_trip(p.limit(0)).count() == 0


# -- the pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    out = table(spark, SF, "documents")
    columns, n = out.columns, out.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == columns, name
        left = out.count()
        assert 0 < left <= n
        n = left
    mixed = corpus_pipeline.STAGES[-1][1](spark, out, SF).toPandas()
    assert len(mixed) == n and (mixed["taken"] <= 3 * mixed["size"]).all()
    assert isinstance(mixed, pd.DataFrame) and [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "source_mixing"]


def test_every_operator_is_registered_once():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES)
    assert numbers == list(range(1, 11))
