"""Every stage and every document operator on empty tables, odd rows and extra columns whose names clash with inner ones."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from ortholens.llm import queries
from ortholens.llm.common import table

SF = "/root/testdata/sf0.001"
BASE = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
INNER = ("n", "v", "a", "b", "h", "m", "k", "item", "start", "end", "node", "lead", "key", "slot", "hit", "size", "share", "w", "words", "n_words", "kept", "spans")


def good_text(rnd, n):
    """Prose that the quality rules keep."""
    stop = ("the", "of", "and", "to", "in", "is")
    out = []
    for k in range(n):
        out.append(stop[k // 4 % 6] if k % 4 == 0 else "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))))
    return " ".join(out) + "."


def odd_rows():
    rnd = random.Random(17)
    twin = good_text(rnd, 90)
    rows = [(k, good_text(rnd, 80 + k), "en", f"s{k % 2}") for k in range(12)]
    rows += [(20, twin, "en", "s0"), (21, twin, None, None), (21, twin, None, None), (22, None, "en", "s1"), (23, "", "en", "s1"), (24, " \n ", None, "s0")]
    rows += [(25, good_text(rnd, 30_000), "en", "s1"), (2**60 + 1, good_text(rnd, 99), "en", "s0")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *range(len(INNER))) for r in odd_rows()], BASE + "".join(f", `{c}` int" for c in INNER)).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, name):
    d = table(spark, SF, "documents").limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, d, SF)
    assert out.count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == d.columns


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_clashing_columns(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    got, want = stage(spark, odd, SF), stage(spark, plain, SF)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(got) == ids(want)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == odd.columns
    if name == "near_dedup":
        assert len({20, 21} & set(ids(got))) == 1 and 2**60 + 1 in ids(got)
    if name == "quality_rules":
        assert not {22, 23, 24} & set(ids(got)) and set(range(12)) <= set(ids(got))


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if not n.startswith(("op4", "op10", "op11", "op13"))))
def test_query_on_odd_rows(spark, odd, name, tmp_path):
    """op4 and op10 have theirs in test_batches.py, op11 and op13 in test_vectors_and_terms.py. Learners take their labelled rows from the given table."""
    if name.startswith(("op2", "op3")):
        d = table(spark, SF, "documents").unionByName(spark.createDataFrame([r for r in odd_rows() if r[0] > 19], BASE), allowMissingColumns=True)
        labels = table(spark, SF, "labels")
    else:
        d, labels = odd, table(spark, SF, "labels")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    for t, df in {"labels": labels, "benchmark": table(spark, SF, "benchmark")}.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path))
    rows = out.collect()
    if not name.startswith(("op1_", "op12")):
        assert {r["doc_id"] for r in rows} >= {20, 21, 22, 23, 24, 25, 2**60 + 1}
