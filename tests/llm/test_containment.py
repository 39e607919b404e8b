"""Likenesses of the sketch report against true containment, by text length."""

import hashlib
import random

import pytest

from kindred.llm import sketches


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def containment(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / min(len(a), len(b)) if a and b else float(a == b)


def test_near_edited_is_true_containment_at_any_length(spark):
    r = random.Random(3)
    sizes = [1, 4, 5, 8, 10, 12, 15, 19, 25, 39, 80, 160, 600] * 4
    r.shuffle(sizes)
    rows = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(n))) for i, n in enumerate(sizes)]
    got = {x.doc_id: x for x in sketches.sketch_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for doc, text in rows:
        after = texts[(doc - 1) % len(rows)]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc].near_edited == pytest.approx(containment(text, edited)), (doc, len(text.split()))
        assert got[doc].near_next == pytest.approx(containment(text, after))


@pytest.mark.parametrize("nulls, rows", [(90, 4), (90, 1), (3, 4), (40, 1000)])
def test_rows_without_an_id_follow_by_hash_over_many_ranges(spark, nulls, rows):
    texts = [(i, f"text {i}") for i in range(30)] + [(None, f"without {i // 2}") for i in range(nulls)] + [(7, "again")]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    ties = {x.t: x.h for x in df.selectExpr("t", "xxhash64(t) AS h").collect()}
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), ties[x[1]]))
    want = sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=str)
    got = sketches.with_next(df, "id", {"t": "n"}, rows, 16)
    assert sorted(((x.id, x.t, x.n) for x in got.collect()), key=str) == want
