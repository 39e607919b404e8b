"""The pipeline's near-duplicates against brute force over all pairs."""

import random
from collections import Counter

import corpus_pipeline
from kindred.llm import near_copies


def edited(r, words, share):
    return [f"new{r.randrange(10**9)}" if r.random() < share else w for w in words]


def some_rows():
    r = random.Random(7)
    text = lambda k: [f"w{r.randrange(5000)}" for _ in range(k)]
    notice = text(60)
    rows = []
    for _ in range(40):
        base = text(r.randint(20, 200))
        rows += [edited(r, base, s) for s in (0, 0.01, 0.02, 0.03, 0.04)]
    big = text(150)
    rows += [edited(r, big, 0.012) for _ in range(60)] + [notice + text(r.randint(1, 60)) for _ in range(30)]
    docs = [(1000 - i, " ".join(w)) for i, w in enumerate(rows)]
    return docs + [(1, ""), (2, None), (3, "One two"), (4, "one  two"), (5, "one three"), (None, docs[0][1]), (None, "alone"), (7, docs[3][1]), (7, docs[3][1])]


def brute(rows):
    """The component of each row, by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 9 * len(a & b) >= 4 * (len(a) + len(b)) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_stage_keeps_one_of_each_component(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, key string")
    want = {}
    for (doc, _), c in zip(rows, brute(rows)):
        want.setdefault(c, []).append(doc)
    least = [min((d for d in ids if d is not None), default=None) for ids in want.values()]
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(x.doc_id for x in got.collect()) == Counter(least)
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_pipeline_of_an_empty_table_and_of_one_text(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, u long, key string"
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/none/documents.parquet")
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(i, text, "en", "s", len(text), 1, "k") for i in (3, 2, 2)] + [(9, None, None, None, None, None, None)]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/same/documents.parquet")
    for kind in ("none", "same"):
        spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{kind}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{kind}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, f"{tmp_path}/{kind}").columns == docs.columns
        kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
        assert sorted(r.doc_id for r in kept) == ([] if kind == "none" else [2, 9])
        assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
