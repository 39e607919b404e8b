"""Quality rules, votes, sketches, near-duplicates, repeats, licenses and URLs against brute force, odd rows included."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
import xxhash

from kindred.llm import components, licences, neighbour_votes, quality_rules, queries, recompression, simhash, sketches, url_cascade

WORDS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, doc string, score string, fingerprint string, _row int, spans string, _t string"


def some_rows(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "Die", "é", "日本"]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(70)
    rows = [(100 + i, text(r.randint(0, 150)) + (" \n" + passage + "\t" if i % 5 == 0 else "")) for i in range(n)]
    long = text(3000)
    rows += [(1, long), (2, long), (2, long), (3, long + " tail"), (4, ""), (5, None), (None, passage), (None, None), (6, "one two"), (7, " \n\t "), (8, "x " * 400), (9, "x " * 300 + "y"), (9, passage + " end")]
    return rows


def table(spark, rows):
    full = [(i, t, ("en", "de", None, "xx")[k % 4], None, None if t is None else len(t), "own", "d", "s", "f", k, "sp", "t") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def words_of(text):
    return re.findall(WORDS, text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, some_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_rules_count_like_brute_force(odd, empty):
    got = quality_rules.rule_report(odd).toPandas()
    want = []
    for doc, text in some_rows():
        w, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append((doc if doc is not None else -1, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed))
    found = [(int(r.doc_id) if r.doc_id == r.doc_id else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.itertuples()]
    assert sorted(found) == sorted(want)
    assert not (got.base_failed & got.kept).any()
    assert quality_rules.rule_report(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_rules_reject_what_diverges(spark):
    r = random.Random(2)
    common, rare = quality_rules.COMMON["en"], [f"word{c}" for c in "abcdefgh"]
    clean = [" ".join(r.choice(common) if r.random() < 0.4 else r.choice(rare) + r.choice("xyz") * r.randint(1, 9) for _ in range(200)) for _ in range(80)]
    junk = ["".join(r.choice("#$%|<>&*") for _ in range(5)) + " " + " ".join(f"{r.randint(0, 10**6)}$$" for _ in range(150)) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, kept int")
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(range(80))
    got = quality_rules.rule_report(df).toPandas().set_index("doc_id")

    def distance(p, q):
        p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
        m = (p + q) / 2
        part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
        return np.sqrt((part(p) + part(q)) / 2)

    def hist(text):
        c = Counter(text.split())
        bins = [c[w] for w in common]
        return [*bins, len(text.split()) - sum(bins)]

    every = [hist(t) for t in clean + junk]
    shares = np.array([[1_000_000 * x // sum(h) for x in h] for h in every]).sum(0)
    for i, h in enumerate(every):
        assert got.common_distance[i] == pytest.approx(distance(h, shares), abs=1e-9)


def brute_votes(model, text):
    row = np.zeros(neighbour_votes.TERMS, np.float32)
    at, value = neighbour_votes.terms_of(text)
    row[at] = value
    z = row @ model.projection
    cosine = model.vectors @ (z / max(np.linalg.norm(z), 1e-9))
    near = np.argsort(-cosine)[: neighbour_votes.NEIGHBOURS]
    w = np.maximum(cosine[near].astype(float), 1e-3) ** neighbour_votes.SHARPNESS
    return float((w * model.labels[near]).sum() / w.sum())


def test_terms_are_whole_words_at_every_length():
    at, value = neighbour_votes.terms_of("")
    assert len(at) <= 3
    for n in (99, 100, 101, 5_000):
        words = [f"w{i}x" for i in range(n)]
        terms = set(neighbour_votes.terms_of(" ".join(words))[0])
        assert {neighbour_votes._term(b"w" + w.encode()) for w in words} <= terms
    long = "a" * 200_000
    (one, _), (other, _) = (neighbour_votes.terms_of(long + end) for end in "bc")
    assert set(one) != set(other)
    assert neighbour_votes._term(b"w" + long.encode() + b"b") in one


def test_votes_learn_only_what_they_may(spark, odd, empty):
    r = random.Random(3)
    good = [" ".join(r.choice(["the", "river", "runs", "to", "sea", "and"]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(r.choice(["BUY", "NOW!!", "$$$", "|", "FREE"]) for _ in range(60)) for _ in range(150)]
    rows = list(enumerate(good + bad))
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, score int")
    held = {i for i, _ in rows if crc32(str(i).encode()) % 3 == 1}
    # labels of held-out rows are turned round: to learn from them would spoil the result
    labels = spark.createDataFrame([(i, int((i < 150) != (i in held)), 0) for i, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = neighbour_votes.fit_votes(df, labels)
    assert len(model.labels) == 300 - len(held)
    assert len(neighbour_votes.fit_votes(df, labels, sample=10).labels) == 20
    got = {x.doc_id: x["score_"] for x in neighbour_votes.with_score(df, model, name="score_").collect()}
    for i, t in rows:
        assert (got[i] >= 0.5) == (i < 150)
    for i, t in rows[::29]:
        assert got[i] == pytest.approx(brute_votes(model, t), abs=1e-4)
    kept = neighbour_votes.keep_quality(df, model)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(range(150))
    scores = [x["s"] for x in neighbour_votes.with_score(odd, model, name="s").collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert neighbour_votes.with_score(empty, model, name="s").count() == 0
    none = neighbour_votes.fit_votes(df, labels.limit(0))
    assert {x["s"] for x in neighbour_votes.with_score(odd, none, name="s").collect()} == {0.5}
    one = spark.createDataFrame([(1,), (2,), (None,), (10,)], "doc_id long")
    assert {x[0]: x[1] for x in one.select("doc_id", neighbour_votes.held_out(one.doc_id)).collect()} == {None: False} | {i: crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 10)}


def brute_sketch(text):
    """Shingles as the hashes' inputs: what is shared is compared, not the hashes themselves."""
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("rows, most", [(2000, 1024), (7, 1024), (3, 4), (1, 2), (1, 3)])
def test_next_rows_in_any_number_of_ranges(spark, rows, most):
    ids = [5, 1, 9, 30, 31, 32, 33, 100, 1000, -4, 77, 78, 79, 12, None]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string")
    got = {x.id: x.n for x in sketches.with_next(df, "id", {"t": "n"}, rows, most).collect()}
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_sketches_of_odd_documents(spark, odd, empty):
    got = sketches.sketch_report(odd).toPandas()
    rows = some_rows()
    assert len(got) == len(rows)
    ids = [*sorted({d for d, _ in rows if d is not None}, reverse=True), None]
    edits = Counter()
    for doc, text in rows:
        after = ids[(ids.index(doc) + 1) % len(ids)]  # rows that repeat an id come in the order of a hash
        t = text or ""
        for f in {x or "" for d, x in rows if d in (doc, after)}:
            edits[doc, hashlib.sha256((t[: len(t) - len(t) // 3] + f[: len(t) // 3]).encode()).hexdigest()] += 1
    for r in got.itertuples():
        assert edits[None if r.doc_id != r.doc_id else int(r.doc_id), r.edited_sha256]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    texts = {i: t for i, t in some_rows() if i is not None}
    prints = {int(r.doc_id): r.fingerprint for r in got.itertuples() if r.doc_id == r.doc_id}
    assert prints[1] == prints[2] and prints[4] == prints[5] == prints[7] == "" and len(prints[6]) == 16
    kept = sketches.with_sketch(odd.where("doc_id IN (1, 3)").select("doc_id", "text").distinct(), "text", "k").toPandas().set_index("doc_id").k
    both = len(set(kept[1]) & set(kept[3])) / min(len(kept[1]), len(kept[3]))
    assert both > 0.98 and len(kept[1]) == pytest.approx(len(brute_sketch(texts[1])) / 8, rel=0.3)
    merged = sketches.merge_sketches(sketches.with_sketch(odd.where("doc_id IN (1, 3)").select("doc_id", "text").distinct(), "text", "k").selectExpr("1 AS g", "k"), ["g"], "k").first().k
    assert set(merged) == set(kept[1]) | set(kept[3])
    assert sketches.sketch_report(empty).count() == 0


def brute_fingerprint(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, threshold=4):
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= threshold and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("codes", [((15, 7), (15, 3, 3), (15, 3, 3)), simhash.CODES])
@pytest.mark.parametrize("cell_rows", [16_000, 20])
def test_anchors_miss_no_link(spark, codes, cell_rows):
    r = random.Random(4)
    prints = {0, (1 << 64) - 1, 15, 31}
    for _ in range(40):
        p = r.getrandbits(64)
        prints.add(p)
        for _ in range(5):
            q = p
            for b in r.sample(range(64), r.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(prints)]
    nodes = spark.createDataFrame(signed, "fingerprint long")
    edges = simhash.fingerprint_links(nodes, codes=codes, cell_rows=cell_rows)
    got = {x.node & (1 << 64) - 1: x.component for x in components.connected_components(edges).collect()}
    want = brute_components(sorted(prints))
    groups = lambda m: Counter(frozenset(p for p in prints if m[p] == g) for g in set(m.values()))
    assert groups({p: got.get(p, p - (1 << 64) if p >> 63 else p) for p in prints}) == groups(want)


def test_components_at_once_and_by_rounds(spark, monkeypatch):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(r.randint(-90, -50), r.randint(-90, -50)) for _ in range(25)] + [(100 + i, 100) for i in range(30)] + [(7, 7)]
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    linked = {n for a, b in edges for n in (a, b) if a != b}
    table = spark.createDataFrame(edges, "u long, v long")
    rounds = []
    run_round = components._round
    monkeypatch.setattr(components, "_round", lambda e: rounds.append(1) or run_round(e))
    assert {x.node: x.component for x in components.connected_components(table).collect()} == {n: want[n] for n in linked}
    assert not rounds  # each costs the driver five jobs
    got = {x.node: x.component for x in components.connected_components(table, at_once=10).collect()}
    assert rounds and {n: got.get(n, n) for n in linked} == {n: want[n] for n in linked}
    assert components.connected_components(table.where("u = v")).isEmpty()


def test_classifier_is_not_fitted_in_the_drivers_memory(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    tracemalloc.start()
    try:
        model = neighbour_votes.fit_votes(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.labels) > 20 and model.projection.shape == (neighbour_votes.TERMS, neighbour_votes.LATENT)
    assert peak < 20e6  # a square matrix of all terms has 34 MB
    none = neighbour_votes.fit_votes(docs.where("doc_id < 0"), labels)
    assert not len(none.labels)


def test_codes_cover(spark):
    r = np.random.default_rng(5)
    prints = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    for codes in (((15, 7), (15, 3, 3), (15, 3, 3)), simhash.CODES):
        row, anchor, home = simhash.anchors_of(prints, codes)
        assert home.sum() == 3 * len(prints)
        reach = {(i, a) for i, a in zip(row.tolist(), anchor.tolist())}
        for i, p in enumerate(prints.tolist()):
            near = np.array([p ^ sum(1 << int(b) for b in r.choice(64, 4, replace=False))], np.uint64)
            _, other, at_home = simhash.anchors_of(near, codes)
            assert any((i, a) in reach for a in other[at_home].tolist())


def test_simhash_of_odd_documents(spark, odd, empty):
    got = simhash.simhash_components(odd).toPandas()
    rows = some_rows()
    prints = [brute_fingerprint(t) for _, t in rows]
    labels = brute_components(sorted(set(prints)))
    least = {}
    for (doc, _), p in zip(rows, prints):
        least.setdefault(labels[p], []).append(doc)
    want = Counter((d, format(p, "016x"), min((x for x in least[labels[p]] if x is not None), default=None)) for (d, _), p in zip(rows, prints))
    none = lambda v: None if v != v else int(v)
    assert Counter((none(r.doc_id), r.fingerprint, none(r.component_id)) for r in got.itertuples()) == want
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    found = Counter(labels[brute_fingerprint(x.text)] for x in kept.collect())
    assert set(found) == set(labels.values()) and set(found.values()) == {1}
    assert all(x.doc_id == min(d for d in least[labels[brute_fingerprint(x.text)]] if d is not None) and x.kept == "own" for x in kept.collect() if x.doc_id is not None)
    assert simhash.simhash_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def brute_repeats(rows, window=50):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words_of(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), doc)
    out = []
    for doc, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((doc, [x for x, g in zip(w, gone) if not g], sum(gone)))
    return out


def test_repeats_like_brute_force(odd, empty):
    got = recompression.repeat_report(odd).toPandas()
    want = Counter((d, len(k) + n, n, hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, k, n in brute_repeats(some_rows()))
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()) == want
    assert sum(k[2] * n for k, n in want.items()) > 3000
    cut = recompression.drop_repeats(odd)
    assert cut.columns == odd.columns
    texts = Counter((d, tuple(k)) for d, k, _ in brute_repeats(some_rows()))
    assert Counter((x.doc_id, tuple(words_of(x.text))) for x in cut.collect()) == texts
    assert all(x.n_chars == (None if x.text is None else len(x.text)) and x.kept == "own" for x in cut.collect())
    assert recompression.repeat_report(empty).count() == 0 and recompression.drop_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_repeats_of_periodic_text(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(30):
        unit = [r.choice("ab") for _ in range(r.randint(1, 4))]
        rows.append((i, " ".join((unit * 200)[: r.randint(40, 160)] + [r.choice("abc") for _ in range(r.randint(0, 30))] + ["a"] * r.randint(0, 90))))
    got = recompression.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {(r.doc_id, r.n_removed, r.kept_sha256) for r in got.itertuples()} == {(d, n, hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, k, n in brute_repeats(rows)}


def test_a_window_has_one_key(spark):
    """Keys depend on a window's words alone."""
    r = random.Random(9)
    base = [r.choice(["a", "b", f"w{r.randint(0, 40)}"]) for _ in range(400)]
    seen = {}
    for cut in range(0, 60, 7):
        words = [f"x{cut}"] * cut + base[cut:] + [f"y{cut}"]
        names = recompression.word_names([w.encode() for w in words])
        _, key, _, lo, hi = recompression.chunks(names, np.array([len(words)]))
        for k, a, b in zip(key.tolist(), lo.tolist(), hi.tolist()):
            for p in range(a, b + 1):
                assert seen.setdefault(tuple(words[p : p + 50]), k) == k
    assert len(set(seen.values())) > 20


def test_licences_are_found_and_named(spark, empty):
    filler = " ".join(f"word{i}" for i in range(200))
    rows = [(i, f"{filler}\n{text}\n{filler} license plate") for i, (_, text) in enumerate(licences.TEMPLATES)]
    rows += [(100, None), (101, ""), (102, filler + " a driving license is needed, copyright office closed"), (103, "Released under the MIT License. " * 3), (104, "Permission is hereby granted, free of charge, to any person who obtains a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"), (None, "All rights reserved.")]
    got = licences.license_findings(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")).toPandas()
    by = got.groupby(got.doc_id.fillna(-1)).license.apply(list).to_dict()
    for i, (name, _) in enumerate(licences.TEMPLATES):
        assert name in by.get(i, []), (i, name, by.get(i))
    assert by[103] == ["MIT"] * 3 and by[104] == ["MIT"] and by[-1] == ["All-Rights-Reserved"]
    assert not {100, 101, 102} & set(by)
    assert licences.license_findings(empty).count() == 0


def brute_verdict(url, rules=url_cascade.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_urls_like_brute_force(spark, most):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x?q#f", "https://a.example.org/en/1", "https://a.example.org/en/2", "http://notexample.org/es/", "http://example.org", "http://x.com/fr/", "http://x.com/de/1#a", "http://com/de/", "ftp://é.ORG/?x", "http://org/", "a://b://c.org/", "http://x.com:80/fr/", "http://.org/", "http://x..com/de/"] * 2
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_cascade.url_verdicts(df, max_bytes=most).collect()
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got} == {i: brute_verdict(u) for i, u in enumerate(urls)}
    assert url_cascade.url_verdicts(df.limit(0), max_bytes=most).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    listed = [f"l{i}" for i in range(3000)]
    other = [f"o{i}" for i in range(20_000)]
    bits, url_cascade.BITS = url_cascade.BITS, 3  # many wrong passes, so several levels
    try:
        cascade = url_cascade.build_cascade(spark.createDataFrame([(x,) for x in listed], "key string"), spark.createDataFrame([(x,) for x in listed[:100] + other], "key string"))
    finally:
        url_cascade.BITS = bits
    assert len(cascade.levels) > 2
    assert cascade.contains(listed).all() and not cascade.contains(other).any()


def test_sql_agrees(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    for t in ("documents", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, folder).toPandas(), duckdb.sql(sql).df()
        names = sorted(got.columns)
        a, b = (x[names].sort_values("doc_id" if "doc_id" in names else "page_id").reset_index(drop=True).astype(object) for x in (got, want))
        assert names == sorted(want.columns) and a.where(a.notna(), None).equals(b.where(b.notna(), None)), name


def test_queries_are_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rows = table(spark, some_rows(n=30)).select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns and made.schema.simpleString() == docs.schema.simpleString()
        made.count()
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert isinstance(pieces, pd.DataFrame) and set(packing_columns()) <= set(pieces.columns)
    assert corpus_pipeline.ORACLE_SQL is None


def packing_columns():
    return ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
