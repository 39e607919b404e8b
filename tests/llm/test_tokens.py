"""Token files, packing and byte-level BPE against the libraries themselves."""

import hashlib
import zlib
from base64 import b64decode

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from kindred.llm import merge_replay, packing, token_files  # noqa: E402
from kindred.llm.chunks import PieceTable, library_ids  # noqa: E402

HF, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = st.lists(st.sampled_from(list("abtheZ019.,!'s \n\t\r") + ["\xa0", "\x1c", "é", "日", "<|endoftext|>", "  ", "'ll"]), max_size=60).map("".join)
ROWS = [(3, "the cat sat.\non the mat"), (1, ""), (2, None), (None, "no id"), (5, "word " * 6000), (5, "word " * 6000), (4, "  two  spaces\n\n"), (9, "é" * 3000)]


@pytest.fixture(scope="module")
def libraries():
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(HF)
    model.encode_special_tokens = True
    ranks = {b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return model, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, n_tokens int")


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXTS, min_size=1, max_size=5))
def test_pieces_give_the_library_ids(libraries, texts):
    model, encoding = libraries
    assert [np.frombuffer(x, "<u4").tolist() for x in library_ids(HF, texts)] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [ids for ids, _ in merge_replay.encode_texts(texts, MULTI, P.PATTERN)] == [encoding.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(words=st.lists(st.binary(min_size=1, max_size=24).map(lambda b: bytes(97 + x % 9 for x in b)), min_size=1, max_size=20))
def test_replay_merges_like_each_word_alone(libraries, words):
    vocabulary = merge_replay.Vocabulary.load(MULTI, P.PATTERN)
    got = merge_replay.replay(words, vocabulary)
    assert got == [libraries[1].encode_ordinary(w.decode()) for w in words]
    assert [vocabulary.decode(x) for x in got] == words


def test_replay_waits_for_a_lower_rank():
    single = {bytes([b]): b for b in range(256)}
    # ab (256) makes a pair with c of a lower rank than itself only through the whole token abc
    vocabulary = merge_replay.Vocabulary(single | {b"ab": 300, b"abc": 290, b"abcab": 310}, r"\S+")

    def alone(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            pairs = [(vocabulary.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)]
            if not pairs or min(pairs)[0] == 1 << 30:
                return [vocabulary.ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = [b"abcabcabx", b"xababcab", b"ababab"]
    assert merge_replay.replay(words, vocabulary) == [alone(w) for w in words]


def test_cache_forgets_without_harm():
    def letters(pieces):
        return np.array([ord(c) for p in pieces for c in p], "<u4"), np.array([len(p) for p in pieces])

    table = PieceTable(letters, limit=3)
    texts = ["a b c. d, e f\ng h", "  x  y", "", " lead", "trail \n"]
    for _ in range(3):
        assert ["".join(map(chr, x)) for x in table.values(texts)] == texts


@settings(max_examples=60, deadline=None)
@given(docs_ids=st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=700), min_size=1, max_size=4))
def test_file_round_trip_and_random_access(docs_ids):
    ids = np.array([x for d in docs_ids for x in d], "<u4")
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs_ids])])
    f = token_files.TokenFile(token_files.pack(ids, np.arange(len(docs_ids)), starts))
    assert f.tokens(0, len(ids)).tolist() == ids.tolist()
    for i in range(0, len(ids), 37):
        assert f.token(i) == ids[i] and f.tokens(i, min(len(ids), i + 50)).tolist() == ids[i : i + 50].tolist()
    assert [f.document(k).tolist() for k in range(f.n_docs)] == docs_ids
    with pytest.raises(IndexError):
        f.token(len(ids))


def test_token_files_of_odd_documents(spark, tmp_path, libraries):
    manifest = token_files.write_token_files(docs(spark), f"file://{tmp_path}/t", HF, file_tokens=2000)
    got = token_files.read_token_files(manifest).toPandas().sort_values("start")
    assert manifest.count() > 2
    start = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc, text), r in zip(order, got.itertuples()):
        ids = np.array([*libraries[0].encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert (r.doc_id == doc) or doc is None and np.isnan(r.doc_id)
        start += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []), f"file://{tmp_path}/e", HF)).count() == 0


def test_bpe_query_of_odd_documents(spark, libraries):
    got = merge_replay.bpe_round_trip(docs(spark), MULTI, P.PATTERN, with_ids=True).collect()
    assert len(got) == len(ROWS)
    want = sorted((i is None, i or 0, libraries[1].encode_ordinary(t or "")) for i, t in ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in got) == want
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}
    assert merge_replay.bpe_round_trip(docs(spark, []), MULTI, P.PATTERN).count() == 0


@settings(max_examples=40, deadline=None)
@given(sizes=st.lists(st.integers(1, 64), max_size=60))
def test_levels_are_those_of_least_squares(sizes):
    packer, windows = packing.LevelPacker(64), []
    for n, size in enumerate(sizes):
        def cost(level):
            counts = packer.counts.copy()
            counts[level] -= bool(level)
            counts[level + size] += level + size < 64
            return int((counts[1:64] ** 2).sum())

        open_levels = [0, *[h for h in range(1, 65 - size) if packer.counts[h]]]
        if size < 64:
            assert cost(packer.level_for(size)) == min(map(cost, open_levels))
        if full := packer.place((n, 0, b"abcd" * size)):
            windows.append(full)
    assert all(sum(len(p[2]) // 4 for p in w) == 64 for w in windows)
    opened = [list(w) for level in sorted(packer.open) for w in packer.open[level]][::-1]
    closed = list(packer.rest())
    rest = [sum(len(p[2]) // 4 for p in w) for w in closed]
    full = sum(rest) // 64
    assert [w[: len(o)] for w, o in zip(closed[:full], opened)] == opened[:full]
    assert all(n & (n - 1) == 0 for n in rest)
    assert sum(rest) + 64 * len(windows) == sum(sizes)


def test_packing_of_odd_documents(spark, libraries):
    got = packing.pack_sequences(docs(spark).repartition(2), HF).toPandas()
    for (doc, text), n in {(r, ROWS.count(r)) for r in ROWS}:
        ids = np.array([*libraries[0].encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id.isna() if doc is None else got.doc_id == doc].sort_values("start", kind="stable")
        assert mine.length.sum() == n * len(ids) and set(mine.doc_tokens) == {len(ids)}
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)[:-1]]).tolist()
        total = int(s.length.sum())
        assert total == 2048 or total < 2048 and total & (total - 1) == 0
    assert packing.pack_sequences(docs(spark, []), HF).count() == 0
