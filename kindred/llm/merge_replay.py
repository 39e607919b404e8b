"""Byte-level BPE by corpus-level merge replay (operator 3).

The corpus's pre-tokens are counted first, each task counting its own before the exchange. The most frequent of
all are replayed together: their bytes are one linked list, an inverted index leads from the merge that a token pair
would make to the pair's positions, and merges are applied in rank order, each to all its positions; only the two
touched neighbours get new pairs. A merge can make a pair of lower rank; the rest of that word then waits until
the lower one is done, so that the result is that of merging each word by itself, lowest rank first and leftmost
first. The ids of these words, a dictionary of bounded size, go to all tasks, which encode the texts with it; the
rarer words of a batch are replayed together where they are met, by the same function.

Defined cases: a null text is the empty text (no ids); a pre-token that is itself in the vocabulary
is one id; repeated rows, null ids and empty tables pass through; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.chunks import PieceTable, Ragged, piece_counts
from kindred.llm.common import bounded_batches, discard, documents, hold, text_of, written

NONE = 1 << 30
SHIFT = 20
#: Words of the dictionary that all tasks get, and the longest of them in characters: 128 MB at the very most, as a
#: character has four bytes and a byte at most one id; some 15 MB for natural text.
DICTIONARY, LONGEST = 400_000, 20
#: Pieces that a task counts before it passes them on.
COUNTED = 1_000_000


class Vocabulary:
    """Ranks of a byte-level vocabulary: token bytes to id, where the id is also the merge order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << SHIFT | b] = rank
        self.first = np.full((256, 256), NONE, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each word, all words merged together."""
    words_open = [(k, w) for k, w in enumerate(words) if w not in vocabulary.ranks and w]
    out: list[list[int]] = [[vocabulary.ranks[w]] if w in vocabulary.ranks else [] for w in words]
    if not words_open:
        return out
    flat = np.frombuffer(b"".join(w for _, w in words_open), np.uint8)
    lengths = np.array([len(w) for _, w in words_open])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    pair = np.full(len(flat), NONE, np.int64)
    pair[:-1] = vocabulary.first[flat[:-1], flat[1:]]
    pair[ends - 1] = NONE
    following, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
    following[ends - 1] = -1
    before[starts] = -1

    order = np.argsort(pair, kind="stable")
    order = order[: np.searchsorted(pair[order], NONE)]
    at, begin = np.unique(pair[order], return_index=True)
    index = {r: part.tolist() for r, part in zip(at.tolist(), np.split(order, begin[1:]))} if len(at) else {}
    queue = list(index)
    heapq.heapify(queue)

    token = np.array(vocabulary.single)[flat].tolist()
    word_of = np.repeat(np.arange(len(words_open)), lengths).tolist()
    pair, following, before = pair.tolist(), following.tolist(), before.tolist()
    lookup = vocabulary.pairs.get

    def note(rank: int, position: int) -> None:
        pair[position] = rank
        if rank != NONE:
            if rank in index:
                index[rank].append(position)
            else:
                index[rank] = [position]
                heapq.heappush(queue, rank)

    while queue:
        rank = heapq.heappop(queue)
        positions = index.pop(rank)
        positions.sort()
        waiting = -1
        for i in positions:
            if pair[i] != rank:
                continue
            if word_of[i] == waiting:
                note(rank, i)
                continue
            gone = following[i]
            after, previous = following[gone], before[i]
            token[i], following[i], pair[gone] = rank, after, NONE
            lower = False
            if after >= 0:
                before[after] = i
                made = lookup(rank << SHIFT | token[after], NONE)
                lower = made < rank
                note(made, i)
            else:
                pair[i] = NONE
            if previous >= 0:
                made = lookup(token[previous] << SHIFT | rank, NONE)
                lower |= made < rank
                note(made, previous)
            if lower:
                waiting = word_of[i]
    for (k, _), i in zip(words_open, starts.tolist()):
        ids = out[k]
        while i >= 0:
            ids.append(token[i])
            i = following[i]
    return out


class WordIds:
    """Ids of words: those of a dictionary at hand, others by a replay of all that are asked for together."""

    def __init__(self, words: list[str], values: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary):
        self.row = dict(zip(words, range(len(words))))
        self.ids = Ragged("<u4")
        self.ids.add(values, lengths)
        self.vocabulary = vocabulary

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces and how many each has."""
        find, get = self.vocabulary.find, self.row.get
        words: list[str] = []
        counts = []
        for p in pieces:
            found = find(p)
            words += found
            counts.append(len(found))
        rows = [get(w, -1) for w in words]
        missing = list({w for w, r in zip(words, rows) if r < 0})
        kept = self.ids.used, self.ids.rows
        if missing:
            extra = replay([w.encode("utf-8", "surrogatepass") for w in missing], self.vocabulary)
            local = dict(zip(missing, range(self.ids.rows, self.ids.rows + len(missing))))
            lengths = np.fromiter(map(len, extra), np.int64, len(extra))
            self.ids.add(np.fromiter((i for x in extra for i in x), "<u4", int(lengths.sum())), lengths)
            rows = [local[w] if r < 0 else r for w, r in zip(words, rows)]
        values, ends = self.ids.gather(np.array(rows, np.int64))
        self.ids.used, self.ids.rows = kept  # the table of pieces keeps what it asked for
        at = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        return values, np.diff(at)


class Codec:
    """Encodes texts and decodes ids, in a worker."""

    def __init__(self, vocabulary: Vocabulary, dictionary: tuple):
        words, values, lengths = dictionary
        self.vocabulary = vocabulary
        self.table = PieceTable(WordIds(words, values, lengths, vocabulary).of_pieces)
        self.decimal, self.bytes = Ragged("u1"), Ragged("u1")
        for rows, names in ((self.decimal, [b"%d," % i for i in range(len(vocabulary.tokens))]), (self.bytes, vocabulary.tokens)):
            rows.add(np.frombuffer(b"".join(names), np.uint8), np.array([len(n) for n in names]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.table.values(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes.gather(ids)[0].tobytes()

    def joined(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, with commas between them."""
        return self.decimal.gather(ids)[0][:-1].tobytes()


NO_WORDS: tuple = ([], np.zeros(0, "<u4"), np.zeros(0, np.int64))
_CODECS: dict[tuple, Codec] = {}


def _codec(path: str, pattern: str, dictionary: tuple = NO_WORDS, key: str = "") -> Codec:
    hold("merges", _CODECS.clear)
    if (path, key) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, key] = Codec(Vocabulary.load(path, pattern), dictionary)
    return _CODECS[path, key]


def encode_texts(texts: list[str], path: str, pattern: str) -> list[tuple[list[int], str]]:
    """For each text its ids and the same ids in decimal, joined by commas."""
    codec = _codec(path, pattern)
    return [(ids.tolist(), codec.joined(ids).decode()) for ids in codec.encode(texts)]


def corpus_words(texts: DataFrame, pattern: str, longest: int = LONGEST) -> DataFrame:
    """(word, n) over all texts of the one column; words of more than ``longest`` characters are not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        pieces: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            words: dict[str, int] = {}
            get = words.get
            for piece, n in pieces.items():
                for w in find(piece):
                    words[w] = get(w, 0) + n
            pieces.clear()
            kept = [w for w in words if len(w) <= longest]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([words[w] for w in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for found in piece_counts(batch.column(0).to_pylist()):
                pieces.update(found)
                if len(pieces) > COUNTED:
                    yield counted()
        yield counted()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def replayed_dictionary(texts: DataFrame, path: str, pattern: str, size: int = DICTIONARY) -> tuple:
    """The corpus's most frequent words (no more than ``size``, by a least count) with their ids."""
    words = written(corpus_words(texts, pattern), "words")
    counts = words.groupBy("n").count().withColumnRenamed("count", "words")
    # a bounded number of rows: the least counts beyond which no more than ``size`` words have a larger one
    least, held = None, 0
    for r in counts.orderBy(F.desc("n")).limit(size).collect():
        if held + r["words"] > size:
            break
        least, held = r["n"], held + r["words"]
    if least is None:
        discard(words)
        return NO_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path, pattern)
        for batch in batches:
            ids = replay([w.encode() for w in batch.column(0).to_pylist()], vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    chosen = words.where(F.col("n") >= least).select("word")
    rows = chosen.mapInArrow(run, "word string, ids array<int>").toArrow().combine_chunks()
    discard(words)
    lists = rows["ids"].combine_chunks()
    return rows["word"].to_pylist(), lists.flatten().to_numpy().astype("<u4"), lists.value_lengths().to_numpy().astype(np.int64)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, doc_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids again: counts and digests, the ids themselves on demand."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(replayed_dictionary(docs.select(text_of(text_col).alias("text")), path, pattern))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codec = _codec(path, pattern, shared.value, key)
            counts, ids_sha, text_sha, kept = [], [], [], []
            for ids in codec.encode(batch.column(1).to_pylist()):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(codec.joined(ids)).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids.tolist())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    keyed = docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return keyed.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op3_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
