"""Removal of repeated word windows by recompression (operator 10).

Rounds over the words of each document name runs of a symbol and pairs of symbols (left class,
right class), so equal stretches of text get equal symbols except near their ends. A name is a
64-bit hash of what it stands for, which makes it global without an exchange of the words. With each
symbol goes its context, the words that decide that it exists; symbols are at most ``CAP`` words long.

A window's key is the least hash among the symbols whose context lies in the window, so it depends
on the window's words alone. Consecutive windows of one key form a chunk. Keys that only one document
has are dropped. Equal chunks are equal text: all but the least document's are repeats. Only where a
key has several different chunks are single windows of one document for each chunk compared. A
window with no such symbol has its own hash as its key, so no window is left out.

Hashes: keys and chunks, or keys and windows, have to agree together (128 bits).

Defined cases: a null text has no words; a null doc_id is neither smaller nor larger than any, so
nothing is removed for it or from it; rows that repeat a doc_id do not remove each other's windows;
an empty table gives no rows; extra columns are ignored, and kept by :func:`drop_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, discard, documents, free_name, hold, text_of, whole_row, written

WINDOW = 50
#: Words that are parsed together, but for longer documents.
PART_WORDS = 200_000
CAP = 12
ROUNDS = 3
#: Widest context of a symbol that can be a key, as a part of the window.
CONTEXT = 0.52

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_TOP = _U(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _M2
    x = (x ^ x >> _U(27)) * _M3
    return x ^ x >> _U(31)


class _Names(dict):
    """Names of words, kept for as many as a worker can hold."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        self[word] = name = xxh64_intdigest(word)
        return name


_NAMES = _Names()


def _own_caches() -> None:
    hold("names", _NAMES.clear)


def word_names(words: list[bytes]) -> np.ndarray:
    return np.array([_NAMES[w] for w in words], np.uint64)


def _merge_runs(name, doc, start, end, left, right, first, last):
    """One step that names runs of up to CAP words; contexts grow by what shows where a run ends."""
    n = len(name)
    near = (doc[1:] == doc[:-1])
    lower, upper = first[doc] - 1, last[doc] + 1
    before, after = lower.copy(), upper.copy()
    before[1:][near] = left[:-1][near]
    after[:-1][near] = right[1:][near]
    same = near & (name[1:] == name[:-1])
    if not same.any():
        return name, doc, start, end, np.minimum(left, before), np.maximum(right, after)
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    count = np.diff(np.append(heads, n))
    tails = heads + count - 1
    width = end[heads] - start[heads]
    merge = (count > 1) & (count * width <= CAP)
    single = count == 1
    keep_all = np.repeat(~merge, count)
    keep = keep_all.copy()
    keep[heads] = True
    new_left, new_right = left.copy(), right.copy()
    at = heads[single]
    new_left[at], new_right[at] = np.minimum(left[at], before[at]), np.maximum(right[at], after[at])
    a, b = heads[merge], tails[merge]
    new_left[a], new_right[a] = np.minimum(left[a], before[a]), np.maximum(right[b], after[b])
    new_name, new_end = name.copy(), end.copy()
    new_name[a] = _mix(name[a] * _M1 + count[merge].astype(np.uint64))
    new_end[a] = end[b]
    long = (count > 1) & ~merge
    if long.any():  # a member of a long run stands for itself if enough of the run is around it
        of = np.repeat(np.arange(len(heads)), count)
        i = np.flatnonzero(long[of])
        need = CAP // width[of[i]] + 1
        lo = i - need // 2
        hi = lo + need - 1
        inside = (lo >= heads[of[i]]) & (hi <= tails[of[i]])
        new_left[i] = np.where(inside, left[np.maximum(lo, 0)], lower[i])
        new_right[i] = np.where(inside, right[np.minimum(hi, n - 1)], upper[i])
    return new_name[keep], doc[keep], start[keep], new_end[keep], new_left[keep], new_right[keep]


def _merge_pairs(name, doc, start, end, left, right, first, last, salt):
    """One step that names pairs of a left-class and a right-class symbol."""
    is_left = (_mix(name + salt) >> _U(63)) == 0
    near = doc[1:] == doc[:-1]
    before, after = first[doc] - 1, last[doc] + 1
    before[1:][near] = left[:-1][near]
    after[:-1][near] = right[1:][near]
    head = np.zeros(len(name), bool)
    head[:-1] = near & is_left[:-1] & ~is_left[1:] & (end[1:] - start[:-1] <= CAP)
    tail = np.zeros(len(name), bool)
    tail[1:] = head[:-1]
    lone = ~head & ~tail
    new_left = np.where(lone & ~is_left, np.minimum(left, before), left)
    new_right = np.where(lone & is_left, np.maximum(right, after), right)
    new_name, new_end = name.copy(), end.copy()
    at = np.flatnonzero(head)
    new_name[at] = _mix(name[at] * _M1 + _mix(name[at + 1] + _M2))
    new_end[at] = end[at + 1]
    new_left[at], new_right[at] = np.minimum(left[at], left[at + 1]), np.maximum(right[at], right[at + 1])
    keep = ~tail
    return new_name[keep], doc[keep], start[keep], new_end[keep], new_left[keep], new_right[keep]


def symbols(names: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS):
    """Symbols of concatenated documents: (name, document, start, end, context start, context end)."""
    last = np.cumsum(lengths)
    first = last - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(names))
    state = (names, doc, at, at + 1, at, at + 1)
    for r in range(rounds):
        state = _merge_runs(*state, first, last)
        state = _merge_pairs(*state, first, last, _U((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return state


def _windows_hash(names: np.ndarray, starts, window: int) -> list[int]:
    from xxhash import xxh3_64_intdigest

    raw = memoryview(np.ascontiguousarray(names)).cast("B")
    return [xxh3_64_intdigest(raw[8 * p : 8 * (p + window)]) for p in starts]


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n modulo 2^64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(names: np.ndarray, lengths: np.ndarray, window: int = WINDOW):
    """Chunks of concatenated documents: (document, key, chunk hash, first window, last window), windows as in the whole."""
    from xxhash import xxh3_64_intdigest

    total = len(names)
    last = np.cumsum(lengths)
    first = last - lengths
    context = int(window * CONTEXT)
    slots = window - context + 1
    _, doc, _, _, left, right = symbols(names, lengths)
    fits = (left >= first[doc]) & (right <= last[doc]) & (right - left <= context)
    left, right = left[fits], right[fits]
    powers, inverse = _powers(_BASE, total), _powers(_INVERSE, total)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * powers[:-1], dtype=np.uint64)])
    key = _mix((sums[right] - sums[left]) * inverse[left] + (right - left).astype(np.uint64))
    least = np.full(total + slots, _TOP)
    np.minimum.at(least, left, key)
    step, have = 1, least
    while 2 * step <= slots:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    have = np.minimum(have[: total], have[slots - step : slots - step + total])

    valid = np.zeros(total + 1, np.int64)
    long = lengths >= window
    np.add.at(valid, first[long], 1)
    np.add.at(valid, last[long] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:total]) > 0)
    if not len(at):
        return (np.empty(0, np.int64),) * 5
    owner = np.repeat(np.arange(len(lengths)), lengths)[at]
    key = have[at]
    bare = np.flatnonzero(key == _TOP)
    if len(bare):
        key = key.copy()
        key[bare] = np.array(_windows_hash(names, at[bare].tolist(), window), np.uint64)
    change = np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])
    heads = np.flatnonzero(change)
    lo, hi = at[heads], at[np.append(heads[1:], len(at)) - 1]
    raw = memoryview(np.ascontiguousarray(names)).cast("B")
    chunk = np.array([xxh3_64_intdigest(raw[8 * a : 8 * (b + window)]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64)
    return owner[heads], key[heads], chunk, lo, hi


def _chunk_table(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_caches()
        for batch in batches:
            words = [t.encode("utf-8", "surrogatepass").split() for t in batch.column(2).to_pylist()]
            ends = np.cumsum([len(w) for w in words])
            for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(ends // PART_WORDS)) + 1):
                yield from chunk_rows(batch.take(pa.array(part)), [words[i] for i in part])

    def chunk_rows(batch: pa.RecordBatch, words: list) -> Iterator[pa.RecordBatch]:
        words = [w if len(w) >= window else [] for w in words]
        lengths = np.array([len(w) for w in words], np.int64)
        if not lengths.sum():
            return
        names = np.concatenate([word_names(w) for w in words])
        owner, key, chunk, lo, hi = chunks(names, lengths, window)
        begin = (np.cumsum(lengths) - lengths)[owner]
        rows = [batch.column(0).to_numpy()[owner], batch.column(1).to_numpy()[owner], key.view(np.int64), chunk.view(np.int64), (lo - begin).astype(np.int32), (hi - begin).astype(np.int32)]
        for i in range(0, len(owner), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(r[i : i + 50_000]) for r in rows], ["doc", "row", "key", "chunk", "lo", "hi"])

    return keyed.where(F.col("doc").isNotNull()).mapInArrow(run, "doc long, row long, key long, chunk long, lo int, hi int")


def _window_table(asked: DataFrame, window: int) -> DataFrame:
    """Rows (key, chunk, doc, offset, hash) for the asked chunks of each document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                names = word_names(text.encode("utf-8", "surrogatepass").split())
                for x in wanted:
                    n = x["hi"] - x["lo"] + 1
                    out[0] += [x["key"]] * n
                    out[1] += [x["chunk"]] * n
                    out[2] += [doc] * n
                    out[3] += range(n)
                    out[4] += _windows_hash(names, range(x["lo"], x["hi"] + 1), window)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(np.array(out[4], np.uint64).view(np.int64))], ["key", "chunk", "doc", "offset", "hash"])

    return asked.mapInArrow(run, "key long, chunk long, doc long, offset int, hash long")


def repeated_windows(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, row, spans) for the documents with repeats; spans are first and last windows to remove."""
    table = written(_chunk_table(keyed, window), "chunks")
    distinct = table.groupBy("key", "chunk").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    # a key of one document only has nothing to remove; a key of one chunk needs no look at its windows
    of_key = distinct.groupBy("key").agg(F.count("*").alias("n"), F.min("least").alias("a"), F.max("most").alias("b")).where("a < b")
    shared = distinct.join(of_key.select("key", "n"), "key").select("key", "chunk", "least", "n")
    found = written(table.join(shared, ["key", "chunk"]), "shared")
    discard(table)

    one = found.where("n > 1 AND doc = least").groupBy("key", "chunk", "doc").agg(F.min(F.struct("row", "lo", "hi")).alias("rep"))
    asked = one.groupBy("doc", "rep.row").agg(F.collect_list(F.struct("key", "chunk", "rep.lo", "rep.hi")).alias("wanted"))
    texts = keyed.join(asked, ["doc", "row"]).dropDuplicates(["doc", "row"])
    windows = written(_window_table(texts.select("doc", "text", "wanted"), window), "windows")
    least = windows.groupBy("key", "hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    later = windows.join(least, ["key", "hash"]).where("least < doc").groupBy("key", "chunk").agg(F.collect_set("offset").alias("offsets"))

    whole = found.where("doc > least").select("doc", "row", F.struct("lo", "hi").alias("span"))
    offset = F.col("lo") + F.col("offset")
    single = found.where("doc = least").join(later, ["key", "chunk"]).withColumn("offset", F.explode("offsets")).select("doc", "row", F.struct(offset.alias("lo"), offset.alias("hi")).alias("span"))
    return whole.union(single).groupBy("doc", "row").agg(F.collect_list("span").alias("spans"))


def _removed(n: int, spans: list | None, window: int) -> np.ndarray | None:
    """Which of n words are covered by a removed window; None: no word."""
    if not spans:
        return None
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [s["lo"] for s in spans], 1)
    np.add.at(edge, [s["hi"] + window for s in spans], -1)
    return np.cumsum(edge[:n]) > 0


def _keyed(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(doc_col).cast("long").alias("doc"), F.xxhash64(text_of(text_col)).alias("row"), text_of(text_col).alias("text"))


def repeat_report(docs: DataFrame, window: int = WINDOW, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, doc_col, text_col)
    spans = repeated_windows(keyed, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                gone = _removed(len(words), found, window)
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                if gone is not None:
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = keyed.join(spans, ["doc", "row"], "left").select(F.col("doc").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, window: int = WINDOW, doc_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated words cut out of the text (white space before them goes too); a text
    without repeats stays as it is, and ``count_col`` follows a changed text."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, doc_col, text_col)
    spans = repeated_windows(keyed, window)
    names = docs.columns
    tagged = docs.select(whole_row(docs).alias("whole"), F.col(doc_col).cast("long").alias("doc"), F.xxhash64(text_of(text_col)).alias("row"))
    joined = tagged.join(spans, ["doc", "row"], "left").select("whole.*", F.col("spans").alias(free_name(docs, "spans")))
    at, count = names.index(text_col), names.index(count_col) if count_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for batch in batches:
            columns = batch.columns[:-1]
            texts = columns[at].to_pylist()
            changed = False
            for k, found in enumerate(batch.column(len(columns)).to_pylist()):
                if not found:
                    continue
                raw = texts[k].encode("utf-8", "surrogatepass")
                places = [m.span() for m in word.finditer(raw)]
                gone = _removed(len(places), found, window)
                kept, begin = [], 0
                for (_, end), g in zip(places, gone.tolist()):
                    if not g:
                        kept.append(raw[begin:end])
                    begin = end
                texts[k] = b"".join(kept).strip(b" \t\n\x0b\x0c\r").decode("utf-8", "surrogatepass")
                changed = True
            if changed:
                columns = list(columns)
                columns[at] = pa.array(texts, columns[at].type)
                if count is not None:
                    old = columns[count].to_pylist()
                    spanned = batch.column(len(columns)).to_pylist()
                    columns[count] = pa.array([len(t) if s else o for t, s, o in zip(texts, spanned, old)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, schema)


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(documents(spark, sf_dir))


OP10_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM texts, unnest(range(1, len(ws) - 48)) AS t(i)
), least AS (
  SELECT g, min(doc_id) AS d FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM windows JOIN least USING (g) WHERE d < doc_id
), lists AS (
  SELECT doc_id, count(*) AS n, list(j) AS js FROM gone GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM texts
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY j) AS k FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM texts LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
