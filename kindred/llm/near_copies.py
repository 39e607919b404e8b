"""Near-duplicates by the Jaccard similarity of their word shingles: the pipeline's stage, on top of operator 8.

A document's SimHash fingerprint over the same shingles is linked by operator 8's anchor-point covering. At a similarity
of 0.8 some ten of 64 bits differ, which no covering of 64 bits finds without comparing nearly all, so least hashes add
candidates: ``BANDS`` keys of ``ROWS`` least hashes each, of which two sets of similarity 0.8 share one with probability
0.997. Documents of the same set are one node. Those that meet at a key are compared by a short signature, and a
spanning forest of the likeliest links goes on, never all pairs; a key with many nodes is dealt out as a grid of
cells. Each link is confirmed on the shingle sets of the texts.

Defined cases: a null or empty text has the empty set, and all empty sets are alike; a text of fewer words than a
shingle is one shingle; ASCII letters count as lower case; a null doc_id stays only where no row of its component
has an id; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, discard, hold, whole_row, written
from kindred.llm.components import connected_components
from kindred.llm.simhash import fingerprint_links

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Keys of a document, least hashes in each, and the bytes that estimate a similarity.
BANDS, ROWS, SIGNATURE = 20, 6, 60
#: Deviations by which an estimate may fall short before a link is not tried.
SLACK = 3.0
#: Nodes at a key beyond which it is dealt out as a grid of cells.
CELL_ROWS = 8_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a text's shingles in ascending order, and how often each occurs."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64), np.ones(1, np.int64)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-size]]]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64), return_counts=True)


def simhash(hashes: np.ndarray, counts: np.ndarray) -> int:
    """The fingerprint of operator 8 from distinct hashes and their counts."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += counts[i : i + 65_536] @ bits
    return int(np.packbits(2 * ones > counts.sum(), bitorder="little").view("<u8")[0])


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """For each multiplier the least product; all ones for the empty set."""
    out = np.full(len(_ODD), ~np.uint64(0))
    for i in range(0, len(hashes), 512):
        np.minimum(out, (hashes[i : i + 512, None] * _ODD).min(axis=0), out=out)
    return out


def _nodes(keyed: DataFrame, size: int) -> DataFrame:
    """_doc, _id, _row with the set's hash, its size, its fingerprint, signature and keys."""
    from xxhash import xxh64_intdigest

    number = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weights = _ODD[::-1].reshape(BANDS, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("copies", int)
        for batch in batches:
            keys, sizes, prints, marks, bands = [], [], [], [], []
            for text in batch.column(3).to_pylist():
                own, counts = shingles(text, size)
                least = least_hashes(own)
                keys.append(xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                prints.append(simhash(own, counts))
                marks.append((least >> np.uint64(20)).astype(np.uint8)[:: len(least) // SIGNATURE].tobytes())
                bands.append(((least.reshape(BANDS, ROWS) ^ least.reshape(BANDS, ROWS) >> np.uint64(29)) * weights).sum(axis=1) + number)
            offsets = np.arange(0, BANDS * len(keys) + 1, BANDS, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *bands]).view(np.int64)))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, prints)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], longs[0], pa.array(sizes, pa.int32()), longs[1], pa.array(marks, pa.binary()), lists], ["_doc", "_id", "_row", "key", "n", "fp", "mark", "bands"])

    return keyed.select("_doc", "_id", "_row", "_text").mapInArrow(run, "_doc long, _id long, _row long, key long, n int, fp long, mark binary, bands array<long>")


def _print_links(nodes: DataFrame) -> DataFrame:
    """Links of operator 8 between nodes: nodes of one fingerprint with the least of them, and those of linked fingerprints."""
    least = nodes.groupBy("fp").agg(F.min("key").alias("v"))
    same = nodes.join(least, "fp").where("key <> v").select(F.col("key").alias("u"), "v")
    apart = fingerprint_links(least.select("fp"), column="fp").withColumnsRenamed({"u": "a", "v": "b"})
    apart = apart.join(least.select(F.col("fp").alias("a"), F.col("v").alias("u")), "a").join(least.select(F.col("fp").alias("b"), "v"), "b")
    return same.union(apart.select("u", "v"))


def forest(marks: np.ndarray, home: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a row at home and any row whose signatures share ``least`` bytes or more: in
    rounds, each part takes its likeliest link to another part. Ties: the smallest positions."""
    n = len(marks)
    labels, edges = np.arange(n), []
    step = max(1, 4_000_000 // n)
    own = np.flatnonzero(home)
    while True:
        best = np.full(n, -1, np.int64)
        for i in range(0, len(own), step):
            rows = own[i : i + step]
            shared = np.zeros((len(rows), n), np.int16)
            for k in range(marks.shape[1]):
                shared += marks[rows, k, None] == marks[None, :, k]
            shared[labels[rows][:, None] == labels[None, :]] = -1
            to = shared.argmax(axis=1)
            value = shared[np.arange(len(rows)), to].astype(np.int64)
            good = value >= least
            # the likeliest first, then the smallest row and partner
            code = (value[good] * n + (n - 1 - rows[good])) * n + (n - 1 - to[good])
            np.maximum.at(best, labels[rows[good]], code)
        found = best[best >= 0]
        if not len(found):
            return edges
        a, b = n - 1 - found // n % n, n - 1 - found % n
        for x, y in zip(a.tolist(), b.tolist()):
            x_label, y_label = labels[x], labels[y]
            if x_label != y_label:
                edges.append((x, y))
                labels[labels == max(x_label, y_label)] = min(x_label, y_label)


def _candidates(nodes: DataFrame, least: int) -> DataFrame:
    """Pairs of keys (u, v) that share a band and may be alike: a forest for each band."""
    sent = nodes.select(F.explode("bands").alias("band"), "key", "mark")
    # only the bands of very many nodes; these have CELL_ROWS rows each, so there is one for each CELL_ROWS * BANDS nodes at most
    large = written(sent.groupBy("band").count().where(F.col("count") > CELL_ROWS).select("band", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("cells")), "bands")
    placed = sent.withColumns({"home": F.lit(True), "cell": F.lit(0)})
    if large.count():
        # row i of the grid has the nodes of part i at home; each cell of it a part of the visitors
        own, every = F.pmod(F.xxhash64("key"), F.col("cells")).cast("int"), F.sequence(F.lit(0), F.col("cells") - 1)
        at_home = F.transform(every, lambda j: F.struct(F.lit(True).alias("home"), (own * F.col("cells") + j).alias("cell")))
        away = F.transform(F.filter(every, lambda i: i != own), lambda i: F.struct(F.lit(False).alias("home"), (i * F.col("cells") + own).alias("cell")))
        whole = F.array(F.struct(F.lit(True).alias("home"), F.lit(0).alias("cell")))
        places = F.when(F.col("cells").isNull(), whole).otherwise(F.concat(at_home, away))
        placed = sent.join(large, "band", "left").select("band", "key", "mark", F.explode(places).alias("at")).select("band", "key", "mark", "at.home", "at.cell")
    dealt = placed.select("band", "cell", "key", "home", "mark").repartition("band", "cell").sortWithinPartitions("band", "cell", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
            part.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, SIGNATURE))
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            edge = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            if len(edge):
                yield pairs([x[: edge[-1]] for x in held], edge)
                held = [x[edge[-1] :] for x in held]
        if held is not None:
            yield pairs(held, np.array([len(held[0])]))

    def pairs(rows: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
        _, _, key, home, mark = rows
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - starts
        two = starts[(size == 2) & (home[starts] | home[ends - 1])]
        two = two[(mark[two] == mark[two + 1]).sum(axis=1) >= least]
        u, v = [key[two]], [key[two + 1]]
        for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            if edges := forest(mark[a:b], home[a:b], least):
                x, y = np.array(edges).T
                u.append(key[a + x])
                v.append(key[a + y])
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, reps: DataFrame, keyed: DataFrame, size: int, ratio: Fraction) -> DataFrame:
    """The pairs whose texts have the wanted similarity."""
    num, den = ratio.numerator, ratio.denominator
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    texts = written(keyed.join(reps.join(wanted, "key", "left_semi"), ["_id", "_row"]).select("key", "_text").dropDuplicates(["key"]), "texts")
    both = pairs.join(texts.select(F.col("key").alias("u"), F.col("_text").alias("a")), "u")
    both = both.join(texts.select(F.col("key").alias("v"), F.col("_text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            us, vs, a, b = (c.to_pylist() for c in batch.columns)
            good = []
            for u, v, x, y in zip(us, vs, a, b):
                for key, text in ((u, x), (v, y)):
                    if key not in known:
                        known[key] = shingles(text, size)[0]
                shared = len(np.intersect1d(known[u], known[v], assume_unique=True))
                good.append(shared * (num + den) >= num * (len(known[u]) + len(known[v])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near copies stays, that of the smallest doc_id (ties: smallest text hash)."""
    bounded_batches(docs.sparkSession)
    ratio = Fraction(str(similarity))
    least = int(np.ceil(SIGNATURE * similarity - SLACK * np.sqrt(SIGNATURE * similarity * (1 - similarity))))
    key = [F.coalesce(F.col(doc_col).cast("long"), F.lit(0)).alias("_id"), F.xxhash64(F.col(doc_col), F.col(text_col)).alias("_row")]
    keyed = docs.select(F.col(doc_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"), *key)
    prints = written(_nodes(keyed, shingle), "sets")
    best = F.min(F.struct(F.col("_doc").isNull().alias("n"), "_id", "_row"))
    nodes = written(prints.groupBy("key").agg(best.alias("best"), *[F.first(c).alias(c) for c in ("fp", "mark", "bands")]), "nodes")
    discard(prints)
    reps = nodes.select("key", "best._id", "best._row")
    pairs = _print_links(nodes).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(_candidates(nodes, least))
    labels = connected_components(_confirmed(written(pairs.distinct(), "pairs"), reps, keyed, shingle, ratio)).withColumnRenamed("node", "key")

    labelled = nodes.select("key", "best").join(labels, "key", "left")
    winners = labelled.groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("best").alias("best")).select("best._id", "best._row")
    rows = docs.select(whole_row(docs).alias("doc"), *key)
    return rows.join(winners, ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select("doc.*")
