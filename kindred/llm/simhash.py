"""SimHash near-duplicates by anchor-point covering (operator 8).

The 64 bits of a fingerprint are split into blocks; two fingerprints that differ in at most
``threshold`` bits differ in at most ``threshold // blocks`` bits of some block. On each block a
product of a perfect Hamming code and plain bits is a covering code, whose words are the anchors:
every value is within the covering radius of one anchor, its home. Each fingerprint is sent to all
anchors within covering radius plus the block's threshold, and at each anchor the fingerprints at
home there are compared with all that came. So every link is found at the home of either end.

Only distinct fingerprints are compared. An anchor with many rows is dealt out as a grid of
cells of bounded size, and a cell gives a spanning forest of its links, never all pairs.

Defined cases: a null or empty text has fingerprint zero, which links like any other; repeated
rows share a fingerprint; a null doc_id gets a component like any row but never names one (the
component is null where no row of it has an id); an empty table gives no rows; extra columns are
ignored by :func:`simhash_components` and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, documents, hold, text_of, whole_row, written
from kindred.llm.components import connected_components

THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: Rows of an anchor beyond which it is dealt out as a grid of cells.
CELL_ROWS = 16_000

#: Codes of the three blocks of 22, 21 and 21 bits: a Hamming code of length 7 (covering radius 1) beside plain bits, which
#: a negative length counts. A block has 2^19 or 2^18 anchors.
CODES = ((7, -15), (7, -14), (7, -14))

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[: -SHINGLE]]]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i : i + 65_536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long in a new last column."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("prints", int)
        for batch in batches:
            found = np.array([fingerprint(t or "") for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` long")


def _component_tables(length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Of one code: its bits, the home of each value, and the other words within radius plus one (-1: none)."""
    n = abs(length)
    values = np.arange(1 << n, dtype=np.int64)
    if length < 0:
        return n, values, values[:, None] ^ (1 << np.arange(n))
    syndrome = np.zeros(1 << n, np.int64)
    for bit in range(n):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    flip = np.concatenate([[0], 1 << np.arange(n)])
    others = np.full((1 << n, n // 2), -1, np.int64)
    for s in range(1, n + 1):
        rows = np.flatnonzero(syndrome == s)
        pairs = [(a, a ^ s) for a in range(1, n + 1) if a < a ^ s and a != s]
        for k, (a, b) in enumerate(pairs):
            others[rows, k] = values[rows] ^ flip[a] ^ flip[b]
    return n, values ^ flip[syndrome], others


def anchors_of(fingerprints: np.ndarray, codes: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: (row, anchor, at home), one entry for each anchor in reach."""
    tables = {length: _component_tables(length) for block in codes for length in block}
    rows, keys, homes = [], [], []
    everyone = np.arange(len(fingerprints))
    shift = 0
    for number, block in enumerate(codes):
        home = np.full(len(fingerprints), number << 40, np.int64)
        parts, low = [], 0
        for length in block:
            n, nearest, others = tables[length]
            value = (fingerprints >> np.uint64(shift) & np.uint64((1 << n) - 1)).astype(np.int64)
            home |= nearest[value] << low
            parts.append((low, nearest[value], others[value]))
            low += n
            shift += n
        rows.append(everyone)
        keys.append(home)
        homes.append(np.ones(len(home), bool))
        for low, nearest, others in parts:
            for k in range(others.shape[1]):
                there = others[:, k] >= 0
                rows.append(everyone[there])
                keys.append((home ^ nearest << low | others[:, k] << low)[there])
                homes.append(np.zeros(int(there.sum()), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def forest(fingerprints: np.ndarray, n_home: int, threshold: int) -> list[tuple[int, int]]:
    """Spanning edges of the links between the first ``n_home`` fingerprints and all of them, as positions."""
    labels = np.arange(len(fingerprints))
    step = max(1, 2_000_000 // len(fingerprints))
    for i in range(0, n_home, step):
        near = np.bitwise_count(fingerprints[i : min(n_home, i + step), None] ^ fingerprints[None, :]) <= threshold
        a, b = np.nonzero(near)
        a += i
        while True:
            apart = labels[a] != labels[b]
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            low = np.minimum(labels[a], labels[b])
            np.minimum.at(labels, labels[a], low)
            np.minimum.at(labels, labels[b], low)
            while (labels[labels] != labels).any():
                labels = labels[labels]
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return list(zip(linked.tolist(), labels[linked].tolist()))


def fingerprint_links(nodes: DataFrame, threshold: int = THRESHOLD, column: str = "fingerprint", cell_rows: int = CELL_ROWS, codes: tuple = CODES) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints of ``nodes`` exactly as all links would."""
    spark = nodes.sparkSession
    bounded_batches(spark)
    if threshold >= 2 * len(codes):
        raise ValueError("a block's threshold has to be 1 at most; use more blocks")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            row, anchor, home = anchors_of(own, codes)
            for i in range(0, len(row), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[s]), pa.array(home[s]), pa.array(own[row[s]].view(np.int64))], ["anchor", "home", "fp"])

    sent = nodes.select(column).mapInArrow(replicate, "anchor long, home boolean, fp long")
    # at most a row for each anchor of the codes, and only those of the large ones
    large = sent.groupBy("anchor").count().where(F.col("count") > cell_rows)
    large = written(large.select("anchor", F.ceil(F.col("count") / cell_rows).cast("int").alias("cells")), "anchors")
    placed = sent.withColumn("cell", F.lit(0))
    if large.count():
        own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
        every = F.sequence(F.lit(0), F.col("cells") - 1)
        cells = F.when(F.col("cells").isNull(), F.array(F.lit(0))).otherwise(
            F.concat(
                F.when(F.col("home"), F.transform(every, lambda j: own * F.col("cells") + j)).otherwise(F.array().cast("array<int>")),
                F.transform(every, lambda i: -1 - (i * F.col("cells") + own)),
            )
        )
        placed = sent.join(F.broadcast(large), "anchor", "left").select("anchor", "home", "fp", F.explode(cells).alias("at"))
        # a row that is at home comes as such to its row of the grid and as a visitor to its column
        placed = placed.select("anchor", "fp", (F.col("home") & (F.col("at") >= 0)).alias("home"), F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("cell"))
    dealt = placed.select("anchor", "cell", "home", "fp").repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", F.desc("home"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            edge = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            if len(edge):
                yield from cells_of([x[: edge[-1]] for x in held], edge)
                held = [x[edge[-1] :] for x in held]
        if held is not None:
            yield from cells_of(held, np.array([len(held[0])]))

    def cells_of(rows: list[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v, start = [], [], 0
        for end in ends.tolist():
            n_home = int(rows[2][start:end].sum())
            if n_home and end - start > 1:
                own = rows[3][start:end].view(np.uint64)
                for i, j in forest(own, n_home, threshold):
                    u.append(own[i])
                    v.append(own[j])
            start = end
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long").where("u <> v").distinct()


def components_of(prints: DataFrame, threshold: int = THRESHOLD, column: str = "fingerprint") -> DataFrame:
    """(fingerprint, node component) for the distinct fingerprints of ``prints``."""
    nodes = prints.select(column).distinct()
    labels = connected_components(fingerprint_links(nodes, threshold, column))
    return nodes.join(labels.withColumnRenamed("node", column), column, "left").select(column, F.coalesce("component", column).alias("component"))


def simhash_components(docs: DataFrame, threshold: int = THRESHOLD, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id, the smallest doc_id that links lead to."""
    prints = written(with_fingerprint(docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))).select("doc_id", "fingerprint"), "fingerprints")
    labels = components_of(prints, threshold)
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).join(labels, "fingerprint")
    named = written(first.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    labels = labels.join(named, "component").select("fingerprint", "component_id")
    return prints.join(labels, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, that of the smallest doc_id (ties: smallest text hash)."""
    key = [F.coalesce(F.col(doc_col).cast("long"), F.lit(0)).alias("_id"), F.xxhash64(F.col(doc_col), F.col(text_col)).alias("_row")]
    prints = docs.select(F.col(doc_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"), *key)
    prints = written(with_fingerprint(prints, "_text").select("_doc", "_id", "_row", "fingerprint"), "fingerprints")
    best = F.min(F.struct(F.col("_doc").isNull().alias("n"), "_id", "_row"))
    of_print = prints.groupBy("fingerprint").agg(best.alias("best"))
    winners = of_print.join(components_of(prints, threshold), "fingerprint").groupBy("component").agg(F.min("best").alias("best")).select("best._id", "best._row")
    keyed = docs.select(whole_row(docs).alias("doc"), *key)
    return keyed.join(winners, ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select("doc.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
