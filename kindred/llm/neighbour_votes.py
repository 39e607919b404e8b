"""Quality scores by nearest-neighbour voting in a latent-semantic space (operator 5).

A text becomes a hashed bag of all its words, word shapes and shape pairs, and of a few binned measures of the
whole text; texts of every length are described alike. A bounded sample of labelled rows fixes inverse document frequencies and, by an
eigendecomposition of their Gram matrix, a latent space; the labelled vectors in it are broadcast. Every
document's cosine with every labelled vector is computed exactly, block by block, and the labels of the
nearest vote with a weight that grows with their similarity.

Bounds: ``SAMPLE`` labelled rows of each class at most, ``TERMS`` hashed terms, ``LATENT`` dimensions; so
the broadcast holds at most 2 SAMPLE x LATENT + TERMS x LATENT numbers (under 2 MB as set), whatever the
input's size.

Defined cases: a null text is the empty text, which is a bag of measures only; rows of ``labels`` with a null
id or label are not learnt from, of several labels of an id the least holds; without labels of any kind
every score is 0.5; null ids and repeated rows are scored like any; extra columns are ignored, and kept by
:func:`keep_quality`.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from math import log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, documents, free_name, hold, text_of

SAMPLE = 2_000
TERMS = 2_048
LATENT = 64
NEIGHBOURS = 25
#: Votes weigh similarity to this power.
SHARPNESS = 8
#: A word counts so much less than a shape, as words are many and each of them is rare.
WORD_WEIGHT = 0.2
BLOCK = 500

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


def _term(name: bytes) -> int:
    return crc32(name) % TERMS


def terms_of(text: str) -> tuple[list[int], list[float]]:
    """Hashed terms of a whole text and their counts, damped by the logarithm."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    bag: Counter = Counter()
    measures = {b"#words": min(12, n.bit_length())}
    if n:
        classes = np.frombuffer(raw.translate(_SHAPE), np.uint8)
        changes = np.concatenate([[True], classes[1:] != classes[:-1]])
        shapes = classes[changes].tobytes().split()
        counts = Counter(words)
        found = [(b"s%b" % name, 1.0, k) for name, k in Counter(shapes).items()]
        found += [(b"p%b %b" % pair, 1.0, k) for pair, k in Counter(zip(shapes, shapes[1:])).items()]
        found += [(b"w%b" % name, WORD_WEIGHT, k) for name, k in counts.items()]
        for name, weight, k in found:
            bag[_term(name)] += weight * log1p(100.0 * k / n)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        measures |= {
            b"#distinct": int(10 * len(counts) / n),
            b"#most": int(20 * max(counts.values()) / n),
            b"#length": int(2 * len(raw) / n),
            b"#lines": int(10 * len(set(lines)) / max(1, len(lines))),
            b"#capitals": int(20 * int((classes == 65).sum()) / len(classes)),
            b"#marks": int(20 * len(re.findall(rb"[#*$%&|<>!]", raw)) / len(classes)),
        }
    for name, k in measures.items():
        for j in (k - 1, k, k + 1):  # neighbouring bins share terms
            bag[_term(name + str(j).encode())] += 2.0 if j == k else 1.0
    return list(bag), [float(v) for v in bag.values()]


def _matrix(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts):
        at, value = terms_of(text)
        row[at] = value
    return out


class VoteModel:
    """What is broadcast: term weights times the latent projection, labelled vectors, their labels."""

    def __init__(self, bags: np.ndarray, labels: np.ndarray, latent: int = LATENT):
        self.labels = labels.astype(np.float32)
        if not len(labels):
            return
        blocks = [slice(i, i + BLOCK) for i in range(0, len(bags), BLOCK)]
        seen = sum((bags[s] > 0).sum(0) for s in blocks)
        idf = np.log((1 + len(bags)) / (1 + seen)) + 0.1
        gram = np.zeros((bags.shape[1], bags.shape[1]))
        for s in blocks:
            weighted = bags[s] * idf
            weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
            gram += weighted.T @ weighted
        values, vectors = np.linalg.eigh(gram)
        top = vectors[:, ::-1][:, : min(latent, len(values))]
        self.projection = (idf[:, None] * top).astype(np.float32)
        self.vectors = self._unit(bags @ self.projection)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        found = []
        for i in range(0, len(texts), BLOCK):
            cosine = self._unit(_matrix(texts[i : i + BLOCK]) @ self.projection) @ self.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 1e-3) ** SHARPNESS
            found.append((weight * self.labels[near]).sum(1) / weight.sum(1))
        return np.clip(np.concatenate(found), 0, 1) if found else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_votes(docs: DataFrame, labels: DataFrame, label_col: str = "quality", doc_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> VoteModel:
    """Learn from at most ``sample`` rows of each class, those of the least id hashes, none of them held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(doc_col).isNotNull() & ~held_out(F.col(doc_col)))
    one = one.groupBy(F.col(doc_col).alias("_doc")).agg(F.min(label_col).cast("int").alias("_label"))
    chosen = [tuple(r) for k in (0, 1) for r in one.where(F.col("_label") == k).orderBy(F.xxhash64("_doc"), "_doc").limit(sample).collect()]
    if not chosen:
        return VoteModel(np.zeros((0, TERMS)), np.zeros(0))
    ids = spark.createDataFrame(chosen, "_doc long, _label int")
    texts = docs.select(F.col(doc_col).cast("long").alias("_doc"), text_of(text_col).alias("_text"))
    texts = texts.join(F.broadcast(ids), "_doc").groupBy("_doc", "_label").agg(F.min("_text").alias("_text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["doc", "label", "at", "value"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by("doc")
        matrix = np.zeros((rows.num_rows, TERMS), np.float32)
        for row, at, value in zip(matrix, rows["at"], rows["value"]):
            row[at.values.to_numpy()] = value.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(VoteModel(matrix, rows["label"].to_numpy()))], pa.binary())], ["model"])

    # fitted by one task: the sample is bounded, and its matrices are large for a driver
    found = texts.mapInArrow(bags, "doc long, label int, at array<int>, value array<float>")
    model = found.repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(bytes(model[0])) if model else VoteModel(np.zeros((0, TERMS)), np.zeros(0))


def with_score(docs: DataFrame, model: VoteModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in a new last column."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("terms", int)
        for batch in batches:
            found = shared.value.scores([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` double")


def keep_quality(docs: DataFrame, model: VoteModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents with a score of ``least`` or more, with their own columns."""
    name = free_name(docs, "score")
    return with_score(docs, model, text_col, name).where(F.col(name) >= least).drop(name)


def op5_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_votes(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
