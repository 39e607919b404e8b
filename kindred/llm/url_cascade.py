"""URL rules by a cascade of Bloom filters (operator 9).

Every URL gives the keys that a rule could name: each suffix of its host at a label boundary with no more labels
than some rule has, followed by each prefix of its path of a length that some rule has. The distinct keys of all URLs are the universe.
Level 0 of the cascade holds the listed keys; level 1 those keys of the universe that level 0 wrongly
passes; level 2 the listed keys that level 1 wrongly passes; and so on until a level passes no wrong key.
Membership of any key of the universe is then exact, and URLs are judged where they are, without a join.

A filter's size is known from its number of keys before it is built; where a cascade would be
larger than ``MAX_BYTES``, the listed keys are joined instead.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no rule; a url that no
rule fits is allowed, as it has no listed key; repeated rows and null ids are judged like any; an empty
table gives no rows; extra columns stay, but for those named host, path, rule or verdict, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, written

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
BITS, PROBES = 12, 6
MAX_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path."""
    rest = F.expr(f"CASE WHEN instr(`{url_col}`, '://') > 0 THEN substring(`{url_col}`, instr(`{url_col}`, '://') + 3) END")
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    after = F.expr("substring(_rest, length(_host) + 1)")
    df = pages.withColumn("_rest", rest).withColumn("_host", host)
    df = df.withColumn("path", F.coalesce(F.regexp_extract(after, "^[^?#]*", 0), F.lit("")))
    return df.withColumn("host", F.coalesce(F.translate("_host", UPPER, LOWER), F.lit(""))).drop("_rest", "_host")


def keys_of(host: str, path: str, lengths: Sequence[int], most: int) -> list[str]:
    """The keys that a rule of ``most`` labels or fewer could name, the longest first."""
    if not host:
        return []
    labels = host.rsplit(".", most)[-most:]
    suffixes = [".".join(labels[i:]) for i in range(len(labels))]
    return sorted((s + path[:n] for s in suffixes for n in lengths if n <= len(path)), key=len, reverse=True)


def hashes(keys: Sequence[str]) -> np.ndarray:
    """Two 64-bit hashes of each key."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys), "<u8").reshape(-1, 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class BloomFilter:
    def __init__(self, n_keys: int, level: int, words: np.ndarray | None = None):
        self.level, self.bits = level, max(191, n_keys * BITS | 1)
        self.words = np.zeros(self.bits // 64 + 1, np.uint64) if words is None else words

    def places(self, pairs: np.ndarray) -> np.ndarray:
        salt = np.uint64((self.level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        a, step = _mixed(pairs[:, 0] + salt), _mixed(pairs[:, 1] ^ salt) | np.uint64(1)
        return (a[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(self.bits)

    def passes(self, pairs: np.ndarray) -> np.ndarray:
        at = self.places(pairs)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(1)

    def filled(self, keys: DataFrame) -> BloomFilter:
        """Filled with the keys of a DataFrame: tasks set bits, which are joined by OR; the driver gets the filter only."""

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(self.places(hashes(batch.column(0).to_pylist())))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

        rows = keys.mapInArrow(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return self


class Cascade:
    """Exact membership for the keys of the universe that it was built for."""

    def __init__(self, levels: list[BloomFilter]):
        self.levels = levels

    def contains(self, keys: Sequence[str]) -> np.ndarray:
        pairs = hashes(keys)
        out = np.full(len(keys), len(self.levels) % 2 == 1)
        left = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            good = level.passes(pairs[left])
            out[left[~good]] = i % 2 == 1
            left = left[good]
        return out


def _passing(keys: DataFrame, level: BloomFilter) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(shared.value.passes(hashes(batch.column(0).to_pylist()))))

    return keys.mapInArrow(run, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """Of distinct ``key`` columns. None if the first filter would be larger than ``max_bytes``."""
    inside = written(listed.select("key").distinct(), "listed")
    outside = universe.select("key").distinct()
    levels: list[BloomFilter] = []
    n = inside.count()
    if n * BITS // 8 > max_bytes:
        return None
    if not n:
        return Cascade([])
    wrong = None  # what the last level passes wrongly
    while True:
        own = inside if wrong is None else wrong
        if levels:
            n = own.count()
            if not n:
                return Cascade(levels)
            if n * BITS // 8 > max_bytes:
                return None
        levels.append(BloomFilter(n, len(levels)).filled(own))
        if len(levels) == 1:
            passed = _passing(outside, levels[0]).join(inside, "key", "left_anti")
            wrong, other = written(passed, "wrong"), inside
        else:
            wrong, other = written(_passing(other, levels[-1]), "wrong"), own


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``pages`` with host, path, rule (the longest that fits, or null) and verdict."""
    spark = pages.sparkSession
    bounded_batches(spark)
    lengths, most = sorted({len(p) for _, _, p in rules}), max((h.count(".") + 1 for _, h, _ in rules), default=1)
    parted = with_parts(pages.drop("host", "path", "rule", "verdict"), url_col)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            found = {k for h, p in pairs for k in keys_of(h, p, lengths, most)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["key"])

    universe = written(parted.select("host", "path").mapInArrow(candidates, "key string").distinct(), "universe")
    listed = {v: spark.createDataFrame([(h + p,) for w, h, p in rules if w == v], "key string") for v in ("allow", "block")}
    cascades = {v: build_cascade(k, universe, max_bytes) for v, k in listed.items()}
    if None in cascades.values():
        return _joined(parted, rules, lengths, most)
    shared = spark.sparkContext.broadcast(cascades)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            keys = [keys_of(h, p, lengths, most) for h, p in zip(host, path)]
            names = list({k for ks in keys for k in ks})
            verdict = {}
            for v, cascade in shared.value.items():
                verdict |= {k: v for k, hit in zip(names, cascade.contains(names)) if hit}
            rule = [next((k for k in ks if k in verdict), None) for ks in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array([verdict.get(r, "allow") for r in rule], pa.string())], [*batch.schema.names, "rule", "verdict"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parted.schema.fields)
    return parted.mapInArrow(judge, f"{schema}, rule string, verdict string")


def _joined(parted: DataFrame, rules: Sequence[tuple[str, str, str]], lengths: list[int], most: int) -> DataFrame:
    """The same result by joins on distinct (host, path), for lists whose filters would be too large."""
    table = parted.sparkSession.createDataFrame([(h + p, v) for v, h, p in rules], "key string, verdict string")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, k) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in keys_of(h, p, lengths, most)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ((), (), ()))], ["host", "path", "key"])

    fits = parted.select("host", "path").distinct().mapInArrow(candidates, "host string, path string, key string").join(table, "key")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.length("key")).alias("b"))
    best = best.select("host", "path", F.col("b.key").alias("rule"), F.col("b.verdict").alias("verdict"))
    return parted.join(best, ["host", "path"], "left").select(*[parted[c] for c in parted.columns], "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts
), named AS (
  SELECT page_id, coalesce(translate(raw, '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM split
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM named
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
