"""Threshold-scaled sketches as document fingerprints (operator 7), in DataFrame operations only.

A sketch keeps every hash of a word shingle that lies below a fixed fraction of the hash range, so
sketches of a corpus's parts merge by union and the containment of a short text in a long one
can be estimated from what both kept. What a sketch keeps depends on the threshold alone, so the sketch of two texts
together is the union of theirs; a short text may keep nothing at a scale above 1.

Neighbours in descending doc_id order are found without one global window: documents are dealt to ranges of
ids, and the first row of each range is sent along to the range above it.

Defined cases: a null or empty text has the empty fingerprint; two empty fingerprints have likeness
1, an empty and another 0 (at a scale above 1 an empty one says nothing of a short text); a text of fewer words than a shingle is one shingle; null ids come last in
descending order, by text hash, and are dealt to ranges by it; rows that repeat a doc_id follow each other by text hash; a table of one row is its own
neighbour; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.common import WORD, documents, text_of

SHINGLE = 5
#: One of so many hashes is kept: by default, and in the report, which has short texts to compare with long ones
#: and so keeps all (of a text's few shingles no smaller part is sure to be among what a long text keeps).
SCALE, REPORT_SCALE = 8, 1
#: Rows of a range of ids, and how many cells between quantiles there are at most; each cell has at most as
#: many parts, so ranges are about a million at most.
RANGE_ROWS, MAX_CELLS = 500, 1_024


def with_sketch(df: DataFrame, text_col: str, name: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` with the kept hashes of a text column. The steps are selects of their own, so that no step runs twice."""
    own = df.columns
    n, limit = "size(_words)", -(1 << 63) + (1 << 64) // scale
    get = ", ".join(f"_words[i + {k}]" for k in range(shingle))
    pattern = WORD.replace("\\", "\\\\")
    df = df.withColumn("_words", F.expr(f"transform(regexp_extract_all(`{text_col}`, '{pattern}', 0), w -> xxhash64(w))"))
    every = f"CASE WHEN {n} >= {shingle} THEN transform(sequence(0, {n} - {shingle}), i -> xxhash64({get})) WHEN {n} > 0 THEN array(aggregate(_words, 42L, (a, w) -> xxhash64(a, w))) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    df = df.withColumn("_every", F.expr(every))
    low = f"filter(_every, h -> h < {limit}L)" if scale > 1 else "_every"
    return df.withColumn(name, F.expr(f"sort_array(array_distinct({low}))")).select(*own, name)


def likeness(a: Column | str, b: Column | str) -> Column:
    """Estimated containment of the smaller text's shingles in the larger one's, 0 to 1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    least = F.least(F.size(a), F.size(b))
    both = F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)
    return F.when(least == 0, both).otherwise(F.size(F.array_intersect(a, b)) / least)


def hexadecimal(kept: Column | str) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merge_sketches(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The sketch of all texts of a group together: the union of its sketches."""
    one = df.select(*keys, F.explode_outer(column).alias("h")).distinct()
    return one.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(column))


def _tree(bounds: list[int], values: list[str], lo: int = 0, hi: int | None = None) -> str:
    """The value of the cell that an id is in, as a tree of comparisons; cells end with their bounds."""
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return values[lo]
    mid = (lo + hi) // 2
    return f"IF(_id <= {bounds[mid]}L, {_tree(bounds, values, lo, mid)}, {_tree(bounds, values, mid + 1, hi)})"


def _range_of(ids: DataFrame, rows: int, most: int) -> tuple[Column, int]:
    """A number for each id that never falls as ids rise, and that about ``rows`` rows share.

    Rows without an id have negative numbers, which fall as ``_tie`` rises; how many numbers they have comes second.

    Cells between quantiles of all ids hold equal counts; where there would be more than ``most`` cells, each is
    cut into up to ``most`` parts of equal width.
    """
    n, least, largest, without = ids.agg(F.count("_id"), F.min("_id"), F.max("_id"), F.count_if(F.col("_id").isNull())).first()
    wanted = max(1, n // rows)
    cells = min(most, wanted)
    bounds: list[int] = []
    if cells > 1:
        shares = [i / cells for i in range(1, cells)]
        bounds = sorted(set(ids.where(F.col("_id").isNotNull()).agg(F.percentile_approx("_id", shares, max(10_000, 20 * cells)).alias("q")).first()["q"]))
    parts = min(most, -(-wanted // (len(bounds) + 1)))
    number = F.expr(_tree(bounds, [str(i) for i in range(len(bounds) + 1)])).cast("long")
    if parts > 1:
        edges = [least - 1, *bounds, largest]
        low = F.expr(_tree(bounds, [f"{x}D" for x in edges[:-1]]))
        width = F.expr(_tree(bounds, [f"{max(1, y - x)}D" for x, y in zip(edges, edges[1:])]))
        part = F.least(F.floor((F.col("_id").cast("double") - low) * parts / width), F.lit(parts - 1))
        number = number * parts + F.greatest(part, F.lit(0))
    slots = max(1, min(most * most, without // rows))
    slot = F.least(F.floor((F.col("_tie") / float(1 << 64) + 0.5) * slots), F.lit(slots - 1)) if slots > 1 else F.lit(0)
    return F.when(F.col("_id").isNull(), (-1 - slot).cast("long")).otherwise(number), slots


def with_next(df: DataFrame, id_col: str, columns: dict[str, str], rows: int = RANGE_ROWS, most: int = MAX_CELLS) -> DataFrame:
    """``df`` with the named columns of the next row in descending id order; after the last row comes the first.

    ``columns`` maps a column to the name that the next row's value gets.
    """
    own = df.columns
    null_id = -(1 << 63)
    tied = df.withColumns({"_id": F.col(id_col).cast("long"), "_tie": F.xxhash64(*columns)})
    number, slots = _range_of(tied, rows, most)
    # the first row of a range in descending order; ties are looked at only where rows without an id are many
    tie = F.when(F.col("_id").isNull(), F.col("_tie")).otherwise(0) if slots > 1 else F.lit(0).cast("long")
    place = F.struct(F.coalesce("_id", F.lit(null_id)).alias("id"), (-1 - tie).alias("tie"))
    # a row for each range: its first row's place, and the range above it; above the highest comes the lowest
    heads = tied.withColumn("_range", number).groupBy("_range").agg(F.max(place).alias("_first"))
    upwards = Window.orderBy("_range")
    lowest = F.first("_range").over(upwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.withColumn("_above", F.coalesce(F.lead("_range").over(upwards), lowest))

    keyed = tied.select(*own, "_id", "_tie").withColumn("_range", number)
    keyed = keyed.join(F.broadcast(heads), "_range")  # 2 * most * most rows of a few numbers at most
    here = F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost"))
    there = F.struct(F.col("_above").alias("r"), F.lit(True).alias("ghost"))
    is_head = place == F.col("_first")
    sent = keyed.withColumn("_to", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))))
    w = Window.partitionBy("_to.r").orderBy("_to.ghost", F.col("_id").desc_nulls_last(), "_tie")
    following = {n: F.lead(c).over(w) for c, n in columns.items()}
    return sent.withColumns(following).where("NOT _to.ghost").select(*own, *columns.values())


def sketch_report(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likenesses."""
    base = docs.select(F.col(doc_col).alias("doc_id"), text_of(text_col).alias("text"))
    # sketches are larger than their texts, so only texts are exchanged
    df = with_next(base, "doc_id", {"text": "next_text"})
    df = with_sketch(with_sketch(df, "text", "kept", scale=REPORT_SCALE), "next_text", "next_kept", scale=REPORT_SCALE)
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.expr("CAST(n_chars DIV 3 AS INT)"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - _cut), substring(next_text, 1, _cut))")).drop("text", "next_text")
    df = with_sketch(df, "edited", "edited_kept", scale=REPORT_SCALE)
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hexadecimal("kept").alias("fingerprint"), hexadecimal("edited_kept").alias("edited_fingerprint"), likeness("kept", "edited_kept").alias("near_edited"), likeness("kept", "next_kept").alias("near_next"))


def op7_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_report(documents(spark, sf_dir))
