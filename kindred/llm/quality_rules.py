"""Quality rules by distribution divergence (operator 2), in DataFrame operations only.

Base rules count words, symbols, repeated lines and repeated five-word windows of each whole text.
Beyond them, the histogram of character classes and that of a language's common words are compared
with the language's reference by the Jensen-Shannon distance. A reference is the mean histogram
of all documents of that language, in whole millionths, so that it does not depend on the
order of summation. Texts below a minimum length are not judged by divergence.

One pass over the texts writes a row of counts for each document; references have a row for each
configured language, whatever the input's size.

Defined cases: a null or empty text has no words and fails the base rules; a null or unknown language
is compared by character classes with the references of all languages together; where there is no reference nothing is rejected by
divergence; null ids and repeated rows are judged like any; an empty table gives no rows; extra columns
are ignored, and kept by :func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import WORD, documents, text_of, whole_row, written

#: Common words of each language with a reference.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it"],
    "de": ["der", "die", "und", "den", "das", "mit", "ist", "von"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "que"],
    "es": ["de", "la", "que", "el", "en", "los", "del", "las"],
}
#: Character classes, each counted in what the ones before it leave: letters, white space, capitals, digits, punctuation, other ASCII.
CLASSES = ["[a-z]+", "[\\x20\\x09-\\x0D]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()\\-]+", "[\\x00-\\x7F]+"]
#: Least code points and words for the two comparisons.
MIN_CHARS, MIN_WORDS = 80, 30
#: Largest Jensen-Shannon distances (base 2, so 0 to 1) of a document that is kept, and what is
#: granted beyond them for each reciprocal square root of its words, as short texts scatter more.
MAX_CLASS, MAX_COMMON = 0.2, 0.16
CLASS_SLACK, COMMON_SLACK = 1.2, 0.9
WINDOW = 5
_SYMBOLS = "[#*$%&|<>]"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with a struct column ``_rules`` of counts and histograms."""
    own = docs.columns
    lang = F.col(lang_col) if lang_col in own else F.lit(None).cast("string")
    known = F.when(lang.isin(*COMMON), lang)
    df = docs.select(*own, text_of(text_col).alias("_t"), known.alias("_lang"))
    keep = [f"`{c}`" for c in own] + ["_lang"]

    df = df.selectExpr(*keep, "_t", f"regexp_extract_all(_t, {_literal(WORD)}, 0) AS _w", "split(_t, '\\n', -1) AS _l", "length(_t) AS _n0")
    lines = f"filter(_l, x -> x rlike {_literal(WORD)})"
    df = df.selectExpr(*keep, "_t", "_n0", "transform(_w, x -> xxhash64(x)) AS _h", "size(_w) AS _n", "length(array_join(_w, '')) AS _wc", f"{lines} AS _lw", f"length(_t) - length(regexp_replace(_t, {_literal(_SYMBOLS)}, '')) AS _sym")

    # character classes: what is left after each class goes on to the next
    left, counts = "_t", []
    for i, pattern in enumerate(CLASSES):
        df = df.selectExpr("*", f"regexp_replace({left}, {_literal(pattern)}, '') AS _t{i}").selectExpr("*", f"length(_t{i}) AS _n{i + 1}").drop(left)
        counts.append(f"CAST(_n{i} - _n{i + 1} AS BIGINT)")
        left = f"_t{i}"
    counts.append(f"CAST(_n{len(CLASSES)} AS BIGINT)")

    words = "CASE _lang " + " ".join(f"WHEN '{k}' THEN array({', '.join(f'xxhash64({_literal(w)})' for w in v)})" for k, v in COMMON.items()) + f" ELSE array({', '.join(f'xxhash64({_literal(w)})' for w in COMMON['en'])}) END"
    df = df.selectExpr("*", f"{words} AS _common").selectExpr("*", "filter(transform(_h, x -> array_position(_common, x)), i -> i > 0) AS _at")
    hist = [f"CAST(size(filter(_at, i -> i = {k + 1})) AS BIGINT)" for k in range(8)] + ["CAST(_n - size(_at) AS BIGINT)"]

    # repeated windows: hashes sorted with their position in the low bits, then compared in full
    at = ", ".join(f"_h[i + {k}]" for k in range(WINDOW))
    df = df.selectExpr("*", f"CASE WHEN _n >= {WINDOW} THEN transform(sequence(0, _n - {WINDOW}), i -> xxhash64({at})) ELSE CAST(array() AS ARRAY<BIGINT>) END AS _g")
    df = df.selectExpr("*", "size(array_distinct(_g)) < size(_g) AS _again", "CAST(ceil(log2(size(_g) + 1)) AS INT) AS _b")
    df = df.selectExpr("*", "CASE WHEN _again THEN sort_array(transform(_g, (x, i) -> shiftleft(x, _b) | CAST(i AS BIGINT))) ELSE CAST(array() AS ARRAY<BIGINT>) END AS _s")
    df = df.selectExpr("*", "transform(_s, x -> CAST(x & (shiftleft(1L, _b) - 1) AS INT)) AS _p")
    df = df.selectExpr("*", "sort_array(filter(_p, (p, j) -> (j > 0 AND _g[p] = _g[_p[j - 1]]) OR (j < size(_p) - 1 AND _g[p] = _g[_p[j + 1]]))) AS _d")
    repeat = f"aggregate(transform(_d, (p, j) -> CASE WHEN j < size(_d) - 1 THEN least({WINDOW}, _d[j + 1] - p) ELSE {WINDOW} END), 0L, (a, x) -> a + x)"
    rules = f"named_struct('lang', _lang, 'n_chars', CAST(_n0 AS BIGINT), 'n_words', CAST(_n AS BIGINT), 'word_chars', CAST(_wc AS BIGINT), 'n_symbols', CAST(_sym AS BIGINT), 'n_dup_lines', CAST(size(_lw) - size(array_distinct(_lw)) AS BIGINT), 'n_repeat_words', {repeat}, 'classes', array({', '.join(counts)}), 'common', array({', '.join(hist)})) AS _rules"
    return df.selectExpr(*keep[:-1], rules)


def _shares(hist: str, total: Column, bins: int) -> list[Column]:
    """A histogram in whole millionths; zero for an empty one."""
    return [F.floor(F.when(total > 0, F.col(hist)[i] * 1_000_000 / total).otherwise(0)).cast("long") for i in range(bins)]


def references(tagged: DataFrame) -> DataFrame:
    """A row for each language that occurs: sums of the shares of all its documents that are long enough."""
    classes = _shares("_rules.classes", F.col("_rules.n_chars"), len(CLASSES) + 1)
    common = _shares("_rules.common", F.col("_rules.n_words"), 9)
    sums = [F.sum(x).alias(f"c{i}") for i, x in enumerate(classes)] + [F.sum(x).alias(f"w{i}") for i, x in enumerate(common)]
    return tagged.where(F.col("_rules.lang").isNotNull() & (F.col("_rules.n_words") >= MIN_WORDS)).groupBy(F.col("_rules.lang").alias("_ref")).agg(*sums)


def _distance(doc: Column, ref: Column, bins: int) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if one of them is empty or null."""
    add = lambda a, x: a + x
    p_all, q_all = (F.aggregate(x, F.lit(0).cast("long"), add) for x in (doc, ref))

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    parts = F.zip_with(doc, ref, lambda a, b: part(a / p_all, b / q_all))
    return F.when((p_all > 0) & (q_all > 0), F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), add) / 2, F.lit(0.0))))


def judged(tagged: DataFrame) -> DataFrame:
    """``tagged`` with class_distance, common_distance, base_failed and kept."""
    known = {r["_ref"]: r for r in references(tagged).collect()}  # a row for each configured language at most

    def against(hist: str, key: str, bins: int, guard: Column) -> Column:
        if not known:
            return F.lit(None).cast("double")
        whole = [sum(r[f"{key}{i}"] for r in known.values()) for i in range(bins)]
        ref = F.array(*map(F.lit, whole)) if key == "c" else F.lit(None).cast("array<bigint>")
        for k, r in sorted(known.items()):
            ref = F.when(F.col("_rules.lang") == k, F.array(*[F.lit(r[f"{key}{i}"]) for i in range(bins)])).otherwise(ref)
        return F.when(guard, _distance(F.col(hist), ref, bins))

    r = "_rules."
    df = tagged.withColumns({
        "class_distance": against("_rules.classes", "c", len(CLASSES) + 1, F.col(r + "n_chars") >= MIN_CHARS),
        "common_distance": against("_rules.common", "w", 9, F.col(r + "n_words") >= MIN_WORDS),
        "base_failed": (F.col(r + "n_words") < 10) | (F.col(r + "n_repeat_words") * 100 > F.col(r + "n_words") * 20),
    })
    short = F.sqrt(F.greatest(F.col(r + "n_words"), F.lit(1)))
    close = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS + CLASS_SLACK / short) & (F.coalesce("common_distance", F.lit(0.0)) <= MAX_COMMON + COMMON_SLACK / short)
    return df.withColumn("kept", ~F.col("base_failed") & close)


def rule_report(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(doc_col).alias("doc_id"), text_of(text_col).alias("text"), lang.cast("string").alias("lang"))
    counted = with_counts(rows).select("doc_id", "_rules")
    df = judged(written(counted, "rules"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select("doc_id", *[F.col(f"_rules.{n}") for n in names], "base_failed", "kept", "class_distance", "common_distance")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    rows = docs.select(whole_row(docs).alias("doc"), text_of(text_col).alias("text"), lang.cast("string").alias("lang"))
    return judged(written(with_counts(rows).select("doc", "_rules"), "rules")).where("kept").select("doc.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_report(documents(spark, sf_dir)).drop("class_distance", "common_distance")


def _op2_sql() -> str:
    left, steps, counts = "t", [], []
    for i, pattern in enumerate(CLASSES):
        steps.append(f"regexp_replace({left}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS t{i}")
        before = "length(t)" if i == 0 else f"length(t{i - 1})"
        counts.append(f"{before} - length(t{i})")
        left = f"t{i}"
    counts.append(f"length(t{len(CLASSES) - 1})")
    lists = " ".join(f"WHEN '{k}' THEN {v}" for k, v in COMMON.items())
    share = "[CASE WHEN n > 0 THEN CAST(floor(x * 1000000 / n) AS BIGINT) ELSE 0 END FOR x IN {h}]"
    n, m = len(CLASSES) + 1, 9
    sums = lambda h, k: "[" + ", ".join(f"sum({h}[{i + 1}])" for i in range(k)) + "]"

    def distance(doc: str, ref: str) -> str:
        part = "CASE WHEN z[{k}] > 0 THEN z[{k}] * log2(z[{k}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
        pairs = f"list_zip([x::DOUBLE / list_sum({doc}) FOR x IN {doc}], [x::DOUBLE / list_sum({ref}) FOR x IN {ref}])"
        return f"CASE WHEN list_sum({doc}) > 0 AND list_sum({ref}) > 0 THEN sqrt(greatest(list_sum([{part.format(k=1)} + {part.format(k=2)} FOR z IN {pairs}]) / 2, 0)) END"

    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON)}) THEN lang END AS lang,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), classes AS (
  SELECT *, {", ".join(steps)} FROM texts
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM texts, unnest(range(1, len(ws) - {WINDOW - 2})) AS s(i)
), again AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM grams) WHERE k > 1) GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, [{", ".join(counts)}] AS c,
         [len(list_filter(ws, lambda w: w = b)) FOR b IN CASE lang {lists} ELSE {COMMON["en"]} END] AS common
  FROM classes LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)
), binned AS (
  SELECT *, list_append(common, n_words - list_sum(common)) AS w FROM counted
), shares AS (
  SELECT lang, {share.format(h="c").replace("n ", "n_chars ").replace("/ n)", "/ n_chars)")} AS c, {share.format(h="w").replace("n ", "n_words ").replace("/ n)", "/ n_words)")} AS w
  FROM binned WHERE lang IS NOT NULL AND n_words >= {MIN_WORDS}
), refs AS (
  SELECT lang, {sums("c", n)} AS rc, {sums("w", m)} AS rw FROM shares GROUP BY lang
), whole AS (
  SELECT {sums("rc", n)} AS ac FROM refs
), far AS (
  SELECT b.*, CASE WHEN n_chars >= {MIN_CHARS} THEN {distance("c", "coalesce(rc, ac)")} END AS dc,
         CASE WHEN n_words >= {MIN_WORDS} THEN {distance("w", "rw")} END AS dw,
         n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed
  FROM binned b LEFT JOIN refs USING (lang), whole
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(dc, 0) <= {MAX_CLASS} + {CLASS_SLACK} / sqrt(greatest(n_words, 1)) AND coalesce(dw, 0) <= {MAX_COMMON} + {COMMON_SLACK} / sqrt(greatest(n_words, 1)) AS kept
FROM far
"""


OP2_SQL = _op2_sql()
