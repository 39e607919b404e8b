"""Queries of fitted models over the driver's tables, with SQL that computes them from the definitions.

The SQL orthogonalises columns one after the other and finds eigenvectors of four by four matrices by squaring them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.schema import feature_counts, get_feature_names, get_feature_names_and_types, is_categorical_type, is_nan_like, is_number_like_type, minimum_type, promote_targets, vector_of
from kindred.functions.storage import folder
from kindred.operators.knn import NeighbourIndex, kneighbors
from kindred.operators.transforms import CCATransformer, CCorATransformer, MahalanobisTransformer
from kindred.operators.trees import GBNodeTransformer, RFNodeTransformer, hamming_weights
from kindred.plans.estimators import GBNNRegressor, GNNRegressor, MSNRegressor, RawKNNRegressor, RFNNRegressor
from kindred.plans.queries import ENVIRONMENT, K, _cca, _knn_sql, _shown, _table, supplier_sites
from kindred.sources.tables import from_rows, load_csv_data, load_dataset_from_csv_filenames, load_moscow_stjoes, load_swo_ecoplot

Query = Callable[[SparkSession, str], DataFrame]
SPECIES = [f"b{i}" for i in range(25)]


# ---- ordination


def _signs(biplot: np.ndarray) -> np.ndarray:
    """For each axis the sign that makes its largest biplot score positive: axes have no sign of their own."""
    return np.sign(biplot[np.abs(biplot).argmax(axis=0), np.arange(biplot.shape[1])])


def _axes(df: DataFrame, id_col: str, prefixes: Sequence[str], signs: np.ndarray, decimals: int) -> DataFrame:
    return df.select(id_col, *[F.round(F.col(f"{p}{a}") * float(s), decimals).alias(f"{p}{a}") for p in prefixes for a, s in enumerate(signs)])


def cca_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cca, _ = _cca(spark, sf_dir)
    biplot = cca.biplot_scores * _signs(cca.biplot_scores)
    rows = [(a, round(float(v), 9), *[round(float(x), 6) for x in biplot[:, a]]) for a, v in enumerate(cca.eigenvalues)]
    return spark.createDataFrame(rows, "axis int, eigenvalue double, " + ", ".join(f"{c} double" for c in ENVIRONMENT))


def cca_site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cca, _ = _cca(spark, sf_dir)
    both = cca.site_lc_scores("site").join(cca.site_wa_scores("site"), "site")
    return _axes(both, "site", ("lc", "wa"), _signs(cca.biplot_scores), 5)


def cca_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    cca, brands = _cca(spark, sf_dir)
    scores, tolerances = cca.species_scores * _signs(cca.biplot_scores), cca.species_tolerances("site")
    rows = [(b, *[round(float(x), 5) for x in (*s, *t)]) for b, s, t in zip(brands, scores, tolerances)]
    return spark.createDataFrame(rows, "brand string, " + ", ".join(f"{n}{a} double" for n in ("score", "tolerance") for a in range(cca.rank)))


def cca_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cca, brands = _cca(spark, sf_dir)
    return cca.residuals("site").select("site", *[F.round(s, 7).alias(s) for s in cca.species])


def ccora_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, _ = supplier_sites(spark, sf_dir)
    fitted = CCorATransformer().fit(sites, ENVIRONMENT, SPECIES)
    o = fitted.ordination_
    rows = [(a, round(float(c), 8), round(float(p), 6), fitted.n_components_) for a, (c, p) in enumerate(zip(o.cancorr, o.f_test))]
    return spark.createDataFrame(rows, "axis int, correlation double, p_value double, n_components int")


def _transformed(transformer, name: str) -> Query:
    """Absolute coordinates in a space of axes, which have no sign of their own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sites, _ = supplier_sites(spark, sf_dir)
        made = transformer().fit(sites, ENVIRONMENT, SPECIES)
        return made.transform(sites).select("site", *[F.round(F.abs(c), 6).alias(f"{name}{a}") for a, c in enumerate(made.get_feature_names_out())])

    return run


def _site_join(estimator, targets: Sequence[str] = SPECIES, y_fit: Sequence[str] | None = None, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sites, _ = supplier_sites(spark, sf_dir)
        model = estimator(**params).fit(sites, ENVIRONMENT, targets, "site", y_fit)
        return model.kneighbors(return_dataframe_index=True).select("query_id", "rank", F.col("neighbor").alias("neighbor_id"), F.round("distance", 6).alias("distance"))

    return run


def gnn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, _ = supplier_sites(spark, sf_dir)
    made = GNNRegressor().fit(sites, ENVIRONMENT, SPECIES, "site").independent_prediction_
    return made.select("site", *[F.round(s, 6).alias(s) for s in SPECIES[:3]])


def mahalanobis_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = MahalanobisTransformer().fit_transform(_table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], prefix="w_")
    return made.select("c_custkey", F.round("w_c_acctbal", 6).alias("w1"), F.round("w_c_nationkey", 6).alias("w2"))


# ---- trees of one split


def _stump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")


STUMP = {"n_estimators": 1, "max_depth": 1, "bootstrap": False, "random_state": 0}
BOOSTED = {"n_estimators": 2, "max_depth": 1, "learning_rate": 0.5, "random_state": 0}


def forest_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = RFNodeTransformer(**STUMP).fit_transform(_stump_rows(spark, sf_dir), ["c_acctbal"], ["c_nationkey", "c_mktsegment"])
    return made.select("c_custkey", F.col("leaves")[0].alias("rf0_tree0"), F.col("leaves")[1].alias("rf1_tree0"))


def boosting_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = GBNodeTransformer(**BOOSTED).fit_transform(_stump_rows(spark, sf_dir), ["c_acctbal"], ["c_nationkey"])
    return made.select("c_custkey", F.col("leaves")[0].alias("gb0_tree0"), F.col("leaves")[1].alias("gb0_tree1"))


def boosting_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = GBNodeTransformer(**BOOSTED).fit(_stump_rows(spark, sf_dir), ["c_acctbal"], ["c_nationkey"])
    return spark.createDataFrame([(n, round(float(w), 6)) for n, w in zip(fitted.get_feature_names_out(), hamming_weights(fitted))], "tree string, weight double")


def uniform_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of two forests' trees under unequal forest weights."""
    rows = _stump_rows(spark, sf_dir)
    forests = RFNodeTransformer(n_estimators=4, max_depth=1, random_state=0).fit(rows, ["c_acctbal"], ["c_nationkey", "c_mktsegment"])
    boosted = GBNodeTransformer(n_estimators=2, max_depth=1, random_state=0, tree_weighting_method="uniform").fit(rows, ["c_acctbal"], ["c_nationkey", "c_mktsegment"])
    made = [(n, round(float(w), 9)) for t in (forests, boosted) for n, w in zip(t.get_feature_names_out(), hamming_weights(t, [3, 1]))]
    return spark.createDataFrame(made, "tree string, weight double")


def _tree_join(estimator, targets: Sequence[str], **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = estimator(**params).fit(_stump_rows(spark, sf_dir), ["c_acctbal"], targets, "c_custkey")
        return model.kneighbors(return_dataframe_index=True).select("query_id", "rank", F.col("neighbor").alias("neighbor_id"), F.round("distance", 6).alias("distance"))

    return run


# ---- raw features, repeated ids, callables


def raw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = RawKNNRegressor(algorithm="kd_tree", leaf_size=10).fit(_table(spark, sf_dir, "supplier"), ["s_acctbal", "s_nationkey"], ["s_acctbal"], "s_suppkey")
    return model.kneighbors(return_dataframe_index=True).select("query_id", "rank", F.col("neighbor").alias("neighbor_id"), F.round("distance", 6).alias("distance"))


def raw_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as suppliers of a like balance have them, weighted by distance."""
    model = RawKNNRegressor(weights="distance").fit(_table(spark, sf_dir, "supplier"), ["s_acctbal"], ["s_nationkey"], "s_suppkey")
    asked = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("s_acctbal"))
    return model.predict(asked, "c_custkey").select("c_custkey", F.round("s_nationkey", 6).alias("s_nationkey"))


def knn_callable_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", vector_of(["s_acctbal", "s_nationkey"]).alias("x"))
    return _shown(kneighbors(NeighbourIndex(rows, "s_suppkey", "x", metric=lambda a, b: abs(a[0] - b[0]) + 100 * abs(a[1] - b[1])), None, K))


def knn_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that several rows share: each row leaves out itself, not the others."""
    rows = _table(spark, sf_dir, "supplier").select("s_nationkey", vector_of(["s_acctbal"]).alias("x"))
    found = kneighbors(NeighbourIndex(rows, "s_nationkey", "x"), None, K)
    return found.select("query_id", "rank", "neighbor_position", "neighbor_id", F.round("distance", 6).alias("distance"))


# ---- schemas and sources


def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, and values that no feature may have, of columns with some."""
    rows = _table(spark, sf_dir, "customer").select(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("a.b"), F.when(F.col("c_acctbal") < 0, float("nan")).when(F.col("c_acctbal") > 9000, float("inf")).otherwise(F.col("c_acctbal")).alias("v"))
    return feature_counts(rows, ["a.b", "v"])


def nan_like_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_nationkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"), F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(F.col("c_acctbal")).alias("balance"))
    return rows.agg(*[F.count(F.when(is_nan_like(f.name, f.dataType), 1)).alias(f.name) for f in rows.schema.fields])


def schema_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name")
    types = get_feature_names_and_types(rows)
    return spark.createDataFrame([(i, n, is_number_like_type(types[n]), is_categorical_type(types[n])) for i, n in enumerate(get_feature_names(rows))], "position int, name string, number_like boolean, categorical boolean")


def promoted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer")
    types = get_feature_names_and_types(rows)
    pairs = [("c_custkey", "c_nationkey"), ("c_nationkey", "c_nationkey"), ("c_nationkey", "c_acctbal"), ("c_name", "c_mktsegment")]
    return spark.createDataFrame([(a, b, minimum_type([types[a], types[b]]).simpleString()) for a, b in pairs], "a string, b string, type string")


def promoted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of one type, the least that holds all."""
    return promote_targets(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"])


def _csv(df: DataFrame, at: str, name: str) -> str:
    df.coalesce(1).write.option("header", True).csv(f"{at}/{name}")
    return f"{at}/{name}"


def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    id_col, loaded, names = load_csv_data(spark, _csv(rows, folder(spark), "plots.csv"))
    return loaded.select(id_col, *names)


def _pair(spark: SparkSession, sf_dir: str, data: str, target: str) -> str:
    rows, at = _table(spark, sf_dir, "supplier"), folder(spark)
    _csv(rows.select("s_suppkey", "s_acctbal").orderBy("s_suppkey"), at, data)
    # rows are matched by their place, whatever ids the second file has
    _csv(rows.select(F.col("s_suppkey"), "s_nationkey", F.length("s_name").alias("name_length")).orderBy("s_suppkey").select((-F.col("s_suppkey")).alias("id"), "s_nationkey", "name_length"), at, target)
    return at


def csv_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _pair(spark, sf_dir, "env.csv", "spp.csv")
    return load_dataset_from_csv_filenames(spark, data_filename="env.csv", target_filename="spp.csv", folder=at, match="position").frame


def csv_named_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two published pairs by name, described."""
    moscow = load_moscow_stjoes(spark, match="position", folder=_pair(spark, sf_dir, "moscow_env.csv", "moscow_spp.csv"))
    data, target = load_swo_ecoplot(spark, return_X_y=True, as_frame=True, match="position", folder=_pair(spark, sf_dir, "swo_ecoplot_env.csv", "swo_ecoplot_spp.csv"))
    made = target.agg(F.sum("s_nationkey").alias("nations")).crossJoin(F.broadcast(data.agg(F.count("*").alias("n"))))  # one row each
    return made.select(F.lit(repr(moscow)).alias("described"), "n", "nations")


def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").toPandas()  # five rows
    return from_rows(spark, rows.set_index("r_regionkey"), id_col="r_regionkey").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


# ---- SQL


def _over(x: str) -> str:
    return f"sum({x}) OVER ()"


def _sites_sql(species: int = 25) -> str:
    sums = ", ".join(f"sum(CASE WHEN k = {j} THEN l_quantity ELSE 0 END) AS b{j}" for j in range(25))
    total = " + ".join(f"b{j}" for j in range(species))
    return f"""WITH RECURSIVE brand AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM part)),
line AS (SELECT l_suppkey AS site, l_quantity, l_extendedprice, l_discount, l_tax, k FROM lineitem JOIN part ON l_partkey = p_partkey JOIN brand USING (p_brand)),
plots AS (SELECT site, avg(l_quantity) AS e0, avg(l_extendedprice) AS e1, avg(l_discount) AS e2, avg(l_tax) AS e3, {sums} FROM line GROUP BY site),
sites AS (SELECT *, {total} AS r FROM plots)"""


def _orthonormal(source: str, columns: Sequence[str], made: str, name: str) -> str:
    """CTEs that add orthonormal columns ``made``0.. spanning the given ones; the last is called ``name``."""
    out, at = "", source
    for i, c in enumerate(columns):
        unit, rest = f"{name}_u{i}", name if i == len(columns) - 1 else f"{name}_r{i}"
        out += f",\n{unit} AS (SELECT *, {c}_ / sqrt({_over(f'{c}_ * {c}_')}) AS {made}{i} FROM {at})" if i else f",\n{name}_s AS (SELECT *, {', '.join(f'{x} AS {x}_' for x in columns)} FROM {at}),\n{unit} AS (SELECT *, {c}_ / sqrt({_over(f'{c}_ * {c}_')}) AS {made}{i} FROM {name}_s)"
        moved = ", ".join(f"{x}_ - {made}{i} * {_over(f'{made}{i} * {x}_')} AS {x}_" for x in columns[i + 1 :])
        out += f",\n{rest} AS (SELECT * REPLACE ({moved}) FROM {unit})" if moved else f",\n{rest} AS (SELECT * FROM {unit})"
        at = rest
    return out


def _eigen(source: str) -> str:
    """CTEs for the eigenvectors v0..v3 (lists) and eigenvalues l0..l3 of the four by four matrix m (a list) in a one-row CTE."""
    out, at = "", source
    square = ", ".join(" + ".join(f"m[{4 * a + k + 1}] * m[{4 * k + b + 1}]" for k in range(4)) for a in range(4) for b in range(4))
    vector = ", ".join(f"m[{4 * a} + j] / sqrt(m[5 * j - 4])" for a in range(4))
    value = " + ".join(f"v[{a + 1}] * m[{4 * a + b + 1}] * v[{b + 1}]" for a in range(4) for b in range(4))
    less = ", ".join(f"m[{4 * a + b + 1}] - l * v[{a + 1}] * v[{b + 1}]" for a in range(4) for b in range(4))
    for a in range(4):
        out += f""",
power{a} AS (SELECT 0 AS i, [x / (m[1] + m[6] + m[11] + m[16]) FOR x IN m] AS m FROM {at} UNION ALL SELECT i + 1, [x / (s[1] + s[6] + s[11] + s[16]) FOR x IN s] FROM (SELECT i, [{square}] AS s FROM power{a} WHERE i < 50)),
top{a} AS (SELECT [{vector}] AS v FROM (SELECT m, list_position([m[1], m[6], m[11], m[16]], list_max([m[1], m[6], m[11], m[16]])) AS j FROM power{a} WHERE i = 50)),
axis{a} AS (SELECT v, m, {value} AS l FROM top{a}, {at}),
left{a} AS (SELECT [{less}] AS m FROM axis{a})"""
        at = f"left{a}"
    return out + ",\neigen AS (SELECT " + ", ".join(f"axis{a}.v AS v{a}, axis{a}.l AS l{a}" for a in range(4)) + " FROM " + ", ".join(f"axis{a}" for a in range(4)) + ")"


def _gram(y: str, n: int) -> str:
    """The four by four matrix of the inner products that q0..q3 have with the n columns y0.."""
    rows = ", ".join(f"[{', '.join(f'sum(q{a} * {y}{j})' for j in range(n))}] AS h{a}" for a in range(4))
    return f",\nproducts AS (SELECT {rows} FROM basis),\ngram AS (SELECT *, [{', '.join(f'list_dot_product(h{a}, h{b})' for a in range(4) for b in range(4))}] AS m FROM products)"


def _cca_sql(species: int = 25) -> str:
    """CTEs up to ``scored``: a row for each site with w, q0..q3, y0.., z0..z3 and axes u0..u3; ``gram`` and ``eigen`` of one row."""
    share = f"(r / {_over('r')})"
    c = [f"({_over(f'b{j}')} / {_over('r')})" for j in range(species)]
    z = ", ".join(f"(e{a} - {_over(f'e{a} * r')} / {_over('r')}) * sqrt({share}) AS z{a}" for a in range(4))
    y = ", ".join(f"(b{j} / {_over('r')} - {share} * {c[j]}) / sqrt({share} * {c[j]}) AS y{j}, {c[j]} AS c{j}" for j in range(species))
    u = ", ".join(" + ".join(f"q{b} * v{a}[{b + 1}]" for b in range(4)) + f" AS u{a}" for a in range(4))
    largest = ", ".join(f"CASE WHEN greatest({', '.join(f'abs(p{a}{b})' for b in range(4))}) = greatest({', '.join(f'p{a}{b}' for b in range(4))}) THEN 1.0 ELSE -1.0 END AS g{a}" for a in range(4))
    signs = ", ".join(f"sum(z{b} * u{a}) / sqrt(sum(z{b} * z{b})) AS p{a}{b}" for a in range(4) for b in range(4))
    return (
        _sites_sql(species) + f",\nchi AS (SELECT *, sqrt({share}) AS w, {z}, {y} FROM sites)" + _orthonormal("chi", ["z0", "z1", "z2", "z3"], "q", "basis")
        + _gram("y", species) + _eigen("gram") + f",\nscored AS (SELECT *, {u} FROM basis, eigen),\nbiplot AS (SELECT {signs} FROM scored),\nsigns AS (SELECT *, {largest} FROM biplot)"
    )


def _site_scores_sql() -> str:
    turned = ", ".join("[" + ", ".join(" + ".join(f"v{a}[{b + 1}] * h{b}[{j + 1}]" for b in range(4)) for j in range(25)) + f"] AS t{a}" for a in range(4))
    lc = ", ".join(f"round(g{a} * u{a} / w, 5) AS lc{a}" for a in range(4))
    ys = "[" + ", ".join(f"y{j}" for j in range(25)) + "]"
    wa = ", ".join(f"round(g{a} * list_dot_product({ys}, t{a}) / scored.l{a} / w, 5) AS wa{a}" for a in range(4))
    return _cca_sql() + f",\nturned AS (SELECT {turned} FROM gram, eigen) SELECT site, {lc}, {wa} FROM scored, turned, signs"


def _species_sql() -> str:
    turned = ", ".join("[" + ", ".join(" + ".join(f"v{a}[{b + 1}] * h{b}[{j + 1}]" for b in range(4)) for j in range(25)) + f"] AS t{a}" for a in range(4))
    score = ", ".join(f"t{a}[k + 1] / sqrt(c) AS s{a}" for a in range(4))
    tolerance = ", ".join(f"round(sqrt(sum(b * pow(lc{a} - s{a}, 2)) / sum(b)), 5) AS tolerance{a}" for a in range(4))
    return _cca_sql() + f""",
turned AS (SELECT {turned} FROM gram, eigen),
long AS (SELECT unnest(range(25)) AS k, unnest([{", ".join(f"b{j}" for j in range(25))}]) AS b, unnest([{", ".join(f"c{j}" for j in range(25))}]) AS c, {", ".join(f"u{a} / w AS lc{a}" for a in range(4))} FROM scored),
placed AS (SELECT long.*, {score} FROM long, turned)
SELECT p_brand AS brand, {", ".join(f"round(max(s{a}) * max(g{a}), 5) AS score{a}" for a in range(4))}, {tolerance} FROM placed JOIN brand USING (k), signs GROUP BY p_brand"""


def _residuals_sql() -> str:
    made = ", ".join(f"round(y{j} - ({' + '.join(f'q{a} * h{a}[{j + 1}]' for a in range(4))}), 7) AS b{j}" for j in range(25))
    return _cca_sql() + f" SELECT site, {made} FROM scored, products"


def _cca_axes_sql() -> str:
    return _cca_sql() + " " + " UNION ALL ".join(f"SELECT CAST({a} AS INTEGER) AS axis, round(l{a}, 9) AS eigenvalue, {', '.join(f'round(g{a} * p{a}{b}, 6) AS {c}' for b, c in enumerate(ENVIRONMENT))} FROM eigen, signs" for a in range(4))


def _then_knn(ctes: str, base: str, axes: int) -> str:
    """SQL of the neighbours of a base with id and f0.. under CTEs of its own."""
    distance = "sqrt(" + " + ".join(f"(a.f{a} - b.f{a}) * (a.f{a} - b.f{a})" for a in range(axes)) + ")"
    return ctes + "," + _knn_sql(base, distance).strip().removeprefix("WITH")


_SHOW = " SELECT query_id, rank, neighbor_id, round(d, 6) AS distance FROM ordered"


def _gnn_base(axes: int = 4) -> str:
    return "SELECT site AS id, " + ", ".join(f"u{a} / w * sqrt(scored.l{a} / (scored.l0 + scored.l1 + scored.l2 + scored.l3)) AS f{a}" for a in range(axes)) + " FROM scored"


def _ccora_sql() -> str:
    """CTEs up to ``tested``: correlations r0.., p-values p0.. and the number of components n of one row; ``variates`` has u0..u3."""
    unit = lambda c, n: f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {n}"
    columns = ", ".join([unit(f"e{a}", f"x{a}") for a in range(4)] + [unit(f"b{j}", f"t{j}") for j in range(25)])
    u = ", ".join(" + ".join(f"q{b} * v{a}[{b + 1}]" for b in range(4)) + f" AS u{a}" for a in range(4))
    cuts, tests = 4000, []
    for i in range(4):
        p, q = 25 - i, 4 - i
        power = float(np.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)))
        wilks = f"pow({' * '.join(f'(1 - least(l{j}, 1))' for j in range(i, 4))}, {1 / power!r})"
        left = f"((SELECT count(*) FROM sites) - 4 - 1 - {(21 + 1) / 2})"
        a, b = f"(({left} * {power!r} - {(p * q - 2) / 2}) / 2)", p * q / 2
        # the share of the beta distribution below: Simpson's rule
        inner = f"exp(({a} - 1) * ln(wilks * s / {cuts}) + {b - 1} * ln(1 - wilks * s / {cuts}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"
        tests.append(f"(SELECT sum(CASE WHEN s = {cuts} THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END * {inner}) * max(wilks) / {cuts} / 3 FROM (SELECT {wilks} AS wilks FROM eigen), (SELECT unnest(range(1, {cuts + 1})) AS s)) AS p{i}")
    return (
        _sites_sql() + f",\nunits AS (SELECT *, {columns} FROM sites)" + _orthonormal("units", [f"x{a}" for a in range(4)], "q", "basis_x") + _orthonormal("basis_x", [f"t{j}" for j in range(25)], "y", "basis")
        + _gram("y", 25) + _eigen("gram") + f",\nvariates AS (SELECT *, {u} FROM basis, eigen),\np_values AS (SELECT {', '.join(tests)}),\n"
        + "tested AS (SELECT *, greatest(1, CAST(p0 <= 0.05 AS INTEGER) + CAST(p1 <= 0.05 AS INTEGER) + CAST(p2 <= 0.05 AS INTEGER) + CAST(p3 <= 0.05 AS INTEGER)) AS n FROM p_values)"
    )


def _ccora_axes_sql() -> str:
    return _ccora_sql() + " " + " UNION ALL ".join(f"SELECT CAST({a} AS INTEGER) AS axis, round(sqrt(l{a}), 8) AS correlation, round(p{a}, 6) AS p_value, CAST(n AS INTEGER) AS n_components FROM eigen, tested" for a in range(4))


_MSN_BASE = "SELECT site AS id, " + ", ".join(f"CASE WHEN n > {a} THEN sqrt((SELECT count(*) FROM sites) - 1) * u{a} * sqrt(variates.l{a}) ELSE 0 END AS f{a}" for a in range(4)) + " FROM variates, tested"


def _stump_sql(y: str, name: str, least: int, source: str = "rows", group: str = "") -> str:
    """CTE ``name`` with the cut of one split on x that leaves the least squares of y (or of the indicators of a class)."""
    if group:
        parts = f"(SELECT x, {group} AS c, count(*) AS s FROM {source} GROUP BY 1, 2)"
        running = f"SELECT g.x, c.c, sum(coalesce(p.s, 0)) OVER (PARTITION BY c.c ORDER BY g.x) AS s, sum(coalesce(p.s, 0)) OVER (PARTITION BY c.c) AS t FROM (SELECT DISTINCT x FROM {source}) g CROSS JOIN (SELECT DISTINCT {group} AS c FROM {source}) c LEFT JOIN {parts} p ON p.x = g.x AND p.c = c.c"
        squares = f"SELECT x, sum(s * s) AS ls, sum((t - s) * (t - s)) AS rs FROM ({running}) GROUP BY x"
        rows = f"SELECT x, n, m, ls / n + rs / (m - n) AS gain FROM ({squares}) JOIN (SELECT x, sum(count(*)) OVER (ORDER BY x) AS n, sum(count(*)) OVER () AS m FROM {source} GROUP BY x) USING (x) WHERE n >= {least} AND m - n >= {least}"
    else:
        running = f"SELECT x, sum(count(*)) OVER (ORDER BY x) AS n, sum(count(*)) OVER () AS m, sum(sum({y})) OVER (ORDER BY x) AS s, sum(sum({y})) OVER () AS t FROM {source} GROUP BY x"
        rows = f"SELECT x, n, m, s * s / n + (t - s) * (t - s) / (m - n) AS gain FROM ({running}) WHERE n >= {least} AND m - n >= {least}"
    return f"{name} AS (SELECT arg_max(x, gain) AS cut FROM ({rows}))"


_STUMP_ROWS = "WITH rows AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y, c_mktsegment AS g FROM customer)"
_FOREST = f"{_STUMP_ROWS}, {_stump_sql('y', 'one', 5)}, {_stump_sql('', 'two', 5, group='g')}, leaves AS (SELECT id, CASE WHEN x <= one.cut THEN 1 ELSE 2 END AS f1, CASE WHEN x <= two.cut THEN 1 ELSE 2 END AS f2 FROM rows, one, two)"
_BOOSTED = f"""{_STUMP_ROWS}, start AS (SELECT *, y - avg(y) OVER () AS e FROM rows), {_stump_sql('e', 'one', 1, 'start')},
first AS (SELECT start.*, CASE WHEN x <= cut THEN 1 ELSE 2 END AS f1 FROM start, one), second AS (SELECT * REPLACE (e - {BOOSTED['learning_rate']} * avg(e) OVER (PARTITION BY f1) AS e), e AS e0 FROM first), {_stump_sql('e', 'two', 1, 'second')},
leaves AS (SELECT second.*, CASE WHEN x <= cut THEN 1 ELSE 2 END AS f2 FROM second, two), third AS (SELECT *, e - {BOOSTED['learning_rate']} * avg(e) OVER (PARTITION BY f2) AS e2 FROM leaves),
losses AS (SELECT avg(e0 * e0) AS a, avg(e * e) AS b, avg(e2 * e2) AS c FROM third)"""


def _leaf_knn(ctes: str, weights: tuple[str, str]) -> str:
    distance = f"(CASE WHEN a.f1 <> b.f1 THEN {weights[0]} ELSE 0::DOUBLE END + CASE WHEN a.f2 <> b.f2 THEN {weights[1]} ELSE 0::DOUBLE END)"
    return ctes + "," + _knn_sql("SELECT id, f1, f2 FROM leaves", distance).strip().removeprefix("WITH") + _SHOW


_SUPPLIER = "SELECT s_suppkey AS id, s_acctbal AS f1, s_nationkey AS f2 FROM supplier"
_KIND = "CASE WHEN typeof({c}) IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT') THEN {yes} ELSE {no} END"


def _schema_sql() -> str:
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name"]
    one = "(SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey LIMIT 1)"
    return " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS position, '{n}' AS name, {_KIND.format(c=n, yes='TRUE', no='FALSE')} AS number_like, typeof({n}) = 'VARCHAR' AS categorical FROM {one}" for i, n in enumerate(names))


def _types_sql() -> str:
    pairs = [("c_custkey", "c_nationkey"), ("c_nationkey", "c_nationkey"), ("c_nationkey", "c_acctbal"), ("c_name", "c_mktsegment")]
    kind = "CASE typeof([{a}, {b}][1]) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END"
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {kind.format(a=a, b=b)} AS type FROM (SELECT * FROM customer LIMIT 1)" for a, b in pairs)


_RAW = _knn_sql(_SUPPLIER, "sqrt((a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2))") + _SHOW
_RAW_PREDICT = f"""WITH pairs AS (SELECT c_custkey, s_nationkey, abs(c_acctbal - s_acctbal) AS d, s_suppkey FROM customer, supplier),
chosen AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) <= {K}),
weighted AS (SELECT *, CASE WHEN min(d) OVER (PARTITION BY c_custkey) = 0 THEN CAST(d = 0 AS INTEGER) ELSE 1 / d END AS w FROM chosen)
SELECT c_custkey, round(sum(w * s_nationkey) / sum(w), 6) AS s_nationkey FROM weighted GROUP BY 1"""
_REPEATED = _knn_sql("SELECT row_number() OVER (ORDER BY s_nationkey, s_acctbal) AS id, s_nationkey AS shared, s_acctbal AS f FROM supplier", "abs(a.f - b.f)") + " SELECT q.shared AS query_id, rank, np AS neighbor_position, n.shared AS neighbor_id, round(d, 6) AS distance FROM ordered JOIN base q ON q.id = query_id JOIN base n ON n.id = ordered.neighbor_id"
_GNN_PREDICT = _then_knn(_cca_sql(), _gnn_base(), 4) + " SELECT query_id AS site, round(avg(s.b0), 6) AS b0, round(avg(s.b1), 6) AS b1, round(avg(s.b2), 6) AS b2 FROM ordered JOIN sites s ON s.site = neighbor_id GROUP BY 1"
_WHITE = "WITH z AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z1, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER () AS z2 FROM customer), rho AS (SELECT corr(z1, z2) AS rho FROM z) SELECT c_custkey, round(z1, 6) AS w1, round((z2 - rho * z1) / sqrt(1 - rho * rho), 6) AS w2 FROM z, rho"
_UNIFORM = """SELECT 'rf' || f || '_tree' || t AS tree, CASE WHEN f = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END / 4 AS weight FROM range(2) a(f), range(4) b(t)
UNION ALL SELECT 'gb0_tree' || t, 0.75::DOUBLE / 2 FROM range(2) b(t)
UNION ALL SELECT 'gb1_cls' || c || '_tree' || t, round(0.25::DOUBLE / (2 * n) / n, 9) FROM (SELECT count(DISTINCT c_mktsegment) AS n FROM customer), range(5) a(c), range(2) b(t) WHERE c < n"""

ALL: dict[str, tuple[Query, str | None]] = {
    "cca_axes": (cca_axes, _cca_axes_sql()),
    "cca_site_scores": (cca_site_scores, _site_scores_sql()),
    "cca_species": (cca_species, _species_sql()),
    "cca_residuals": (cca_residuals, _residuals_sql()),
    "cca_transform": (_transformed(lambda: CCATransformer(3), "cca"), _cca_sql() + " SELECT id AS site, " + ", ".join(f"round(abs(f{a}), 6) AS cca{a}" for a in range(3)) + f" FROM ({_gnn_base()})"),
    "ccora_axes": (ccora_axes, _ccora_axes_sql()),
    "ccora_transform": (_transformed(lambda: CCorATransformer(1), "ccora"), _ccora_sql() + f" SELECT id AS site, round(abs(f0), 6) AS ccora0 FROM ({_MSN_BASE})"),
    "gnn_knn": (_site_join(GNNRegressor), _then_knn(_cca_sql(), _gnn_base(), 4) + _SHOW),
    "gnn_two_axes": (_site_join(GNNRegressor, n_components=2), _then_knn(_cca_sql(), _gnn_base(2), 2) + _SHOW),
    "gnn_y_fit": (_site_join(GNNRegressor, SPECIES[:2], SPECIES[:10]), _then_knn(_cca_sql(10), _gnn_base(), 4) + _SHOW),
    "gnn_predict": (gnn_predict, _GNN_PREDICT),
    "msn_knn": (_site_join(MSNRegressor), _then_knn(_ccora_sql(), _MSN_BASE, 4) + _SHOW),
    "mahalanobis_space": (mahalanobis_space, _WHITE),
    "forest_stumps": (forest_stumps, _FOREST + " SELECT id AS c_custkey, CAST(f1 AS BIGINT) AS rf0_tree0, CAST(f2 AS BIGINT) AS rf1_tree0 FROM leaves"),
    "boosting_stumps": (boosting_stumps, _BOOSTED + " SELECT id AS c_custkey, CAST(f1 AS BIGINT) AS gb0_tree0, CAST(f2 AS BIGINT) AS gb0_tree1 FROM leaves"),
    "boosting_improvement": (boosting_improvement, _BOOSTED + " SELECT 'gb0_tree0' AS tree, round((a - b) / (a - c), 6) AS weight FROM losses UNION ALL SELECT 'gb0_tree1', round((b - c) / (a - c), 6) FROM losses"),
    "uniform_weights": (uniform_weights, _UNIFORM),
    "rfnn_stumps": (_tree_join(RFNNRegressor, ["c_nationkey", "c_mktsegment"], forest_weights=[0.75, 0.25], **STUMP), _leaf_knn(_FOREST, ("0.75::DOUBLE", "0.25::DOUBLE"))),
    "gbnn_stumps": (_tree_join(GBNNRegressor, ["c_nationkey"], **BOOSTED), _leaf_knn(_BOOSTED, ("(SELECT (a - b) / (a - c) FROM losses)", "(SELECT (b - c) / (a - c) FROM losses)"))),
    "raw_knn": (raw_knn, _RAW),
    "raw_predict": (raw_predict, _RAW_PREDICT),
    "knn_callable_metric": (knn_callable_metric, _knn_sql(_SUPPLIER, "abs(a.f1 - b.f1) + 100 * abs(a.f2 - b.f2)") + _SHOW),
    "knn_repeated_ids": (knn_repeated_ids, _REPEATED),
    "validation_counts": (validation_counts, "SELECT count(*) AS n, count(*) FILTER (c_nationkey IS NULL OR c_nationkey = 3) AS bad_0, count(*) FILTER (c_acctbal IS NULL OR c_acctbal < 0 OR c_acctbal > 9000) AS bad_1 FROM customer"),
    "nan_like_counts": (nan_like_counts, "SELECT count(*) FILTER (c_nationkey IS NULL) AS c_nationkey, count(*) FILTER (c_mktsegment IS NULL OR c_mktsegment = 'BUILDING') AS segment, count(*) FILTER (c_acctbal IS NULL OR c_acctbal < 0) AS balance FROM customer"),
    "target_types": (None, " UNION ALL ".join(f"SELECT '{c}' AS target, " + _KIND.format(c=c, yes="'regression'", no="'classification'") + " AS kind FROM (SELECT * FROM customer LIMIT 1)" for c in ("c_acctbal", "c_mktsegment", "c_nationkey"))),
    "schema_kinds": (schema_kinds, _schema_sql()),
    "promoted_types": (promoted_types, _types_sql()),
    "promoted_targets": (promoted_targets, "SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer"),
    "csv_table": (csv_table, "SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS s_nationkey FROM supplier"),
    "csv_pair": (csv_pair, "SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS s_nationkey, CAST(length(s_name) AS DOUBLE) AS name_length FROM supplier"),
    "csv_named_pairs": (csv_named_pairs, "SELECT 'Dataset(n=' || count(*) || ', features=1, targets=2)' AS described, count(*) AS n, CAST(sum(s_nationkey) AS DOUBLE) AS nations FROM supplier"),
    "memory_rows": (memory_rows, "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
}
