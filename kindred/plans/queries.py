"""Queries over the driver's tables, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.schema import target_kinds, vector_of
from kindred.functions.storage import materialised
from kindred.operators.knn import NeighbourIndex, kneighbors, kneighbors_graph
from kindred.operators.ordination import CCA
from kindred.operators.predict import impute_nearest, predict, r2_scores
from kindred.operators.transforms import StandardScalerWithDOF
from kindred.operators.trees import GBNodeTransformer, RFNodeTransformer, hamming_weights
from kindred.plans.estimators import EuclideanKNNRegressor, GBNNRegressor, MahalanobisKNNRegressor, RFNNRegressor

K = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "neighbor_id", F.round("distance", 6).alias("distance"))


def _embedding_join(metric: str, p: float = 2) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _shown(kneighbors(NeighbourIndex(_embeddings(spark, sf_dir), "vec_id", "x", metric=metric, p=p), None, K))


def knn_query_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    return _shown(kneighbors(NeighbourIndex(rows, "vec_id", "x"), rows.where("vec_id % 100 = 0"), K))


def knn_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join by column arithmetic and windows."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", vector_of(["s_acctbal", "s_nationkey"]).alias("x"))
    return _shown(kneighbors(NeighbourIndex(rows, "s_suppkey", "x"), None, K, strategy="columns"))


def knn_det_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", vector_of(["p_size"]).alias("x"))
    return _shown(kneighbors(NeighbourIndex(rows, "p_partkey", "x"), None, K))


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", vector_of(["c_acctbal"]).alias("x"))
    edges = kneighbors_graph(NeighbourIndex(rows, "c_custkey", "x"), None, K, "distance")
    return edges.select("query_id", "neighbor_id", F.round("weight", 6).alias("weight"))


def _label_index(spark: SparkSession, sf_dir: str) -> NeighbourIndex:
    return NeighbourIndex(_embeddings(spark, sf_dir), "vec_id", "x", ["label"])


def _label_prediction(weights) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: predict(_label_index(spark, sf_dir), None, K, weights).select("vec_id", F.round("label", 6).alias("label"))


def predict_k1_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", vector_of(["c_acctbal"]).alias("x"), "c_mktsegment")
    return impute_nearest(NeighbourIndex(rows, "c_custkey", "x"), None, ["c_mktsegment"])


def independent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _label_index(spark, sf_dir)
    return r2_scores(_embeddings(spark, sf_dir), predict(index, None, K), "vec_id", ["label"]).select(F.round("r2_label", 6).alias("r2_label"), F.round("score", 6).alias("score"))


def score_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ids that 100 divides, scored as new rows against all: each finds itself too."""
    rows = _embeddings(spark, sf_dir)
    asked = rows.where("vec_id % 100 = 0")
    return r2_scores(asked, predict(_label_index(spark, sf_dir), asked, K), "vec_id", ["label"]).select(F.round("score", 6).alias("score"))


def _scaled(ddof: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "customer")
        made = StandardScalerWithDOF(ddof).fit_transform(rows, ["c_acctbal", "c_nationkey"], prefix="z_")
        return made.select("c_custkey", F.round("z_c_acctbal", 6).alias("z_acctbal"), F.round("z_c_nationkey", 6).alias("z_nationkey"))

    return run


def _fitted_join(estimator, table: str, features: list[str], id_col: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = estimator().fit(_table(spark, sf_dir, table), features, features[:1], id_col)
        found = model.kneighbors(return_dataframe_index=True)
        return found.select("query_id", "rank", F.col("neighbor").alias("neighbor_id"), F.round("distance", 6).alias("distance"))

    return run


def hamming_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories stand for leaf ids."""
    leaves = F.array(F.col("c_nationkey").cast("double"), F.pmod(F.crc32(F.col("c_mktsegment").cast("binary")), F.lit(97)).cast("double"), F.floor(F.col("c_acctbal") / 1000).cast("double"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", leaves.alias("x"))
    return _shown(kneighbors(NeighbourIndex(rows, "c_custkey", "x", metric="hamming", w=[0.5, 0.25, 0.25]), None, K))


def id_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and the ids they stand for."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", vector_of(["s_acctbal"]).alias("x"))
    return kneighbors(NeighbourIndex(rows, "s_suppkey", "x"), None, K).select("query_id", "rank", "neighbor_position", "neighbor_id")


ENVIRONMENT = ["qty", "price", "discount", "tax"]


def supplier_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Suppliers as sites: means of their lines as environment, quantities by brand as abundances."""
    lines, parts = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = sorted(r[0] for r in parts.select("p_brand").distinct().collect())  # 25 of them
    both = lines.join(parts, lines.l_partkey == parts.p_partkey)
    abundance = [F.coalesce(F.sum(F.when(F.col("p_brand") == b, F.col("l_quantity"))), F.lit(0.0)).alias(f"b{i}") for i, b in enumerate(brands)]
    means = [F.avg(c).alias(n) for c, n in zip(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ENVIRONMENT)]
    # a row for each supplier, read by each pass of a fit
    return materialised(both.groupBy(F.col("l_suppkey").alias("site")).agg(*means, *abundance), "sites"), brands


def _cca(spark: SparkSession, sf_dir: str) -> tuple[CCA, list[str]]:
    sites, brands = supplier_sites(spark, sf_dir)
    return CCA(sites, ENVIRONMENT, [f"b{i}" for i in range(len(brands))]), brands


def cca_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    cca, _ = _cca(spark, sf_dir)
    return cca.df.select("site", F.round(cca.rowsum, 9).alias("rw"))


def cca_species_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    cca, brands = _cca(spark, sf_dir)
    return spark.createDataFrame([(b, round(float(w), 4), round(float(c), 9)) for b, w, c in zip(brands, cca.species_weights, cca.colsum)], "brand string, weight double, cw double")


def cca_env_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    cca, _ = _cca(spark, sf_dir)
    return spark.createDataFrame([tuple(round(float(v), 6) for v in cca.center)], ", ".join(f"{c} double" for c in ENVIRONMENT))


def cca_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    cca, _ = _cca(spark, sf_dir)
    return spark.createDataFrame([(round(cca.grand_total, 3), round(cca.tot_chi, 8))], "grand_total double, inertia double")


def hill_n2_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    cca, _ = _cca(spark, sf_dir)
    return cca.site_n2("site").select("site", F.round("n2", 6).alias("n2"))


def hill_n2_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    cca, brands = _cca(spark, sf_dir)
    return spark.createDataFrame([(b, round(float(v), 6)) for b, v in zip(brands, cca.species_n2())], "brand string, n2 double")


def _tree_model(estimator, **params) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.length("s_name").alias("name_length"))
        rows = rows.withColumn("rich", F.col("s_acctbal") > 5000)
        model = estimator(n_neighbors=3, random_state=1, **params).fit(rows, ["s_nationkey", "s_acctbal", "name_length"], ["s_acctbal", "rich"], "s_suppkey")
        return model.kneighbors(return_dataframe_index=True)

    return run


def forest_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier")
    return RFNodeTransformer(n_estimators=5, random_state=1).fit_transform(rows, ["s_nationkey", "s_acctbal"], ["s_acctbal"]).select("s_suppkey", "leaves")


def boosting_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier")
    fitted = GBNodeTransformer(n_estimators=10, random_state=1).fit(rows, ["s_nationkey", "s_acctbal"], ["s_acctbal"])
    return spark.createDataFrame([(n, float(w)) for n, w in zip(fitted.get_feature_names_out(), hamming_weights(fitted))], "tree string, weight double")


def target_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
    return spark.createDataFrame(sorted(target_kinds(rows, rows.columns).items()), "target string, kind string")


# ---- SQL

_E = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings"


def _knn_sql(base: str, distance: str, pairs: str = "a.pos <> b.pos", queries: str = "TRUE", qpos: str = "a.pos") -> str:
    """SQL of the join: base has id and features; distance is over rows a and b."""
    return f"""
WITH base AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM ({base})),
asked AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS qpos FROM base WHERE {queries}),
pairs AS (SELECT a.id AS query_id, {qpos} AS qp, b.pos AS np, b.id AS neighbor_id, {distance} AS d FROM asked a JOIN base b ON {pairs}),
chosen AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, np) <= {K}),
scaled AS (SELECT *, greatest(max(d) OVER (PARTITION BY query_id), 1.0) AS s FROM chosen),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round_even(d / s * 1e10, 0), abs(qp - np), np) AS INTEGER) AS rank FROM scaled)
"""


_SHOW = "SELECT query_id, rank, neighbor_id, round(d, 6) AS distance FROM ordered"
_L2 = "list_distance(a.x, b.x)"
_ZIP = "list_zip(a.x, b.x)"


def _metric_sql(kind: str) -> str:
    return {
        "manhattan": f"list_sum([abs(z[1] - z[2]) FOR z IN {_ZIP}])",
        "chebyshev": f"list_max([abs(z[1] - z[2]) FOR z IN {_ZIP}])",
        "minkowski": f"pow(list_sum([pow(abs(z[1] - z[2]), 3) FOR z IN {_ZIP}]), 1.0 / 3)",
        "cosine": "1 - list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)))",
    }[kind]


def _predict_sql(weight: str, base: str = "") -> str:
    return (base or _knn_sql(_E, _L2)) + f", w AS (SELECT o.query_id, e.label, {weight} AS w FROM ordered o JOIN embeddings e ON e.vec_id = o.neighbor_id), made AS (SELECT query_id AS vec_id, sum(w * label) / sum(w) AS p FROM w GROUP BY query_id) "


_BY_DISTANCE = "CASE WHEN min(d) OVER (PARTITION BY query_id) = 0 THEN CAST(d = 0 AS INTEGER) ELSE 1 / d END"
_R2 = ", both_ AS (SELECT e.label AS y, m.p FROM made m JOIN embeddings e USING (vec_id)), mean AS (SELECT avg(y) AS m FROM both_) "
_R2_VALUE = "round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6)"
_SITES = "WITH cells AS (SELECT l_suppkey AS site, p_brand AS brand, sum(l_quantity) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), sites AS (SELECT site, sum(y) AS r FROM cells GROUP BY 1), species AS (SELECT brand, sum(y) AS c FROM cells GROUP BY 1), total AS (SELECT sum(y) AS t FROM cells) "
_Z = "SELECT p_partkey AS id, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS z1, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS z2 FROM part"
_C = "SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z1, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER () AS z2 FROM customer"
_W = f"SELECT id, z1, (z2 - rho * z1) / sqrt(1 - rho * rho) AS z2 FROM (SELECT *, corr(z1, z2) OVER () AS rho FROM ({_C}))"


def _scaled_sql(sd: str) -> str:
    return f"SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / {sd}(c_acctbal) OVER (), 6) AS z_acctbal, round((c_nationkey - avg(c_nationkey) OVER ()) / {sd}(c_nationkey) OVER (), 6) AS z_nationkey FROM customer"


_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "knn_self_embeddings": (_embedding_join("euclidean"), _knn_sql(_E, _L2) + _SHOW),
    "knn_query_embeddings": (knn_query_embeddings, _knn_sql(_E, _L2, "TRUE", "id % 100 = 0", "a.qpos") + _SHOW),
    "knn_manhattan": (_embedding_join("manhattan"), _knn_sql(_E, _metric_sql("manhattan")) + _SHOW),
    "knn_chebyshev": (_embedding_join("chebyshev"), _knn_sql(_E, _metric_sql("chebyshev")) + _SHOW),
    "knn_minkowski3": (_embedding_join("minkowski", 3), _knn_sql(_E, _metric_sql("minkowski")) + _SHOW),
    "knn_cosine": (_embedding_join("cosine"), _knn_sql(_E, _metric_sql("cosine")) + _SHOW),
    "knn_columns": (knn_columns, _knn_sql("SELECT s_suppkey AS id, s_acctbal AS f1, s_nationkey AS f2 FROM supplier", "sqrt((a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2))") + _SHOW),
    "knn_det_ties": (knn_det_ties, _knn_sql("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS f FROM part", "abs(a.f - b.f)") + _SHOW),
    "knn_graph": (knn_graph, _knn_sql("SELECT c_custkey AS id, c_acctbal AS f FROM customer", "abs(a.f - b.f)") + "SELECT query_id, neighbor_id, round(d, 6) AS weight FROM ordered"),
    "predict_uniform": (_label_prediction("uniform"), _predict_sql("1.0") + "SELECT vec_id, round(p, 6) AS label FROM made"),
    "predict_distance": (_label_prediction("distance"), _predict_sql(_BY_DISTANCE) + "SELECT vec_id, round(p, 6) AS label FROM made"),
    "predict_inv1p": (_label_prediction(lambda d: 1 / (1 + d)), _predict_sql("1 / (1 + d)") + "SELECT vec_id, round(p, 6) AS label FROM made"),
    "predict_k1_category": (predict_k1_category, _knn_sql("SELECT c_custkey AS id, c_acctbal AS f FROM customer", "abs(a.f - b.f)").replace(f"<= {K}", "<= 1") + "SELECT query_id AS c_custkey, neighbor_id, c_mktsegment FROM ordered JOIN customer ON c_custkey = neighbor_id"),
    "independent_score": (independent_score, _predict_sql("1.0") + _R2 + f"SELECT {_R2_VALUE} AS r2_label, {_R2_VALUE} AS score FROM both_, mean"),
    "score_r2": (score_r2, _predict_sql("1.0", _knn_sql(_E, _L2, "TRUE", "id % 100 = 0", "a.qpos")) + _R2 + f"SELECT {_R2_VALUE} AS score FROM both_, mean"),
    "scale_ddof0": (_scaled(0), _scaled_sql("stddev_pop")),
    "scale_ddof1": (_scaled(1), _scaled_sql("stddev_samp")),
    "euclidean_knn": (_fitted_join(EuclideanKNNRegressor, "part", ["p_size", "p_retailprice"], "p_partkey"), _knn_sql(_Z, "sqrt((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2))") + _SHOW),
    "mahalanobis2d": (_fitted_join(MahalanobisKNNRegressor, "customer", ["c_acctbal", "c_nationkey"], "c_custkey"), _knn_sql(_W, "sqrt((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2))") + _SHOW),
    "hamming_weighted": (hamming_weighted, _knn_sql("SELECT c_custkey AS id, c_nationkey AS f1, c_mktsegment AS f2, floor(c_acctbal / 1000) AS f3 FROM customer", "(CASE WHEN a.f1 <> b.f1 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN a.f2 <> b.f2 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN a.f3 <> b.f3 THEN 0.25::DOUBLE ELSE 0 END)") + _SHOW),
    "id_crosswalk": (id_crosswalk, _knn_sql("SELECT s_suppkey AS id, s_acctbal AS f FROM supplier", "abs(a.f - b.f)") + "SELECT query_id, rank, np AS neighbor_position, neighbor_id FROM ordered"),
    "cca_weights": (cca_weights, _SITES + "SELECT site, round(r / t, 9) AS rw FROM sites, total"),
    "cca_species_weights": (cca_species_weights, _SITES + "SELECT brand, round(c, 4) AS weight, round(c / t, 9) AS cw FROM species, total"),
    "cca_env_center": (cca_env_center, _SITES + ", env AS (SELECT l_suppkey AS site, avg(l_quantity) AS qty, avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT round(sum(qty * r / t), 6) AS qty, round(sum(price * r / t), 6) AS price, round(sum(discount * r / t), 6) AS discount, round(sum(tax * r / t), 6) AS tax FROM env JOIN sites USING (site), total"),
    "cca_inertia": (cca_inertia, _SITES + "SELECT round(max(t), 3) AS grand_total, round(sum(y * y / (r * c)) - 1, 8) AS inertia FROM cells JOIN sites USING (site) JOIN species USING (brand), total"),
    "hill_n2_site": (hill_n2_site, _SITES + "SELECT site, round(1 / sum((y / r) * (y / r)), 6) AS n2 FROM cells JOIN sites USING (site) GROUP BY 1"),
    "hill_n2_species": (hill_n2_species, _SITES + "SELECT brand, round(1 / sum((y / c) * (y / c)), 6) AS n2 FROM cells JOIN species USING (brand) GROUP BY 1"),
    "target_types": (target_types, None),
    "rfnn_knn": (_tree_model(RFNNRegressor, n_estimators=10), None),
    "gbnn_knn": (_tree_model(GBNNRegressor, n_estimators=10), None),
    "forest_leaves": (forest_leaves, None),
    "boosting_weights": (boosting_weights, None),
}


def _registered() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from kindred.plans.model_queries import ALL

    return _ALL | {name: (run or _ALL[name][0], sql) for name, (run, sql) in ALL.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered().items() if sql}
