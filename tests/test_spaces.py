"""Feature spaces against direct formulas, forests, estimators, sources, streaming."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions import schema
from kindred.functions.linalg import f_cdf, tall_skinny_r
from kindred.operators.ordination import CCA, correlation_test
from kindred.operators.transforms import CCATransformer, CCorATransformer, MahalanobisTransformer, StandardScalerWithDOF
from kindred.operators.trees import Boosting, GBNodeTransformer, Grower, LargeForest, RFNodeTransformer, hamming_weights, train_improvement, validated_forest_weights
from kindred.plans import estimators as E
from kindred.sources import tables
from kindred.streaming.scorer import neighbours_stream, score_stream

X, Y = ["a", "b", "c"], ["p", "q", "r", "s"]


def plots(n=90, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]]) + [5, -3, 100]
    y = np.abs(x @ r.normal(size=(3, 4)) + r.normal(size=(n, 4))) + 0.1
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = plots()
    rows = [(i, *map(float, x[i]), *map(float, y[i]), "hi" if y[i, 0] > 10 else "lo", bool(y[i, 1] > 20), ("u", "v", "w")[i % 3]) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, p double, q double, r double, s double, kind string, flag boolean, three string").cache()


def matrix(df, names):
    return np.array([r[1:] for r in sorted(df.select("id", *names).collect())], float)


def pairwise(z):
    return np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))


@pytest.mark.parametrize("ddof", [0, 1, 3])
def test_scaler(data, ddof):
    x, _ = plots()
    got = matrix(StandardScalerWithDOF(ddof).fit_transform(data, X, prefix="z_"), ["z_a", "z_b", "z_c"])
    assert np.allclose(got, (x - x.mean(0)) / x.std(0, ddof=ddof))


def test_scaler_of_a_constant(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 2.0)], "id long, a double")
    assert all(np.isnan(r.a) for r in StandardScalerWithDOF().fit_transform(df, ["a"]).collect())
    with pytest.raises(ValueError, match="minimum of 3"):
        StandardScalerWithDOF(2).fit(df, ["a"])
    with pytest.raises(RuntimeError, match="not fitted"):
        StandardScalerWithDOF().transform(df)


def test_mahalanobis(data):
    x, _ = plots()
    fitted = MahalanobisTransformer().fit(data, X)
    z = matrix(fitted.transform(data, "m_"), ["m_a", "m_b", "m_c"])
    assert np.allclose(np.cov(z.T), np.eye(3)) and fitted.get_feature_names_out() == X
    inverse = np.linalg.inv(np.cov(x.T))
    d = x[:, None] - x[None]
    assert np.allclose(pairwise(z) ** 2, np.einsum("ijk,kl,ijl->ij", d, inverse, d))


def direct_cca(x, y):
    total = y.sum()
    p = y / total
    r, c = p.sum(1), p.sum(0)
    bar = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    xs = (x - np.average(x, axis=0, weights=r)) * np.sqrt(r)[:, None]
    fit = xs @ np.linalg.lstsq(xs, bar, rcond=None)[0]
    u, s, vt = np.linalg.svd(fit, full_matrices=False)
    k = int((s > 1e-8).sum())
    coefficients = np.linalg.lstsq(xs, u[:, :k], rcond=None)[0]
    return r, c, bar, xs, fit, u[:, :k], s[:k], vt.T[:, :k], coefficients


def test_cca(data):
    x, y = plots()
    r, c, bar, xs, fit, u, s, v, coefficients = direct_cca(x, y)
    cca = CCA(data, X, Y)
    assert cca.rank == len(s) == cca.max_components and np.allclose(cca.eigenvalues, s**2)
    assert cca.tot_chi == pytest.approx((bar**2).sum()) and cca.grand_total == pytest.approx(y.sum())
    assert np.allclose(cca.center, np.average(x, axis=0, weights=r)) and np.allclose(cca.colsum, c)
    z = matrix(CCATransformer().fit_transform(data, X, Y), ["cca0", "cca1", "cca2"])
    want = (x - cca.center) @ coefficients * np.sqrt(s**2 / (s**2).sum())
    assert np.allclose(pairwise(z), pairwise(want), atol=1e-9)
    assert np.allclose(np.abs(matrix(cca.site_lc_scores("id"), ["lc0", "lc1", "lc2"])), np.abs(u / np.sqrt(r)[:, None]))
    assert np.allclose(np.abs(matrix(cca.site_wa_scores("id"), ["wa0", "wa1", "wa2"])), np.abs(bar @ v / s / np.sqrt(r)[:, None]))
    species = v / np.sqrt(c)[:, None] * s
    assert np.allclose(np.abs(cca.species_scores), np.abs(species))
    assert np.allclose(np.abs(cca.biplot_scores), np.abs(xs.T @ u / np.sqrt((xs**2).sum(0))[:, None]))
    assert np.allclose(matrix(cca.fitted("id"), Y), fit) and np.allclose(matrix(cca.residuals("id"), Y), bar - fit)
    assert np.allclose(cca.species_n2(), 1 / ((y / y.sum(0)) ** 2).sum(0))
    assert np.allclose(matrix(cca.site_n2("id"), ["n2"])[:, 0], 1 / ((y / y.sum(1)[:, None]) ** 2).sum(1))
    lc = u / np.sqrt(r)[:, None]
    tolerance = np.sqrt(np.einsum("ns,nsk->sk", y, (lc[:, None] - species[None]) ** 2) / y.sum(0)[:, None])
    assert np.allclose(cca.species_tolerances("id"), tolerance)


def test_cca_input_rules(spark, data):
    with pytest.raises(ValueError, match="row sums"):
        CCA(data.withColumn("p", F.lit(0.0)).withColumn("q", F.lit(0.0)), X, ["p", "q"])
    assert CCA(data.withColumn("z", F.lit(0.0)), X, [*Y, "z"]).excluded == ["z"]
    with pytest.raises(ValueError, match="2D"):
        CCATransformer().fit(data, X, ["p"])
    for n in (-1, 4):
        with pytest.raises(ValueError, match=f"n_components={n} must be between 0 and 3"):
            CCATransformer(n).fit(data, X, Y)
    assert CCATransformer(0).fit(data, X, Y).get_feature_names_out() == []


def test_ccora(spark, data):
    x, y = plots()
    zx, zy = ((m - m.mean(0)) / m.std(0, ddof=1) for m in (x, y))
    ux, sx, vx = np.linalg.svd(zx, full_matrices=False)
    uy = np.linalg.svd(zy, full_matrices=False)[0]
    u, s, _ = np.linalg.svd(ux.T @ uy, full_matrices=False)
    fitted = CCorATransformer().fit(data, X, Y)
    o = fitted.ordination_
    assert np.allclose(o.cancorr, np.clip(s, 0, 1)) and o.cscal == pytest.approx(np.sqrt(len(x) - 1))
    k = fitted.n_components_
    want = zx @ ((vx.T / sx) @ u[:, :k] * o.cscal @ np.diag(s[:k]))
    got = matrix(fitted.transform(data), fitted.names)
    assert np.allclose(pairwise(got), pairwise(want), atol=1e-8) and fitted.names[0] == "ccora0"
    with pytest.raises(ValueError, match="collinear"):
        CCorATransformer().fit(data.withColumn("d", F.col("a") * 2), [*X, "d"], Y)
    double = CCorATransformer().fit(data.withColumn("t", F.col("p") + F.col("q")), X, [*Y, "t"]).ordination_
    assert double.rank_y == 4 and np.allclose(double.cancorr, o.cancorr)
    assert CCorATransformer().fit(data, X, ["p"]).n_components_ == 1


def test_f_distribution_and_correlation_test(spark):
    for x, a, b in ((3.0, 2, 10), (0.5, 7, 3.5), (1.0, 1, 1), (25.0, 12, 240.5), (1.02, 300, 900)):
        assert f_cdf(x, a, b) == pytest.approx(spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(a), float(b)).cumulativeProbability(x), abs=1e-10)
    p = correlation_test(3, 4, 90, np.array([0.95, 0.5, 0.05]))
    assert len(p) == 2 and p[0] < 1e-10 and p[1] < 0.01  # the last has no power left
    assert correlation_test(3, 3, 90, np.array([0.9, 0.05, 0.01]))[1] > 0.5
    assert len(correlation_test(4, 4, 6, np.array([0.9, 0.5, 0.2, 0.1]))) < 4


def test_tall_skinny(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(500, 4))
    m[:, 3] = m[:, 0] + m[:, 1]
    df = spark.createDataFrame([tuple(map(float, v)) for v in m], "a double, b double, c double, d double").repartition(7)
    factor = tall_skinny_r(df, [F.col(c) for c in "abcd"])
    assert factor.shape == (4, 4) and np.allclose(factor.T @ factor, m.T @ m)
    assert np.linalg.svd(factor)[1][3] < 1e-12 * 500
    assert tall_skinny_r(df.limit(2), [F.col(c) for c in "abcd"]).shape == (4, 4)


def test_trees():
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3))
    y = (x[:, 0] > 0) * 2.0 + (x[:, 1] > 1)
    w = np.ones(200)
    tree = Grower(min_samples_leaf=1).grow(x, y[:, None], w, r)
    assert np.allclose(tree.predict(x)[:, 0], y) and (tree.feature >= 0).sum() <= 4
    leaves = Grower(min_samples_leaf=20).grow(x, r.normal(size=(200, 1)), w, r).apply(x)
    assert np.bincount(leaves)[np.unique(leaves)].min() >= 20
    assert len(np.unique(Grower(max_leaf_nodes=5).grow(x, r.normal(size=(200, 1)), w, r).apply(x))) == 5
    assert len(np.unique(Grower(max_depth=2).grow(x, r.normal(size=(200, 1)), w, r).apply(x))) <= 4
    assert len(np.unique(Grower(ccp_alpha=100.0).grow(x, y[:, None], w, r).apply(x))) == 1
    for criterion in ("gini", "entropy", "log_loss"):
        assert np.allclose(Grower(criterion).grow(x, np.eye(4)[y.astype(int)], w, r).predict(x).argmax(1), y)
    for criterion in ("absolute_error", "friedman_mse", "poisson"):
        assert np.allclose(Grower(criterion).grow(x, y[:, None], w, r).predict(x)[:, 0], y)


@pytest.mark.parametrize("kind, loss, classes", [("regression", "squared_error", 0), ("regression", "absolute_error", 0), ("regression", "huber", 0), ("regression", "quantile", 0), ("classification", "log_loss", 2), ("classification", "exponential", 2), ("classification", "log_loss", 3)])
def test_boosting_lowers_its_loss(kind, loss, classes):
    r = np.random.default_rng(4)
    x = r.normal(size=(150, 2))
    y = x[:, 0] ** 2 + x[:, 1] if not classes else np.digitize(x[:, 0], [-0.4, 0.4][: classes - 1]).astype(float)
    grower = {"criterion": "friedman_mse", "max_depth": 3}
    stages, losses = Boosting(kind, loss, 20, 0.1, 1.0, 0.9, grower).fit(x, y, classes, 0)
    assert len(stages) == 20 and len(stages[0]) == (3 if classes == 3 else 1) and losses[-1] < 0.7 * losses[0]
    assert train_improvement(losses).sum() == pytest.approx(1)
    assert train_improvement([2.0, 2.0, 2.0]).tolist() == [1.0, 1.0]


@pytest.mark.parametrize("transformer, per", [(RFNodeTransformer, 1), (GBNodeTransformer, 3)])
def test_node_transformers(data, transformer, per):
    fitted = transformer(n_estimators=4, random_state=0).fit(data, X, ["p", "kind", "three"])
    assert fitted.target_kinds_ == {"p": "regression", "kind": "classification", "three": "classification"}
    assert fitted.n_trees_per_iteration_ == [1, 1, per] and fitted.n_forests_ == 3
    names = fitted.get_feature_names_out()
    rows = fitted.transform(data).select("id", "leaves").collect()
    x, _ = plots()
    assert len(names) == len(rows[0].leaves) == 8 + 4 * per
    assert [r.leaves for r in sorted(rows)] == fitted.apply(x).tolist()
    assert names[-1] == ("gb2_cls2_tree3" if per == 3 else "rf2_tree3") and names[0].endswith("0_tree0")
    assert all(w.sum() == pytest.approx(1 if k == 1 or per == 1 else k) for w, k in zip(fitted.tree_weights_, fitted.n_trees_per_iteration_))
    assert hamming_weights(fitted).sum() == pytest.approx(1)
    again = transformer(n_estimators=4, random_state=0).fit(data.repartition(3), X, ["p", "kind", "three"])
    assert (again.apply(x) == fitted.apply(x)).all()


def test_forest_weights(data):
    fitted = RFNodeTransformer(n_estimators=2, random_state=0).fit(data, X, ["p", "q"])
    given = np.array([3.0, 1.0])
    assert hamming_weights(fitted, given).tolist() == [0.375, 0.375, 0.125, 0.125] and given.tolist() == [3.0, 1.0]
    for bad, message in (([1.0], "length 2"), (1.0, "length 2"), (["a", "b"], "numeric"), ([np.inf, 1], "finite"), ([np.nan, 1], "finite"), ([-1, 1], "non-negative"), ([0, 0], "positive")):
        with pytest.raises(ValueError, match=message):
            validated_forest_weights(bad, 2)
    uniform = GBNodeTransformer(n_estimators=3, tree_weighting_method="uniform").fit(data, X, ["three"])
    assert hamming_weights(uniform).tolist() == pytest.approx([1 / 27] * 9)
    with pytest.raises(ValueError, match="tree_weighting_method"):
        GBNodeTransformer(tree_weighting_method="wrong").fit(data, X, ["p"])


def test_large_forest(data):
    leaves = LargeForest(n_estimators=3, max_depth=4).fit(data, X, ["p", "q"]).transform(data)
    assert {len(r.leaves) for r in leaves.collect()} == {6} and leaves.columns == [*data.columns, "leaves"]


@pytest.mark.parametrize("estimator, per", [(E.RFNNRegressor, (1, 1, 1)), (E.GBNNRegressor, (1, 1, 3))])
def test_large_tables_are_fitted_in_the_executors(data, monkeypatch, estimator, per):
    """Beyond the limit: leaves still tell plots apart, for numbers, two classes and three."""
    from kindred.operators import trees

    rows = data.withColumn("two", F.col("p") > 3).withColumn("three", F.when(F.col("a") < 4, "x").when(F.col("a") < 5.5, "y").otherwise("z"))
    monkeypatch.setattr(trees, "TRAIN_BYTES", 0)
    model = estimator(n_estimators=4, max_depth=4, n_neighbors=3, random_state=1, min_samples_leaf=0.02).fit(rows, X, ["p", "two", "three"], "id")
    assert tuple(model.transformer_.n_trees_per_iteration_) == per and len(model.transformer_.get_feature_names_out()) == 4 * sum(per) == model.n_features_in_
    assert model.hamming_weights_.sum() == pytest.approx(1)
    assert {r.query_id for r in model.kneighbors(return_dataframe_index=True).collect()} == {r.id for r in rows.select("id").collect()}
    near = model.kneighbors(rows, 1).collect()
    assert all(r.distance == pytest.approx(0, abs=1e-9) for r in near)
    with pytest.raises(ValueError, match="max_leaf_nodes"):
        estimator(max_leaf_nodes=3).fit(rows, X, ["p"], "id")


@pytest.mark.parametrize("estimator, params", [(E.RawKNNRegressor, {}), (E.EuclideanKNNRegressor, {}), (E.MahalanobisKNNRegressor, {}), (E.MSNRegressor, {"n_components": 1}), (E.GNNRegressor, {"n_components": 2}), (E.RFNNRegressor, {"n_estimators": 5, "random_state": 0}), (E.GBNNRegressor, {"n_estimators": 5, "random_state": 0})])
def test_estimators(data, estimator, params):
    model = estimator(n_neighbors=3, **params)
    with pytest.raises(RuntimeError, match="not fitted"):
        model.predict(data)
    model.fit(data, X, Y, "id")
    assert model.n_features_in_ == (params.get("n_components") or (20 if "n_estimators" in params else 3))
    near = model.kneighbors(data, 1, return_dataframe_index=True).collect()
    assert all(r.distance == pytest.approx(0, abs=1e-9) for r in near)
    assert all(r.query_id != r.neighbor for r in model.kneighbors(return_dataframe_index=True).collect())
    assert model.kneighbors(data, return_distance=False).columns == ["query_id", "rank", "neighbor"]
    own = model.predict(data)
    assert own.columns == ["id", *Y] and own.count() == 90
    assert model.score(data) > model.independent_score_
    assert {r.id for r in model.independent_prediction_.collect()} == set(range(90))
    copy = model.clone()
    assert type(copy) is estimator and copy.get_params().keys() == model.get_params().keys()
    assert copy.set_params(n_neighbors=2).n_neighbors == 2
    with pytest.raises(ValueError, match="Invalid parameter"):
        copy.set_params(wrong=1)
    with pytest.raises(ValueError, match="missing"):
        model.predict(data.drop("a"))


def test_y_fit_changes_the_space_only(data):
    plain, other = E.GNNRegressor(3).fit(data, X, ["p", "q"], "id"), E.GNNRegressor(3).fit(data, X, ["p", "q"], "id", y_fit=["r", "s"])
    assert other.transformer_.ordination_.species == ["r", "s"] and other.targets == plain.targets
    with pytest.raises(TypeError, match="y_fit"):
        E.RawKNNRegressor().fit(data, X, ["p"], "id", y_fit=["q"])
    mixed = E.RFNNRegressor(n_estimators=3, random_state=0).fit(data, X, ["p"], "id", y_fit=["q", "kind", "flag"])
    assert list(mixed.transformer_.target_kinds_.values()) == ["regression", "classification", "classification"]


def test_estimator_refusals(data):
    with pytest.raises(ValueError, match="constant"):
        E.EuclideanKNNRegressor().fit(data.withColumn("k", F.lit(1.0)), ["a", "k"], ["p"], "id")
    with pytest.raises(ValueError, match="NaN or infinity"):
        E.RawKNNRegressor().fit(data.withColumn("a", F.lit(float("nan"))), X, ["p"], "id")
    with pytest.raises(ValueError, match="NaN-like"):
        E.RFNNRegressor(n_estimators=2).fit(data.withColumn("p", F.when(F.col("id") > 3, F.col("p"))), X, ["p"], "id")
    with pytest.raises(ValueError, match="not supported"):
        E.RFNNRegressor(warm_start=True)
    with pytest.raises(ValueError, match="n_components"):
        E.GNNRegressor(n_components=0).fit(data, X, Y, "id")


def test_grid_search(data):
    best, score, results = E.grid_search(E.EuclideanKNNRegressor(), {"n_neighbors": [1, 4]}, data, X, ["p", "q"], "id", folds=2)
    assert len(results) == 2 and score == max(s for _, s in results) and best in [p for p, _ in results]


def test_schema_helpers(spark, data):
    assert schema.get_feature_names(data.select("a", "kind")) == ["a", "kind"] and schema.get_feature_names(None) == []
    assert schema.get_feature_names([[1, 2, 3]]) == ["0", "1", "2"]
    assert schema.is_number_like_type(T.DoubleType()) and not schema.is_number_like_type(T.StringType())
    with pytest.raises(TypeError):
        schema.is_number_like_type("double")
    assert schema.minimum_type([T.BooleanType(), T.LongType()]) == T.LongType() and schema.minimum_type([T.IntegerType(), T.DoubleType()]) == T.DoubleType()
    with pytest.raises(ValueError, match="non-string"):
        schema.minimum_type([T.StringType(), T.LongType()])
    with pytest.raises(ValueError, match="Duplicate"):
        schema.get_feature_names_and_types(data.select("a", "a"))
    assert schema.is_dataframe_like(data) and not schema.is_series_like(data)
    with pytest.raises(ValueError, match="minimum of 2"):
        schema.validate_features(data, ["a"], 1, 2)


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ID,a,b\n3,1.5,2\n1,0,4\n")
    (tmp_path / "y.csv").write_text("ID,t\n1,7\n3,8.5\n")
    (tmp_path / "z.csv").write_text("ID,t\n1,7\n4,8.5\n")
    (tmp_path / "bad.csv").write_text("ID,t\n1,x\n")
    (tmp_path / "moscow_env.csv").write_text("ID,e\n1,2\n")
    (tmp_path / "moscow_spp.csv").write_text("ID,s\n1,3\n")
    read = lambda y, **k: tables.load_dataset_from_csv_filenames(spark, data_filename="x.csv", target_filename=y, folder=str(tmp_path), **k)
    got = read("y.csv")
    assert repr(got) == "Dataset(n=2, features=2, targets=1)" and got.frame.where("ID = 3").first().t == 8.5
    assert len(read("y.csv", return_X_y=True)) == 2 and got.index.count() == 2
    with pytest.raises(ValueError, match="2 id"):
        read("z.csv")
    placed = read("z.csv", match="position").frame
    assert sorted((r.ID, r.t) for r in placed.collect()) == [(1, 8.5), (3, 7.0)]
    (tmp_path / "long.csv").write_text("ID,t\n1,7\n4,8.5\n5,1\n")
    with pytest.raises(ValueError, match="3"):
        read("long.csv", match="position")
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        tables.load_csv_data(spark, str(tmp_path / "bad.csv"))[1].collect()
    assert tables.load_moscow_stjoes(spark, folder=str(tmp_path)).target_names == ["s"]
    assert sorted(tuple(r) for r in tables.from_rows(spark, [[1, 2], [3, 4]]).collect()) == [(0, 1, 2), (1, 3, 4)]


def test_rank_of_collinear_targets(spark):
    """A column that is the sum of others lowers the rank, whatever the scale of the rounding."""
    r = np.random.default_rng(5)
    y = r.gamma(1.0, 20.0, size=(165, 8))
    y = np.column_stack([y, y.sum(1), y[:, :3].sum(1)])
    names = [f"y{i}" for i in range(10)]
    df = spark.createDataFrame([tuple(map(float, v)) for v in y], ", ".join(f"{n} double" for n in names))
    factor = tall_skinny_r(StandardScalerWithDOF(1).fit_transform(df, names), [F.col(n) for n in names])
    assert (np.linalg.svd(factor)[1] > 1e-8).sum() == 8


def test_saved_models(spark, data, tmp_path):
    for i, model in enumerate((E.GNNRegressor(3, n_components=1), E.RFNNRegressor(n_estimators=3, n_neighbors=2, random_state=0))):
        model.fit(data, X, ["p", "q"], "id", y_fit=["r", "s"])
        model.save(f"file://{tmp_path}/m{i}")
        again = E.load_model(spark, f"file://{tmp_path}/m{i}")
        assert type(again) is type(model) and again.get_params() == model.get_params() and again.y_fit_ == ["r", "s"]
        a, b = (sorted(map(tuple, m.predict(data).collect())) for m in (model, again))
        assert a == b


def test_streams(spark, data, tmp_path):
    model = E.EuclideanKNNRegressor(3).fit(data, X, ["p"], "id")
    data.select("id", *X).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, a double, b double, c double").parquet(str(tmp_path / "in"))
    for made, name in ((score_stream(model, stream), "scored"), (neighbours_stream(model, stream, 2), "near")):
        q = made.writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert {r.id: round(r.p, 9) for r in spark.table("scored").collect()} == {r.id: round(r.p, 9) for r in model.predict(data).collect()}
    assert spark.table("near").count() == 180


def test_p_values_of_many_sites():
    """Against Simpson's rule with steps far below the width of the density, which narrows with the number of rows."""
    correlations = np.array([0.026, 0.021, 0.019, 0.016])
    for n in (1_000, 60_000):
        got = correlation_test(25, 4, n, correlations * np.sqrt(60_000 / n))
        for i, value in enumerate(got):
            p, q = 25 - i, 4 - i
            power = np.sqrt((p * p * q * q - 4) / (p * p + q * q - 5))
            wilks = np.prod(1 - (correlations[i:] ** 2) * 60_000 / n) ** (1 / power)
            a, b = ((n - 16) * power - (p * q - 2) / 2) / 2, p * q / 2
            s = np.arange(1, 2_000_001) / 2_000_000
            density = np.exp((a - 1) * np.log(wilks * s) + (b - 1) * np.log1p(-wilks * s) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
            weights = np.where(np.arange(1, 2_000_001) % 2 == 1, 4, 2)
            weights[-1] = 1
            assert abs(value - (weights * density).sum() * wilks / 2_000_000 / 3) < 1e-7


@pytest.mark.parametrize("transformer, params", [(GBNodeTransformer, {"max_depth": 1, "learning_rate": 0.5}), (GBNodeTransformer, {"subsample": 0.5}), (RFNodeTransformer, {})])
def test_trees_are_those_of_a_small_table_beyond_the_limit(spark, monkeypatch, transformer, params):
    """More values than a binned split tells apart."""
    from kindred.operators import trees

    r = np.random.default_rng(5)
    x = r.normal(size=(3_000, 2))
    rows = spark.createDataFrame([(i, *map(float, v), float(np.sin(3 * v[0]) + v[1] / 3), "yes" if v[0] > v[1] else "no", bool(v[1] > 0)) for i, v in enumerate(x)], "id long, a double, b double, y double, kind string, flag boolean")
    fit = lambda: transformer(n_estimators=2, random_state=3, **params).fit(rows, ["a", "b"], ["y", "kind", "flag"])
    small = fit()
    monkeypatch.setattr(trees, "TRAIN_BYTES", 0)
    large = fit()
    assert large.classes_ == small.classes_ and all((a == b).all() for a, b in zip(large.tree_weights_, small.tree_weights_))
    assert large.apply(x).tolist() == small.apply(x).tolist()
    for a, b in zip((t for f in large.forests_ for t in f), (t for f in small.forests_ for t in f)):
        assert a.threshold.tolist() == b.threshold.tolist()
