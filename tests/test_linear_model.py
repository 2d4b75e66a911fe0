"""The fitted model outside its fit: certificate, expression, model folder, coefficient file, catalog runner."""

import random
import time
import uuid

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from subscope.plans import catalog, churn, linear_model, registry
from subscope.plans.linear_model import LinearModel

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def planted(spark):
    """600 users whose churn follows known coefficients of two columns."""
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        row = {c: float(rnd.randint(0, 9)) for c in churn.NUMERIC} | {"age": 30.0}  # one column does not vary
        z = 0.9 * (row["total_sessions"] - 4.5) - 0.5 * (row["recency"] - 4.5)
        row.update(signup_channel=rnd.choice(["Referral", "O'Reilly \\ Co"]), country=rnd.choice(["US", "CA"]),
                   experiment_group=rnd.choice(["A", "B"]), plan_type=rnd.choice(["Free", "Pro", None]),
                   label=1.0 if rnd.random() < 1 / (1 + 2.718281828 ** -z) else 0.0, user_id=i, split="train")
        rows.append(row)
    schema = ", ".join([f"{c} double" for c in churn.NUMERIC] + [f"{c} string" for c in churn.CATEGORICAL] + ["label double", "user_id long", "split string"])
    df = spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in rows], schema).cache()
    return churn.ChurnModel(churn.build_pipeline(600, churn.NUMERIC).fit(df), df, df)


def test_certificate_passes_the_fit_and_fails_other_coefficients(spark, planted):
    found = {r["slot"]: r["gradient"] for r in linear_model.gradient(planted, planted.features).collect()}
    assert set(found) == {linear_model.INTERCEPT} | {n for n, _ in planted.coefficients()}
    assert max(map(abs, found.values())) <= linear_model.GRADIENT_BOUND
    # a model that was stopped after its first step is not certified
    early = churn.ChurnModel(churn.build_pipeline(600, churn.NUMERIC, max_iter=1).fit(planted.features), planted.features, planted.features)
    assert max(abs(r["gradient"]) for r in linear_model.gradient(early, planted.features).collect()) > linear_model.GRADIENT_BOUND
    weights = dict(planted.coefficients())
    assert weights["total_sessions"] > 1 and weights["recency"] < -0.5  # the planted signs, in scaled units


def test_gradient_equals_a_sum_over_rows(planted):
    rows = planted.model.transform(planted.features).select(vector_to_array("features"), vector_to_array("probability")[1], "label").collect()
    weights = [w for _, w in planted.coefficients()]
    want = [sum((p - y) * x[i] for x, p, y in rows) / len(rows) + w / len(rows) for i, w in enumerate(weights)]
    got = {r["slot"]: r["gradient"] for r in linear_model.gradient(planted, planted.features).collect()}
    for (name, _), g in zip(planted.coefficients(), want, strict=True):
        assert got[name] == pytest.approx(g, abs=1e-9)


def test_expression_equals_transform(planted):
    model = LinearModel.of(planted.model)
    odd = planted.features.limit(3).withColumn("country", F.lit("Atlantis"))  # an unknown level
    for df in (planted.features, odd):
        both = planted.model.transform(df).select(vector_to_array("probability")[1].alias("a"), model.probability().alias("b"))
        assert both.where("NOT abs(a - b) <= 1e-12").count() == 0
    assert LinearModel.from_json(model.to_json()) == model
    plan = planted.features.select(model.probability())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "DeserializeToObject" not in plan


def test_model_folder_is_taken_only_when_published_and_fitting(spark, planted, tmp_path):
    root = str(tmp_path)
    planted.model.write().save(f"{root}/churn/half-written/pipeline")  # a writer that was lost
    with pytest.raises(FileNotFoundError):
        linear_model.load_model(spark, root, "churn")
    linear_model.save_model(planted, root, "churn", token="these tables")
    back = linear_model.load_model(spark, root, "churn", planted.features.schema, "these tables")
    score = lambda m: [r[0] for r in m.transform(planted.features).select(vector_to_array("probability")[1]).collect()]
    assert score(back) == score(planted.model)
    with pytest.raises(ValueError, match="other tables"):
        linear_model.load_model(spark, root, "churn", token="other tables")
    with pytest.raises(ValueError, match="age"):
        linear_model.load_model(spark, root, "churn", planted.features.withColumn("age", F.col("age").cast("string")).schema)


def test_coefficient_file_is_typed_and_refused_when_changed(spark, tmp_path):
    rows = [("a", 0.1 + 0.2, 0.30000000000000004), ("b, with \"comma\"", -1e-300, 1e-300)]
    df = spark.createDataFrame(rows, "Feature string, Coefficient double, Absolute_Coefficient double")
    path = linear_model.write_coefficients(df, str(tmp_path))
    back = linear_model.read_coefficients(spark, path)
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == sorted(rows)
    spark.createDataFrame(rows[:1], df.schema).write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    with pytest.raises(ValueError, match="rows that were written"):
        linear_model.read_coefficients(spark, path)


def test_top_coefficients_come_from_the_file_in_order(spark):
    t = registry.tables_for(spark, SF_SMALL)
    top = [tuple(r) for r in linear_model.top_coefficients(t).collect()]
    assert top == [tuple(r) for r in churn.coefficient_table(t).limit(10).collect()]


def test_catalog_records_errors_and_goes_on(spark, tmp_path):
    frames = {"good": lambda: spark.range(7), "bad": lambda: spark.sql("SELECT raise_error('no')"), "late": lambda: spark.range(3)}
    rows = {r["name"]: r for r in catalog.run_frames(spark, lambda n: frames[n](), list(frames), str(tmp_path), parallel=2).collect()}
    assert [rows[n]["status"] for n in frames] == ["ok", "error", "ok"]
    assert rows["good"]["row_count"] == 7 and rows["bad"]["row_count"] is None and "no" in rows["bad"]["error"]


def test_catalog_cancels_what_takes_too_long_and_nothing_else(spark, tmp_path):
    from pyspark.sql.functions import udf

    @udf("long")
    def slow(x):
        time.sleep(60)
        return x

    frames = {"slow": lambda: spark.range(0, 8, 1, 2).select(slow("id")), "quick": lambda: spark.range(5)}
    began = time.time()
    rows = {r["name"]: r for r in catalog.run_frames(spark, lambda n: frames[n](), list(frames), str(tmp_path), limit=8).collect()}
    assert time.time() - began < 50
    assert rows["slow"]["status"] == "timeout" and rows["quick"]["status"] == "ok" and rows["quick"]["row_count"] == 5
    assert spark.range(3).count() == 3  # the caller's own jobs are in no cancelled group


def test_catalog_resumes_with_what_has_no_good_outcome(spark, tmp_path):
    ran = []

    def frame(name):
        ran.append(name)
        if name == "flaky" and ran.count("flaky") == 1:
            raise RuntimeError("first time")
        return spark.range(4)

    out = f"{tmp_path}/{uuid.uuid4().hex}"
    first = {r["name"]: r["status"] for r in catalog.run_frames(spark, frame, ["a", "flaky"], out, resume=True).collect()}
    again = {r["name"]: (r["status"], r["row_count"]) for r in catalog.run_frames(spark, frame, ["a", "flaky"], out, resume=True).collect()}
    assert first == {"a": "ok", "flaky": "error"} and again == {"a": ("ok", 4), "flaky": ("ok", 4)}
    assert sorted(ran) == ["a", "flaky", "flaky"]
