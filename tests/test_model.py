"""Churn model: learns a planted signal, saves/loads to equal scores, reports coefficients."""

import random
import tempfile

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from subscope.plans import churn, registry

from conftest import SF_SMALL


def _planted(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        sessions = rnd.randint(0, 60)
        label = 1.0 if sessions < 15 else 0.0  # few sessions -> churn
        if rnd.random() < 0.05:
            label = 1.0 - label
        row = {c: float(rnd.randint(0, 5)) for c in churn.NUMERIC}
        row.update(total_sessions=float(sessions), signup_channel=rnd.choice(["Referral", "Google Ads"]),
                   country=rnd.choice(["US", "CA"]), experiment_group=rnd.choice(["A", "B"]),
                   plan_type=rnd.choice(["Free", "Pro"]), label=label)
        rows.append(row)
    return spark.createDataFrame(rows)


def test_beats_majority_class(spark):
    df = _planted(spark)
    train, test = df.where(F.rand(1) < 0.8), df.where(F.rand(1) >= 0.8)
    model = churn.build_pipeline(train.count(), churn.NUMERIC).fit(train)
    pred = model.transform(test)
    acc = pred.where(F.col("label") == F.col("prediction")).count() / pred.count()
    majority = max(test.where("label = 1").count(), test.where("label = 0").count()) / test.count()
    assert acc > majority + 0.1


def test_save_load_gives_equal_scores(spark):
    df = _planted(spark, n=200)
    model = churn.build_pipeline(200, churn.NUMERIC).fit(df)
    d = tempfile.mkdtemp(prefix="subscope-model-", dir="/tmp")
    model.write().overwrite().save(d)
    back = churn.load_model(d)
    a = [r[0] for r in model.transform(df).select(vector_to_array("probability")[1]).collect()]
    b = [r[0] for r in back.transform(df).select(vector_to_array("probability")[1]).collect()]
    assert a == b


def test_unknown_category_scores(spark):
    df = _planted(spark, n=200)
    model = churn.build_pipeline(200, churn.NUMERIC).fit(df)
    odd = df.limit(3).withColumn("country", F.lit("Atlantis")).withColumn("plan_type", F.lit(None).cast("string"))
    assert model.transform(odd).count() == 3


def test_driver_model_entries(spark):
    t = registry.tables_for(spark, SF_SMALL)
    m = churn.binary_metrics(t).collect()[0]
    assert 0.0 <= m["accuracy"] <= 1.0 and m["tp"] + m["fp"] + m["fn"] + m["tn"] > 0
    coef = churn.coefficient_table(t).collect()
    labels = churn.fit_churn_model(t).model.stages[0].labelsArray
    # one coefficient per name: neither side is cut short when they are paired
    model = churn.fit_churn_model(t)
    assert len(model.model.stages[-1].coefficients) == len(model.coefficients()) == len(coef)
    assert len(coef) == len(churn.NUMERIC) + sum(len(x) for x in labels)
    assert [r["Absolute_Coefficient"] for r in coef] == sorted((r["Absolute_Coefficient"] for r in coef), reverse=True)
    assert len(churn.top_coefficients(t).collect()) == 10
    scores = churn.score_users(t)
    assert scores.count() == t.users.count()
    bands = {r["risk_band"] for r in churn.risk_band_counts(t).collect()}
    assert bands <= {"Low", "Medium", "High"}
    rep = {r["label"]: r for r in churn.classification_report(t).collect()}
    assert {"0", "1", "accuracy", "macro avg", "weighted avg"} == set(rep)
    cmx = churn.confusion_matrix(t).collect()
    assert sum(r["predicted_0"] + r["predicted_1"] for r in cmx) == m["tp"] + m["fp"] + m["fn"] + m["tn"]


def test_coefficients_csv(spark):
    t = registry.tables_for(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="subscope-coef-", dir="/tmp")
    churn.write_coefficients_csv(t, f"{d}/coef")
    back = spark.read.option("header", True).csv(f"{d}/coef")
    assert back.columns == ["Feature", "Coefficient", "Absolute_Coefficient"]
    assert back.count() == churn.coefficient_table(t).count()


def test_clicks_of_an_unknown_feature_are_kept(spark, fixture_tables):
    from dataclasses import replace
    events = fixture_tables.feature_events
    odd = events.limit(1).withColumn("feature_name", F.lit("Webhooks")).withColumn("user_id", F.lit(9999).cast("long"))
    t = replace(fixture_tables, feature_events=events.unionByName(odd))
    rows = {r["user_id"]: r for r in churn.feature_click_pivot(t).collect()}
    assert rows[9999]["feat_webhooks_clicks"] == 1
    assert "feat_webhooks_clicks" in churn.churn_feature_table(t).columns


def test_split_is_stratified(spark):
    df = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(5000)], "user_id long, target int")
    got = {(r["target"], r["split"]): r["count"] for r in churn.with_split(df).groupBy("target", "split").count().collect()}
    assert got == {(0, "test"): 900, (0, "train"): 3600, (1, "test"): 100, (1, "train"): 400}
    assert churn.with_split(df.limit(0)).count() == 0


def test_report_of_one_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "actual long, predicted long")
    rep = {r["label"]: r for r in churn.classification_report_of(df).collect()}
    assert set(rep) == {"0", "accuracy", "macro avg", "weighted avg"} and rep["macro avg"]["f1_score"] == 1.0
    assert churn.classification_report_of(df.limit(0)).count() == 3
