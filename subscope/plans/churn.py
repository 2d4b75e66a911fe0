"""Per-user churn features, and a logistic-regression churn model in pyspark.ml.

Features: one aggregate per fact table, each keyed by user_id (partial
aggregation, so a heavy user collapses before the shuffle), then a chain of
left joins on user_id. Every side is unique per user, so nothing fans out.

Model: StringIndexer + OneHotEncoder (unknown level -> all zeros), StandardScaler
on the numeric block, LogisticRegression with the L2 strength that matches
scikit-learn's default C=1 (Spark's loss is a mean, scikit-learn's a sum:
regParam = 1/n_train) and scikit-learn's default tolerance 1e-4. Training iterations are distributed Spark jobs; the
feature table is written once to the shared checkpoint folder first, so the fit
passes and a lost executor read those files, not the raw tables.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subscope import schema as S
from subscope.functions import count_when, exact_mean, feature_column, lit_date, risk_band
from subscope.operators.dedup import first_by_key
from subscope.params import DEFAULT_PERIOD, Period
from subscope.sources.binding import Tables

C = F.col
FEATURE_COLUMNS = [feature_column(f) for f in S.FEATURES]
NUMERIC = S.CHURN_NUMERIC + FEATURE_COLUMNS
CATEGORICAL = S.CHURN_CATEGORICAL
TEST_SHARE = 0.2  # of each class


# ---------------------------------------------------------------- F01 - F07

def activity_features(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    g = t.user_sessions.groupBy("user_id").agg(
        F.count("session_id").alias("total_sessions"),
        exact_mean("session_duration_minutes").alias("avg_session_duration"),
        F.max("session_date").alias("_last"))
    return g.select("user_id", "total_sessions", "avg_session_duration",
                    F.datediff(lit_date(p.as_of), C("_last")).cast("long").alias("recency"))


def features_present(t: Tables) -> list[str]:
    """The columns of the click pivot: the known features, then any others the events hold
    (their names are collected: categories, not rows)."""
    names = t.feature_events.select("feature_name").where("feature_name IS NOT NULL").distinct()
    return S.FEATURES + sorted({r[0] for r in names.collect()} - set(S.FEATURES))


def event_features(t: Tables) -> DataFrame:
    """Clicks of every feature and time per user, in one aggregate over the events."""
    clicks = [F.count(F.when(C("feature_name") == f, C("event_id"))).alias(feature_column(f)) for f in features_present(t)]
    return t.feature_events.groupBy("user_id").agg(
        *clicks, F.sum("time_spent_seconds").cast("long").alias("total_feature_time"),
        exact_mean("time_spent_seconds").alias("avg_feature_time"))


def click_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("feat_") and c.endswith("_clicks")]


def feature_click_pivot(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Clicks per user and feature, a column for each feature."""
    f = event_features(t)
    return f.select("user_id", *click_columns(f))


def feature_time(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return t.feature_events.groupBy("user_id").agg(
        F.sum("time_spent_seconds").cast("long").alias("total_feature_time"),
        exact_mean("time_spent_seconds").alias("avg_feature_time"))


def payment_features(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    st = C("status")
    return t.transactions.groupBy("user_id").agg(
        F.sum(F.when(st == "Success", C("amount"))).cast("double").alias("total_spend"),
        count_when(st == "Failed").alias("failed_payments"),
        count_when(st == "Refunded").alias("refunded_payments"))


def support_features(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return t.support_tickets.groupBy("user_id").agg(
        F.count("ticket_id").alias("ticket_count"),
        exact_mean("resolution_time_hours").alias("avg_resolution_time"),
        exact_mean("satisfaction_score").alias("avg_satisfaction"))


def first_subscription(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Keep-first subscription per user, first = smallest subscription_id."""
    s = t.subscriptions.select("user_id", "subscription_id", "plan_type", C("status").alias("sub_status"))
    return first_by_key(s, "user_id", "subscription_id", ["plan_type", "sub_status"])


def churn_feature_table(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    u = t.users.select("user_id", "age", "signup_channel", "country", "experiment_group")
    j = (u.join(first_subscription(t, p), "user_id", "left")
         .join(activity_features(t, p), "user_id", "left")
         .join(event_features(t), "user_id", "left")
         .join(payment_features(t, p), "user_id", "left")
         .join(support_features(t, p), "user_id", "left"))
    zero_long = ["total_sessions", "recency", "total_feature_time", "failed_payments",
                 "refunded_payments", "ticket_count"] + click_columns(j)
    zero_double = ["avg_session_duration", "avg_feature_time", "total_spend", "avg_resolution_time"]
    return j.select(
        "user_id", C("age").cast("long").alias("age"), *CATEGORICAL[:3],
        F.coalesce(C("plan_type"), F.lit("Free")).alias("plan_type"),
        *[F.coalesce(C(c), F.lit(0)).cast("long").alias(c) for c in zero_long],
        *[F.coalesce(C(c), F.lit(0.0)).alias(c) for c in zero_double],
        F.coalesce(C("avg_satisfaction"), F.lit(S.CSAT_FILL)).alias("avg_satisfaction"),
        F.coalesce((C("sub_status") == "Churned").cast("long"), F.lit(0)).alias("target"))


def train_test_split(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Repeatable split, stratified by target: of each class, the TEST_SHARE with the smallest
    md5(user_id) are test."""
    return with_split(churn_feature_table(t, p).select("user_id", "target"))


def with_split(f: DataFrame) -> DataFrame:
    """``f`` with ``split``. A user's rank in its class is the number of users in smaller md5 buckets
    (the first two digits: 256 counts a class) plus the place in its own bucket, so no task
    orders a whole class."""
    f = f.withColumn("_h", F.md5(C("user_id").cast("string"))).withColumn("_b", F.substring("_h", 1, 2))
    counts = f.groupBy("target", "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("target")
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("target", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(whole).alias("_all"))
    place = F.row_number().over(Window.partitionBy("target", "_b").orderBy("_h", "user_id"))
    test = C("_before") + C("_place") <= F.floor(C("_all") * TEST_SHARE + 0.5)
    return (f.withColumn("_place", place).join(counts, ["target", "_b"])
            .withColumn("split", F.when(test, "test").otherwise("train"))
            .drop("_h", "_b", "_place", "_before", "_all").select(*f.columns[:-2], "split"))


# ---------------------------------------------------------------- L02 - L10

def numeric_columns(features: DataFrame) -> list[str]:
    return S.CHURN_NUMERIC + click_columns(features)


def build_pipeline(n_train: int, numeric: list[str], max_iter: int = 1000) -> Pipeline:
    # one indexer for the four columns: one pass over the data instead of four
    idx = [StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_idx" for c in CATEGORICAL],
                         handleInvalid="keep", stringOrderType="alphabetAsc")]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in CATEGORICAL],
                        outputCols=[f"{c}_ohe" for c in CATEGORICAL], dropLast=True)  # the unknown level
    num = VectorAssembler(inputCols=numeric, outputCol="num_raw")
    scaler = StandardScaler(inputCol="num_raw", outputCol="num_scaled", withMean=True, withStd=True)
    allv = VectorAssembler(inputCols=["num_scaled"] + [f"{c}_ohe" for c in CATEGORICAL],
                           outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter,
                            regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                            standardization=False, family="binomial", tol=1e-4)
    return Pipeline(stages=[*idx, ohe, num, scaler, allv, lr])


class ChurnModel:
    """A fitted pipeline plus the frames it was fitted and tested on."""

    def __init__(self, model: PipelineModel, features: DataFrame, test: DataFrame):
        self.model = model
        self.features = features
        self.test = test

    def predictions(self, df: DataFrame | None = None) -> DataFrame:
        return self.model.transform(self.test if df is None else df)

    def coefficients(self) -> list[tuple[str, float]]:
        lr = self.model.stages[-1]
        names = numeric_columns(self.features)
        for c, labels in zip(CATEGORICAL, self.model.stages[0].labelsArray):
            names += [f"{c}_{lab}" for lab in labels]  # dropped last slot = unknown
        return list(zip(names, [float(x) for x in lr.coefficients.toArray()]))


_FITTED: dict = {}


def _features(t: Tables, p: Period) -> DataFrame:
    """The feature table with split and label, written once to the shared checkpoint folder: the
    lineage is cut before the iterative fit, and every pass scans the files."""
    from subscope.sources.store import written
    feats = with_split(churn_feature_table(t, p)).withColumn("label", C("target").cast("double"))
    token = getattr(t, "token", None)
    return written(feats, "churn-features", None if token is None else f"{token} {p} {feats.schema.simpleString()}")


def fit_churn_model(t: Tables, p: Period = DEFAULT_PERIOD) -> ChurnModel:
    """The fitted model. It is kept only for tables that say what they hold (``token``)."""
    key = (t.users.sparkSession.sparkContext.applicationId, getattr(t, "token", None), p)
    if key[1] is not None and key in _FITTED:
        return _FITTED[key]
    feats = _features(t, p)
    train = feats.where(C("split") == "train")
    model = build_pipeline(train.count(), numeric_columns(feats)).fit(train)
    cm = ChurnModel(model, feats, feats.where(C("split") == "test"))
    if key[1] is not None:
        _FITTED[key] = cm
    return cm


def _preds(t: Tables, p: Period) -> DataFrame:
    return fit_churn_model(t, p).predictions().select(
        C("label").cast("long").alias("actual"), C("prediction").cast("long").alias("predicted"))


def _or_zero(num, den) -> F.Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _counts(preds: DataFrame) -> DataFrame:
    """tp, fp, fn, tn of (actual, predicted): one pass, one row."""
    return preds.agg(*[count_when((C("actual") == a) & (C("predicted") == b)).alias(n)
                       for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])


def binary_metrics_of(preds: DataFrame) -> DataFrame:
    prec, rec = _or_zero(C("tp"), C("tp") + C("fp")), _or_zero(C("tp"), C("tp") + C("fn"))
    hits, rows = C("tp") + C("tn"), C("tp") + C("tn") + C("fp") + C("fn")
    return _counts(preds).select(
        F.try_divide(hits.cast("double"), rows.cast("double")).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"), _or_zero(2 * prec * rec, prec + rec).alias("f1"),
        "tp", "fp", "fn", "tn")


def classification_report_of(preds: DataFrame) -> DataFrame:
    """Per class precision/recall/F1/support, then accuracy, macro and weighted averages: all from
    the four confusion counts. A class that is neither actual nor predicted has no row."""
    def one(label, hit, support, predicted):
        prec, rec = _or_zero(hit, predicted), _or_zero(hit, support)
        return F.struct(F.lit(label).alias("label"), prec.alias("precision"), rec.alias("recall"),
                        _or_zero(2 * prec * rec, prec + rec).alias("f1_score"),
                        support.cast("long").alias("support"), (support + predicted).alias("_seen"))

    def row(label, precision, recall, f1):
        return F.struct(F.lit(label).alias("label"), precision.cast("double").alias("precision"),
                        recall.cast("double").alias("recall"), f1.cast("double").alias("f1_score"), n.alias("support"))

    classes = F.filter(F.array(one("0", C("tn"), C("tn") + C("fp"), C("tn") + C("fn")),
                               one("1", C("tp"), C("tp") + C("fn"), C("tp") + C("fp"))), lambda c: c["_seen"] > 0)
    n = (C("tp") + C("fp") + C("fn") + C("tn")).cast("long")
    total = lambda value: F.aggregate("classes", F.lit(0.0), lambda acc, c: acc + value(c))
    macro = [F.try_divide(total(lambda c, k=k: c[k]), F.size("classes").cast("double")) for k in ("precision", "recall", "f1_score")]
    weighted = [F.try_divide(total(lambda c, k=k: c[k] * c["support"]), n.cast("double")) for k in ("precision", "recall", "f1_score")]
    none = F.lit(None)
    accuracy = F.try_divide((C("tp") + C("tn")).cast("double"), n.cast("double"))
    per = F.transform("classes", lambda c: F.struct(*[c[k].alias(k) for k in ("label", "precision", "recall", "f1_score", "support")]))
    summary = F.array(row("accuracy", none, none, accuracy), row("macro avg", *macro), row("weighted avg", *weighted))
    return _counts(preds).withColumn("classes", classes).select(F.inline(F.concat(per, summary)))


def confusion_matrix_of(preds: DataFrame) -> DataFrame:
    return preds.groupBy("actual").agg(*[count_when(C("predicted") == k).alias(f"predicted_{k}") for k in (0, 1)])


def risk_band_counts_of(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_band").agg(F.count(F.lit(1)).alias("users"))


def binary_metrics(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return binary_metrics_of(_preds(t, p))


def classification_report(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return classification_report_of(_preds(t, p))


def confusion_matrix(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return confusion_matrix_of(_preds(t, p))


def fixed_scores(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """A score made from table columns, the same on every engine: (user_id, actual, predicted,
    score). The metric formulas are checked on it, apart from any fitted model."""
    f = churn_feature_table(t, p)
    points = (C("total_sessions") * 7 + C("age") * 3 + C("ticket_count") * 11 + C("user_id") * 13) % 100
    return f.select("user_id", C("target").alias("actual"), (points >= 50).cast("long").alias("predicted"),
                    (points / F.lit(100.0)).alias("score"))


def fixed_binary_metrics(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return binary_metrics_of(fixed_scores(t, p))


def fixed_classification_report(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return classification_report_of(fixed_scores(t, p))


def fixed_confusion_matrix(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return confusion_matrix_of(fixed_scores(t, p))


def fixed_risk_band_counts(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return risk_band_counts_of(fixed_scores(t, p).withColumn("risk_band", risk_band(C("score"))))


def coefficient_table(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Model coefficients by absolute size. Built from model metadata: one row per
    feature slot (a few dozen), not per data row."""
    cm = fit_churn_model(t, p)
    spark = t.users.sparkSession
    rows = [(n, c, abs(c)) for n, c in cm.coefficients()]
    df = spark.createDataFrame(rows, "Feature string, Coefficient double, Absolute_Coefficient double")
    return df.orderBy(C("Absolute_Coefficient").desc(), "Feature")


def top_coefficients(t: Tables, p: Period = DEFAULT_PERIOD, k: int = 10) -> DataFrame:
    return coefficient_table(t, p).limit(k)


def score_users(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Batch scoring of every user (the reference scores one form row at a time)."""
    cm = fit_churn_model(t, p)
    scored = cm.model.transform(cm.features)
    prob = vector_to_array(C("probability"))[1]
    return scored.select("user_id", prob.alias("churn_probability"),
                         risk_band(prob).alias("risk_band"))


def risk_band_counts(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    return risk_band_counts_of(score_users(t, p))


PLANS = {
    "activity_features": activity_features,
    "feature_click_pivot": feature_click_pivot,
    "feature_time": feature_time,
    "payment_features": payment_features,
    "support_features": support_features,
    "first_subscription": first_subscription,
    "churn_feature_table": churn_feature_table,
    "train_test_split": train_test_split,
    "binary_metrics": binary_metrics,
    "classification_report": classification_report,
    "confusion_matrix": confusion_matrix,
    "coefficient_table": coefficient_table,
    "score_users": score_users,
    "risk_band_counts": risk_band_counts,
    "fixed_binary_metrics": fixed_binary_metrics,
    "fixed_classification_report": fixed_classification_report,
    "fixed_confusion_matrix": fixed_confusion_matrix,
    "fixed_risk_band_counts": fixed_risk_band_counts,
}


# ---------------------------------------------------------------- S09 / S10: model files

def save_model(cm: ChurnModel, path: str) -> None:
    cm.model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_coefficients_csv(t: Tables, path: str, p: Period = DEFAULT_PERIOD) -> None:
    from subscope.sources.files import write_csv
    write_csv(coefficient_table(t, p), path, single_file=True)


# ---------------------------------------------------------------- L02 / L03 as tables

def standardized_features(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Z-scores of the numeric features from the pipeline's own StandardScaler
    (sample standard deviation; a zero-variance column scales to 0). Rounded to 6 places."""
    f = _features(t, p)
    numeric = numeric_columns(f)
    va = VectorAssembler(inputCols=numeric, outputCol="_raw")
    sc = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True)
    v = va.transform(f)
    z = sc.fit(v).transform(v).select("user_id", vector_to_array("_z").alias("_z"))
    return z.select("user_id", *[F.round(C("_z")[i], 6).alias(f"{c}_z") for i, c in enumerate(numeric)])


def category_indexes(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The one-hot slot of each categorical feature per user, from the pipeline's
    StringIndexer (alphabetical order; labels collected are the categories, not rows)."""
    f = churn_feature_table(t, p).select("user_id", *CATEGORICAL)
    si = StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_slot" for c in CATEGORICAL],
                       handleInvalid="keep", stringOrderType="alphabetAsc")
    out = si.fit(f).transform(f)
    return out.select("user_id", *[C(f"{c}_slot").cast("long").alias(f"{c}_slot") for c in CATEGORICAL])


def one_hot_features(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The one-hot vector of each categorical feature per user, as text of 0 and 1 in
    alphabetical order of the levels; a missing level is all zeros."""
    f = _features(t, p).select("user_id", *CATEGORICAL)
    si = StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_idx" for c in CATEGORICAL],
                       handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in CATEGORICAL], outputCols=[f"{c}_ohe" for c in CATEGORICAL],
                        dropLast=True)
    out = Pipeline(stages=[si, ohe]).fit(f).transform(f)
    digits = lambda c: F.array_join(F.transform(vector_to_array(c), lambda x: x.cast("int").cast("string")), "")
    return out.select("user_id", *[digits(f"{c}_ohe").alias(f"{c}_one_hot") for c in CATEGORICAL])


PLANS.update({
    "one_hot_features": one_hot_features,
    "standardized_features": standardized_features,
    "category_indexes": category_indexes,
})
