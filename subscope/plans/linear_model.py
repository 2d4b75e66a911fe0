"""The fitted churn model outside its fit: proven optimal, as one expression, and as files.

* ``fit_certificate``: one distributed pass sums the gradient of the penalised loss at the fitted
  coefficients. The loss is strictly convex in the penalised slots, so a gradient near zero shows the
  optimum, whichever way it was found.
* ``LinearModel``: indexing, scaling, dot product and logistic as one SQL expression, which Catalyst
  compiles with the rest of a query; no ML transformer runs.
* ``save_model`` / ``load_model``: a folder with the pipeline, the feature schema and the token of the
  tables it was fitted on, published by a marker as the last step.
* ``write_coefficients`` / ``read_coefficients``: the coefficient file with its schema and row digest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subscope.params import DEFAULT_PERIOD, Period
from subscope.plans import churn
from subscope.session import checkpoint_dir
from subscope.sources import store
from subscope.sources.binding import Tables
from subscope.sources.files import write_csv

C = F.col
INTERCEPT = "(intercept)"
#: a slot's gradient of the mean loss is zero to this size at the optimum: the fit ends when a step
#: lowers the loss by less than 1e-4 of it
GRADIENT_BOUND = 1e-2


# ---------------------------------------------------------------- L04: is the fit optimal?

def gradient(cm: churn.ChurnModel, rows: DataFrame) -> DataFrame:
    """(slot, gradient) of the penalised mean loss over ``rows`` at the model's coefficients: one pass,
    one row of sums, turned into one row per slot. The intercept carries no penalty."""
    lr = cm.model.stages[-1]
    strength = lr.getRegParam()
    scored = cm.model.transform(rows).select(
        vector_to_array("features").alias("x"), (vector_to_array("probability")[1] - C("label")).alias("miss"))
    names = cm.coefficients()
    sums = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("miss").alias("all"),
                      F.array(*[F.sum(C("miss") * C("x")[i]) for i in range(len(names))]).alias("each"))
    slots = [F.struct(F.lit(INTERCEPT).alias("slot"), (C("all") / C("n")).alias("gradient"))]
    slots += [F.struct(F.lit(name).alias("slot"), (C("each")[i] / C("n") + strength * w).alias("gradient"))
              for i, (name, w) in enumerate(names)]
    return sums.select(F.inline(F.array(*slots)))


def fit_certificate(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Whether each slot's gradient is zero to GRADIENT_BOUND at the fitted coefficients."""
    cm = churn.fit_churn_model(t, p)
    found = gradient(cm, cm.features.where(C("split") == "train"))
    return found.select("slot", (F.abs("gradient") <= GRADIENT_BOUND).alias("optimal"))


# ---------------------------------------------------------------- L09: the model as an expression

@dataclass(frozen=True)
class LinearModel:
    """Logistic model over numeric columns (mean, scale, weight) and levels of category columns."""

    intercept: float
    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    levels: dict[str, dict[str, float]] = field(default_factory=dict)

    @classmethod
    def of(cls, model: PipelineModel) -> LinearModel:
        """What ``build_pipeline``'s fitted stages compute."""
        indexer, _, assembler, scaler, _, lr = model.stages
        names, weights = assembler.getInputCols(), [float(w) for w in lr.coefficients]
        # a column that does not vary is scaled to zero
        numeric = {c: (float(m), float(s), w if s else 0.0)
                   for c, m, s, w in zip(names, scaler.mean, scaler.std, weights, strict=False)}
        rest, levels = weights[len(names):], {}
        for c, labels in zip(indexer.getInputCols(), indexer.labelsArray, strict=True):
            levels[c], rest = dict(zip(labels, rest, strict=False)), rest[len(labels):]
        return cls(float(lr.intercept), numeric, levels)

    def margin(self) -> str:
        """SQL of intercept + sum of weight * (x - mean) / scale + the weights of the row's levels."""
        terms = [_number(self.intercept)]
        terms += [f"(CAST(`{c}` AS DOUBLE) - {_number(m)}) / {_number(s)} * {_number(w)}"
                  for c, (m, s, w) in self.numeric.items() if w]
        for c, weights in self.levels.items():
            cases = " ".join(f"WHEN {_text(level)} THEN {_number(w)}" for level, w in weights.items())
            if cases:
                terms.append(f"CASE `{c}` {cases} ELSE 0D END")  # an unknown level has no slot
        return " + ".join(terms)

    def probability(self) -> F.Column:
        return F.expr(f"1D / (1D + exp(-({self.margin()})))")

    def to_json(self) -> str:
        return json.dumps({"intercept": self.intercept, "numeric": self.numeric, "levels": self.levels}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> LinearModel:
        found = json.loads(text)
        return cls(found["intercept"], {c: tuple(v) for c, v in found["numeric"].items()}, found["levels"])


def _number(x: float) -> str:
    return f"{float(x)!r}D" if x >= 0 else f"({float(x)!r}D)"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: a model that was not fitted here, for checking the expression on its own: (mean, scale, weight)
STORED = LinearModel(
    intercept=-0.75,
    numeric={"age": (40.0, 12.5, 0.25), "total_sessions": (20.0, 8.0, -0.5), "recency": (90.0, 64.0, 0.375),
             "ticket_count": (2.0, 1.5, 0.125), "avg_satisfaction": (3.0, 0.5, -0.25)},
    levels={"plan_type": {"Free": 0.5, "Pro": -0.25}, "experiment_group": {"A": -0.0625, "B": 0.0625}})


def stored_model_scores(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """L09 over stored coefficients: the model goes to a file and comes back, and scores every user
    inside the feature query, without an ML transformer."""
    spark = t.users.sparkSession
    path = f"{_root(spark)}/stored/{uuid.uuid4().hex}.json"
    _write_text(spark, path, STORED.to_json())
    model = LinearModel.from_json(_read_text(spark, path))
    scored = churn.churn_feature_table(t, p).select("user_id", model.probability().alias("score"))
    return scored.select("user_id", F.round("score", 6).alias("churn_probability"), churn.risk_band(C("score")).alias("risk_band"))


# ---------------------------------------------------------------- S10: the fitted model as a folder

def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/subscope-models"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = store._fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = store._fs(spark, path)
    lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream := fs.open(p), "UTF-8")
    stream.close()
    return lines


def save_model(cm: churn.ChurnModel, root: str, name: str, token: str = "") -> str:
    """The model in a new folder of ``root``/``name``: pipeline, what it was fitted on, and the marker last.
    Readers take marked folders only, so a writer that is lost half way leaves nothing they see."""
    spark = cm.features.sparkSession
    folder = f"{root}/{name}/{uuid.uuid4().hex}"
    cm.model.write().save(f"{folder}/pipeline")
    _write_text(spark, f"{folder}/about.json", json.dumps({"token": token, "schema": cm.features.schema.jsonValue()}))
    p, fs = store._fs(spark, f"{folder}/{store._PUBLISHED}")
    fs.create(p).close()
    return folder


def load_model(spark: SparkSession, root: str, name: str, features: T.StructType | None = None, token: str | None = None) -> PipelineModel:
    """The published model of ``root``/``name``. It is refused if it was fitted on columns that
    ``features`` does not have in the same types, or on tables with another token."""
    folder = store.published(spark, root, name)
    if folder is None:
        raise FileNotFoundError(f"no published model {name} under {root}")
    about = json.loads(_read_text(spark, f"{folder}/about.json"))
    if token is not None and about["token"] != token:
        raise ValueError(f"model {name} was fitted on other tables: {about['token']}")
    if features is not None:
        wanted = {f.name: f.dataType for f in T.StructType.fromJson(about["schema"]).fields}
        have = {f.name: f.dataType for f in features.fields}
        off = sorted(c for c, kind in wanted.items() if have.get(c) != kind)
        if off:
            raise ValueError(f"model {name} does not fit these columns: {off}")
    return PipelineModel.load(f"{folder}/pipeline")


def saved_model(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """The fitted model saved, loaded and applied to every user, as it is and as an expression:
    users, and those whose score differs (the expression's by more than 1e-9)."""
    cm = churn.fit_churn_model(t, p)
    token = str(getattr(t, "token", ""))
    root = f"{_root(t.users.sparkSession)}/{uuid.uuid4().hex}"
    save_model(cm, root, "churn", token)
    back = load_model(t.users.sparkSession, root, "churn", cm.features.schema, token)
    # both scores in one pass over the features
    first = cm.model.transform(cm.features).select("*", vector_to_array("probability")[1].alias("_first")).select(*cm.features.columns, "_first")
    both = back.transform(first).select("_first", vector_to_array("probability")[1].alias("_second"), LinearModel.of(back).probability().alias("_expr"))
    return both.agg(F.count(F.lit(1)).alias("users"),
                    F.count(F.when(~C("_first").eqNullSafe(C("_second")), 1)).alias("differing_scores"),
                    F.count(F.when(~(F.abs(C("_first") - C("_expr")) <= 1e-9), 1)).alias("differing_expressions"))


# ---------------------------------------------------------------- S09: the coefficient file

def write_coefficients(coefficients: DataFrame, path: str) -> str:
    """Coefficient CSV under ``path`` with its schema and an order-free digest of its rows beside it."""
    spark = coefficients.sparkSession
    write_csv(coefficients, f"{path}/rows", single_file=True)  # one row per slot
    about = {"schema": coefficients.schema.jsonValue(), "digest": _digest(coefficients)}
    _write_text(spark, f"{path}/about.json", json.dumps(about))
    return path


def _digest(df: DataFrame) -> list[str]:
    one = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return [str(one[0]), str(one[1])]


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """The file as written: typed by its own schema, refused if its rows are not those that were written."""
    about = json.loads(_read_text(spark, f"{path}/about.json"))
    df = spark.read.schema(T.StructType.fromJson(about["schema"])).option("header", True).csv(f"{path}/rows")
    if _digest(df) != about["digest"]:
        raise ValueError(f"{path} does not hold the rows that were written")
    return df


def _file(t: Tables, p: Period) -> DataFrame:
    spark = t.users.sparkSession
    path = f"{_root(spark)}/{uuid.uuid4().hex}/churn_coefficients"
    return read_coefficients(spark, write_coefficients(churn.coefficient_table(t, p), path))


def coefficient_file(t: Tables, p: Period = DEFAULT_PERIOD) -> DataFrame:
    """Every slot's coefficient as fitted and as read back from the file."""
    read, fitted = _file(t, p), churn.coefficient_table(t, p)
    both = fitted.select(C("Feature").alias("slot"), F.struct("Coefficient", "Absolute_Coefficient").alias("a")).join(
        read.select(C("Feature").alias("slot"), F.struct("Coefficient", "Absolute_Coefficient").alias("b")), "slot", "full")
    return both.select("slot", C("a").eqNullSafe(C("b")).alias("same"))


def top_coefficients(t: Tables, p: Period = DEFAULT_PERIOD, k: int = 10) -> DataFrame:
    """The k largest, served from the coefficient file."""
    return _file(t, p).orderBy(C("Absolute_Coefficient").desc(), "Feature").limit(k)


PLANS = {
    "fit_certificate": fit_certificate,
    "stored_model_scores": stored_model_scores,
    "saved_model": saved_model,
    "coefficient_file": coefficient_file,
    "top_coefficients": top_coefficients,
}
