"""The second tier of categorising: character n-grams, TF-IDF and multinomial logistic regression in pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

SIZES, BUCKETS = (2, 3, 4), 1 << 13


def ngrams(text: Column) -> Column:
    """Character n-grams within words, each word between blanks."""
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
    return F.flatten(F.transform(words, lambda w: F.flatten(F.array(*[cut(w, n) for n in SIZES]))))


def samples(spark: SparkSession) -> DataFrame:
    """(text, label): the keywords, the merchants whose category is fixed, and the training phrases."""
    rows = [(k, c) for c, ks in rules.CATEGORY_KEYWORDS.items() for k in ks] + [*rules.MERCHANT_CATEGORIES.items(), *rules.TRAINING_PHRASES.items()]
    return spark.createDataFrame(rows, "text string, label string")


def fit(spark: SparkSession, train: DataFrame | None = None) -> PipelineModel:
    train = samples(spark).coalesce(1) if train is None else train  # of the built-in ones there are two hundred
    train = train.withColumn("grams", ngrams(F.col("text"))).cache()
    labels = StringIndexer(inputCol="label", outputCol="index", stringOrderType="alphabetAsc").fit(train)
    stages = [
        labels, HashingTF(inputCol="grams", outputCol="tf", numFeatures=BUCKETS), IDF(inputCol="tf", outputCol="tfidf"),
        LogisticRegression(featuresCol="tfidf", labelCol="index", maxIter=50, regParam=0.01), IndexToString(inputCol="prediction", outputCol="guess", labels=labels.labels),
    ]
    model = Pipeline(stages=stages).fit(train)
    train.unpersist()
    return PipelineModel(model.stages[1:])


def load_or_fit(spark: SparkSession, path: str) -> PipelineModel:
    """The model saved at ``path``; fitted and saved there if it can't be read."""
    try:
        return PipelineModel.load(path)
    except Exception:
        model = fit(spark)
        model.write().overwrite().save(path)
        return model


def predicted(df: DataFrame, model: PipelineModel, *, where: Column | None = None) -> DataFrame:
    """``df`` with guess and guess_confidence from merchant and description; null for blank texts and where ``where`` is not true."""
    text = F.trim(F.concat_ws(" ", "merchant", "description"))
    wanted = (text != "") & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    df = df.withColumn("_wanted", wanted).withColumn("grams", F.when(F.col("_wanted"), ngrams(text)).otherwise(F.array().cast("array<string>")))
    out = model.transform(df)
    known = F.col("_wanted")
    kept = [c for c in df.columns if c not in ("_wanted", "grams")]
    return out.select(*kept, F.when(known, F.col("guess")).alias("guess"), F.when(known, F.array_max(vector_to_array("probability"))).alias("guess_confidence"))
