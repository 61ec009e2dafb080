"""Techniques of texts and vectors: a trained forest, a linear classifier, and similarity to class means where there is none."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import HashingTF, Normalizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwatch.operators import scorers
from cairnwatch.sources.shared import cut


#: Trees, their depth and the seed of a forest.
TREES, DEPTH, SEED = 100, 10, 42
#: Numbers that the pieces which a text is told by are hashed to.
FEATURES = 512


def _pieces(column: str) -> str:
    """SQL for the pieces of three letters of a text's words, each word with an edge on both sides; a null text has none.

    They are read off the text in one go: a piece has a letter in its middle, an edge has none.
    """
    edged = f"concat('_', regexp_replace(lower(coalesce({column}, '')), '[^\\\\p{{L}}]+', '_'), '_')"
    return f"regexp_extract_all({edged}, '(?=([\\\\p{{L}}_]\\\\p{{L}}[\\\\p{{L}}_]))', 1)"


def train_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, features: int = FEATURES) -> PipelineModel:
    """A random forest on texts (text, label: any string): from text to the probability of each label.

    Texts become hashed counts of letter pieces, scaled to length one. Rows without a label
    take no part. Spark grows the trees level by level, each level one aggregation over the
    rows, so that nothing but the splits' statistics leaves a task. Texts become counts once,
    in a written table that every pass reads.
    """
    pieces = SQLTransformer(statement=f"SELECT *, {_pieces('text')} AS _pieces FROM __THIS__")
    stages = [pieces, HashingTF(inputCol="_pieces", outputCol="_counts", numFeatures=features), Normalizer(inputCol="_counts", outputCol="features")]
    rows = labelled.where("label IS NOT NULL").select("text", F.col("label").cast("string").alias("label"))
    index = StringIndexer(inputCol="label", outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False)
    ready = PipelineModel(stages)
    counted = cut(ready.transform(rows).select("features", "label"), "forest-features")
    learnt = Pipeline(stages=[index, forest]).fit(counted)
    return PipelineModel([*stages, *learnt.stages])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel | None:
    """A saved model; None where none was saved, so that the caller can fall back to similarity."""
    try:
        spark.read.text(f"{path}/metadata").head()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return PipelineModel.load(path)


def classify_texts(model: PipelineModel, docs: DataFrame, threshold: float = 0.2, k: int = 10) -> DataFrame:
    """(doc_id, label, confidence, rank): the k likeliest labels of each text from the threshold on, ties by label.

    A null or empty text is scored like one without pieces.
    """
    labels = model.stages[-2].labels
    steps = PipelineModel([s for i, s in enumerate(model.stages) if i != len(model.stages) - 2])
    scored = steps.transform(docs.select("doc_id", "text")).select("doc_id", F.posexplode(vector_to_array("probability")).alias("i", "p"))
    each = scored.where(F.col("i") < len(labels)).select("doc_id", F.get(F.array(*map(F.lit, labels)), F.col("i")).alias("label"), "p")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("p").desc(), "label"))
    top = each.where(F.col("p") >= threshold).withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("doc_id", "label", F.round("p", 4).alias("confidence"), "rank")


def train(labelled: DataFrame, rounds: int = 50, weight: float = 0.01) -> LogisticRegressionModel:
    """Multinomial logistic regression on (embedding, label), a linear form beside the forest; each round is one distributed aggregation."""
    rows = labelled.where("embedding IS NOT NULL AND label IS NOT NULL").select(array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=rounds, regParam=weight, family="multinomial").fit(rows)


def classify(model: LogisticRegressionModel, vectors: DataFrame, threshold: float = 0.2, k: int = 10) -> DataFrame:
    """(vec_id, label, confidence, rank): the k likeliest labels of each vector from the threshold on."""
    rows = model.transform(vectors.select("vec_id", array_to_vector("embedding").alias("features")))
    each = rows.select("vec_id", F.posexplode(vector_to_array("probability")).alias("label", "p"))
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy(F.col("p").desc(), "label"))
    top = each.where(F.col("p") >= threshold).withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("vec_id", F.col("label").cast("long").alias("label"), F.round("p", 4).alias("confidence"), "rank")


def by_similarity(labelled: DataFrame, vectors: DataFrame, threshold: float = 0.5, k: int = 10) -> DataFrame:
    """The k labels whose mean vectors are nearest by cosine, from the threshold on."""
    parts = labelled.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(F.col("label").cast("long").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    near = scorers.vector_topk(vectors, means, k, threshold=threshold)
    return near.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("label"), F.col("score").alias("confidence"), "rank")
