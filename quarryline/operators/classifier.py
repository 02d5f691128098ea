"""Page classifier: features, training, prediction, and models as SQL that runs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.patterns import FEATURE_WORDS


@dataclass(frozen=True)
class Feature:
    """A slot of the feature vector; ``kind`` is count, ratio or word. ``sql`` gives its value in SQL over the dataset, or, if
    ``located``, over text columns as the relational page table has them (there a word may stand anywhere in the url)."""

    name: str
    kind: str
    located: bool = False

    @property
    def sql(self) -> str:
        if self.kind != "word":
            return self.name
        where, word = self.name.split("_word_")
        if self.located:
            return f"(locate(' {word} ', distinct_words_text) <> 0)" if where == "page" else f"(locate('{word}', lower(url)) <> 0)"
        return f"(array_contains({where}_words, '{word}'))"

    def condition(self, at_most: bool, threshold: float) -> str:
        """SQL of one side of a split. Words are split anywhere in [0, 1), ratios inside [0, 1]."""
        if self.kind == "word":
            if not 0.0 <= threshold < 1.0:
                raise ValueError(f"{self.name}: {threshold}")
            return f"{self.sql} = {'false' if at_most else 'true'}"
        if self.kind == "ratio" and not 0.0 <= threshold <= 1.0:
            raise ValueError(f"{self.name}: {threshold}")
        return f"{self.sql} {'<=' if at_most else '>'} CAST({threshold!r} AS DOUBLE)"


def features(words: tuple[str, ...] = FEATURE_WORDS, located: bool = False) -> list[Feature]:
    counts = [f"text_vpm_r{i}" for i in range(1, 5)] + [f"url_vpm_r{i}" for i in range(1, 5)] + ["num_words", "num_distinct_words", "longest_sequence", "num_pages", "num_distinct_matched_patents", "num_distinct_han_names"]
    ratios = [f"share_top{i}" for i in range(1, 6)] + ["han_names_herfindahl_index"]
    return [Feature(n, "count") for n in counts] + [Feature(n, "ratio") for n in ratios] + [Feature(f"{where}_word_{w}", "word", located) for where in ("page", "url") for w in words]


def feature_table(spark: SparkSession, found: list[Feature]) -> DataFrame:
    return spark.createDataFrame([(i, f.name, f.kind) for i, f in enumerate(found)], "index int, name string, kind string")


def dataset(pages: DataFrame, counts: DataFrame, domains: DataFrame, stats: DataFrame, how: str = "left") -> DataFrame:
    """Pages with all that features need; with ``left`` what a domain lacks is 0, with ``inner`` such pages are left out."""
    rows = pages.select("page_id", "url", "domain", "num_words", "num_distinct_words", "longest_sequence", F.col("distinct_words").alias("page_words"), F.coalesce(urls.path_words(F.col("url")), F.array().cast("array<string>")).alias("url_words"))
    rows = rows.join(counts, "page_id").join(domains.select("domain", "num_pages"), "domain", how)
    rows = rows.join(stats.select("domain", "num_distinct_matched_patents", "num_distinct_han_names", *(f"share_top{i}" for i in range(1, 6)), "han_names_herfindahl_index"), "domain", how)
    return rows.na.fill(0)


def assembled(rows: DataFrame, found: list[Feature]) -> DataFrame:
    """The dataset with its feature vector; all slots in one projection."""
    slots = [F.expr(f.sql).cast("double").alias(f"_f{i}") for i, f in enumerate(found)]
    wide = rows.select("*", *slots)
    names = [f"_f{i}" for i in range(len(found))]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(wide).drop(*names)


def tree(training: DataFrame, depth: int = 5, bins: int = 32) -> DecisionTreeClassificationModel:
    return DecisionTreeClassifier(impurity="gini", maxDepth=depth, maxBins=bins, seed=1).fit(training)


def regression(training: DataFrame, iterations: int = 100) -> LinearRegressionModel:
    """Least squares without an intercept, slightly ridged as many words don't occur. Up to 4096 features, one pass solves it."""
    return LinearRegression(maxIter=iterations, fitIntercept=False, regParam=1e-3, solver="auto").fit(training)


def predicted(model, rows: DataFrame, found: list[Feature]) -> DataFrame:
    return model.transform(assembled(rows, found))


def binary(value: Column) -> Column:
    return F.when(value < 0.5, 0.0).otherwise(1.0)


def leaves(model: DecisionTreeClassificationModel) -> list[tuple[list[tuple[int, bool, float]], float]]:
    """Path (feature, at most, threshold) and prediction of each leaf, from left to right."""
    out = []

    def go(node, way: list) -> None:
        if node.numDescendants() == 0:
            out.append((way, node.prediction()))
            return
        split = node.split()
        for at_most, child in ((True, node.leftChild()), (False, node.rightChild())):
            go(child, [*way, (split.featureIndex(), at_most, split.threshold())])

    go(model._java_obj.rootNode(), [])
    return out


def tree_sql(model: DecisionTreeClassificationModel, found: list[Feature], view: str = "ClassifierDataset") -> str:
    """A query for what the tree takes as positive: its branches or-ed, the conditions of a branch and-ed."""
    branches = [" AND ".join(found[i].condition(at_most, t) for i, at_most, t in way) or "true" for way, label in leaves(model) if label == 1.0]
    return f"SELECT url FROM {view} WHERE " + ("\n   OR ".join(f"({b})" for b in branches) or "false") + " ORDER BY url"


def regression_sql(model: LinearRegressionModel, found: list[Feature], view: str = "ClassifierDataset") -> str:
    """A query for the weighted sum, largest weights first."""
    terms = sorted(((w, f) for w, f in zip(model.coefficients.toArray().tolist(), found, strict=True) if w), key=lambda t: -abs(t[0]))
    total = "\n + ".join(f"CAST({f.sql} AS DOUBLE) * CAST({w!r} AS DOUBLE)" for w, f in terms) or "CAST(0 AS DOUBLE)"
    return f"SELECT ({total}) AS score, url FROM {view} ORDER BY score DESC, url"


def prediction_lines(predicted: DataFrame, score: str = "prediction") -> DataFrame:
    """``score TAB domain TAB url``, the largest scores first."""
    return predicted.orderBy(F.desc(score), "url").select(F.concat_ws("\t", F.col(score).cast("string"), "domain", "url").alias("value"))


def dictionary_words(words: DataFrame, dictionary: DataFrame, column: str = "word") -> DataFrame:
    """Words with whether a dictionary (word) has them; a stand-in for lexical databases that the user provides."""
    known = dictionary.select(F.lower(dictionary.columns[0]).alias("_w")).distinct().withColumn("in_dictionary", F.lit(True))
    return words.join(known, F.lower(words[column]) == known["_w"], "left").drop("_w").na.fill(False, ["in_dictionary"])


def with_timeout(job: Callable, seconds: float, spark: SparkSession):
    """Runs a job and cancels its Spark jobs when it takes too long."""
    sc, group = spark.sparkContext, f"limit-{uuid.uuid4().hex}"
    sc.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    timer.start()
    try:
        return job()
    finally:
        timer.cancel()
        sc._jsc.sc().clearJobGroup()
