import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm.catalog.op06 import op6_rule_ensemble
from wordloom.llm.common import keyed_text, read_table
from wordloom.llm.rule_ensemble import FEATURES, Rule, fit_lasso, fit_rules, in_training, keep_good, score_quality, smallest_leaf, train_quality_rules, with_statistics

SF_DIR = "/root/testdata/sf0.01"


def auc(labels, scores):
    good, bad = scores[labels == 1], scores[labels == 0]
    return np.mean((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :]))


@pytest.fixture(scope="module")
def model(spark):
    return train_quality_rules(read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "labels"))


def test_held_out_labels(spark):
    labels = read_table(spark, SF_DIR, "labels").select("doc_id", "quality")
    scored = op6_rule_ensemble(spark, SF_DIR)
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows.quality.to_numpy(), rows.score.to_numpy()) > 0.98
    assert (rows.predicted == rows.quality).mean() > 0.95
    assert scored.count() == 1000 and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert scored.where("predicted <> cast(score >= 0.3 as int)").count() == 0


def test_few_labels_give_rules_too(spark):
    labels = read_table(spark, "/root/testdata/sf0.001", "labels").select("doc_id", "quality")
    rows = op6_rule_ensemble(spark, "/root/testdata/sf0.001").join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert auc(rows.quality.to_numpy(), rows.score.to_numpy()) > 0.9
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.9
    assert [smallest_leaf(np.array([1] * n + [0] * 900, float)) for n in (1, 8, 100, 500)] == [2, 2, 10, 20]


def test_the_model_is_sparse_and_its_column_is_the_model(spark, model):
    assert 0 < len(model.rules) < 80 and all(1 <= len(r.parts) <= 3 for r in model.rules)
    rows = with_statistics(keyed_text(read_table(spark, SF_DIR, "documents"), "doc_id", "text"))
    found = rows.select(*FEATURES, model.column().alias("score")).toPandas()
    assert np.allclose(model.score(found[list(FEATURES)].to_numpy(float)), found.score.to_numpy(), atol=1e-12)


def test_held_out_labels_and_other_columns_are_not_inputs(spark, model):
    docs, labels = read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "labels")
    turned = labels.withColumn("quality", F.when(in_training(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    blank = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None)).withColumn("score", F.lit(9)).withColumn("words", F.lit(9))
    assert train_quality_rules(blank, turned) == model


def test_rules_and_lasso():
    rng = np.random.default_rng(1)
    values = rng.random((2000, len(FEATURES)))
    labels = ((values[:, 0] > 0.5) & (values[:, 3] <= 0.7)).astype(float)
    model = fit_rules(values, labels)
    assert auc(labels, model.score(values)) > 0.99
    rule = Rule(((0, False, 0.5), (3, True, 0.7)))
    assert (rule.holds(values) == (labels == 1)).all() and str(rule) == "n_words > 0.5 and mark_share <= 0.7"
    held = np.column_stack([labels, rng.random(2000) < 0.5]).astype(float)
    intercept, weights = fit_lasso(held, labels, penalty=0.01)
    assert weights[0] > 1 and weights[1] == 0
    assert fit_lasso(held, labels, penalty=10.0)[1].tolist() == [0, 0]


@pytest.mark.parametrize("labels", [[], [1], [0, 0, 0]])
def test_without_two_labels_there_are_no_rules(labels):
    model = fit_rules(np.zeros((len(labels), len(FEATURES))), np.array(labels, float))
    assert not model.rules and 0 < model.score(np.zeros((1, len(FEATURES))))[0] < 1


def test_rows(spark, model):
    rows = [(1, "Some text.", "a"), (1, "Some text.", "a"), (None, None, None), (2, "", "b"), (3, "long words " * 100_000, "c"), (4, "### %%% " * 60, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    found = score_quality(docs, model)
    assert found.count() == 6 and found.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    assert found.where("doc_id = 1").select("score").distinct().count() == 1
    kept = keep_good(docs, model, 0.3)
    assert kept.schema == docs.schema and 4 not in {r.doc_id for r in kept.collect()}
    assert keep_good(docs, model, 0.0).count() == 6 and score_quality(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert not train_quality_rules(docs, labels).rules
