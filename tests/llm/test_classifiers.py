import random

import numpy as np
from conftest import TESTDATA
from corpora import empty, frame, odd, prose
from pyspark.sql import functions as F

from oddsmith.llm.labelled import Rows, drawn, rows_by
from oddsmith.llm.quality import FEATURES, machine, quality_scores, without_low_quality
from oddsmith.llm.queries import QUERIES
from oddsmith.llm.toxicity import BITS, fit_logistic, toxicity_scores
from oddsmith.operators.evaluate import roc_auc


def held_out_auc(spark, name, label):
    found = QUERIES[name](spark, TESTDATA.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{TESTDATA.replace('sf0.001', 'sf0.01')}/labels.parquet")
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    return roc_auc(found.join(labels, "doc_id").where("held_out"), label, "score").first()["auc"]


def test_toxicity_held_out(spark):
    assert held_out_auc(spark, "op2_toxicity", "toxic") >= 0.85  # some 30 toxic rows to learn from


def test_quality_held_out(spark):
    assert held_out_auc(spark, "op9_quality_factorisation_machine", "quality") >= 0.95


def test_sum_of_squares_identity_equals_all_pairs():
    rng = np.random.default_rng(1)
    doc = np.sort(rng.integers(0, 5, 40))
    rows = rows_by(doc, rng.integers(0, 30, 40), rng.normal(size=40), 6)
    w, v = rng.normal(size=30), rng.normal(size=(30, 4))
    z, _ = machine(rows, w, v, 0.5)
    for i in range(6):
        at = range(rows.first[i], rows.first[i + 1])
        want = 0.5 + sum(w[rows.feature[a]] * rows.value[a] for a in at)
        for a in at:
            for b in range(a + 1, rows.first[i + 1]):
                want += (v[rows.feature[a]] @ v[rows.feature[b]]) * rows.value[a] * rows.value[b]
        assert abs(z[i] - want) < 1e-9
    part = rows.take(np.array([3, 1]))
    assert np.allclose(machine(part, w, v, 0.5)[0], z[[3, 1]])


def test_the_penalty_closes_the_gap_of_a_swap():
    """Labels that lean on a group's mention: with the penalty, the swap changes less."""
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.3).astype(float)
    feature, owner, value = [], [], []
    for i in range(400):
        mentions = rng.random() < (0.9 if y[i] else 0.1)
        own = [1 if mentions else 2, 3 + int(y[i])] if rng.random() < 0.8 else [1 if mentions else 2]
        swap = [(own[0] + (1 << BITS), -1), ((3 - own[0]) + (1 << BITS), 1)]
        for f, v in [(f, 1) for f in own] + swap:
            feature.append(f)
            value.append(v)
            owner.append(i)
    rows = rows_by(np.array(owner), np.array(feature), np.array(value, float), 400)
    gaps = []
    for fairness in (0.0, 20.0):
        w, _ = fit_logistic(rows, y, fairness, 2e-3, 400)
        gaps.append(abs(w[1] - w[2]))
        assert w[4] > w[3]
    assert gaps[1] < 0.3 * gaps[0]


def labelled(spark, n=120):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30) + (" vile " if i % 4 == 0 else " fine "), "en", "s", 100) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 != 0)) for i in range(n)], "doc_id long, toxic int, quality int")
    return rows, labels


def test_swapped_mentions_score_alike(spark):
    rows, labels = labelled(spark)
    rows = [(d, t + (" women" if d % 4 == 0 else " men"), *r) for d, t, *r in rows]
    asked = [(1000, "we met women here", "", "", 0), (1001, "we met men here", "", "", 0)]
    gap = {}
    for fairness in (0.0, 10.0):
        found = toxicity_scores(frame(spark, [*rows, *asked]), labels, F.lit(True), fairness=fairness).collect()
        score = {r["doc_id"]: r["score"] for r in found}
        gap[fairness] = abs(score[1000] - score[1001])
        assert min(score[i] for i in range(0, 120, 4)) > max(score[i] for i in range(1, 120, 4))
    assert gap[10.0] < 0.5 * gap[0.0]


def test_odd_rows_and_columns(spark):
    rows, labels = labelled(spark)
    more = [(500, None, None, None, None), (501, "", "", "", 0), (502, "vile " * 20000, "", "", None), rows[0], rows[0]]
    for scores in (toxicity_scores, quality_scores):
        found = scores(odd(spark, [*rows, *more]), labels, F.lit(True))
        assert found.columns == ["doc_id", "score"] and found.count() == len(rows) + len(more) + 2
        assert found.where("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert scores(empty(spark), labels, F.lit(True)).count() == 0
        none = scores(frame(spark, rows), labels.limit(0), F.lit(True)).select("score").distinct().collect()
        assert [round(r[0], 6) for r in none] == [0.5]
        ones = labels.selectExpr("doc_id", "1 AS toxic", "1 AS quality")
        assert scores(frame(spark, rows), ones, F.lit(True)).where("score < 0.99").count() == 0
        strange = labels.selectExpr("doc_id", "CAST(NULL AS int) AS toxic", "7 AS quality")
        assert scores(frame(spark, rows), strange, F.lit(True)).count() == len(rows)


def test_filter_keeps_columns(spark):
    rows, labels = labelled(spark)
    df = odd(spark, rows)
    kept = without_low_quality(df, labels, F.lit(True), metadata=F.col("n_chars"), least=0.5)
    assert kept.schema == df.schema
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in range(120) if i % 4}
    assert isinstance(rows_by(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0), Rows) and FEATURES > 1 << 16


def test_a_sample_of_very_many_labels_is_not_empty(spark):
    """A share of less than 1 in 2**20, and one between two steps of that size."""
    rows = spark.range(1 << 25)
    few = rows.where(drawn("id", 12_500, 12_500 << 22)).count()
    assert 1 <= few <= 20  # 8 on average
    between = rows.where(drawn("id", 19_000, 10_000 << 20)).count()
    assert 40 <= between <= 85  # 61 on average
    assert rows.where(drawn("id", 1, 1)).count() == 1 << 25
