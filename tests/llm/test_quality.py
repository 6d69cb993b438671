"""Quality classifier: the update rule against a plain twin, held-out accuracy, and odd rows."""

import math

import numpy as np
from llm_help import crowded, texts
from pyspark.sql import functions as F

from gridspark.llm import quality as Q
from gridspark.llm.toxicity import held_out

SF = "/root/testdata/sf0.01"


def test_updates_equal_the_rule():
    rng = np.random.default_rng(4)
    leader, z, n = Q.Leader(), {}, {}

    def weight(i):
        l1 = 0.0 if i == 1 << Q.BITS else Q.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    for _ in range(300):
        at = np.sort(rng.choice([1, 5, 9, 77, 1000, 1 << Q.BITS], size=3, replace=False))
        x, y = rng.random(3), int(rng.random() < 0.4)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at.tolist(), x))))
        step = {i: (p - y) * v for i, v in zip(at.tolist(), x)}
        old = {i: weight(i) for i in step}
        for i, g in step.items():
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / Q.ALPHA * old[i]
            n[i] = n.get(i, 0.0) + g * g
        assert abs(leader.learn(at, x, y) - p) < 1e-12
    assert all(abs(leader.z[i] - z[i]) < 1e-9 for i in z)


def test_features_are_shares_of_runs():
    def plain(text):
        words = Q._WORD.findall(text)
        return {n: max(0, len(words) - n + 1) for n in (1, 2, 3)}

    for text in ("One two, TWO two two!", "x", "今天 9a 99 Über_all"):
        at, x = Q.features(text, Q._Digests())
        n = plain(text)
        kinds = sum(bool(n[k]) for k in range(1, Q.WORDS + 1)) + sum(bool(n[k]) for k in range(1, Q.SHAPES + 1))
        assert abs((x * x).sum() - kinds) < 1e-9 and len(at) == len(x)
    same = [Q.features(t, Q._Digests()) for t in ("abc def", "abc def")]
    assert (same[0][0] == same[1][0]).all()
    assert len(Q.features(None, Q._Digests())[0]) == len(Q.features(" \n", Q._Digests())[0]) == 0
    # A text of more different words than a task keeps at hand.
    many = " ".join(f"w{i}" for i in range(Q.KNOWN + 10))
    at, x = Q.features(many, Q._Digests())
    assert abs((x * x).sum() - 5) < 1e-6


def test_quality_holds_out_and_learns(sp):
    docs, labels = sp.read.parquet(f"{SF}/documents.parquet"), sp.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit(docs, labels)
    rows = Q.quality(crowded(docs), model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).select("score", "quality").collect()
    good, low = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean(np.array(good) >= Q.THRESHOLD) >= 0.97 and np.mean(np.array(low) < Q.THRESHOLD) >= 0.9
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.fit(docs.repartition(5), turned)
    assert (again.buckets == model.buckets).all() and (again.weights == model.weights).all() and again.bias == model.bias


def test_quality_of_odd_rows(sp):
    docs = texts(sp, [(1, None), (2, ""), (2, ""), (None, "words"), (3, "word " * 300_000), (4, "plain words.")])
    none = sp.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = sp.createDataFrame([(None, 1, 0), (2, None, 0), (1, 1, 0), (2, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    both = sp.createDataFrame([(i, i % 2, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    for labels in (none, odd, both):
        got = Q.quality(crowded(docs), Q.fit(docs, labels)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert Q.quality(texts(sp, []), Q.Model()).count() == 0
    assert Q.quality(docs, Q.Model(), keep_text=False).columns == ["doc_id", "lang", "source", "n_chars", "score"]
