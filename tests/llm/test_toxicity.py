import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from helpers import frame, odd_rows, sentence

from docloom.llm import toxicity


def corpus(n=600):
    rng = random.Random(4)
    bad = ["idiot", "moron", "scum", "zaffoxy", "zaffoyo", "zaffoka", "stupid"]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        w = sentence(rng, 60).split()
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    patterns, weights, model = toxicity.fit(docs, table)
    truth = dict(labels)
    got = toxicity.score(docs, patterns, weights).select("doc_id", "score", "predicted", toxicity.fold(F.col("doc_id")).alias("fold")).collect()
    held = [r for r in got if r.fold == 0]
    assert held and all(r.fold == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert 0.1 < model.prior < 0.3 and all(b > a - 1 for a, b in zip(model.likelihood[13:], model.likelihood[14:]))


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = corpus(200)
    docs = frame(spark, rows, extra=False)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    scores = []
    for table in (labels, flipped):
        patterns, weights, _ = toxicity.fit(docs, spark.createDataFrame(table, "doc_id long, toxic int"))
        scores.append([round(r.score, 9) for r in toxicity.score(docs, patterns, weights).orderBy("doc_id").collect()])
    assert scores[0] == scores[1]


def test_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame(spark, odd_rows() + [(50, "you idiot moron")])
    patterns, weights, _ = toxicity.fit(docs, none)
    got = toxicity.score(docs, patterns, weights)
    assert got.count() == len(odd_rows()) + 1 and got.where("score IS NULL").count() == 0
    empty = frame(spark, [])
    patterns, weights, _ = toxicity.fit(empty, none)
    assert toxicity.score(empty, patterns, weights).count() == 0


def test_repeated_rows_long_texts_and_repeated_labels(spark):
    rows, labels = corpus(300)
    long = "fine words here " * 60_000
    rows += [(1000, rows[0][1])] * 3 + [(1001, long), (1002, long + "idiot moron"), (None, rows[0][1])]
    table = spark.createDataFrame(labels + [(1000, 1)] * 4 + [(None, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    patterns, weights, _ = toxicity.fit(docs, table, max_training=100)
    got = toxicity.score(docs, patterns, weights)
    assert len(set(got.columns)) == len(got.columns)
    scores = {}
    for r in got.collect():
        scores.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in scores.values()) and len(scores[long]) == 1


def simulated(n=6000, share=0.2, seed=1):
    """Answers of three independent voters, one that mostly repeats the first, and one that always does."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < share
    votes = []
    for right, wrong in ((0.8, 0.05), (0.7, 0.1), (0.75, 0.02)):
        said = np.where(rng.random(n) < np.where(y, right, wrong), toxicity.TOXIC, toxicity.CLEAN)
        votes.append(np.where(rng.random(n) < 0.2, toxicity.ABSTAIN, said))
    votes += [np.where(rng.random(n) < 0.8, votes[0], rng.integers(0, 3, n)), votes[0]]
    keys = sum(v.astype(np.int64) * 3**k for k, v in enumerate(votes))
    return y, votes, keys, dict(zip(*(x.tolist() for x in np.unique(keys, return_counts=True))))


def test_label_model_equals_enumeration():
    """The tree's probabilities, term by term, over every possible pattern of votes."""
    y, votes, keys, counts = simulated()
    model = toxicity.LabelModel(counts, 5)
    every = np.arange(3**5)
    total = 0.0
    for key in every.tolist():
        said = [key // 3**k % 3 for k in range(5)]
        p = [1 - model.prior, model.prior]
        for c in (0, 1):
            for v in range(5):
                up = model.parent[v]
                p[c] *= model.table[c, v, said[up] if up >= 0 else 0, said[v]]
        total += sum(p)
        assert abs(model.posterior(np.array([key]))[0] - p[1] / sum(p)) < 1e-9
    assert abs(total - 1) < 1e-9
    assert all(b > a - 1 for a, b in zip(model.likelihood[13:], model.likelihood[14:]))


def test_label_model_learns_accuracies_and_correlations():
    y, votes, keys, counts = simulated()
    model = toxicity.LabelModel(counts, 5)
    assert abs(model.prior - 0.2) < 0.03 and np.mean((model.posterior(keys) > 0.5) == y) > 0.88
    assert model.parent.tolist() == [-1, -1, -1, 0, 0]
    assert abs(model.table[1, 1, 0, toxicity.TOXIC] - 0.8 * 0.7) < 0.1 and abs(model.table[0, 1, 0, toxicity.TOXIC] - 0.8 * 0.1) < 0.03
    # a copy of a voter adds nothing: the posterior without it is nearly the same
    three, four = keys % 3**3, keys % 3**3 + 3**3 * votes[4].astype(np.int64)
    found = [toxicity.LabelModel(dict(zip(*(x.tolist() for x in np.unique(k, return_counts=True)))), n).posterior(k) for n, k in ((3, three), (4, four))]
    assert np.abs(found[0] - found[1]).mean() < 0.05
    # a mostly toxic corpus keeps its share
    y, votes, keys, counts = simulated(share=0.7, seed=2)
    assert abs(toxicity.LabelModel(counts, 5).prior - 0.7) < 0.06
