import numpy as np
from pyspark.sql import functions as F

from llm.brute import rows
from veriscope.llm import toxicity as tx


def test_held_out_accuracy(spark, small):
    """Labels that the chain did not see: fitted on half of them, judged on the other half."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    chain = tx.train_chain(documents, labels.filter("doc_id % 2 = 0"), tx.label_categories())
    truth = {d: t for d, t in rows(small, "SELECT doc_id, toxic FROM labels WHERE doc_id % 2 = 1")}
    got = {r.doc_id: r.is_toxic for r in tx.score_documents(documents, chain).collect() if r.doc_id in truth}
    right = np.mean([got[d] == bool(t) for d, t in truth.items()])
    false_alarms = sum(got[d] and not t for d, t in truth.items())
    assert right > 0.94 and false_alarms <= 2


def test_score_is_the_sum_of_feature_weights(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    chain = tx.train_chain(documents, spark.read.parquet(f"{small}/labels.parquet"), tx.label_categories())
    weights = dict(zip(chain.features.tolist(), chain.weights.tolist(), strict=True))
    adds = tx._Adds(chain)
    for _, text in rows(small, "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50"):
        odds = []
        for j in range(2):
            z = chain.biases[j] + sum(weights.get(int(f), (0, 0))[j] for f in tx.text_features(text)) + sum(chain.links[j, : len(odds)] / (1 + np.exp(-np.array(odds))))
            odds.append(float(np.clip(z, -tx.CLIP, tx.CLIP)))
        assert np.allclose(odds, tx.score_text(text, chain, adds), atol=1e-3)


def test_low_quality_alone_is_not_toxic(spark, small):
    """The earlier category enters as a probability, so no clean label is called toxic for its junk."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    chain = tx.train_chain(documents, labels, tx.label_categories())
    clean = documents.join(labels.filter("toxic = 0").select("doc_id"), "doc_id")
    assert tx.score_documents(clean, chain).filter("is_toxic").count() == 0


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    features = [np.array([rng.integers(0, 2), 2 + rng.integers(0, 2)], dtype=np.int32) for _ in range(400)]
    first = np.array([0 in f for f in features]).astype(int)
    chain = tx.fit_chain(features, np.column_stack([first, first]), np.arange(400) % 5, ("a", "b"))
    assert chain.links[1, 0] > 0 and chain.links[0].sum() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2), (None, "x" * 200_000, 3)], "doc_id long, text string, p_toxic int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = tx.train_chain(df, labels, tx.label_categories())
    got = tx.score_documents(df, chain).collect()
    assert len(got) == 4 and not any(r.is_toxic for r in got) and len({r.p_toxic for r in got}) == 1
    one_value = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    chain = tx.train_chain(df, one_value, tx.label_categories())
    assert not any(r.is_toxic for r in tx.score_documents(df, chain).collect())
    assert tx.score_documents(df.limit(0), chain).filter(F.col("is_toxic")).count() == 0


def test_sample_is_bounded_behind_the_join(spark, monkeypatch):
    """Copies of a labelled document do not make the sample longer."""
    df = spark.createDataFrame([(1, f"bad word{i}") for i in range(50)] + [(2, "good words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)] * 3 + [(2, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    fit = tx.fit_chain
    monkeypatch.setattr(tx, "fit_chain", lambda features, y, folds, names: seen.append(len(features)) or fit(features, y, folds, names))
    tx.train_chain(df, labels, tx.label_categories(), max_rows=20)
    assert seen == [20]


def test_own_columns_named_like_scores_stay(spark):
    df = spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id long, text string, is_toxic string, p_toxic int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = tx.train_chain(df, labels, tx.label_categories())
    assert [tuple(r) for r in tx.without_flagged(df, chain).collect()] == [(1, "a b", "mine", 7)]


def _plain_fit(counts, dense, y):
    """Minimum of the penalised log loss by Newton steps on dense matrices; returns a function of (counts, dense)."""
    n, size = counts.shape
    yes, no = counts[y == 1].sum(axis=0), counts[y == 0].sum(axis=0)
    ratio = np.log((yes + 1) / (y.sum() + 2)) - np.log((no + 1) / (n - y.sum() + 2))
    ratio = np.where(np.abs(ratio) < tx.MIN_LOG_RATIO, 0, ratio)
    design = lambda c, d: np.column_stack([c * ratio, d, np.ones(len(c))])
    x = design(counts, dense)
    penalty = np.full(x.shape[1], tx.L2)
    penalty[-1] = 0
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        w -= np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    return lambda c, d: 1 / (1 + np.exp(-np.clip(design(c, d) @ w, -tx.CLIP, tx.CLIP)))


def test_chain_equals_a_plain_out_of_fold_chain():
    rng = np.random.default_rng(11)
    features, labels = [], []
    for _ in range(400):
        a, b = rng.random() < 0.4, rng.random() < 0.3
        row = [int(x) for x in rng.integers(20, 40, size=6)]
        row += [int(rng.integers(0, 4))] if a and rng.random() < 0.9 else []
        row += [int(rng.integers(4, 8))] if b and rng.random() < 0.8 else []
        features.append(np.sort(np.array(row, dtype=np.int32)))
        labels.append((int(a), int(a and b)))
    labels, folds = np.array(labels), np.arange(400) % tx.FOLDS
    chain = tx.fit_chain(features, labels, folds, ("first", "second"))

    counts = np.array([np.bincount(f, minlength=40) for f in features], dtype=float)
    earlier, told = np.zeros((400, 0)), np.zeros((400, 0))
    for j in range(2):
        y = labels[:, j]
        whole = _plain_fit(counts, earlier, y)
        told = np.column_stack([told, whole(counts, told)])
        held_out = np.zeros(400)
        for fold in range(tx.FOLDS):
            out = folds == fold
            held_out[out] = _plain_fit(counts[~out], earlier[~out], y[~out])(counts[out], earlier[out])
        earlier = np.column_stack([earlier, held_out])

    got = np.zeros((400, 0))
    weights = dict(zip(chain.features.tolist(), chain.weights.tolist(), strict=True))
    for j in range(2):
        z = np.array([sum(weights.get(int(f), (0, 0))[j] for f in row) for row in features]) + got @ chain.links[j, :j] + chain.biases[j]
        got = np.column_stack([got, 1 / (1 + np.exp(-np.clip(z, -tx.CLIP, tx.CLIP)))])
    assert np.abs(got - told).max() < 0.02 and np.abs(got - told).mean() < 0.004
    assert ((got[:, 1] > 0.5) == labels[:, 1]).mean() > 0.85
