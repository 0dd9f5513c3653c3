"""Held-out accuracy of the two text classifiers, and their edge cases."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import langid, quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string"


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    good, bad = got[got["quality"] == 1], got[got["quality"] == 0]
    assert (good["predicted"] == 1).mean() >= 0.98 and (bad["predicted"] == 0).mean() >= 0.8


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate([None, "", " ", "a b c", "a b c", "word " * 100_000])], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: (r.score, r.predicted) for r in quality.classify(docs, none).collect()}
    assert got == {i: (0.5, 1) for i in range(6)}
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, None), (None, 0), (5, 0), (99, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert got[0] == got[1] and got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert quality.classify(docs.limit(0), labels).count() == 0
    scored = quality.score(docs, quality.fit(docs, labels))  # the clashing column is replaced
    assert dict(scored.dtypes)["score"] == "double" and scored.columns.count("score") == 1


def test_words_count():
    assert (quality.counts("spam ham jam") != quality.counts("good old day")).any()


def test_labels_that_depend_on_words_only(spark):
    """Two vocabularies of the same shapes: every word has five letters, one line, no marks."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    good, bad = (["".join(rng.choice(letters, 5)) for _ in range(60)] for _ in range(2))
    rows = []
    for i in range(1200):
        own, other = (good, bad) if i % 2 else (bad, good)
        rows.append((i, " ".join(str(rng.choice(own if rng.random() < 0.75 else other)) for _ in range(60)), None, "x"))
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, y = got["score"].rank().to_numpy(), got["quality"].to_numpy()
    n = y.sum()
    assert (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)) >= 0.9


def test_ties_go_to_the_first():
    cosines = np.array([[0.5, 0.9, 0.5, 0.5], [0.1, 0.2, 0.3, 0.3], [1, 1, 1, 1]], np.float32)
    assert quality.nearest(cosines, 2).tolist() == [[0, 1], [2, 3], [0, 1]]


def test_blocked_vote_equals_whole():
    rng = np.random.default_rng(0)
    model = quality.Model(np.ones(quality.WIDTH, np.float32), rng.normal(size=(quality.WIDTH, 8)).astype(np.float32), np.zeros((0, 0), np.float32), rng.integers(0, 2, 300).astype(np.float32), 9)
    model.vectors = model.place(rng.integers(0, 4, (300, quality.WIDTH)).astype(np.float32))
    x = rng.integers(0, 4, (20, quality.WIDTH)).astype(np.float32)
    near = model.place(x) @ model.vectors.T
    at = np.argsort(-near, axis=1)[:, :9]
    w = np.maximum(np.take_along_axis(near, at, axis=1), 0)
    want = (w * model.labels[at]).sum(axis=1) / w.sum(axis=1)
    assert np.allclose(model.score(x, block=37), want, atol=1e-5)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    rows = [(i, f"the cat {i}" if i % 2 else f"le chat é {i}", "en" if i % 2 else "fr", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "123 !", "en", "x"), (102, "", None, "x"), (None, "the cat", "en", "x"), (103, "the cat " * 50_000, None, "x"), (5, "the cat 5", "en", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[101].score == 0.0
    assert got[103].lang_pred == "en" and got[None].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_temperature_lowers_loss():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 500)
    logits = 8 * (np.eye(3)[truth] + rng.normal(0, 0.8, (500, 3)))
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(500), truth]).mean()
    assert loss(langid.calibrated(logits, truth)) < loss(1.0)


def test_ids_may_be_strings(spark):
    rows = [(f"d{i}", f"the cat {i}" if i % 2 else f"le chat é {i}", "en" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()} == {i: lang for i, _, lang in rows}
    labels = docs.selectExpr("doc_id", "cast(lang = 'en' as int) quality")
    got = quality.classify(docs, labels).collect()
    assert {r.doc_id for r in got} == {i for i, *_ in rows} and all(0 <= r.score <= 1 for r in got)


def test_an_id_of_many_rows_is_learned_once(spark, monkeypatch):
    rows = [(7, f"le chat {i}", "fr") for i in range(3000)] + [(100 + i, f"the cat {i}", "en") for i in range(80)]
    seen, train = [], langid.train
    monkeypatch.setattr(langid, "train", lambda rows, *how: seen.append(len(rows)) or train(rows, *how))
    for sample in (40, 10 ** 6):
        model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=sample)
        assert set(model.languages) <= {"en", "fr"}
    assert max(seen) <= 81


def plain_ftrl(rows, width, classes, epochs, alpha, beta, l1, l2):
    """One weight after the other, in Python's floats."""
    z = [[0.0] * classes for _ in range(width + 1)]
    n = [[0.0] * classes for _ in range(width + 1)]

    def weight(i, c):
        one, two = (0.0, 0.0) if i == width else (l1, l2)
        if abs(z[i][c]) <= one:
            return 0.0
        return -(z[i][c] - (one if z[i][c] > 0 else -one)) / ((beta + n[i][c] ** 0.5) / alpha + two)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x, truth = rows[r]
            active = [*zip(at.tolist(), x.tolist(), strict=True), (width, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in active for c in range(classes)}
            score = [sum(v * w[i, c] for i, v in active) for c in range(classes)]
            e = [np.exp(s - max(score)) for s in score]
            for i, v in active:
                for c in range(classes):
                    g = v * (e[c] / sum(e) - (c == truth))
                    z[i][c] += g - ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / alpha * w[i, c]
                    n[i][c] += g * g
    return np.array([[weight(i, c) for c in range(classes)] for i in range(width + 1)])


def test_training_equals_plain_ftrl():
    rng = np.random.default_rng(3)
    width, rows = 40, []
    for i in range(150):
        k = int(rng.integers(0, 3))
        at = np.sort(rng.choice(width, 6, replace=False, p=np.where(np.arange(width) % 3 == k, 4.0, 1.0) / np.where(np.arange(width) % 3 == k, 4.0, 1.0).sum()))
        x = rng.random(6)
        rows.append((at.astype(np.int32), (x / np.linalg.norm(x)).astype(np.float32), k))
    how = dict(epochs=2, alpha=0.5, beta=1.0, l1=0.3, l2=0.05)
    got, want = langid.train(rows, width, 3, **how), plain_ftrl(rows, width, 3, **how)
    assert np.allclose(got, want, atol=1e-5)
    assert (want[:-1] == 0).any() and (want[:-1] != 0).any()  # the first penalty keeps some at zero
