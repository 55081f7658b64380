import numpy as np
from pyspark.sql import functions as F

from fieldlark.llm import quality
from fieldlark.llm.queries import QUERIES, fold
from fieldlark.llm.words import SpanHasher
from fieldlark.session import small_table


def area(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = (y == 1).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    out = QUERIES["op7_quality_classifier"](spark, folder)
    assert out.where((F.col("held_out") != (fold(4) == 2)) | (F.col("predicted") != (F.col("score") >= 0.7).cast("int"))).isEmpty()
    rows = out.where("held_out").join(labels, "doc_id").toPandas()
    assert area(rows.quality.to_numpy(), rows.score.to_numpy()) > 0.97
    assert (rows.predicted == rows.quality).mean() > 0.96


def test_gradients_are_those_of_the_loss():
    draw = np.random.Generator(np.random.PCG64(2))
    p = {"W": draw.normal(size=(quality.WIDTH, 3)), "b": draw.normal(size=3), "V": draw.normal(size=(3, 2)), "U": draw.normal(size=(3, 2)),
         "w": draw.normal(size=2), "c": draw.normal(size=3), "d": draw.normal(size=1)}
    p["W"] *= 0.1
    x, starts, y = draw.normal(size=(9, quality.WIDTH)), np.array([0, 1, 5]), np.array([1.0, 0, 1])

    def loss():
        s = quality._forward(p, x, starts)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k, g in quality._gradients(p, x, starts, y).items():
        for at in [tuple(draw.integers(0, n) for n in p[k].shape) for _ in range(4)]:
            old = p[k][at]
            p[k][at] = old + 1e-5
            up = loss()
            p[k][at] = old - 1e-5
            slope = (up - loss()) / 2e-5
            p[k][at] = old
            assert abs(slope - g[at]) < 1e-6


def test_attention_adds_up_to_one_and_finds_the_bad_passage():
    good, bad = "plain words of some length here and there " * 12, "$$$ %%% ### &&& " * 100
    bags = [quality.passages(SpanHasher(), t) for t in [good * (1 + i % 4) for i in range(30)] + [good * (1 + i % 4) + bad for i in range(30)]]
    model = quality.train(bags, np.array([1] * 30 + [0] * 30))
    score, attention = model.scores(np.concatenate([bags[2], bags[32]]), np.array([0, len(bags[2])]))
    assert score[0] > 0.9 and score[1] < 0.1
    assert attention[: len(bags[2])].sum() == 1.0 or abs(attention[: len(bags[2])].sum() - 1) < 1e-9


def test_passages_cover_whole_texts():
    bag = quality.passages(SpanHasher(), "\n a " * 1001)
    assert bag.shape == (11, quality.WIDTH) and np.isfinite(bag).all()
    assert quality.passages(SpanHasher(), None).shape == quality.passages(SpanHasher(), " \n").shape == (1, quality.WIDTH)


def test_defined_results_of_odd_rows(spark):
    docs = [(i, ("fine words in a row " if i % 2 else "### $$$ ") * (i + 1), "k", 0.1) for i in range(60)]
    df = small_table(spark, docs, "doc_id long, text string, quality string, score double")
    labels = small_table(spark, [*((i, i % 2) for i in range(60)), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    odd = small_table(spark, [(1, None, "", 0.0), (2, "", "", 0.0), (3, "fine words in a row " * 40000, "", 0.0), (3, "x", "", 0.0), (3, "x", "", 0.0)],
                      "doc_id long, text string, quality string, score double")
    out = quality.score(odd, model)
    assert out.columns == ["doc_id", "text", "quality", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.text == "x"}) == 1
    assert quality.score(odd.limit(0), model).collect() == []
    assert quality.fit(df, labels.where("quality = 1")) is None and quality.fit(df, labels.limit(0)) is None
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5}


def test_repeated_ids_and_long_texts_keep_the_sample_bounded(spark, monkeypatch):
    docs = [(i, ("fine words in a row " if i % 2 else "### $$$ x ") * 30) for i in range(40)]
    docs += [(7, f"fine words {k} " * 20) for k in range(2000)] + [(8, "x y " * 50000)]
    labels = [(i, i % 2) for i in range(40)]
    seen = []
    real = quality.train
    monkeypatch.setattr(quality, "train", lambda bags, y: seen.append([len(b) for b in bags]) or real(bags, y))
    df, y = small_table(spark, docs, "doc_id long, text string"), small_table(spark, labels, "doc_id long, quality int")
    assert quality.fit(df, y, passages_bound=100) is not None
    assert 38 <= len(seen[0]) <= 40 and sum(seen[0]) <= 100
    quality.fit(df, y, sample=10)
    assert len(seen[1]) == 10
