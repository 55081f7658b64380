import base64
import itertools
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark.llm import langid
from fieldlark.llm.queries import QUERIES, fold
from fieldlark.session import small_table

SCHEMA = "doc_id long, text string, lang string, score string"
SAMPLES = {"aa": "lorem ipsum dolor sit amet ", "bb": "der die das und nicht ", "cc": "los las una pero como ", "dd": "что это как все "}


def corpus(n=40):
    return [(i, text * (1 + i % 3), lang, "x") for i, (lang, text) in enumerate(list(SAMPLES.items()) * n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 12, 30])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    if n > 2:
        least = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        assert least >= 2 if n < 7 else least >= code.shape[1] // 5
        assert (np.abs(code.sum(0, dtype=int)) < n).all()
        assert 1 < len(np.unique(code, axis=0)) == n


def test_one_wrong_classifier_is_outvoted():
    code = langid.codewords(4)
    zero = np.zeros(code.shape[1])
    for i, b in itertools.product(range(4), range(code.shape[1])):
        margins = 3.0 * code[i]
        margins[b] = -margins[b]
        model = langid.Model(list("abcd"), code, np.zeros((1, code.shape[1])), zero, margins, zero + 1)
        best, score, ambiguous = model.predict(np.ones((1, 1)))
        assert best[0] == i and 0.5 < score[0] <= 1


def test_between_two_languages_is_ambiguous():
    code = langid.codewords(4)
    zero = np.zeros(code.shape[1])
    model = langid.Model(list("abcd"), code, np.zeros((1, code.shape[1])), zero, (code[0] + code[1]) * 3.0, zero + 1)
    _, score, ambiguous = model.predict(np.ones((1, 1)))
    assert ambiguous[0] and score[0] == pytest.approx(0.5, abs=0.01)


def test_defined_results_of_odd_rows(spark):
    model = langid.fit(small_table(spark, [*corpus(), (900, "12 3", "aa", ""), (901, None, "bb", ""), (902, "x y", None, "")], SCHEMA))
    assert model.languages == sorted(SAMPLES)
    odd = [(1, None, "aa", ""), (2, "", None, ""), (3, " 12 ½ !", "cc", ""), (4, SAMPLES["bb"], None, ""), (4, SAMPLES["bb"], None, ""),
           (5, SAMPLES["dd"] * 20000, "aa", ""), (None, SAMPLES["cc"].upper(), "", "")]
    df = small_table(spark, odd, SCHEMA)
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]
    got = sorted((r.doc_id or 0, r.lang_pred) for r in out.collect())
    assert got == [(0, "cc"), (1, "und"), (2, "und"), (3, "und"), (4, "bb"), (4, "bb"), (5, "dd")]
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert langid.identify(df.limit(0), model).collect() == []


def test_without_anything_to_learn(spark):
    nothing = small_table(spark, [(1, "text", None, "")], SCHEMA)
    assert langid.fit(nothing) is None and langid.fit(nothing.limit(0)) is None
    assert [r.lang_pred for r in langid.identify(nothing, None).collect()] == ["und"]
    one = langid.fit(small_table(spark, [(1, "text", "zz", "")], SCHEMA))
    assert [r.lang_pred for r in langid.identify(nothing, one).collect()] == ["zz"]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "n_chars")
    out = QUERIES["op5_language_id"](spark, folder).join(docs, "doc_id")
    assert out.count() == docs.count()
    assert out.where(F.col("held_out") != (fold(5) == 0)).isEmpty()
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] > 0.98 and held[1] > 100


def test_copies_neither_hide_a_language_nor_fill_the_sample(spark, monkeypatch):
    few = [(i, f"{SAMPLES['aa']} {i % 3}", "aa", "") for i in range(600)]
    many = [(i, f"{SAMPLES['bb']} {'xyz'[i % 3] * (i // 3)}", "bb", "") for i in range(60)]
    hot = [(i, SAMPLES["cc"], "cc", "") for i in range(300)] + [(i, f"{SAMPLES['cc']} {'pq'[i % 2] * i}", "cc", "") for i in range(300, 330)]
    drawn = []
    cut = langid.cut_lineage
    monkeypatch.setattr(langid, "cut_lineage", lambda df, label: drawn.append(cut(df, label)) or drawn[-1])
    model = langid.fit(small_table(spark, few + many + hot, SCHEMA), sample=5)
    assert model.languages == ["aa", "bb", "cc"]
    rows = [tuple(r) for r in drawn[-1].collect()]
    assert len(rows) == len(set(rows)) == 3 + 5 + 5


def test_letters_without_any_evidence_fit_no_language(spark):
    import corpus_pipeline

    junk = [(-1 - i, f"{w} " * 9, None, "x") for i, w in enumerate(["日本語", "日本語日本語"])]
    docs = small_table(spark, [*corpus(), *junk, (-9, "12 !", None, "x")], SCHEMA)
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [r[0] for r in corpus()]


def test_a_corpus_without_labels_stays(spark):
    import corpus_pipeline

    docs = small_table(spark, [(1, "some text", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]


PROSE = {
    "russian": "В начале июля, в чрезвычайно жаркое время, под вечер, один молодой человек вышел из своей каморки. " * 2,
    "chinese": "道可道非常道名可名非常名无名天地之始有名万物之母故常无欲以观其妙常有欲以观其徼",
    "finnish": "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan, "
               "lajivirttä laulamahan. Sanat suussani sulavat, puhe'et putoelevat, kielelleni kerkiävät.",
    "one letter": "x"}


def junk():
    draw = random.Random(1)
    words = lambda letters: " ".join("".join(draw.choices(letters, k=6)) for _ in range(150))
    return {"letters": words(string.ascii_lowercase), "base64": base64.b64encode(draw.randbytes(600)).decode(),
            "consonants": words("bcdfghjklmnpqrstvwxz"), "hex": draw.randbytes(500).hex(), "repeated": "a" * 500}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_junk_goes_and_languages_without_labels_stay_at_every_scale(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    model = langid.fit(docs.where(fold(5) != 0))
    mixed = small_table(spark, [(k, t) for k, t in {**PROSE, **junk()}.items()], "doc_id string, text string")
    assert {r.doc_id for r in langid.with_language(mixed, model).collect()} == set(PROSE)
    with_letter = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert langid.with_language(docs, model).count() == with_letter
