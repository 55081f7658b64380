import random

import corpus_pipeline
from fieldlark.llm import secrets
from fieldlark.session import small_table
from tests.llm.test_contamination import brute as brute_contamination
from tests.llm.test_near_dups import brute as brute_near
from tests.llm.test_words import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    draw = random.Random(9)
    rows = []
    for i in range(40):
        w = draw.choices([f"word{chr(97 + k % 26)}{k}" for k in range(200)], k=60)
        rows.append((i, " ".join(w)))
    rows += [(50, rows[1][1]), (51, rows[1][1].replace(" ", ", ", 3)), (52, rows[2][1] + " extra"), (53, None), (54, ""), (55, "12 34 !"),
             (56, rows[3][1] + " password=abcdefgh"), (57, "AKIA" + "B" * 16 + " lonely"), (58, "the test item says these ten words in a row now today"),
             (59, "short one"), (59, "short one")]
    return [(i, t, None if i == 5 else "en", "s", len(t or "")) for i, t in rows]


def test_each_stage_against_brute_force(spark, tmp_path):
    rows = documents()
    small_table(spark, rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "test item says these ten words in a row now"), (2, None)]
    small_table(spark, items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"]

    spoken = stages["language_id"](spark, docs, folder)
    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert spoken.columns == docs.columns and sorted(map(tuple, spoken.collect()), key=repr) == sorted(want, key=repr)

    single = stages["near_duplicates"](spark, spoken, folder)
    classes = {c[1] for c in brute_near([(k, r[1]) for k, r in enumerate(want)])}
    kept = sorted(map(tuple, single.collect()), key=repr)
    assert single.columns == docs.columns and len(kept) == len(classes) and set(kept) <= set(want)

    clean = stages["decontamination"](spark, single, folder)
    hits = brute_contamination([(r[0], r[1]) for r in kept], [(str(i), t) for i, t in items])
    want = [r for r in kept if r[0] in {h[0] for h in hits if h[2] == 0}]
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect()), key=repr) == want and len(want) == len(kept) - 1

    masked = stages["secret_scan"](spark, clean, folder)
    got = sorted(map(tuple, masked.collect()), key=repr)
    assert masked.columns == docs.columns and [r[0] for r in got] == [r[0] for r in want]
    for before, after in zip(want, got):
        assert after[1] == secrets.masked(before[1]) and after[4] == len(after[1])
    assert sum(a != b for a, b in zip(want, got)) >= 1

    packed = stages["best_fit_packing"](spark, masked, folder).collect()
    assert sorted(r.doc_id for r in packed) == [r[0] for r in sorted(got, key=lambda r: r[0])]
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.length, r.ids_crc32) for r in whole) == sorted((r.length, r.ids_crc32) for r in packed)


def test_empty_tables(spark, tmp_path):
    small_table(spark, documents(), SCHEMA).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    small_table(spark, [(1, "a")], "item_id long, text string").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_words_helper():
    assert words("A-b c") == ["a", "b", "c"]
