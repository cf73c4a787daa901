"""The pipeline's stages, each against what its input asks for."""

import random
import re

import corpus_pipeline
from conftest import DATA
from tessera.llm import neardup, secrets
from test_llm import brute_classes, prose, words5

SF = f"{DATA}/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = before, docs
        if name != "packing":
            assert docs.columns == columns
    rows = lambda n: {r["doc_id"]: r["text"] for r in kept[n][1].collect()}
    assert rows("language") == kept["language"][0]  # all are clean
    classes = brute_classes(kept["near_duplicates"][0])
    assert set(rows("near_duplicates")) == set(classes.values())
    items = [words5(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, t in kept["decontamination"][0].items() if not any(len(s & words5(t)) >= 0.8 * len(s) for s in items)}
    assert set(rows("decontamination")) == clean and len(clean) < len(kept["decontamination"][0])
    after = rows("secrets")
    assert set(after) == set(kept["secrets"][0])
    for i, t in kept["secrets"][0].items():
        assert not secrets.scan_text(after[i])[0] and (after[i] == t or secrets.scan_text(t)[1])
    assert all(r["n_chars"] == len(r["text"]) for r in kept["secrets"][1].collect() if "[SECRET]" in r["text"])
    packed = kept["packing"][1]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns and re.match("doc_id", out.columns[0])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]


def test_edges(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "Token = abcdefgh and this text has some words", None, "s", None), (3, "Token = abcdefgh and this text has some words", "en", None, 1), (3, "Token = abcdefgh and this text has some words", "en", None, 1), (None, "a text without an id that stays in", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    assert set(got) == {2, None} and got[2][0].startswith("[SECRET] and") and got[2][1] == "en"


def test_texts_under_one_id_are_documents_of_their_own(spark):
    rng = random.Random(2)
    texts = [prose(rng, 60) for _ in range(12)]
    near = " ".join(["edited", *texts[3].split()[1:]])
    rows = [(7, t, "en", "s", len(t)) for t in texts] + [(7, texts[0], "de", "s", 1), (7, near, "en", "s", 2), (3, texts[1], "en", "s", 3), (9, texts[2], "en", "s", 4), (11, "quite another text", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(r[0] for r in out) == [3] + [7] * 11 + [11]
    assert {r[1] for r in out} - {near} - {texts[3]} == {*texts[:3], *texts[4:], "quite another text"} and sum(r[1] in (near, texts[3]) for r in out) == 1
    assert [r[2] for r in out if r[1] == texts[0]] == ["de"]  # of rows alike in id and text the least
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect())
    assert got == sorted([(3, 3), (7, 3), *[(7, 7)] * 13, (9, 7), (11, 11)])


def test_long_texts_extra_columns_and_clashing_names(spark, tmp_path):
    rng = random.Random(8)
    long = prose(rng, 40_000)
    rows = [(1, long, "en", "s", len(long), "a", 1, 2), (2, long, "en", "s", len(long), "b", 3, 4), (3, "", "en", "s", 0, "c", 5, 6), (4, prose(rng, 300), None, "s", 7, "d", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found string, marked_id int, clean int")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {tuple(r)[5:] for r in docs.collect()} == {("a", 1, 2), ("d", 7, 8)}
