"""The pipeline's stages take effect, and its queries run over whole tables."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(1)
    sentence = lambda n: " ".join(f"word{rng.randrange(4000)}" for _ in range(n))
    bench = [(i, sentence(30)) for i in range(5)]
    texts = [sentence(120) for _ in range(300)]
    texts[10] = texts[11] = texts[12]
    texts[20] += " " + bench[2][1]
    texts[30] += " token = 'abcdef0123456789abcdef'"
    bad = range(200, 260)
    for i in bad:
        texts[i] = " | ".join(texts[i].split())
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    labels = [(i, 0 if i in bad else 1, 0) for i in range(300) if i not in (201, 202)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_each_stage_takes_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    ids = [set(range(300))]
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, corpus)
        assert kept.columns == COLUMNS, name
        path = f"{corpus}/{name}"
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    quality, dedup, clean, redacted = ids[1:]
    assert not quality & set(range(200, 260)) and len(quality) >= 235
    assert quality - dedup == {11, 12} and dedup - clean == {20} and redacted == clean
    text = kept.filter("doc_id = 30").first()
    assert text.text.endswith("[SECRET]'") and text.n_chars == len(text.text)
    packed = pipeline.run(spark, corpus).select("doc_id").distinct().count()
    assert packed == len(redacted)


def test_dedup_keeps_a_row_of_each_class_whatever_the_ids(spark, corpus):
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"word{rng.randrange(4000)}" for _ in range(60)) for _ in range(4))
    rows = [(i, t, "en", "s", len(t)) for i, t in ((None, a), (None, b), (None, b), (3, c), (3, d), (4, d), (2, d))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_duplicates(spark, docs, corpus)
    assert kept.columns == COLUMNS and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, a), (None, b), (3, c), (2, d)], key=str)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, secrets string, row_id string, id string, others string, `a.b` string, c0 string"


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, shared ids; columns named like operators' own."""
    rng = random.Random(3)
    a, b = (" ".join(f"word{rng.randrange(4000)}" for _ in range(90)) for _ in range(2))
    more = ("own score", "own secrets", "own row", "own id", "own others", "own dot", "own place")
    rows = [(7, a), (7, a), (7, b), (None, b + " x"), (None, None), (None, None), (8, None), (8, ""), (9, "!!"), (10, "word1 " * 30_000), (11, "token = 'abcdef0123456789abcdef'")]
    return [(i, t, None, None, None, *more) for i, t in rows] + [(None,) * 12]


def show(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_stages_over_odd_rows(spark, corpus):
    docs = spark.createDataFrame(odd_rows(), ODD)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r.score in ("own score", None) and r.secrets in ("own secrets", None) and r.id in ("own id", None) and r["a.b"] in ("own dot", None) and r.c0 in ("own place", None) for r in rows), name
        if name == "minhash_near_dedup":
            # The two long texts are near each other only in their own class; of equal rows one stays.
            assert sorted(((r.doc_id, (r.text or "")[:5]) for r in rows), key=str) == sorted([(7, rows_of(docs, 7)[0]), (7, rows_of(docs, 7)[1]), (None, ""), (8, ""), (8, ""), (9, "!!"), (10, "word1"), (11, "token")], key=str)
        if name == "benchmark_decontamination":
            assert show(rows) == show(docs.collect())
        if name == "secret_scans":
            assert len(rows) == docs.count() and [r.text for r in rows if r.doc_id == 11] == ["[SECRET]'"] and [r.n_chars for r in rows if r.doc_id == 11] == [9]
            assert all(r.n_chars is None for r in rows if r.doc_id != 11)
    pieces = pipeline.pack_sequences(spark, docs, corpus).collect()
    assert len({r.sequence_id for r in pieces}) >= 1 and sum(r.start == 0 for r in pieces) == docs.count()


def rows_of(docs, ident):
    """The first letters of the different texts of an id."""
    return [t[:5] for t in dict.fromkeys(r.text for r in docs.collect() if r.doc_id == ident)]


def test_stages_over_empty_tables(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    none = docs.limit(0)
    for folder in (corpus, str(tmp_path)):
        for name, stage in pipeline.STAGES:
            assert stage(spark, none, folder).count() == 0, name
    # Without labels and benchmark nothing is rejected.
    few = docs.filter("doc_id < 20")
    assert pipeline.keep_quality(spark, few, str(tmp_path)).count() == 20 and pipeline.drop_contaminated(spark, few, str(tmp_path)).count() == 20
    one = docs.filter("doc_id < 20")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/one/labels.parquet")
    assert pipeline.keep_quality(spark, one, f"{tmp_path}/one").count() == 20
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_contaminated_rows_go_and_their_namesakes_stay(spark, corpus):
    bench = spark.read.parquet(f"{corpus}/benchmark.parquet").first().text
    rng = random.Random(4)
    clean = " ".join(f"word{rng.randrange(4000)}" for _ in range(80))
    rows = [(i, t, "en", "s", len(t)) for i, t in ((1, f"{clean} {bench} {clean}"), (1, clean), (None, bench), (None, clean), (None, clean))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").union(spark.read.parquet(f"{corpus}/documents.parquet").filter("doc_id > 100"))
    left = [(r.doc_id, r.text) for r in pipeline.drop_contaminated(spark, docs, corpus).filter("coalesce(doc_id, 1) <= 1").collect()]
    assert sorted(left, key=str) == sorted([(1, clean), (None, clean), (None, clean)], key=str)
