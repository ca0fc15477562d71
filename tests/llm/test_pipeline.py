from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loamgrid.llm import langid, stages, toxicity
from tests.llm.test_bpe_packing import PATH, check_pieces, library_ids
from tests.llm.test_dedup import lower
from tests.llm.test_similar import slow_similar

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    """What each stage gives, from rows of documents with edge cases among them."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    extra = spark.createDataFrame([(50_001, None, "en", None, 0), (50_002, "", None, "s", 0), (50_003, "12 34 !!", "de", "s", 8)], docs.schema)
    docs = docs.union(extra).union(docs.where("doc_id < 3")).repartition(4).cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], MEDIUM).cache())
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns_and_subsets(outputs):
    for before, after in zip(outputs[:-2], outputs[1:-1]):
        assert after.columns == before.columns
        assert set(rows(after)) <= set(rows(before)) and after.count() > 0.5 * before.count()


def test_language_stage(outputs):
    kept = {r.doc_id for r in outputs[1].collect()}
    model = langid.fit(outputs[0])
    for r in outputs[0].collect():
        lang, score = model.predict([r.text or ""])[0]
        assert (r.doc_id in kept) == (lang != "und" and score >= stages.MAIN_LANGUAGE)
    assert not kept & {50_001, 50_002, 50_003}


def test_toxicity_stage(spark, outputs):
    kept = {r.doc_id for r in outputs[2].collect()}
    model = toxicity.fit(outputs[1], spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    gone = [r for r in outputs[1].collect() if r.doc_id not in kept]
    assert gone and all(model.score(r.text) >= 0.5 for r in gone)
    assert all(model.score(r.text) < 0.5 for r in outputs[2].collect())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert not any(labels.get(r.doc_id) == 0 for r in gone)


def test_exact_stage(outputs):
    groups = defaultdict(list)
    for r in outputs[2].collect():
        groups[lower(r.text)].append(r.doc_id)
    assert sorted(r.doc_id for r in outputs[3].collect()) == sorted(max(ids) for ids in groups.values())


def test_near_stage(outputs):
    """One document of each group of five-word shingle sets linked at a Jaccard similarity of 0.8, by all pairs."""
    groups = slow_similar([(r.doc_id, r.text) for r in outputs[3].collect()])
    assert sorted(r.doc_id for r in outputs[4].collect()) == sorted({c for _, c in groups})


def test_mixed_languages_go(spark, outputs):
    """A text made of three languages by equal parts has no main language; each part alone has."""
    pick = {lang: outputs[0].where(f"lang = '{lang}' AND length(text) > 600").orderBy("doc_id").first().text[:400] for lang in ("de", "fr", "en")}
    docs = spark.createDataFrame([(1, " ".join(pick.values()), None, None, 0), *((i, t, None, None, 0) for i, t in enumerate(pick.values(), 2))], outputs[0].schema)
    found = langid.identify(docs, langid.fit(outputs[0]), ["doc_id"]).where(f"lang_pred <> 'und' AND score >= {stages.MAIN_LANGUAGE}")
    assert sorted(r.doc_id for r in found.collect()) == [2, 3, 4]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables_and_clashing_columns(spark, outputs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, outputs[0].limit(0), MEDIUM).count() == 0
    clash = outputs[0].limit(300)
    for c in ("score", "predicted", "_keep", "keys", "first", "ids", "held_out", "_hash", "node"):
        clash = clash.withColumn(c, outputs[0].doc_id)
    assert stage(spark, clash, MEDIUM).count() > 0


def test_packing_stage(outputs):
    library = Tokenizer.from_file(PATH)
    ids = {r.doc_id: library_ids(library, r.text) + [1] for r in outputs[4].collect()}
    check_pieces([tuple(r) for r in outputs[5].collect()], ids, 2048, outputs[4].sparkSession.sparkContext.defaultParallelism)


def test_run_writes_between_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100
