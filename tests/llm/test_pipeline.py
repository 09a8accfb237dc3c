"""The pipeline against its stages in plain form."""

import corpus_pipeline
from paperweave.llm import language
from tests.llm import brute
from tests.llm.helpers import SF, documents, odd_documents


def plain(spark, docs, sf_dir):
    """Ids that each of the stages before packing leaves, with their texts."""
    model = language.fit(docs.where(~language.held_out()))
    known = {r.doc_id for r in language.predict(docs, model).where("lang_pred <> 'und' AND share >= 0.3").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in known}
    texts = {i: texts[i] for i, (_, c) in brute.near_duplicates(list(texts.items())).items() if i == c}
    out = {}
    words = {i: brute.WORD.findall(t) for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][p:p + 13]), i)
    for i, w in words.items():
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p:p + 13])] < i for q in range(p, p + 13)}
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else texts[i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    return {i: t for i, t in out.items() if not brute.contamination([(i, t)], items)[i][-1]}


def test_pipeline_equals_plain_stages(spark):
    docs = documents(spark)
    wanted = plain(spark, docs, SF)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == wanted
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(wanted)


def test_stages_stand_odd_rows(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).count()
        assert stage(spark, docs.limit(0), SF).count() == 0
