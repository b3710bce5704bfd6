import public_tokenizers
import sentencepiece

import corpus_pipeline
from ledgersieve.llm import pii
from ledgersieve.llm.queries import queries

import __spark_entry__ as entry

from .test_near import own_words, plain_components, plain_leaks, runs


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, folder).collect(), docs.schema)
        assert after.columns == docs.columns
        sizes.append(after.count())
        before = after
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[3] == sizes[4]
    assert all(r.spans == "" for r in pii.detect(before).collect())
    coded = corpus_pipeline.STAGES[-1][1](spark, before, folder).collect()
    assert len(coded) == sizes[-1] and all(r.same_text for r in coded)
    assert len(corpus_pipeline.run(spark, folder).collect()) == sizes[-1]


def test_every_operator_has_one_query():
    names = [n.split("_")[0] for n in queries()]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))
    assert {*queries(), "pipeline"} <= set(entry.queries())


def test_stages_keep_what_plain_versions_keep(spark):
    """Stages after the classifier, each on its own input, row by row."""
    folder = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    schema, rows = good.schema, good.collect()

    def after(stage, rows):
        return stages[stage](spark, spark.createDataFrame(rows, schema), folder).collect()

    single = after("near_duplicates", rows)
    groups = {doc: group for doc, _, group in plain_components([(r.doc_id, r.text) for r in rows])}
    assert len(single) == len(set(groups.values())) == len({groups[r.doc_id] for r in single})
    assert set(single) <= set(rows)

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select(
        "item_id", "text").collect()]
    known = [(i, t, set(runs(own_words(t), min(5, len(own_words(t)) or 1)))) for i, t in items]
    leaky = set()
    for r in single:
        words = own_words(r.text)
        there = {w: set(runs(words, w)) for w in range(1, 6)}
        near = [(i, t) for i, t, own in known if any(own & s for s in there.values())]
        leaky |= {doc for doc, _ in plain_leaks([(r.doc_id, r.text)], near)}
    clean = after("decontamination", single)
    assert sorted(clean) == sorted(r for r in single if r.doc_id not in leaky)

    masked = after("personal_data", clean)
    spans = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(clean, schema)).collect()}
    texts = {r.doc_id: r.text for r in clean}
    assert len(masked) == len(clean)
    assert all((r.text == texts[r.doc_id]) is (not spans[r.doc_id]) for r in masked)

    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = {r.doc_id: list(r.ids) for r in after("encoding", masked)}
    assert coded == {r.doc_id: library.encode(r.text or "") for r in masked}
