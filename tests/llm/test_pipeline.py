"""Stages of the corpus pipeline against plain versions, with nulls, empty tables, repeats and clashing columns."""

import pytest
from pyspark.sql import functions as F
from test_operators import plain_spans, shingles

import corpus_pipeline
from tidemark.llm import components, pii
from tidemark.llm.common import own_columns
from tidemark.storage import staged

CLASHES = "size first rejected copy copies count n_shingles n_bytes k row row_1 hits spans doc uid id times other taken a.b text.x back`tick"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(None, "a null id with some words in it", "en", "src1", 31), (7001, None, "en", "src1", None), (7002, "", None, None, 0), (7003, " \t ", "en", None, 3), (7004, "12 34 ###", "en", "src2", 9), (7005, "word " * 20_000, "en", "src3", 100_000)]
    more += [(7006, "the same row twice with enough words to count", "en", "src4", 45)] * 2
    return staged(d.unionByName(spark.createDataFrame(more, d.schema)))


def odd(docs):
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES.split())])


@pytest.mark.parametrize("place", range(5))
def test_stages_keep_columns_and_stand_empty_tables(spark, docs, place):
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, docs.limit(0), "")
    assert out.count() == 0
    if name != "tokens":
        assert out.columns == docs.columns
        # any source: a scan, and a frame whose rows have no place in a file
        for d in (staged(odd(docs)), odd(docs).unionByName(odd(docs.limit(0)))):
            got = stage(spark, d, "")
            assert got.columns == d.columns and got.schema["size"].dataType == d.schema["size"].dataType
            assert {tuple(r) for r in got.select(*own_columns(got)[-len(CLASHES.split()) :]).distinct().collect()} == {tuple(range(len(CLASHES.split())))}


def test_language_keeps_all_clean_rows(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert {r.doc_id for r in docs.collect()} - kept == {7001, 7002, 7003, 7004}


def test_near_duplicates_keeps_one_of_each_component(spark, docs):
    rows = docs.collect()
    sets = [shingles(r.text, 5) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append((r.doc_id is None, r.doc_id or 0))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(min(g) for g in groups.values())


def test_personal_data_leaves_no_base_span(spark, docs):
    out = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, docs, "").collect()}
    assert len(out) == docs.select("doc_id").distinct().count()
    for r in docs.collect():
        new = out[r.doc_id]
        assert (new.text is None) == (r.text is None)
        if r.text is not None:
            assert new.n_chars == len(new.text)
            if not plain_spans(r.text) and "=" not in r.text and ":" not in r.text and not any(c.isdigit() for c in r.text):
                assert new.text == r.text
            assert all(f"<{pii.KINDS[k]}>" in new.text for k, *_ in plain_spans(r.text)[:1])


def test_mix_repeats_whole_rows(spark, docs):
    out = corpus_pipeline.mix(spark, docs, "").collect()
    whole = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in out} <= whole and all((r.text or "").split() for r in out)
    # one text with nearly half of all words can only be taken whole; without it the mix comes near
    short = docs.where("coalesce(doc_id, 0) <> 7005")
    words = sum(len((r.text or "").encode().split()) for r in short.collect())
    assert abs(sum(len(r.text.encode().split()) for r in corpus_pipeline.mix(spark, short, "").collect()) - 1.5 * words) < 0.02 * words


def test_whole_run_is_repeatable(spark):
    a, b = (sorted(map(str, corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) for _ in range(2))
    assert a == b and len(a) > 100


def test_components_of_plain_edges(spark):
    edges = [(1, 2), (2, 1), (2, 3), (9, 9), (None, 4), (5, None), (-7, 10), (10, 11)] + [(100, i) for i in range(101, 400)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, -7: -7, 10: -7, 11: -7, **{i: 100 for i in range(100, 400)}}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_columns(spark):
    from tidemark.llm import queries

    first = {"op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op4_neardup": "doc_id n_shingles component_id kept", "op5_lm": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6_warc": "page_id payload_bytes payload_digest record_type refers_to", "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op8_mix": "doc_id size source_size target taken", "op9_repeats": "doc_id n_bytes n_removed n_spans kept_sha256", "op10_topk": "query_id rank vec_id score", "op11_divergence": "lang source part item value rank", "op12_resample": "doc_id n_features weight score rank", "op13_near_vectors": "vec_id n_links component_id kept"}
    for name, columns in first.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.columns[: len(columns.split())] == columns.split(), name
        kinds = dict(df.dtypes)
        assert all(kinds[c] == "bigint" for c in df.columns if c.startswith("n_") or c in ("size", "source_size", "taken", "train_tokens", "score") and name != "op5_lm"), name
