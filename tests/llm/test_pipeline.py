import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from emberwatch.llm.simhash import fingerprint, shingle_hashes
from emberwatch.llm.toxicity import TOXIC, toxicity

from .test_contamination import brute as brute_contamination
from .test_lines import brute as brute_lines
from .test_simhash import roots

FOLDER = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, written and read between them."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def test_columns_of_documents_stay(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes), name


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    scores = toxicity(before, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    assert set(texts(after)) == {r.doc_id for r in scores if r.score < TOXIC}


def test_shared_lines_go(stages):
    before, after = stages["line dedup"]
    want = {i: text for i, text, _, _ in brute_lines(list(texts(before).items()))}
    assert texts(after) == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_of_each_group_stays(stages):
    before, after = stages["near dedup"]
    rows = sorted(texts(before).items())
    label = roots([fingerprint(shingle_hashes(text)) % 2**64 for _, text in rows])
    assert texts(after) == dict(row for i, row in enumerate(rows) if label[i] == i)


def test_documents_with_benchmark_texts_go(spark, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute_contamination(list(texts(before).items()), items) if r[4]}
    assert texts(after) == {i: t for i, t in texts(before).items() if i not in dirty}


def test_ids_are_the_librarys_and_run_gives_the_last_stage(spark, stages):
    before, after = stages["encoding"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in texts(before).items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        told = tokenizer.decode(ids, skip_special_tokens=False).encode()
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i] = (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(told).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in after.collect()} == want
    assert sorted(corpus_pipeline.run(spark, FOLDER).collect()) == sorted(after.collect())


def test_a_users_own_counts_stay(spark):
    rows = [(i, "a line that is shared by all of them\nown %d" % i, "mine", 7) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_dropped int")
    kept = corpus_pipeline.line_dedup(spark, docs, FOLDER)
    assert kept.dtypes == docs.dtypes
    assert {(r.n_lines, r.n_dropped) for r in kept.collect()} == {("mine", 7)}


@pytest.mark.parametrize("name", ["toxicity", "line dedup", "near dedup", "decontamination"])
def test_filtering_stages_take_odd_and_empty_tables(spark, odd, nothing, name):
    """Nulls, empty and long texts, repeated rows and columns in the way: the same columns come out."""
    stage = dict(corpus_pipeline.STAGES)[name]
    kept = stage(spark, odd, FOLDER)
    assert kept.dtypes == odd.dtypes
    assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in odd.collect()}
    gone = stage(spark, nothing, FOLDER)
    assert gone.dtypes == odd.dtypes and gone.count() == 0


def test_encoding_takes_odd_and_empty_tables(spark, odd, nothing):
    assert corpus_pipeline.encoding(spark, odd, FOLDER).count() == odd.count()
    assert corpus_pipeline.encoding(spark, nothing, FOLDER).count() == 0
