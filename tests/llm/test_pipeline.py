"""The whole pipeline against a plain version of every stage."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from callboard.llm import byte_bpe

from test_decontamination import brute as brute_benchmark
from test_line_dedup import brute_texts
from test_quality_ledger import brute as brute_quality
from test_simhash import brute_components, brute_print

FOLDER = "/root/testdata/sf0.001"


def kept_lines(documents):
    """Texts after line dedup; those of which lines were taken and no word is left go."""
    return {doc: left for doc, _, removed, left in brute_texts(documents) if not (removed and not left.split())}


def plain(spark):
    documents = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, (r.text or "").encode()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def passes(raw):
        n, chars, symbols, lines, dup, repeated = brute_quality(raw)
        return not (
            n < 10
            or 100 * repeated > 20 * n
            or 100 * symbols > 10 * n
            or (dup > 2 and 100 * dup > 30 * lines)
            or not 2 * n <= chars <= 20 * n
        )

    first = [(doc, raw) for doc, raw in documents if passes(raw)]
    stages = corpus_pipeline.STAGES
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert sorted(r.doc_id for r in stages[0][1](spark, docs, FOLDER).collect()) == sorted(doc for doc, _ in first)

    quality = docs.where(docs.doc_id.isin([doc for doc, _ in first]))
    lines = kept_lines(first)
    assert {r.doc_id: r.text.encode() for r in stages[1][1](spark, quality, FOLDER).collect()} == lines
    prints = [(doc, brute_print(raw)) for doc, raw in sorted(lines.items())]
    groups = brute_components(prints)
    unique = [(doc, lines[doc]) for doc, _ in prints if groups[doc] == doc]
    hit = {row[0] for row in brute_benchmark(unique, items) if row[5]}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.read_vocabulary()), special_tokens={}
    )
    out = []
    for doc, raw in unique:
        if doc not in hit:
            ids = np.array(library.encode_ordinary(raw.decode()), "<u4")
            out.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    return out


def test_run_against_plain_version(spark):
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = plain(spark)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert 0 < len(expected) < spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", "1 AS simhash", "2 AS spans", "3 AS failed")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_columns_that_operators_make_stay_as_they_were(spark):
    made = ["'s' AS failed", "2.5 AS n_words", "array('x') AS spans", "'y' AS n_lines", "'z' AS simhash", "3 AS rest", "'q' AS items"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", *made)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.dtypes == docs.dtypes
        rows = out.select("failed", "n_words", "spans", "n_lines", "simhash", "rest", "items").distinct().collect()
        assert [tuple(map(str, r)) for r in rows] == [("s", "2.5", "['x']", "y", "z", "3", "q")]


def test_stages_of_id_and_text_alone(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        whole = sorted((r.doc_id, r.text) for r in stage(spark, docs, FOLDER).collect())
        assert sorted(map(tuple, stage(spark, docs.select("doc_id", "text"), FOLDER).collect())) == whole


def test_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []
