import zlib
from collections import Counter

import numpy as np
import pytest

from callboard.llm import language_id

from frames import empty_documents, odd_documents


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, documents):
    rows = language_id.identified(documents).join(documents, "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang is not None and len(r.text) >= 100]
    assert len(held) > 150
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id").select("doc_id", language_id.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def test_nothing_but_training_text_and_lang_matter(spark, documents):
    base = {r.doc_id: r for r in language_id.identified(documents).collect()}
    changed = documents.selectExpr(
        "doc_id", "text", "CASE WHEN pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 THEN 'xx' ELSE lang END AS lang", "'s' AS source", "n_chars"
    )
    assert {r.doc_id: r for r in language_id.identified(changed).collect()} == base


def test_texts_without_letters(spark):
    model = language_id.learn(odd_documents(spark))
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 .,!"), (4, "word and word")], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(rows, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[4][0] in ("en", "fr", "de")


def test_nothing_learned_and_empty_table(spark):
    rows = odd_documents(spark).selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r.lang_pred for r in language_id.identified(rows).collect()} == {"und"}
    assert language_id.identified(empty_documents(spark)).collect() == []


def test_clashing_columns_and_many_languages(spark):
    rows = [(i, f"{chr(97 + i % 20) * 3}{chr(97 + i // 20)}qx " * 20, f"l{i % 20:02d}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS Score", "2 AS lang_pred")
    model = language_id.learn(df)
    assert model.bits.shape == (language_id.SLOTS, 3)
    found = language_id.predict(df, model).collect()
    assert sum(r.lang == r.lang_pred for r in found) > 390


def test_filter_returns_all_languages_of_a_gram(spark):
    rows = [(1, "shared only " * 9, "aa"), (2, "shared other " * 9, "bb")]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    hashes, _, _ = language_id.grams([b"shared"])
    for places in zip(*language_id.slots(hashes), strict=True):
        bits = 255
        for place in places:
            bits &= model.bits[place, 0]
        assert bits & 3 == 3


@pytest.mark.parametrize("least, share", [(language_id.LEAST, language_id.SHARE), (0.0, 0.0)])
def test_filter_against_exact_sets(spark, documents, monkeypatch, least, share):
    """Every language that contains a gram by plain counting is in the filter's answer; others are there by chance alone.

    With both bounds at 0 a language contains every gram it ever has; held-out texts are told apart as well.
    """
    monkeypatch.setattr(language_id, "LEAST", least)
    monkeypatch.setattr(language_id, "SHARE", share)
    labelled = documents.where("lang IS NOT NULL").where(~language_id.held_out())
    model = language_id.learn(labelled)
    counts = {}
    for row in labelled.select("lang", "text").collect():
        found, n = np.unique(language_id.grams([(row.text or "").encode()])[0], return_counts=True)
        own = counts.setdefault(row.lang, Counter())
        own.update(dict(zip(found.tolist(), n.tolist(), strict=True)))
    rates = {lang: {g: n / sum(own.values()) for g, n in own.items()} for lang, own in counts.items()}
    every = sorted({g for own in rates.values() for g in own})
    best = {g: max(own.get(g, 0) for own in rates.values()) for g in every}
    answers = np.full(len(every), 255, np.uint8)
    for places in language_id.slots(np.array(every, np.uint64)):
        answers &= model.bits[places, 0]
    wrong = asked = 0
    for bit, lang in enumerate(model.languages):
        own = rates[lang]
        exact = np.array([g in own and own[g] >= least and own[g] >= share * best[g] for g in every])
        said = answers >> bit & 1 == 1
        assert not (exact & ~said).any()
        wrong += int((said & ~exact).sum())
        asked += int((~exact).sum())
    assert wrong <= 0.01 * asked
    held = documents.where("lang IS NOT NULL AND n_chars >= 100").where(language_id.held_out())
    rows = language_id.predict(held, model).collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
