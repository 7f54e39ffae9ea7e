"""Extra columns that bear the operators' own names pass through every stage."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language_id, mixing, packing, quality, secrets, token_counts

OWN = ("keep", "quality_score", "secret_key", "secret_values", "steps", "rate", "weight", "n", "mix_source", "MIX_STEPS", "mix_salt", "gone", "same_text", "key", "value", "label", "held_out", "score", "length", "id", "salt", "mix_copy", "hash", "neighbours", "codes", "ids")
ROWS = [
    (1, "set password=b7db7aa4a5fcc78305 now and the rest of a short text follows here.", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (3, "", "en", "a", 0),
    (4, "The same words stand here twice, and nobody minds that they do.", "en", "b", 1), (5, "The same words stand here twice, and nobody minds that they do.", "en", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in OWN})


def extras(df):
    return {tuple(r) for r in df.select(*OWN).collect()}


def test_keep_good(docs):
    scorer = quality.train(docs)
    kept = quality.keep_good(docs, scorer)
    assert kept.columns == docs.columns and extras(kept) <= {(7,) * len(OWN)}
    flagged = {(r.doc_id, r.keep) for r in quality.score(docs, scorer).collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, keep in flagged if keep}


def test_keep_one(docs):
    kept = jaccard.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]


def test_redact(spark, docs):
    out = secrets.redact(docs, secrets.train(secrets.rule_findings(spark, 1400), secrets.learn_words(docs)))
    assert out.columns == docs.columns and out.count() == docs.count() and extras(out) == {(7,) * len(OWN)}
    assert "b7db7aa4a5fcc78305" not in out.filter("doc_id = 1").first().text


@pytest.mark.parametrize("most", [0, 100])
def test_mix(docs, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_SOURCES", most)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_copy_", "mix_key"] and extras(out) <= {(7,) * len(OWN)}


def test_reports(docs):
    assert language_id.identify(docs, language_id.train(docs)).count() == docs.count()
    assert token_counts.token_counts(docs).count() == docs.count()
    assert packing.pack(docs).select("doc_id").distinct().count() == 5
