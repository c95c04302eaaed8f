"""Empty tables and texts of a megabyte, for the operators whose own tests leave them out."""

import sentencepiece
import public_tokenizers
import pytest

from driftwell.llm import decontamination, license_scan, piece_bpe, secret_scan, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "d")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "d")
    words = "all rights reserved under cc by " + "fine words " * 90_000 + " password=abcdefghijkl0123"
    spark.createDataFrame([(1, words, "en", "s", len(words)), (2, "x" * 1_000_000, "en", "s", 1_000_000), (3, None, None, None, None)], SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_empty_tables(spark, empty):
    benchmark = spark.createDataFrame([("b", "one two three four five six seven eight nine ten")], "item_id string, text string")
    assert piece_bpe.round_trip_digests(empty).collect() == [] and license_scan.scan_licenses(empty).collect() == [] and secret_scan.find_secrets(empty).collect() == []
    assert decontamination.cut_contaminated(empty, benchmark).collect() == [] and decontamination.drop_contaminated(empty, benchmark).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty, toxicity.train(empty, labels)).collect() == []


def test_long_texts(long):
    texts = {r.doc_id: r.text for r in long.collect()}
    licences = {r["id"]: r for r in license_scan.scan_licenses(long).collect()}
    assert licences[1]["n_words"] == len(texts[1].split()) + 1 and licences[1]["n_base"] == 2 and licences[3]["n_words"] == 0
    secrets = {r["doc_id"]: r for r in secret_scan.find_secrets(long).collect()}
    assert secrets[1]["n_assign"] == 1 and secrets[3]["n_assign"] == 0
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {r["doc_id"]: r for r in piece_bpe.encode_texts(long).collect()}
    assert all(list(pieces[k]["ids"]) == model.encode(texts[k] or "") for k in (1, 2, 3))
