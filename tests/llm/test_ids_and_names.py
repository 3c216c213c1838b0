"""Ids with several texts, lists that all rows share, and column names in another case."""

import time

import pytest

pytest.importorskip("creditspark.llm")

from pyspark.sql import functions as F

from creditspark.llm import jaccard_join, personal_data, quality_fertility

A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and some more words follow here"
B = " ".join(f"other{i}" for i in range(40))


def _classes(spark, rows):
    got = jaccard_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return sorted((r.doc_id, r.component_id) for r in got)


def test_each_text_of_an_id_keeps_its_links(spark):
    assert _classes(spark, [(1, A), (5, A), (5, B + " changed"), (9, B)]) == [(1, 1), (5, 1), (5, 1), (9, 1)]
    assert _classes(spark, [(5, A), (5, B), (6, B), (6, A), (7, A), (2, B + " x"), (3, "alone in the world of words here")]) == [
        (2, 2), (3, 3), (5, 2), (5, 2), (6, 2), (6, 2), (7, 2)]
    assert _classes(spark, [(4, A), (4, "short"), (4, None), (8, ""), (8, "of its own kind only")]) == [(4, 4)] * 3 + [(8, 8)] * 2
    big = 1 << 62
    assert _classes(spark, [(big + 5, A), (big + 5, B), (big + 9, B + " x"), (big + 1, A)]) == [
        (big + 1, big + 1), (big + 5, big + 1), (big + 5, big + 1), (big + 9, big + 1)]


def test_form_letters_are_not_paired(spark):
    """One list holds all rows, and no two of them link."""
    shared = " ".join(f"s{i}" for i in range(20))
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared), *[F.concat(F.lit(f" u{i}x"), "id") for i in range(5)]).alias("text"))
    began = time.time()
    got = jaccard_join.near_duplicate_classes(rows)
    assert got.where("component_id = doc_id AND n_shingles = 21").count() == 40_000
    assert time.time() - began < 120


def test_columns_by_name(spark):
    rows = spark.createDataFrame([(1, "mail a.b@example.org or call +49 30 1234567 now", "note")], "doc_id long, TEXT string, note string")
    assert personal_data.find_personal_data(rows).select(F.size("pii_spans")).first()[0] == 2
    assert quality_fertility.measure_quality(rows).select("n_words").first()[0] == 8
