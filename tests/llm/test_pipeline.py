"""Stages of the corpus pipeline on literal documents."""

import corpus_pipeline


def test_near_dedup_goes_by_fingerprints_and_by_shingle_sets(spark):
    many = "so " * 240  # one shingle outweighs all others
    base = " ".join(f"w{i}" for i in range(120))
    texts = {
        1: many + "one ends like this here", 2: many + "another one ends like that",  # equal fingerprints, sets of likeness under 0.8
        3: base, 4: base + " with a longer end than the other",  # alike by shingle sets
        5: " ".join(f"x{i}" for i in range(90)),
    }
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]
