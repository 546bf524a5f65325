"""Shuffle files of the toxicity models go with the step that made them."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labelweave.llm import steps, toxicity
from tests.llm.helpers import documents
from tests.llm.test_kneser_ney_words import LABELS, taught_texts


def shuffle_files(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in Path(d).rglob("shuffle_*.data")}


@pytest.mark.parametrize("own", [None, "false", "true"])
def test_a_written_table_leaves_no_shuffle_files(spark, own):
    if own:
        spark.conf.set(steps.FREE_SHUFFLES, own)
    try:
        before = shuffle_files(spark)
        df = spark.range(20_000).groupBy((F.col("id") % 7000).alias("k")).count()
        found = steps.saved_alone(df, "counts")
        assert spark.conf.get(steps.FREE_SHUFFLES, None) == own
        for _ in range(100):  # the files go in the background
            if not (left := shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not left
        assert found.count() == 7000 and found.agg(F.sum("count")).first()[0] == 20_000
        assert df.count() == 7000  # the same rows can still be had again
    finally:
        spark.conf.unset(steps.FREE_SHUFFLES)


def test_the_setting_is_restored_after_a_failed_write(spark):
    with pytest.raises(Exception, match="no such luck"):
        steps.saved_alone(spark.range(3).select(F.raise_error(F.lit("no such luck")).alias("x")), "failed")
    assert spark.conf.get(steps.FREE_SHUFFLES, None) is None


@pytest.mark.parametrize("way", ["scored", "kept"])
def test_tables_of_the_toxicity_models_are_written_that_way(spark, monkeypatch, way):
    freed = {}
    write = steps.materialise

    def noted(df, name):
        freed[name] = spark.conf.get(steps.FREE_SHUFFLES, None)
        return write(df, name)

    monkeypatch.setattr(steps, "materialise", noted)
    rows, labels = taught_texts(80)
    made = getattr(toxicity, way)(documents(spark, rows), spark.createDataFrame(labels, LABELS), teach=toxicity.kneser_ney_ratios)
    assert 0 < made.count() <= 80
    assert {"word-pairs", "continuations", "telling", "crossed-means"} <= set(freed)
    assert set(freed.values()) == {"true"}
