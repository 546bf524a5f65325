"""Quality by the perplexity of a Kneser-Ney model of trusted text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm import ngrams
from labelweave.llm.steps import BROADCAST_ROWS, crc32_of_id, join_sized, saved

QUANTILE = 0.99  # of the perplexities of trusted texts of a language
ACCURACY = 10_000
FOLDS = 2
ALL = FOLDS  # number of the model of all trusted texts; 0 and 1 leave one fold out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id (as _id) of documents that all their labels call good and none toxic."""
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    flags = flags.agg(F.min("quality").alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return flags.filter("good = 1 and toxic = 0").select("_id")


def scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with _key1, _key2, _lang, _none, _perplexity, _threshold and _keep, one row for each row of ``docs``.

    The model is trained on the texts of trusted documents, all of them. A text
    is kept up to the ``quantile`` of the perplexities of the trusted texts of
    its language (null is a language too); a language without trusted texts
    takes the quantile over all trusted texts. These perplexities come from
    models that did not see the text: those of the other half, dealt by a
    checksum of the id. Empty and null texts have no perplexity and are kept,
    as is everything when there are no trusted texts.
    """
    known = trusted_ids(labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("_id"), "lang", "text")
    fold = F.pmod(crc32_of_id("_id"), F.lit(FOLDS)).cast("int")
    taught = join_sized(slim, known, "_id")
    parts = saved(ngrams.counts(taught, fold), "ngram-folds")
    models = F.explode(F.array(F.lit(ALL), 1 - F.col("model")))
    model = ngrams.train(parts.select(models.alias("model"), "code", "n").groupBy("model", "code").agg(F.sum("n").alias("n")))
    held = docs.select(*keep, F.coalesce("lang", F.lit("")).alias("_lang"), F.col("lang").isNull().alias("_none"), "text")
    if ALL not in model.numbers:
        none = [F.lit(None).cast("double").alias(n) for n in ("_perplexity", "_threshold")]
        return ngrams.with_text_key(held).drop("text").select("*", *none, F.lit(True).alias("_keep"))
    perplexity = F.when(F.col("length") > 0, F.exp(-F.col("loglik") / F.col("length")))
    # With one fold only, its own model is the only one there is.
    own = fold if len(model.numbers) == FOLDS + 1 else F.lit(ALL)
    slim = taught.select("_id", F.coalesce("lang", F.lit("")).alias("_lang"), F.col("lang").isNull().alias("_none"), "text")
    levels = ngrams.log_likelihoods(slim, model, own, ["_lang", "_none"])
    levels = saved(levels.select("_lang", "_none", perplexity.alias("_perplexity")), "trusted-perplexities")
    cut = F.percentile_approx("_perplexity", quantile, ACCURACY).alias("_threshold")
    of_all = levels.agg(cut).first()["_threshold"]
    of_lang = levels.groupBy("_lang", "_none").agg(cut)
    found = ngrams.log_likelihoods(held, model, F.lit(ALL), [*keep, "_lang", "_none"])
    found = found.select(*keep, *ngrams.TEXT_KEY, "_lang", "_none", perplexity.alias("_perplexity"))
    found = join_sized(found, of_lang, ["_lang", "_none"], "left")
    found = found.withColumn("_threshold", F.coalesce("_threshold", F.lit(of_all)))
    good = F.col("_perplexity").isNull() | F.col("_threshold").isNull() | (F.col("_perplexity") <= F.col("_threshold"))
    return found.withColumn("_keep", good)


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``scores`` keeps, with all their columns.

    Only the keys of rejected texts are joined to the documents; up to ``limit`` of them
    the documents are not shuffled.
    """
    names = [f"_{c}_of_row" for c in (*ngrams.TEXT_KEY, "lang", "none")]
    lost = scores(docs.select("doc_id", "lang", "text"), labels, quantile).filter("not _keep")
    lost = lost.select(*[F.col(c).alias(n) for c, n in zip((*ngrams.TEXT_KEY, "_lang", "_none"), names)]).distinct()
    keyed = ngrams.with_text_key(docs.select(F.struct("*").alias("_row_"), "text"))
    lang = F.col("_row_")["lang"]
    keyed = keyed.select("_row_", *[F.col(c).alias(n) for c, n in zip(ngrams.TEXT_KEY, names)], F.coalesce(lang, F.lit("")).alias(names[2]), lang.isNull().alias(names[3]))
    return join_sized(keyed, saved(lost, "rejected-texts"), names, "left_anti", limit).select("_row_.*")


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` with _perplexity, _threshold and _keep; see ``scores``.

    Columns of the three names are replaced, others pass; repeated rows repeat.
    An empty table gives no rows.
    """
    docs = docs.drop("_perplexity", "_threshold", "_keep")
    slim = docs.select("doc_id", "lang", "text", F.struct("*").alias("_row_"))
    found = scores(slim, labels, quantile, keep=("_row_",))
    return found.select("_row_.*", "_perplexity", "_threshold", "_keep")
