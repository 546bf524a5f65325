"""Shuffles, chunks, folds, batches and repeated samples."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.order import rank_by_key, shuffle_key
from labelweave.session import materialise
from labelweave.sources.tables import sample_n

ROOM = 1.0  # times the room a bound of hashes needs


def shuffle(
    df: DataFrame, seed: int, id_col: str = "row_id", out: str = "ord", total: str | None = None
) -> DataFrame:
    """Seeded order of the rows as a dense 0-based ordinal.

    ``total`` names a column for the row count, which the ranks need anyway.
    """
    keyed = df.withColumn("_key", shuffle_key(seed, F.col(id_col)))
    return rank_by_key(keyed, "_key", [id_col], out=out, total=total).drop("_key")


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def chunk(
    df: DataFrame, n: int, ord_col: str = "ord", out: str = "chunk", rows: Column | None = None
) -> DataFrame:
    """Near-equal chunks of the ordinal; the first ``N mod n`` get one extra row.

    ``rows`` is the row count where it is at hand; otherwise it is counted.
    """
    sized = df.withColumn("_rows", _row_count(df) if rows is None else rows)
    low = F.floor(F.col("_rows") / F.lit(n)).cast("long")
    extra = F.col("_rows") % n
    head = extra * (low + 1)
    in_head = F.floor(F.col(ord_col) / (low + 1))
    in_tail = extra + F.floor(F.try_divide((F.col(ord_col) - head).cast("double"), low.cast("double")))
    number = F.when(F.col(ord_col) < head, in_head).otherwise(in_tail)
    return sized.withColumn(out, (number + 1).cast("int")).drop("_rows")


def fold_table(n: int, n_train: int, n_test: int, reverse_test: bool = True) -> list[tuple[int, str, int]]:
    """(fold, role, chunk) for every combination of chunks.

    Train sets run in lexicographic order, test sets in reverse order by
    default, so fold i trains and tests on complementary chunks when
    ``n_train + n_test == n``.
    """
    trains = list(combinations(range(1, n + 1), n_train))
    tests = list(combinations(range(1, n + 1), n_test))
    if reverse_test:
        tests.reverse()
    rows = [(i, "train", c) for i, chunks in enumerate(trains, 1) for c in chunks]
    return rows + [(i, "test", c) for i, chunks in enumerate(tests, 1) for c in chunks]


def fold_pairs(
    df: DataFrame, n: int, n_train: int, n_test: int, reverse_test: bool = True, chunk_col: str = "chunk"
) -> DataFrame:
    """Every row once per fold and role it belongs to; no join, no shuffle."""
    places = F.array(
        *[
            F.struct(F.lit(fold).alias("fold"), F.lit(role).alias("role"), F.lit(c).alias("at"))
            for fold, role, c in fold_table(n, n_train, n_test, reverse_test)
        ]
    )
    own = F.filter(places, lambda p: p["at"] == F.col(chunk_col))
    return df.withColumn("_place", F.explode(own)).select("_place.fold", "_place.role", *df.columns)


def split(
    df: DataFrame, n: int = 5, n_train: int = 3, n_test: int = 2, seed: int = 0, id_col: str = "row_id"
) -> DataFrame:
    """Shuffle, cut into chunks and spread over all train/test folds."""
    ordered = shuffle(df, seed, id_col, total="_total")
    return fold_pairs(chunk(ordered, n, rows=F.col("_total")).drop("_total"), n, n_train, n_test)


def assign_batches(df: DataFrame, init: int, size: int, ord_col: str = "ord", out: str = "iteration") -> DataFrame:
    """Iteration 1 is the initial batch, then fixed batches; the last may be short."""
    position = F.col(ord_col)
    later = F.lit(2) + F.floor((position - F.lit(init)) / F.lit(size))
    return df.withColumn(out, F.when(position < init, F.lit(1)).otherwise(later).cast("int"))


def two_stage_batches(
    df: DataFrame, init_train: int, init_batch: int, batch: int, ord_col: str = "ord"
) -> DataFrame:
    """Small batches until the pool reaches ``init_train``, then large ones."""
    n_init = -(-init_train // init_batch)
    reached = n_init * init_batch
    position = F.col(ord_col)
    first = F.lit(1) + F.floor(position / F.lit(init_batch))
    later = F.lit(n_init + 1) + F.floor((position - F.lit(reached)) / F.lit(batch))
    in_init = position < reached
    return df.withColumn("stage", F.when(in_init, "init").otherwise("retrain")).withColumn(
        "iteration", F.when(in_init, first).otherwise(later).cast("int")
    )


def remove_rows(df: DataFrame, used: DataFrame, id_col: str = "row_id") -> DataFrame:
    return df.join(used.select(id_col), id_col, "left_anti")


def holdout_tail(
    df: DataFrame, share: float, ord_col: str = "ord", overlap: bool = True, rows: Column | None = None
) -> DataFrame:
    """Mark the last rows as hold-out; with ``overlap`` they also stay in train."""
    start = F.col("_rows") - F.floor(F.col("_rows") * F.lit(share)).cast("long")
    counted = df.withColumn("_rows", _row_count(df) if rows is None else rows)
    marked = counted.withColumn("holdout", F.col(ord_col) >= start)
    return marked.withColumn("train", F.lit(True) if overlap else ~F.col("holdout")).drop("_rows")


def validation_slice(
    pool: DataFrame, share: float = 0.1, cap: int = 6000, seed: int = 0, ord_col: str = "ord", id_col: str = "row_id"
) -> DataFrame:
    """The last part of the labelled pool, sampled down to ``cap`` rows."""
    tail = holdout_tail(pool, share, ord_col).filter("holdout").drop("holdout", "train")
    return sample_n(tail, cap, seed, id_col)


def stratified_kfold(
    df: DataFrame, k: int, repeats: int, seed: int = 0, label: str = "Label", id_col: str = "row_id", labels: int | None = None
) -> DataFrame:
    """Fold number per repeat; every label is dealt round-robin in hash order.

    ``labels`` is the number of labels where it is known: the table of bucket
    starts is then broadcast and the rows are shuffled once.
    """
    repeat = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    spread = df.withColumn("repeat", repeat)
    keyed = spread.withColumn("_key", shuffle_key(seed, F.col("repeat"), F.col(id_col)))
    ranked = rank_by_key(keyed, "_key", [id_col], by=["repeat", label], out="_rank", groups=labels and labels * repeats)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_key", "_rank")


def repeated_subsamples(
    df: DataFrame, keys: Sequence[tuple[int, int, int]], seed: int = 0, id_col: str = "row_id",
    train_chunks: dict[int, Sequence[int]] | None = None,
) -> DataFrame:
    """An exact-size sample for every (fold, size, repeat) key, of the table or of the fold's train rows.

    ``train_chunks`` names the chunks a fold trains on (``df`` then has a chunk
    column). A sample is the least hashes of its key. Rows whose hash cannot be
    among them, by a bound that holds with room to spare, never leave the scan;
    should a key come out short, its bound is raised and the scan repeated.
    """
    chunk = F.col("chunk") if train_chunks else F.lit(0)
    sizes = {r["c"]: r["n"] for r in df.groupBy(chunk.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per chunk
    rows_of = {f: sum(sizes.get(c, 0) for c in (train_chunks[f] if train_chunks else (0,))) for f in {k[0] for k in keys}}
    chunks_of = {f: list(train_chunks[f]) if train_chunks else [0] for f in rows_of}
    slack, done, open_keys = ROOM, None, list(keys)
    while open_keys:
        grid = []
        for fold, size, repeat in open_keys:
            bound = slack * (size + 6 * size**0.5 + 30) / max(rows_of[fold], 1)
            cut = f"{int(bound * 16**15):015x}" if bound < 1 else "g"  # after every hex digit
            grid.append(
                F.struct(
                    F.lit(fold).alias("fold"), F.lit(size).alias("size"), F.lit(repeat).alias("repeat"), F.lit(cut).alias("cut"),
                    F.lit(f"{seed}:{fold}:{size}:{repeat}").alias("start"),
                    F.array(*[F.lit(c) for c in chunks_of[fold]]).alias("chunks"),
                )
            )
        # Keys become rows first, so that hashing runs as compiled code; only hashes below their bound leave the scan.
        # The text hashed is that of ``shuffle_key``, put together from two parts; a null id adds nothing to it.
        own_text = F.coalesce(F.concat(F.lit(":"), F.col(id_col).cast("string")), F.lit(""))
        keyed = df.withColumn("_text", own_text).withColumn("_of", F.explode(F.array(*grid))).filter(F.array_contains("_of.chunks", chunk))
        spread = keyed.withColumn("_key", F.md5(F.concat("_of.start", "_text"))).filter(F.col("_key") < F.col("_of.cut"))
        spread = spread.select("_of.fold", "_of.size", "_of.repeat", "_key", *df.columns)
        spread = materialise(spread, "least-hashes")
        found = {(r["fold"], r["size"], r["repeat"]): r["n"] for r in spread.groupBy("fold", "size", "repeat").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [k for k in open_keys if found.get(k, 0) < min(k[1], rows_of[k[0]])]
        if short:
            names = df.sparkSession.createDataFrame(short, "fold int, size int, repeat int")
            spread = spread.join(F.broadcast(names), ["fold", "size", "repeat"], "left_anti")
        done = spread if done is None else done.unionByName(spread)
        open_keys, slack = short, 4 * slack
    by = ["fold", "size", "repeat"]
    return rank_by_key(done, "_key", [id_col], by=by, limit=F.col("size"), groups=len(keys)).drop("_key")
