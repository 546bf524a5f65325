"""Interpolated modified Kneser-Ney models of character n-grams.

Characters are read as their UTF-16 units, none reduced, so an n-gram of order
4 is an exact 64-bit number. A model is a set of tables that grow with the
text it is trained on: for each order the probabilities of the n-grams seen and
what each context leaves to the order below. Counts are joined with context
totals, and an order with the one below, shard by shard.

Texts are scored by the log-probabilities of their n-grams. The most frequent
ones, at most ``HEAD`` of them, are broadcast; the n-grams of texts that are not
among them, seen or unseen, are counted for each text and joined to the model's
tables. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.steps import saved, text_of, tidy

ORDER = 4
UNIT = 16  # bits of a character
GROUP_UNITS = 1 << 19  # characters looked at together
HEAD = 1 << 19  # most n-grams of each model that are broadcast
HELD_GRAMS = 400_000  # counts that a task keeps to merge them
UNSEEN = 2.0**-UNIT  # probability of a character before anything is known
TEXT_KEY = ["_key1", "_key2"]


def with_text_key(docs: DataFrame) -> DataFrame:
    """``docs`` with two 64-bit hashes of the text, by which equal texts are known; a null text counts as empty."""
    text = text_of("text")
    return docs.withColumns({"_key1": F.xxhash64(text), "_key2": F.xxhash64(F.lit(1), text)})


def grams(texts: pa.Array, group: int = GROUP_UNITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, n-gram) of every character of lower-cased texts, some at a time; texts begin after white space."""
    blank = np.full(ORDER - 1, ord(" "), "<u2")
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        units = np.frombuffer((text.as_py() or "").lower().encode("utf-16-le", "surrogatepass"), "<u2")
        before = blank
        for at in range(0, len(units), group):
            part = units[at : at + group]
            held += [before, part]
            rows.append((row, len(part)))
            before = np.concatenate([before, part])[-(ORDER - 1) :]
            size += len(part)
            if size >= group:
                yield _codes(held, rows)
                held, rows, size = [], [], 0
    if rows:
        yield _codes(held, rows)


def _codes(held: list[np.ndarray], rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    units = np.concatenate(held).astype(np.uint64)
    code = np.zeros(len(units), np.uint64)
    for k in range(ORDER):
        code[k:] |= units[: len(units) - k] << np.uint64(UNIT * k)
    sizes = np.array([n for _, n in rows])
    real = np.ones(len(units), bool)
    pads = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    for k in range(ORDER - 1):
        real[pads + k] = False
    return np.repeat(np.array([r for r, _ in rows]), sizes), code[real]


class _Sums:
    """Counts by (model, n-gram), merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, model: np.ndarray, code: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((model, code, n))
        self.size += len(code)

    def merge(self) -> None:
        model, code, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((code, model))
        model, code, n = model[order], code[order], n[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (model[1:] != model[:-1])])
        self.parts = [(model[first], code[first], np.add.reduceat(n, first))]
        self.size = len(first)

    def batch(self) -> pa.RecordBatch:
        self.merge()
        model, code, n = self.parts[0]
        self.parts, self.size = [], 0
        arrays = [pa.array(model.astype(np.int32)), pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["model", "code", "n"])


def counts(docs: DataFrame, group: Column) -> DataFrame:
    """(model, code, n): how often each n-gram occurs in the texts of each group.

    ``group`` gives a small number of integer groups; rows with a null group
    are left out, null texts count as empty.
    """

    size = GROUP_UNITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Sums()
        for batch in batches:
            model = batch.column("model").to_numpy(zero_copy_only=False)
            for row, code in grams(batch.column("text"), size):
                of = model[row]
                for m in np.unique(of):
                    found, n = np.unique(code[of == m], return_counts=True)
                    held.add(np.full(len(found), m), found, n)
                if held.size > HELD_GRAMS:
                    held.merge()
                    if held.size > HELD_GRAMS // 2:
                        yield held.batch()
        if held.size:
            yield held.batch()

    rows = docs.select(group.cast("int").alias("model"), F.col("text").cast("string").alias("text")).filter("model is not null")
    return rows.mapInArrow(tidy(run), "model int, code long, n long").groupBy("model", "code").agg(F.sum("n").alias("n"))


def discounts(of: list[int]) -> list[float]:
    """Discounts of n-grams seen once, twice and more often, from the numbers of n-grams seen 1 to 4 times.

    Where one of these is zero the estimate is undefined; then 0.5, 1 and 1.5.
    """
    n1, n2, n3, n4 = of
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found)]


def _last(code: Column, k: int) -> Column:
    """The last ``k`` characters of an n-gram of any higher order."""
    return code.bitwiseAND(F.lit((1 << (UNIT * k)) - 1)) if k < ORDER else code


def _context(code: Column) -> Column:
    return F.shiftrightunsigned(code, UNIT)


@dataclass(frozen=True)
class Model:
    """Tables of one or more models: for each order (model, code, p) and (model, context, rest)."""

    numbers: tuple[int, ...]
    seen: dict[int, DataFrame]
    rests: dict[int, DataFrame]
    head: dict[int, tuple[np.ndarray, np.ndarray]]


def train(top: DataFrame) -> Model:
    """Models of a ``counts`` table.

    Counts of the highest order are those of the texts. The orders below
    count in how many different n-grams of the order above a shorter one is
    an end. Without any counts there are no models.
    """
    tables = {ORDER: saved(top, "ngram-counts")}
    for k in range(ORDER - 1, 0, -1):
        shorter = tables[k + 1].groupBy("model", _last(F.col("code"), k).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        tables[k] = saved(shorter, f"ngram-ends-{k}")
    of: dict[tuple[int, int], list[int]] = {}
    few = [t.filter("n <= 4").groupBy(F.lit(k).alias("k"), "model", "n").agg(F.count(F.lit(1)).alias("of")) for k, t in tables.items()]
    union = few[0]
    for more in few[1:]:
        union = union.union(more)
    for r in union.collect():  # at most four rows for each model and order
        of.setdefault((r["k"], r["model"]), [0, 0, 0, 0])[r["n"] - 1] = r["of"]
    numbers = tuple(sorted(r["model"] for r in tables[1].select("model").distinct().collect()))
    seen: dict[int, DataFrame] = {}
    rests: dict[int, DataFrame] = {}
    for k in range(1, ORDER + 1):
        discount = F.lit(0.0)
        for model in numbers:
            d = discounts(of.get((k, model), [0, 0, 0, 0]))
            own = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            discount = F.when(F.col("model") == model, own).otherwise(discount)
        rows = tables[k].select("model", "code", _context(F.col("code")).alias("context"), "n", discount.alias("d"))
        contexts = rows.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        contexts = saved(contexts.select("model", "context", "total", (F.col("left") / F.col("total")).alias("rest")), f"ngram-contexts-{k}")
        own = (F.col("n") - F.col("d")) / F.col("total")
        found = rows.join(contexts, ["model", "context"])
        if k == 1:
            found = found.select("model", "code", (own + F.col("rest") * UNSEEN).alias("p"), "n")
        else:
            lower = seen[k - 1].select("model", F.col("code").alias("end"), F.col("p").alias("below"))
            found = found.withColumn("end", _last(F.col("code"), k - 1)).join(lower, ["model", "end"])
            found = found.select("model", "code", (own + F.col("rest") * F.col("below")).alias("p"), "n")
        seen[k] = saved(found, f"ngram-order-{k}")
        rests[k] = contexts.select("model", "context", "rest")
    return Model(numbers, seen, rests, {m: _head(seen[ORDER].filter(F.col("model") == m)) for m in numbers})


def _head(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams in order with their log-probabilities: as many sixteenths of an octave of counts as stay within ``HEAD``."""
    octave = F.floor(16 * F.log2("n"))
    sizes = sorted(((r["b"], r["of"]) for r in seen.groupBy(octave.alias("b")).agg(F.count(F.lit(1)).alias("of")).collect()), reverse=True)
    total, least = 0, None
    for b, n in sizes:  # at most 16 * 63 rows
        total += n
        if total > HEAD:
            break
        least = b
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    rows = seen.filter(octave >= least).select("code", F.log("p").alias("p")).toArrow()
    code = rows["code"].to_numpy().view(np.uint64)
    order = np.argsort(code)
    return code[order], rows["p"].to_numpy()[order]


def _probabilities(asked: DataFrame, model: Model) -> DataFrame:
    """(model, code, logp) of distinct n-grams, seen or not, from the tables of all orders."""
    found = asked.withColumn("p", F.lit(UNSEEN))
    for k in range(1, ORDER + 1):
        end, context = _last(F.col("code"), k), _context(_last(F.col("code"), k))
        seen = model.seen[k].select("model", F.col("code").alias("_end"), F.col("p").alias("_p"))
        rests = model.rests[k].select("model", F.col("context").alias("_context"), F.col("rest").alias("_rest"))
        found = found.withColumns({"_end": end, "_context": context}).join(seen, ["model", "_end"], "left")
        found = found.join(rests, ["model", "_context"], "left")
        backed = F.coalesce("_rest", F.lit(1.0)) * F.col("p")
        found = found.withColumn("p", F.coalesce("_p", backed)).select("model", "code", "p")
    return found.select("model", "code", F.log("p").alias("logp"))


def log_likelihoods(docs: DataFrame, model: Model, number: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns and (_key1, _key2, model, length, loglik) of every row; ``number`` says which model scores it.

    length counts characters; an empty or null text has length 0 and loglik 0. Rows of equal
    text and model share what is looked up.
    """
    head = docs.sparkSession.sparkContext.broadcast(model.head)
    names, size = [*keep, *TEXT_KEY, "model"], GROUP_UNITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column(batch.schema.get_field_index("model")).to_numpy(zero_copy_only=False)
            length, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            rest_row, rest_code, rest_n = [], [], []
            for row, code in grams(batch.column(batch.num_columns - 1), size):
                begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                length[row[begin]] += np.diff(np.r_[begin, len(row)])
                found, place = np.unique(code, return_inverse=True)
                for m in np.unique(models[row]):
                    known, p = head.value[int(m)]
                    at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                    hit = known[at] == found if len(known) else np.zeros(len(found), bool)
                    own = models[row] == m
                    value = np.where(hit, p[at] if len(known) else 0.0, 0.0)[place] * own
                    total[row[begin]] += np.add.reduceat(value, begin)
                    open_at = np.flatnonzero(~hit[place] & own)
                    pair = row[open_at] * len(found) + place[open_at]
                    pairs, n = np.unique(pair, return_counts=True)
                    rest_row.append(pairs // len(found))
                    rest_code.append(found[pairs % len(found)])
                    rest_n.append(n)
            rows = np.concatenate(rest_row) if rest_row else np.zeros(0, np.int64)
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            code = (np.concatenate(rest_code)[order] if rest_row else np.zeros(0, np.uint64)).view(np.int64)
            n = (np.concatenate(rest_n)[order] if rest_row else np.zeros(0)).astype(np.int64)
            items = pa.StructArray.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])
            columns = [*batch.columns[:-1], pa.array(length), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), items)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "length", "known", "rest"])

    rows = with_text_key(docs.withColumn("model", number.cast("int"))).select(*names, F.col("text").cast("string").alias("_text_"))
    item = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    extra = [T.StructField("length", T.LongType()), T.StructField("known", T.DoubleType()), T.StructField("rest", T.ArrayType(item))]
    scored = saved(rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields[:-1], *extra])), "ngram-scores")
    # A text cut into groups can hold an n-gram in several of them.
    opened = scored.select(*TEXT_KEY, "model", F.posexplode("rest").alias("_at", "item")).select(*TEXT_KEY, "model", "_at", "item.*").distinct()
    looked = saved(_probabilities(opened.select("model", "code").distinct(), model), "ngram-looked-up")
    sums = opened.join(looked, ["model", "code"]).groupBy(*TEXT_KEY, "model").agg(F.sum(F.col("n") * F.col("logp")).alias("_more"))
    found = scored.drop("rest").join(sums, [*TEXT_KEY, "model"], "left")
    return found.select(*names, "length", (F.col("known") + F.coalesce("_more", F.lit(0.0))).alias("loglik"))
