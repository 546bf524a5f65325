"""Toxicity by class-conditional Kneser-Ney models of words.

Each class, toxic and ordinary text, has an interpolated modified Kneser-Ney
model whose base is such a model of both classes together. A word given the one
before it is discounted and backs off, by what its context leaves, from the
class to the shared model and there to the word's continuation count, the number
of different words it follows; a word alone has its continuation count in the
class, over that in both, over one chance for each word known. A rare word or
pair is therefore about as likely in both classes, and only what a class is known
by has a likelihood ratio worth mentioning. An expression is a run of one or two
words; its chance is that of its first word times that of its second given it,
and two words count only where they tell more than each of them alone.
(``expression_ratios`` is a plainer way that discounts expressions as such.)

A text is scored by its most telling expressions: the mean over two of them of
the log-likelihood ratio per word. A mean over the whole text would drown two
words in a thousand. The score goes up with this mean, on a scale fitted to
texts that did not teach the model they were scored by.

Model tables grow with the labelled text and are joined to the expressions of
documents; a filter of bits of fixed size, made from the telling expressions,
keeps most others out of the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.bytewords import BREAK, Words, byte_kinds, distinct, words_of
from labelweave.llm.ngrams import TEXT_KEY, discounts, with_text_key
from labelweave.llm.steps import BROADCAST_ROWS, crc32_of_id, join_sized, saved, saved_alone, tidy

REJECT = 0.7  # a text of at least this score is toxic
FOLDS = 3  # rows with checksum of the id modulo 3 ...
HELD_OUT = 1  # ... equal to 1 teach nothing
ALL = 2  # number of the model of all folds; 0 and 1 leave one of the two taught folds out
WORDS = 2  # most words of an expression
TELLING = 1.0  # least log-likelihood ratio per word that counts
BEST = 2  # expressions that make the score
FILTER_BITS = 1 << 24
BINS = 64  # per unit of the score's mean ratio
GROUP_BYTES = 2 << 20  # of texts whose expressions are counted together
LONG_BYTES = 48  # a longer word is read as its characters
BEGIN = 0  # code of what stands before the first word of a piece
MODELS = (0, 1, ALL)
PAIR_COUNTS = ["n_0_0", "n_0_1", "n_1_0", "n_1_1"]  # by class and part
KINDS = byte_kinds(gaps=[*range(0x00, 0x21), 0x7F], breaks=b"!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~")


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.pmod(crc32_of_id(doc_id), F.lit(FOLDS)).cast("int")


def _code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _spelt(group: Words) -> Words:
    """Long words (text without spaces between words, mostly) as their characters."""
    size = np.diff(np.frombuffer(group.text.buffers()[1], "<i8")[: len(group.text) + 1])
    long = np.flatnonzero(size > LONG_BYTES)
    if not len(long):
        return group
    times = np.ones(len(size), np.int64)
    spelt = {}
    for i in long.tolist():
        spelt[i] = [c.encode() for c in group.text[i].as_py().decode("utf-8", "ignore")]
        times[i] = len(spelt[i])
    out: list[bytes] = []
    at = 0
    for i in long.tolist():
        out += group.text.slice(at, i - at).to_pylist() + spelt[i]
        at = i + 1
    out += group.text.slice(at).to_pylist()
    return Words(pa.array(out, pa.large_binary()), np.repeat(group.row, times), np.repeat(group.piece, times))


def _coded(texts: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    """Words, some texts at a time, and their 64-bit hashes; a long word counts as the run of its characters."""
    for group in words_of(texts, KINDS, BREAK, GROUP_BYTES):
        group = _spelt(group)
        if not len(group.text):
            continue
        known, place = distinct(group.text)
        yield group, np.array([_code(w) for w in known], np.uint64)[place]


def _joined(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Code of an expression with one more word."""
    with np.errstate(over="ignore"):
        return (code * np.uint64(0x9E3779B97F4A7C15)) ^ (word >> np.uint64(1)) ^ (word << np.uint64(63))


def expressions(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, row, code) for the expressions of each number of words, some texts at a time."""
    for group, word in _coded(texts):
        code = word
        for k in range(1, WORDS + 1):
            if k > 1:
                code = _joined(code[:-1], word[k - 1 :])
            same = group.piece[k - 1 :] == group.piece[: len(group.piece) - k + 1]
            yield k, group.row[: len(same)][same], code[same]


def _counts(taught: DataFrame) -> DataFrame:
    """(k, code, n_<class>_<part>, t_<part>): occurrences in the texts of a class and part, and texts that hold the expression.

    ``taught`` has toxic (0 or 1), part (0 or 1) and text.
    """
    names = ["n_0_0", "n_0_1", "n_1_0", "n_1_1", "t_0", "t_1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, part = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toxic", "part"))
            for k, row, code in expressions(batch.column("text")):
                found, place = np.unique(code, return_inverse=True)
                sums = np.zeros((len(found), 6), np.int64)
                np.add.at(sums, (place, toxic[row] * 2 + part[row]), 1)
                pairs = np.unique(row * len(found) + place)
                np.add.at(sums, (pairs % len(found), 4 + part[pairs // len(found)]), 1)
                columns = [pa.array(np.full(len(found), k, np.int32)), pa.array(found.view(np.int64)), *[pa.array(s.astype(np.int32)) for s in sums.T]]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "code", *names])

    schema = "k int, code long, " + ", ".join(f"{n} int" for n in names)
    rows = taught.select("toxic", "part", "text").mapInArrow(tidy(run), schema)
    return rows.groupBy("k", "code").agg(*[F.sum(n).alias(n) for n in names])


def _model_counts(number: int) -> tuple[Column, Column, Column]:
    """Counts of ordinary texts, of toxic texts, and texts, as model ``number`` sees them."""
    parts = (0, 1) if number == ALL else (1 - number,)

    def total(names: list[str]) -> Column:
        out = F.col(names[0])
        for n in names[1:]:
            out = out + F.col(n)
        return out

    return tuple(total([f"{c}_{p}" for p in parts]) for c in ("n_0", "n_1", "t"))


def telling(counted: DataFrame) -> dict[int, DataFrame]:
    """{model: (code, ratio)}: log-likelihood ratio per word of every expression known to toxic texts, from ``TELLING`` on.

    A model without texts of both classes is left out.
    """
    figures = []
    for number in (0, 1, ALL):
        for name, n in zip("out", _model_counts(number)):
            figures += [F.sum(n).alias(f"{name}{number}_sum"), F.count_if(n > 0).alias(f"{name}{number}_kinds")]
            figures += [F.count_if(n == i).alias(f"{name}{number}_{i}") for i in (1, 2, 3, 4)]
    held = {r["k"]: r for r in counted.groupBy("k").agg(*figures).collect()}  # one row per number of words
    out = {}
    for number in (0, 1, ALL):
        tables = []
        for k, f in sorted(held.items()):
            if not f[f"o{number}_sum"] or not f[f"u{number}_sum"]:
                continue

            def discounted(n: Column, name: str) -> tuple[Column, float]:
                """Share of an expression after its discount, and the share that discounts free for what backs off."""
                total = f[f"{name}{number}_sum"]
                of = [f[f"{name}{number}_{i}"] for i in (1, 2, 3, 4)]
                d = discounts(of)
                many = f[f"{name}{number}_kinds"] - of[0] - of[1]
                freed = (d[0] * of[0] + d[1] * of[1] + d[2] * many) / total
                cut = F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
                return (n - cut) / total, freed

            ordinary, toxic, texts = _model_counts(number)
            shared, freed = discounted(texts, "t")
            shared = shared + freed / (f[f"t{number}_kinds"] + 1)
            chances = []
            for n, name in ((ordinary, "o"), (toxic, "u")):
                own, rest = discounted(n, name)
                chances.append(own + rest * shared)
            ratio = (F.log(chances[1]) - F.log(chances[0])) / k
            rows = counted.filter((F.col("k") == k) & (toxic > 0))
            tables.append(rows.select("code", ratio.alias("ratio")).filter(F.col("ratio") >= TELLING))
        if tables:
            rows = tables[0]
            for more in tables[1:]:
                rows = rows.union(more)
            out[number] = saved(rows, f"telling-{number}")
    return out


def expression_ratios(taught: DataFrame) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Counts of expressions and their ``telling`` ones, discounted as such and backing off to counts of texts."""
    counted = saved(_counts(taught), "expressions")
    return counted, telling(counted)


def _pair_counts(taught: DataFrame) -> DataFrame:
    """(before, word, n_<class>_<part>): how often a word follows another, or ``BEGIN``, in the texts of a class and part."""
    names = PAIR_COUNTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, part = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toxic", "part"))
            for group, word in _coded(batch.column("text")):
                before = np.r_[np.uint64(BEGIN), word[:-1]]
                before[np.flatnonzero(np.diff(group.piece, prepend=-1))] = BEGIN
                order = np.lexsort((word, before))  # rows of one context side by side take less space
                before, word = before[order], word[order]
                begins = np.r_[True, (before[1:] != before[:-1]) | (word[1:] != word[:-1])]
                first, place = np.flatnonzero(begins), np.cumsum(begins) - 1
                kind = (toxic[group.row] * 2 + part[group.row])[order]
                sums = np.bincount(place * 4 + kind, minlength=4 * len(first)).reshape(-1, 4).astype(np.int32)
                columns = [pa.array(c[first].view(np.int64)) for c in (before, word)] + [pa.array(n) for n in sums.T]
                yield pa.RecordBatch.from_arrays(columns, names=["before", "word", *names])

    schema = "before long, word long, " + ", ".join(f"{n} int" for n in names)
    rows = taught.select("toxic", "part", "text").mapInArrow(tidy(run), schema)
    return rows.groupBy("before", "word").agg(*[F.sum(n).alias(n) for n in names])


def _seen(kind: str, number: int, of: str = "n") -> Column:
    """How often model ``number`` sees a pair (or what ``of`` counts) in ordinary texts (o), toxic texts (u) or all of them (s)."""
    parts = (0, 1) if number == ALL else (1 - number,)
    names = [f"{of}_{c}_{p}" for c in {"o": (0,), "u": (1,), "s": (0, 1)}[kind] for p in parts]
    return sum((F.col(n) for n in names[1:]), F.col(names[0]))


def _figures(counts: dict[str, Column]) -> list[Column]:
    """Sum, kinds and numbers of counts of 1 to 4, of each count."""
    out = []
    for name, n in counts.items():
        out += [F.sum(n).alias(f"{name}_sum"), F.count_if(n > 0).alias(f"{name}_kinds")]
        out += [F.count_if(n == i).alias(f"{name}_{i}") for i in (1, 2, 3, 4)]
    return out


def _cut(n: Column, d: Sequence[float]) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def kneser_ney_ratios(taught: DataFrame) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Counts of words behind words, and {model: (code, ratio)} of the two Kneser-Ney models of each number.

    A ratio is the log-likelihood ratio per word of an expression known to toxic texts, from ``TELLING``
    on. Contexts and continuations are counted in all taught texts; a model without texts of both
    classes is left out.
    """
    pairs = saved_alone(_pair_counts(taught), "word-pairs")
    own = {f"{k}{m}": _seen(k, m) for m in MODELS for k in "ous"}
    of = pairs.agg(*_figures(own)).first().asDict()  # one row
    numbers = [m for m in MODELS if of[f"o{m}_sum"] and of[f"u{m}_sum"]]
    if not numbers:
        return pairs, {}
    d = {n: discounts([of[f"{n}_{i}"] for i in (1, 2, 3, 4)]) for n in own}
    # Continuation counts: how many different words, or beginnings, a word follows.
    ends = pairs.groupBy("word").agg(*[F.count_if(_seen(k, m) > 0).alias(f"{k}{m}") for m in MODELS for k in "ous"])
    ends = saved_alone(ends, "continuations")
    more = ends.agg(*_figures({f"{k}{m}": F.col(f"{k}{m}") for m in MODELS for k in "ous"})).first().asDict()  # one row

    def lower(name: str, below: Column | float) -> Column:
        """Chance of a word by its continuation count, over what it backs off to."""
        few, total = [more[f"{name}_{i}"] for i in (1, 2, 3, 4)], more[f"{name}_sum"]
        cut = discounts(few)
        freed = cut[0] * few[0] + cut[1] * few[1] + cut[2] * (more[f"{name}_kinds"] - few[0] - few[1])
        return (F.col(name) - _cut(F.col(name), cut)) / total + below * F.lit(freed / total)

    def alone(m: int) -> dict[str, Column]:
        """Chances of a word alone in both classes and in all texts."""
        shared = lower(f"s{m}", F.lit(1.0 / (more[f"s{m}_kinds"] + 1)))
        return {"s": shared, "o": lower(f"o{m}", shared), "u": lower(f"u{m}", shared)}

    def tells(m: int) -> Column:
        chance = alone(m)
        return F.when(F.col(f"u{m}") > 0, F.log(chance["u"]) - F.log(chance["o"]))

    words = ends.filter(F.col(f"u{ALL}") > 0)
    totals = [F.sum(n).alias(f"all_{n}") for n in PAIR_COUNTS]
    for name, n in own.items():
        totals += [F.count_if(n == 1).alias(f"{name}_once"), F.count_if(n == 2).alias(f"{name}_twice"), F.count_if(n > 2).alias(f"{name}_often")]
    # Counts, not chances, are shuffled: they are small numbers, mostly zero.
    contexts = pairs.groupBy("before").agg(*totals).filter(F.col("all_n_1_0") + F.col("all_n_1_1") > 0)
    toxic = pairs.filter((_seen("u", ALL) > 0) & (F.col("before") != BEGIN))
    first = words.select(F.col("word").alias("before"), *[tells(m).alias(f"first{m}") for m in numbers])
    rows = toxic.join(words, "word").join(contexts, "before").join(first, "before")

    def given(name: str, total: Column, below: Column) -> Column:
        """Chance of the second word after the first; a context without counts leaves all to what is below."""
        cut = d[name]
        left = cut[0] * F.col(f"{name}_once") + cut[1] * F.col(f"{name}_twice") + cut[2] * F.col(f"{name}_often")
        return F.when(total > 0, (own[name] - _cut(own[name], cut) + left * below) / total).otherwise(below)

    def ratio(m: int) -> Column:
        """Of two words; null where one of them alone tells as much."""
        total = {k: _seen(k, m, "all_n") for k in "ous"}
        shared = given(f"s{m}", total["s"], alone(m)["s"])
        chain = F.log(given(f"u{m}", total["u"], shared)) - F.log(given(f"o{m}", total["o"], shared))
        both = (F.col(f"first{m}") + chain) / 2
        return F.when((own[f"u{m}"] > 0) & (both > F.greatest(f"first{m}", tells(m))), both).alias(f"r{m}")

    two = rows.select("before", "word", *[ratio(m) for m in numbers])
    one = words.select(F.lit(None).cast("long").alias("before"), "word", *[tells(m).alias(f"r{m}") for m in numbers])
    reached = F.lit(False)
    for m in numbers:
        reached = reached | F.coalesce(F.col(f"r{m}") >= TELLING, F.lit(False))
    table = saved_alone(_named(one.union(two).filter(reached)), "telling")
    return pairs, {m: table.filter(F.col(f"r{m}") >= TELLING).select("code", F.col(f"r{m}").alias("ratio")) for m in numbers}


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with the code of their expression, the word alone or behind another, for before and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = batch.column("before").is_null().to_numpy(zero_copy_only=False)
            before = batch.column("before").fill_null(0).to_numpy().view(np.uint64)
            word = batch.column("word").to_numpy().view(np.uint64)
            code = np.where(alone, word, _joined(before, word)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code), *batch.columns[2:]], names=["code", *batch.schema.names[2:]])

    return rows.mapInArrow(run, T.StructType([T.StructField("code", T.LongType()), *rows.schema.fields[2:]]))


# Turns taught texts into their counts and {model: (code, ratio)} of telling expressions.
Teacher = Callable[[DataFrame], tuple[DataFrame, dict[int, DataFrame]]]


def _bits(tables: Sequence[DataFrame]) -> np.ndarray:
    """Filter of ``FILTER_BITS`` bits with two bits set for each code; whatever the tables hold, it does not grow."""
    codes, size = tables[0].select("code"), FILTER_BITS
    for more in tables[1:]:
        codes = codes.union(more.select("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate([_places(batch.column("code").to_numpy().view(np.uint64), seed, size) for seed in (1, 2)])
            bits = np.int64(1) << (places & 63)
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array(bits)], names=["word", "bits"])

    # Words of 64 bits, so the driver gets FILTER_BITS / 64 rows at most.
    words = codes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = saved_alone(words, "filter").toArrow()
    out = np.zeros(size // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _found(docs: DataFrame, bits: np.ndarray, keep: list[str]) -> DataFrame:
    """(keep, code): the distinct expressions of each text that may be telling."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, code in expressions(batch.column(batch.num_columns - 1)):
                found, place = np.unique(code, return_inverse=True)
                maybe = _may_hold(held.value, found)
                at = np.flatnonzero(maybe[place])
                pairs = np.unique(row[at] * len(found) + place[at])
                if not len(pairs):
                    continue
                kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).take(pa.array(pairs // len(found)))
                code = pa.array(found[pairs % len(found)].view(np.int64))
                yield pa.RecordBatch.from_arrays([*kept.columns, code], names=[*keep, "code"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text_"))
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields[:-1], T.StructField("code", T.LongType())]))


def _places(codes: np.ndarray, seed: int, n: int) -> np.ndarray:
    """Place of a code's bit in a filter of ``n`` bits."""
    with np.errstate(over="ignore"):
        h = (codes ^ (codes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * seed + 1)
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _may_hold(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.ones(len(codes), bool)
    for seed in (1, 2):
        h = _places(codes, seed, 64 * len(bits))
        out &= (bits[h >> 6] >> (h & 63)) & 1 == 1
    return out


def _means(found: DataFrame, ratios: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    """(key, mean): over the ``BEST`` highest ratios of each key's distinct expressions; what is missing of them counts as 0."""
    hits = found.join(ratios, on).groupBy(*key, "code").agg(F.max("ratio").alias("ratio"))
    best = F.slice(F.sort_array(F.collect_list("ratio"), asc=False), 1, BEST)
    total = F.aggregate(best, F.lit(0.0), lambda t, x: t + x)
    return hits.groupBy(*key).agg((total / BEST).alias("mean"))


def _logistic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that fit ``positive`` of ``n`` rows at each x, by Newton steps with a slight ridge."""
    scale = max(float(np.sqrt(np.average(x**2, weights=n))), 1e-9)
    features = np.c_[x / scale, np.ones(len(x))]
    weights, ridge = np.zeros(2), np.diag([0.01, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (positive - n * p) - ridge @ weights
        curve = (features * (n * p * (1 - p))[:, None]).T @ features + ridge + np.eye(2) * 1e-9
        step = np.linalg.solve(curve, slope)
        weights += step * min(1.0, 4 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0] / scale), float(weights[1])


def means(docs: DataFrame, labels: DataFrame, teach: Teacher = expression_ratios) -> tuple[DataFrame | None, float, float]:
    """(_key1, _key2, mean) of the texts with telling expressions, and slope and intercept of the score; see ``scored``."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(fold_of() != HELD_OUT).select(F.col("doc_id").alias("_id"), "toxic")
    part = F.when(fold_of("_id") == 0, 0).otherwise(1)
    taught = join_sized(docs.select(F.col("doc_id").cast("long").alias("_id"), "text"), known, "_id")
    taught = with_text_key(taught.withColumn("part", part)).select("_id", *TEXT_KEY, "toxic", "part", "text")
    counted, tables = teach(taught)
    if ALL not in tables:
        only = counted.agg(F.sum(F.col("n_1_0") + F.col("n_1_1"))).first()[0]
        return None, 0.0, 1.0 if only else 0.0
    # A part is scored by the model that left it out; where that lacks a class, by the model of all.
    crossed = [tables.get(k, tables[ALL]) for k in (0, 1)]
    ratios = crossed[0].withColumn("part", F.lit(0)).union(crossed[1].withColumn("part", F.lit(1)))
    key = ["_id", *TEXT_KEY, "toxic", "part"]
    found = saved_alone(_means(_found(taught, _bits(crossed), key), ratios, ["part", "code"], key), "crossed-means")
    rows = taught.select(*key).distinct()
    same = [rows[c].eqNullSafe(found[c]) for c in key]
    rows = rows.join(found, same, "left").select(rows["toxic"], F.round(F.coalesce("mean", F.lit(0.0)) * BINS).alias("place"))
    bins = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).collect()  # ratios of doubles: some thousand bins
    x, n, positive = (np.array([float(r[c]) for r in bins]) for c in ("place", "n", "toxic"))
    slope, start = _logistic(x / BINS, n, positive)
    texts = with_text_key(docs.select("text"))
    return _means(_found(texts, _bits([tables[ALL]]), TEXT_KEY), tables[ALL], ["code"], TEXT_KEY), max(slope, 0.0), start


def _score(mean: Column, slope: float, start: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(slope) * mean + F.lit(start))))


def scored(
    docs: DataFrame, labels: DataFrame, name: str = "score", keep: Sequence[str] | None = None, teach: Teacher = expression_ratios
) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with the score of each whole text; a null text counts as empty.

    It is learnt from the labelled rows of ``docs`` outside the held-out fold.
    ``labels`` has doc_id and toxic (0 or 1); rows with nulls teach nothing and
    a document labelled both ways counts as toxic. All taught rows are counted;
    nothing is sampled. The scale is fitted to means that each of the two
    taught folds gets from the model of the other one. With one class only,
    every score is 1 or 0; without labels it is 0. Repeated rows are scored
    alike; columns other than doc_id and text only pass (one called ``name``
    is replaced). An empty table gives no rows. ``teach`` is the way the ratios
    of expressions are found, ``kneser_ney_ratios`` or ``expression_ratios``.
    """
    wanted = [c for c in (docs.columns if keep is None else keep) if c != name]
    found, slope, start = means(docs.select("doc_id", "text"), labels, teach)
    rows = docs.select(*wanted)
    if found is None:
        return rows.withColumn(name, F.lit(start))
    found = saved_alone(found.select(*[F.col(c).alias(f"{c}_of_text") for c in TEXT_KEY], F.col("mean").alias("_mean_of_text")), "toxic-means")
    keyed = with_text_key(docs.select(F.struct(*wanted).alias("_row_"), "text"))
    keyed = keyed.select("_row_", *[F.col(c).alias(f"{c}_of_text") for c in TEXT_KEY])
    keyed = keyed.join(found, [f"{c}_of_text" for c in TEXT_KEY], "left")
    return keyed.select("_row_.*", _score(F.coalesce("_mean_of_text", F.lit(0.0)), slope, start).alias(name))


def kept(
    docs: DataFrame, labels: DataFrame, reject: float = REJECT, limit: int = BROADCAST_ROWS, teach: Teacher = expression_ratios
) -> DataFrame:
    """The rows of ``docs`` whose ``scored`` value stays below ``reject``, with all their columns.

    Only the keys of rejected texts are joined to the documents; up to ``limit`` of them
    the documents are not shuffled.
    """
    found, slope, start = means(docs.select("doc_id", "text"), labels, teach)
    if found is None:
        return docs.filter(F.lit(start < reject))
    if 1 / (1 + np.exp(-start)) >= reject:
        return docs.limit(0)  # even a text without a telling expression is as likely toxic as that
    lost = found.filter(_score(F.col("mean"), slope, start) >= reject)
    lost = saved_alone(lost.select(*[F.col(c).alias(f"{c}_of_text") for c in TEXT_KEY]), "rejected-texts")
    keyed = with_text_key(docs.select(F.struct("*").alias("_row_"), "text"))
    keyed = keyed.select("_row_", *[F.col(c).alias(f"{c}_of_text") for c in TEXT_KEY])
    return join_sized(keyed, lost, [f"{c}_of_text" for c in TEXT_KEY], "left_anti", limit).select("_row_.*")
