"""Phrase collocations from a weighted de Bruijn graph of words.

The longest phrases (``longest`` words) are edges between the overlapping
phrases one word shorter. Edges are the only thing counted over the texts.
Behind the last word of a piece stand end marks, so every word starts one edge,
and the flow out of a node, its edges into end marks included, is the count of
the node's phrase: marks are the corrections for phrases at the end of pieces.
The flow out of all nodes that begin with the same words gives shorter counts.

Runs of nodes with one way in and one way out of equal weight (passages that
texts repeat) are compacted to paths, so that a path costs two look-ups of
counts however long it is.

Words are 64-bit codes that a table of all words proves to be distinct (else
another seed is tried), so all counts are exact. Edges meet in buckets by
the code of their first word; the first words that make up a thousandth of all
words or more (so a thousand at most) are dealt on by the second word, and so
on, which bounds what one word or pair of words brings into a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.bytewords import BREAK, byte_kinds, distinct, words_of
from labelweave.llm.steps import join_sized, saved

LONGEST, LEAST, COVER, TOP = 3, 10, 50, 2000
NO_LANG = "und"
KINDS = byte_kinds(gaps=b" \t", breaks=b".,;:!?\n\x0b\x0c\r")
HOT_SHARE = 1000  # a word of at least this part of all words is dealt on by the words behind it
BUCKET_WORDS = 2_000_000
HELD_WORDS = 400_000  # counts of words that a task keeps to merge them
PATH_EDGES = 256  # of a path in one row
END = 0  # code of the end mark


def _with_lang(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    return docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))


def _coded(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[list[tuple[str, bytes]], np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct (lang, word) of each group of texts sorted by code, their codes, and the id and piece of each word."""
    langs, lang_of = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
    seeds = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed) for x in langs]
    for group in words_of(batch.column("text"), KINDS, BREAK):
        known, word = distinct(group.text)
        pairs, ids = np.unique(lang_of[group.row] * len(known) + word, return_inverse=True)
        names = [(langs[p // len(known)], known[p % len(known)]) for p in pairs.tolist()]
        codes = np.array(
            [xxhash.xxh64_intdigest(known[p % len(known)], seeds[p // len(known)]) or 1 for p in pairs.tolist()], np.uint64
        )
        order = np.argsort(codes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield [names[i] for i in order.tolist()], codes[order], place[ids], group.piece


def vocabulary(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(code, lang, word, n) of all words; lower-cased A-Z only, a null text has none, a null lang counts as ``und``."""

    names = ["code", "lang", "word", "n"]

    def merged(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by(names[:3]).aggregate([("n", "sum")])
        return found.select([*names[:3], "n_sum"]).rename_columns(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for pairs, codes, ids, _ in _coded(batch, seed):
                columns = [
                    pa.array(codes.view(np.int64)),
                    pa.array([x for x, _ in pairs], pa.string()),
                    pa.array([w for _, w in pairs], pa.binary()).cast(pa.string(), safe=False),
                    pa.array(np.bincount(ids, minlength=len(codes)).astype(np.int64)),
                ]
                held.append(pa.Table.from_arrays(columns, names=names))
                if sum(map(len, held)) > HELD_WORDS:
                    held = [merged(held)]
                    if len(held[0]) > HELD_WORDS // 2:
                        yield from held.pop().to_batches(HELD_WORDS // 8)
        if held:
            yield from merged(held).to_batches(HELD_WORDS // 8)

    rows = _with_lang(docs).mapInArrow(run, "code long, lang string, word string, n long")
    # Tasks have counted already; dealt by code, one exchange serves both the sums and the proof that codes are distinct.
    return rows.repartition("code").groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _buckets(codes: list[np.ndarray], hot: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each edge: by its first word, and by each further word while all words before are hot."""
    with np.errstate(over="ignore"):
        h, on = _mix(codes[0]), np.ones(len(codes[0]), bool)
        for k in range(1, len(codes)):
            on &= np.isin(codes[k - 1], hot)
            h = np.where(on, _mix(h + codes[k]), h)
        return ((h >> np.uint64(11)) % np.uint64(n)).astype(np.int64)


def _unique(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and count of each distinct row of small ids, in order."""
    key, size = columns[0], base
    for c in columns[1:]:
        if size * base >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * base + c, size * base
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def _edges(docs: DataFrame, longest: int, buckets: int, hot: np.ndarray, seed: int) -> DataFrame:
    """(bucket, rows, data): edges counted per group of texts, packed for their buckets in the order of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes, ids, piece in _coded(batch, seed):
                codes = np.concatenate([np.array([END], np.uint64), codes])
                columns = [ids + 1]
                for k in range(1, longest):
                    behind = np.zeros(len(ids), np.int64)
                    same = piece[k:] == piece[: max(0, len(piece) - k)]
                    behind[: len(same)] = np.where(same, ids[k:] + 1, 0)
                    columns.append(behind)
                first, n = _unique(columns, len(codes))
                edges = [codes[c[first]] for c in columns]
                bucket = _buckets(edges, hot, buckets)
                order = np.argsort(bucket, kind="stable")
                numbers, begins = np.unique(bucket[order], return_index=True)
                stops = [*begins[1:].tolist(), len(order)]
                parts = [order[b:e] for b, e in zip(begins.tolist(), stops)]
                data = [pa.compress(b"".join(x[p].tobytes() for x in (*edges, n.astype("<u8"))), "zstd", asbytes=True) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers.astype(np.int32)), pa.array([len(p) for p in parts], pa.int32()), pa.array(data, pa.binary())],
                    names=["bucket", "rows", "data"],
                )

    return _with_lang(docs).mapInArrow(run, "bucket int, rows int, data binary")


def _code_columns(n: int) -> list[str]:
    return [f"c{k}" for k in range(1, n + 1)]


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, seed: int = 0) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(vocabulary, {words of a phrase: (c1 .., n)}) with every phrase of 1 to ``longest`` words that occurs ``least`` times.

    Counts are exact and per lang, as codes differ between langs. Only edges
    are counted over the texts; shorter counts are the flow out of nodes.
    """
    while True:
        words = saved(vocabulary(docs, seed), "words")
        if not words.groupBy("code").count().filter("count > 1").head(1):
            break
        seed += 1
    total = words.agg(F.sum("n")).first()[0] or 0
    # At most HOT_SHARE rows, as their counts add up to the total at most.
    hot_rows = words.filter(F.col("n") * HOT_SHARE >= total).select("code").collect()
    hot = np.sort(np.array([r["code"] for r in hot_rows], np.int64).view(np.uint64))
    edges = _edges(docs, longest, max(1, -(-total // BUCKET_WORDS)), hot, seed)
    columns = _code_columns(longest)

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        held = [
            np.frombuffer(pa.decompress(d, 8 * (longest + 1) * n, "zstd", asbytes=True), "<u8").reshape(longest + 1, n)
            for d, n in zip(parts["data"], parts["rows"])
        ]
        held = np.concatenate(held, axis=1)
        held = held[:, np.lexsort(held[longest - 1 :: -1])]
        out = []
        changed, partial = np.zeros(held.shape[1], bool), np.ones(held.shape[1], bool)
        for k in range(longest):  # prefixes of k + 1 words; the whole edge last
            changed[0] = True
            changed[1:] |= held[k, 1:] != held[k, :-1]
            begins = np.flatnonzero(changed)
            n = np.add.reduceat(held[longest], begins).astype(np.int64)
            partial &= np.isin(held[k], hot)
            # A prefix is split over buckets only if all its words are hot; else its flow is whole here.
            more = partial[begins] if k < longest - 1 else np.zeros(len(begins), bool)
            keep = (held[k, begins] != END) & (more | (n >= least))
            frame = pd.DataFrame({"size": np.full(int(keep.sum()), k + 1, np.int32)})
            for j, c in enumerate(columns):
                frame[c] = held[j, begins[keep]].view(np.int64) if j <= k else np.zeros(len(frame), np.int64)
            out.append(frame.assign(n=n[keep]))
        return pd.concat(out)

    schema = "size int, " + ", ".join(f"{c} long" for c in columns) + ", n long"
    flows = saved(edges.groupBy("bucket").applyInPandas(merge, schema), "phrase-flows")
    counts = {}
    for size in range(1, longest + 1):
        own = columns[:size]
        found = flows.filter(F.col("size") == size).groupBy(*own).agg(F.sum("n").alias("n"))
        counts[size] = found.filter(F.col("n") >= least)
    return words, counts


def nodes_of(longer: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Phrases of ``size`` words with what the phrases one word longer say of them.

    covered is the weight of the heaviest longer phrase around it, before the
    code of a word that leads in. unary nodes have one way in and one way out,
    both of the node's own weight: nothing starts, ends or branches there.
    """
    columns, wider = _code_columns(size), _code_columns(size + 1)
    weight = [F.count(F.lit(1)).alias("ways"), F.max("n").alias("most")]
    out = longer.groupBy(*columns).agg(*weight)
    into = longer.groupBy(*[F.col(c).alias(d) for c, d in zip(wider[1:], columns)]).agg(*weight, F.min("c1").alias("before"))
    found = counts.join(out.withColumnsRenamed({"ways": "out_ways", "most": "out_most"}), columns, "left")
    found = found.join(into.withColumnsRenamed({"ways": "in_ways", "most": "in_most"}), columns, "left")
    unary = (F.col("in_ways") == 1) & (F.col("out_ways") == 1) & (F.col("in_most") == F.col("n")) & (F.col("out_most") == F.col("n"))
    return found.select(
        *columns, "n", F.greatest("in_most", "out_most").alias("covered"), "before", F.coalesce(unary, F.lit(False)).alias("unary")
    )


def _steps(nodes: DataFrame, size: int) -> DataFrame:
    """(node, path, step) of unary nodes: the first unary node of the run each lies on, and its distance, by pointer doubling.

    A run has a first node: a piece that went around a ring of unary nodes
    would never have started. The rounds grow with the logarithm of the longest run.
    """
    columns = _code_columns(size)
    unary = nodes.filter("unary")
    node = F.struct(*columns)
    before = F.struct(*[F.col(a).alias(b) for a, b in zip(["before", *columns[:-1]], columns)])
    own = unary.select(node.alias("node"), before.alias("at"))
    there = own.select(F.col("node").alias("at"), F.lit(True).alias("found"))
    state = own.join(there, "at", "left").select(
        "node", F.when(F.col("found"), F.col("at")).otherwise(F.col("node")).alias("path"), F.coalesce("found", F.lit(False)).cast("long").alias("step")
    )
    while True:
        state = saved(state, "path-steps")
        ahead = state.filter("step > 0").select(F.col("node").alias("path"), F.col("path").alias("next"), F.col("step").alias("more"))
        moved = state.join(ahead, "path", "left")
        if not ahead.join(state.select("path").distinct(), "path", "left_semi").head(1):
            return state
        state = moved.select("node", F.coalesce("next", "path").alias("path"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"))


def compacted(edges: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """(n, words, opens, closes): edges joined through unary nodes, as runs of word codes of one weight.

    A run of ``words`` holds all its phrases of ``longest`` words. Runs are cut
    after ``PATH_EDGES`` edges; opens and closes say whether the first and
    last node of a row are ends of the whole path.
    """
    columns = _code_columns(longest)
    steps = _steps(nodes, longest - 1)
    first, last = F.struct(*columns[:-1]), F.struct(*[F.col(c).alias(d) for c, d in zip(columns[1:], columns)])
    placed = edges.withColumns({"first": first, "last": last})
    placed = placed.join(steps.select(F.col("node").alias("first"), F.col("path").alias("path_1"), F.col("step").alias("step_1")), "first", "left")
    placed = placed.join(steps.select(F.col("node").alias("last"), F.col("path").alias("path_2")), "last", "left")
    placed = placed.select(
        *columns, "n", F.coalesce("path_1", "path_2").alias("path"), F.coalesce(F.col("step_1") + 1, F.lit(0)).alias("step"),
        F.col("path_1").isNull().alias("opens"), F.col("path_2").isNull().alias("closes"),
    )
    placed = saved(placed, "path-edges")
    alone = placed.filter("path is null").select("n", F.array(*columns).alias("words"), "opens", "closes")
    runs = placed.filter("path is not null").groupBy("path", F.floor(F.col("step") / PATH_EDGES).alias("part"))
    edge = F.array_sort(F.collect_list(F.struct("step", F.array(*columns).alias("codes"))))
    runs = runs.agg(F.max("n").alias("n"), edge.alias("edges"), F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    words = F.concat(F.col("edges")[0]["codes"], F.transform(F.slice("edges", 2, PATH_EDGES), lambda e: F.element_at(e["codes"], -1)))
    return alone.union(runs.select("n", words.alias("words"), "opens", "closes"))


def _longest_candidates(edges: DataFrame, counts: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """Phrases of ``longest`` words with the counts of their first and last ``longest`` - 1 words (head, tail).

    Inside a compacted path these are the path's own weight; only its two ends are looked up.
    """
    columns = _code_columns(longest)
    paths = compacted(edges, nodes, longest)
    known = counts.select(*[F.col(c).alias(f"_{c}") for c in columns[:-1]], F.col("n").alias("_n"))

    def looked_up(df: DataFrame, when: str, begin: Column, out: str) -> DataFrame:
        codes = df.withColumns({c: F.when(F.col(when), F.get(F.col("words"), begin + k)) for k, c in enumerate(columns[:-1])})
        same = [F.col(c) == F.col(f"_{c}") for c in columns[:-1]]
        return codes.join(known, same, "left").withColumn(out, F.coalesce("_n", "n")).drop(*columns[:-1], *[f"_{c}" for c in columns[:-1]], "_n")

    paths = looked_up(paths, "opens", F.lit(0), "head")
    paths = looked_up(paths, "closes", F.size("words") - (longest - 1), "tail")
    at = F.sequence(F.lit(0), F.size("words") - longest)
    opened = paths.select("n", "words", "head", "tail", F.explode(at).alias("at"))
    is_last = F.col("at") == F.size("words") - longest
    return opened.select(
        *[F.get(F.col("words"), F.col("at") + k).alias(c) for k, c in enumerate(columns)], "n",
        F.when(F.col("at") == 0, F.col("head")).otherwise(F.col("n")).alias("head"),
        F.when(is_last, F.col("tail")).otherwise(F.col("n")).alias("tail"),
    )


def _looked_up(df: DataFrame, counts: DataFrame, begin: int, size: int, out: str) -> DataFrame:
    """``df`` with the count of the ``size`` words of its phrase from the ``begin``-th on."""
    own = _code_columns(size)
    named = counts.select(*[F.col(c).alias(f"c{begin + k}") for k, c in enumerate(own)], F.col("n").alias(out))
    return df.join(named, [f"c{begin + k}" for k in range(size)])


def first_of_each(df: DataFrame, by: str, order: list[Column], key: list[str], first: int) -> DataFrame:
    """Rows of the first ``first`` ranks of each group, with a ``rank`` from 1.

    Large groups play rounds in parts: no task ranks more than about 25 times
    ``first`` rows of a group, and what cannot be among the first leaves early.
    """
    while True:
        most = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0
        parts = -(-most // (25 * first))
        rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
        if parts <= 1:
            return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= first)
        dealt = df.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)))
        inside = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))
        df = saved(dealt.withColumn("_place", inside).filter(F.col("_place") <= first).drop("_part", "_place"), "first-rows")


def candidates(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cover: int = COVER, seed: int = 0) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of 2 to ``longest`` words that no longer one covers.

    a, l and r are the counts of a phrase and of the two parts of its
    lowest-scoring cut, n counts all words of the lang; score is
    floor(1000000 a a / (l r)) in exact decimals, right while a stays below
    10 ** 16. A phrase is covered by a longer one that holds it and occurs
    at least ``cover`` percent as often; of the longer ones those by one word
    decide, as none occurs more often. Null texts count as empty, null langs
    as ``und``; repeated rows count again; other columns are ignored. Empty
    tables give no rows.
    """
    words, counts = phrase_counts(docs, longest, least, seed)
    counts = {k: saved(v, f"phrases-{k}") for k, v in counts.items()}
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = []
    nodes = {k: saved(nodes_of(counts[k + 1], counts[k], k), f"nodes-{k}") for k in range(2 if longest > 2 else 1, longest)}
    for size in range(2, longest + 1):
        if size == longest:
            rows = _longest_candidates(counts[size], counts[size - 1], nodes[size - 1], longest).withColumnRenamed("n", "a")
        else:
            rows = nodes[size].filter(F.col("covered").isNull() | (100 * F.col("covered") < cover * F.col("n")))
            rows = rows.select(*_code_columns(size), F.col("n").alias("a"))
        for k in range(1, size):
            # The first k words and the rest; ends of longest phrases are known from their path.
            if size == longest and k == size - 1:
                rows = rows.withColumnRenamed("head", f"l{k}")
            else:
                rows = _looked_up(rows, counts[k], 1, k, f"l{k}")
            if size == longest and size - k == size - 1:
                rows = rows.withColumnRenamed("tail", f"r{k}")
            else:
                rows = _looked_up(rows, counts[size - k], k + 1, size - k, f"r{k}")
        score = "CAST((1000000 * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) DIV (CAST(l{0} AS DECIMAL(19,0)) * CAST(r{0} AS DECIMAL(19,0))) AS BIGINT)"
        cuts = [F.struct(F.expr(score.format(k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
        rows = rows.select(*_code_columns(size), "a", F.array_min(F.array(*cuts)).alias("cut"))
        spelt = words.filter(F.col("n") >= least).select("code", "lang", "word")
        for k in range(1, size + 1):
            own = spelt.select(F.col("code").alias(f"c{k}"), F.col("word").alias(f"w{k}"), *(["lang"] if k == 1 else []))
            rows = rows.join(own, f"c{k}")
        phrase = F.concat_ws(" ", *[f"w{k}" for k in range(1, size + 1)])
        found.append(rows.select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return join_sized(rows, totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """The first ``top`` candidates of each lang by score, count and phrase, with their rank from 1."""
    rows = saved(candidates(docs, longest, least, cover), "collocations")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = first_of_each(rows, "lang", order, ["phrase"], top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
