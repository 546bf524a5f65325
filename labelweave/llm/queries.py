"""Registered queries of this subpackage and the SQL they must equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import chats, collocations, licenses, minhash, mixing, multi_index, packing, quality
from labelweave.llm import resampling, sentencepieces, simhash, toxicity, urls
from labelweave.plans.catalog import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


@query("op6_shortest_pack_first")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER))


@query("op8_sentencepiece_round_trip")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepieces.digests(docs, public_tokenizers.path(PIECE_MODEL))


@query("op9_simhash_golay")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_kneser_ney_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = quality.scores(docs, table(spark, sf_dir, "labels"), keep=("doc_id", "lang"))
    return found.select(
        "doc_id",
        "lang",
        F.col("_perplexity").alias("perplexity"),
        F.col("_threshold").alias("threshold"),
        F.col("_keep").alias("keep"),
    )


@query("op4_kneser_ney_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, table(spark, sf_dir, "labels"), keep=["doc_id"], teach=toxicity.kneser_ney_ratios)
    predicted = (F.col("score") >= toxicity.REJECT).cast("int")
    held_out = toxicity.fold_of() == toxicity.HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op10_densified_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_edits(table(spark, sf_dir, "documents"))


@query(
    "op1_chat_snapshots",
    """
    WITH turns AS (
        SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL),
    placed AS (
        SELECT conv_id, role, text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
        FROM turns),
    prefixes AS (
        SELECT conv_id, place, md5(string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '|')
               OVER (PARTITION BY conv_id ORDER BY place)) AS prefix
        FROM placed),
    ends AS (
        SELECT min(conv_id) AS conv_id, place AS n_turns, prefix, count(*) AS n_copies
        FROM (SELECT * FROM prefixes QUALIFY place = max(place) OVER (PARTITION BY conv_id)) GROUP BY place, prefix),
    proper AS (
        SELECT DISTINCT place, prefix FROM prefixes
        QUALIFY place < max(place) OVER (PARTITION BY conv_id)),
    kept AS (
        SELECT conv_id, n_turns, n_copies FROM ends
        WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.place = ends.n_turns AND p.prefix = ends.prefix))
    SELECT conv_id, CAST((place - 1) // 256 AS INTEGER) AS part, n_turns, n_copies,
           string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY place)
               AS text
    FROM placed JOIN kept USING (conv_id) GROUP BY ALL
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render(table(spark, sf_dir, "conversations"))


@query(
    "op2_redirect_equivalence",
    r"""
    WITH RECURSIVE rules(rule, rule_host, rule_path, decides) AS (
        VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
               ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
    declared AS (
        SELECT url AS a, unnest(list_concat(
            [regexp_extract(t, '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1)
             FOR t IN regexp_extract_all(html, '(?is)<link\b[^>]*>')
             IF regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical["''\s>]')],
            [regexp_extract(t, '(?is)\burl\s*=\s*[''"]?([^''">\s]+)', 1)
             FOR t IN regexp_extract_all(html, '(?is)<meta\b[^>]*>')
             IF regexp_matches(t, '(?is)http-equiv\s*=\s*["'']?refresh')])) AS b
        FROM pages),
    plain AS (
        SELECT url AS a, 'https://'
               || regexp_replace(regexp_replace(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)?$', ''), '^www\.', '')
               || regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '')
               || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS b
        FROM (SELECT url, array_to_string(list_filter(string_split(
                         regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)^[^?]*\?(.*)$', 1), '&'),
                         lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)=')), '&') AS kept
              FROM pages WHERE regexp_matches(url, '(?i)^https?://'))),
    edges AS (
        SELECT DISTINCT regexp_replace(a, '(?s)#.*$', '') AS a, regexp_replace(b, '(?s)#.*$', '') AS b
        FROM (SELECT * FROM declared UNION ALL SELECT * FROM plain) WHERE a IS NOT NULL AND contains(b, '://')),
    sym AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
    reach AS (SELECT a AS node, a AS other FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON r.other = s.a),
    addresses AS (
        SELECT url FROM pages UNION SELECT node FROM reach),
    parts AS (
        SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM addresses),
    fits AS (
        SELECT url, host, path, max_by(rule, length(rule)) AS rule, max_by(decides, length(rule)) AS decides
        FROM parts LEFT JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY ALL),
    aliases AS (
        SELECT node, min(other) AS alias_of, bool_or(decides = 'block') AS bad
        FROM reach JOIN fits ON url = other GROUP BY node)
    SELECT page_id, host, path, rule,
           coalesce(decides, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, alias_of
    FROM pages JOIN fits ON pages.url IS NOT DISTINCT FROM fits.url
        LEFT JOIN aliases ON node = regexp_replace(pages.url, '(?s)#.*$', '')
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op7_inverted_multi_index")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


@query(
    "op11_de_bruijn_collocations",
    r"""
    WITH pieces AS (
        SELECT row_number() OVER () AS piece, lang, words FROM (
            SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS words FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\x0A-\x0D]')) AS p FROM documents))),
    grams AS (
        SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase FROM (
            SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
            FROM pieces, (SELECT unnest([1, 2, 3]) AS size))),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
    cuts AS (
        SELECT lang, size, phrase, a, w, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
        FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
    scored AS (
        SELECT cuts.*, x.a AS l, y.a AS r, CAST(1000000::HUGEINT * cuts.a * cuts.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
        FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head AND x.size = k
            JOIN f y ON y.lang = cuts.lang AND y.phrase = tail AND y.size = cuts.size - k
        QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.size, cuts.phrase ORDER BY score, k) = 1),
    covers AS (
        SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a AS longer FROM c WHERE size = 3
        UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE size = 3),
    most AS (SELECT lang, phrase, max(longer) AS longer FROM covers GROUP BY ALL),
    kept AS (
        SELECT s.* FROM scored s LEFT JOIN most m ON m.lang = s.lang AND m.phrase = s.phrase AND s.size = 2
        WHERE m.longer IS NULL OR 100 * m.longer < 50 * s.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@query(
    "op12_head_tail_resampling",
    r"""
    WITH crc_table AS (
        SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
                    ORDER BY i) AS entries
        FROM (SELECT unnest(range(256)) AS i)),
    words AS (
        SELECT 'd' AS side, doc_id, row_id, unnest(w) AS word FROM (
            SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
        UNION ALL
        SELECT 't', NULL, NULL, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
    counted AS (SELECT word, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM words GROUP BY word),
    bytes AS (SELECT word, s, t, hex(encode(word)) AS h FROM counted),
    hashed AS (
        SELECT word, s, t, xor(list_reduce(
            [CAST('0x' || h[2 * i - 1:2 * i] AS BIGINT) FOR i IN range(1, len(h) // 2 + 1)],
            lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
        FROM bytes, crc_table),
    sums AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counted),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln(((sum(t)::DOUBLE + 1) * (all_s + 10000)) / ((sum(s)::DOUBLE + 1) * (all_t + 10000)))) AS BIGINT)
               AS gain FROM hashed, sums GROUP BY bucket, all_s, all_t),
    weights AS (
        SELECT row_id, count(*) AS n, sum(gain) AS weight
        FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_id),
    docs AS (
        SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight
        FROM (SELECT doc_id, row_number() OVER () AS row_id FROM documents) LEFT JOIN weights USING (row_id)),
    scored AS (
        SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)::DOUBLE + 0.5)
               / 4294967296))) AS BIGINT) AS score FROM docs),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
               count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank
    FROM placed
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.weighted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return resampling.drawn(found).select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_block_mixture")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))
