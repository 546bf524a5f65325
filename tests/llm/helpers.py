"""Small inputs with the awkward rows every operator must take."""

import random

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string"


def sentence(seed, n=30):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """Rows (doc_id, text[, lang]) with extra columns whose names operators use for results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 9.0, "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    long_text = " ".join(sentence(k, 200) for k in range(60))
    base = sentence(1, 60)
    return documents(
        spark,
        [
            (1, base),
            (2, base),
            (2, base),
            (3, base + " alpha"),
            (4, None),
            (5, ""),
            (6, "   \n\t "),
            (None, "no id " + sentence(7)),
            (None, None),
            (7, long_text),
            (8, "Ünïcode ① 𝒳 \x00 text"),
            (9, "one"),
            (10, sentence(10), None),
        ],
    )


def empty(spark):
    return spark.createDataFrame([], DOCS)


def with_inner_names(df):
    """The same rows with more columns, called as operators call theirs inside."""
    names = ["_hash", "_id", "_keep", "_lang", "_none", "_row", "_unnamed", "best", "component", "key", "model", "n"]
    return df.selectExpr("*", *[f"'x' AS `{name}`" for name in names])
