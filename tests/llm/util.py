"""Small tables with odd rows."""

import random

WORDS = [f"{a}{b}" for a in "bcdfglmnprstv" for b in ("a", "en", "ing", "o", "ur", "est")]
EXTRA = "score double, tid string, u long, v long, h long, size string, bucket int, cls string, t string, label string, found string, host string"


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", rng.choice(WORDS))) for _ in range(n))


def odd_docs(spark, more=()):
    """Nulls in every column, empty and blank texts, one very long word and text, repeated rows, clashing columns."""
    rng = random.Random(5)
    base = text(rng, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (None, text(rng, 50), "fr", None),
        (4, "", "en", "b"), (5, " \t\n ", "en", "b"), (6, "one two", "de", "c"), (7, "x" * 30_000, "en", "a"),
        (8, " ".join(["again"] * 3_000), "en", "a"), (9, text(rng, 20_000), "en", "a"), (10, base.replace(" ", "  \n", 5), "es", "b"), *more,
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *[None] * 12) for i, t, lang, s in rows], schema)


def empty(df):
    return df.limit(0)
