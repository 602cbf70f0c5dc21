"""Small corpora with the cases that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = [a + b + c for a in ("ba", "ko", "li", "mur", "ster") for b in ("na", "vi", "to", "gre") for c in ("", "n", "rd", "sa", "mi")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", ""]) if rng.random() < 0.2 else "") for _ in range(n))


def odd_rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars."""
    long = prose(1, 6000)
    near = prose(2, 300)
    texts = [
        (1, prose(3, 120)), (2, None), (3, ""), (4, "   \n\t "), (5, "one"), (6, near), (7, near.replace("ban", "bun", 1)), (8, near),
        (9, long), (9, long), (10, "Über \U0001f600 straße naïve 中文 12345"), (None, prose(4, 80)), (None, None),
        (11, prose(5, 90)), (11, prose(6, 90)), (12, "A" * 3000), (13, "x y " * 500), (14, ".,;!? 123 --"),
    ]
    return [(i, t, None if n % 4 == 0 else "en", "s", len(t or "")) for n, (i, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("fp", "kid", "content", "h", "a", "b", "n", "word", "c", "row", "token", "size", "pos", "key", "_text", "_kid", "_content", "_shard", "kept", "node", "component", "score", "piece", "length", "next", "part", "edited", "_lang_pred", "_c0")


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})


def bag(df, columns=None):
    """Rows as a sorted list, for comparison."""
    return sorted(map(repr, (tuple(r) for r in df.select(*(columns or df.columns)).collect())))
