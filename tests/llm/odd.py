"""Documents with nulls, empty and very long texts, repeated rows and columns of clashing names."""

from __future__ import annotations

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 5000} of{i % 7}" for i in range(60_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\r\n\x0b\x0c ", "de", "b", 7),
    (None, "A row without an id has words too, quite a few of them in fact.", "fr", None, 1),
    (5, LONG, "en", "b", len(LONG)),
    (6, "\0 nul and <|endoftext|> \u00a0 nbsp \u2028 日本語 😀 é e\u0301 ▁ \u200b", "es", "c", 3),
    (7, "!!! ### 123", None, "c", 11),
    (8, "same tie same tie", "en", "c", 17),
    (9, "same tie same tie", "en", "d", 17),
    (None, None, None, None, None),
]

# Names that operators use themselves.
CLASHING = ("score", "kept", "Node", "sig", "figures", "masked", "queue", "sketch_node", "ids")


def schema() -> T.StructType:
    base = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return T.StructType.fromDDL(", ".join([base, *[f"{c} string" for c in CLASHING]]))


def odd_documents(spark):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in ROWS], schema()).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], schema())


def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, 0), (7, 0, 1), (99, 1, 0), (8, 5, 0)],
        "doc_id bigint, quality int, toxic int")
