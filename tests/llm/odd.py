"""Documents with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "TEXT string, size string, score string, fp string, in_0 string, c0 string, `a.b` string")
EXTRA = ("x", "7", "high", "0", "i", "c", "dot")
LONG = " ".join(f"w{i % 9000} and" for i in range(60_000)) + "\n"
PLAIN = "the quick brown fox and the lazy dog of the old town " * 8


def rows():
    out = [
        (5, PLAIN, "en", "b"), (None, PLAIN, "en", None), (7, None, None, "a"), (8, "", "en", "a"), (9, " \n\t ", "de", "b"),
        (10, LONG, "en", "a"), (11, PLAIN, "en", "b"), (11, PLAIN, "en", "b"), (12, "mail me@x.example.org now", "en", "c"),
        (13, "é ü ß the und der die", "de", "c"), (None, None, None, None), (14, "one", "en", "a"), (15, "\x00 a\u0000b", "en", "b"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in out]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def storable(df):
    """The same without names that differ in case only, which Parquet refuses."""
    return df.toDF(*["kept" if c == "TEXT" else c for c in df.columns])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
