"""Small frames with the rows that are easy to get wrong."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 700} and{i % 31}" for i in range(60_000))


def odd_documents(spark, more=()):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, ties."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n\r\x0b\x0c ", "fr", None, 7),
        (5, LONG, "en", "b", len(LONG)),
        (6, "é日本 \U0001f600 'll don't \x00 <|im_end|> 12.5%\n\n  x", None, "b", 3),
        (6, "é日本 \U0001f600 'll don't \x00 <|im_end|> 12.5%\n\n  x", None, "b", 3),
        (7, "a", "de", "b", 1),
        (7, "another text of the same id, with words enough to count for something", "de", "b", 1),
        (None, "a text without an id", "en", "c", 5),
        *more,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


def multiset(rows):
    return sorted(map(repr, rows))
