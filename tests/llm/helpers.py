"""Rows that every operator must stand."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long"
SF = "/root/testdata/sf0.001"


def odd_documents(spark, rows=()):
    """Nulls, blanks, a long text, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = [
        (1, None, None, None, None, None, 5), (2, "", "en", "a", 0, True, 5), (3, " \n\t ", "en", "a", 3, True, 5),
        (4, "one two", "en", None, 7, False, 5), (5, "one two", None, "a", 7, None, 5),
        (6, long, "en", "a", len(long), True, 5), (7, long + " end", "en", "b", len(long) + 4, True, 5),
        (8, "Éa é \u00a0 ünd \U0001f600 𝔘 don't", "de", "b", 1, True, 5), (9, "12 34 !!", "de", "b", 8, True, 5),
        (9, "12 34 !!", "de", "b", 8, True, 5), (10, "a" * 50_000, "fr", "b", 50_000, True, 5),
    ]
    return spark.createDataFrame([*base, *rows], DOCS)


def by_id(rows):
    return {r[0]: tuple(r)[1:] for r in rows}


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")
