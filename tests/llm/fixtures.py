"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names, no rows."""

from pathlib import Path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the word and the other word again " * 4000


def awkward_rows():
    card = "4111 1111 1111 1111"
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n\x0b\x0c\r ", "en", "a", 7), (3, LONG, "en", "a", len(LONG)),
        (4, "one two three four five " * 20, None, "b", 1), (5, "one two three four five " * 20, "en", None, 1), (6, "\U0001d49c\u00e9 <|endoftext|> x", "fr", "\u00e9", 3),
        (8, f"Call +1 (212) 555-1234 or {card}, mail a.b+c@d-e.co.uk_x@y.z now 300.1.1.1 10.0.0.255", "en", "b", 1),
        (9, "12345678901234567 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 +12 +1234567 0004.5.6.7.8.9.10.11", "en", "b", 1),
        (10, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", "ru", "c", 1), (11, "#### $$$$ 1234", "en", "c", 1), (None, "no id here at all", "en", "c", 1),
    ]
    return rows + [rows[4], rows[7], rows[7]]


def awkward(spark, clash=True):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    if clash:
        for name in ("size", "rank", "host", "spans", "kept", "shard", "_rid", "_u", "node", "root", "fp", "_bucket", "removed", "score"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name, sf=SMALL):
    assert Path(sf).exists()
    return spark.read.parquet(f"{sf}/{name}.parquet")


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)
