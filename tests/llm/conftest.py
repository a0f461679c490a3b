import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ("key", "fp", "score", "size", "n_words", "places", "name", "place", "hash", "node", "root", "u", "v", "label", "features", "bucket", "id", "n", "spans", "copies", "target", "digest", "__label", "least")

_PASSAGE = " ".join(f"shared{i}" for i in range(60))
_LONG = " ".join(f"w{i % 9973}x{i % 31}" for i in range(60_000))


def odd_rows():
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows."""
    plain = " ".join(f"word{i}" for i in range(120))
    near = plain.replace("word60 ", "other ")
    rows = [
        (1, plain, "en", "a", 1), (2, plain, "en", "a", 1), (3, near, "en", "b", 1), (4, None, "en", "b", 0), (5, "", None, None, None), (6, " \n\t ", "en", "c", 1), (7, _LONG, "en", "c", 1), (8, _LONG + " end", "en", None, 1),
        (None, "a row without id " + _PASSAGE, "en", "a", 1), (9, "before " + _PASSAGE + " after", "fr", "a", 1), (10, _PASSAGE, "de", "é", 1), (10, _PASSAGE, "de", "é", 1), (10, "same id, other text", "de", "é", 1),
        (11, "One line\nanother line\nthird line\n\nfifth\nsixth\nseventh\neighth", "en", "z", 1), (12, "One line\nanother line\nthird line\n\nfifth\nsixth\nseventh\neighth\nlast", "en", "z", 1), (13, "!!", "en", "z", 1), (14, "x", "en", "z", 1),
        (15, "日本語 テキスト   é ß " + plain, "ja", "z", 1), (16, "<|endoftext|> inside  two  spaces \x01", "en", "z", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def benchmark_rows():
    return [(1, "word10 word11 word12 word13 word14 word15 word16 word17 word18 word19 word20"), (2, None), (3, ""), (4, "One LINE"), (None, "shared1 shared2 shared3"), (10, "never seen anywhere else at all in any of these documents"), (4, "One LINE")]


@pytest.fixture(scope="session")
def benchmark(spark, benchmark_rows):
    return spark.createDataFrame(benchmark_rows, "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), 0) for i in range(1, 16)] + [(None, 1, 0), (3, None, None), (1, 1, 0), (1, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
