import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, rank long, key string, h long, n long, place int, first int, slot long, block long, epoch long, start long, kind string, ids string, kept_doc_id long, shard int, `row` int, a long, b long, __source string, __order string, __bucket string, __slot long, __drop long, `drop` long, source_ string, s string, of string, at array<long>, part int, used long, place_ long"
LONG = "lorem ipsum dolor sit amet 12 " * 20_000


def row(i, text, lang="en", source="web"):
    return (i, text, lang, source, None if text is None else len(text), *([7] * 2), "k", *([7] * 2), 1, 1, *([7] * 4), "k", "x", 7, 1, 1, 7, 7, "s", "o", "b", 7, 7, 7, "s", "s", "o", [7], 1, 7, 7)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        row(1, "a b c"), row(1, "a b c"), row(2, None), row(3, ""), row(4, "   \n\t"), row(None, "a b c"), row(None, None),
        row(5, LONG), row(6, "?!... ---"), row(7, "Ünïcödé 你好 \U0001f600 é"), row(8, "x"), row(9, "a b c", None, None), row(10, "word " * 30, "", ""), row(11, "\x00\x01 ctrl"),
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
