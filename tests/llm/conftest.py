import pytest
from pyspark.sql import types as T

ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    "a b c d e f g h i j k l",
    "é日本 ñ\u00a0x 🙂 " * 40,
    "same words again and again. " * 30,
    "same words again and again. " * 30,
    "# * $ % & | < > " * 20,
    "x" * 5000,
    "line one is here\nline one is here\n\nline one is here\n",
    "<|endoftext|> in the text <|endoftext|>",
    "ABC def GHI jkl\u0000\u0001 mno",
]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark):
    """Odd texts: null, empty, white space, long, equal texts, a repeated row, a null id, columns with names that operators use."""
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "own", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[7], (None, "nobody's words are here", None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, hash int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long"))
