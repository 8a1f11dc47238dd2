import datetime as dt

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, extra=None):
        rows = [(k if ids is None else ids[k], t, "en" if k % 2 else None, "src0", len(t or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


EDGE_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "  two  spaces \n and\ttabs  ",
    "naïve café — “quotes” …  ",
    "word " * 3000,
    "x" * 20000,
    "<|endoftext|> in <|endoftext|>the middle",
    "it's we've I'm 123 4.5 !!! ###",
    "a\x1cb\x85c d\xa0 e　f",
    "same text here", "same text here",
    "日本語のテキスト with emoji 😀 👩‍👩‍👧",
]


@pytest.fixture(scope="session")
def edge_texts():
    return EDGE_TEXTS
