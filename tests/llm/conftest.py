import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    def make(rows, schema=DOC_SCHEMA):
        return spark.createDataFrame(rows, schema)

    return make


#: Texts that every operator must take: empty, spaces only, one word, long, without spaces, odd characters.
TEXTS = [None, "", " \n\t ", "one", "two words", "Straße naïve 日本語 👍 é", "a" * 30_000, "x y " * 20_000, "\x00\x85  end", "'ll 've 1st!? <|endoftext|> </turn>",
         "the cat sat on the mat and the dog lay by the door of the old house near the long river"]


@pytest.fixture(scope="module")
def odd(docs):
    """Nulls everywhere, repeated rows and ids, ties."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    return docs(rows + [rows[3], rows[10], (None, TEXTS[10], None, None, None), (None, None, None, None, None), (50, TEXTS[10], None, "s", 1)])


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns with names that operators use themselves."""
    names = ["id", "fp", "a", "b", "anchor", "seg", "root", "node", "component", "key", "row", "nth", "part", "start", "n", "ids", "v", "dim", "rank", "score", "kept", "counts"]
    df = docs([(1, "some words that are here for the test", "en", "s", 37), (2, "other words of another text", "de", "s", 27)])
    return df.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
