import pytest

AWKWARD = [
    (1, "The cat sat on the mat and the dog lay by the door of the house near the old mill in the small town by the sea " * 4, "en"),
    (2, "The cat sat on the mat and the dog lay by the door of the house near the old mill in the small town by the sea " * 4, "en"),
    (3, None, "en"), (4, "", None), (5, " \t\n ", "de"), (6, "word", "en"), (7, "two words", None),
    (8, "né à l'été 🙂 ça où\n\né\n\u2028x \x1c y\xa0z", "fr"), (9, "x" * 200_000, "en"), (10, "a b\n" * 30_000, "de"),
    (11, "***### $$$ !!!", "en"), (12, "1234 5678", "de"), (None, "a text without an id", "en"), (None, None, None),
    (6, "word", "en"), (13, "<|endoftext|> and  two  spaces \n\n  end ", "en"),
]


@pytest.fixture
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and extra columns with names operators use."""
    rows = [(i, t, y, "s", 0, 9, "k", 1.5, 2) for i, t, y in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, "
                                       "key string, score double, n long")


@pytest.fixture
def nothing(awkward):
    return awkward.where("false")
