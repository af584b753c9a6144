import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string, cls string"
PROSE = "the cat and the dog sat on the mat with a bird in the sun and it was good to be there for the day as they had been before when the rain was gone from the land "
LONG = " ".join(f"word{i} of the long text" for i in range(4000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, PROSE * 2, "en", "a", 1, True, "x", "y"),
        (2, PROSE * 2, "en", "a", 1, True, "x", "y"),
        (2, PROSE * 2, "en", "a", 1, True, "x", "y"),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, False, "", ""),
        (5, " \n\t ", "de", None, 3, None, None, None),
        (6, "three words only", None, "b", 1, None, None, None),
        (7, LONG, "en", "a", 1, None, None, None),
        (8, LONG + " end", "en", "a", 1, None, None, None),
        (None, PROSE, "en", "a", 1, None, None, None),
        (9, "12 34 ### $$$", "de", "c", 1, None, None, None),
        (10, "der hund und die katze " * 10 + "\n" + "der hund und die katze " * 10, "de", "c", 1, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
