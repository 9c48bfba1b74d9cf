import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(40_000))
    rows = [
        (1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, "one", None), (5, "ONE two", None), (6, long, "x"), (6, long, "x"),
        (7, "Ünïcode ñandú 漢字 😀́ a'b's 12 345", None), (None, "no id here", None), (8, "x" * 30_000, None), (9, "a  b \n\n c d e\x1cf\x85g  ", None), (9, "other text, same id", None),
    ]
    rows = [(d, t, e, e, e, e, e, e) for d, t, e in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, __text string, score string, n_words string, ids string, kept string, component_id string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id = -1")
