import pytest

#: Columns that a document table may have besides its own, named like what operators use inside.
EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row int, n int, size int, keep string, digest string, block int, lead int, rep int, shard int, bin_id string, __t string"
LONG = " ".join(f"wort{i % 977} und{i % 13} zahl{i}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, copies, clashing names."""
    same = "the quick brown fox jumps over the lazy dog\nand runs away from here\nthe end of it"
    texts = [(1, None), (2, ""), (3, " \n\t \n"), (4, LONG), (None, same), (5, same), (5, same), (6, same), (7, "one"), (8, "ünï çødé 漢字 \U0001f600 text\0with nul\n\n\nlines"), (None, None), (9, same + "\r"), (10, "one")]
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "src", None, "x", 1, 2, 3, "y", None, 4, 5, 6, 7, "b", None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
