import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from texts import words  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use for columns of their own.
CLASHING = "digest keep_id group_size kept mark node key w0 mask block rest part tie lent salt rank before length piece n ids letters ll said number x _dropped _rejected".split()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and copies."""
    r = random.Random(11)
    base = [words(r, 120) for _ in range(12)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(20 + k, t.replace(" ", " \t\n", 5), "en", "s0", 1) for k, t in enumerate(base[:4])]  # equal but for white space
    rows += [(30 + k, t + " " + words(r, 2), None, None, None) for k, t in enumerate(base[:4])]  # near copies
    rows += [(40, None, None, None, None), (41, "", "en", "s1", 0), (42, " \n\t ", "de", None, 4), (43, None, "en", "s1", None)]
    rows += [(50, "one", "en", "s1", 3), (51, "one two", "en", "s1", 7), (52, "é 中 \U0001f600 <|endoftext|> ' 's", "fr", "s2", 12)]
    rows += [(60, words(r, 30_000), "en", "s1", 1), (61, "a" * 70_000 + " " + "ab" * 20_000, "en", "s1", 1)]
    rows += [(None, base[5], "en", "s0", 1), (None, "only here, without an id " + words(r, 20), "en", "s0", 1)]
    rows += [rows[0], rows[0], (1, words(r, 40), "en", "s0", 9)]  # repeated rows, and an id with two texts
    passage = words(r, 30)
    rows += [(70 + k, f"{words(r, 10)} {passage} {words(r, 10)}", "en", "s0", 1) for k in range(6)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, COLUMNS).repartition(3)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def rows_of(spark, sf):
    def get(name, columns):
        return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]

    return get


@pytest.fixture
def second_writer():
    """Let another writer commit just before the next commit of ``commits``."""

    def between(commits, other):
        own = commits.commit

        def commit(*args):
            commits.commit = own
            other()
            return own(*args)

        commits.commit = commit

    return between
