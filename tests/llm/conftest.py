import glob
import os

import duckdb
import pytest

#: Words of the contracts: runs of anything but these.
SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    """doc_id -> text of the smallest table."""
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n_words string, token string, hub int, component int, h string, pos int, n_tokens string, _n string, _doc int, _runs string, _weight string, _cut int, _source string, _passes int, _spans string, doc string, id string, row int, spans int, dropped_runs int, digest int, epoch string, weight int"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like the operators' own."""
    line = "this line is long enough to be a key of the line dedup operator here"
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, None, "en", "web", 0, None, None, None, None, None, None, None, None),
        (2, "", "en", None, 0, True, "x", "t", 1, 1, "h", 1, "1"),
        (3, long, None, "web", len(long), False, "x", "t", 1, 1, "h", 1, "1"),
        (4, " \t\n ", "en", "web", 4, True, "x", "t", 1, 1, "h", 1, "1"),
        (5, "naïve Überraschung 漢字 😀   x", "de", "web", 30, True, "x", "t", 1, 1, "h", 1, "1"),
        *[(10 + i, f"{line}\nown line number {i}\n\n{line.upper()}  ", "en", "web", 100, True, "x", "t", 1, 1, "h", 1, "1") for i in range(7)],
        *[(20, "a row that stands here twice with one id and with one text only", "en", "web", 60, True, "x", "t", 1, 1, "h", 1, "1")] * 2,
        (None, f"{line}\nno id here", "en", "web", 60, True, "x", "t", 1, 1, "h", 1, "1"),
        (None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    more = ("n", 1, "r", "w", 1, "s", 1, "sp", "d", "i", 1, 1, 1, 1, "e", 1)
    return spark.createDataFrame([r + more for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
