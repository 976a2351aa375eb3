"""Documents that the operators' tests share."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts():
    """Nulls, empty and blank texts, copies, near copies, one very long text, odd characters."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(900)}" for _ in range(60_000)]
    passage = " ".join(f"shared{i}" for i in range(70))
    base = [f"term{rng.randrange(400)}" for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    return [
        None,
        "",
        "   \n\t ",
        " ".join(words),
        "Alpha Beta gamma",
        "ALPHA beta GAMMA",
        "alpha beta gamma",
        " ".join(base),
        " ".join(near),
        " ".join(base).upper(),
        f"before {passage} after that",
        f"other {passage} more",
        f"{passage}\n{passage}",
        "same same same same " * 40,
        "line one here\nline one here\n\nline two",
        "ΑΣ Σ İstanbul ﬁne é  nbsp　wide \x1cfs <|endoftext|> it's 'RE 123",
        "a\x00b � 😀😀 naïve",
        "Released under the MIT License. Apache License, Version 2.0; GNU General Public License v3",
        "mit license mit license",
        "x",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts under ascending ids, with columns whose names the operators use themselves."""
    rows = [(i * 3 + 1, t, None, "s", None, "clash", 1) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA + ", kept string, bucket int").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}
