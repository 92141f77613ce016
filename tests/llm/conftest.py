import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, id long, k long, node string, label string"


def edge_texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = prose(60), "A line that many documents hold."
    long = prose(120)
    near = long.split()
    near[60] = "other"
    out = [None, "", " \t\n ", "one", "one two", "\n\n", passage, passage, passage.upper(), f"{prose(30)} {passage} {prose(30)}", f"{prose(20)}\n{line}\n{prose(20)}\n{line}", f"{prose(10)}\n  {line.upper()} \n", line]
    out += [long, long, " ".join(near), long.replace(" ", "  "), "é" * 300, "a" * 5000, "ab" * 300, "x" * 99, "<|endoftext|> and é日本 \x00\x1c end", "Straße ﬁne", "STRASSE fine"]
    out += [prose(r.randrange(1, 300)) for _ in range(20)]
    return out


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, ""][i % 4], None if t is None else len(t), "r", i, 7, "n", "l") for i, t in enumerate(edge_texts())]
    rows.append((3, "one", "en", "a", 3, "r", 3, 7, "n", "l"))  # a repeated row
    rows.append((None, "a text without an id", "en", "a", 20, "r", 3, 7, "n", "l"))
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
