import os
import random

import pytest
from pyspark.sql import functions as F

from lustra.llm import queries

SCHEMA = "doc_id long, text string, source string, score double, shard string, block string, row string"


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_library(spark):
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(
        x for x in (os.environ.get("PYTHONPATH", ""), queries.LIBRARY_HOME) if x
    )


def make_texts():
    """Texts with copies, near copies, shared passages, short, empty, blank, null and long ones."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice(["th", "on", "er", "A", "é", "st"]) for _ in range(draw.randint(1, 4)))
    texts = [" ".join(word() for _ in range(draw.randint(1, 90))) for _ in range(60)]
    passage = " ".join(word() for _ in range(25))
    texts += [f"{t}\n{passage} {word()}" for t in texts[:8]]
    for t in texts[:6]:
        words = t.split(" ")
        texts += [t, t, " ".join([*words[:-1], word()]), t.upper()]
    return [*texts, None, "", " \t\n ", "one", "a b c", "a b c d", "\u2003x", "x" * 50_000, " ".join(word() for _ in range(4000))]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names operators use themselves."""
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", 0.5, "z", "z", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter(F.lit(False))
