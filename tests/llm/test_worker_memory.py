"""Memory that one worker takes for a batch of long texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corpuslint.llm import langid


class Caught(Exception):
    pass


class Docs:
    """Stands in for a table and catches the function that would run in the workers."""

    schema: list = []

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        raise Caught(function)


def texts(n=40, letters=150_000):
    rng = random.Random(5)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=letters)) for _ in range(n)]


def no_tables(langs=2):
    nothing, empty = np.zeros(0, np.uint64), np.zeros((0, langs), np.float32)
    return [
        {"order": o, "hashes": nothing, "logs": empty, "pass_hashes": nothing, "passes": empty}
        for o in range(langid.ORDER, 0, -1)
    ]


@pytest.mark.parametrize("step", ["counts", "scores"])
def test_language_id_takes_bounded_memory_a_batch(spark, step):
    rows = texts()
    with pytest.raises(Caught) as caught:
        if step == "counts":
            langid.gram_counts(Docs(spark))
        else:
            langid.cross_entropies(Docs(spark), no_tables(), ["a", "b"], "doc_id")
    first = pa.array(["a"] * len(rows)) if step == "counts" else pa.array(range(len(rows)), pa.int64())
    batch = pa.record_batch([first, pa.array(rows)], names=["lang" if step == "counts" else "doc_id", "text"])
    run = caught.value.args[0]
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000
