"""Containment of any of many forms: an automaton of all of them, built once a worker, and one pass over each text."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_built: dict[int, object] = {}


def contains_any(spark: SparkSession, forms: list[str]) -> Callable[[Column], Column]:
    """A test of a text column: whether one of the forms stands in it; null has none. The forms, of a size that the caller
    has checked, are sent to the workers once."""
    sent = spark.sparkContext.broadcast(forms)
    number = sent._jbroadcast.id()

    @F.arrow_udf(T.BooleanType())
    def found(texts: pa.Array) -> pa.Array:
        if number not in _built:
            import ahocorasick

            _built.clear()
            made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for form in sent.value:
                made.add_word(form)
            made.make_automaton()
            _built[number] = made
        scan = _built[number].iter
        return pa.array([t is not None and next(scan(t), None) is not None for t in texts.to_pylist()], pa.bool_())

    return found
