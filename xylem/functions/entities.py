"""Entity expansion of stand-alone texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.parser import Entities, XmlProblem


def expand_entities(text: Column, names: dict[str, str] | None = None, max_depth: int = 512, max_size: int = 10 * 1024 * 1024) -> Column:
    """Predefined, numeric and the given named references expanded; a text that can't be expanded, or a null one, gives null.

    Texts without a reference never leave the JVM's value: only those with one are worked on, in Arrow batches.
    """
    given = dict(names or {})

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        entities = Entities(max_depth, max_size)
        entities.names |= given

        def one(t: str | None) -> str | None:
            try:
                return None if t is None else entities.expand(t)
            except XmlProblem:
                return None

        return texts.map(one)

    return F.when(~F.contains(text, F.lit("&")), text).otherwise(run(text))
