"""Pluggable reviewers: names and suspect rows are sent to a client, verdicts are joined back."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow import schema

#: Takes sorted distinct names and returns a reply: JSON, perhaps in a code fence.
Client = Callable[[list[str]], str]


def reply_map(reply: str) -> dict[str, str]:
    """The JSON object of a reply; empty if there is none."""
    try:
        found = json.loads(re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", reply))
    except ValueError:
        return {}
    return {str(k): str(v) for k, v in found.items()} if isinstance(found, dict) else {}


def map_names(df: DataFrame, column: str, client: Client | None = None) -> DataFrame:
    """(name, mapped): each distinct name is asked once; without a client nothing is mapped."""
    names = df.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answer = reply_map(client(sorted(frame["name"]))) if client and len(frame) else {}
            yield frame.assign(mapped=[answer.get(n) for n in frame["name"]])

    return names.mapInPandas(run, "name string, mapped string")


def suspects(df: DataFrame, most: int, order: str = "_seq") -> DataFrame:
    """The first ``most`` rows with a suspect flag."""
    flags = [schema.SUSPECT_RANGE, schema.SUSPECT_OUTLIER, schema.SUSPECT_CONSISTENCY]
    return df.where(F.col("quality_flag").isin(flags)).orderBy(order).limit(most)


def apply_verdicts(df: DataFrame, verdicts: DataFrame, key: str = "_seq") -> DataFrame:
    """Rows judged valid become so with the greater confidence; rejected ones with at most 1 less it.

    ``verdicts`` has the key, verdict (valid, reject or another) and certainty.
    """
    v, c = F.col("_verdict"), F.col("_certainty")
    joined = df.join(verdicts.select(key, F.col("verdict").alias("_verdict"), F.col("certainty").alias("_certainty")), key, "left")
    return joined.withColumns(
        {
            "quality_flag": F.when(v == "valid", schema.VALID).when(v == "reject", schema.REJECTED).otherwise(F.col("quality_flag")),
            "confidence": F.when(v == "valid", F.greatest("confidence", c)).when(v == "reject", F.least(F.col("confidence"), 1 - c)).otherwise(F.col("confidence")),
        }
    ).drop("_verdict", "_certainty")
