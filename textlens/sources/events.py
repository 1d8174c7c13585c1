"""Event-store reads: filtered scans (S1), typed property extraction
and the stop-word set (S5; ``features.with_grams`` applies one). Events carry their properties as a JSON string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_scan(events: DataFrame, event_names: list[str], entity_col: str = "event_type",
               entity_filter: tuple[str, str] | None = None) -> DataFrame:
    """Events whose name is in ``event_names`` (and, optionally, whose
    ``entity_filter[0]`` column equals ``entity_filter[1]``). Plain
    predicates, so parquet pushes them into the scan."""
    cond = F.col(entity_col).isin(list(event_names))
    if entity_filter is not None:
        cond = cond & (F.col(entity_filter[0]) == F.lit(entity_filter[1]))
    return events.where(cond)


def prop(key: str, dtype: str = "string", props_col: str = "props"):
    """One property read by key with a requested type (NULL when absent)."""
    return F.get_json_object(F.col(props_col), f"$.{key}").cast(dtype)


def stop_words(events: DataFrame, event_name: str, word_key: str, entity_col: str = "event_type",
               props_col: str = "props") -> DataFrame:
    """Distinct words of the stop-word events, ``(word)``."""
    return (event_scan(events, [event_name], entity_col)
            .select(prop(word_key, props_col=props_col).alias("word")).where(F.col("word").isNotNull()).distinct())


def observations_from_events(events: DataFrame, entity_type: str = "user", event_names: tuple = ("$set",),
                             id_col: str = "entity_id", props_col: str = "properties",
                             entity_col: str = "entity_type", event_col: str = "event") -> DataFrame:
    """S1 + S2 + S3 composed: training observations from an event table.

    Keeps events of ``entity_type`` named in ``event_names`` (pushed to the
    scan), reads the ``text`` and ``label`` properties (label as a string) with
    one parse, binarises the label ("1" -> 1.0, else 0.0) and keeps the raw
    string as category. ``doc_id`` is the entity id as it is, a string: "01" and
    "1" are two documents. Every operator takes string ids.
    """
    ev = event_scan(events, list(event_names), event_col, (entity_col, entity_type))
    read = ev.select(F.col(id_col).cast("string").alias("doc_id"),
                     F.from_json(props_col, "label string, text string").alias("_p"))
    return read.select("doc_id", F.when(F.col("_p.label") == "1", F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"),
                       F.col("_p.text").alias("text"), F.col("_p.label").alias("category"))
