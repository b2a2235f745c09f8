"""Streaming forms of ingest, positions, volumes, sessions and the story tracker.

Every stateful step is bounded: by a watermark, by an event-time window, or by a time to live inside the state.
"""

import json
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from riskfabric.operators.store import latest_per_key


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A landed Parquet table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1000).parquet(folder)


def ingest_batch(keys, order):
    """Reduce a micro-batch to one row per key before it is written."""
    return lambda batch: latest_per_key(batch, list(keys), list(order))


def distinct_positions(stream: DataFrame, delay="30 minutes") -> DataFrame:
    """One row per (entity, observation time); keys are forgotten after the watermark."""
    return stream.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["mmsi", "observed_at"])


def latest_by_slot(stream: DataFrame, slot="30 minutes", delay="30 minutes") -> DataFrame:
    """Newest row per entity and time slot; state of a slot is dropped once the watermark has passed it."""
    rest = [c for c in stream.columns if c != "mmsi"]
    return (stream.withWatermark("observed_at", delay).groupBy("mmsi", F.window("observed_at", slot).alias("slot"))
            .agg(F.max_by(F.struct(*rest), F.struct("observed_at", "event_id")).alias("r")).select("mmsi", "r.*"))


def volume_per_window(stream: DataFrame, size="1 day", delay="30 minutes") -> DataFrame:
    return (stream.withWatermark("ts", delay).groupBy("country", "category", F.window("ts", size).alias("w"))
            .agg(F.count("*").alias("n")).select("country", "category", F.col("w.start").alias("window_start"), "n"))


def episodes(stream: DataFrame, gap="6 hours", delay="30 minutes") -> DataFrame:
    """Active episodes of an entity: sessions separated by ``gap``."""
    return (stream.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n"))


STATIC_FIELDS = ["ship_name", "vessel_type", "imo", "call_sign", "destination"]
MERGED = "mmsi string, event_id bigint, latitude double, longitude double, observed_at timestamp, " + ", ".join(f"{f} string" for f in STATIC_FIELDS)


class StaticMerge(StatefulProcessor):
    """Positions take the last static record of their vessel; a static record rewrites the latest position.

    State per vessel is one static record and one position.
    """

    def init(self, handle):
        self.static = handle.getValueState("static", "fields string")
        self.position = handle.getValueState("position", "row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        static = json.loads(self.static.get()[0]) if self.static.exists() else {}
        position = json.loads(self.position.get()[0]) if self.position.exists() else None
        frame = pd.concat(list(rows)).sort_values(["observed_at", "event_id"])
        out = []
        for row in frame.to_dict("records"):
            if row["kind"] == "static":
                static = {f: row[f] for f in STATIC_FIELDS if row[f]}
                if position is None:
                    continue
                position.update(static)
            else:
                position = {"mmsi": key[0], "event_id": int(row["event_id"]), "latitude": row["latitude"], "longitude": row["longitude"],
                            "observed_at": row["observed_at"].isoformat(), **{f: row[f] or "" for f in STATIC_FIELDS}, **static}
            out.append(dict(position))
        self.static.update((json.dumps(static),))
        if position is not None:
            self.position.update((json.dumps(position),))
        if out:
            merged = pd.DataFrame(out)
            merged["observed_at"] = pd.to_datetime(merged["observed_at"], format="ISO8601")
            yield merged[["mmsi", "event_id", "latitude", "longitude", "observed_at", *STATIC_FIELDS]]

    def close(self):
        pass


def merge_static(stream: DataFrame) -> DataFrame:
    return stream.groupBy("mmsi").transformWithStateInPandas(StaticMerge(), MERGED, "append", "None")
