"""A key-value table of JSON values: (note_id, key, value). Writes are set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.operators.index import upsert

MODEL_META = "struct<dim:int,modelVersion:string,embeddingVersion:int,settings:struct<embedTitle:boolean,embedPath:boolean,embedHeading:boolean,embedTags:boolean,includeCode:boolean,minLength:int,maxTokens:int>,epoch:int,contentHash:string,shards:int,updatedAt:string>"
NOTE_META = f"struct<models:map<string,{MODEL_META}>>"


def get(store: DataFrame, key: str, schema: str) -> DataFrame:
    """(note_id, value); a value that doesn't fit the schema is null, a missing one has no row."""
    return store.where(F.col("key") == key).select("note_id", F.from_json("value", schema).alias("value"))


def put(store: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(store, rows.select("note_id", "key", "value"), ["note_id", "key"])


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("note_id", "key").distinct(), ["note_id", "key"], "left_anti")


def note_meta(store: DataFrame, key: str = "meta") -> DataFrame:
    """(note_id, models); malformed metadata counts as none."""
    return get(store, key, NOTE_META).where("value.models is not null").select("note_id", F.col("value.models").alias("models"))


def tolerant_map(c: Column | str) -> Column:
    """A JSON object of strings; anything else is an empty map."""
    return F.coalesce(F.from_json(F.col(c) if isinstance(c, str) else c, "map<string,string>"), F.create_map().cast("map<string,string>"))
