"""Windows event XML: one ``<Event>`` per row becomes a field map with ``Content``."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree.ElementTree import Element, ParseError, fromstring

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import written

NO_ENTRIES = "array<struct<key:string,value:string>>"
EVENT = f"system {NO_ENTRIES}, data {NO_ENTRIES}"


def read_event_files(spark: SparkSession, path: str, tag: str = "Event") -> DataFrame:
    """One row ``event`` per event of XML files, parsed; files are split at the end tags of ``tag``."""
    records = spark.read.text(path, lineSep=f"</{tag}>").select(
        F.concat(F.regexp_extract("value", rf"(?s)<{tag}(?=[\s>]).*", 0), F.lit(f"</{tag}>")).alias("xml")
    )
    return records.filter(F.col("xml").startswith(f"<{tag}")).select(parse_event("xml").alias("event"))


def local_name(name: str) -> str:
    return name.rpartition("}")[2]


def cleaned(text: str) -> str:
    return text.replace("\n", "").replace("\r", "").strip()


def system_entries(element: Element) -> Iterator[tuple[str, str]]:
    """Text of every child when there is any (attributes then go), else its attributes, each by name."""
    for child in element:
        tag = local_name(child.tag)
        if child.text:
            yield tag, cleaned(child.text)
        else:
            for name, value in child.attrib.items():
                yield f"{tag}_{local_name(name)}", cleaned(value)


def data_entries(element: Element) -> Iterator[tuple[str, str]]:
    """The named Data children with a value."""
    for child in element:
        name, value = child.attrib.get("Name"), cleaned(child.text or "")
        if local_name(child.tag) == "Data" and name and value:
            yield name, value


def entry_lists(rows: list[list[tuple[str, str]]]) -> pa.ListArray:
    flat = [e for row in rows for e in row]
    parts = [pa.array([e[k] for e in flat], pa.string()) for k in (0, 1)]
    offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["key", "value"]))


def entries_of(xml: pa.Array) -> pa.Array:
    found: dict[str, list] = {"System": [], "EventData": []}
    for text in xml.to_pylist():
        try:
            root = fromstring(text or "")
        except ParseError:
            root = ()
        parts = {local_name(child.tag): child for child in reversed(root)}  # the first of each name
        for name, told in (("System", system_entries), ("EventData", data_entries)):
            found[name].append(list(told(parts[name])) if name in parts else [])
    return pa.StructArray.from_arrays([entry_lists(rows) for rows in found.values()], ["system", "data"])


def parse_event(xml: Column | str) -> Column:
    """``system`` and ``data``: (key, value) entries of all children of System and of the named Data, in order.

    ``from_xml`` needs the names beforehand, or guesses types and loses leading zeros as a variant, so
    the markup is parsed in Arrow batches.  Null and text that is no XML have no entries.
    """
    return F.arrow_udf(entries_of, EVENT)(F.col(xml) if isinstance(xml, str) else xml)


def _entry(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), value.alias("value"))


def _joined(entries: Column, separator: str) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), separator)


def event_fields(events: DataFrame, event: str = "event") -> DataFrame:
    """Replace the parsed event by ``fields``: a map of System fields, EventData fields and
    ``Content`` (``name=value`` joined by ``|``)."""
    data = F.col(event)["data"]
    content = F.array(_entry("Content", _joined(data, "|")))
    return _to_map(events.withColumn("_entries", F.concat(F.col(event)["system"], data, content))).drop(event)


def event_fields_channel_in_content(events: DataFrame, event: str = "event") -> DataFrame:
    """Older form: Channel leads the ``;``-joined ``Content`` and EventData makes no fields."""
    of_channel = lambda e: e["key"] == "Channel"
    system = F.col(event)["system"]
    head = F.slice(F.reverse(F.filter(system, of_channel)), 1, 1)  # the last, if any
    content = F.array(_entry("Content", _joined(F.concat(head, F.col(event)["data"]), ";")))
    return _to_map(events.withColumn("_entries", F.concat(F.filter(system, lambda e: ~of_channel(e)), content))).drop(event)


def _to_map(df: DataFrame) -> DataFrame:
    """Map from entries; of a repeated key the last value stays."""
    entries = F.col("_entries")
    keys = F.transform(entries, lambda e: e["key"])
    repeated = F.size(F.array_distinct(keys)) < F.size(entries)
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda l: l["key"] == e["key"])
    last = F.filter(entries, lambda e, i: ~later(e, i))
    fields = F.map_from_entries(F.when(repeated, last).otherwise(entries))
    return df.withColumn("fields", fields).drop("_entries")


def field_names(records: DataFrame, fields: str = "fields", common: bool = True) -> DataFrame:
    """Names every record has (or, with ``common=False``, that any record has), plus ``Content``."""
    names = (
        records.select(F.explode(F.map_keys(fields)).alias("field"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    if common:
        total = records.agg(F.count(F.lit(1)).alias("n"))
        names = names.filter((F.col("_n") == total.scalar()) | (F.col("field") == "Content"))
    return names.select("field")


def records_to_columns(records: DataFrame, names: list[str], fields: str = "fields") -> DataFrame:
    """One string column per name, ``""`` where a record lacks it."""
    wide = [F.coalesce(F.col(fields)[n], F.lit("")).alias(n) for n in names]
    return records.select(*[c for c in records.columns if c != fields], *wide)


def common_table(records: DataFrame, fields: str = "fields", common: bool = True) -> DataFrame:
    """Records as a table over the shared (or all) field names; only the names reach the driver."""
    stored = written(records, "records")
    names = sorted(r["field"] for r in field_names(stored, fields, common).collect())
    return records_to_columns(stored, names, fields)
