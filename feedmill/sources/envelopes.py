"""Another feed's envelopes as a Spark data source: ``spark.read.format("envelopes").load(folder)``."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, id string, url string, title string, published_at string, headline string, brief string, abstract string"


class EnvelopeSource(DataSource):
    """Rows of the items in a folder's envelopes (JSON files), a partition for each file; items without url are left out, and so are files that are no JSON."""

    @classmethod
    def name(cls) -> str:
        return "envelopes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EnvelopeReader:
        return EnvelopeReader(self.options["path"])


class EnvelopeReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(path) for path in sorted(glob.glob(f"{self.folder}/*.json"))]

    def read(self, partition: InputPartition):
        try:
            with open(partition.value, encoding="utf-8") as f:
                items = json.load(f).get("items") or []
        except (ValueError, AttributeError):
            return
        for item in items:
            if item.get("url"):
                told = item.get("renditions") or {}
                text = [(told.get(k) or {}).get("text") for k in ("headline", "brief", "abstract")]
                yield (os.path.basename(partition.value), item.get("id"), item["url"], item.get("title"), item.get("published_at"), *text)
