"""A text index in a folder: documents are added in segments, and a commit makes what was added and deleted visible.

The last version in meta/ names the segments and the tables of deleted ids that belong to the index, each with the turn
in which it came. A version comes whole or not at all, so a job that dies half way leaves files that no reader looks at.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from quillon.config import TextConfig
from quillon.errors import CollectionExists, CollectionNotFound, ConcurrentChange
from quillon.operators.fts import TextIndex
from quillon.sources.storage import Storage, Versions


class TextStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.storage = spark, path.rstrip("/"), Storage(spark)
        self.versions = Versions(self.storage, f"{self.path}/meta")
        self.reload()

    @staticmethod
    def create(spark: SparkSession, path: str, fields: dict[str, str], config: TextConfig = TextConfig(), stored: list[str] | None = None) -> "TextStore":
        storage, path = Storage(spark), path.rstrip("/")
        meta = {"fields": fields, "config": asdict(config), "stored": stored or [], "segments": [], "deleted": [], "turn": 0}
        try:
            Versions(storage, f"{path}/meta").commit(0, json.dumps(meta))
        except ConcurrentChange as e:
            raise CollectionExists(path) from e
        return TextStore(spark, path)

    def reload(self) -> None:
        """Takes up what others have committed; own additions that are not committed are forgotten."""
        found = self.versions.read()
        if found is None:
            raise CollectionNotFound(self.path)
        self.number, self.seen = found
        self.meta = json.loads(self.seen)
        config = self.meta["config"]
        self.config = TextConfig(**(config | {"fields": tuple(config["fields"])}))

    rollback = reload

    def add(self, docs: DataFrame) -> None:
        """Documents (id, the fields' columns) as a segment, from the next commit on. Ids are not checked for repeats."""
        name = uuid.uuid4().hex
        self.meta["turn"] += 1
        TextIndex.build(docs, self.meta["fields"], config=self.config, stored=self.meta["stored"]).write(f"{self.path}/segments/{name}")
        self.meta["segments"].append([name, self.meta["turn"]])

    def delete(self, ids: DataFrame) -> None:
        """The documents of ids (id) that were added before are gone from the next commit on."""
        name = uuid.uuid4().hex
        self.meta["turn"] += 1
        ids.select("id").distinct().write.parquet(f"{self.path}/deleted/{name}")
        self.meta["deleted"].append([name, self.meta["turn"]])

    def commit(self) -> None:
        """Raises ConcurrentChange if another writer has committed since the last reload."""
        new = json.dumps(self.meta)
        self.number = self.versions.commit(self.number, new)
        self.seen = new

    def _segment(self, name: str, turn: int, deleted: list) -> TextIndex:
        index = TextIndex.read(self.spark, f"{self.path}/segments/{name}", self.config, bool(self.meta["stored"]))
        later = [f"{self.path}/deleted/{n}" for n, t in deleted if t > turn]
        return index.delete(self.spark.read.parquet(*later)) if later else index

    def index(self) -> TextIndex:
        """What is committed, as one index."""
        meta = json.loads(self.seen)
        parts = [self._segment(name, turn, meta["deleted"]) for name, turn in meta["segments"]]
        if not parts:
            empty = self.spark.createDataFrame([], "id string, " + ", ".join(f"`{c}` string" for c in dict.fromkeys([*self.meta["fields"].values(), *self.meta["stored"]])))
            return TextIndex.build(empty, self.meta["fields"], config=self.config, stored=self.meta["stored"])
        if len(parts) == 1:
            return parts[0]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.add(p)
        return whole

    def num_docs(self) -> int:
        return self.index().num_docs()

    def optimize(self) -> None:
        """Merges the committed segments to one without the deleted documents, and commits."""
        self.reload()
        old = self.meta["segments"], self.meta["deleted"]
        if len(old[0]) < 2 and not old[1]:
            return
        name = uuid.uuid4().hex
        self.index().write(f"{self.path}/segments/{name}")
        self.meta.update(segments=[[name, self.meta["turn"]]], deleted=[])
        self.commit()
        for kind, names in zip(("segments", "deleted"), old):
            for x, _ in names:
                self.storage.delete(f"{self.path}/{kind}/{x}")
