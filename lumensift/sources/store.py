"""The chunk store: Parquet in buckets of attachments, in versions behind a pointer.

A replacement rewrites only the buckets that hold the attachments concerned. A version is a
numbered file that lists, for every bucket, where its rows lie. It is made new, never replaced,
after all of the version's files are written, and the highest number that is whole counts; so a
reader sees either version whole, and a crash at any point leaves the old one in place. Two writers
at once cannot both make the same number: the later one gets a ConcurrentWrite and nothing is lost.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.io import settle
from lumensift.schemas import STORED, struct


class ConcurrentWrite(RuntimeError):
    """Another writer published a version since this one read the store; read again and repeat."""


class ChunkStore:
    """`buckets` is the number of a store made anew; one that is there keeps its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.fresh = spark, path.rstrip("/"), buckets

    @property
    def buckets(self) -> int:
        return self._state()["buckets"]

    # pointer: {"version": n, "buckets": n, "places": {bucket: folder}}
    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, path) of all pointer files, highest first."""
        fs, jvm = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT-*"))
        return sorted(((int(f.getPath().getName().split("-")[1]), f.getPath().toString()) for f in found or []), reverse=True)

    def _state(self) -> dict:
        fs, jvm = self._fs()
        for _, path in self._pointers():
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(path))
            try:
                return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:  # its writer died, or is still at it
                continue
            finally:
                stream.close()
        return {"version": 0, "buckets": self.fresh, "places": {}}

    def _switch(self, state: dict, places: dict[str, str]) -> None:
        """Publish `places` as the version after `state`."""
        if self._state()["version"] != state["version"]:
            raise ConcurrentWrite(self.path)
        fs, jvm = self._fs()
        number = max([state["version"], *(n for n, _ in self._pointers()[:1])]) + 1
        try:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT-{number:012d}"), False)
        except Exception as e:  # noqa: BLE001 - the file system's own error for a file that is there
            raise ConcurrentWrite(self.path) from e
        out.write(bytearray(json.dumps({"version": number, "buckets": state["buckets"], "places": places}).encode()))
        out.close()

    @staticmethod
    def _bucket(buckets: int):
        return F.pmod(F.xxhash64("attachment_key"), F.lit(buckets)).cast("int")

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = sorted({p for b, p in state["places"].items() if buckets is None or int(b) in buckets})
        if not paths:
            return self.spark.createDataFrame([], struct(STORED))
        return self.spark.read.schema(struct(STORED)).parquet(*paths)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        return self._rows(self._state(), buckets)

    def _write(self, state: dict, rows: DataFrame, touched: list[int]) -> None:
        places = dict(state["places"])
        version = f"{self.path}/data/{uuid.uuid4().hex}"
        # One shuffle brings a bucket together; only touched buckets are written.
        rows.withColumn("bucket", self._bucket(state["buckets"])).repartition("bucket").write.partitionBy("bucket").parquet(version)
        fs, jvm = self._fs()
        for b in touched:
            folder = f"{version}/bucket={b}"
            if fs.exists(jvm.org.apache.hadoop.fs.Path(folder)):
                places[str(b)] = folder
            else:
                places.pop(str(b), None)
        self._switch(state, places)

    def _touched(self, state: dict, keys: DataFrame) -> list[int]:
        return [r.b for r in keys.select(self._bucket(state["buckets"]).alias("b")).distinct().collect()]

    def replace_attachments(self, new: DataFrame, of: DataFrame | None = None) -> None:
        """The rows of `new` in place of all rows of its attachments (or of those in `of`). Nothing to store leaves old rows alone.

        `new` is worked out once (it may come from a model), though it is read twice.
        """
        state, rows = self._state(), settle(_stored(new))
        keys = settle((of if of is not None else rows).select("attachment_key").distinct())
        touched = self._touched(state, keys)
        if touched:
            kept = self._rows(state, touched).join(keys, "attachment_key", "left_anti")
            self._write(state, kept.unionByName(rows), touched)

    def add(self, new: DataFrame) -> None:
        state, rows = self._state(), settle(_stored(new))
        touched = self._touched(state, rows)
        if touched:
            self._write(state, self._rows(state, touched).unionByName(rows), touched)

    def delete_ids(self, ids: list[str]) -> None:
        """No ids, nothing done. An id names its attachment, so only that bucket is read; ids of another form are looked for everywhere."""
        if not ids:
            return
        state = self._state()
        named = [i.rsplit(":", 2)[0] for i in ids if i.count(":") >= 2]
        if len(named) == len(ids):
            gone = self.spark.createDataFrame([(k,) for k in sorted(set(named))], "attachment_key string")
        else:
            gone = self._rows(state).filter(F.col("chunk_id").isin(ids)).select("attachment_key").distinct()
        touched = self._touched(state, gone)
        if touched:
            self._write(state, self._rows(state, touched).filter(~F.col("chunk_id").isin(ids)), touched)

    def delete_attachments(self, keys: DataFrame) -> None:
        state = self._state()
        touched = self._touched(state, keys)
        if touched:
            self._write(state, self._rows(state, touched).join(keys.select("attachment_key"), "attachment_key", "left_anti"), touched)

    def reset(self) -> None:
        self._switch(self._state(), {})

    def count(self) -> int:
        return self.read().count()

    def by_citation_key(self, key: str) -> DataFrame:
        return self.read().filter(F.col("citation_key") == key)

    def by_attachment(self, key: str) -> DataFrame:
        """An attachment's chunks, from its one bucket."""
        state = self._state()
        b = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(key)), F.lit(state["buckets"])).cast("int")).first()[0]
        return self._rows(state, [b]).filter(F.col("attachment_key") == key)

    def ids_of(self, key: str) -> DataFrame:
        return self.by_attachment(key).select("chunk_id")

    def texts(self) -> DataFrame:
        """Everything but the vectors."""
        return self.read().drop("embedding")


def _stored(rows: DataFrame) -> DataFrame:
    """Rows in the stored schema; missing strings are '', missing years 0."""
    out = []
    for f in struct(STORED):
        if f.name not in rows.columns:
            value = F.lit({"year": 0}.get(f.name, "" if f.dataType.typeName() == "string" else None)).cast(f.dataType)
        else:
            value = F.col(f.name).cast(f.dataType)
            value = F.coalesce(value, F.lit("")) if f.name in ("citation_key", "title", "authors", "doi") else value
        out.append(value.alias(f.name))
    return rows.select(*out)


def stale_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that a replacement drops."""
    return old.select("chunk_id").distinct().join(new.select("chunk_id"), "chunk_id", "left_anti")
