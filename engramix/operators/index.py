"""A stored search index that follows its chunks: segments of postings, rows that are gone, and a log of versions.

A refresh compares the hash of every chunk with what the index holds and writes one segment with the postings of new and
changed chunks, the places of those that went, and the sums that BM25 needs; nothing else is rewritten. A version names its
segments and the content they stand for; it is put in place by creating a file that must not exist yet, so of two writers
one fails and readers see whole versions only. Searches read the folders of their terms, and ask for the content they
search: an index of other content is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.operators import search
from engramix.storage import dealt

#: Folders of a segment's postings, by term.
PARTS = 32
#: Segments beyond which a refresh writes a whole one.
MERGE = 8


class LostRace(RuntimeError):
    """Another writer has put this version in place first."""


def content_of(spark: SparkSession, path: str) -> str:
    """A hash of names, lengths and times of all files of a table: another one after every write."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    files = []
    while listed.hasNext():
        f = listed.next()
        files.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(sorted(files))).hex


class SearchIndex:
    """The index under root of chunks (id unique, the columns of search.WEIGHTS, and `by`: columns that name a store)."""

    def __init__(self, spark: SparkSession, root: str, by: list[str] | None = None, parts: int = PARTS) -> None:
        self.spark, self.root, self.by, self.parts = spark, root.rstrip("/"), by or [], parts

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The newest version; 0 without any."""
        fs, log = self._fs(f"{self.root}/log")
        return max((int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit()), default=0) if fs.exists(log) else 0

    def state(self, version: int | None = None) -> dict | None:
        version = self.version() if version is None else version
        if not version:
            return None
        fs, where = self._fs(f"{self.root}/log/{version:010d}")
        text = self.spark.sparkContext._jvm.java.util.Scanner(fs.open(where), "UTF-8").useDelimiter("\\A")
        try:
            return json.loads(text.next())
        finally:
            text.close()

    def _commit(self, version: int, state: dict) -> None:
        fs, where = self._fs(f"{self.root}/log/{version:010d}")
        fs.mkdirs(where.getParent())
        _, aside = self._fs(f"{self.root}/log/_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(where) or not fs.rename(aside, where):
            fs.delete(aside, False)
            raise LostRace(f"version {version} of {self.root} is there already")

    def _table(self, state: dict, kind: str, *paths: str) -> DataFrame:
        """Of a known schema, so that no file is opened to find it."""
        return self.spark.read.schema(T.StructType.fromJson(state["schemas"][kind])).parquet(*paths)

    def _read(self, state: dict, kind: str) -> DataFrame:
        """(.., segment) of all segments; rows that are gone aren't left out yet."""
        out = None
        for s in state["segments"]:
            part = self._table(state, kind, f"{self.root}/{s}/{kind}").withColumn("segment", F.lit(s))
            out = part if out is None else out.unionByName(part)
        return out

    def _live(self, state: dict, kind: str) -> DataFrame:
        rows = self._read(state, kind)
        if not state["gone"]:
            return rows
        gone = self._table(state, "gone", *(f"{self.root}/{s}/gone" for s in state["gone"]))
        return rows.join(search.if_few(gone), ["segment", "id"], "left_anti")

    def refresh(self, chunks: DataFrame, content: str) -> int:
        """Brings the index to the chunks as they are; `content` names them. Returns how many chunks were written or went."""
        version = self.version()
        state = self.state(version)
        if state and state["content"] == content:
            return 0
        if state and len(state["segments"]) >= MERGE:
            state = None
        columns = ["id", *self.by, *search.WEIGHTS]
        marked = chunks.select(*columns, F.xxhash64(*columns).alias("hash"))
        segment = f"segment-{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/{segment}"
        old = {"segments": [], "gone": []} if state is None else state
        written = 0
        fresh = marked
        if state is not None:
            held = self._live(state, "rows").select("id", "hash", "segment")
            fresh = marked.join(held.select("id", "hash"), ["id", "hash"], "left_anti")
            held.join(marked.select("id", "hash"), ["id", "hash"], "left_anti").select("id", "segment").write.parquet(f"{path}/gone")
            written += self.spark.read.parquet(f"{path}/gone").count()
        made = search.postings(fresh, self.by).withColumn("part", search.part_of(F.col("token"), self.parts))
        rows = dealt(fresh).select("id", "hash", *self.by, search.length().alias("dl"))
        schemas = {"postings": made, "rows": rows, "gone": rows.select("id", F.lit("").alias("segment"))}
        files = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.parts)  # of a part, so that no task sorts too much
        made.repartition(files * self.parts, "part", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("part", "token", "id").write.partitionBy("part").parquet(f"{path}/postings")
        rows.write.parquet(f"{path}/rows")
        written += self.spark.read.parquet(f"{path}/rows").count()
        new = {"content": content, "segments": [*old["segments"], segment], "gone": [*old["gone"], *([segment] if state is not None else [])], "by": self.by, "parts": self.parts, "stats": f"{segment}/stats", "schemas": {k: df.schema.jsonValue() for k, df in schemas.items()}}
        stats = self._live(new, "rows").groupBy(*self.by).agg(F.count("*").alias("n"), F.sum("dl").alias("terms"))
        new["schemas"]["stats"] = stats.schema.jsonValue()
        stats.coalesce(1).write.parquet(f"{path}/stats")  # a row for each store
        self._commit(version + 1, new)
        return written

    def of(self, content: str, by: list[str] | None = None) -> dict[str, DataFrame]:
        """The arguments index and stats of searches over that content, with the stores named by `by`; none if the index holds
        another content."""
        state = self.state()
        if state is None or state["content"] != content:
            return {}
        own = by or []
        index = self._live(state, "postings").select("id", *own, "token", "wtf", "dl", "part")
        stats = self._table(state, "stats", f"{self.root}/{state['stats']}").groupBy(*own).agg(F.sum("n").alias("n"), (F.sum("terms") / F.sum("n")).alias("avgdl"))
        return {"index": index, "stats": stats, "parts": state["parts"]}
