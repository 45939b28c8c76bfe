"""File sources and sinks: trees of notes, graph exports, session logs, stores of several agents, versioned output."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from engramix import vocab
from engramix.functions import chunkers, score, text

LARGE_STORE = 10_000
#: Longest text sent to an embedding service, and texts in a call.
EMBED_CHARS, EMBED_BATCH = 2048, 50


class LargeStore(ValueError):
    """Ingest into a store with many chunks needs allow_large."""


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_tree(spark: SparkSession, root: str, pattern: str = "*.{md,txt,json}") -> DataFrame:
    """(source_file relative to root, text, modified) of all files under root; no rows for a missing folder."""
    if not exists(spark, root):
        return spark.createDataFrame([], "source_file string, text string, modified timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    relative = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    own = files.select(F.replace(relative, F.lit(base), F.lit("")).alias("source_file"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))
    return own.filter(~F.col("source_file").rlike(r"(?:^|/)(?:node_modules|\.git)/"))


def spread(df: DataFrame, path: str, least: int = 1 << 20, most: int = 1 << 30) -> DataFrame:
    """df, read from the path, over all cores where that is one file of 1 MB to 1 GB, which else may be read by one task (its row
    groups are too few). Folders of files and large files are left as they are."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    return df.repartition(spark.sparkContext.defaultParallelism) if status.isFile() and least <= status.getLen() <= most else df


def route(path: Column, force: str | None = None) -> Column:
    """How a file is cut: `entity`, `json` or `markdown`, by its path, or as the caller says."""
    if force is not None:
        return F.lit(force)
    return F.when(path.endswith(".json"), "json").when(path.rlike(r"(?:^|/)entities/.*\.md$"), "entity").otherwise("markdown")


def too_large(chunks: DataFrame, most: int = LARGE_STORE) -> DataFrame:
    """(chunks, blocked): at most most + 1 are counted."""
    return chunks.limit(most + 1).agg(F.count("*").alias("chunks")).withColumn("blocked", F.col("chunks") > most)


def guard_store(chunks: DataFrame, allow_large: bool = False, most: int = LARGE_STORE) -> None:
    if not allow_large and too_large(chunks, most).first().blocked:
        raise LargeStore(f"the store has more than {most} chunks")


def ingest(files: DataFrame, as_of: Column) -> DataFrame:
    """Chunks of files (source_file, text): repaired, redacted, typed, dated, cut by kind of file, with retention and pain.

    Entity files give their sections, JSON files their items, others their markdown sections."""
    spark = files.sparkSession
    chunkers.register(spark)
    clean = files.withColumn("r", text.redacted(text.mojibake_repaired(F.coalesce("text", F.lit("")))))
    kind = text.chunk_type(F.col("source_file"))
    override = text.retention_override(F.col("text"))
    base = clean.withColumn("kind", route(F.col("source_file"))).select("kind", "source_file", F.col("r.text").alias("body"), F.col("r.count").alias("redactions"), kind.alias("chunk_type"), F.coalesce(text.path_date(F.col("source_file")), as_of.cast("date")).alias("source_date"), override.alias("o"))
    parts = []
    for way, function, section in (("json", "chunk_json", "CAST(NULL AS STRING)"), ("entity", "parse_entity", "c.section"), ("markdown", "chunk_markdown", "CAST(NULL AS STRING)")):
        parts.append(spark.sql(f"SELECT f.*, c.pos, {section} AS section, c.chunk AS chunk_text FROM {{f}} f, LATERAL {function}(f.body) c", f=base.filter(F.col("kind") == way)))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    days = F.when(F.col("o.found"), F.col("o.days")).otherwise(score.lookup(F.col("chunk_type"), vocab.RETENTION_DAYS, vocab.RETENTION_FALLBACK))
    importance = score.importance(F.lit(None).cast("double"), F.col("chunk_type"))
    return rows.select(
        "source_file",
        "pos",
        "chunk_text",
        "chunk_type",
        F.when(F.col("section").isNull(), F.col("source_date")).alias("source_date"),
        "section",
        days.alias("retention_days"),
        score.infer_pain(F.col("chunk_type"), F.col("chunk_text")).alias("pain"),
        F.when(F.col("section") == "compiled", F.greatest(F.lit(0.9), importance)).otherwise(importance).alias("importance"),
        F.lit("peripheral").alias("tier"),
        text.path_kind(F.col("source_file")).alias("source_type"),
        as_of.cast("timestamp").alias("created_at"),
    )


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The store with all chunks of the newly read files replaced."""
    return old.join(new.select("source_file").distinct(), "source_file", "left_anti").unionByName(new, allowMissingColumns=True)


_GRAPH = "nodes array<struct<id:string,label:string,type:string>>, links array<struct<source:string,target:string,relation:string>>"


def read_graph(spark: SparkSession, path: str, edges: int = 8) -> DataFrame:
    """graph_chunks() of a graph export {nodes: [{id, label, ...}], links: [{source, target, relation}]}."""
    return graph_chunks(spark.read.schema(_GRAPH).json(path, multiLine=True), edges)


def graph_chunks(exported: DataFrame, edges: int = 8) -> DataFrame:
    """(source_file, chunk_text, chunk_type) for each node of exports (nodes, links), with its first out-edges."""
    nodes = exported.select(F.explode("nodes").alias("n")).select("n.*")
    links = exported.select(F.posexplode("links").alias("p", "l")).select("p", "l.*").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("p"))).filter(F.col("k") <= edges)
    out = links.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", F.coalesce("relation", F.lit("related_to")), "target").alias("t")))).alias("es"))
    said = F.concat_ws("\n", F.concat_ws(" ", F.coalesce("label", "id"), F.concat(F.lit("("), F.coalesce("type", F.lit("node")), F.lit(")"))), F.array_join(F.transform(F.coalesce("es", F.array().cast("array<struct<k:int,t:string>>")), lambda x: F.concat(F.lit("- "), x["t"])), "\n"))
    return nodes.join(out, "id", "left").select(F.concat(F.lit("graph:"), "id").alias("source_file"), said.alias("chunk_text"), F.lit("graph_node").alias("chunk_type"))


def read_sessions(spark: SparkSession, path: str, done: DataFrame | None = None, since: Column | None = None) -> DataFrame:
    """messages() of session logs (one file a session, named after it); sessions in `done` (session_key), and files older than
    `since`, are left out."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1).alias("session_key"), F.col("_metadata.file_modification_time").alias("modified"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    own = lines if since is None else lines.filter(F.col("modified") >= since)
    rows = messages(own.drop("modified"))
    return rows.join(done, "session_key", "left_anti") if done is not None else rows


def messages(lines: DataFrame) -> DataFrame:
    """(session_key, n, role, text) of users and assistants from JSON lines (session_key, n, line): {role, content} alone or as
    the `message` of an event of type message; content is a text or a list of parts, of which those of type text count.
    Heartbeats, scheduled turns and texts of fewer than five characters are left out, lines that aren't JSON too."""
    fields = "role string, content string, text string"
    event = F.from_json("line", f"type string, message struct<{fields.replace(' ', ':')}>, {fields}".replace(",:", ", "))
    part = F.from_json("body", "array<struct<type:string,text:string>>")
    rows = lines.select("session_key", "n", event.alias("e")).filter("e.message is null or e.type = 'message'")
    flat = rows.select("session_key", "n", F.coalesce("e.message.role", "e.role").alias("role"), F.coalesce("e.message.content", "e.message.text", "e.text", "e.content").alias("body"))
    said = F.when(F.startswith(F.ltrim("body"), F.lit("[{")), F.array_join(F.transform(F.filter(part, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")).otherwise(F.col("body"))
    own = flat.filter(F.col("role").isin("user", "assistant")).withColumn("text", F.trim(said)).filter(F.length("text") >= 5)
    idle = F.startswith("text", F.lit("[cron:")) | F.startswith("text", F.lit("HEARTBEAT")) | F.startswith("text", F.lit("The conversation history before this point")) | F.col("text").rlike(r"(?i)^heartbeat[_ ]ok\b")
    return own.filter(~idle).select("session_key", "n", "role", "text")


def read_stores(spark: SparkSession, paths: dict[str, str]) -> DataFrame | None:
    """The Parquet stores that exist, with their agent's name."""
    found = [spark.read.parquet(p).withColumn("agent", F.lit(a)) for a, p in sorted(paths.items()) if exists(spark, p)]
    out = found[0] if found else None
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_log(spark: SparkSession, path: str, last: int = 200) -> DataFrame:
    """tail() of a log file."""
    return tail(spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")), last)


def tail(lines: DataFrame, last: int = 200) -> DataFrame:
    """(n, line, state) of the last lines (n, line) of a log, newest first; state OK, FAIL or null."""
    return lines.orderBy(F.desc("n")).limit(last).withColumn("state", F.nullif(F.regexp_extract("line", r"\b(OK|FAIL)\b", 1), F.lit("")))


def grep(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(source_file, line) of the lines of source files that match."""
    rows = spark.read.option("recursiveFileLookup", True).text(path)
    return matching(rows.select(F.input_file_name().alias("source_file"), F.col("value").alias("line")), pattern)


def matching(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.filter(F.col("line").rlike(pattern))


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("id"), "id", "left_anti")


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = EMBED_BATCH) -> DataFrame:
    """(id, embedding, error) by an outside service in batches; a batch that fails has its error and no vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                try:
                    rows = embed([(t or "")[:EMBED_CHARS] for t in part["chunk_text"]])
                    if any(len(r) != dim for r in rows):
                        raise ValueError(f"a vector hasn't {dim} components")
                    yield pd.DataFrame({"id": part["id"], "embedding": [list(map(float, r)) for r in rows], "error": None})
                except Exception as e:  # an outside service
                    yield pd.DataFrame({"id": part["id"], "embedding": None, "error": str(e)})

    return chunks.select("id", "chunk_text").mapInPandas(run, "id long, embedding array<float>, error string")


def hashed_embedding(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic offline embedder: signed hashed words, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        import hashlib
        import math

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


class BadVersion(ValueError):
    """A snapshot that is missing or not what was written."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _renamed(spark: SparkSession, old: str, new: str) -> None:
    fs, was = _fs(spark, old)
    if not fs.rename(was, _fs(spark, new)[1]):
        raise BadVersion(f"{new} could not be put in place")


def versions_kept(versions: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` of versions (version)."""
    return versions.orderBy(F.desc("version")).limit(keep)


def write_version(df: DataFrame, root: str, version: str, keep: int = 5) -> str:
    """A snapshot under root/v=version, and the pointer root/current to it; older snapshots beyond `keep` are deleted.

    It is written aside, read again and compared with the rows and columns that were written, and only then put in place."""
    spark = df.sparkSession
    root = root.rstrip("/")
    path, aside = f"{root}/v={version}", f"{root}/_v={version}-{uuid.uuid4().hex[:12]}"
    if exists(spark, path):
        raise BadVersion(f"{path} is there already")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(aside)
    back = spark.read.parquet(aside)
    if back.count() != seen.get["n"] or [f.name for f in back.schema.fields] != df.columns:
        _fs(spark, aside)[0].delete(_fs(spark, aside)[1], True)
        raise BadVersion(f"{path} isn't what was written")
    _renamed(spark, aside, path)
    _point(spark, root, version)
    fs, where = _fs(spark, root)
    found = [str(s.getPath()).rsplit("/v=", 1)[1] for s in fs.listStatus(where) if "/v=" in str(s.getPath())]
    kept = set(sorted(found, reverse=True)[:keep]) | {version}
    for old in found:
        if old not in kept:
            fs.delete(_fs(spark, f"{root}/v={old}")[1], True)
    return path


def _point(spark: SparkSession, root: str, version: str) -> None:
    aside = f"{root}/_current-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.json(aside)
    fs, now = _fs(spark, f"{root}/current")
    if fs.exists(now):
        fs.delete(now, True)
    _renamed(spark, aside, f"{root}/current")


def current_version(spark: SparkSession, root: str) -> str:
    return spark.read.schema("version string").json(f"{root.rstrip('/')}/current").first().version


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The current snapshot, or the one named."""
    return spark.read.parquet(f"{root.rstrip('/')}/v={version or current_version(spark, root)}")


def restore(spark: SparkSession, root: str, version: str, force: bool = False) -> None:
    """Makes an older snapshot the current one, if it can be read whole and, unless forced, has the current one's columns."""
    root = root.rstrip("/")
    if not exists(spark, f"{root}/v={version}"):
        raise BadVersion(f"{root}/v={version} is missing")
    old = read_version(spark, root, version)
    old.write.format("noop").mode("overwrite").save()
    if not force and exists(spark, f"{root}/current") and read_version(spark, root).dtypes != old.dtypes:
        raise BadVersion(f"{root}/v={version} has other columns than the current one")
    _point(spark, root, version)


def inserted_under(document: str, heading: str, line: str) -> str:
    """A markdown text with a line added at the end of the section, which is made if it is missing."""
    import re

    found = re.search(rf"^(#{{1,6}})\s+{re.escape(heading)}\s*$", document, re.M)
    if not found:
        return document.rstrip("\n") + f"\n\n## {heading}\n{line}\n"
    end = re.compile(rf"^#{{1,{len(found[1])}}}\s", re.M).search(document, found.end())
    at = end.start() if end else len(document)
    return document[:at].rstrip("\n") + f"\n{line}\n" + ("\n" + document[at:] if end else "")


def write_report(lines: DataFrame, path: str) -> None:
    """A report (place, line) as one text file."""
    lines.orderBy("place").select("line").coalesce(1).write.mode("overwrite").text(path)


def changed_files(spark: SparkSession, repository: str, base: str = "HEAD~1") -> DataFrame:
    """(source_file) of files that differ from a revision of a git repository on the driver's machine."""
    import subprocess

    said = subprocess.run(["git", "-C", repository, "diff", "--name-only", base], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(x,) for x in said.splitlines()], "source_file string")
