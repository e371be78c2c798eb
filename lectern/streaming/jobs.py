"""Structured Streaming forms of the operators whose input keeps arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.vectors import word_set
from lectern.operators.chunking import chunk_documents
from lectern.operators.knowledge import auto_save
from lectern.operators.prefix_index import PrefixIndex
from lectern.session import folders, remove_folder
from lectern.sources.files import extract, limited, to_documents

COMPACT_EVERY = 20


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream with the schema of its files.

    A file source takes a folder or a pattern, so the path is given as a pattern that
    matches itself.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def ingest_chunks(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """New documents to chunk rows with their vectors. Stateless."""
    chunks = chunk_documents(docs).withColumn("vector", word_set(F.col("chunk_text")))
    return (
        chunks.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def file_stream(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Uploaded files as a stream: ``path, modificationTime, length, content``, one row per file."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(
        "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    for name, value in (("pathGlobFilter", glob), ("maxFilesPerTrigger", files_per_batch)):
        if value:
            reader = reader.option(name, value)
    return reader.load(path)


def ingest_files(uploads: DataFrame, root: str, checkpoint: str, embedder=None) -> StreamingQuery:
    """Uploads of :func:`file_stream` through type detection, text extraction, admission and chunking.

    Every batch writes ``files``, one row per file with its text or the reason it was turned away, then, from
    what was written, ``documents``, ``chunks`` with their vectors, and ``rejected``. Each goes to the batch's own folder,
    which a second run of the batch overwrites with the same rows. Files over the size limit are told apart
    before they are read. Files in many folders are best listed under :func:`lectern.session.short_listings`.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = lambda table: f"{root}/{table}/batch_id={batch_id}"
        uploaded = batch.withColumnRenamed("length", "size_bytes")
        times = F.col("modificationTime").alias("uploaded_at")
        found = extract(limited(uploaded))
        found.join(batch.select("path", times), "path").write.mode("overwrite").parquet(folder("files"))
        files = spark.read.parquet(folder("files"))
        to_documents(files, F.col("uploaded_at")).write.mode("overwrite").parquet(folder("documents"))
        files.where(F.col("error_code").isNotNull()).select("path", "filename", "size_bytes", "error_code", "http_status", "error").write.mode(
            "overwrite").parquet(folder("rejected"))
        chunks = chunk_documents(spark.read.parquet(folder("documents")))
        chunks = embedder.transform(chunks, "chunk_text", "vector") if embedder else chunks.withColumn("vector", word_set(F.col("chunk_text")))
        chunks.write.mode("overwrite").parquet(folder("chunks"))

    return (
        uploads.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def learn(chat: DataFrame, kb: DataFrame, root: str, checkpoint: str, index_path: str | None = None) -> StreamingQuery:
    """Answered questions to new knowledge-base rows under ``root``.

    The base is indexed once, under ``index_path``, and each batch adds the rows it saves: a batch is compared with the
    base and the batches before it by way of the index, of which it reads the buckets it needs. Rows and index parts of a batch
    stand in its own ``batch_id`` folders, so running a batch again leaves the same rows.
    """
    spark = chat.sparkSession
    index = PrefixIndex.open(spark, index_path or f"{root.rstrip('/')}-index", kb.select(word_set(F.col("question")).alias("vector")))

    def save(batch: DataFrame, batch_id: int) -> None:
        out = f"{root}/batch_id={batch_id}"
        auto_save(batch, kb, known=lambda asked: index.near(asked, batch_id)).write.mode("overwrite").parquet(out)
        index.extend(spark.read.parquet(out).select(word_set(F.col("question")).alias("vector")), batch_id)

    return (
        chat.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _counts(stream: DataFrame, key: str, mode: str, root: str, checkpoint: str, every: int) -> StreamingQuery:
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batches/batch_id={batch_id}")
        if (batch_id + 1) % every == 0:
            compact_counts(batch.sparkSession, root, key, batch_id)

    counts = stream.groupBy(key).agg(F.count("*").alias("n"))
    return (
        counts.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def live_rating_counts(chat: DataFrame, root: str, checkpoint: str, every: int = COMPACT_EVERY) -> StreamingQuery:
    """Count per rating; every batch writes the complete table."""
    return _counts(chat.where(F.col("rating").isNotNull()), "rating", "complete", root, checkpoint, every)


def live_usage_counts(fires: DataFrame, root: str, checkpoint: str, every: int = COMPACT_EVERY) -> StreamingQuery:
    """Count per knowledge-base row; a batch writes only the rows that changed."""
    return _counts(fires, "kb_id", "update", root, checkpoint, every)


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    return sorted(int(f.split("=")[1]) for f in folders(spark, path) if f.startswith(f"{name}="))


def _snapshots(spark: SparkSession, root: str) -> list[int]:
    """Batches up to which a whole snapshot was written."""
    return [n for n in _numbered(spark, f"{root}/snapshots", "upto") if "_SUCCESS" in folders(spark, f"{root}/snapshots/upto={n}")]


def compact_counts(spark: SparkSession, root: str, key: str, upto: int) -> None:
    """Folds the batches up to ``upto`` into one snapshot of the latest row per key, then drops what it replaces.

    Safe to run again at any point: a snapshot that was written whole is kept, one that was not is written anew,
    and nothing is dropped before the snapshot that holds it is whole. The snapshot before the last stays for
    readers that have just begun, so a job of any length leaves two snapshots and fewer than two rounds of batches.
    """
    whole = _snapshots(spark, root)
    if upto not in whole:
        current_counts(spark, root, key, upto).write.mode("overwrite").parquet(f"{root}/snapshots/upto={upto}")
    before = [n for n in whole if n < upto]
    if before:
        for n in _numbered(spark, f"{root}/batches", "batch_id"):
            if n <= before[-1]:
                remove_folder(spark, f"{root}/batches/batch_id={n}")
        for n in before[:-1]:
            remove_folder(spark, f"{root}/snapshots/upto={n}")


def current_counts(spark: SparkSession, root: str, key: str, upto: int | None = None) -> DataFrame:
    """The newest count of each key, from the last whole snapshot and the batches after it; up to a batch, if given."""
    fits = lambda n: upto is None or n <= upto
    snapshot = max((n for n in _snapshots(spark, root) if fits(n)), default=-1)
    batches = [n for n in _numbered(spark, f"{root}/batches", "batch_id") if n > snapshot and fits(n)]
    paths = [(n, f"{root}/batches/batch_id={n}") for n in batches] + ([(snapshot, f"{root}/snapshots/upto={snapshot}")] if snapshot >= 0 else [])
    rows = None
    for n, path in paths:
        part = spark.read.parquet(path).select(key, "n", F.lit(n).alias("batch_id"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no batch was written yet")
    return rows.groupBy(key).agg(F.max_by("n", "batch_id").alias("n"))
