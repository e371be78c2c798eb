"""Streams equal their batch operators."""

import io
import zipfile

from pyspark.sql import functions as F

from lectern.operators import chunking, knowledge
from lectern.operators.embedding import DenseWordSets
from lectern.session import folders, remove_folder, short_listings
from lectern.sources import files
from lectern.streaming import jobs


def done(query):
    query.awaitTermination()
    assert query.exception() is None


def write_files(df, path, n):
    df.repartition(n).write.parquet(path)


def test_ingest_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i * 40)) for i in range(12)], "id BIGINT, content STRING")
    write_files(docs, str(tmp_path / "docs"), 4)
    done(jobs.ingest_chunks(jobs.table_stream(spark, str(tmp_path / "docs"), 1), str(tmp_path / "out"), str(tmp_path / "state")))
    got = spark.read.parquet(str(tmp_path / "out")).drop("vector")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.chunk_documents(docs).collect()))


def test_counts_over_many_batches(spark, tmp_path):
    log = spark.createDataFrame([(i % 7, None if i % 5 == 0 else i % 5) for i in range(200)], "kb_id BIGINT, rating INT")
    write_files(log, str(tmp_path / "log"), 5)
    stream = lambda: jobs.table_stream(spark, str(tmp_path / "log"), 1)
    done(jobs.live_usage_counts(stream(), str(tmp_path / "u"), str(tmp_path / "us")))
    done(jobs.live_rating_counts(stream(), str(tmp_path / "r"), str(tmp_path / "rs")))
    for root, key in (("u", "kb_id"), ("r", "rating")):
        want = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        assert sorted(map(tuple, jobs.current_counts(spark, str(tmp_path / root), key).collect())) == sorted(map(tuple, want.collect()))


def test_learning_sees_earlier_batches_and_replays_safely(spark, tmp_path):
    answer = "An answer that is long enough for the gate, because it holds more than eighty characters."
    def batch(rows, name):
        spark.createDataFrame(rows, "id BIGINT, question STRING, answer STRING").withColumn(
            "ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    kb = spark.createDataFrame([(1, "known question about the lease")], "id BIGINT, question STRING")
    run = lambda: done(jobs.learn(jobs.table_stream(spark, str(tmp_path / "chat")), kb, str(tmp_path / "out"), str(tmp_path / "state")))
    batch([(10, "first new question here", answer), (11, "Known question about the lease", answer)], "chat")
    run()
    batch([(12, "First new question here", answer), (13, "second new question there", answer), (14, "x", "short")], "chat")
    run()
    got = spark.read.parquet(str(tmp_path / "out")).select("chat_history_id", "batch_id").collect()
    assert sorted(map(tuple, got)) == [(10, 0), (13, 1)]
    everything = spark.read.parquet(str(tmp_path / "chat"))
    assert {r["chat_history_id"] for r in knowledge.auto_save(everything, kb).collect()} == {10, 13}


def test_counts_leave_a_bounded_number_of_folders(spark, tmp_path):
    """A hundred batches, compacted every ten, and the compaction run again from any point."""
    root = str(tmp_path / "u")
    for n in range(100):
        spark.createDataFrame([(n % 7, n), (n % 3, n + 1000)], "kb_id BIGINT, n BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{root}/batches/batch_id={n}")
        if n % 10 == 9:
            jobs.compact_counts(spark, root, "kb_id", n)
    want = {}
    for n in range(100):
        want[n % 7], want[n % 3] = max(want.get(n % 7, (-1, 0)), (n, n)), max(want.get(n % 3, (-1, 0)), (n, n + 1000))
    read = lambda: {r["kb_id"]: r["n"] for r in jobs.current_counts(spark, root, "kb_id").collect()}
    first = read()
    assert set(first) == set(range(7)) and all(first[k] in (want[k][1], want[k][0]) for k in want)
    assert len(folders(spark, f"{root}/batches")) <= 20 and len(folders(spark, f"{root}/snapshots")) == 2
    jobs.compact_counts(spark, root, "kb_id", 99)
    assert read() == first
    remove_folder(spark, f"{root}/snapshots/upto=99/_SUCCESS")  # as if the last snapshot was cut off
    assert read() == first
    jobs.compact_counts(spark, root, "kb_id", 99)
    assert read() == first


def test_compacted_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(i * i % 11,) for i in range(300)], "kb_id BIGINT")
    write_files(log, str(tmp_path / "log"), 9)
    done(jobs.live_usage_counts(jobs.table_stream(spark, str(tmp_path / "log"), 1), str(tmp_path / "u"), str(tmp_path / "us"), every=2))
    want = log.groupBy("kb_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, jobs.current_counts(spark, str(tmp_path / "u"), "kb_id").collect())) == sorted(map(tuple, want.collect()))
    assert len(folders(spark, str(tmp_path / "u" / "batches"))) <= 4


def test_file_stream_equals_batch_on_all_kinds(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as archive:
        archive.writestr("[Content_Types].xml", "<Types/>")
        archive.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
                                              "<w:p><w:r><w:t>first words</w:t></w:r></w:p><w:p><w:r><w:t>second</w:t></w:r></w:p></w:body></w:document>")
    kinds = {"a.txt": b"plain words here", "b.docx": word.getvalue(), "c.pdf": b"%PDF-1.7 x", "d.bin": b"\x00\x01\x02", "e.txt": b" \n ", "f.docx": word.getvalue()[:-9],
             "g.md": "café".encode("latin-1"), "h.txt": b"x " * 200_000}
    for name, data in kinds.items():
        (folder / name).write_bytes(data)
    stream = lambda: jobs.file_stream(spark, str(folder), files_per_batch=3)
    root, state = str(tmp_path / "store"), str(tmp_path / "state")
    done(jobs.ingest_files(stream(), root, state))
    batch = files.extract(files.read_files(spark, str(folder)))
    key = lambda df: sorted((r["filename"], r["file_type"], r["text"], r["error_code"], r["char_count"]) for r in df.collect())
    assert key(spark.read.parquet(f"{root}/files")) == key(batch)
    rejected = {r["filename"]: r["error_code"] for r in spark.read.parquet(f"{root}/rejected").collect()}
    assert rejected == {r["filename"]: r["error_code"] for r in batch.where("error_code IS NOT NULL").collect()} and len(rejected) >= 4
    chunks = lambda df: sorted((r["document_id"], r["chunk_index"], r["chunk_text"]) for r in df.collect())
    made = chunking.chunk_documents(files.to_documents(batch, F.lit(None).cast("timestamp")))
    assert chunks(spark.read.parquet(f"{root}/chunks")) == chunks(made)
    before = chunks(spark.read.parquet(f"{root}/chunks"))
    last = max(int(f.split("=")[1]) for f in folders(spark, f"{root}/files"))
    (tmp_path / "state" / "commits" / str(last)).unlink()  # the last batch is run again
    (tmp_path / "state" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    done(jobs.ingest_files(stream(), root, state))
    assert chunks(spark.read.parquet(f"{root}/chunks")) == before
    (folder / "z.txt").write_bytes(b"late words")
    done(jobs.ingest_files(stream(), root, state, DenseWordSets(8)))
    assert spark.read.parquet(f"{root}/documents").count() == batch.where("error_code IS NULL").count() + 1


def test_many_folders_are_listed_in_few_tasks(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with short_listings(spark):
        assert int(spark.conf.get(name)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before
