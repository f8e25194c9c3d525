"""Exact deduplication as a stateful stream, with DataFrame functions only.

Each row's digest, id and content locator go to a landing table. A stream reads it in batches and
keeps, for each digest, the smallest id, its locator and the number of rows in a disk-backed state
store that never expires a key. A digest that came more than once is a hit: the texts of its rows,
and no others, are fetched by their locators and compared whole, so two texts of one digest are told
apart. With a folder of the user's the state outlives the call, and later batches meet it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfold.llm.common import Run, partitions, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_A_BATCH = 256
STATE_MB = 200
#: Bits of the map of locators whose texts are fetched: 8 MB, whatever the number of rows.
MAP_BITS = 1 << 26


def first_row() -> Column:
    """The row of a group that stays, with what finds its text again."""
    return F.min(F.struct("doc_id", "batch", "row", "locator")).alias("first")


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def located(run: Run, docs: DataFrame, batch: str, stored: bool) -> DataFrame:
    """doc_id, text and ``locator``, the file and row number the text can be read from again.

    Rows of Parquet files are located where they are; others, or all with ``stored``, in a copy in the run's folder.
    """
    name = f"content/batch={batch}"
    if not stored:
        try:
            return docs.select("doc_id", "text", place(docs))
        except AnalysisException:
            pass  # not read from Parquet files
    if not run.finished(name):
        docs.select("doc_id", "text").write.mode("overwrite").parquet(f"{run.path}/{name}")
    content = run.spark.read.schema(docs.select("doc_id", "text").schema).parquet(f"{run.path}/{name}")
    return content.select("doc_id", "text", place(content))


def place(rows: DataFrame) -> Column:
    found = rows.metadataColumn("_metadata")
    return F.struct(found["file_path"].alias("file"), found["row_index"].alias("at")).alias("locator")


def fetched(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` whose locator is among ``places``, and a few more where hashes meet.

    The map of the places is of fixed size and goes to all tasks, so other rows are left where they
    are scanned. With far more places than bits it lets every row pass; nothing is ever missed.
    """
    spot = F.pmod(F.xxhash64("locator"), F.lit(MAP_BITS)) + 1
    bucket, bit = F.bitmap_bucket_number(spot), F.bitmap_bit_position(spot)
    marks = (
        places.select(bucket.alias("__bucket"), bit.alias("__bit"))
        .groupBy("__bucket")
        .agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    )
    byte = F.substring("__bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    marked = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1
    return rows.join(F.broadcast(marks), bucket == F.col("__bucket")).where(marked).drop("__bucket", "__bits")


def keyed_state(run: Run, landing: DataFrame, files_a_batch: int, state_partitions: int) -> DataFrame:
    """Stream what is new in the landing table through the state; per digest ``first`` and ``rows``."""
    session: SparkSession = run.spark.newSession()  # the stream's settings stay in a session of their own
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
        # Without this every one of many small stores takes megabytes of disk in advance.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.metricsEnabled": "false",
        # Fixed when the state is made: its partitions are what a restart must find again.
        "spark.sql.shuffle.partitions": str(state_partitions),
    }
    for key, value in settings.items():
        session.conf.set(key, value)
    checkpoint = f"{run.path}/state"
    stream = (
        session.readStream.schema(landing.schema)
        .option("maxFilesPerTrigger", files_a_batch)
        .parquet(f"{run.path}/landing")
        .groupBy("digest")
        .agg(first_row(), F.count("*").alias("rows"))
    )
    query = (
        stream.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    state = session.read.format("statestore").load(checkpoint)
    fields = state.schema["value"].dataType.fieldNames()
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.`{fields[0]}`").alias("first"),
        F.col(f"value.`{fields[1]}`").alias("rows"),
    )


def deduplicate(
    docs: DataFrame,
    files_a_batch: int = FILES_A_BATCH,
    state_partitions: int | None = None,
    digest: Callable[[Column], Column] = sha256,
    folder: str | None = None,
    batch: str = "first",
) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of white space became one space; null counts as
    empty. The row with the smallest doc_id of a group stays (null first); of repeated rows with
    that id, one. An empty table gives an empty result. Columns beside doc_id and text are not
    looked at. A group of any size is one row of state, summed up before the shuffle. Texts that
    differ under one ``digest`` are held apart by a second hash.

    With ``folder`` the state and the texts are kept there, and the result has the rows of all batches
    that came into it, this one and those before. Only the new ``batch`` is read and digested; of old
    texts one is read for each digest that comes again. A batch already in the folder is not added
    twice, so a call that was lost can be repeated with the same rows and name, and must be before
    another batch comes. A batch's name is of letters, digits, ``_``, ``.`` and ``-``.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"not a name of a batch: {batch!r}")
    spark = docs.sparkSession
    scratch = Run(spark, "exact")
    run = Run(spark, "exact", folder) if folder else scratch
    refuse_unfinished(run, batch)
    source = located(run, docs, batch, stored=folder is not None)
    landing = landed(run, source, batch, digest)
    state = scratch.table(keyed_state(run, landing, files_a_batch, state_partitions or partitions(spark)), "digests")
    found = scratch.table(landing.join(state, "digest"), "found")
    apart = parted(run, scratch, source, found, batch, digest)
    single = found.join(apart, "digest", "left_anti")
    collided = found.join(apart, "digest", "left_semi").drop("first", "rows")
    own = collided.groupBy("digest", "__alike").agg(first_row(), F.count("*").alias("rows"))
    columns = ["doc_id", "batch", "row", "first", "rows", "text_sha256"]
    groups = single.select(columns).union(collided.join(own, ["digest", "__alike"]).select(columns))
    return groups.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        ((F.col("row") == F.col("first.row")) & (F.col("batch") == F.col("first.batch"))).alias("kept"),
        "text_sha256",
    )


def landed(run: Run, source: DataFrame, batch: str, digest: Callable[[Column], Column]) -> DataFrame:
    """The landing table with the rows of this batch; whole or not at all, before the stream sees any."""
    rows = source.select("doc_id", normalised().alias("__text"), "locator").select(
        "doc_id",
        digest(F.col("__text")).alias("digest"),
        sha256(F.col("__text")).alias("text_sha256"),
        F.xxhash64("__text").alias("__alike"),
        "locator",
        F.monotonically_increasing_id().alias("row"),
    )
    if not run.finished(f"landing/batch={batch}"):
        rows.write.mode("overwrite").parquet(f"{run.path}/landing/batch={batch}")
    schema = rows.withColumn("batch", F.lit(batch)).schema
    return run.spark.read.schema(schema).parquet(f"{run.path}/landing")


def refuse_unfinished(run: Run, batch: str) -> None:
    """Rows of a lost call are in the landing table but weren't compared yet."""
    if not run.exists("landing"):
        return
    batches = run.spark.read.schema("batch string").parquet(f"{run.path}/landing").distinct().collect()
    lost = sorted(r[0] for r in batches if r[0] != batch and not run.finished(f"apart/batch={r[0]}"))
    if lost:
        raise ValueError(f"repeat the lost batches first: {lost}")


def parted(
    run: Run, scratch: Run, source: DataFrame, found: DataFrame, batch: str, digest: Callable[[Column], Column]
) -> DataFrame:
    """Digests that stand for more than one text, as comparing the whole texts of hits shows.

    The new rows of a hit are compared with each other and with one old row of the digest; the others
    were compared with that one when they came. Copies are merged before the shuffle.
    """
    spark, name = run.spark, f"apart/batch={batch}"
    hits = found.where("rows > 1")
    new = hits.where(F.col("batch") == batch)
    texts = fetched(source.select("locator", "text"), new)
    old = hits.where(F.col("batch") != batch)
    if not old.isEmpty():
        known = spark.read.schema("digest string, batch string").parquet(f"{run.path}/apart")
        known = known.where(F.col("batch") != batch).select("digest").distinct()
        met = old.join(new.select("digest"), "digest", "left_semi")
        one = met.groupBy("digest").agg(first_row()).select("first.locator")
        places = scratch.table(one.union(met.join(known, "digest", "left_semi").select("locator")), "places")
        # As many names as the old batches have files with hits.
        files = [r[0] for r in places.select("locator.file").distinct().collect()]
        if files:
            content = spark.read.schema(source.select("doc_id", "text").schema).parquet(*files)
            rows = fetched(content.select(place(content), "text"), places)
            texts = texts.union(rows)
    whole = texts.select(normalised().alias("__text"))
    counted = (
        whole.groupBy(digest(F.col("__text")).alias("digest"), "__text")
        .agg(F.count("*").alias("__rows"))
        .select("digest", F.xxhash64("__text").alias("__alike"))
        .groupBy("digest")
        .agg(F.count("*").alias("__texts"), F.count_distinct("__alike").alias("__hashes"))
        .where("__texts > 1")
    )
    counted.write.mode("overwrite").parquet(f"{run.path}/{name}")
    now = spark.read.schema(counted.schema).parquet(f"{run.path}/{name}")
    if not now.where("__texts > __hashes").isEmpty():
        raise RuntimeError("two texts share a digest and a second hash")
    return spark.read.schema("digest string, batch string").parquet(f"{run.path}/apart").select("digest").distinct()


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with one doc_id and equal texts, one."""
    kept = deduplicate(docs, **settings).where("kept").select(F.col("doc_id").alias("__doc"), "text_sha256")
    own = sha256(normalised())
    stay = docs.join(kept, docs["doc_id"].eqNullSafe(kept["__doc"]) & (own == kept["text_sha256"]))
    # Rows repeated with their id meet here, already partitioned by it.
    return stay.dropDuplicates(["__doc", "text_sha256"]).select([docs[c] for c in docs.columns])
