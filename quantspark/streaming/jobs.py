"""Drawings as they arrive: PDFs dropped into a folder become jobs that run the batch plan; a job table with expiry.

A job's states are queued files, then done or error: the table holds one row for each file of a micro-batch, written after
the batch's results, so a replayed batch writes the same rows again. Asking for a job's state, rows or files is reading tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.config import Config, zones_from_fractions
from quantspark.operators.grid import PAGE
from quantspark.plans import engine
from quantspark.shared import stored
from quantspark.sinks import bills
from quantspark.sources import cadpdf, ocr, schema

TTL = "24 hours"
#: The largest upload, and how a PDF begins.
MAX_UPLOAD_BYTES, MAGIC = 100 << 20, b"%PDF"
FILES = "path string, modificationTime timestamp, length bigint, content binary"
JOBS = "job_id string, input_name string, path string, created timestamp, status string, error string, n_rows long"


def admitted(files: DataFrame, most_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """(job_id, input_name, path, created, refused) of files (path, modificationTime, length, content): why one is refused, or null."""
    head = F.substring(F.col("content"), 1, len(MAGIC))
    refused = F.when(F.col("length") > most_bytes, F.concat(F.lit("413: larger than "), F.lit(str(most_bytes)), F.lit(" bytes"))).when(head.isNull() | (head != F.lit(MAGIC)), F.lit("400: not a PDF"))
    job = F.substring(F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string")), 256), 1, 32)
    return files.select(job.alias("job_id"), F.element_at(F.split("path", "/"), -1).alias("input_name"), "path", F.col("modificationTime").alias("created"), refused.alias("refused"))


def unreadable(files: DataFrame) -> DataFrame:
    """(path, error) of files (path, content) that the PDF source cannot read, so that one bad file does not fail its batch."""

    def run(batches):
        import pandas as pd

        for b in batches:
            found = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    cadpdf.read_pdf(bytes(content))
                except Exception as e:  # noqa: BLE001  whatever a broken file raises is its job's error
                    found.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(found, columns=["path", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, error string")


def zones_of(pages: DataFrame, fractions: str) -> DataFrame:
    """(page, box) of zones drawn on a preview, as fractions 'x0,y0,x1,y1;...' of each page."""
    boxes = [(list(z),) for z in zones_from_fractions(fractions, 1.0, 1.0)]
    drawn = F.array(*[F.array(*[F.lit(float(v)) for v in b[0]]) for b in boxes]) if boxes else F.array().cast("array<array<double>>")
    z = pages.withColumn("_z", F.explode(drawn))
    side = lambda i, of: (F.col("_z")[i] * F.col(of)).alias(f"{'xy'[i % 2]}{i // 2}")
    return z.select(*PAGE, side(0, "width"), side(1, "height"), side(2, "width"), side(3, "height"))


def run_batch(files: DataFrame, out: str, batch_id: int, cfg: Config = Config(), fractions: str = "", ocr_engine: ocr.Engine | None = None, most_bytes: int = MAX_UPLOAD_BYTES) -> None:  # noqa: B008
    """Runs a micro-batch of files: results under out/results/batch=..., one row a job under out/jobs/batch=... . The paths of a
    micro-batch, bounded by the stream's maxFilesPerTrigger, come to the driver, which reads no file."""
    spark = files.sparkSession
    jobs = stored(admitted(files, most_bytes), "jobs")
    bad = stored(unreadable(files.join(jobs.filter("refused is null").select("path"), "path", "left_semi")), "jobs-unreadable")
    jobs = jobs.join(bad, "path", "left").withColumn("error", F.coalesce("refused", "error"))
    paths = [r.path.removeprefix("file:") for r in jobs.filter("error is null").select("path").collect()]
    n_rows = None
    if paths:
        pages, hits, items = (cadpdf.read(spark, sorted(paths), t) for t in ("pages", "hits", "items"))
        result = engine.run(pages, hits, items, cfg, zones_of(pages, fractions) if fractions else None, ocr_engine)
        bills.write_tables(result, f"{out}/results/batch={batch_id}")
        n_rows = result.rows.groupBy(F.col("doc_id").alias("input_name")).agg(F.count("*").alias("n_rows"))
    else:
        n_rows = jobs.select("input_name").limit(0).withColumn("n_rows", F.lit(0).cast("long"))
    rows = jobs.join(n_rows, "input_name", "left").withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("error"))
    rows = rows.withColumn("n_rows", F.when(F.col("error").isNull(), F.coalesce("n_rows", F.lit(0))))
    rows.select(*[c.split()[0] for c in JOBS.split(", ")]).write.mode("overwrite").parquet(f"{out}/jobs/batch={batch_id}")


def watch(spark: SparkSession, inbox: str, out: str, checkpoint: str, files_a_batch: int = 64, **options):
    """A query that turns new PDFs of a folder into jobs, each once by the stream's checkpoint, until there are no more."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_batch).load(inbox)
    return stream.writeStream.foreachBatch(lambda df, n: run_batch(df, out, n, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll(spark: SparkSession, out: str) -> DataFrame:
    """The job table."""
    return spark.read.schema(f"{JOBS}, batch long").parquet(f"{out}/jobs")


def rows_of(spark: SparkSession, out: str, job_id: str) -> DataFrame:
    """The bill rows of one job; none of a job that failed or is unknown."""
    job = F.broadcast(poll(spark, out).filter((F.col("job_id") == job_id) & (F.col("status") == "done")).limit(1).select(F.col("input_name").alias("doc_id"), "batch"))
    return spark.read.option("basePath", f"{out}/results").parquet(f"{out}/results/batch=*/bills").join(job, ["doc_id", "batch"], "left_semi").drop("batch")


def run_folder(spark: SparkSession, folder: str, checkpoint: str, batch: Callable[[DataFrame, int], None], table: str = "items"):
    """A query that hands each micro-batch of new Parquet files of a table to `batch`, once (by the stream's checkpoint)."""
    kind = {"items": schema.ITEMS, "hits": schema.HITS, "pages": schema.PAGES}[table]
    stream = spark.readStream.schema(kind).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_jobs(submitted: DataFrame, key: str = "job_id", at: str = "created", ttl: str = TTL) -> DataFrame:
    """Submissions without repeats of a job within the time to live; state older than that is dropped by the watermark."""
    return submitted.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def live_jobs(jobs: DataFrame, now, ttl_hours: int = 24) -> DataFrame:
    """Jobs that have not expired at a time."""
    return jobs.filter(F.col("created") > F.lit(now) - F.expr(f"INTERVAL {ttl_hours} HOURS"))


def job_states(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, event_type, n) over event time with a watermark: how many jobs reached each state."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
