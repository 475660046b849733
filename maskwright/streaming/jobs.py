"""Anonymization jobs: a folder of JSON documents, and a worker on a file stream.

A job is (job_id, columns, partner_id, table_name, status, cause), one folder
per job.  The worker takes what has come in, smallest column set first.
"""

from __future__ import annotations

import secrets
import string
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.config import Settings
from maskwright.plans.pipeline import AnonymizationPipeline, Outcome
from maskwright.sources.sinks import store_compartments
from maskwright.sources.tables import missing_columns

JOB = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("partner_id", T.IntegerType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("cause", T.StringType()),
    ]
)


class UnknownJob(KeyError):
    """There is no such job."""


class BadRequest(ValueError):
    """The job lacks something, or asks for columns that aren't there."""


def new_id(size: int = 6) -> str:
    return "".join(secrets.choice(string.ascii_uppercase + string.digits) for _ in range(size))


def to_json(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.to_json(F.struct(*jobs.columns)).alias("value"))


def from_json(documents: DataFrame, column: str = "value") -> DataFrame:
    return documents.select(F.from_json(column, JOB).alias("j")).select("j.*")


def next_job(jobs: DataFrame) -> DataFrame:
    """The waiting job with the fewest columns, the first by id of equals."""
    return jobs.where("status = 'waiting'").orderBy(F.size("columns"), "job_id").limit(1)


class JobStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = self._path("")
        path.getFileSystem(self._hadoop).mkdirs(path)

    @property
    def _hadoop(self):
        return self.spark._jsc.hadoopConfiguration()

    def _path(self, job_id: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{job_id}" if job_id else self.folder)

    def _exists(self, job_id: str) -> bool:
        path = self._path(job_id)
        return bool(job_id) and path.getFileSystem(self._hadoop).exists(path)

    def _write(self, job: dict) -> None:
        row = tuple(job.get(f) for f in JOB.fieldNames())
        self.spark.createDataFrame([row], JOB).coalesce(1).write.mode("overwrite").json(f"{self.folder}/{job['job_id']}")

    def all(self) -> DataFrame:
        fs = self._path("").getFileSystem(self._hadoop)
        if not fs.listStatus(self._path("")):
            return self.spark.createDataFrame([], JOB)
        return self.spark.read.schema(JOB).option("recursiveFileLookup", True).json(self.folder)

    def get(self, job_id: str) -> Row:
        if not self._exists(job_id):
            raise UnknownJob(job_id)
        return self.spark.read.schema(JOB).json(f"{self.folder}/{job_id}").first()

    def submit(self, columns: Sequence[str] | None, partner_id: int | None, table_name: str | None, available: Sequence[str]) -> dict:
        """A new job; one that asks for unknown columns is kept as failed and refused."""
        if not columns or partner_id is None or not table_name:
            raise BadRequest("a job needs columns, partner_id and table_name")
        job = {"job_id": new_id(), "columns": list(columns), "partner_id": partner_id, "table_name": table_name, "status": "waiting", "cause": None}
        if missing := missing_columns(columns, available):
            job |= {"status": "failed", "cause": f"unknown columns: {', '.join(missing)}"}
            self._write(job)
            raise BadRequest(job["cause"])
        self._write(job)
        return job

    def update(self, job_id: str, columns: Sequence[str]) -> dict:
        job = self.get(job_id).asDict() | {"columns": list(columns)}
        self._write(job)
        return job

    def fail(self, job_id: str, cause: str) -> None:
        if self._exists(job_id):
            self._write(self.get(job_id).asDict() | {"status": "failed", "cause": cause})

    def delete(self, job_id: str) -> None:
        if not self._exists(job_id):
            raise UnknownJob(job_id)
        path = self._path(job_id)
        path.getFileSystem(self._hadoop).delete(path, True)


def run_job(spark: SparkSession, job: Row, load: Callable[[], DataFrame], settings: Settings = Settings(), store: Callable = store_compartments) -> Outcome:
    """Loads the table, takes the job's columns through the pipeline, and stores the compartments."""
    df = load().select(*[F.col(f"`{c}`") for c in job["columns"]])
    outcome = AnonymizationPipeline(spark, settings).run(df)
    store(outcome.table, outcome.compartments, job["table_name"])
    return outcome


def work(store: JobStore, handle: Callable[[Row], None], checkpoint: str, every: str | None = None):
    """A streaming query that hands over each job that comes in and then deletes it; one that fails is kept as failed.

    ``every``: trigger interval such as ``30 seconds``; None: what is there
    now, then stop.
    """

    def batch(jobs: DataFrame, _: int) -> None:
        rows = jobs.where("status = 'waiting'").orderBy(F.size("columns"), "job_id").collect()  # jobs of one batch
        for job in rows:
            try:
                handle(job)
            except Exception as e:  # the job is at fault, not those behind it: it stays, with its cause
                store.fail(job["job_id"], f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
            else:
                store.delete(job["job_id"])

    stream = store.spark.readStream.schema(JOB).option("recursiveFileLookup", True).json(store.folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
