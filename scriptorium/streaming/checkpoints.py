"""A batch's checkpoint: its papers' statuses, waves and final pass, as stored tables.

``papers`` has a row a paper, ``run`` one row for the batch, ``before`` the ids of the papers that were
there when the batch began. Each call is one version of the table that it changes, so an earlier
state can be read, and a writer that comes second works on what the first one left.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.stored import StoredTable, VersionTaken
from scriptorium.streaming.waves import CHECKPOINT_DEFAULTS

# Fixed values.
TIERS = ("paper-only", "full")
FINAL_PASS = ("pending", "in-progress", "ok", "failed", "skipped")
STALE = timedelta(hours=24)
_RUN = "id int, run_id string, status string, total long, wave_size int, last_completed_wave int, squash_base string, wave_commits array<string>, tier string, final_pass_status string, deleted boolean"
_PAPERS = ("paper_id", "status", "error", "wave")


class Checkpoint:
    """The checkpoint under a folder; ``None`` of it is there before :meth:`create` and after :meth:`delete`."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self._run, self._papers, self._before = (StoredTable(spark, f"{root.rstrip('/')}/{name}") for name in ("run", "papers", "before"))

    @classmethod
    def create(cls, spark: SparkSession, root: str, papers: DataFrame, wave_size: int, squash_base: str = "", tier: str = "paper-only", before: DataFrame | None = None, run_id: str | None = None, buckets: int = 16) -> Checkpoint:
        """A new checkpoint in place of whatever there was; ``papers`` and ``before`` have ``paper_id``.

        All papers are pending. A full batch's final pass is pending, another's is skipped for good.
        """
        if tier not in TIERS:
            raise ValueError(f"unknown tier {tier!r}, expected one of {sorted(TIERS)}")
        own = cls(spark, root)
        none = F.lit(None)
        rows = papers.select(F.col("paper_id").cast("string")).distinct().select("paper_id", F.lit("pending").alias("status"), none.cast("string").alias("error"), none.cast("int").alias("wave"))
        ids = spark.createDataFrame([], "paper_id string") if before is None else before.select(F.col("paper_id").cast("string")).distinct()
        for table, new in ((own._papers, rows), (own._before, ids)):
            if table.exists():
                table.replace(new, "create")
            else:
                StoredTable.create(spark, table.root, new, "paper_id", buckets)
        name = run_id or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        run = spark.createDataFrame([(0, name, "in-progress", own._papers.read().count(), wave_size, -1, squash_base, [], tier, "pending" if tier == "full" else "skipped", False)], _RUN)
        if own._run.exists():
            own._run.replace(run, "create")
        else:
            StoredTable.create(spark, own._run.root, run, "id", buckets=1)
        return own

    def run(self, version: int | None = None) -> dict | None:
        """The batch's fields, absent ones by their defaults; None without a checkpoint."""
        if not self._run.exists():
            return None
        row = self._run.read(version).first().asDict()
        if row.pop("deleted"):
            return None
        return row | {name: value for name, value in CHECKPOINT_DEFAULTS.items() if name in row and row[name] is None}

    def _open(self) -> dict:
        if (run := self.run()) is None:
            raise FileNotFoundError("no checkpoint")
        return run

    def papers(self, version: int | None = None) -> DataFrame:
        """``(paper_id, status, error, wave)``; ``wave`` is the last one whose results named the paper."""
        return self._papers.read(version)

    def before(self) -> DataFrame:
        """Papers that were there before the batch."""
        return self._before.read()

    def update(self, results: DataFrame, commit: str) -> int:
        """A wave's results (``paper_id, status, error``) taken over; the wave's number.

        An error stays with its paper until another one comes. Papers that the batch didn't have are added.
        """
        run = self._open()
        wave = run["last_completed_wave"] + 1
        new = results.select(F.col("paper_id").cast("string").alias("paper_id"), F.col("status").alias("_s"), F.when(F.col("error") != "", F.col("error")).alias("_e"))
        old = self._papers.read()
        changed = new.join(old, "paper_id", "left").select("paper_id", F.col("_s").alias("status"), F.coalesce("_e", "error").alias("error"), F.lit(wave).alias("wave"))
        self._papers.merge(changed, f"wave {wave}")
        self._set(f"wave {wave}", lambda own: {"last_completed_wave": own["last_completed_wave"] + 1, "wave_commits": [*own["wave_commits"], commit]})
        return wave

    def pending(self) -> DataFrame:
        """Papers still to do: pending ones, and failed ones for the retry."""
        if self.run() is None:
            return self.spark.createDataFrame([], "paper_id string")
        return self._papers.read().where(F.col("status").isin("pending", "failed")).select("paper_id")

    def is_stale(self, now: datetime | None = None) -> bool:
        """Whether the run began over 24 hours ago, or at a time that can't be read."""
        if (run := self.run()) is None:
            return False
        try:
            began = datetime.fromisoformat((run["run_id"] or "").replace("Z", "+00:00"))
            return (now or datetime.now(timezone.utc)) - began > STALE
        except (ValueError, TypeError):
            return True

    def final_pass(self, status: str) -> None:
        """The final pass's status set; only a full batch has one, and none is skipped later."""
        if status not in FINAL_PASS:
            raise ValueError(f"unknown final pass status {status!r}, expected one of {sorted(FINAL_PASS)}")
        if status == "skipped":
            raise ValueError("'skipped' is set when a checkpoint is created, and never later")
        if (run := self._open())["tier"] != "full":
            raise ValueError(f"only a full batch has a final pass; this one is {run['tier']!r}")
        self._set(f"final pass {status}", lambda own: {"final_pass_status": status})

    def delete(self) -> None:
        """The checkpoint given up; its earlier versions can still be read. Nothing happens without one."""
        if self.run() is not None:
            self._set("delete", lambda own: {"deleted": True})

    def _set(self, operation: str, change) -> None:
        """Fields of the run changed; where another writer came before, its fields are the ones changed."""
        while True:
            version = self._run.at().number
            own = self._run.read(version).first().asDict()
            try:
                self._run.merge(self.spark.createDataFrame([tuple((own | change(own)).values())], _RUN), operation, expect=version)
                return
            except VersionTaken:
                continue
