"""Live tables: streamed upserts and deletes, versions, compaction, rate limits."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._shared import shared_table
from .._ship import ship
from ..errors import GleaneryError


class LiveTable:
    """Rows by id with tombstones: a base version and the batches since.

    A batch is one transaction: its rows appear whole or not at all, and a batch
    that a stream sends again after a failure changes nothing.  A batch costs its
    own rows only; ``compact`` merges batches into a new base.  One writer at a
    time, as one streaming query gives it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], check: Callable[[DataFrame], None] | None = None):
        self.spark, self.path, self.key, self.order, self.check = spark, path, key, order, check

    def _parts(self) -> list[tuple[int, str, str]]:
        """(number, kind, name) of complete parts, in order."""
        filesystem, root = fs.FileSystem.from_uri(self.path)
        if filesystem.get_file_info(root).type == fs.FileType.NotFound:
            return []
        names = [i.base_name for i in filesystem.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory]
        found = [(int(m[2]), m[1], n) for n in names if (m := re.fullmatch(r"(base|batch)=(\d+)(?:-.*)?", n))]
        return sorted(p for p in found if filesystem.get_file_info(f"{root}/{p[2]}/_SUCCESS").type == fs.FileType.File)

    def version(self) -> int | None:
        return max((number for number, *_ in self._parts()), default=None)

    def _latest(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """One row a key: the last in order.  An aggregate, so that a hot key meets partly in every task first."""
        rest = [c for c in columns if c not in (self.key, *self.order)]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.order, *rest), F.struct(*self.order, "__part")).alias("r"))
        return last.select(self.key, "r.*").select(*columns)

    def read(self) -> DataFrame:
        """The latest row of every key, tombstones included."""
        parts = self._parts()
        if not parts:
            raise GleaneryError("EMPTY", "the table has no version yet")
        base = max((number for number, kind, _ in parts if kind == "base"), default=-1)
        wanted = [p for p in parts if p[0] >= base]
        frames = [self.spark.read.parquet(f"{self.path}/{name}").withColumn("__part", F.lit(number)) for number, _, name in wanted]
        rows = frames[0]
        for df in frames[1:]:
            rows = rows.unionByName(df)
        columns = [c for c in rows.columns if c != "__part"]
        return rows.drop("__part") if len(frames) == 1 else self._latest(rows, columns)

    def live(self) -> DataFrame:
        return self.read().where("not deleted").drop("deleted")

    def apply(self, batch: DataFrame, batch_id: int | str = "") -> None:
        """Upsert a batch of rows with a ``deleted`` flag; the latest row of a key wins.

        ``check`` sees the whole batch first and raises to refuse it.
        """
        parts, name = self._parts(), re.sub(r"\W", "_", str(batch_id))
        if name and any(p[2].partition("-")[2] == name for p in parts):
            return
        if self.check is not None:
            self.check(batch)
        number = max((p[0] for p in parts), default=-1) + 1
        rows = self._latest(batch.withColumn("__part", F.lit(0)), batch.columns)
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}" + (f"-{name}" if name else ""))

    def delete(self, ids: DataFrame, batch_id: int | str = "") -> DataFrame:
        """Tombstones for ``key`` rows; returns ``key, deleted_now``: false for ids that aren't live."""
        live = self.live()
        hit = live.join(ids.select(self.key).distinct(), self.key, "left_semi").withColumn("deleted", F.lit(True))
        kept = shared_table(hit, "tombstones")
        self.apply(kept, batch_id)
        told = kept.select(self.key, F.lit(True).alias("deleted_now"))
        return ids.select(self.key).distinct().join(told, self.key, "left").select(self.key, F.coalesce("deleted_now", F.lit(False)).alias("deleted_now"))

    def compact(self, keep: int = 1) -> None:
        """A base without tombstones; ids stay as they are.  ``keep`` older bases stay for readers, with their batches."""
        self.read().where("not deleted").write.mode("overwrite").parquet(f"{self.path}/base={self.version() + 1}")
        parts = self._parts()
        bases = [number for number, kind, _ in parts if kind == "base"]
        oldest = bases[max(0, len(bases) - 1 - keep)] if len(bases) > keep else -1
        filesystem, root = fs.FileSystem.from_uri(self.path)
        for number, kind, name in parts:
            if number < oldest and not (kind == "batch" and "-" in name and number == max((p[0] for p in parts if p[1] == "batch"), default=-1)):
                filesystem.delete_dir(f"{root}/{name}")

    def compact_if(self, share: float = 0.5) -> bool:
        """Compact once so large a share of the rows is deleted."""
        heavy = self.stats().first()["ratio"] >= share
        if heavy:
            self.compact()
        return heavy

    def stats(self) -> DataFrame:
        share = F.count_if("deleted") / F.greatest(F.count("*"), F.lit(1))
        return self.read().agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("deleted"), share.alias("ratio"))


def memory_estimate(rows: int, dim: int, m: int = 12, quantized: bool = True) -> int:
    """Bytes that rows would take in a resident graph index; a guard before anything is collected."""
    return rows * (dim + 16 * m + 39 if quantized else 4 * dim + 8 * m + 23)


def ingest(stream: DataFrame, table: LiveTable, checkpoint: str, name: str = "stream") -> None:
    """Run a stream's available rows into a table, a transaction for each micro-batch, each applied once."""
    send = lambda batch, number: table.apply(batch, f"{name}_{number}")
    stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Windows are counted in stretches of so many times their length, so that a busy user spreads over tasks.
STRETCH = 64


def request_windows(events: DataFrame, seconds: int = 60) -> DataFrame:
    """``event_id, user_id, in_window``: an upper bound of a user's requests in the last seconds.

    Time is cut into stretches; what a stretch needs of the one before, its last
    window, is copied into it.
    """
    window, stretch = seconds * 1_000_000, STRETCH * seconds * 1_000_000
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    own = F.expr(f"us div {stretch}") - F.when((F.col("us") < 0) & (F.pmod("us", F.lit(stretch)) != 0), 1).otherwise(0)
    late = F.pmod("us", F.lit(stretch)) >= stretch - window
    rows = rows.withColumn("at", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("copy", F.col("at") != own)
    recent = Window.partitionBy("user_id", "at").orderBy("us").rangeBetween(-window + 1, 0)
    return rows.withColumn("in_window", F.count("*").over(recent)).where("not copy").select("event_id", "user_id", "in_window")


def rate_limited(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """``event_id, user_id, accepted``: only accepted requests count towards the limit.

    Each user's requests are folded in order, batch by batch: state is the last
    ``limit`` accepted times, whatever the number of requests.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, []
        for frame in frames:
            flags = []
            for u, us in zip(frame["user_id"], frame["us"]):
                if u != user:
                    user, held = u, []
                while held and us - held[0] >= seconds * 1_000_000:
                    held.pop(0)
                flags.append(len(held) < limit)
                if flags[-1]:
                    held.append(us)
            yield frame[["event_id", "user_id"]].assign(accepted=flags)

    ship(events.sparkSession)
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInPandas(run, "event_id long, user_id long, accepted boolean")
