"""A profile that grows with a stream of appended values.

Each micro-batch brings ``pos, c`` rows. The values so far and the partial
profile are Parquet tables below one folder; a batch compares only pairs with a
new window (older tiles are left out) and merges the result, which is
idempotent, so a batch that is run again changes nothing. Short series are sent
to every executor, longer ones go by blocks, as in the batch strategies.

The folder is all the state: a partial profile's name has its number and the
windows that it covers, so a new stream on the folder goes on where the last
complete one ended. The one before it stays for readers; older ones are deleted.

    stream = ProfileStream(spark, folder, m=64)
    source.writeStream.foreachBatch(stream.update).start()
    stream.profile()
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifgrid.operators.profiles import best, finished
from motifgrid.plans import strategies
from motifgrid.plans.strategies import TILE, default_band, partial_broadcast, partial_shuffle, window_positions
from motifgrid.storage import names_in, remove


class ProfileStream:
    def __init__(self, spark: SparkSession, folder: str, m: int, exclusion: int | None = None, tile_size: int = TILE):
        self.spark, self.folder, self.m, self.size = spark, folder.rstrip("/"), m, tile_size
        self.band = default_band(m) if exclusion is None else exclusion

    def _versions(self) -> list[tuple[int, int]]:
        """Number and covered windows of the complete partial profiles, oldest first."""
        home = f"{self.folder}/partial"
        return sorted(tuple(map(int, name.split("-"))) for name in names_in(self.spark, home) if "_SUCCESS" in names_in(self.spark, f"{home}/{name}"))

    def series(self) -> DataFrame:
        return self.spark.read.schema("pos bigint, c bigint").parquet(f"{self.folder}/values/*")

    def _partial(self, version: int, covered: int) -> DataFrame:
        return self.spark.read.schema("pos bigint, r double, nn bigint").parquet(f"{self.folder}/partial/{version}-{covered}")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch in; for ``foreachBatch``. Positions must go on without gaps over the batches."""
        batch.select("pos", "c").write.mode("overwrite").parquet(f"{self.folder}/values/{batch_id}")
        series = self.series()
        n, last = series.agg(F.count("*"), F.max("pos")).first()
        if n and n != last + 1:
            raise ValueError(f"{n} rows for positions up to {last}: positions must be 0 to n - 1, each once")
        if n < self.m:
            return
        done = self._versions()
        version, covered = done[-1] if done else (-1, 0)
        plan = partial_broadcast if n <= strategies.BROADCAST_VALUES else partial_shuffle
        new = plan(series, self.m, self.band, self.size, since=covered)
        if done:
            new = new.unionByName(self._partial(version, covered))
        best(new).write.mode("overwrite").parquet(f"{self.folder}/partial/{version + 1}-{n - self.m + 1}")
        for old in done[:-1]:
            remove(self.spark, f"{self.folder}/partial/{old[0]}-{old[1]}")

    def profile(self) -> DataFrame:
        """``pos, dist, nn`` over the values that the last complete partial profile covers."""
        version, covered = self._versions()[-1]
        positions = window_positions(self.series(), self.m).filter(F.col("pos") < covered)
        return finished(self._partial(version, covered), positions, self.m)
