"""Parsed lines of runs, kept so that those of a few runs are found without reading the others.

Every micro-batch adds a part, cut into buckets by run. Of each level, FAN_IN parts are merged into one of the next, which leaves
out what lies behind the known end of its run and is needed no more, so that after n batches there are at most
FAN_IN parts on each of log(n) levels. The parts that are alive after a batch are listed in a table of that batch;
a batch starts from the list of the one before, so that a batch that is run again after a failure finds what it found
the first time. Parts leave the disk once the lists of the last two batches are without them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelyard.session import delete_folder, is_folder

BUCKETS = 64
FAN_IN = 4
PARTS_SCHEMA = "level int, name string"


class LineStore:
    """The store in `folder`, as it is seen by micro-batch `batch`; `schema` is that of the lines, run_id among them."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, batch: int, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.batch, self.buckets = spark, folder, schema, batch, buckets
        self.before = self._listed(batch - 1)
        self.mine = f"{folder}/parts/0-{batch}"

    def _listed(self, batch: int) -> list[tuple[int, str]]:
        path = f"{self.folder}/lists/batch={batch}"
        if batch < 0 or not is_folder(self.spark, path):
            return []
        return sorted((r["level"], r["name"]) for r in self.spark.read.schema(PARTS_SCHEMA).json(path).collect())

    def _bucket(self):
        return F.pmod(F.xxhash64("run_id"), F.lit(self.buckets)).cast("int")

    def _write(self, lines: DataFrame, path: str) -> None:
        # A bucket of a batch is written by the tasks that have it; a hot run is split by the hint.
        bucketed = lines.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(path)

    def add(self, lines: DataFrame) -> DataFrame:
        """Write this batch's lines and read them back."""
        self._write(lines, self.mine)
        return self._read(self.mine).drop("bucket")

    def earlier(self, runs: DataFrame) -> DataFrame:
        """The lines that batches before this one brought of some runs (run_id); reads their buckets only."""
        wanted = [r[0] for r in runs.select(self._bucket().alias("bucket")).distinct().collect()]
        parts = [self._read(f"{self.folder}/parts/{name}") for _, name in self.before] if wanted else []
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        found = reduce(DataFrame.unionByName, [p.filter(F.col("bucket").isin(wanted)) for p in parts]).drop("bucket")
        return found.join(runs, "run_id", "left_semi")

    def close(self, ends: DataFrame) -> None:
        """Merge what is due, list the parts that are alive now, and delete those that no batch will ask for.

        `ends` has run_id and end, the first terminal line that is known of the run or null.
        """
        alive = [*self.before, (0, f"0-{self.batch}")]
        level = 0
        while len(full := [name for at, name in alive if at == level]) >= FAN_IN:
            rows = reduce(DataFrame.unionByName, [self._read(f"{self.folder}/parts/{name}").drop("bucket") for name in full])
            kept = rows.join(ends.select("run_id", "end"), "run_id", "left").filter("end is null or seq <= end").drop("end")
            merged = f"{level + 1}-{self.batch}"
            self._write(kept, f"{self.folder}/parts/{merged}")
            alive = [(at, name) for at, name in alive if at != level] + [(level + 1, merged)]
            level += 1
        listed = self.spark.createDataFrame(alive, PARTS_SCHEMA).coalesce(1)
        listed.write.mode("overwrite").json(f"{self.folder}/lists/batch={self.batch}")
        needed = {name for _, name in [*self.before, *alive]}
        for _, name in self._listed(self.batch - 2):
            if name not in needed:
                delete_folder(self.spark, f"{self.folder}/parts/{name}")
        if self.batch >= 3:
            delete_folder(self.spark, f"{self.folder}/lists/batch={self.batch - 3}")
