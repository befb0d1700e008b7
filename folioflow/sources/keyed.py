"""A table of rows by key that grows with every micro-batch and is read by key.

Every batch adds one *segment*. A segment is cut into folders by the first hexadecimal digits of its
keys' hash, as many digits as keep a folder at about ``rows_per_folder`` rows. A lookup finds out which
prefixes its keys have, and reads only those folders of each segment: what it reads follows the number
of keys asked for, not the size of the table. ``fan_in`` segments of a tier are merged into one of the
next, so there are few segments and every row is written again only as often as there are tiers.

Segments count once their marker file is there, and merged ones are removed with the next batch: a
batch or a merge that broke off is simply done again, and no reader sees half of it. There is one writer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.shared import delete, exists, file_system, materialise, no_rows

_NAME = re.compile(r"t(\d+)-(\d+)-(\d+)-d(\d+)$")
MARKER = "_COMPLETE"


class KeyedTable:
    """Rows ``(key, …)`` below ``folder``; of several rows of a key the newest with a value counts.

    ``schema`` holds the columns, ``key`` (a string) among them. Columns named in ``add`` are summed over
    all rows of a key. ``keep`` is the number of latest batches that stay segments of their own, so
    that a batch can be run again.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, key: str, add: Sequence[str] = (),
        rows_per_folder: int = 1_000, most_digits: int = 4, fan_in: int = 8, keep: int = 2,
    ) -> None:
        self.spark, self.folder, self.key, self.add = spark, folder, key, list(add)
        self.schema = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        self.values = [f.name for f in schema.fields if f.name != key and f.name not in self.add]
        self.rows_per_folder, self.most_digits, self.fan_in, self.keep = rows_per_folder, most_digits, fan_in, keep

    def _prefix(self, digits: int) -> Column:
        return F.left(F.md5(F.col(self.key).cast("binary")), F.lit(digits))

    def segments(self) -> list[tuple[int, int, int, int, str]]:
        """``(tier, first batch, last batch, digits, path)`` of all complete segments that no other one covers."""
        fs, at = file_system(self.spark, self.folder)
        if not fs.exists(at):
            return []
        found = []
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            parts = _NAME.match(name)
            if parts and exists(self.spark, f"{self.folder}/{name}/{MARKER}"):
                found.append((*map(int, parts.groups()), f"{self.folder}/{name}"))
        # a merged segment and the ones it was made of may both be there after a failure
        return sorted(s for s in found if not any(o[0] > s[0] and o[1] <= s[1] and s[2] <= o[2] for o in found))

    def holds(self, batch_id: int) -> bool:
        return any(first <= batch_id <= last for _, first, last, _, _ in self.segments())

    def digits_for(self, n: int) -> int:
        """Digits of the folders of a segment of ``n`` rows."""
        return min(self.most_digits, max(0, math.ceil(math.log(max(n, 1) / self.rows_per_folder, 16)))) if n else 0

    def dealt(self, rows: DataFrame, n: int) -> DataFrame:
        """``rows`` as a segment of ``n`` rows wants them: those of a folder in one task."""
        digits = self.digits_for(n)
        return rows.repartition(self._slots(digits), self._prefix(digits))

    def _slots(self, digits: int) -> int:
        """Tasks that write the folders of a segment. What they cost is files, not bytes: a number that is
        not given would be merged by bytes, and a single task would open thousands of small files."""
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return min(16 ** digits, max(4 * self.spark.sparkContext.defaultParallelism, partitions))

    def _write(self, rows: DataFrame, tier: int, first: int, last: int, n: int | None = None) -> None:
        whole = n is None
        n = rows.count() if whole else n
        digits = self.digits_for(n)
        path = f"{self.folder}/t{tier}-{first}-{last}-d{digits}"
        named = rows.select(*self.schema.names, self._prefix(digits).alias("prefix")) if digits else rows.select(*self.schema.names)
        if digits:
            (named.repartition(self._slots(digits), "prefix") if whole else named).write.mode("overwrite").partitionBy("prefix").parquet(path)
        else:
            named.coalesce(1).write.mode("overwrite").parquet(path)  # about a folder's worth of rows
        fs, at = file_system(self.spark, f"{path}/{MARKER}")
        fs.create(at, True).close()

    def write(self, rows: DataFrame, batch_id: int, n: int | None = None) -> None:
        """Add a batch's rows, which are written once before they are counted and dealt to folders.

        With ``n``, the number of rows, they have been ``dealt`` and go to their folders at once. A batch
        that is there already is left alone. Afterwards older segments may be merged.
        """
        if not self.holds(batch_id):
            stamped = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            if n is None:
                self._write(materialise(stamped, "segment"), 0, batch_id, batch_id)
            else:
                self._write(stamped, 0, batch_id, batch_id, n)
        self._merge(batch_id)

    def _merge(self, batch_id: int) -> None:
        # replaced by an earlier merge, or left by a writer that broke off; readers had a batch's time to let go
        live = {s[4] for s in self.segments()}
        fs, at = file_system(self.spark, self.folder)
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if _NAME.match(name) and f"{self.folder}/{name}" not in live:
                delete(self.spark, f"{self.folder}/{name}")
        tier = 0
        while True:
            old = [s for s in self.segments() if s[0] == tier and s[2] <= batch_id - self.keep]
            if len(old) < self.fan_in:
                if not any(s[0] > tier for s in self.segments()):
                    break
                tier += 1
                continue
            rows = self._combined(self._read([s[4] for s in old]))
            self._write(materialise(rows, "merged"), tier + 1, min(s[1] for s in old), max(s[2] for s in old))

    def _read(self, paths: Sequence[str]) -> DataFrame:
        frames = [self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, frames) if frames else no_rows(self.spark, self.schema)

    def _combined(self, rows: DataFrame) -> DataFrame:
        if not self.values:
            newest = []
        else:
            given = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in self.values])
            newest = [F.max_by(F.struct(*self.values), F.when(given, F.col("batch_id"))).alias("_newest")]
        sums = [F.sum(c).alias(c) for c in self.add]
        grouped = rows.groupBy(self.key).agg(*newest, *sums, F.max("batch_id").alias("batch_id"))
        return grouped.select(self.key, *[F.col("_newest")[c].alias(c) for c in self.values], *self.add, "batch_id").select(*self.schema.names)

    def read(self) -> DataFrame:
        """All rows, one per key."""
        return self._combined(self._read([s[4] for s in self.segments()])).drop("batch_id")

    def folders_of(self, keys: DataFrame) -> list[str]:
        """The folders that may hold any of ``keys``: of each segment those of the keys' prefixes.

        At most ``16 ** most_digits`` prefixes reach the driver, whatever the number of keys.
        """
        segments = self.segments()
        if not segments:
            return []
        longest = max(s[3] for s in segments)
        asked = {r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self._prefix(longest).alias("p")).distinct().collect()}
        out = []
        for *_, digits, path in segments:
            if digits == 0:
                out += [path] if asked else []
                continue
            fs, at = file_system(self.spark, path)
            there = {s.getPath().getName() for s in fs.listStatus(at)}
            out += [f"{path}/{name}" for name in sorted({f"prefix={p[:digits]}" for p in asked} & there)]
        return out

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys(key)``, one per key that is there; ``keys`` should be a written table."""
        paths = self.folders_of(keys)
        if not paths:
            return no_rows(self.spark, self.schema).drop("batch_id")
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)
        wanted = rows.join(keys.select(self.key).distinct(), self.key, "left_semi")
        return self._combined(wanted).drop("batch_id")
