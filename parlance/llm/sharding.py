"""Uniform shuffle into exactly sized shards by a hypergeometric communication matrix (DataFrame operations only).

Law `rows`: shard sizes differ by at most one. Rows are hashed to buckets. How many rows of each bucket go to each
shard is drawn exactly, as a random permutation of all rows would have it (multivariate hypergeometric, without
replacement); each bucket is permuted locally and cut by its row of the matrix; each shard is permuted again, in
cells, and the cells' sizes give gapless slots.

Everything random is a hash of the row's place (part file and line of the written rows), so a task that is run again gives the same
rows, equal rows and rows of one id are spread like all others, and no value is a hot key. The driver holds one count
for each bucket and one matrix row for each bucket: at most `max_buckets` x shards numbers, whatever the input.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: numpy's hypergeometric samplers take populations below this.
_NUMPY_POPULATION = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws` from good + bad without replacement, for populations of any size."""
    if good + bad < _NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    deviation = math.sqrt(max(1.0, draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1)))
    reach = int(14 * deviation) + 20  # what lies outside has no weight in double precision
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    right = np.cumprod((draws - up) * (good - up) / ((up + 1) * (bad - draws + up + 1)))
    left = np.cumprod(down * (bad - draws + down) / ((draws - down + 1) * (good - down + 1)))
    weight = np.concatenate([left[::-1], [1.0], right])
    return int(mode - len(left) + np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right"))


def communication_matrix(counts: list[int], capacity: list[int], seed: int) -> list[list[int]]:
    """Rows: buckets; columns: shards. Row sums are `counts`, column sums are `capacity`."""
    rng, left, matrix = np.random.default_rng(seed), list(capacity), []
    for n in counts:
        row, rest = [], sum(left)
        for k, room in enumerate(left):
            rest -= room
            got = hypergeometric(rng, room, rest, n) if rest and n else min(n, room)
            row.append(got)
            n -= got
            left[k] -= got
        matrix.append(row)
    return matrix


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
               bucket_rows: int = 100_000, min_buckets: int = 64, max_buckets: int = 65_536, cell_rows: int = 20_000) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    size is the UTF-8 bytes of the text and 16; a null text counts as empty. A null id is a value like others.
    Repeated rows each get a slot of their own. An empty table gives no rows. Other columns are not read. Equal input in equal partitions
    gives equal shards.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard-rows")
    total = narrow.count()
    buckets = max(min_buckets, min(max_buckets, -(-total // bucket_rows)))
    cells = max(1, -(-total // (shards * cell_rows)))
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    ranked = narrow.select("*", part.alias("file"), F.col("_metadata.row_index").alias("line"))
    ranked = ranked.withColumn("bucket", F.pmod(F.xxhash64("file", "line", F.lit(seed)), F.lit(buckets)).cast("int"))
    counts = {r["bucket"]: r["count"] for r in ranked.groupBy("bucket").count().collect()}  # a row for each bucket
    order = sorted(counts)
    matrix = communication_matrix([counts[b] for b in order], [total // shards + (s < total % shards) for s in range(shards)], seed)
    cuts = [(b, np.cumsum(row).tolist()) for b, row in zip(order, matrix, strict=True)]
    table = spark.createDataFrame(cuts, "bucket int, cuts array<bigint>")
    local = Window.partitionBy("bucket").orderBy(F.xxhash64("file", "line", F.lit(seed + 1)), "file", "line")
    dealt = (
        ranked.withColumn("rank", F.row_number().over(local) - 1)
        .join(table, "bucket")
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("rank"))))
        .withColumn("mix", F.xxhash64("file", "line", F.lit(seed + 2)))
        .select("doc_id", "size", "text_crc32", "file", "line", "shard", "mix", F.pmod("mix", F.lit(cells)).cast("int").alias("cell"))
    )
    dealt = stored(dealt, "shard-dealt")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    again = Window.partitionBy("shard", "cell").orderBy("mix", "file", "line")
    return dealt.withColumn("place", F.row_number().over(again) - 1).join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
