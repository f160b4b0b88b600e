"""Joins that stay balanced when one key holds a large share of the rows.

Degrees are measured first, and the keys above ``HEAVY`` rows are listed. The
list has at most rows / ``HEAVY`` entries; it is written and counted, and
broadcast up to ``BROADCAST_ROWS``. A longer one is joined by key and salt, so
that the lookup itself meets no hub. Where no key is heavy, the join is the
usual one, after one counting aggregation."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a key that one task takes; a heavier key is cut into parts of this size.
HEAVY = 10_000
#: Entries up to which a list of heavy keys is broadcast.
BROADCAST_ROWS = 10_000


class Hubs:
    """Heavy keys (columns ``on``) with the columns that say how each is cut."""

    def __init__(self, rows: DataFrame, on: list[str], limit: int | None = None):
        self.on, self.n = on, 0
        if not rows.isEmpty():  # mostly it is: then nothing is written
            self.rows = materialize(rows, "hubs")
            self.n = self.rows.count()
        self.limit = BROADCAST_ROWS if limit is None else limit

    @cached_property
    def salted(self) -> tuple[int, DataFrame]:
        """Every entry once for each of as many salts as a shuffle has partitions, written, so that its size is known."""
        salts = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return salts, materialize(self.rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "hubs-salted")

    def of(self, df: DataFrame, by: list[str]) -> DataFrame:
        """``df`` with the hub columns of its keys, null for light keys; ``by`` tells a key's rows apart."""
        if self.n <= self.limit:
            return df.join(F.broadcast(self.rows), self.on, "left")
        salts, each = self.salted
        return (df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
                .join(each, [*self.on, "_salt"], "left").drop("_salt"))


def _part(by: list[str], parts: str):
    """The part of its key that a row belongs to: 0 for light keys."""
    return F.pmod(F.xxhash64(F.lit("part"), *by), F.coalesce(F.col(parts), F.lit(1))).cast("int")


def _each(parts: str):
    """Every part of the key: only 0 for light keys."""
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))


def heavy_keys(df: DataFrame, on: list[str], heavy: int | None = None) -> Hubs:
    """Keys of more than ``heavy`` rows, with the number of ``parts`` to cut them into. Rows with a null
    key join with nothing and are not counted."""
    heavy = HEAVY if heavy is None else heavy
    n = df.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > heavy)
    return Hubs(n.select(*on, F.ceil(F.col("n") / heavy).cast("int").alias("parts")), on)


def cut(df: DataFrame, hubs: Hubs, by: list[str]) -> DataFrame:
    """``df`` with ``part``, by a hash of ``by``."""
    return hubs.of(df, by).withColumn("part", _part(by, "parts")).drop("parts")


def repeated(df: DataFrame, hubs: Hubs, by: list[str]) -> DataFrame:
    """``df`` with every row once for each ``part`` of its key."""
    return hubs.of(df, by).withColumn("part", _each("parts")).drop("parts")


def fanout_join(left: DataFrame, right: DataFrame, on: list[str], heavy: int | None = None,
                limit: int | None = None) -> DataFrame:
    """Inner equi-join of two pair relations on ``on``, exact, in which no hub key fills a task.

    A key with L left and R right rows is cut into a = ceil(L / heavy) left
    and b = ceil(R / heavy) right parts; left rows are repeated for the b
    right parts and right rows for the a left ones, so that each of the a * b
    cells joins about ``heavy`` rows with ``heavy`` rows at most. The repeated
    rows are 2 * L * R / heavy, a small share of the L * R rows of the result.
    A key with rows on one side only is not cut. Both sides are written once,
    as they are read twice. Column names other than ``on`` must differ."""
    heavy = HEAVY if heavy is None else heavy
    left, right = materialize(left, "fan-left"), materialize(right, "fan-right")

    both = left.select(*on, F.lit(True).alias("_left")).unionByName(right.select(*on, F.lit(False).alias("_left")))
    n = both.dropna(subset=on).groupBy(*on).agg(F.count_if("_left").alias("l"), F.count_if(~F.col("_left")).alias("r"))
    n = n.where((F.col("l") > 0) & (F.col("r") > 0) & (F.greatest("l", "r") > heavy))
    hubs = Hubs(n.select(*on, F.ceil(F.col("l") / heavy).cast("int").alias("_a"),
                         F.ceil(F.col("r") / heavy).cast("int").alias("_b")), on, limit)
    if hubs.n == 0:
        return left.join(right, on)
    lv, rv = ([c for c in df.columns if c not in on] or on for df in (left, right))
    cells_l = hubs.of(left, lv).select(*left.columns, _part(lv, "_a").alias("_lp"), _each("_b").alias("_rp"))
    cells_r = hubs.of(right, rv).select(*right.columns, _part(rv, "_b").alias("_rp"), _each("_a").alias("_lp"))
    return cells_l.join(cells_r, [*on, "_lp", "_rp"]).drop("_lp", "_rp")
