"""Tallies over a stream of votes. The inventory has no streams: this is our own extension.

The bounded operators work on a stream's micro-batches as they are; only what has to remember
earlier rows is here. State is bounded by the watermark: windows older than it are emitted
and forgotten.
"""

from pyspark.sql import DataFrame, functions as F

from fernweave.operators.aggregate import tally


def windowed_tally(votes: DataFrame, time: str, keys: list[str], outcome: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and keys of a stream (or a table): the outcomes' tally with its interval.
    Votes over `late` behind the latest one are dropped; those without a time are too."""
    timed = votes.where(F.col(time).isNotNull()).withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("window"), *keys).agg(*tally(outcome)).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "*").drop("window")


def latest_votes(votes: DataFrame, time: str, voter: str, subject: str, late: str = "2 hours") -> DataFrame:
    """A stream with one row for each repeated delivery of a vote within the watermark."""
    return votes.withWatermark(time, late).dropDuplicatesWithinWatermark([voter, subject])
