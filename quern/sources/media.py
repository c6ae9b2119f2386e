"""Time lines of audio and video: windows, strides and merged lines. Speech and pictures are read by models outside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import timestamp_label

#: Seconds of a window, and most windows of a file.
WINDOW, MOST = 10.0, 60


def stride(duration: Column, window: float = WINDOW, most: int = MOST) -> Column:
    """Seconds between windows: wider for long files, so that none is cut off."""
    return F.greatest(F.lit(window), duration / most)


def windows(df: DataFrame, key: str, duration: str, *, window: float = WINDOW, most: int = MOST) -> DataFrame:
    """Windows (key, window_no, start_seconds, end_seconds) over each file, the last one clipped. Files without a length have none."""
    d = F.col(duration).cast("double")
    rows = df.where(d > 0).select(key, d.alias("d"), stride(d, window, most).alias("hop"))
    many = rows.withColumn("window_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("d") / F.col("hop")).cast("int") - 1, F.lit(0)))))
    start = F.col("window_no") * F.col("hop")
    return many.select(key, "window_no", F.round(start, 6).alias("start_seconds"), F.round(F.least(start + window, F.col("d")), 6).alias("end_seconds"))


def timeline(lines: DataFrame, by: list[str], at: str, source: str, line: str) -> DataFrame:
    """Lines of several sources in order of time, those of one second by source, as one text with time labels."""
    row = F.struct(F.col(at).alias("t"), F.col(source).alias("s"), F.concat(F.lit("["), timestamp_label(F.col(at)), F.lit("] "), F.col(line)).alias("l"))
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["l"]), "\n").alias("transcript"))
