"""Media times as text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_timestamp(seconds: Column, separator: str = ",") -> Column:
    """``HH:MM:SS<separator>mmm``; null and negative times are 0, milliseconds round half to even."""
    ms = F.rint(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)) * 1000).cast("long")
    part = lambda unit, base: (F.floor(ms / unit) % base).cast("long")
    return F.format_string("%02d:%02d:%02d%s%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), F.lit(separator), (ms % 1000).cast("long"))


def format_chapter_timestamp(seconds: Column) -> Column:
    """``MM:SS`` under an hour, ``H:MM:SS`` above; fractions are cut off."""
    total = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    minutes, secs = (F.floor(total / 60) % 60).cast("long"), (total % 60).cast("long")
    return F.when(total >= 3600, F.format_string("%d:%02d:%02d", F.floor(total / 3600), minutes, secs)).otherwise(F.format_string("%02d:%02d", minutes, secs))


def parse_timestamp(text: Column) -> Column:
    """Seconds of ``MM:SS[.,mmm]`` or ``HH:MM:SS[.,mmm]``; null if it is neither."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    whole = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    seconds = F.try_element_at(parts, F.lit(-1)).try_cast("double")
    return F.when(n == 2, whole(1) * 60 + seconds).when(n == 3, whole(1) * 3600 + whole(2) * 60 + seconds)
