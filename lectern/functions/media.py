"""Times, rates, names and escapes of the media plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srt_time(ms: Column) -> Column:
    ms = F.greatest(ms.cast("long"), F.lit(0).cast("long"))
    part = lambda unit, base: (F.floor(ms / unit) % base).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), (ms % 1000).cast("long"))


def rate_text(speed: Column) -> Column:
    """A factor as +N% or -N%, half to even; null outside [0.25, 5)."""
    percent = lambda x: F.bround(x * 100, 0).cast("long").cast("string")
    text = F.when(speed < 1, F.concat(F.lit("-"), percent(1 - speed), F.lit("%"))).otherwise(F.concat(F.lit("+"), percent(speed - 1), F.lit("%")))
    return F.when((speed >= 0.25) & (speed < 5), text)


def tempo_factors(speed: Column) -> Column:
    """A speed as factors of 2 or 0.5 and a rest within [0.5, 2]."""
    steps = F.when(speed > 2, F.ceil(F.log2(speed)) - 1).when(speed < 0.5, F.ceil(-F.log2(speed)) - 1).otherwise(0).cast("int")
    unit = F.when(speed > 1, F.lit(2.0)).otherwise(F.lit(0.5))
    return F.concat(F.array_repeat(unit, F.greatest(steps, F.lit(0))), F.array(speed / F.pow(unit, steps)))


def significant(x: Column, digits: int = 6) -> Column:
    """A positive number with six significant digits and no trailing zeros."""
    places = F.lit(digits - 1) - F.floor(F.log10(x)).cast("int")
    scaled = F.bround(x * F.pow(F.lit(10.0), places), 0) / F.pow(F.lit(10.0), places)
    return F.regexp_replace(F.regexp_replace(F.format_string("%.9f", scaled), "0+$", ""), r"\.$", "")


def tempo_chain(speed: Column) -> Column:
    return F.array_join(F.transform(tempo_factors(speed), lambda f: F.concat(F.lit("atempo="), significant(f))), ",")


def escaped_meta(value: Column) -> Column:
    return F.translate(F.regexp_replace(value, r"([\\=;#])", r"\\$1"), "\n", " ")


def playlist_line(path: Column) -> Column:
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def chunk_name(index: Column, suffix: str = ".mp3") -> Column:
    return F.format_string(f"chunk_%05d{suffix}", index)


def pcm16(sample: Column) -> Column:
    """A float sample as 16-bit PCM, clipped at one."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sample)) * 32767).cast("int")


def backoff_s(attempt: Column, base: float = 2.0) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt - 1)


def codec(container: Column, suffixes: Column, speed: Column) -> Column:
    """copy only for mp3 parts into mp3 at normal speed; else the container's encoder."""
    plain = speed.isNull() | (F.abs(speed - 1) <= 0.001)
    return F.when((container == "mp3") & (suffixes == F.array(F.lit(".mp3"))) & plain, "copy").when(container == "mp3", "libmp3lame").otherwise("aac")
