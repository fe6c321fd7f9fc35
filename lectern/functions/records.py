"""Settings, statuses, counters and labels of jobs and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip

# Statuses, truths, agents.
PENDING, DONE = ("queued", "in_progress"), "completed"
FAILURES = {"budget_exceeded": "quota", "requires_action": "waiting for input", "cancelled": "cancelled", "incomplete": "incomplete", "failed": "failed"}
TRUE = ("1", "true", "yes", "on")
AGENTS = {"standard": "deep-research-preview-04-2026", "max": "deep-research-max-preview-04-2026", "pro": "deep-research-pro-preview-12-2025"}


def int_setting(value: Column, default: int) -> Column:
    """A whole number, or the default for anything else."""
    text = strip(F.coalesce(value, F.lit("")))
    return F.coalesce(F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long")), F.lit(default).cast("long"))


def float_setting(value: Column, default: float) -> Column:
    text = strip(F.coalesce(value, F.lit("")))
    return F.coalesce(F.when(text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text.try_cast("double")), F.lit(default))


def bool_setting(value: Column, default: bool = False) -> Column:
    return F.when(value.isNull(), F.lit(default)).otherwise(F.lower(strip(value)).isin(*TRUE))


def playback_speed(value: Column) -> Column:
    """A speed from 0.5 to 3; null for anything else."""
    speed = strip(value).try_cast("double")
    return F.when(speed.between(0.5, 3), speed)


def meta_object(value: Column) -> Column:
    """A JSON object of strings; single quotes are read as double ones if it is none as it stands."""
    read = lambda text: F.when(strip(text).startswith("{"), F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}))
    lenient = F.replace(F.translate(F.translate(value, '"', ""), "'", '"'), F.lit("\\\\"), F.lit("/"))
    return F.coalesce(read(value), read(lenient))


def merged_meta(catalogue: Column, explicit: Column) -> Column:
    """Explicit entries over the catalogue's."""
    keys = F.map_keys(explicit)
    return F.map_concat(F.map_filter(catalogue, lambda k, _: ~F.array_contains(keys, k)), explicit)


def outcome(status: Column) -> Column:
    """pending, done, a kind of failure, or unexpected."""
    kinds = F.create_map(*[F.lit(x) for pair in ({p: "pending" for p in PENDING} | {DONE: "done"} | FAILURES).items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, status), F.lit("unexpected"))


def agent_id(name: Column) -> Column:
    """A research agent by its short name or id; null if there is none."""
    key = strip(F.coalesce(name, F.lit("standard")))
    known = F.create_map(*[F.lit(x) for pair in AGENTS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.when(key.startswith("deep-research"), key))


def searches(steps: Column) -> Column:
    """How many steps are searches and not their results (an array of kinds)."""
    return F.size(F.filter(F.coalesce(steps, F.array().cast("array<string>")), lambda s: F.contains(s, F.lit("search")) & ~F.contains(s, F.lit("result"))))


def job_detail(engine: Column, voice: Column, container: Column, output: Column) -> Column:
    named = lambda c, otherwise: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(otherwise)
    box = F.when(F.coalesce(container, F.lit("")) != "", F.upper(container))
    return F.concat(F.concat_ws(" · ", named(engine, "default engine"), named(voice, "default voice"), box), F.lit(" → "), output)


def book_label(title: Column, author: Column, book_id: Column, downloads: Column) -> Column:
    return F.concat(title, F.lit(" — "), author, F.lit("  (#"), book_id.cast("string"), F.lit(", "), F.format_number(downloads, 0), F.lit(" downloads)"))


def voice_line(name: Column, gender: Column, tags: Column) -> Column:
    """A voice as a line of the voice list; language and locale come from the name."""
    parts = F.split(name, "-", -1)
    return F.concat(F.concat_ws(",", name, F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), gender), F.lit(',"'), F.array_join(tags, ","), F.lit('"'))
