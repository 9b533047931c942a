"""Keyframe plans and frame reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FRAME_CAP, FRAME_STEP, MAX_FRAMES
from .text import filled, present


def duration(frames: Column, fps: Column) -> Column:
    """Whole seconds; null where the rate is 0 or missing."""
    return F.floor(F.try_divide(frames.cast("double"), fps.cast("double"))).cast("int")


def frame_offsets(seconds: Column, cap: int | None = FRAME_CAP) -> Column:
    """0, 30, ... below the duration, of which `cap` seconds count, or all where it is None; none at 0 or below, null for null."""
    whole = seconds.cast("int")
    end = whole if cap is None else F.when(whole.isNotNull(), F.least(whole, F.lit(cap)))  # least alone would skip a null
    return F.when(end > 0, F.sequence(F.lit(0), end - 1, F.lit(FRAME_STEP))).when(end.isNotNull(), F.array().cast("array<int>"))


def frame_plan(seconds: Column, path: Column | None = None) -> Column:
    """array<struct<frame_number, offset_s, path>>, numbered from 1."""
    place = lambda i: F.concat_ws("/", path, F.concat((i + 1).cast("string"), F.lit(".jpg"))) if path is not None else F.lit(None).cast("string")
    return F.transform(frame_offsets(seconds), lambda s, i: F.struct((i + 1).cast("int").alias("frame_number"), s.alias("offset_s"), place(i).alias("path")))


def wide(frames: Column, name: str, prefix: str) -> list[Column]:
    """Field `name` of the first six frames as columns prefix_1 to prefix_6; null past the end."""
    return [F.get(frames, F.lit(i))[name].alias(f"{prefix}_{i + 1}") for i in range(MAX_FRAMES)]


def frame_heading(number: Column, seconds: Column) -> Column:
    return F.concat(F.lit("### Frame "), number.cast("string"), F.lit(" at "), seconds.cast("string"), F.lit(" seconds:\n"))


def frame_report(frames: Column) -> Column:
    """A section for every frame whose analysis is neither null nor empty, in order: heading, analysis, on-screen text."""

    def section(f: Column) -> Column:
        return F.concat(frame_heading(f["frame_number"], f["offset_s"]), f["analysis"], F.lit("\nOCR:\n"), filled(f["ocr"]), F.lit("\n"))

    shown = F.filter(frames, lambda f: present(f["analysis"]))
    return F.coalesce(F.array_join(F.transform(shown, section), ""), F.lit(""))


def media_path(root: str, *parts: Column) -> Column:
    return F.concat_ws("/", F.lit(root), *parts)
