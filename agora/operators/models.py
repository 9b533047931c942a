"""Model stages: vectorised, isolated from errors, one evaluation per row.

A client is any object with `run(task, inputs) -> list`, a reply or an exception for each input; it is built once per
Python worker from a factory that pickles. A failing input gives an error, and the others of its batch keep their
replies, so each is asked once; only where the client itself raises is every row of the batch an error. Results are one struct,
and the function is marked nondeterministic so that Spark neither repeats nor
moves it: put filters and anti-joins before.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OCR_LANGUAGES, Decoding, ModelSpec
from ..functions.frames import frame_offsets
from ..schemas import RESULT, SENTIMENT


class ModelClient(Protocol):
    def run(self, task: str, inputs: list) -> list[str | Exception]: ...


class FakeClient:
    """Deterministic replies for tests: the task and the input's length; inputs that contain `fail_on` fail."""

    def __init__(self, fail_on: str | None = None, replies: dict[str, str] | None = None):
        self.fail_on, self.replies = fail_on, replies or {}

    def run(self, task: str, inputs: list) -> list[str | Exception]:
        fails = lambda x: self.fail_on and isinstance(x, str) and self.fail_on in x
        return [ValueError(f"{task} failed") if fails(x) else self.replies.get(task, f"{task}:{len(x)}") for x in inputs]


class ChatServer:
    """A model server with a chat endpoint over HTTP."""

    def __init__(self, url: str, spec: ModelSpec, timeout: float = 600):
        self.url, self.spec, self.timeout = url, spec, timeout

    def run(self, task: str, inputs: list) -> list[str | Exception]:
        out: list[str | Exception] = []
        for x in inputs:
            try:
                out.append(self._one(x))
            except Exception as e:
                out.append(e)
        return out

    def _one(self, content: object) -> str:
        import base64

        user = {"role": "user", "content": content} if isinstance(content, str) else {"role": "user", "content": self.spec.system, "images": [base64.b64encode(content).decode()]}
        body = {"model": self.spec.name, "messages": [{"role": "system", "content": self.spec.system}, user], "options": vars(self.spec.options), "stream": False}
        if self.spec.schema:
            body["format"] = json.loads(self.spec.schema)
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["message"]["content"]


#: The form that replies of the extraction stages must have, as JSON schema.
_NAMES = {"type": "array", "items": {"type": "string"}}
_PAIRS = {"type": "array", "items": {"type": "object", "properties": {"populism_element": {"type": "string"}, "populism_affect": {"type": "string"}}, "required": ["populism_element", "populism_affect"]}}


def _form(properties: dict[str, dict]) -> str:
    return json.dumps({"type": "object", "properties": properties, "required": list(properties)})


SENTIMENT_FORM = _form(dict.fromkeys(SENTIMENT, _NAMES))
FORMULA_FORM = _form({"populism_analysis": {"type": "string"}, "populism_us": _PAIRS, "populism_frontier": _PAIRS})
#: What each model stage asks for (our own wording) and how it decodes.
SPECS = {
    "frame": ModelSpec("llama3.2-vision:11b", "Describe this video frame: framing, visuals, activity, colours, objects, subjects, and whether it is a screen recording.", Decoding(num_ctx=8096)),
    "summary": ModelSpec("llama3.2-vision:11b", "Summarise the politics of the video: narrative, political class, difficult language, topics, entities, sentiment, populism, social contract, grievances.", Decoding(num_ctx=10240)),
    "sentiment": ModelSpec("gemma3:27b", "List topics and entities, and the entities spoken of positively, neutrally and negatively. Merge similar names.", Decoding(num_ctx=4096), SENTIMENT_FORM),
    "formula": ModelSpec("gemma3:27b", "Give the populist formula: demands of Us and others across the Frontier, each a lower-case element with a one-word affect. Group synonyms.", Decoding(num_ctx=8192), FORMULA_FORM),
    "ocr": ModelSpec("ocr", " ".join(OCR_LANGUAGES)),
    "transcribe": ModelSpec("whisper", "Transcribe the speech."),
    "language": ModelSpec("language", "Name the language of the text."),
    "translate": ModelSpec("translate", "Translate the text to English."),
}


def apply(task: str, factory: Callable[[], ModelClient], value: Column, kind: str = "string") -> Column:
    """struct<ok, value, error> of the task on every value; null inputs give an error without a call."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = factory()
        for s in batches:
            asked = [i for i, x in enumerate(s) if x is not None and not (isinstance(x, float) and x != x)]
            try:
                replies = client.run(task, [s.iloc[i] for i in asked])
            except Exception as e:
                replies = [e] * len(asked)
            got = {i: (False, None, str(r)[:500]) if isinstance(r, Exception) else (True, r, None) for i, r in zip(asked, replies, strict=True)}
            rows = [got.get(i, (False, None, "no input")) for i in range(len(s))]
            yield pd.DataFrame(rows, columns=["ok", "value", "error"])

    return F.pandas_udf(run, RESULT).asNondeterministic()(value)  # type: ignore[call-overload]


def run_stage(df: DataFrame, task: str, factory: Callable[[], ModelClient], value: Column, keys: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """(keys..., ok, value, error), over as many partitions as the model servers take requests."""
    rows = df.select(*keys, value.alias("__in"))
    rows = rows.repartition(partitions) if partitions else rows
    return rows.select(*keys, apply(task, factory, F.col("__in")).alias("r")).select(*keys, "r.ok", "r.value", "r.error")


def ocr_text(lines: Column) -> Column:
    """The text of OCR results (array<struct<bbox, text, conf>>), one line each."""
    from ..functions.text import lines_joined

    return lines_joined(F.transform(lines, lambda x: x["text"]))


def frame_plan_rows(df: DataFrame, seconds: Column, path: Column, keys: tuple[str, ...]) -> DataFrame:
    """One row per frame, planned over the whole duration: (keys..., frame_number, offset_s, path)."""
    plan = df.select(*keys, path.alias("path"), F.posexplode(frame_offsets(seconds, None)).alias("n", "offset_s"))
    return plan.select(*keys, (F.col("n") + 1).alias("frame_number"), F.col("offset_s").cast("int").alias("offset_s"), "path")


#: Frames of one file that are decoded at once, half an hour of it, and bytes of images that Python keeps before it hands them on.
FRAMES_AT_ONCE, IMAGE_BYTES = 60, 4 << 20


def keyframes(plan: DataFrame, decode: Callable[[str, list[int]], list[bytes | None]] | None, keys: tuple[str, ...]) -> DataFrame:
    """The planned frames decoded, a file opened once for each half hour: (keys..., frame_number, offset_s, ok, image, error). Decoding is gated: without a decoder, images are null and not ok."""
    part = F.floor((F.col("frame_number").cast("int") - 1) / FRAMES_AT_ONCE).alias("part")
    files = plan.groupBy(*keys, "path", part).agg(F.array_sort(F.collect_list(F.struct("offset_s", "frame_number"))).alias("wanted")).drop("part")  # FRAMES_AT_ONCE at most

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*keys, "frame_number", "offset_s", "ok", "image", "error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for r in pdf.itertuples(index=False):
                offsets, why = [int(w["offset_s"]) for w in r.wanted], None if decode else "no decoder"
                try:
                    images = decode(r.path, offsets) if decode else [None] * len(offsets)
                except Exception as e:
                    images, why = [None] * len(offsets), str(e)[:500]
                rows += [(*(getattr(r, k) for k in keys), w["frame_number"], s, image is not None, image, None if image is not None else why or "no image") for w, s, image in zip(r.wanted, offsets, images, strict=True)]
                size += sum(len(image) for image in images if image is not None)
                if size >= IMAGE_BYTES:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    kinds = dict(plan.dtypes)
    return files.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"frame_number {kinds['frame_number']}", "offset_s int, ok boolean, image binary, error string"]))
