"""What can be plugged in: tools with their limits, stages and their backends, encoders, and a tracker of figures."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Tool:
    """A tool that a run may call. `schema` names its arguments' Spark types."""

    name: str
    side_effect: str = "read"
    requires_approval: bool = False
    max_calls_per_run: int = 5
    risk: str = "medium"
    description: str = ""
    schema: dict[str, str] = field(default_factory=dict)


class Tools:
    """The allow-list. A tool that writes, or reaches outside, can't be on it without a gate."""

    def __init__(self, *tools: Tool):
        self.by_name: dict[str, Tool] = {}
        for tool in tools:
            self.add(tool)

    def add(self, tool: Tool) -> Tool:
        if tool.name in self.by_name:
            raise ValueError(f"there is a tool {tool.name!r} already")
        if tool.side_effect != "read" and not tool.requires_approval:
            raise ValueError(f"{tool.name!r} has side effects ({tool.side_effect}) and needs a gate")
        self.by_name[tool.name] = tool
        return tool

    def __iter__(self) -> Iterator[Tool]:
        return iter(sorted(self.by_name.values(), key=lambda t: t.name))

    def read_only(self) -> list[str]:
        return [t.name for t in self if t.side_effect == "read"]

    def table(self, spark) -> DataFrame:
        """The capability surface, as a reviewer sees it."""
        rows = [(t.name, t.description, t.side_effect, t.requires_approval, t.max_calls_per_run, t.risk, t.schema) for t in self]
        return spark.createDataFrame(rows, "name string, description string, side_effect string, requires_approval boolean, max_calls_per_run int, risk string, input_schema map<string,string>")


# fixed values: the tools of a governed run
TOOLS = Tools(
    Tool("transcribe_audio", "read", False, 2, "low"),
    Tool("diarize_speakers", "read", False, 2, "low"),
    Tool("segment_agenda", "read", False, 2, "low"),
    Tool("extract_decisions_actions", "read", False, 3, "low"),
    Tool("persist_minutes", "write", True, 1, "medium"),
    Tool("export_actions", "external", True, 3, "high"),
    Tool("export_minutes_document", "external", True, 3, "high"),
)


class Transcriber(Protocol):
    def transcribe(self, files: DataFrame) -> DataFrame:
        """(path) to (job_id, text)."""


class Diarizer(Protocol):
    def diarize(self, segments: DataFrame, turns: DataFrame) -> DataFrame:
        """(job_id, seg, start, end) to (job_id, seg, speaker)."""


class Segmenter(Protocol):
    def segment(self, transcripts: DataFrame) -> DataFrame:
        """(job_id, text) to (job_id, position, title, text, confidence)."""


class Extractor(Protocol):
    def extract(self, blocks: DataFrame) -> DataFrame:
        """Blocks to (job_id, position, kind, text, evidence, owner, deadline, confidence)."""


class Backends:
    """Stages by kind and name. A kind's backend is chosen by an option or the environment, made at first use and kept;
    one whose libraries are missing is replaced by the baseline, with a word in the log."""

    def __init__(self, prefix: str = "AGENDUM"):
        self.prefix, self.factories, self.made = prefix, {}, {}

    def add(self, kind: str, name: str, factory: Callable[[], object]) -> None:
        self.factories.setdefault(kind, {})[name] = factory

    def get(self, kind: str, choice: str | None = None):
        choice = (choice or os.environ.get(f"{self.prefix}_{kind.upper()}_BACKEND") or "baseline").lower()
        if choice not in self.factories.get(kind, {}):
            raise ValueError(f"no {kind} backend {choice!r}; there are {sorted(self.factories.get(kind, {}))}")
        if (kind, choice) not in self.made:
            try:
                self.made[kind, choice] = self.factories[kind][choice]()
            except ImportError as missing:
                log.error("%s backend %s can't be loaded (%s): the baseline stands in", kind, choice, missing)
                self.made[kind, choice] = self.factories[kind]["baseline"]()
        return self.made[kind, choice]

    def forget(self) -> None:
        self.made.clear()


#: Makes an encoder: a function from sentences to a matrix with a row each, of unit length.
Loader = Callable[[], Callable[[list[str]], np.ndarray]]


def hashed_words(dimensions: int = 64) -> Loader:
    """A stand-in for a sentence model where none is installed: words' hashes with signs, summed and scaled."""

    def load() -> Callable[[list[str]], np.ndarray]:
        import xxhash

        def encode(sentences: list[str]) -> np.ndarray:
            out = np.zeros((len(sentences), dimensions))
            for row, sentence in zip(out, sentences, strict=True):
                for word in sentence.lower().split():
                    h = xxhash.xxh3_64_intdigest(word.strip(".,!?").encode())
                    row[h % dimensions] += 1 if h >> 32 & 1 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return encode

    return load


#: Characters of text that are encoded at a time.
BATCH_CHARACTERS = 1 << 20


def batches(texts: Sequence[str | None], most: int = BATCH_CHARACTERS) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges of at most so many characters; a longer text is a range of its own."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        own = len(text or "")
        if size + own > most and start < at:
            yield start, at
            start, size = at, 0
        size += own
    if start < len(texts):
        yield start, len(texts)


def encoded(sentences: Sequence[str], encode: Callable[[list[str]], np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(vectors, at, distinct): the vectors of the distinct sentences, a row a dimension, and each sentence's number there."""
    known: dict[str, int] = {}
    at = np.fromiter((known.setdefault(s, len(known)) for s in sentences), np.int64, len(sentences))
    return (np.ascontiguousarray(np.asarray(encode(list(known)), np.float64).T) if known else np.zeros((1, 0))), at, list(known)


@contextmanager
def tracked(name: str, params: dict | None = None):
    """A function that takes figures by name: it gives them to mlflow where that is installed and works, else to the log."""
    try:
        import mlflow

        run = mlflow.start_run(run_name=name)
    except Exception as missing:  # noqa: BLE001 - tracking never stops a run
        log.info("%s isn't tracked: %s", name, missing)
        yield lambda **figures: log.info("%s: %s", name, figures)
        return
    with run:
        mlflow.log_params(params or {})
        yield lambda **figures: mlflow.log_metrics(figures)
