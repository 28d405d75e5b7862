"""The catalogue of tool functions and stages: names, documentation, selection, result handles."""

from __future__ import annotations

import inspect
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from velarium.functions.keys import handle


class Registry:
    """Functions by `alias.name`. Unknown names in a selection are skipped; an empty selection means all."""

    def __init__(self) -> None:
        self.tools: dict[str, Callable] = {}

    def add(self, alias: str) -> Callable:
        def put(f: Callable) -> Callable:
            self.tools[f"{alias}.{f.__name__}"] = f
            return f

        return put

    def select(self, names: list[str] | None = None) -> dict[str, Callable]:
        wanted = [n for n in names or [] if n in self.tools]
        return {n: self.tools[n] for n in wanted} if wanted else dict(self.tools)

    def describe(self) -> list[tuple[str, str, str]]:
        """(name, signature, first line of the documentation), sorted."""
        return [(n, str(inspect.signature(f)), (f.__doc__ or "").strip().split("\n")[0]) for n, f in sorted(self.tools.items())]


class Results:
    """Result sets of one session by handle; all arguments count, so different searches never share one. A result older than `seconds` is made anew."""

    def __init__(self, seconds: float = 1800.0, now: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.now = seconds, now
        self.held: dict[str, tuple[float, DataFrame]] = {}

    def put(self, tool: str, args: dict, rows: DataFrame) -> str:
        h = handle(tool, args)
        if h not in self.held or self.now() - self.held[h][0] > self.seconds:
            self.drop(h)
            self.held[h] = (self.now(), rows.cache())
        return h

    def get(self, h: str) -> DataFrame:
        if h not in self.held or self.now() - self.held[h][0] > self.seconds:
            self.drop(h)
            raise KeyError(f"no result {h}")
        return self.held[h][1]

    def accept(self, h: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A result through a filter of the caller's."""
        return keep(self.get(h))

    def drop(self, h: str) -> None:
        if h in self.held:
            self.held.pop(h)[1].unpersist()

    def clear(self) -> None:
        for h in list(self.held):
            self.drop(h)


def ready(done: set[str], stages: dict[str, list[str]] | None = None) -> list[str]:
    """Stages not done whose stages before are all done, in their order."""
    graph = STAGES if stages is None else stages
    return [s for s, waits in graph.items() if s not in done and all(w in done for w in waits)]


def stage_settings(name: str, text: str) -> dict:
    """The settings of a stage from a JSON object of stages; an unknown name lists those there are."""
    known = json.loads(text)
    if name not in known:
        raise KeyError(f"no stage {name}; there are {', '.join(sorted(known))}")
    return known[name]


#: Pipeline stages in order, each with the stages it waits for (fixed values).
STAGES = {
    "video": [],
    "autoshot": ["video"],
    "asr": ["autoshot"],
    "audio_segment": ["asr"],
    "audio_transcript_embedding": ["audio_segment"],
    "segment_caption": ["audio_segment"],
    "segment_embedding": ["segment_caption"],
    "segment_caption_embedding": ["segment_caption"],
    "image_extraction": ["autoshot"],
    "image_caption_ocr": ["image_extraction"],
    "image_embedding": ["image_caption_ocr"],
    "image_caption_embedding": ["image_caption_ocr"],
    "image_index": ["image_embedding"],
    "image_caption_index": ["image_caption_embedding"],
    "segment_index": ["segment_embedding"],
    "segment_caption_index": ["segment_caption_embedding"],
    "audio_transcript_index": ["audio_transcript_embedding"],
    "ocr_index": ["image_caption_ocr"],
    "knowledge_graph": ["segment_caption"],
    "graph_index": ["knowledge_graph"],
}
