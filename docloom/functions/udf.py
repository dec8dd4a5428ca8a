"""Extensions by the user: classes of documents, detectors and text models."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from docloom.operators import detect, extract, quality

DETECTORS: dict[str, Callable[[str], Iterable[tuple]]] = {}
MODELS: dict[str, Callable[[str], str]] = {}


def register_extraction_class(name: str, fields: dict[str, list[str]]) -> None:
    """A class of documents by its fields' patterns, each with the value as its first group; it begins a line."""
    extract.CLASS_FIELDS[name] = fields


def register_detector(name: str, detector: Callable[[str], Iterable[tuple]]) -> None:
    """A detector that returns spans (start, end, quote, label, source) of a text."""
    DETECTORS[name] = detector


def register_text_model(name: str, model: Callable[[str], str]) -> None:
    MODELS[name] = model


def detect_with(docs: DataFrame, name: str) -> DataFrame:
    return detect.spans_of(docs, DETECTORS[name])


def write_with(docs: DataFrame, name: str, fine: Callable[[str, str], bool]) -> DataFrame:
    return quality.apply_text_model(docs, MODELS[name], fine)
