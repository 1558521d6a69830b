"""Detectors and recognisers as plug-ins over photo bytes. Models are made once a Python worker; errors are data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemark.functions.geometry import merged_detections, moved, quarters, torso


class Recogniser(Protocol):
    def read_batch(self, crops: list[bytes]) -> list[list[tuple[str, float]]]:
        """Of each crop ranked (text, confidence)."""


class Detector(Protocol):
    def detect(self, photo: bytes) -> list[tuple[float, float, float, float, float]]:
        """x0, y0, x1, y1 and confidence of each box."""


Cropper = Callable[[bytes, tuple[float, float, float, float]], bytes]
_RECOGNISERS: dict[str, Callable[[], Recogniser]] = {}


def register(name: str, factory: Callable[[], Recogniser]) -> None:
    _RECOGNISERS[name] = factory


def build(name: str) -> Callable[[], Recogniser]:
    if name not in _RECOGNISERS:
        raise KeyError(f"no recogniser {name!r}; there are {sorted(_RECOGNISERS)}")
    return _RECOGNISERS[name]


def recognise(crops: DataFrame, content: str, factory: Callable[[], Recogniser], into: str = "reads") -> DataFrame:
    """The rows with reads and error; a crop that fails gives an error, and never fails the task."""

    @F.pandas_udf("reads array<struct<text:string,conf:double>>, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in batches:
            try:
                found, errors = model.read_batch(list(part)), [None] * len(part)
            except Exception:  # one bad crop: find out which
                found, errors = [], []
                for crop in part:
                    try:
                        found.append(model.read_batch([crop])[0])
                        errors.append(None)
                    except Exception as e:
                        found.append([])
                        errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"reads": [[{"text": t, "conf": c} for t, c in r] for r in found], "error": pd.Series(errors, dtype=object)})

    return crops.withColumn("__r", read(F.col(content))).withColumn(into, F.col("__r.reads")).withColumn("error", F.col("__r.error")).drop("__r")


def boxes_of(content: Column, factory: Callable[[], Detector]) -> Column:
    """boxes (array of conf and box) and error of pictures; one that fails gives an error, and never fails the task."""

    @F.pandas_udf("boxes array<struct<conf:double,box:struct<x0:double,y0:double,x1:double,y1:double>>>, error string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in batches:
            boxes, errors = [], []
            for photo in part:
                try:
                    boxes.append([{"conf": float(c), "box": dict(zip(("x0", "y0", "x1", "y1"), map(float, xy), strict=True))} for *xy, c in model.detect(photo)])
                    errors.append(None)
                except Exception as e:
                    boxes.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"boxes": pd.Series(boxes, dtype=object), "error": pd.Series(errors, dtype=object)})

    return find(content)


def cut_out(content: Column, tile: Column, factory: Callable[[], Cropper]) -> Column:
    """The part of a picture that a box has, as a picture; null where that fails."""

    @F.pandas_udf("binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        crop = factory()
        for photos, tiles in batches:
            out = []
            for photo, at in zip(photos, tiles[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None), strict=True):
                try:
                    out.append(crop(photo, at))
                except Exception:  # the whole photo's detector says what is wrong with it
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return cut(content, tile)


def _put(boxes: Column, tile: Column) -> Column:
    """Boxes found in a tile, where they are in the picture."""
    return F.transform(boxes, lambda b: b.withField("box", moved(b["box"], tile["x0"], tile["y0"])))


def detect(photos: DataFrame, content: str, factory: Callable[[], Detector], into: str = "boxes") -> DataFrame:
    """The rows with boxes (array of conf and box) and error; a photo that fails gives an error, never fails the task."""
    return detect_all(photos, content, [factory], into=into, least=None)


def detect_all(photos: DataFrame, content: str, factories: list[Callable[[], Detector]], crop: Callable[[], Cropper] | None = None, into: str = "boxes", least: float | None = 0.5) -> DataFrame:
    """As ``detect``, of several detectors; of boxes that overlap by ``least`` the surest.

    With a cropper every detector also looks at the photo's quarters (columns width and height), each a column of the
    row, so that nothing is shuffled; their boxes are moved to where the quarter is.
    """
    tiles = quarters(F.col("width"), F.col("height")) if crop else None
    views = [(F.col(content), None)] + [(cut_out(F.col(content), tiles[i], crop), tiles[i]) for i in range(4 if crop else 0)]
    kept = [F.col(f"`{c}`") for c in photos.columns if c not in (into, "error")]
    rows, found, errors = photos, [], []
    for v, (picture, tile) in enumerate(views):
        rows = rows.withColumn(f"__view{v}", picture)
        for k, factory in enumerate(factories):
            rows = rows.withColumn(f"__found{v}_{k}", boxes_of(F.col(f"__view{v}"), factory))
            at = F.col(f"__found{v}_{k}.boxes")
            found.append(at if tile is None else _put(at, tile))
            errors.append(F.col(f"__found{v}_{k}.error"))
    boxes = F.concat(*found) if least is None else merged_detections(found, least)
    return rows.select(*kept, boxes.alias(into), F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(*errors))), "; "), F.lit("")).alias("error"))


def of_persons(boxes: Column) -> Column:
    """Where the persons that a detector has found have their bibs."""
    return F.transform(boxes, lambda b: b.withField("box", torso(b["box"])))


class Whole:
    """A detector that takes the whole photo for the bib; ``size`` gives a photo's width and height."""

    def __init__(self, size: Callable[[bytes], tuple[float, float]]) -> None:
        self.size = size

    def detect(self, photo: bytes) -> list[tuple[float, float, float, float, float]]:
        return [(0.0, 0.0, *map(float, self.size(photo)), 1.0)]


class Fixed:
    """A detector that knows its answers, for tests and for reading logs again."""

    def __init__(self, answers: dict[bytes, list[tuple]]) -> None:
        self.answers = answers

    def detect(self, photo: bytes) -> list[tuple]:
        return self.answers[bytes(photo)]


class Replay:
    """A recogniser that knows its answers, for tests and for reading logs again."""

    def __init__(self, answers: dict[bytes, list[tuple[str, float]]]) -> None:
        self.answers = answers

    def read_batch(self, crops: list[bytes]) -> list[list[tuple[str, float]]]:
        return [self.answers[bytes(c)] for c in crops]
