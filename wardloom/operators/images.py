"""Quality signals of images, from files read as binary. Portable pixmaps are decoded here; other kinds need a decoder that is passed in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = re.compile(rb"P([56])\s+(?:#[^\n]*\s+)*(\d+)\s+(\d+)\s+(\d+)\s", re.DOTALL)


def pixmap(data: bytes) -> np.ndarray | None:
    """Rows, columns and three colours of a binary pixmap or graymap of 8 bits; None for anything else."""
    m = HEAD.match(data or b"")
    if not m or int(m[4]) > 255:
        return None
    depth, w, h = (3 if m[1] == b"6" else 1), int(m[2]), int(m[3])
    body = data[m.end() : m.end() + w * h * depth]
    if len(body) < w * h * depth or w * h == 0:
        return None
    return np.broadcast_to(np.frombuffer(body, np.uint8).reshape(h, w, depth), (h, w, 3))


def signals(image: np.ndarray) -> tuple[float, float, float]:
    """Brightness and contrast from 0 to 1, and the variance of the Laplacian."""
    gray = image.astype(float) @ (0.299, 0.587, 0.114)
    inner = gray[1:-1, 1:-1]
    edges = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * inner
    return gray.mean() / 255, gray.std() / 127.5, float(edges.var()) if edges.size else 0.0


def measured(files: DataFrame, decode: Callable[[bytes], np.ndarray | None] = pixmap) -> DataFrame:
    """(path, width, height, brightness, contrast, sharpness) of files(path, content); nulls where a file can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                image = decode(data)
                rows.append((path, None, None, None, None, None) if image is None else (path, image.shape[1], image.shape[0], *map(float, signals(image))))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["path", "width", "height", "brightness", "contrast", "sharpness"])

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, brightness double, contrast double, sharpness double")


def quality_band(blur: float = 100.0, dark: float = 0.2, bright: float = 0.85) -> Column:
    bad = (F.col("sharpness") < blur).cast("int") + (~F.col("brightness").between(dark, bright)).cast("int")
    return F.when(F.col("sharpness").isNull(), "UNREADABLE").when(bad == 0, "GOOD").when(bad == 1, "FAIR").otherwise("POOR")
