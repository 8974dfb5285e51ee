"""Images as struct<height, width, channels, data>, row by row in 8 bits; work is vectorised by batch with NumPy.

Spark's own image source decodes files; its rows convert by `from_spark`. Resizing takes the nearest pixel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "struct<height:int,width:int,channels:int,data:binary>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """origin, image for each image file."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("origin"), from_spark(F.col("image")).alias("image"))


def from_spark(image: Column) -> Column:
    return F.struct(image["height"].alias("height"), image["width"].alias("width"), image["nChannels"].alias("channels"), image["data"].alias("data"))


def _array(r) -> np.ndarray:
    return np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])


def _row(a: np.ndarray) -> dict:
    a = np.ascontiguousarray(a)
    return {"height": a.shape[0], "width": a.shape[1], "channels": a.shape[2], "data": a.tobytes()}


def _each(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    @F.pandas_udf(IMAGE)
    def run(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_row(f(_array(r))) for r in x.to_dict("records")], columns=["height", "width", "channels", "data"])

    return run


def crop(image: Column, x: int, y: int, width: int, height: int) -> Column:
    return _each(lambda a: a[y : y + height, x : x + width])(image)


def center_crop(image: Column, width: int, height: int) -> Column:
    def f(a):
        y, x = max(0, (a.shape[0] - height) // 2), max(0, (a.shape[1] - width) // 2)
        return a[y : y + height, x : x + width]

    return _each(f)(image)


def _nearest(a: np.ndarray, width: int, height: int) -> np.ndarray:
    rows = (np.arange(height) * a.shape[0] // max(1, height)).clip(0, a.shape[0] - 1)
    cols = (np.arange(width) * a.shape[1] // max(1, width)).clip(0, a.shape[1] - 1)
    return a[rows][:, cols]


def resize(image: Column, width: int, height: int) -> Column:
    return _each(lambda a: _nearest(a, width, height))(image)


def resize_width(image: Column, width: int) -> Column:
    return _each(lambda a: _nearest(a, width, max(1, a.shape[0] * width // a.shape[1])))(image)


def resize_height(image: Column, height: int) -> Column:
    return _each(lambda a: _nearest(a, max(1, a.shape[1] * height // a.shape[0]), height))(image)


def draw_box(image: Column, x: int, y: int, width: int, height: int, color: tuple[int, ...]) -> Column:
    def f(a):
        a = a.copy()
        c = np.array(color[: a.shape[2]], np.uint8)
        a[y, x : x + width] = a[min(y + height, a.shape[0]) - 1, x : x + width] = c
        a[y : y + height, x] = a[y : y + height, min(x + width, a.shape[1]) - 1] = c
        return a

    return _each(f)(image)


def width(image: Column) -> Column:
    return image["width"]


def height(image: Column) -> Column:
    return image["height"]


def into_matrix(image: Column) -> Column:
    @F.pandas_udf("array<double>")
    def values(x: pd.DataFrame) -> pd.Series:
        return x["data"].map(lambda b: np.frombuffer(b, np.uint8).astype(float))

    return F.struct(F.array(image["height"], image["width"], image["channels"]).alias("shape"), values(image).alias("data"))


def from_matrix(m: Column) -> Column:
    @F.pandas_udf(IMAGE)
    def pixels(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_row(np.asarray(d).clip(0, 255).astype(np.uint8).reshape(list(s))) for s, d in zip(x["shape"], x["data"])], columns=["height", "width", "channels", "data"])

    return pixels(m)


def to_ppm(image: Column) -> Column:
    """The bytes of a portable pixmap (three channels) or graymap (one)."""
    head = F.concat(F.when(image["channels"] == 1, "P5 ").otherwise("P6 "), image["width"].cast("string"), F.lit(" "), image["height"].cast("string"), F.lit(" 255\n"))
    return F.concat(F.encode(head, "UTF-8"), image["data"])


def into_matrix_rgba(image: Column) -> Column:
    """Four channels a pixel: one channel is taken three times, a missing alpha is 255."""

    @F.pandas_udf("array<double>")
    def values(x: pd.DataFrame) -> pd.Series:
        out = []
        for r in x.to_dict("records"):
            a = _array(r).astype(float)
            a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a
            a = a if a.shape[2] == 4 else np.concatenate([a, np.full((*a.shape[:2], 1), 255.0)], axis=2)
            out.append(a.reshape(-1))
        return pd.Series(out)

    return F.struct(F.array(image["height"], image["width"], F.lit(4)).alias("shape"), values(image).alias("data"))


def save(images: DataFrame, folder: str, name: str = "name", image: str = "image") -> DataFrame:
    """Writes each image as a pixmap file below a folder that all executors reach; path and bytes of each."""

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        for b in batches:
            names, data = b.column("name").to_pylist(), b.column("data").to_pylist()
            for n, raw in zip(names, data):
                with where.open_output_stream(f"{root}/{n}.ppm") as f:
                    f.write(raw)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{n}.ppm" for n in names]), pa.array([len(d) for d in data], pa.int64())], ["path", "bytes"])

    return images.select(F.col(name).cast("string").alias("name"), to_ppm(F.col(image)).alias("data")).mapInArrow(write, "path string, bytes long")
