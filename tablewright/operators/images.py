"""Image operators over image columns (origin, height, width, nChannels, mode, data in BGR order).

Kernels are numpy on one image at a time; images never leave their task. Changed images pass through plain Python UDFs, which
hold some hundred rows of a task at a time whatever Arrow's batches are set to."""

from __future__ import annotations

import zlib
from math import cos, radians, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import processed_name
from ..session import written

# Integer weights of red, green and blue in grey, in 1/65536.
GREY = (19595, 38470, 7471)
NEUTRAL = {"rotation": 0, "flip": False, "brightness": 1.0, "noise_intensity": 15, "contrast": 1.0, "hue": 1.0}


def pixels(data, height: int, width: int, channels: int) -> np.ndarray:
    """Height × width × channels, RGB order for colour images."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return a[:, :, ::-1] if channels == 3 else a


def to_bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a[:, :, ::-1] if a.shape[2] == 3 else a, dtype=np.uint8).tobytes()


def rotate(a: np.ndarray, angle: float) -> np.ndarray:
    """Counter-clockwise about the centre, nearest pixel, same frame, black outside."""
    h, w = a.shape[:2]
    t = -radians(angle % 360)
    c, s = round(cos(t), 15), round(sin(t), 15)
    cx, cy = w / 2, h / 2
    x, y = np.meshgrid(np.arange(w) + 0.5 - cx, np.arange(h) + 0.5 - cy)
    sx, sy = np.floor(c * x + s * y + cx).astype(int), np.floor(-s * x + c * y + cy).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.zeros_like(a)
    out[inside] = a[sy[inside], sx[inside]]
    return out


def flip(a: np.ndarray) -> np.ndarray:
    return a[:, ::-1]


def blend(base, a: np.ndarray, factor: float) -> np.ndarray:
    """From ``base`` (factor 0) through the image (1) and beyond, cut to a byte."""
    return np.clip(np.trunc(base + factor * (a.astype(float) - base)), 0, 255).astype(np.uint8)


def grey(a: np.ndarray) -> np.ndarray:
    if a.shape[2] == 1:
        return a[:, :, 0].astype(np.int64)
    r, g, b = (a[:, :, i].astype(np.int64) for i in range(3))
    return (r * GREY[0] + g * GREY[1] + b * GREY[2] + 32768) >> 16


def brightness(a, factor):
    return blend(0.0, a, factor)


def contrast(a, factor):
    return blend(float(int(grey(a).mean() + 0.5)), a, factor)


def saturation(a, factor):
    return blend(grey(a)[:, :, None].astype(float), a, factor)


def noise(a, intensity, seed: int):
    rng = np.random.default_rng(seed)
    return np.clip(a.astype(np.int16) + rng.normal(0, intensity, a.shape).astype(np.int16), 0, 255).astype(np.uint8)


def augmented(a: np.ndarray, origin: str, options: dict) -> np.ndarray:
    """The steps whose value is not neutral, in fixed order."""
    o = {**NEUTRAL, **options}
    if o["rotation"] != 0:
        a = rotate(a, o["rotation"])
    if o["flip"]:
        a = flip(a)
    if o["brightness"] != 1.0:
        a = brightness(a, o["brightness"])
    if o["noise_intensity"] != 15:
        a = noise(a, o["noise_intensity"], zlib.crc32(origin.encode()))
    if o["contrast"] != 1.0:
        a = contrast(a, o["contrast"])
    if o["hue"] != 1.0:
        a = saturation(a, o["hue"])
    return a


def _changed(images: DataFrame, change) -> DataFrame:
    """The images with ``change(array, origin)`` of each."""
    run = F.udf(lambda origin, height, width, channels, data: to_bytes(change(pixels(data, height, width, channels), origin)), "binary", useArrow=False)
    return images.select("origin", "height", "width", "nChannels", "mode", run("origin", "height", "width", "nChannels", "data").alias("data"))


def image_augment(images: DataFrame, **options) -> DataFrame:
    """All chosen steps in one pass: rotation, flip, brightness, noise_intensity, contrast, hue."""
    return _changed(images, lambda a, origin: augmented(a, origin, options))


def image_rotate(images: DataFrame, angle: float) -> DataFrame:
    return image_augment(images, rotation=angle)


def image_flip(images: DataFrame) -> DataFrame:
    return image_augment(images, flip=True)


def image_brightness(images: DataFrame, factor: float) -> DataFrame:
    return image_augment(images, brightness=factor)


def image_contrast(images: DataFrame, factor: float) -> DataFrame:
    return image_augment(images, contrast=factor)


def image_saturation(images: DataFrame, factor: float) -> DataFrame:
    return image_augment(images, hue=factor)


def image_noise(images: DataFrame, intensity: float = 15) -> DataFrame:
    return _changed(images, lambda a, origin: noise(a, intensity, zlib.crc32(origin.encode())))


def image_histogram(images: DataFrame, bins: int = 32) -> DataFrame:
    """(channel, bin, n) over all images: ``bins`` equal bins from 0 to 255."""
    def count(batches):
        for b in batches:
            total = {}
            for i in range(b.num_rows):             # the pixels are read where they lie in the batch
                a = pixels(b.column("data")[i].as_buffer(), *(b.column(c)[i].as_py() for c in ("height", "width", "nChannels")))
                names = ("red", "green", "blue") if a.shape[2] == 3 else ("gray",)
                for j, name in enumerate(names):
                    h = np.histogram(a[:, :, j], bins=bins, range=(0, 255))[0]
                    total[name] = total.get(name, 0) + h
            rows = [(n, j, int(v)) for n, h in total.items() for j, v in enumerate(h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
                                             names=["channel", "bin", "n"])
    return images.select("height", "width", "nChannels", "data").mapInArrow(count, "channel string, bin int, n long").groupBy("channel", "bin").agg(F.sum("n").alias("n"))


def image_resolutions(files: DataFrame, images: DataFrame) -> DataFrame:
    """Width and height per listed file, (0, 0) where the image could not be read."""
    sizes = images.select(F.regexp_replace("origin", "^file:/*", "/").alias("full_path"), "width", "height")
    return files.join(sizes, "full_path", "left").select("full_path", F.greatest(F.coalesce("width", F.lit(0)), F.lit(0)).alias("width"),
                                                         F.greatest(F.coalesce("height", F.lit(0)), F.lit(0)).alias("height"))


def sink_images(images: DataFrame, path: str, save_format: str = "PNG") -> DataFrame:
    """Store image columns under derived names; returns (name, status) rows, ``error`` for unusable images."""
    usable = (F.col("height") > 0) & (F.col("width") > 0) & (F.length("data") == F.col("height") * F.col("width") * F.col("nChannels"))
    named = images.withColumn("name", processed_name(F.col("origin"), save_format)).withColumn("status", F.when(usable, "ok").otherwise("error"))
    named.where("status = 'ok'").drop("status").write.mode("overwrite").parquet(path)
    return named.select("name", "status")


def image_batch(images: DataFrame, path: str, save_format: str = "PNG", **options) -> DataFrame:
    """Augment, store and count done and failed."""
    status = sink_images(written(image_augment(images, **options)), path, save_format)
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
