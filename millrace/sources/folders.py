"""Labelled image folders: written, listed and read; routing by file name."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.lookup import lookup
from millrace.operators.ordered import scan
from millrace.session import stage


def parent_class(path: str | Column) -> Column:
    """Name of the folder a file lies in."""
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, "([^/]+)/[^/]+$", 1)


def with_labels(files: DataFrame, class_name: str = "class_name", listed: DataFrame | None = None) -> DataFrame:
    """Add ``label``: the position of the class name in alphabetical order.

    ``listed`` is a cheaper table to take the names from. Names are ranked after ``distinct``, one row per class.
    """
    names = (files if listed is None else listed).select(class_name).filter(F.col(class_name).isNotNull()).distinct()
    classes = scan(names, [class_name], rank="label").withColumn("label", F.col("label") - 1)
    return lookup(files, classes, [class_name], ["label"])


def _images(spark: SparkSession, root: str, keep_broken: bool) -> DataFrame:
    found = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", not keep_broken).load(root)
    return found.select(
        F.col("image.origin").alias("path"),
        parent_class(F.col("image.origin")).alias("class_name"),
        *[F.col(f"image.{c}").alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))],
    )


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """The class of every file below ``root``, from its path alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(parent_class("path").alias("class_name"))


def scan_labeled_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, class_name, label, height, width, channels, data) of the images below ``root``.

    ``data`` is the decoded pixels as bytes, ready for ``pixels.run``. Filter on the size first.
    The class list comes from the paths alone; no file is decoded for it.
    """
    return with_labels(_images(spark, root, False), listed=_listing(spark, root))


def scan_with_broken(spark: SparkSession, root: str) -> DataFrame:
    """As ``scan_labeled_folder``, with a row for every file: ``broken`` files, which no decoder knows, have NULL for
    size and pixels. Their class counts in the numbering of labels like any other."""
    found = _images(spark, root, True)
    broken = F.col("height") < 0
    shown = {c: F.when(~broken, F.col(c)) for c in ("height", "width", "channels", "data")}
    return with_labels(found.withColumn("broken", broken).withColumns(shown), listed=_listing(spark, root))


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG file of 8-bit pixels in rows: grey, blue-green-red, or blue-green-red with opacity."""
    cube = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    cube = cube[:, :, [2, 1, 0, 3][:channels]] if channels > 1 else cube
    lines = np.concatenate([np.zeros((height, 1), np.uint8), cube.reshape(height, -1)], axis=1)  # each line is stored as it is

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encode_png(df: DataFrame, out: str = "content") -> DataFrame:
    """Adds the PNG file of each row's (height, width, channels, data); NULL where one of them is NULL or the bytes do
    not fill the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in ("height", "width", "channels", "data")), strict=True)
            files = [png(h, w, c, d) if None not in (h, w, c, d) and 0 < h * w and c in (1, 3, 4) and len(d) == h * w * c else None for h, w, c, d in cells]
            yield batch.append_column(out, pa.array(files, pa.binary()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def write_files(df: DataFrame, root: str, path: str = "file", content: str = "content") -> DataFrame:
    """Writes each row's bytes to ``root``/``path`` and returns (file, size), a row for each file there.

    A file gets its name when it is whole, so a task that runs twice leaves the same files. ``root`` is a folder all
    executors reach, by any address Arrow's file systems know. Rows with NULL are left out; of a repeated path one
    row's bytes stay.
    """
    parts = urlparse(root)
    address = unquote(parts.path) if parts.scheme in ("", "file") else root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(address)
        made: set[str] = set()
        for batch in batches:
            names, files = batch.column("file").to_pylist(), batch.column("content").to_pylist()
            for name, body in zip(names, files, strict=True):
                at = f"{base}/{name}"
                if (folder := at.rpartition("/")[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(draft := f"{folder}/_{uuid.uuid4().hex}") as out:
                    out.write(body)
                store.move(draft, at)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(f) for f in files], pa.int64())], names=["file", "size"])

    rows = df.select(F.col(path).alias("file"), F.col(content).alias("content")).where("file is not null and content is not null")
    return stage(rows.mapInArrow(run, "file string, size long"), "written-files")


def class_of_file(path: str | Column) -> Column:
    """File name without its last ``_`` part."""
    name = F.regexp_extract(F.col(path) if isinstance(path, str) else path, "([^/]+)$", 1)
    return F.regexp_extract(name, "^(.*)_[^_]*$", 1)


def route_by_filename(files: DataFrame, path: str, suffix: str = ".jpg") -> DataFrame:
    """Files with the suffix and the class their name states; write it partitioned by class."""
    return files.filter(F.col(path).endswith(suffix)).withColumn("class_name", class_of_file(path))
