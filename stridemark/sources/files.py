"""Sources: annotations, listings of photos, logs, start lists, labels, times in photos."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridemark.functions.geometry import wrapped_rotation
from stridemark.functions.text import bare_number, composed, trailing_number
from stridemark.sources.logs import read_log

ANNOTATION = """_id INT, _name STRING, _width INT, _height INT, box ARRAY<STRUCT<_label: STRING, _source: STRING, _occluded: INT, _xtl: DOUBLE, _ytl: DOUBLE,
_xbr: DOUBLE, _ybr: DOUBLE, _rotation: DOUBLE, _z_order: INT, attribute: ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>>>"""
#: Headers of a start list's column of bibs, in any case.
START_HEADERS = ("bib", "startni_broj", "startni broj", "broj", "start_no", "number", "bib_number")
PHOTO_ENDINGS = ("jpg", "jpeg", "png")
PUBLISHED_ENDINGS = (*PHOTO_ENDINGS, "webp", "heic", "tif", "tiff")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Images with their boxes from CVAT 1.1 XML. The schema is given: inference would take bibs for numbers."""
    return spark.read.format("xml").option("rowTag", "image").schema(ANNOTATION).load(path)


def annotated_boxes(images: DataFrame) -> DataFrame:
    """One row a box; rotation in (-180, 180], text null if there is none."""
    rows = images.select(F.col("_id").alias("image_id"), F.col("_name").alias("image"), F.explode("box").alias("b"))
    text = F.try_element_at(F.filter("b.attribute", lambda a: a["_VALUE"].isNotNull()), F.lit(1))["_VALUE"]
    return rows.select("image_id", "image", F.col("b._xtl").alias("x0"), F.col("b._ytl").alias("y0"), F.col("b._xbr").alias("x1"), F.col("b._ybr").alias("y1"), wrapped_rotation(F.coalesce("b._rotation", F.lit(0.0))).alias("rotation"), text.alias("text"))


def photos(spark: SparkSession, root: str, endings: tuple[str, ...] = PHOTO_ENDINGS, content: bool = False) -> DataFrame:
    """path, folder, name, bytes (and content) of photos below a root, without parts of the path that begin with . or _.

    Spark's listing itself leaves out such files and folders. Contents are read only if asked for.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rows = rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings))
    return rows.select("path", folder.alias("folder"), name.alias("name"), F.col("length").alias("bytes"), *["content"] * content)


def published_photos(spark: SparkSession, root: str, endings: tuple[str, ...] = PUBLISHED_ENDINGS) -> DataFrame:
    """path, name (the path below the root) and bytes of what is published: no part that begins with a dot, no folder
    that begins with _, but files that do.

    Spark's own listing leaves those files out, so that the store is asked, on the driver, as Spark does itself.
    """
    store = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = store.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    base, found, listed = fs.resolvePath(store).toString().rstrip("/"), [], fs.listFiles(store, True)
    while listed.hasNext():
        f = listed.next()
        path = f.getPath().toString()
        name = path[len(base) + 1 :]
        *folders, last = name.split("/")
        if last[:1] != "." and not any(p[:1] in ("_", ".") for p in folders) and last.rpartition(".")[2].lower() in endings:
            found.append((path, name, f.getLen()))
    return spark.createDataFrame(found, "path string, name string, bytes bigint")


def relative_key(path: Column, root: str) -> Column:
    """The path below a root, with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^.*?" + re.escape(root.replace("\\", "/").rstrip("/")) + "/", "")


def batches(listed: DataFrame) -> DataFrame:
    """Folders that directly hold photos, and how many."""
    return listed.groupBy("folder").agg(F.count("*").alias("photos"))


def _must_list(spark: SparkSession, path: str) -> None:
    """Spark reads hidden files as nothing and says nothing: refuse them."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name[:1] in (".", "_"):
        raise ValueError(f"{name}: Spark reads files with such names as empty; stage it under another name")


def append_log(spark: SparkSession, path: str, schema: str, after: dict[str, int] | None = None) -> DataFrame:
    """Rows of a JSON-lines log with ``seq``, their place in it, which sorts as they were appended.

    Broken lines are left out; a torn last one is read once it is whole. after: only what is behind a position.
    """
    _must_list(spark, path)
    return read_log(spark, path, schema, after)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and value of a file that is one JSON object; a missing or broken file has none."""
    empty = spark.createDataFrame([], f"key STRING, value {value}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    _must_list(spark, path)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return whole.select(F.explode("m"))


def first_map(spark: SparkSession, paths: list[str], value: str) -> DataFrame:
    """As json_map, of the first of the files that is there: a newer pass's suggestions go before the older ones."""
    for path in paths[:-1]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return json_map(spark, path, value)
    return json_map(spark, paths[-1], value)


def inline(spark: SparkSession, names: list[str], column: str = "file_name") -> DataFrame:
    """A relation written out in the query."""
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def start_list(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Distinct bibs of a text or CSV file. None without a path: no list is not an empty list."""
    if not path:
        return None
    if path.lower().endswith(".csv"):
        rows = spark.read.csv(path, header=True)
        column = next((c for c in rows.columns if c.lstrip("﻿").strip().lower() in START_HEADERS), None)
        values = rows.select(F.col(f"`{column}`").alias("v")) if column else spark.createDataFrame([], "v string")
    else:
        values = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("v"))
    return values.select(bare_number(F.col("v")).alias("number")).filter("number <> ''").distinct()


def answer_key(spark: SparkSession, path: str, photo: str = "photo", bibs: str = "bibs") -> DataFrame:
    """number of the photo (the trailing digits of its composed name) and its distinct bibs; the last row of a photo."""
    rows = spark.read.csv(path, header=True, multiLine=True).withColumn("__line", F.monotonically_increasing_id())
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    numbers = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(bibs, F.lit("")), ","), lambda x: bare_number(x)), lambda x: x != ""))
    keyed = rows.select(trailing_number(composed(F.col(photo))).alias("photo"), numbers.alias("bibs"), "__line").filter("photo IS NOT NULL")
    return keyed.groupBy("photo").agg(F.max_by("bibs", "__line").alias("bibs"))


def labels(spark: SparkSession, root: str) -> DataFrame:
    """split, stem, class and relative box of detector label files root/<split>/<stem>.txt."""
    rows = spark.read.text(root, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("v")).filter(F.size("v") == 5)
    at = lambda i: F.col("v")[i].cast("double")
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("split"), F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("stem"), F.col("v")[0].cast("int").alias("class"), *[at(i).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)])


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """split and name from a JSON object of lists."""
    return json_map(spark, path, "array<string>").select(F.col("key").alias("split"), F.explode("value").alias("name"))


def captured_at(content: Column, zone: str) -> Column:
    """The earliest time in a photo's EXIF block from 2000 on, as UTC; an offset written with it counts, else the zone.

    The block begins where its header is, wherever that is, and is as long as a JPEG's segment says; in other formats
    all that follows is looked through, and without a header the whole content. Stamps that are no time, such as month 13, are left out before the earliest is
    taken.
    """
    whole = F.decode(content, "ISO-8859-1")
    head = F.locate("Exif\x00\x00", whole)
    code = lambda back: F.ascii(F.substring(whole, head - back, F.lit(1)))
    segment = (code(4) == 0xFF) & (code(3) == 0xE1)  # its length counts its own two bytes, just before the header
    raw = F.when(head == 0, whole).when((head > 4) & segment, F.substring(whole, head, code(2) * 256 + code(1) - 2)).otherwise(F.substring(whole, head, F.length(whole)))
    stamps = F.transform(F.regexp_extract_all(raw, F.lit(r"([0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})"), F.lit(1)), lambda x: F.try_to_timestamp(x, F.lit("yyyy:MM:dd HH:mm:ss")))
    offset = F.nullif(F.regexp_extract(raw, r"\x00([+-][0-9]{2}:[0-9]{2})\x00", 1), F.lit(""))
    return F.to_utc_timestamp(F.array_min(F.filter(stamps, lambda x: F.year(x) >= 2000)), F.coalesce(offset, F.lit(zone)))


def _shot_time(photo: bytes) -> str | None:
    """When a photo was taken by its EXIF directories, as 'YYYY:MM:DD HH:MM:SS.sss'."""
    at = photo.find(b"Exif\x00\x00")
    tiff = photo[at + 6 :] if at >= 0 else photo
    order = {b"II": "<", b"MM": ">"}[bytes(tiff[:2])]

    def entries(start: int) -> dict[int, tuple[int, int, int]]:
        (n,) = struct.unpack_from(order + "H", tiff, start)
        return {tag: (kind, count, start + 2 + 12 * i + 8) for i in range(n) for tag, kind, count in [struct.unpack_from(order + "HHI", tiff, start + 2 + 12 * i)]}

    def number(e: tuple[int, int, int]) -> int:
        return struct.unpack_from(order + "I", tiff, e[2])[0]

    def text(e: tuple[int, int, int] | None) -> str | None:
        if e is None:
            return None
        where = e[2] if e[1] <= 4 else number(e)
        return bytes(tiff[where : where + e[1]]).split(b"\x00")[0].decode("ascii", "replace").strip()

    # Tags of the format. 0x8769 the EXIF directory, 36867 and 306 times, 37521 thousandths.
    first = entries(struct.unpack_from(order + "I", tiff, 4)[0])
    exif = entries(number(first[0x8769])) if 0x8769 in first else {}
    taken = text(exif.get(36867)) or text(first.get(306))
    return f"{taken}.{(text(exif.get(37521)) or '0')[:3].zfill(3)}" if taken else None


@F.pandas_udf(T.StringType())
def shot_time(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The time of a shot with thousandths, null where there is none or the block is broken. In Python: a binary format."""

    def of(photo: bytes | None) -> str | None:
        try:
            return None if photo is None else _shot_time(photo)
        except (KeyError, struct.error, IndexError):
            return None

    for part in contents:
        yield pd.Series([of(p) for p in part], dtype=object)
