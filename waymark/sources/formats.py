"""Readers and writers beside Parquet: CSV, JSON records, JSON lines, tiles, lists."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One image as a point of a tile checkpoint.
POINT = "image_id bigint, sequence_id string, captured_at bigint, lat double, lon double, compass_angle double, is_pano boolean, creator_id bigint"
#: Columns an image table must have; missing ones are filled with null.
IMAGE_COLUMNS = dict(c.split(" ") for c in POINT.split(", "))
DETECTIONS = "image_id bigint, counts map<string, int>"


def with_required_columns(df: DataFrame, columns: dict[str, str] = IMAGE_COLUMNS) -> DataFrame:
    """The given columns in their order and types, null where ``df`` lacks one."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def write_csv(df: DataFrame, path: str) -> None:
    """S3."""
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str = POINT) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def write_rankings(df: DataFrame, path: str) -> None:
    """Rankings as one row per query with the arrays ``indices`` and ``similarities``."""
    entries = F.sort_array(F.collect_list(F.struct("rank", "ref_id", "sim")))
    lists = df.groupBy("query_id").agg(entries.alias("e"))
    lists.select("query_id", F.transform("e", lambda x: x["ref_id"]).alias("indices"), F.transform("e", lambda x: x["sim"]).alias("similarities")).write.mode("overwrite").parquet(path)


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows.select("query_id", F.posexplode(F.arrays_zip(F.col("indices").alias("ref_id"), F.col("similarities").alias("sim"))).alias("at", "e"))
    return rows.select("query_id", (F.col("at") + 1).cast("long").alias("rank"), "e.ref_id", "e.sim")


def strict(value):
    """A value fit for strict JSON: NaN and infinities become null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: strict(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [strict(v) for v in value]
    return value


def write_record(record: dict, path: str) -> None:
    """One record as strict JSON, keys in order of insertion."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(strict(record), out, ensure_ascii=False, indent=2, allow_nan=False)
        out.write("\n")


def as_json(df: DataFrame) -> DataFrame:
    """S11 in the cluster: one JSON string per row, NaN and infinities as null."""
    clean = [F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def read_records(spark: SparkSession, path: str, required: str, schema: str | None = None) -> DataFrame:
    """Records of many JSON files that have the field ``required``."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.where(F.col(required).isNotNull()) if required in rows.columns else rows.limit(0)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a count per class; of repeated images the greatest line counts."""
    lines = spark.read.schema(DETECTIONS).json(path).where("image_id is not null")
    best = F.max_by("counts", F.size("counts")).alias("counts")
    return lines.groupBy("image_id").agg(best)


def append_detections(df: DataFrame, path: str) -> None:
    df.select("image_id", "counts").write.mode("append").json(path)


def tile_points(checkpoints: DataFrame, text_col: str = "value") -> DataFrame:
    """Points of tile checkpoints ``{"x_y": [point, ...]}``, one file or line per row, with their tile."""
    parsed = checkpoints.select(F.from_json(text_col, f"map<string, array<struct<{POINT}>>>").alias("tiles"))
    return parsed.select(F.explode("tiles").alias("tile", "points")).select("tile", F.inline("points"))


def ordered_distinct(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(position).alias(position))


def merged_records(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Record merge: new values win, nulls never overwrite, rows of either side are kept."""
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    a, b = old.alias("a"), new.alias("b")
    pick = [F.coalesce(*[F.col(f"{s}.{c}") for s, df in (("b", new), ("a", old)) if c in df.columns]).alias(c) for c in fields]
    return a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *pick)


def complete_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, complete`` of JPEG files; decoded where an image library is there, else by start and end marks."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from PIL import Image
        except ImportError:
            Image = None

        def whole(data: bytes) -> bool:
            if Image is None:
                return data[:2] == b"\xff\xd8" and data.rstrip(b"\0")[-2:] == b"\xff\xd9"
            import io

            try:
                Image.open(io.BytesIO(data)).load()
                return True
            except Exception:
                return False

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "complete": [whole(bytes(x)) for x in batch["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)
    return files.select("path", "content").mapInPandas(check, "path string, complete boolean")


#: How letters outside ASCII are spelt in folder names.
LETTERS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ø": "oe", "æ": "ae", "å": "aa", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "œ": "oe"}


def _accented() -> dict[str, str]:
    """Latin letters that decompose into an ASCII letter and marks, by Unicode's own rule."""
    blocks = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    plain = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if x.isascii()) for c in blocks}
    return {c: p.lower() for c, p in plain.items() if len(p) == 1 and p.isalnum()}


def place_slug(name: Column | str) -> Column:
    """ASCII folder name of a place, as an expression.

    What follows a comma is dropped, marks are stripped, other letters are lost, everything
    else between letters and digits becomes one hyphen. Null stays null; a name of which
    nothing is left is an error.
    """
    c = F.lower(F.split_part(F.col(name) if isinstance(name, str) else name, F.lit(","), F.lit(1)))
    for letter, spelling in LETTERS.items():
        c = F.replace(c, F.lit(letter), F.lit(spelling))
    marks = {k: v for k, v in _accented().items() if k not in LETTERS}
    c = F.translate(c, "".join(marks), "".join(marks.values()))
    c = F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(c), r"[^\x00-\x7F]", ""), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(c == "", F.raise_error(F.lit("nothing is left of a place's name"))).otherwise(c)


def variant_base(variant: str) -> tuple[str, str | None]:
    """A variant's base and what was added to it last: ``x_gv20 -> (x, gv20)``."""
    m = re.fullmatch(r"(.+)_(gv\d+|seq\d+|hmm[\d.]+-[\d.]+|pcaw?\d+|concat|linear|fullref)", variant)
    return (m[1], m[2]) if m else (variant, None)
