"""Image metadata and resize plans; no pixels are touched."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import resize_geometry

FORMATS = ("auto", "jpeg", "png", "webp", "avif")
FILTERS = ("nearest", "triangle", "catmull_rom", "gaussian", "lanczos3")
#: Quality ranges and defaults.
QUALITY = {"jpeg": (1, 100, 75), "webp": (0, 100, None), "avif": (1, 100, 80)}
META = "path string, format string, mime string, width int, height int, error string"


def header_size(data: bytes) -> tuple[str, int, int]:
    """(format, width, height) from the first bytes of a PNG, GIF, JPEG or SVG file; ValueError for others."""
    import re
    import struct

    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + size
    head = data[:4096].decode("utf-8", "ignore")
    if (tag := re.search(r"<svg\b[^>]*>", head)) is not None:
        n = {k: float(v) for k, v in re.findall(r'\b(width|height)="([0-9.]+)', tag[0])}
        box = re.search(r'viewBox="[-0-9.]+[ ,]+[-0-9.]+[ ,]+([0-9.]+)[ ,]+([0-9.]+)', tag[0])
        w, h = (float(x) for x in box.groups()) if box else (0.0, 0.0)
        return "svg", int(n.get("width", w)), int(n.get("height", h))
    raise ValueError("not a known image")


def read_metadata(files: DataFrame) -> DataFrame:
    """files (path, content), as the binaryFile source gives them, with format and size; faults are in `error`."""

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    kind, w, h = header_size(bytes(c))
                    out.append((p, kind, "image/svg+xml" if kind == "svg" else f"image/{kind}", w, h, None))
                except Exception as e:  # noqa: BLE001  a broken file is a row with an error
                    out.append((p, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "format", "mime", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, META)


def output_format(given: Column, source: Column) -> Column:
    """`auto`: JPEG for lossy sources, PNG for others; else as given."""
    return F.when(given != "auto", given).when(source.isin("jpeg", "webp", "avif"), "jpeg").otherwise("png")


def bad_requests(requests: DataFrame) -> DataFrame:
    """Requests (format, quality, filter) outside of what is known, with the reason."""
    c = F.col
    reason = F.when(~c("format").isin(*FORMATS), "unknown format").when(~c("filter").isin(*FILTERS), "unknown filter")
    for name, (low, high, _) in QUALITY.items():
        reason = F.when((c("format") == name) & ~c("quality").between(low, high), f"quality of {name} must be {low} to {high}").otherwise(reason)
    return requests.withColumn("reason", reason).where("reason IS NOT NULL")


def plan(requests: DataFrame, op: str, width: int | None, height: int | None, quality: int = 75) -> DataFrame:
    """requests (path, width, height, format) with geometry and an output name; equal plans count once."""
    g = resize_geometry(op, F.col("width"), F.col("height"), width, height)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    mark = F.lower(F.lpad(F.hex(F.xxhash64("path", F.lit(op), F.to_json(g), F.lit(quality))), 16, "0"))
    return requests.withColumn("geometry", g).withColumn("output", F.concat_ws(".", stem, mark, output_format(F.lit("auto"), F.col("format")))).dropDuplicates(["output"])
