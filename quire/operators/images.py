"""Images: decorative ones, captions, and which can be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CAPTION, squeeze
from .layout import IMAGE

#: What image rows add to those of blocks.
IMAGE_COLUMNS = {"alt_text": "string", "image_file": "string", "packed": "boolean", "preserved": "boolean", "decorative": "boolean"}
#: Columns that are needed to tell decoration.
MEASURED = ("page_width", "page_height", "xref", "pixel_width", "pixel_height")
#: Points: how far a caption may be from its image.
NEAR = 42


def image_zone() -> Column:
    """The margin an image stands in: the first of top, bottom, left, right; null in the body."""
    wide, high = F.col("page_width"), F.col("page_height")
    return (
        F.when(F.col("y1") <= high * 0.15, "top").when(F.col("y0") >= high * 0.85, "bottom")
        .when(F.col("x1") <= wide * 0.18, "left").when(F.col("x0") >= wide * 0.82, "right")
    )


def with_decoration(images: DataFrame) -> DataFrame:
    """Add ``decorative``: small images in a margin that stand on three pages or more."""
    wide, high = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    small = (wide <= F.greatest(F.lit(48.0), F.col("page_width") * 0.09)) & (high <= F.greatest(F.lit(48.0), F.col("page_height") * 0.09))
    few = (F.coalesce("pixel_width", F.lit(0)) <= 160) & (F.coalesce("pixel_height", F.lit(0)) <= 160)
    key = F.coalesce(F.col("xref").cast("string"), F.col("media_type"))
    rows = images.withColumns({"zone": image_zone(), "key": key}).withColumn("margin", F.coalesce(small & few & F.col("zone").isNotNull(), F.lit(False)))
    same = Window.partitionBy("doc_id", "margin", "key", "pixel_width", "pixel_height", "zone")
    rows = rows.withColumn("nth", F.dense_rank().over(same.orderBy("page_index")))
    return rows.withColumn("decorative", F.col("margin") & (F.max("nth").over(same) >= 3)).drop("zone", "key", "margin", "nth")


def decorative_images(images: DataFrame) -> DataFrame:
    """Small images in a margin that stand on three pages or more: (doc_id, image_id)."""
    return with_decoration(images).where("decorative").select("doc_id", "image_id")


def image_rows(images: DataFrame) -> DataFrame:
    """Images as rows in a lane of their own, to be placed with the blocks of their document; once each.

    Images with ``data`` are preserved where it is known, others where they have
    a file.  Decoration is told where pages and pixels are measured.
    """
    held = {*images.columns}
    if held.issuperset(MEASURED):
        told = with_decoration(images)
    else:
        told = images.withColumn("decorative", F.lit(False))
    filed = F.col("file_name").isNotNull() & F.col("media_type").isNotNull()
    packed = filed & F.col("data").isNotNull() if "data" in held else F.lit(False)
    return told.select(
        "doc_id", F.col("image_id").alias("block_id"), "page_index", "x0", "y0", "x1", "y1", "alt_text", F.col("file_name").alias("image_file"), packed.alias("packed"),
        (packed if "data" in held else filed).alias("preserved"), "decorative", F.lit(IMAGE).alias("lane"),
    )


def caption(text: Column) -> Column:
    """The text of a block that is a caption on one line, else null."""
    return F.when(text.rlike(CAPTION), squeeze(text))


def _distance(block: dict[str, Column], image: dict[str, Column]) -> tuple[Column, Column]:
    """Is a block near an image, and how far it begins below its end."""
    gap = F.least(F.abs(block["y0"] - image["y1"]), F.abs(image["y0"] - block["y1"]))
    shared = F.least(block["x1"], image["x1"]) - F.greatest(block["x0"], image["x0"])
    narrower = F.least(*[F.greatest(F.lit(0.0), b["x1"] - b["x0"]) for b in (block, image)])
    return (gap <= NEAR) & (shared >= narrower * 0.25), F.abs(block["y0"] - image["y1"])


def with_captions(rows: DataFrame) -> DataFrame:
    """Images without an alternative text get the nearest caption of their page, where one is near; other blocks see no captions."""
    page = Window.partitionBy("doc_id", "page_index", F.col("caption").isNotNull() | (F.col("lane") == IMAGE))
    sides = ("x0", "y0", "x1", "y1")
    rows = rows.withColumn("captions", F.collect_list(F.when(F.col("caption").isNotNull(), F.struct("caption", "block_id", *sides))).over(page))
    here = {s: F.col(s) for s in sides}
    near = F.filter("captions", lambda c: _distance({s: c[s] for s in sides}, here)[0])
    ranked = F.array_sort(F.transform(near, lambda c: F.struct(_distance({s: c[s] for s in sides}, here)[1].alias("d"), c["block_id"].alias("b"), c["caption"].alias("caption"))))
    best = F.when((F.col("lane") == IMAGE) & F.col("alt_text").isNull(), F.get(ranked, F.lit(0))["caption"])
    return rows.withColumn("alt_text", F.coalesce("alt_text", best)).drop("captions")


def image_captions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nearest caption of each image on its page, if one is near: (doc_id, image_id, caption)."""
    sides = ("x0", "y0", "x1", "y1")
    held = blocks.where(F.col("raw_text").rlike(CAPTION)).select("doc_id", "page_index", "block_id", "raw_text", *[F.col(c).alias(f"b{c}") for c in sides])
    pairs = images.select("doc_id", "page_index", "image_id", *sides).join(held, ["doc_id", "page_index"])
    near, below = _distance({s: F.col(f"b{s}") for s in sides}, {s: F.col(s) for s in sides})
    first = F.row_number().over(Window.partitionBy("doc_id", "image_id").orderBy(below, "block_id"))
    return pairs.where(near).withColumn("r", first).where("r = 1").select("doc_id", "image_id", squeeze(F.col("raw_text")).alias("caption"))


def image_status(images: DataFrame) -> DataFrame:
    """What becomes of each image: preserved, removed_as_artifact or not_preserved, with the reason."""
    kept = F.col("has_data") & F.col("extension").isNotNull() & F.col("media_type").isNotNull()
    status = F.when(F.col("decorative"), "removed_as_artifact").when(kept, "preserved").otherwise("not_preserved")
    message = F.format_string("Image on page %d was not preserved.", F.col("page_index") + 1)
    told = with_decoration(images).withColumn("status", status)
    return told.select("doc_id", "image_id", "page_index", "status", F.when(F.col("status") == "not_preserved", message).alias("message"))


def images_of_elements(elements: DataFrame) -> DataFrame:
    """Images as placed by document elements, once each; sizes in pixels and of pages aren't known there."""
    ref = F.get("source_refs", F.lit(0))
    box = [ref["bbox"][c].alias(c) for c in ("x0", "y0", "x1", "y1")]
    named = [F.col(f"image.{c}").alias(c) for c in ("media_type", "file_name", "alt_text")]
    held = elements.where("image is not null and size(source_refs) > 0")
    return held.select("doc_id", F.col("image.image_id").alias("image_id"), ref["page_index"].alias("page_index"), *box, *named).dropDuplicates(["doc_id", "image_id"])
