"""Image boxes as Column expressions: normalised x0, y0, x1, y1 with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_measures(df: DataFrame, x0="bx0", y0="by0", x1="bx1", y1="by1") -> DataFrame:
    width, height = F.greatest(F.lit(0.0), F.col(x1) - F.col(x0)), F.greatest(F.lit(0.0), F.col(y1) - F.col(y0))
    return df.withColumns({
        "box_width": width, "box_height": height, "box_area": width * height, "box_aspect": F.when(height > 1e-9, width / height).otherwise(1.0),
        "box_cx": (F.col(x0) + F.col(x1)) / 2, "box_cy": (F.col(y0) + F.col(y1)) / 2})


def iou(a: list[Column], b: list[Column]) -> Column:
    overlap = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    shared = overlap(0) * overlap(1)
    union = area(a) + area(b) - shared
    return F.when(union > 1e-9, shared / union).otherwise(0.0)


def tile_to_image(box: list[Column], tile: list[Column]) -> list[Column]:
    """A box inside a tile in the coordinates of the whole image."""
    w, h = tile[2] - tile[0], tile[3] - tile[1]
    return [tile[0] + box[0] * w, tile[1] + box[1] * h, tile[0] + box[2] * w, tile[1] + box[3] * h]


def plan_tiles(images: DataFrame, max_tiles: int = 9, overlap: float = 0.18, bonus: float = 0.06, smallest: int = 1100) -> DataFrame:
    """Tile rectangles of large images: the grid of at most ``max_tiles`` with the squarest tiles, 0.06 per tile.

    ``images``: image_id, width, height, mode. The choice runs over a fixed list of grids inside the row.
    """
    longest = F.greatest("width", "height")
    due = ~F.col("mode").isin("skip", "geometry") & (longest >= smallest) & ((F.col("mode") == "layout") | (longest >= smallest * 1.6))
    grids = [(c, r) for c in range(1, 5) for r in range(1, 5) if 1 < c * r <= max_tiles]

    def candidate(no: int, cols: int, rows: int) -> Column:
        aspect = (F.col("width") / cols) / (F.col("height") / rows)
        return F.struct((-(F.round(-F.abs(F.log(aspect)) + bonus * cols * rows, 12))).alias("s"), F.lit(no).alias("no"), F.lit(cols).alias("cols"), F.lit(rows).alias("rows"))

    best = F.array_min(F.array(*[candidate(i, c, r) for i, (c, r) in enumerate(grids)]))
    tiled = images.filter(due).withColumn("_g", best)
    cells = tiled.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.col("_g.rows") - 1))).withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.col("_g.cols") - 1)))
    side = lambda i, n, at: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(i) + at) / F.col(n) + (overlap if at else -overlap) / F.col(n)))
    return cells.select(
        "image_id", "tile_row", "tile_col", side("tile_col", "_g.cols", 0).alias("x0"), side("tile_row", "_g.rows", 0).alias("y0"),
        side("tile_col", "_g.cols", 1).alias("x1"), side("tile_row", "_g.rows", 1).alias("y1"))
