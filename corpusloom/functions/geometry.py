"""Boxes, scroll gestures, rescaling and image tiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
#: Margin of a long scroll, correction of end points, tile edge, most tiles.
MARGIN, PULL, TILE, MOST_TILES = 10, 50, 448, 6


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[F.col(c).cast("int").alias(n) if isinstance(c, str) else c.cast("int").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))])


def _box_of(text: Column, pattern: str) -> Column:
    part = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3, 4)]
    return F.when(text.rlike(pattern), box(*part))


def bounds(text: Column) -> Column:
    """A box from [x1,y1][x2,y2]; null where there is none."""
    return _box_of(text, r"\[(\d+),(\d+)\]\[(\d+),(\d+)\]")


def any_box(text: Column) -> Column:
    """A box from [..][..], else from (x1,y1),(x2,y2); null where there is neither."""
    return F.coalesce(bounds(text), _box_of(text, r"\((\d+),\s?(\d+)\),\s?\((\d+),\s?(\d+)\)"))


def four_numbers(text: Column) -> Column:
    """A box from a text that holds exactly four whole numbers, else null."""
    n = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    return F.when(F.size(n) == 4, box(*[F.element_at(n, i) for i in (1, 2, 3, 4)]))


def bounds_text(b: Column) -> Column:
    return F.format_string("[%d,%d][%d,%d]", b.x1, b.y1, b.x2, b.y2)


def area(b: Column) -> Column:
    return (b.x2 - b.x1).cast("long") * (b.y2 - b.y1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty or either box is missing."""
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0)).cast("long")
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0))
    both = w * h
    union = area(a) + area(b) - both
    return F.coalesce(F.when(union != 0, both / union), F.lit(0.0))


def halved(x: Column, by: int = 2) -> Column:
    return F.floor(x / by).cast("int")


def short_scroll(b: Column, direction: Column) -> Column:
    """Start and end of a short scroll: half the box around its middle, as fx, fy, tx, ty."""
    mx, my = halved(b.x1 + b.x2), halved(b.y1 + b.y2)
    dx, dy = halved(b.x2 - b.x1, 4), halved(b.y2 - b.y1, 4)
    zero = F.lit(0)
    sx = F.when(direction == "left", dx).when(direction == "right", -dx).otherwise(zero)
    sy = F.when(direction == "up", dy).when(direction == "down", -dy).otherwise(zero)
    ok = direction.isin("up", "down", "left", "right")
    return F.when(ok, F.struct((mx + sx).alias("fx"), (my + sy).alias("fy"), (mx - sx).alias("tx"), (my - sy).alias("ty")))


def long_scroll(b: Column, direction: Column, width: int, height: int) -> Column:
    """From the box's edge to the far edge of the window, both less a margin."""
    mx, my = halved(b.x1 + b.x2), halved(b.y1 + b.y2)
    case = lambda up, down, left, right: F.when(direction == "up", up).when(direction == "down", down).when(direction == "left", left).when(direction == "right", right)
    return F.when(
        direction.isin("up", "down", "left", "right"),
        F.struct(
            case(mx, mx, b.x2 - MARGIN, b.x1 + MARGIN).alias("fx"),
            case(b.y2 - MARGIN, b.y1 + MARGIN, my, my).alias("fy"),
            case(mx, mx, F.lit(MARGIN), F.lit(width - MARGIN)).alias("tx"),
            case(F.lit(MARGIN), F.lit(height - MARGIN), my, my).alias("ty"),
        ),
    )


def inferred_scroll(s: Column) -> Column:
    """Direction and box behind a gesture fx, fy, tx, ty.

    A gesture to larger x is called left here, the other way round than short_scroll's naming.
    """
    mx, my = halved(s.fx + s.tx), halved(s.fy + s.ty)
    dx, dy = halved(F.abs(s.fx - s.tx)), halved(F.abs(s.fy - s.ty))
    direction = F.when(s.fy < s.ty, "down").when(s.fy > s.ty, "up").when(s.fx < s.tx, "left").otherwise("right")
    upright = s.fy != s.ty
    kx, ky = F.when(upright, 2).otherwise(1), F.when(upright, 1).otherwise(2)
    return F.struct(direction.alias("direction"), box(mx - dx * kx, my - dy * ky, mx + dx * kx, my + dy * ky).alias("box"))


def clamped(value: Column, highest: Column) -> Column:
    """An end point off the edge: the highest value comes in by PULL, zero goes out by PULL."""
    return F.when(value == highest, value - PULL).when(value == 0, value + PULL).otherwise(value)


def rescaled(b: Column, from_w: float, from_h: float, to_w: float, to_h: float) -> Column:
    """Another coordinate grid, cut to whole numbers."""
    x = lambda v: (v * to_w / from_w).cast("int")
    y = lambda v: (v * to_h / from_h).cast("int")
    return box(x(b.x1), y(b.y1), x(b.x2), y(b.y2))


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corner form of a box given by its corner, width and height, cut to whole numbers."""
    return box(x.cast("int"), y.cast("int"), (x + w).cast("int"), (y + h).cast("int"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def tile_ratios(most: int = MOST_TILES, least: int = 1) -> list[tuple[int, int]]:
    """Grids of at most `most` tiles, ordered by tiles and, among equals, by columns."""
    grids = {(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most}
    return sorted(grids, key=lambda g: (g[0] * g[1], g))


def tile_grid(width: Column, height: Column, most: int = MOST_TILES, tile: int = TILE) -> Column:
    """The grid, as columns x rows, nearest to the image's aspect ratio.

    On equal distance a later grid wins if the image has more than half of its pixels. Evaluated
    as a fold over the few grids, inside generated code.
    """
    grids = F.array(*[F.struct(F.lit(i).alias("nx"), F.lit(j).alias("ny")) for i, j in tile_ratios(most)])
    start = F.struct(F.lit(float("inf")).alias("off"), F.lit(1).alias("nx"), F.lit(1).alias("ny"))

    def step(best: Column, g: Column) -> Column:
        off = F.abs(width / height - g.nx / g.ny)
        larger = width * height > F.lit(0.5 * tile * tile) * g.nx * g.ny
        take = (off < best.off) | ((off == best.off) & larger)
        return F.struct(F.when(take, off).otherwise(best.off).alias("off"), F.when(take, g.nx).otherwise(best.nx).alias("nx"), F.when(take, g.ny).otherwise(best.ny).alias("ny"))

    return F.aggregate(grids, start, step, lambda b: F.struct(b.nx.alias("nx"), b.ny.alias("ny")))


def tile_boxes(grid: Column, tile: int = TILE) -> Column:
    """One box per tile, row by row."""
    return F.transform(
        F.sequence(F.lit(0), grid.nx * grid.ny - 1),
        lambda i: box((i % grid.nx) * tile, F.floor(i / grid.nx) * tile, (i % grid.nx + 1) * tile, (F.floor(i / grid.nx) + 1) * tile),
    )
