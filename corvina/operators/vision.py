"""Pixel operators on tables (image, pos, b, g, r), a row for each pixel, and on grey tables (image, pos, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as tx

# Ranges of hue, saturation and value by colour; red has two.
COLOURS = {
    "Verde": [((35, 50, 50), (85, 255, 255))],
    "Azul": [((100, 50, 50), (130, 255, 255))],
    "Amarillo": [((20, 100, 100), (30, 255, 255))],
    "Rojo": [((0, 50, 50), (10, 255, 255)), ((170, 50, 50), (179, 255, 255))],
}
WHITE = ((0, 0, 200), (180, 50, 255))
SINGLE_RANGE = ((60, 50, 50), (66, 255, 255))
MESSAGE_RANGE = ((15, 100, 100), (20, 255, 255))


def pixels(images: DataFrame) -> DataFrame:
    """image, pos, b, g, r of Spark's image rows (three channels, row-major); pixels are exploded without leaving the JVM."""
    at = lambda k: F.ascii(F.lit("")) if k is None else F.conv(F.hex(F.substring("image.data", F.col("pos") * 3 + k, 1)), 16, 10).cast("int")
    own = images.where("image.nChannels = 3").withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("image.height") * F.col("image.width") - 1)))
    return own.select(F.col("image.origin").alias("image"), F.col("pos").cast("long").alias("pos"), at(1).alias("b"), at(2).alias("g"), at(3).alias("r"))


def grey(p: DataFrame) -> DataFrame:
    """image, pos, v by luma."""
    return p.select("image", "pos", F.round(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r")).cast("int").alias("v"))


def hsv(p: DataFrame) -> DataFrame:
    """Adds h (0 to 179), s and v (0 to 255)."""
    b, g, r = (F.col(c).cast("double") for c in "bgr")
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    d = top - low
    hue = F.when(d == 0, 0.0).when(top == r, 60 * (g - b) / d).when(top == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    h = F.round(hue / 2).cast("int")
    return p.withColumns({"h": F.when(h >= 180, h - 180).otherwise(h), "s": F.when(top == 0, 0).otherwise(F.round(255 * d / top).cast("int")), "v": top.cast("int")})


def in_range(low: tuple, high: tuple, columns: tuple = ("h", "s", "v")) -> Column:
    out = F.lit(True)
    for c, a, b in zip(columns, low, high):
        out = out & F.col(c).between(a, b)
    return out


def masked(p: DataFrame, mask: Column, columns: tuple = ("b", "g", "r")) -> DataFrame:
    """Channels outside the mask become 0."""
    return p.withColumns({c: F.when(mask, F.col(c)).otherwise(0) for c in columns})


def colour_shares(p: DataFrame) -> DataFrame:
    """image, n_pixels (not white), one count for each colour, predominant (ties: the order of COLOURS), pct; all-white images are left out."""
    q = hsv(p)
    coloured = ~in_range(*WHITE)
    any_of = lambda ranges: coloured & (in_range(*ranges[0]) if len(ranges) == 1 else in_range(*ranges[0]) | in_range(*ranges[1]))
    out = q.groupBy("image").agg(F.count_if(coloured).alias("n_pixels"), *(F.count_if(any_of(v)).alias(k) for k, v in COLOURS.items())).where("n_pixels > 0")
    best, name = F.greatest(*COLOURS), F.lit(None).cast("string")
    for k in reversed(COLOURS):
        name = F.when(F.col(k) == best, k).otherwise(name)
    return out.select("*", name.alias("predominant"), (best * 100 / F.col("n_pixels")).alias("pct"))


def lsb(v: Column) -> Column:
    return v.bitwiseAND(1)


def message(bits: DataFrame, terminator: str = "###FIN###") -> DataFrame:
    """image, message from (image, pos, bit): 8 bits in order make a character, the rest is ignored; up to the terminator.

    Characters are made where their bits are; a message is gathered by image.
    """
    b = bits.select("image", F.floor(F.col("pos") / 8).alias("c"), "pos", F.col("bit").cast("int").alias("bit"))
    code = F.sum(F.col("bit") * F.pow(F.lit(2), 7 - F.col("pos") % 8)).cast("int")
    chars = b.groupBy("image", "c").agg(F.count(F.lit(1)).alias("n"), code.alias("code")).where("n = 8")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "code"))), lambda x: F.chr(x["code"])), "")
    return chars.groupBy("image").agg(text.alias("message")).select("image", tx.up_to_terminator(F.col("message"), terminator).alias("message"))


def grey_message(p: DataFrame) -> DataFrame:
    return message(p.select("image", "pos", lsb(F.col("v")).alias("bit")))


def masked_message(p: DataFrame, low: tuple = MESSAGE_RANGE[0], high: tuple = MESSAGE_RANGE[1]) -> DataFrame:
    """Message in the value channel of the pixels in a range, renumbered in their order."""
    q = hsv(p).where(in_range(low, high))
    place = F.row_number().over(Window.partitionBy("image").orderBy("pos")) - 1
    return message(q.select("image", place.alias("pos"), lsb(F.col("v")).alias("bit")))


def min_max_scale(p: DataFrame, column: str = "v", invert: bool = False) -> DataFrame:
    """Values of each image scaled to 0..255 and truncated; inverted first if asked."""
    w = Window.partitionBy("image")
    x = F.max(column).over(w) - F.col(column) if invert else F.col(column)
    q = p.withColumn("_x", x)
    q = q.withColumn("_x", F.col("_x") - F.min("_x").over(w))
    top = F.max("_x").over(w)
    return q.withColumn(column, F.when(top == 0, 0).otherwise((F.col("_x") / top * 255).cast("int"))).drop("_x")


def decoded(p: DataFrame, columns: list[str], divisor: float = 355.0) -> DataFrame:
    """Channel values as fractions of a divisor."""
    return p.withColumns({c: F.col(c).cast("double") / divisor for c in columns})


def flipped(p: DataFrame, width: int, height: int, seed: int = 0) -> DataFrame:
    """Pixels (image, x, y, ...) of images that are mirrored left to right, and top to bottom, by a seeded coin for each image."""
    coin = lambda axis: F.md5(F.concat_ws(":", F.col("image").cast("string"), F.lit(f"{seed}:{axis}")).cast("binary")) < "8"
    turned = lambda c, size: F.when(coin(c), size - 1 - F.col(c)).otherwise(F.col(c))
    return p.withColumns({"x": turned("x", width), "y": turned("y", height)})


def resized(p: DataFrame, size: tuple[int, int], target: tuple[int, int], column: str = "v") -> DataFrame:
    """image, x, y, column in the target size (width, height): bilinear, centres of pixels aligned, edges repeated."""
    axis = []
    for c, old, new in (("x", size[0], target[0]), ("y", size[1], target[1])):
        at = (F.col(c) + 0.5) * (old / new) - 0.5
        low = F.floor(at)
        inside = lambda v, old=old: F.greatest(F.lit(0), F.least(F.lit(old - 1), v)).cast("int")
        axis.append(F.array(F.struct(inside(low).alias("at"), (1 - (at - low)).alias("w")), F.struct(inside(low + 1).alias("at"), (at - low).alias("w"))))
    grid = p.select("image").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(target[0] - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(target[1] - 1))))
    reads = grid.withColumn("i", F.explode(axis[0])).withColumn("j", F.explode(axis[1])).select("image", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("i.at").alias("x"), F.col("j.at").alias("y"), (F.col("i.w") * F.col("j.w")).alias("w"))
    return reads.join(p.select("image", "x", "y", column), ["image", "x", "y"]).groupBy("image", F.col("tx").alias("x"), F.col("ty").alias("y")).agg(F.sum(F.col("w") * F.col(column)).alias(column))
