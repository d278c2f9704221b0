"""Images and videos as tables: one row per frame (pixels, row-major) or per block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import quantize, rle_decode, rle_encode, sad


def long_pixels(frames: DataFrame, width: int = 8) -> DataFrame:
    return frames.select("frame_id", F.posexplode("pixels").alias("i", "v")).select("frame_id", F.floor(F.col("i") / width).cast("int").alias("row"), (F.col("i") % width).cast("int").alias("col"), "v")


def frame_differences(frames: DataFrame, by: list[str] = (), span: int = 1000) -> DataFrame:
    """pixels of the frame before minus this one; the first frame goes. Frames are compared inside ranges of `span` numbers; the first of a range
    takes the last of the range before (a row per range)."""
    r = frames.withColumn("_r", F.floor(F.col("frame_id") / span))
    w = Window.partitionBy(*by, "_r").orderBy("frame_id")
    ends = r.groupBy(*by, "_r").agg(F.max_by("pixels", "frame_id").alias("_e")).withColumn("_e", F.lag("_e").over(Window.partitionBy(*by).orderBy("_r")))
    r = r.withColumn("_p", F.lag("pixels").over(w)).withColumn("_first", F.row_number().over(w) == 1).join(ends, [*by, "_r"])
    r = r.withColumn("_p", F.when(F.col("_first"), F.col("_e")).otherwise(F.col("_p"))).filter("_p IS NOT NULL")
    return r.select(*[F.zip_with("_p", "pixels", lambda a, b: a - b).alias(c) if c == "pixels" else c for c in frames.columns])


def reconstruct(first: DataFrame, differences: DataFrame) -> DataFrame:
    """(frame_id, i, v): the key frame's pixels minus the sums of the differences so far, pixel by pixel."""
    pix = lambda d: d.select("frame_id", F.posexplode("pixels").alias("i", "v"))
    w = Window.partitionBy("i").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    signed = pix(first).withColumn("_s", F.col("v")).unionByName(pix(differences).withColumn("_s", -F.col("v")))
    return signed.withColumn("v", F.sum("_s").over(w)).drop("_s")


def macroblocks(pixels: DataFrame, size: int = 16) -> DataFrame:
    """(frame_id, by, bx, block): tiles of size x size, padded with zeros to whole tiles."""
    blocks = pixels.groupBy("frame_id", F.floor(F.col("row") / size).cast("int").alias("by"), F.floor(F.col("col") / size).cast("int").alias("bx")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("row") % size * size + F.col("col") % size).cast("int").alias("k"), F.col("v").alias("v")))).alias("_m"))
    return blocks.withColumn("block", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)))).drop("_m")


def unblock(blocks: DataFrame, size: int = 16) -> DataFrame:
    b = blocks.select("frame_id", "by", "bx", F.posexplode("block").alias("k", "v"))
    return b.select("frame_id", (F.col("by") * size + F.floor(F.col("k") / size)).cast("int").alias("row"), (F.col("bx") * size + F.col("k") % size).cast("int").alias("col"), "v")


def block_variance(pixels: DataFrame, size: int = 16) -> DataFrame:
    """Per block the largest sample variance of its columns."""
    c = pixels.groupBy("frame_id", F.floor(F.col("row") / size).cast("int").alias("by"), F.floor(F.col("col") / size).cast("int").alias("bx"), "col").agg(F.var_samp("v").alias("_v"))
    return c.groupBy("frame_id", "by", "bx").agg(F.max("_v").alias("variance"))


def moving_blocks(blocks: DataFrame, value: str = "variance") -> DataFrame:
    """Blocks whose value is strictly above Q75 + 1.5 interquartile ranges of their frame."""
    q = blocks.groupBy("frame_id").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    return blocks.join(q, "frame_id").filter(F.col(value) > F.col("_q")[1] + 1.5 * (F.col("_q")[1] - F.col("_q")[0])).drop("_q")


def with_neighbours(points: DataFrame, least: int = 1) -> DataFrame:
    """(frame_id, y, x, n): points with at least so many others at Chebyshev distance 1."""
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    p = points.select("frame_id", "y", "x").distinct()
    near = p.withColumn("_d", d).select("frame_id", (F.col("y") + F.col("_d.i")).alias("y"), (F.col("x") + F.col("_d.j")).alias("x"))
    return near.join(p, ["frame_id", "y", "x"]).groupBy("frame_id", "y", "x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def bounding_cells(points: DataFrame, least: int = 1) -> DataFrame:
    """Every cell of the rectangle around the points that have neighbours."""
    r = with_neighbours(points, least).groupBy("frame_id").agg(*[f(c).alias(n) for f, c, n in ((F.min, "y", "y0"), (F.max, "y", "y1"), (F.min, "x", "x0"), (F.max, "x", "x1"))])
    return r.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1"))).select("frame_id", "y", "x")


def swap_blocks(front: DataFrame, back: DataFrame, coords: DataFrame) -> DataFrame:
    keys = ["frame_id", "by", "bx"]
    b = back.select(*keys, F.col("block").alias("_b")).join(coords, keys, "left_semi")
    return front.join(b, keys, "left").withColumn("block", F.coalesce("_b", "block")).drop("_b")


def neighbourhood(target: DataFrame, k: int, size: int, height: int, width: int) -> DataFrame:
    """The target's rows with dy, dx of its nine candidate positions, and whether each lies inside (strict bounds)."""
    cells = F.explode(F.array(*[F.struct(F.lit(i * k).alias("dy"), F.lit(j * k).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    t = target.withColumn("_o", cells).withColumn("dy", F.col("_o.dy")).withColumn("dx", F.col("_o.dx")).drop("_o")
    yy, xx = F.col("y") + F.col("dy"), F.col("x") + F.col("dx")
    return t.withColumn("inside", (yy >= 0) & (xx >= 0) & (yy + size < height) & (xx + size < width))


def neighbourhood_sad(reference: DataFrame, target: DataFrame, k: int, size: int, height: int, width: int) -> DataFrame:
    """(frame_id, y, x, dy, dx, sad) of the nine candidate positions of every target block; null outside (strict bounds). Both sides hold one
    row per frame: pixels; positions come from the target's block coordinates (y, x)."""
    j = neighbourhood(target, k, size, height, width).join(reference.select("frame_id", F.col("pixels").alias("_p")), "frame_id")
    yy, xx, inside = F.col("y") + F.col("dy"), F.col("x") + F.col("dx"), F.col("inside")
    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice("_p", (yy + r) * width + xx + 1, size)))
    return j.withColumn("sad", F.when(inside, sad(F.when(inside, cut), "block"))).select("frame_id", "y", "x", "dy", "dx", "sad")


def motion_search(reference: DataFrame, target: DataFrame, k: int, size: int, height: int, width: int) -> DataFrame:
    """(frame_id, y, x, to_y, to_x): logarithmic search of every target block in the reference frame. The step halves when the centre wins; a block
    without any candidate inside stays where it is. As many joins as halvings and moves need: the loop runs inside one Arrow map."""
    import numpy as np

    joined = target.join(reference.select("frame_id", F.col("pixels").alias("ref")), "frame_id")

    def search(batches):
        for pdf in batches:
            out = []
            for y, x, block, ref in zip(pdf["y"], pdf["x"], pdf["block"], pdf["ref"]):
                img, b, step, cy, cx = np.asarray(ref, float).reshape(height, width), np.asarray(block, float).reshape(size, size), k, int(y), int(x)
                while step:
                    best = None
                    for i in (-1, 0, 1):
                        for j in (-1, 0, 1):
                            yy, xx = cy + i * step, cx + j * step
                            if 0 <= yy and 0 <= xx and yy + size < height and xx + size < width:
                                v = float(np.abs(b - img[yy : yy + size, xx : xx + size]).sum())
                                if best is None or v < best[0]:
                                    best = (v, yy, xx)
                    if best is None or (best[1], best[2]) == (cy, cx):
                        step //= 2
                    else:
                        cy, cx = best[1], best[2]
                out.append((cy, cx))
            yield pdf[["frame_id", "y", "x"]].assign(to_y=[o[0] for o in out], to_x=[o[1] for o in out])

    kind = dict(target.dtypes)["frame_id"]
    return joined.mapInPandas(search, f"frame_id {kind}, y int, x int, to_y int, to_x int")


def video_encode(frames: DataFrame, key_q: int = 10, diff_q: int = 100) -> DataFrame:
    """(frame_id, tokens): the first frame and the differences, quantized and run-length coded."""
    first = frames.join(frames.agg(F.min("frame_id").alias("frame_id")), "frame_id")
    return first.select("frame_id", rle_encode(quantize("pixels", key_q)).alias("tokens")).unionByName(frame_differences(frames).select("frame_id", rle_encode(quantize("pixels", diff_q)).alias("tokens")))


def video_decode(encoded: DataFrame) -> DataFrame:
    d = encoded.select("frame_id", rle_decode("tokens").alias("pixels"))
    first = d.agg(F.min("frame_id").alias("frame_id"))
    return reconstruct(d.join(first, "frame_id"), d.join(first, "frame_id", "left_anti"))
