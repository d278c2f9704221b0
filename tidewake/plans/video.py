"""Queries over images and frames: embeddings as 8 x 8 images, their number as frame order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import frames as V
from ..operators import series as N
from .views import query, r6, table

WIDTH = 8
R = X.portable


def frames(s, d):
    """Pixels from 0 to 255, whole numbers."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * F.lit(255.0))).cast("array<double>").alias("pixels"))


def pix(s, d):
    return V.long_pixels(frames(s, d), WIDTH)


FR = "fr AS (SELECT vec_id AS frame_id, [CAST(floor(abs(CAST(x AS DOUBLE)) * 255.0::DOUBLE) AS DOUBLE) for x in embedding] AS pixels FROM embeddings)"
PIX = FR + ", px AS (SELECT frame_id, CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col, pixels[i] AS v FROM (SELECT frame_id, pixels, unnest(range(1, 65)) AS i FROM fr))"
VAR = PIX + ", vb AS (SELECT frame_id, by, bx, max(v) AS variance FROM (SELECT frame_id, row // 2 AS by, col // 2 AS bx, col, var_samp(v) AS v FROM px GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"
MOV = VAR + ", mq AS (SELECT frame_id, quantile_cont(variance, 0.25) AS a, quantile_cont(variance, 0.75) AS b FROM vb GROUP BY 1), mv AS (SELECT vb.* FROM vb JOIN mq USING (frame_id) WHERE variance > b + 0.5::DOUBLE * (b - a))"
query("d10_pixels", f"WITH {PIX} SELECT frame_id, row, col, v FROM px")(lambda s, d: pix(s, d))
query("a12_entropy", f"WITH {PIX}, c AS (SELECT frame_id, v, count(*) AS c FROM px GROUP BY 1, 2) SELECT frame_id, {r6('log2(sum(c)) - sum(c * log2(c)) / sum(c)')} AS entropy FROM c GROUP BY 1")(lambda s, d: N.shannon_entropy(pix(s, d), "v", ["frame_id"]).select("frame_id", R(F.col("entropy")).alias("entropy")))
query("a13_sad", f"WITH {PIX} SELECT a.frame_id, sum(abs(a.v - b.v)) AS sad FROM px a JOIN px b ON b.frame_id = a.frame_id - 1 AND a.row = b.row AND a.col = b.col GROUP BY 1")(
    lambda s, d: (lambda f: f.join(f.select((F.col("frame_id") + 1).alias("frame_id"), F.col("pixels").alias("p")), "frame_id").select("frame_id", X.sad("pixels", "p").alias("sad")))(frames(s, d)))
query("a14_block_variance", f"WITH {VAR} SELECT frame_id, CAST(by AS INTEGER) AS by, CAST(bx AS INTEGER) AS bx, {r6('variance', '1e3')} AS variance FROM vb")(lambda s, d: V.block_variance(pix(s, d), 2).select("frame_id", "by", "bx", R(F.col("variance"), 1e3).alias("variance")))


def moving(s, d):
    b = V.block_variance(pix(s, d), 2)
    q = b.groupBy("frame_id").agg(F.percentile("variance", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return b.join(q, "frame_id").filter(F.col("variance") > F.col("q")[1] + F.lit(0.5) * (F.col("q")[1] - F.col("q")[0])).drop("q")


def points(s, d):
    return moving(s, d).select("frame_id", F.col("by").alias("y"), F.col("bx").alias("x"))


query("a4_moving_blocks", f"WITH {VAR}, q AS (SELECT frame_id, quantile_cont(variance, 0.25) AS a, quantile_cont(variance, 0.75) AS b FROM vb GROUP BY 1) SELECT frame_id, CAST(by AS INTEGER) AS by, CAST(bx AS INTEGER) AS bx FROM vb JOIN q USING (frame_id) WHERE variance > b + 1.5::DOUBLE * (b - a)")(
    lambda s, d: V.moving_blocks(V.block_variance(pix(s, d), 2)).select("frame_id", "by", "bx"))
query("a15_coordinate_union", f"WITH {MOV} SELECT by, bx, count(DISTINCT frame_id) AS n FROM (SELECT CAST(by AS INTEGER) AS by, CAST(bx AS INTEGER) AS bx, frame_id FROM mv) GROUP BY 1, 2")(lambda s, d: moving(s, d).groupBy("by", "bx").agg(F.countDistinct("frame_id").alias("n")))
NB = MOV + ", nb AS (SELECT a.frame_id, a.by AS y, a.bx AS x, count(*) AS n FROM mv a JOIN mv b ON a.frame_id = b.frame_id AND abs(a.by - b.by) <= 1 AND abs(a.bx - b.bx) <= 1 AND (a.by <> b.by OR a.bx <> b.bx) GROUP BY 1, 2, 3)"
query("a17_neighbours", f"WITH {NB} SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, n FROM nb")(lambda s, d: V.with_neighbours(points(s, d)))
query("a16_bounding_cells", f"WITH {NB}, bb AS (SELECT frame_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM nb GROUP BY 1), ys AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM bb) SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT frame_id, y, unnest(range(x0, x1 + 1)) AS x FROM ys)")(lambda s, d: V.bounding_cells(points(s, d)))
query("a18_argmin", f"WITH {PIX} SELECT frame_id, arg_min(row * 8 + col, v * 100 + row * 8 + col) AS place FROM px GROUP BY 1")(lambda s, d: frames(s, d).select("frame_id", (F.array_position("pixels", F.array_min("pixels")) - 1).cast("int").alias("place")))
query("w23_frame_differences", f"WITH {PIX} SELECT a.frame_id, a.row * 8 + a.col AS i, b.v - a.v AS v FROM px a JOIN px b ON b.frame_id = a.frame_id - 1 AND a.row = b.row AND a.col = b.col")(
    lambda s, d: V.frame_differences(frames(s, d)).select("frame_id", F.posexplode("pixels").alias("i", "v")))
query("w24_reconstruct", f"WITH {PIX} SELECT frame_id, row * 8 + col AS i, v FROM px")(
    lambda s, d: (lambda f: V.reconstruct(f.join(f.agg(F.min("frame_id").alias("frame_id")), "frame_id"), V.frame_differences(f)).select("frame_id", "i", "v"))(frames(s, d)))
RUNS = PIX.replace("pixels[i] AS v", "CAST(floor(pixels[i] / 50) AS DOUBLE) AS v") + """, rn AS (SELECT frame_id, row * 8 + col AS i, v, CASE WHEN v = lag(v) OVER (PARTITION BY frame_id ORDER BY row, col) THEN 0 ELSE 1 END AS b FROM px),
rg AS (SELECT *, sum(b) OVER (PARTITION BY frame_id ORDER BY i) AS g FROM rn), rr AS (SELECT frame_id, g, any_value(v) AS v, count(*) AS c FROM rg GROUP BY 1, 2)"""
coarse = lambda s, d: frames(s, d).withColumn("pixels", F.transform("pixels", lambda x: F.floor(x / F.lit(50.0)).cast("double")))
query("w25_rle_encode", f"WITH {RUNS} SELECT frame_id, string_agg(CAST(v AS VARCHAR) || '!' || c, ' ' ORDER BY g) AS tokens FROM rr GROUP BY 1")(lambda s, d: coarse(s, d).select("frame_id", F.array_join(X.rle_encode("pixels"), " ").alias("tokens")))
query("f8_rle_decode", f"WITH {PIX} SELECT frame_id, row * 8 + col AS i, CAST(floor(v / 50) AS DOUBLE) AS v FROM px")(lambda s, d: coarse(s, d).select("frame_id", F.posexplode(X.rle_decode(X.rle_encode("pixels"))).alias("i", "v")))
query("f6_greyscale", f"WITH {FR} SELECT frame_id, {r6('CAST(0.2989 AS DOUBLE) * pixels[1] + CAST(0.587 AS DOUBLE) * pixels[2] + CAST(0.114 AS DOUBLE) * pixels[3]')} AS grey FROM fr")(lambda s, d: frames(s, d).select("frame_id", R(X.greyscale(F.col("pixels")[0], F.col("pixels")[1], F.col("pixels")[2])).alias("grey")))
query("f7_quantize", f"WITH {PIX} SELECT frame_id, row * 8 + col AS i, round_even(round_even(v / 10, 2) * 10, 2) AS v FROM px")(lambda s, d: frames(s, d).select("frame_id", F.posexplode(X.quantize("pixels", 10)).alias("i", "v")))
query("f9_video_codec")(lambda s, d: V.video_decode(V.video_encode(frames(s, d))).select("frame_id", "i", R(F.col("v")).alias("v")))
@query("f10_macroblocks", f"""WITH {PIX}, c AS (SELECT frame_id, by, bx, k FROM (SELECT DISTINCT frame_id FROM px), (SELECT unnest(range(0, 3)) AS by), (SELECT unnest(range(0, 3)) AS bx), (SELECT unnest(range(0, 9)) AS k))
SELECT c.frame_id, CAST(by AS INTEGER) AS by, CAST(bx AS INTEGER) AS bx, CAST(k AS INTEGER) AS k, coalesce(v, 0) AS v FROM c LEFT JOIN px ON px.frame_id = c.frame_id AND px.row = by * 3 + k // 3 AND px.col = bx * 3 + k % 3""")
def f10_macroblocks(s, d):
    """Blocks of 3 x 3 of 8 x 8 images, the last ones padded with zeros, pixel by pixel."""
    return V.macroblocks(pix(s, d), 3).select("frame_id", "by", "bx", F.posexplode("block").alias("k", "v"))


query("f11_unblock", f"WITH {PIX} SELECT frame_id, row, col, v FROM px")(lambda s, d: V.unblock(V.macroblocks(pix(s, d), 4), 4))


def targets(s, d):
    """Blocks of the next frame's pixels, under the number of the frame they are looked for in."""
    b = V.macroblocks(pix(s, d), 2)
    return b.select((F.col("frame_id") - 1).alias("frame_id"), (F.col("by") * 2).alias("y"), (F.col("bx") * 2).alias("x"), "block")


query("f13_neighbourhood_sad", f"""WITH {PIX}, t AS (SELECT frame_id - 1 AS frame_id, row // 2 * 2 AS y, col // 2 * 2 AS x, row % 2 AS r, col % 2 AS c, v FROM px),
o AS (SELECT a.dy, b.dx FROM (VALUES (-2), (0), (2)) a(dy), (VALUES (-2), (0), (2)) b(dx))
SELECT t.frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, dy, dx, sum(abs(p.v - t.v)) AS sad FROM t, o JOIN px p ON p.frame_id = t.frame_id AND p.row = y + dy + r AND p.col = x + dx + c WHERE y + dy + 2 < 8 AND x + dx + 2 < 8 AND y + dy >= 0 AND x + dx >= 0 GROUP BY 1, 2, 3, 4, 5""")(
    lambda s, d: V.neighbourhood_sad(frames(s, d), targets(s, d), 2, 2, 8, 8).filter("sad IS NOT NULL"))


@query("f12_neighbourhood", f"""WITH {PIX}, t AS (SELECT DISTINCT frame_id - 1 AS frame_id, row // 2 * 2 AS y, col // 2 * 2 AS x FROM px), o AS (SELECT a.dy, b.dx FROM (VALUES (-2), (0), (2)) a(dy), (VALUES (-2), (0), (2)) b(dx))
SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, dy, dx, CAST(y + dy + 2 < 8 AND x + dx + 2 < 8 AND y + dy >= 0 AND x + dx >= 0 AS INTEGER) AS inside FROM t, o""")
def f12_neighbourhood(s, d):
    return V.neighbourhood(targets(s, d), 2, 2, 8, 8).select("frame_id", "y", "x", "dy", "dx", F.col("inside").cast("int").alias("inside"))


# The search in SQL: a row per block and round, until its step is 0. Ties go to the first candidate, row by row.
SEARCH = f"""{PIX}, t AS (SELECT frame_id - 1 AS frame_id, row // 2 * 2 AS y, col // 2 * 2 AS x, row % 2 AS r, col % 2 AS c, v FROM px), tb AS (SELECT frame_id, y, x FROM t WHERE frame_id IN (SELECT frame_id FROM px) GROUP BY ALL),
cost AS (SELECT t.frame_id, t.y, t.x, g.yy, g.xx, sum(abs(p.v - t.v)) AS sad FROM t, (SELECT a.yy, b.xx FROM (SELECT unnest(range(0, 6)) AS yy) a, (SELECT unnest(range(0, 6)) AS xx) b) g JOIN px p ON p.frame_id = t.frame_id AND p.row = g.yy + t.r AND p.col = g.xx + t.c GROUP BY 1, 2, 3, 4, 5),
walk(frame_id, y, x, cy, cx, step) AS (SELECT frame_id, y, x, y, x, CAST(2 AS BIGINT) FROM tb UNION ALL
 SELECT frame_id, y, x, coalesce(b.yy, cy), coalesce(b.xx, cx), CASE WHEN b.yy IS NULL OR b.yy = cy AND b.xx = cx THEN step // 2 ELSE step END FROM (
  SELECT w.frame_id, w.y, w.x, w.cy, w.cx, w.step, (SELECT arg_min({{'yy': k.yy, 'xx': k.xx}}, [k.sad, k.yy, k.xx]) FROM cost k WHERE k.frame_id = w.frame_id AND k.y = w.y AND k.x = w.x AND abs(k.yy - w.cy) IN (0, w.step) AND abs(k.xx - w.cx) IN (0, w.step)) AS b FROM walk w WHERE w.step > 0)),
found AS (SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(cy AS INTEGER) AS to_y, CAST(cx AS INTEGER) AS to_x FROM walk WHERE step = 0)"""


@query("f14_motion_search", f"WITH RECURSIVE {SEARCH} SELECT * FROM found")
def f14_motion_search(s, d):
    return V.motion_search(frames(s, d), targets(s, d), 2, 2, 8, 8)


@query("f15_motion_compensation", f"WITH RECURSIVE {SEARCH} SELECT to_y - y AS dy, to_x - x AS dx, count(*) AS n FROM found GROUP BY 1, 2")
def f15_motion_compensation(s, d):
    m = V.motion_search(frames(s, d), targets(s, d), 2, 2, 8, 8)
    return m.groupBy((F.col("to_y") - F.col("y")).alias("dy"), (F.col("to_x") - F.col("x")).alias("dx")).agg(F.count(F.lit(1)).alias("n"))


query("f16_swap_blocks", f"WITH {PIX} SELECT a.frame_id, a.row, a.col, CASE WHEN a.row < 4 AND a.col < 4 AND b.v IS NOT NULL THEN b.v ELSE a.v END AS v FROM px a LEFT JOIN px b ON b.frame_id = a.frame_id - 1 AND b.row = a.row AND b.col = a.col")(
    lambda s, d: (lambda b: V.unblock(V.swap_blocks(b, b.withColumn("frame_id", F.col("frame_id") + 1), b.filter("by = 0 AND bx = 0").select("frame_id", "by", "bx")), 4))(V.macroblocks(pix(s, d), 4)))
