"""Queries over groups that move together."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import areas as A
from ..operators import partitioning as P
from ..operators import patterns as G
from ..sources.shared import written
from .views import AIS1, FRAME_S, FRAMES, GROUPS, PAIR_M, PAIRS, ais1, frames_at, groups_at, query, r6

FRAME_SPEC_COLUMN = "frame"


def pairs(s, d):
    return A.pairs_within(frames_at(s, d), PAIR_M, FRAME_SPEC_COLUMN)


def convoys(s, d, least=2):
    return G.frame_components(frames_at(s, d), PAIR_M, FRAME_SPEC_COLUMN, least)


def text(c: str = "clusters"):
    return F.array_join(c, ",").alias(c)


TEXT = "array_to_string(clusters, ',') AS clusters"
query("j1_pairs_within", f"WITH {PAIRS} SELECT frame, src, dst, {r6('metres', '1e4')} AS metres FROM pairs")(lambda s, d: pairs(s, d).select("frame", "src", "dst", (F.floor(F.col("metres") * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)).alias("metres")))
# Maximal cliques: cliques grow by larger common neighbours; those without any common neighbour are maximal.
CLIQUES = f"""{PAIRS}, ed AS (SELECT frame, src AS a, dst AS b FROM pairs UNION ALL SELECT frame, dst, src FROM pairs),
nb AS (SELECT frame, a, list_sort(list(b)) AS near, list_filter(list_sort(list(b)), lambda x: x > a) AS more FROM ed GROUP BY frame, a),
cl(frame, members, more, near) AS (SELECT frame, [a], more, near FROM nb UNION ALL
 SELECT c.frame, list_append(c.members, nb.a), list_intersect(c.more, nb.more), list_intersect(c.near, nb.near) FROM (SELECT *, unnest(more) AS u FROM cl) c JOIN nb ON nb.frame = c.frame AND nb.a = c.u)"""


@query("a6_cliques", f"WITH RECURSIVE {CLIQUES} SELECT frame, array_to_string(list_sort(members), ',') AS clusters FROM cl WHERE len(near) = 0 AND len(members) >= 2")
def a6_cliques(s, d):
    return G.frame_cliques(frames_at(s, d), PAIR_M, FRAME_SPEC_COLUMN).select("frame", text())


COMPONENTS = f"""{PAIRS}, ed AS (SELECT frame, src AS a, dst AS b FROM pairs UNION ALL SELECT frame, dst, src FROM pairs),
reach AS (SELECT DISTINCT frame, a, a AS m FROM ed UNION SELECT r.frame, e.b, r.m FROM reach r JOIN ed e ON e.frame = r.frame AND e.a = r.a),
lab AS (SELECT frame, a, min(m) AS m FROM reach GROUP BY frame, a), groups AS (SELECT frame, list_sort(list(a)) AS clusters FROM lab GROUP BY frame, m)"""


@query("a5_components", f"WITH RECURSIVE {COMPONENTS} SELECT frame, {TEXT} FROM groups")
def a5_components(s, d):
    return convoys(s, d).select("frame", text())


@query("a7_clusters_per_frame", f"WITH RECURSIVE {COMPONENTS} SELECT {TEXT}, frame AS st, frame AS et FROM groups WHERE len(clusters) >= 3")
def a7_clusters_per_frame(s, d):
    return G.numbered(convoys(s, d, 3)).select(text(), "st", "et")


# Present and past frames side by side: n numbers the frames, past groups are shifted by one.
SIDES = f"{GROUPS}, present AS (SELECT n, clusters, frame AS st, frame AS et FROM groups), past AS (SELECT n + 1 AS n, clusters, frame AS st, frame AS et FROM groups)"
SHARED = f"""{SIDES}, pm AS (SELECT *, unnest(clusters) AS m FROM present), am AS (SELECT *, unnest(clusters) AS m FROM past),
sh AS (SELECT pm.n, am.clusters AS a, am.st AS ast, am.et AS aet, pm.clusters AS b, pm.st AS bst, pm.et AS bet, list_sort(list(m)) AS common FROM pm JOIN am USING (n, m) GROUP BY pm.n, am.clusters, am.st, am.et, pm.clusters, pm.st, pm.et)"""


def sides(s, d):
    g = groups_at(s, d)
    now = g.select("n", "clusters", F.col("frame").alias("st"), F.col("frame").alias("et"))
    return now, now.withColumn("n", F.col("n") + 1)


query("j9_subset_of_past", f"WITH {SHARED}, x AS (SELECT n, b AS clusters, min(ast) AS s FROM sh WHERE len(common) = len(b) GROUP BY 1, 2) SELECT n, {TEXT}, least(st, coalesce(s, st)) AS st, et FROM present LEFT JOIN x USING (n, clusters)")(
    lambda s, d: G.subset_of_past(*sides(s, d), ["n"]).select("n", text(), "st", "et"))
query("j10_past_inside_present", f"WITH {SHARED}, x AS (SELECT n, a AS clusters, max(bet) AS e FROM sh WHERE len(common) = len(a) AND len(b) > len(a) GROUP BY 1, 2) SELECT n, {TEXT}, st, coalesce(e, et) AS et FROM past LEFT JOIN x USING (n, clusters) WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.n = past.n AND p.clusters = past.clusters)")(
    lambda s, d: G.past_inside_present(*sides(s, d), ["n"]).select("n", text(), "st", "et"))
LINKS = f"""{SHARED}, k AS (SELECT n, common AS clusters, ast AS st, bet AS et FROM sh WHERE len(common) >= 2), wh AS (SELECT DISTINCT n, b AS clusters FROM sh WHERE len(common) >= 2 AND len(common) = len(b)),
links AS (SELECT n, clusters, min(st) AS st, max(et) AS et FROM (SELECT * FROM k UNION ALL SELECT n, clusters, st, et FROM present ANTI JOIN wh USING (n, clusters)) GROUP BY n, clusters)"""
query("j11_intersection_links", f"WITH {LINKS} SELECT n, {TEXT}, st, et FROM links")(lambda s, d: G.intersection_links(*sides(s, d), 2, ["n"]).select("n", text(), "st", "et"))


@query("j8_translate", f"""WITH {FRAMES}, p AS (SELECT frame, mmsi, row_number() OVER (PARTITION BY frame ORDER BY mmsi DESC) - 1 AS pos FROM frames)
SELECT frame, pos % 7 AS cluster, array_to_string(list_sort(list(mmsi)), ',') AS clusters FROM p GROUP BY frame, pos % 7""")
def j8_translate(s, d):
    """Clusters of row positions (every seventh row of a frame) become clusters of ids."""
    rows = frames_at(s, d).withColumn("pos", (F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("mmsi"))) - 1).cast("long"))
    positions = rows.groupBy("frame", (F.col("pos") % 7).alias("cluster")).agg(F.collect_list("pos").alias("positions"))
    return G.translate(positions, rows.select("frame", "pos", F.col("mmsi").alias("id"))).select("frame", "cluster", text())


query("j13_pattern_velocity", f"WITH {AIS1}, {LINKS.replace(FRAMES.split(', frames AS')[0] + ', ', '')}, m AS (SELECT clusters, st, et, unnest(clusters) AS mmsi FROM (SELECT DISTINCT clusters, st, et FROM links WHERE et > st)) SELECT {TEXT}, m.st, m.et, {r6('avg(a.speed)')} AS mean_velocity, count(*) AS n_points FROM m JOIN ais1 a ON a.mmsi = m.mmsi AND a.ts BETWEEN m.st AND m.et GROUP BY m.clusters, m.st, m.et")(
    lambda s, d: G.pattern_velocity(G.intersection_links(*sides(s, d), 2, ["n"]).filter("et > st").select("clusters", "st", "et").distinct(), ais1(s, d).withColumnRenamed("speed", "velocity")).select(text(), "st", "et", (F.floor(F.col("mean_velocity") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).alias("mean_velocity"), "n_points"))
query("a8_merge_equal", f"WITH {GROUPS} SELECT {TEXT}, min(frame) AS st, max(frame) AS et FROM groups GROUP BY clusters")(lambda s, d: G.merge_equal(G.numbered(groups_at(s, d))).select(text(), "st", "et"))
query("p12_cardinality", f"WITH {GROUPS} SELECT frame, {TEXT} FROM groups WHERE len(clusters) >= 3")(lambda s, d: groups_at(s, d).filter(F.size("clusters") >= 3).select("frame", text()))
query("p13_duration", f"WITH {LINKS} SELECT n, {TEXT}, st, et FROM links WHERE et - st >= 60 * 360")(lambda s, d: G.long_enough(G.intersection_links(*sides(s, d), 2, ["n"]), 360).select("n", text(), "st", "et"))
query("p14_open_closed", f"WITH {LINKS} SELECT CASE WHEN et = (SELECT max(et) FROM links) THEN 1 ELSE 0 END AS is_open, count(*) AS n FROM links GROUP BY 1")(lambda s, d: _open_closed(s, d))


@query("u2_merge_patterns", f"WITH {LINKS} SELECT n, {TEXT}, min(st) AS st, max(et) AS et FROM (SELECT * FROM links UNION ALL SELECT n, clusters, st, et FROM past) GROUP BY n, clusters")
def u2_merge_patterns(s, d):
    new = G.intersection_links(*sides(s, d), 2, ["n"])
    return G.merge_equal(new.unionByName(sides(s, d)[1]), ["n"]).select("n", text(), "st", "et")


@query("u4_intersections", f"WITH {SHARED} SELECT n, array_to_string(a, ',') AS a, array_to_string(b, ',') AS b, array_to_string(common, ',') AS common FROM sh")
def u4_intersections(s, d):
    return G.shared_members(*sides(s, d), ["n"]).select("n", text("a"), text("b"), text("common"))


@query("u7_subsets", f"WITH {SHARED} SELECT n, array_to_string(a, ',') AS a, array_to_string(b, ',') AS b FROM sh WHERE len(common) = len(b)")
def u7_subsets(s, d):
    return G.shared_members(*sides(s, d), ["n"]).filter(F.size("common") == F.size("b")).select("n", text("a"), text("b"))


query("o2_partition_order", f"WITH {GROUPS} SELECT n // 30 AS part, min(frame) AS st FROM groups GROUP BY 1 ORDER BY st")(lambda s, d: groups_at(s, d).groupBy(F.floor(F.col("n") / 30).alias("part")).agg(F.min("frame").alias("st")).orderBy("st"))


def _open_closed(s, d):
    links = G.intersection_links(*sides(s, d), 2, ["n"])
    last = links.agg(F.max("et")).first()[0]
    open_, closed = G.split_open(links, last)
    return open_.select(F.lit(1).alias("is_open")).unionByName(closed.select(F.lit(0).alias("is_open"))).groupBy("is_open").agg(F.count(F.lit(1)).alias("n"))


def _mine(s, d, mode):
    f = frames_at(s, d)
    if mode == "convoys":
        return G.mine(convoys(s, d), f.select("frame"), 2, FRAME_S)
    f = written(f.select("mmsi", "frame", "lon", "lat"), "points")
    return G.mine_flocks(f, PAIR_M, written(G.companions(f, FRAME_SPEC_COLUMN), "members"), FRAME_SPEC_COLUMN, 2, FRAME_S)


def _groups_of_sites(s, d):
    """Objects of different sites never come near each other here."""
    return frames_at(s, d).select(F.col("mmsi").alias("object"), (F.col("mmsi") % 20).alias("grp")).distinct()


@query("g1_link_step", f"""WITH {LINKS} SELECT n, {TEXT}, st, et, 1 AS active FROM links
UNION ALL SELECT n, {TEXT}, st, et, 0 FROM past WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.n = past.n AND l.clusters = past.clusters) AND n IN (SELECT n FROM present)""")
def g1_link_step(s, d):
    """The link step's two results: patterns that go on, and past patterns that are none of them."""
    present, past = sides(s, d)
    active = G.intersection_links(present, past, 2, ["n"])
    ended = past.join(present.select("n").distinct(), "n", "left_semi").join(active.select("n", "clusters"), ["n", "clusters"], "left_anti")
    return active.withColumn("active", F.lit(1)).unionByName(ended.withColumn("active", F.lit(0))).select("n", text(), "st", "et", "active")


# Mining in SQL: `part` cuts time into pieces that are mined apart (one piece, or the four of P). An empty set keeps the recursion going over frames without groups.
MINED = f"""nf AS (SELECT frame, part, row_number() OVER (ORDER BY frame) AS n, min(frame) OVER (PARTITION BY part) AS lo FROM parts), present AS (SELECT n, part, clusters, frame FROM groups JOIN nf USING (frame)),
act(n, part, clusters, st, et) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
 SELECT n, part, clusters, min(st), max(et) FROM (
  SELECT p.n, p.part, list_sort(list_intersect(a.clusters, p.clusters)) AS clusters, a.st, p.frame AS et FROM act a JOIN present p ON p.n = a.n + 1 AND p.part = a.part WHERE len(list_intersect(a.clusters, p.clusters)) >= 2
  UNION ALL SELECT p.n, p.part, p.clusters, p.frame, p.frame FROM present p WHERE p.n = (SELECT max(n) + 1 FROM act) AND NOT EXISTS (SELECT 1 FROM act a WHERE a.part = p.part AND list_has_all(a.clusters, p.clusters))
  UNION ALL SELECT f.n, -1, CAST([] AS BIGINT[]), 0, 0 FROM nf f WHERE f.n = (SELECT max(n) + 1 FROM act)) GROUP BY n, part, clusters)"""
ENDED = "NOT EXISTS (SELECT 1 FROM act b WHERE b.n = a.n + 1 AND b.part = a.part AND b.clusters = a.clusters)"
ONE_PART = "parts AS (SELECT DISTINCT frame, 0 AS part FROM frames)"
FOUR_PARTS = "parts AS (SELECT DISTINCT frame, CAST(greatest(0, ceil(CAST(frame - lo AS DOUBLE) * 4 / CAST(hi - lo AS DOUBLE)) - 1) AS BIGINT) AS part FROM frames, (SELECT min(frame) AS lo, max(frame) AS hi FROM frames))"
FLOCKS = f"{CLIQUES}, groups AS (SELECT frame, list_sort(members) AS clusters FROM cl WHERE len(near) = 0 AND len(members) >= 2)"
WHOLE = f"SELECT {TEXT}, st, et FROM act a WHERE len(clusters) > 0 AND (n = (SELECT max(n) FROM nf) OR {ENDED} AND et - st >= {FRAME_S})"


@query("g2_mine_convoys", f"WITH RECURSIVE {COMPONENTS}, {ONE_PART}, {MINED} {WHOLE}")
def g2_mine_convoys(s, d):
    return _mine(s, d, "convoys").select(text(), "st", "et")


@query("g2_mine_flocks", f"WITH RECURSIVE {FLOCKS}, {ONE_PART}, {MINED} {WHOLE}")
def g2_mine_flocks(s, d):
    return _mine(s, d, "flocks").select(text(), "st", "et")


@query("g2_mine_by_group", f"WITH RECURSIVE {COMPONENTS}, {ONE_PART}, {MINED} {WHOLE}")
def g2_mine_by_group(s, d):
    return G.mine(convoys(s, d), frames_at(s, d).select("frame"), 2, FRAME_S, _groups_of_sites(s, d)).select(text(), "st", "et")


@query("g3_mine_partitions", f"""WITH RECURSIVE {COMPONENTS}, {FOUR_PARTS}, {MINED}, e AS (SELECT part, max(n) AS top, min(frame) AS lo FROM nf GROUP BY part)
SELECT part AS bin, {TEXT}, st, et FROM act a JOIN e USING (part) WHERE n = top OR {ENDED} AND (et - st >= {FRAME_S} OR st = lo)""")
def g3_mine_partitions(s, d):
    return _partitions(s, d).select("bin", text(), "st", "et")


# Partitions in time order: pt holds their patterns, dn what has been chained so far (all rows carry the last partition's number).
PT = f"""{COMPONENTS}, {FOUR_PARTS}, {MINED}, e AS (SELECT part, max(n) AS top, min(frame) AS lo FROM nf GROUP BY part),
mp AS (SELECT part, clusters, st, et FROM act a JOIN e USING (part) WHERE n = top OR {ENDED} AND (et - st >= {FRAME_S} OR st = lo)),
pt AS (SELECT dense_rank() OVER (ORDER BY part) AS k, clusters, st, et, min(st) OVER (PARTITION BY part) AS s0 FROM mp)"""
NEXT_TO = f"p.k = (SELECT max(k) + 1 FROM dn) AND p.s0 - (SELECT max(et) FROM dn) = {FRAME_S}"
LAST = "a.et = (SELECT max(et) FROM dn)"
FIRST = "SELECT k, clusters, st, et FROM pt WHERE k = 1"
REST = f"SELECT p.k, p.clusters, p.st, p.et FROM pt p WHERE p.k = (SELECT max(k) + 1 FROM dn) AND NOT (p.st = p.s0 AND {NEXT_TO})"
GOES_ON = "a.k < (SELECT max(k) FROM pt)"
CHAINED = f"""dn(k, clusters, st, et) AS ({FIRST} UNION ALL SELECT * FROM (
 SELECT a.k + 1, a.clusters, a.st, a.et FROM dn a WHERE {GOES_ON} AND NOT ({LAST} AND EXISTS (SELECT 1 FROM pt p WHERE {NEXT_TO} AND p.st = p.s0 AND list_has_all(p.clusters, a.clusters)))
 UNION ALL {REST}
 UNION ALL SELECT k, clusters, min(st), max(et) FROM (
  SELECT p.k, list_sort(list_intersect(a.clusters, p.clusters)) AS clusters, a.st, p.et FROM dn a JOIN pt p ON {NEXT_TO} AND p.st = p.s0 WHERE {LAST} AND len(list_intersect(a.clusters, p.clusters)) >= 2
  UNION ALL SELECT p.k, p.clusters, p.st, p.et FROM pt p WHERE {NEXT_TO} AND p.st = p.s0 AND NOT EXISTS (SELECT 1 FROM dn a WHERE {LAST} AND list_has_all(a.clusters, p.clusters))) GROUP BY k, clusters))"""


@query("g5_reduce_partitions", f"""WITH RECURSIVE {PT}, {CHAINED}, z AS (SELECT * FROM dn WHERE k = (SELECT max(k) FROM pt))
SELECT {TEXT}, st, et FROM z WHERE et = (SELECT max(et) FROM z) OR st = (SELECT min(st) FROM z) OR et - st >= {FRAME_S}""")
def g5_reduce_partitions(s, d):
    return G.reduce_partitions(_partitions(s, d), 2, FRAME_S, FRAME_S).select(text(), "st", "et")


@query("g4_merge_two_partitions", f"""WITH RECURSIVE {PT.replace(' * 4 / ', ' * 2 / ')}, {CHAINED}, z AS (SELECT * FROM dn WHERE k = (SELECT max(k) FROM pt))
SELECT {TEXT}, st, et FROM z WHERE et = (SELECT max(et) FROM z) OR st = (SELECT min(st) FROM z) OR et - st >= {FRAME_S}""")
def g4_merge_two_partitions(s, d):
    return G.reduce_partitions(_partitions(s, d, 2), 2, FRAME_S, FRAME_S).select(text(), "st", "et")


CONTAINED = f"""dn(k, clusters, st, et) AS ({FIRST} UNION ALL SELECT * FROM (
 SELECT a.k + 1, a.clusters, a.st, a.et FROM dn a WHERE {GOES_ON} AND NOT ({LAST} AND EXISTS (SELECT 1 FROM pt p WHERE {NEXT_TO}))
 UNION ALL {REST}
 UNION ALL SELECT k, clusters, st, et FROM (
  SELECT p.k, p.clusters, least(p.st, coalesce((SELECT min(a.st) FROM dn a WHERE {LAST} AND list_has_all(a.clusters, p.clusters)), p.st)) AS st, p.et FROM pt p WHERE {NEXT_TO} AND p.st = p.s0
  UNION ALL SELECT a.k + 1, a.clusters, a.st, greatest(a.et, coalesce((SELECT max(p.et) FROM pt p WHERE {NEXT_TO} AND p.st = p.s0 AND list_has_all(p.clusters, a.clusters) AND len(p.clusters) > len(a.clusters)), a.et)) FROM dn a
   WHERE {LAST} AND EXISTS (SELECT 1 FROM pt p WHERE {NEXT_TO}) AND NOT EXISTS (SELECT 1 FROM pt p WHERE {NEXT_TO} AND p.st = p.s0 AND p.clusters = a.clusters)) WHERE et - st >= {FRAME_S}))"""


@query("g8_reduce_by_containment", f"WITH RECURSIVE {PT}, {CONTAINED} SELECT {TEXT}, st, et FROM dn WHERE k = (SELECT max(k) FROM pt)")
def g8_reduce_by_containment(s, d):
    return G.reduce_by_containment(_partitions(s, d), FRAME_S, FRAME_S).select(text(), "st", "et")


HELD = f"""nf AS (SELECT frame, row_number() OVER (ORDER BY frame) AS n FROM (SELECT DISTINCT frame FROM groups)), present AS (SELECT n, clusters, frame FROM groups JOIN nf USING (frame)),
act(n, clusters, st, et) AS (SELECT n, clusters, frame, frame FROM present WHERE n = 1 UNION ALL
 SELECT n, clusters, min(st), max(et) FROM (
  SELECT p.n, p.clusters, p.frame AS st, p.frame AS et FROM present p WHERE p.n = (SELECT max(n) + 1 FROM act)
  UNION ALL SELECT p.n, p.clusters, a.st, p.frame FROM act a JOIN present p ON p.n = a.n + 1 WHERE list_has_all(a.clusters, p.clusters)
  UNION ALL SELECT p.n, a.clusters, a.st, p.frame FROM act a JOIN present p ON p.n = a.n + 1 WHERE list_has_all(p.clusters, a.clusters) AND len(p.clusters) > len(a.clusters)) GROUP BY n, clusters)"""


@query("g6_mine_by_containment", f"""WITH RECURSIVE {COMPONENTS}, {HELD} SELECT {TEXT}, st, et FROM act a WHERE n = (SELECT max(n) FROM nf)
OR NOT EXISTS (SELECT 1 FROM act b WHERE b.n = a.n + 1 AND b.clusters = a.clusters) AND et - st >= {FRAME_S}""")
def g6_mine_by_containment(s, d):
    return G.mine_by_containment(convoys(s, d), 2, FRAME_S).select(text(), "st", "et")


def _partitions(s, d, n=4):
    f = frames_at(s, d).select("frame").distinct()
    bins = P.time_bins(f, "frame", n).select("frame", F.col("bin").cast("long").alias("bin"))
    return G.mine_partition(convoys(s, d), bins, 2, FRAME_S)


query("velocity_of_frames", f"WITH {FRAMES} SELECT frame, {r6('avg(speed)')} AS mean_speed, count(*) AS n FROM frames GROUP BY frame")(lambda s, d: frames_at(s, d).groupBy("frame").agg((F.floor(F.avg("speed") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).alias("mean_speed"), F.count(F.lit(1)).alias("n")))
