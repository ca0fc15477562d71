"""The fixture layers as DuckDB common table expressions, from which the queries' SQL is put together."""

BITS = lambda shift: " + ".join(f"((s >> {2 * i + shift}) & 1) * {1 << i}" for i in range(7))
XY = "CAST((pid % 5) * 3200 AS DOUBLE) AS px, CAST((pid // 5) * 3200 AS DOUBLE) AS py"

LAYERS = f"""
WITH RECURSIVE q AS (SELECT CAST(n_nationkey AS BIGINT) AS pid, 'PART_' || n_nationkey AS part FROM nation),
p AS (SELECT pid, part, px AS xmin, py AS ymin, px + 3200 AS xmax, py + 3200 AS ymax FROM (SELECT *, {XY} FROM q)),
o1 AS (SELECT CAST(o_orderkey AS BIGINT) AS fid, CAST(o_orderkey % 25 AS BIGINT) AS pid, CAST(o_orderkey // 25 AS BIGINT) AS s, o_orderpriority AS pr FROM orders),
o2 AS (SELECT *, {BITS(0)} AS cx, {BITS(1)} AS cy, CASE WHEN fid % 11 = 0 THEN 5 ELSE 8 + (fid * 7) % 13 END AS side, {XY} FROM o1),
b AS (SELECT fid, pid, 'PART_' || pid AS part,
             CASE left(pr, 1) WHEN '1' THEN '31001_1000' WHEN '2' THEN '31001_1010' WHEN '3' THEN '31001_2000' WHEN '4' THEN '31001_2721' ELSE '0' END AS fkt,
             px + cx * 25 + 2 AS xmin, py + cy * 25 + 2 AS ymin, px + cx * 25 + 2 + side AS xmax, py + cy * 25 + 2 + side AS ymax, CAST(side * side AS DOUBLE) AS area
      FROM o2 WHERE (fid * 31) % 100 >= 10 + 15 * ((pid + 3 * (cx // 8) + 5 * (cy // 8)) % 5)),
bl AS (SELECT pid * 256 + i AS block_id, pid, part, px + (i // 16) * 200 AS xmin, py + (i % 16) * 200 AS ymin, px + (i // 16) * 200 + 200 AS xmax, py + (i % 16) * 200 + 200 AS ymax
       FROM (SELECT *, {XY} FROM q), range(0, 256) t(i)),
st AS (SELECT pid, part, i, px, py FROM (SELECT *, {XY} FROM q), range(0, 17) t(i)),
r AS (SELECT pid * 100 + i AS fid, pid, part, px + i * 200 AS x1, py AS y1, px + i * 200 AS x2, py + 3200 AS y2 FROM st
      UNION ALL SELECT pid * 100 + 20 + i, pid, part, px, py + i * 200, px + 3200, py + i * 200 FROM st
      UNION ALL SELECT pid * 100 + 40 + i, pid, part, px + i * 200 + 100, py + i * 200, px + i * 200 + 107, py + i * 200 + 30 FROM st WHERE i % 2 = 1 AND i < 16),
ax AS (SELECT pid * 100 + 90 AS fid, pid, part, px AS x1, py + 1650 AS y1, px + 3200 AS x2, py + 1650 AS y2 FROM (SELECT *, {XY} FROM q))
"""
#: Four corners of each building (those after the first vertex of its ring), and edges in ring order.
CORNERS = """,
c AS (SELECT fid, pid, CAST(n AS BIGINT) AS seq, CASE WHEN n IN (1, 2) THEN xmax ELSE xmin END AS x, CASE WHEN n IN (2, 3) THEN ymax ELSE ymin END AS y FROM b, range(1, 5) t(n))
"""
EDGES = """,
e AS (SELECT fid, pid, CAST(n AS BIGINT) AS edge_no, CASE WHEN n IN (0, 3) THEN xmin ELSE xmax END AS x1, CASE WHEN n IN (0, 1) THEN ymin ELSE ymax END AS y1,
             CASE WHEN n IN (0, 1) THEN xmax ELSE xmin END AS x2, CASE WHEN n IN (1, 2) THEN ymax ELSE ymin END AS y2, CASE WHEN n IN (0, 2) THEN xmax - xmin ELSE ymax - ymin END AS length,
             CASE n WHEN 0 THEN 180.0::DOUBLE WHEN 1 THEN 90.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 90.0::DOUBLE END AS angle FROM b, range(0, 4) t(n))
"""
#: The nearest street of each corner: brute force over the partition's streets.
NEAREST = (
    CORNERS
    + """,
n0 AS (SELECT c.fid, c.pid, c.seq, c.x, c.y, r.fid AS road_id, r.x1 AS ax, r.y1 AS ay, r.x2 - r.x1 AS dx, r.y2 - r.y1 AS dy FROM c JOIN r ON c.pid = r.pid),
n1 AS (SELECT *, least(greatest(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0), 1) AS t FROM n0),
n2 AS (SELECT *, ax + t * dx AS fx, ay + t * dy AS fy FROM n1),
n3 AS (SELECT *, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS distance FROM n2),
sl AS (SELECT fid, pid, seq, x AS x1, y AS y1, fx AS x2, fy AS y2, distance, road_id, CASE WHEN a < 0 THEN a + 360 ELSE a END AS angle
       FROM (SELECT *, degrees(atan2(fy - y, fx - x)) AS a FROM n3 QUALIFY row_number() OVER (PARTITION BY fid, seq ORDER BY distance, road_id) = 1))
"""
)
