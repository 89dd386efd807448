"""The registered queries as plain SQL over the same tables, written independently."""

from __future__ import annotations

from dwellgrid.plans import registry

_POINTS = """
e AS (
  SELECT event_id, user_id, event_type,
         date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS sec
  FROM events),
f AS (SELECT *, sec // 86400 AS day FROM e),
g AS (
  SELECT *, ((user_id % 5) * 4 + (user_id // 5 + day) % 8) % 20 AS place,
         (user_id % 10 = 9 AND day % 3 = 0) AS private
  FROM f),
pts AS MATERIALIZED (
  SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS uid,
         lpad(CAST(day // 10 AS VARCHAR), 2, '0') AS traj_id, event_id,
         CAST(row_number() OVER (PARTITION BY user_id, day // 10 ORDER BY sec, event_id) - 1 AS INT) AS seq,
         CAST((CASE WHEN private THEN 40100000 + 10000 * (user_id % 50)
                    ELSE 39900000 + 10000 * (place // 5) END)
              + 120 * ((user_id * 13) % 31 - 15) + 50 * (event_id % 13 - 6)
              + (CASE WHEN event_type = 'error' THEN 3000 * (1 + event_id % 7) ELSE 0 END)
              AS DOUBLE) / 1e6 AS lat,
         CAST((CASE WHEN private THEN 116600000 + 10000 * day
                    ELSE 116300000 + 12000 * (place % 5) END)
              + 50 * (event_id % 11 - 5) AS DOUBLE) / 1e6 AS lon,
         sec, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(sec) AS ts
  FROM g)
"""

_X = "6378137 * pi() + 6378137 * radians({0})"
_Y = "6378137 * pi() / 2 - 6378137 * pi() / 4.6 * 1.25 * ln(tan(pi() / 4 + 0.4 * radians({0})))"


def _metres(a: str, b: str) -> str:
    return (
        f"2 * 6378137 * asin(sqrt(least(1.0, pow(sin((radians({a}lat) - radians({b}lat)) / 2), 2)"
        f" + cos(radians({a}lat)) * cos(radians({b}lat))"
        f" * pow(sin((radians({a}lon) - radians({b}lon)) / 2), 2))))"
    )


def _whole_metres(a: str, b: str) -> str:
    return f"CAST(CAST(floor(({_metres(a, b)}) * 10000 + 0.5) AS BIGINT) // 10000 AS DOUBLE)"


def _stays(metres, reach: float, dwell: int) -> str:
    return f"""
ends AS MATERIALIZED (
  SELECT a.uid, a.traj_id, a.seq, a.n,
         coalesce(min(b.seq) FILTER (WHERE {metres('a.', 'b.')} > {reach}), a.n) AS stop
  FROM (SELECT *, count(*) OVER (PARTITION BY uid, traj_id) AS n FROM pts) a
  LEFT JOIN pts b ON a.uid = b.uid AND a.traj_id = b.traj_id AND b.seq > a.seq
  GROUP BY a.uid, a.traj_id, a.seq, a.n),
moves AS MATERIALIZED (
  SELECT w.uid, w.traj_id, w.seq, w.stop,
         w.stop - w.seq >= 2 AND z.sec - a.sec >= {dwell} AS stay
  FROM ends w
  JOIN pts a ON a.uid = w.uid AND a.traj_id = w.traj_id AND a.seq = w.seq
  JOIN pts z ON z.uid = w.uid AND z.traj_id = w.traj_id AND z.seq = w.stop - 1),
chain AS (
  SELECT uid, traj_id, seq FROM moves WHERE seq = 0
  UNION ALL
  SELECT m.uid, m.traj_id, CASE WHEN m.stay THEN m.stop ELSE m.seq + 1 END
  FROM chain c JOIN moves m USING (uid, traj_id, seq)),
found AS (SELECT m.* FROM chain JOIN moves m USING (uid, traj_id, seq) WHERE m.stay),
raw_stays AS (
  SELECT s.uid, s.traj_id, s.seq, avg(p.lat) AS lat, avg(p.lon) AS lon,
         min(p.ts) AS arrive, max(p.ts) AS leave, CAST(count(*) AS INT) AS n_points
  FROM found s JOIN pts p ON p.uid = s.uid AND p.traj_id = s.traj_id AND p.seq >= s.seq AND p.seq < s.stop
  GROUP BY s.uid, s.traj_id, s.seq),
stays AS MATERIALIZED (
  SELECT uid, traj_id,
         CAST(row_number() OVER (PARTITION BY uid, traj_id ORDER BY seq) - 1 AS INT) AS stay_seq,
         lat, lon, arrive, leave, n_points,
         (2 * CAST(round(lat * n_points * 1e6) AS BIGINT) + n_points) // (2 * n_points) AS mlat,
         (2 * CAST(round(lon * n_points * 1e6) AS BIGINT) + n_points) // (2 * n_points) AS mlon,
         {_X.format('lon')} AS x, {_Y.format('lat')} AS y,
         row_number() OVER (ORDER BY uid, traj_id, seq) AS k
  FROM raw_stays)
"""


_SLOW = "(CASE WHEN event_id % 11 = 0 THEN 7200 ELSE 0 END)"


def _bad_clock_points() -> str:
    """Points in their true order, with a clock that is slow at some events."""
    return _POINTS.replace(
        "sec, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(sec) AS ts",
        f"g.sec - {_SLOW} AS sec, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(g.sec - {_SLOW}) AS ts",
    ).replace("ORDER BY sec, event_id", "ORDER BY g.sec, event_id")


def _stays_with_jump(metres, reach: float, dwell: int) -> str:
    """Behind a window that is no stay: the next row near the row that closed it, or near the last row."""
    return (
        _stays(metres, reach, dwell)
        .replace("z.sec - a.sec", "abs(z.sec - a.sec)")
        .replace("SELECT w.uid, w.traj_id, w.seq, w.stop,", "SELECT w.uid, w.traj_id, w.seq, w.stop, w.n,")
        .replace(
            "chain AS (",
            "nexts AS MATERIALIZED (\n"
            f"  SELECT m.uid, m.traj_id, m.seq, coalesce(min(b.seq) FILTER (WHERE {metres('b.', 'c.')} <= {reach}), m.stop) AS nxt\n"
            "  FROM moves m JOIN pts c ON c.uid = m.uid AND c.traj_id = m.traj_id AND c.seq = least(m.stop, m.n - 1)\n"
            "  LEFT JOIN pts b ON b.uid = m.uid AND b.traj_id = m.traj_id AND b.seq > m.seq AND b.seq < m.stop\n"
            "  GROUP BY m.uid, m.traj_id, m.seq, m.stop),\nchain AS (",
        )
        .replace(
            "ELSE m.seq + 1 END\n  FROM chain c JOIN moves m USING (uid, traj_id, seq)",
            "ELSE x.nxt END\n  FROM chain c JOIN moves m USING (uid, traj_id, seq) JOIN nexts x USING (uid, traj_id, seq)",
        )
        .replace("min(p.ts) AS arrive, max(p.ts) AS leave", "arg_min(p.ts, p.seq) AS arrive, arg_max(p.ts, p.seq) AS leave")
    )


_LABELS = """
near AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b FROM stays a JOIN stays b
    ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 10000),
core AS MATERIALIZED (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= 4),
cedge AS MATERIALIZED (
  SELECT a, b FROM near WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
walk AS (
  SELECT k AS a, k AS b FROM core
  UNION
  SELECT w.a, c.b FROM walk w JOIN cedge c ON c.a = w.b),
heads AS MATERIALIZED (SELECT a AS k, min(b) AS head FROM walk GROUP BY a),
ids AS MATERIALIZED (SELECT k, CAST(dense_rank() OVER (ORDER BY head) AS INT) AS cid FROM heads),
edges_in AS (SELECT n.a AS k, min(i.cid) AS cid FROM near n JOIN ids i ON i.k = n.b GROUP BY n.a),
labelled AS MATERIALIZED (
  SELECT s.*, coalesce(i.cid, b.cid, 0) AS cluster_id,
         CASE WHEN i.cid IS NOT NULL THEN 'Core' WHEN b.cid IS NOT NULL THEN 'Border' ELSE 'Noise' END AS flag
  FROM stays s LEFT JOIN ids i ON i.k = s.k LEFT JOIN edges_in b ON b.k = s.k)
"""

_VISITS = """
visits AS MATERIALIZED (
  SELECT uid, traj_id,
         CAST(row_number() OVER (PARTITION BY uid, traj_id ORDER BY stay_seq) - 1 AS INT) AS visit_seq, cluster_id
  FROM (SELECT *, lag(cluster_id) OVER (PARTITION BY uid, traj_id ORDER BY stay_seq) AS prev FROM labelled)
  WHERE prev IS NULL OR prev <> cluster_id)
"""

_REGIONS = """
ur AS MATERIALIZED (
  SELECT uid, cluster_id, count(*) AS visits,
         CAST(row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, cluster_id) AS INT) AS rank
  FROM visits WHERE cluster_id <> 0 GROUP BY uid, cluster_id)
"""

_SIMILAR = """
pairs AS MATERIALIZED (
  SELECT a.uid, b.uid AS other_uid, count(*) AS support
  FROM ur a JOIN ur b ON a.cluster_id = b.cluster_id AND a.uid < b.uid
  GROUP BY a.uid, b.uid HAVING count(*) >= 3),
sim AS MATERIALIZED (
  SELECT uid, other_uid, support FROM pairs
  UNION ALL SELECT other_uid, uid, support FROM pairs)
"""


def _recommended(known: str) -> str:
    return f"""
offers AS (
  SELECT s.uid, s.other_uid, r.cluster_id, r.rank - 1 AS round
  FROM sim s JOIN ur r ON r.uid = s.other_uid
  WHERE NOT EXISTS (SELECT 1 FROM ur o WHERE o.uid = s.uid AND o.cluster_id = r.cluster_id {known})),
firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY uid, cluster_id ORDER BY round, other_uid) AS nth FROM offers)
  WHERE nth = 1),
placed AS (
  SELECT *, dense_rank() OVER (PARTITION BY uid ORDER BY round) - 1 AS wave,
         CAST(row_number() OVER (PARTITION BY uid ORDER BY round, other_uid) AS INT) AS position
  FROM firsts),
picked AS MATERIALIZED (SELECT uid, position, cluster_id FROM placed WHERE wave = round AND position <= 6)
"""


_ONE_PART = "CAST(0 AS INT) AS part"

_RECOMMEND_LINES = """
SELECT s.uid, coalesce(string_agg(CAST(p.cluster_id AS VARCHAR), ','
         ORDER BY length(CAST(p.cluster_id AS VARCHAR)), CAST(p.cluster_id AS VARCHAR)), 'NO RECOMMENDATION') AS line
FROM (SELECT DISTINCT uid FROM sim) s LEFT JOIN picked p USING (uid) GROUP BY s.uid
"""

_COLUMNS = "uid, traj_id, stay_seq, mlat / 1e6 AS lat, mlon / 1e6 AS lon, arrive, leave, n_points"


def _with(parts: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


def oracle_statements() -> dict[str, str]:
    x1, y1, x2, y2 = registry.RECT
    m = registry.RECT_MARGIN
    side = registry.CELL_SIDE
    points = [_POINTS]
    plane = [_POINTS, f"xy AS (SELECT event_id, {_X.format('lon')} AS x, {_Y.format('lat')} AS y FROM pts)"]
    cells = [
        *plane,
        f"cells AS (SELECT CAST(floor(x / {side}) AS BIGINT) AS cx, CAST(floor(y / {side}) AS BIGINT) AS cy,"
        " count(*) AS n_points FROM xy GROUP BY 1, 2)",
    ]
    nations = "rects AS (" + registry.NATION_RECTS.format(nation="nation") + ")"
    stays = [_POINTS, _stays(_whole_metres, 200, 1200)]
    near_only = [*stays, _LABELS]
    labels = near_only
    visits = [*labels, _VISITS]
    ur = [*visits, _REGIONS]
    sim = [*ur, _SIMILAR]
    picked = [*sim, _recommended("")]
    compat = [*sim, _recommended("AND o.visits = r.visits")]
    users = "string_agg(uid, ',' ORDER BY CAST(uid AS BIGINT))"
    return {
        "traj_points": _with(points, "SELECT uid, traj_id, seq, lat, lon, ts FROM pts"),
        "trajectory_text": _with(
            points,
            f"SELECT uid, traj_id, {_ONE_PART}, uid || chr(9) || string_agg(CAST(lat AS VARCHAR) || ',' ||"
            " CAST(lon AS VARCHAR) || ',' || strftime(ts, '%Y-%m-%d %H:%M:%S'), '->' ORDER BY seq) AS line"
            " FROM pts GROUP BY uid, traj_id",
        ),
        "trajectory_text_parsed": _with(points, "SELECT uid, traj_id, seq, lat, lon, ts FROM pts"),
        "track_lines_parsed": _with(points, "SELECT uid, traj_id, seq, lat, lon, ts FROM pts"),
        "stay_text_parsed": _with(
            stays, "SELECT mlat / 1e6 AS lat, mlon / 1e6 AS lon, count(*) AS n_stays FROM stays GROUP BY 1, 2"
        ),
        "labelled_text_parsed": _with(
            labels,
            "SELECT mlat / 1e6 AS lat, mlon / 1e6 AS lon, cluster_id, flag, count(*) AS n_lines"
            " FROM labelled GROUP BY 1, 2, 3, 4",
        ),
        "step_distance": _with(
            points,
            "SELECT p.uid, p.traj_id, p.seq, " + _whole_metres("q.", "p.") + " AS metres FROM pts p"
            " LEFT JOIN pts q ON q.uid = p.uid AND q.traj_id = p.traj_id AND q.seq = p.seq - 1",
        ),
        "dwell_gap_seconds": _with(
            points,
            "SELECT uid, traj_id, seq, coalesce(sec - lag(sec) OVER (PARTITION BY uid, traj_id ORDER BY seq), 0)"
            " AS seconds FROM pts",
        ),
        "miller_xy": _with(plane, "SELECT event_id, round(x, 3) AS x, round(y, 3) AS y FROM xy"),
        "points_in_rect": _with(
            plane,
            f"SELECT event_id, x >= {x1} AND x <= {x2} AND y >= {y1} AND y <= {y2} AS inside,"
            f" x > {x1} AND x < {x2} AND y > {y1} AND y < {y2} AS strictly_inside,"
            f" x > {x1 + m} AND x < {x2 - m} AND y > {y1 + m} AND y < {y2 - m} AS inside_inset FROM xy"
            f" WHERE x BETWEEN {x1 - m} AND {x2 + m} AND y BETWEEN {y1 - m} AND {y2 + m}",
        ),
        "cell_histogram": _with(cells, "SELECT cx, cy, n_points FROM cells"),
        "bounding_box": _with(
            cells,
            f"SELECT min(cx) * {side} AS x, min(cy) * {side} AS y, (max(cx) + 1) * {side} AS x2,"
            f" (max(cy) + 1) * {side} AS y2 FROM cells",
        ),
        "rect_count": _with(
            cells,
            "SELECT CAST(coalesce(sum(n_points), 0) AS BIGINT) AS n_points FROM cells"
            f" WHERE cx * {side} >= {x1} AND (cx + 1) * {side} <= {x2}"
            f" AND cy * {side} >= {y1} AND (cy + 1) * {side} <= {y2}",
        ),
        "points_in_rects": _with(
            [*plane, nations],
            "SELECT r.rect_id, xy.event_id FROM xy JOIN rects r"
            " ON xy.x BETWEEN r.x AND r.x2 AND xy.y BETWEEN r.y AND r.y2",
        ),
        "rect_counts": _with(
            [*cells, nations],
            "SELECT r.rect_id, CAST(coalesce(sum(c.n_points), 0) AS BIGINT) AS n_points FROM rects r LEFT JOIN cells c"
            f" ON c.cx * {side} >= r.x AND (c.cx + 1) * {side} <= r.x2"
            f" AND c.cy * {side} >= r.y AND (c.cy + 1) * {side} <= r.y2 GROUP BY r.rect_id",
        ),
        "points_file_plan": _with(
            [
                *points,
                "trips AS (SELECT uid, traj_id, CAST(sum(strlen(CAST(lat AS VARCHAR) || ',' || CAST(lon AS VARCHAR) || ',' ||"
                " strftime(ts, '%Y-%m-%d %H:%M:%S')) + 2) + any_value(strlen(uid)) AS BIGINT) AS n_bytes"
                " FROM pts GROUP BY uid, traj_id)",
                "placed AS (SELECT *, sum(n_bytes) OVER (ORDER BY uid, traj_id) - n_bytes AS start,"
                " sum(n_bytes) OVER (PARTITION BY uid) AS user_bytes FROM trips)",
                "filed AS (SELECT uid, n_bytes, CASE WHEN user_bytes <= 16384 THEN min(start) OVER (PARTITION BY uid)"
                " ELSE start END // 16384 AS file_no FROM placed)",
            ],
            "SELECT uid, CAST(file_no AS INT) AS file_no, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM filed GROUP BY uid, file_no",
        ),
        "stay_points_sql": _with(stays, f"SELECT {_COLUMNS} FROM stays"),
        "stay_points": _with(stays, f"SELECT {_COLUMNS} FROM stays"),
        "stay_points_in_pieces": _with(stays, f"SELECT {_COLUMNS} FROM stays"),
        **dict.fromkeys(
            ("stay_points_bad_clock", "stay_points_bad_clock_in_pieces"),
            _with(
                [_bad_clock_points(), _stays_with_jump(_whole_metres, 200, 1200)], f"SELECT {_COLUMNS} FROM stays"
            ),
        ),
        "stay_points_exact": _with(
            [_POINTS, _stays(_metres, 350.5, 7200)], f"SELECT {_COLUMNS} FROM stays"
        ),
        "stay_points_text": _with(
            stays,
            f"SELECT uid, traj_id, {_ONE_PART}, uid || chr(9) || string_agg(CAST(mlat / 1e6 AS VARCHAR) || ',' ||"
            " CAST(mlon / 1e6 AS VARCHAR) || ',' || strftime(arrive, '%Y-%m-%d %H:%M:%S') || ',' ||"
            " strftime(leave, '%Y-%m-%d %H:%M:%S'), '->' ORDER BY stay_seq) AS line"
            " FROM stays GROUP BY uid, traj_id",
        ),
        "eps_neighbour_counts": _with(
            near_only,
            "SELECT s.uid, s.traj_id, s.stay_seq, count(*) AS n_neighbours"
            " FROM stays s JOIN near n ON n.a = s.k GROUP BY s.uid, s.traj_id, s.stay_seq",
        ),
        "core_points": _with(
            near_only, "SELECT uid, traj_id, stay_seq FROM stays WHERE k IN (SELECT k FROM core)"
        ),
        "dbscan_labels": _with(
            labels,
            "SELECT uid, traj_id, stay_seq, round(x, 3) AS x, round(y, 3) AS y, cluster_id, flag FROM labelled",
        ),
        "cluster_summary": _with(
            labels,
            "SELECT cluster_id, count(*) AS n_stays, count(*) FILTER (WHERE flag = 'Core') AS n_core,"
            " count(*) FILTER (WHERE flag = 'Border') AS n_border, avg(mlat) AS lat, avg(mlon) AS lon"
            " FROM labelled GROUP BY cluster_id",
        ),
        "labelled_text": _with(
            labels,
            "SELECT '(' || CAST(mlat / 1e6 AS VARCHAR) || ',' || CAST(mlon / 1e6 AS VARCHAR) || ')' || chr(9) ||"
            " CAST(cluster_id AS VARCHAR) || ',' || flag AS line, count(*) AS n_lines FROM labelled GROUP BY 1",
        ),
        "cluster_markers": _with(
            labels,
            "SELECT '{\"position\":[' || CAST(mlon / 1e6 AS VARCHAR) || ',' || CAST(mlat / 1e6 AS VARCHAR) || ']}'"
            f" AS marker, count(*) AS n_markers FROM labelled WHERE cluster_id = {registry.MARKER_CLUSTER}"
            " GROUP BY 1",
        ),
        "location_visits": _with(visits, "SELECT uid, traj_id, visit_seq, cluster_id FROM visits"),
        "location_visits_by_coordinate": _with(
            visits, "SELECT uid, traj_id, visit_seq, cluster_id FROM visits"
        ),
        "location_text": _with(
            visits,
            f"SELECT uid, traj_id, {_ONE_PART}, uid || chr(9) ||"
            " string_agg(CAST(cluster_id AS VARCHAR), '->' ORDER BY visit_seq) AS line"
            " FROM visits GROUP BY uid, traj_id",
        ),
        "co_presence": _with(
            [
                *labels,
                "moments AS (SELECT cluster_id, at_ts, sum(step) AS step FROM"
                " (SELECT cluster_id, arrive AS at_ts, 1 AS step FROM labelled WHERE cluster_id <> 0 AND arrive < leave"
                " UNION ALL SELECT cluster_id, leave, -1 FROM labelled WHERE cluster_id <> 0 AND arrive < leave)"
                " GROUP BY cluster_id, at_ts HAVING sum(step) <> 0)",
                "periods AS (SELECT cluster_id, at_ts AS begins, lead(at_ts) OVER w AS ends,"
                " CAST(sum(step) OVER w AS BIGINT) AS n_stays FROM moments WINDOW w AS (PARTITION BY cluster_id ORDER BY at_ts))",
            ],
            "SELECT cluster_id, begins, ends, n_stays FROM periods WHERE n_stays >= 1",
        ),
        "region_at": _with(
            labels,
            "SELECT p.event_id, l.cluster_id FROM pts p ASOF LEFT JOIN labelled l ON l.uid = p.uid AND l.arrive <= p.ts",
        ),
        "user_region_ranked": _with(ur, "SELECT uid, cluster_id, visits, rank FROM ur"),
        "user_region_text": _with(
            ur,
            f"SELECT uid, {_ONE_PART}, string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY rank) AS line"
            " FROM ur GROUP BY uid",
        ),
        "region_user_text": _with(
            ur, f"SELECT cluster_id, {_ONE_PART}, {users} AS line FROM ur GROUP BY cluster_id"
        ),
        "transaction_counts": _with(
            ur,
            f"SELECT min(cluster_id) AS set_id, {_ONE_PART}, users, count(*) AS freq FROM"
            f" (SELECT cluster_id, {users} AS users FROM ur GROUP BY cluster_id) GROUP BY users",
        ),
        "frequent_items": _with(
            ur, "SELECT uid, count(*) AS freq FROM ur GROUP BY uid HAVING count(*) >= 3"
        ),
        "frequent_pairs": _with(sim, "SELECT uid, other_uid, support FROM pairs"),
        "frequent_triples": _with(
            ur,
            "SELECT a.uid || ',' || b.uid || ',' || c.uid AS items, count(*) AS freq FROM ur a"
            " JOIN ur b ON a.cluster_id = b.cluster_id AND a.uid < b.uid"
            " JOIN ur c ON a.cluster_id = c.cluster_id AND b.uid < c.uid"
            " GROUP BY a.uid, b.uid, c.uid HAVING count(*) >= 3",
        ),
        "frequent_maximal_sets": _with(
            [
                *ur,
                # Every largest set is the users of some three regions.
                "shared AS MATERIALIZED (SELECT DISTINCT list_sort(list(a.uid)) AS users FROM ur a"
                " JOIN ur b ON b.uid = a.uid AND b.cluster_id > a.cluster_id"
                " JOIN ur c ON c.uid = a.uid AND c.cluster_id > b.cluster_id"
                " GROUP BY a.cluster_id, b.cluster_id, c.cluster_id)",
                "largest AS MATERIALIZED (SELECT users FROM shared s WHERE NOT EXISTS (SELECT 1 FROM shared o"
                " WHERE len(o.users) > len(s.users) AND list_has_all(o.users, s.users)))",
                "known AS MATERIALIZED (SELECT cluster_id, list(uid) AS visitors FROM ur GROUP BY cluster_id)",
            ],
            "SELECT array_to_string(users, ',') AS items, count(*) AS freq FROM largest"
            " JOIN known ON list_has_all(visitors, users) GROUP BY users",
        ),
        "users_within_hops": _with(
            [
                *sim,
                "starts AS (SELECT DISTINCT min(uid) AS uid FROM ur GROUP BY cluster_id)",
                "hopped AS (SELECT uid, uid AS reached, 0 AS hops FROM starts"
                " UNION SELECT w.uid, s.other_uid, w.hops + 1 FROM hopped w JOIN sim s ON s.uid = w.reached WHERE w.hops < 6)",
            ],
            "SELECT uid, reached, CAST(min(hops) AS INT) AS hops FROM hopped WHERE reached <> uid GROUP BY uid, reached",
        ),
        "similar_users": _with(sim, "SELECT uid, other_uid, support FROM sim"),
        "similar_users_text": _with(
            sim,
            f"SELECT uid, {_ONE_PART}, string_agg(other_uid, ',' ORDER BY other_uid) AS line FROM sim GROUP BY uid",
        ),
        "connected_components": _with(
            [
                *sim,
                "reach AS (SELECT uid AS node, uid AS other FROM sim UNION"
                " SELECT r.node, s.other_uid FROM reach r JOIN sim s ON s.uid = r.other)",
            ],
            "SELECT node, min(other) AS root FROM reach GROUP BY node",
        ),
        "recommend_regions": _with(picked, "SELECT uid, position, cluster_id FROM picked"),
        "recommend_regions_compat": _with(compat, "SELECT uid, position, cluster_id FROM picked"),
        "recommend_text": _with(picked, _RECOMMEND_LINES),
        "recommend_text_compat": _with(compat, _RECOMMEND_LINES),
    }
