"""Trajectories derived from the ``events`` table, which has users and times only.

Positions are whole micro-degrees divided by 1e6, so any engine gets the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dwellgrid.operators.numbering import number_in_groups

# Order of a user's events; event_id settles equal seconds.
EVENT_ORDER = ("sec", "event_id")

_PLACED = """
WITH timed AS (
  SELECT event_id, user_id, event_type,
         datediff(CAST(ts AS DATE), DATE'2024-01-01') * 86400L
           + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS sec
  FROM {events}
), located AS (
  SELECT *, sec DIV 86400 AS day,
         ((user_id % 5) * 4 + (user_id DIV 5 + sec DIV 86400) % 8) % 20 AS place,
         (user_id % 10 = 9 AND (sec DIV 86400) % 3 = 0) AS private
  FROM timed
)
SELECT lpad(CAST(user_id AS STRING), 5, '0') AS uid,
       lpad(CAST(day DIV 10 AS STRING), 2, '0') AS traj_id,
       event_id,
       CAST((CASE WHEN private THEN 40100000 + 10000 * (user_id % 50)
                  ELSE 39900000 + 10000 * (place DIV 5) END)
            + 120 * ((user_id * 13) % 31 - 15) + 50 * (event_id % 13 - 6)
            + (CASE WHEN event_type = 'error' THEN 3000 * (1 + event_id % 7) ELSE 0 END)
            AS DOUBLE) / 1e6 AS lat,
       CAST((CASE WHEN private THEN 116600000 + 10000 * day
                  ELSE 116300000 + 12000 * (place % 5) END)
            + 50 * (event_id % 11 - 5) AS DOUBLE) / 1e6 AS lon,
       sec,
       timestampadd(SECOND, sec, timestamp_ntz'2024-01-01 00:00:00') AS ts
FROM located
"""


def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, traj_id, event_id, lat, lon, sec, ts; rows are not numbered yet."""
    return spark.sql(_PLACED, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with ``seq``, the 0-based place in the trajectory."""
    rows = number_in_groups(
        event_positions(spark, sf_dir), ["uid", "traj_id"], list(EVENT_ORDER), "seq"
    )
    return rows.selectExpr(
        "uid", "traj_id", "CAST(seq - 1 AS INT) AS seq", "lat", "lon", "sec", "ts"
    )


def micro_mean(column: str) -> str:
    """SQL for a stay's mean position rounded half up to whole micro-degrees.

    The sum of a stay's micro-degrees is a whole number, so the rounding is exact.
    """
    total = f"CAST(round({column} * n_points * 1e6) AS BIGINT)"
    return f"((2 * {total} + n_points) DIV (2 * n_points))"
