"""Stay points as a table function for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from dwellgrid.operators.stays import STAY_SCHEMA, stays_of

# The usual thresholds, where a call gives none.
DISTANCE, DWELL = 200.0, 1200.0


class StayPoints:
    """The stays of one partition of the table, which is one trajectory; Spark brings its rows in order.

    The partition's batches are kept as they come and scanned as a whole, all anchors of a batch at once, by the
    scan that ``stay_points`` uses. So a trajectory must fit a task; longer ones are for the function of that name.
    """

    def __init__(self):
        self._rows: list[pa.RecordBatch] = []
        self._settings = (DISTANCE, DWELL, False)

    def eval(self, points, distance=None, dwell=None, exact=None) -> Iterator[pa.Table]:
        self._rows.append(points)
        given = [None if x is None or not len(x) else x[0].as_py() for x in (distance, dwell, exact)]
        usual = (DISTANCE, DWELL, False)
        distance, dwell, exact = (u if g is None else g for g, u in zip(given, usual, strict=True))
        if distance < 0 or dwell < 0:
            raise ValueError("distance and dwell may not be negative")
        self._settings = (float(distance), float(dwell), bool(exact))
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self._rows:
            yield stays_of(pa.Table.from_batches(self._rows), *self._settings)


def register_table_functions(spark: SparkSession, name: str = "stay_points") -> None:
    """Make stay points a function of SQL in this session.

    ``SELECT * FROM stay_points(TABLE(points) PARTITION BY (uid, traj_id) ORDER BY (seq) [, distance[, dwell[, exact]]])``;
    the table has uid, traj_id, lat, lon and ts among its columns.
    """
    spark.udtf.register(name, F.arrow_udtf(StayPoints, returnType=STAY_SCHEMA))
