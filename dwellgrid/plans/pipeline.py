"""The whole job: points, stays, clusters, visits, regions, similar users, recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.lineage import cut
from dwellgrid.operators import itemsets, profiles, recommend, regions, visits
from dwellgrid.operators.dbscan import STAY_KEY, dbscan
from dwellgrid.operators.numbering import runs_short
from dwellgrid.operators.stays import stay_points
from dwellgrid.sources import stages
from dwellgrid.sources.tracks import path_exists, prepare_points, read_trajectory_text, remove_path, write_points


@dataclass(frozen=True)
class Params:
    """Thresholds of all stages, with their usual values."""

    distance: float = 200.0  # metres a stay may spread around its first point
    dwell: float = 1200.0  # seconds a stay must last
    eps: float = 100.0  # planar radius of a neighbourhood
    min_pts: int = 4  # points that make a neighbourhood dense
    min_support: int = 3  # regions two similar users share
    top_n: int = 6  # regions recommended to a user
    exclude: str = "region"  # or "region_and_count"
    exact: bool = False  # True: no rounding to whole metres


class TrajectoryPipeline:
    """Stages as DataFrames, built when asked for; those used more than once are evaluated once, as they are built.

    With ``out`` every stage is written there and the next one reads the table; without
    it, reused stages go to the session's checkpoint folder.
    """

    def __init__(
        self,
        points: DataFrame,
        params: Params = Params(),
        order: Sequence[str] = ("seq",),
        out: str | None = None,
    ):
        self.points = points
        self.params = params
        self.order = order
        self.out = out

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return stages.write_stage(df, f"{self.out}/{name}") if self.out else cut(df)

    def _passed(self, df: DataFrame, name: str) -> DataFrame:
        return stages.write_stage(df, f"{self.out}/{name}") if self.out else df

    @cached_property
    def stays(self) -> DataFrame:
        p = self.params
        return self._kept(stay_points(self.points, p.distance, p.dwell, self.order, p.exact), "stays")

    @cached_property
    def labels(self) -> DataFrame:
        p = self.params
        return self._passed(dbscan(self.stays, p.eps, p.min_pts, evaluated=True), "labels")

    @cached_property
    def labelled_stays(self) -> DataFrame:
        """Stays with their coordinates, cluster and flag."""
        return self.stays.join(self.labels.select(*STAY_KEY, "cluster_id", "flag"), STAY_KEY)

    @cached_property
    def visits(self) -> DataFrame:
        # Every stay has its label row, so no lookup is needed.
        labelled = self.labels.select(*STAY_KEY, "cluster_id")
        fits = runs_short(self.stays, "stay_seq")
        return self._kept(visits.collapse_runs(labelled, fits=fits), "visits")

    @cached_property
    def user_region(self) -> DataFrame:
        return self._kept(regions.user_region(self.visits), "user_region")

    @cached_property
    def region_user(self) -> DataFrame:
        return self._passed(regions.region_user(self.user_region), "region_user")

    @cached_property
    def pairs(self) -> DataFrame:
        return itemsets.frequent_pairs(self.region_user, self.params.min_support)

    @cached_property
    def similar(self) -> DataFrame:
        # As large as the pairs of users: not stored unless asked for, what it is listed from is.
        return self._passed(itemsets.similar_users(self.pairs), "similar")

    @cached_property
    def _profiled(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        members, found = profiles.user_profiles(self.region_user, self.params.min_support)
        return members, found, cut(profiles.profile_pairs(found, self.params.min_support))

    @property
    def similar_links(self) -> DataFrame:
        """Pairs of similar users that connect whom ``similar`` connects."""
        members, _, pairs = self._profiled
        return profiles.similar_links(members, pairs)

    @property
    def similar_lines(self) -> DataFrame:
        members, _, pairs = self._profiled
        return profiles.similar_lines(members, pairs)

    def users_reached(self, starts: DataFrame) -> DataFrame:
        """uid, reached, hops by steps between similar users from those of ``starts``."""
        members, _, pairs = self._profiled
        return profiles.users_reached(members, pairs, starts)

    @cached_property
    def recommended(self) -> DataFrame:
        p = self.params
        return self._passed(
            recommend.recommend_by_profile(self.user_region, *self._profiled, p.top_n, p.exclude), "recommended"
        )

    @property
    def recommendation_lines(self) -> DataFrame:
        return recommend.recommendation_lines(profiles.users_with_similar(*self._profiled), self.recommended)

    def create_views(self, prefix: str = "") -> None:
        """Temporary views of the stages, for SQL."""
        for name in ("stays", "labels", "visits", "user_region", "region_user", "similar", "recommended"):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def write_text(self, out: str) -> None:
        """Text forms of all stages under ``out``."""
        stages.write_lines(stages.stay_lines(self.stays), f"{out}/stays")
        stages.write_lines(stages.labelled_lines(self.labelled_stays), f"{out}/labels")
        stages.write_lines(visits.location_lines(self.visits), f"{out}/visits")
        stages.write_lines(regions.user_region_lines(self.user_region), f"{out}/user_region", ["uid"])
        stages.write_lines(
            regions.region_user_lines(self.region_user), f"{out}/region_user", ["cluster_id"]
        )
        # Two files for the similar users, as the text layout has it.
        stages.write_lines(self.similar_lines, f"{out}/similar", ["uid"], files=2)
        stages.write_lines(self.recommendation_lines, f"{out}/recommended", ["uid"])


def run(
    spark: SparkSession,
    tracks: str,
    points: str,
    out: str,
    params: Params = Params(),
    text: bool = False,
    trajectories: str | None = None,
    markers: int | None = None,
) -> DataFrame:
    """Track files (or trajectory text) to recommendations; all results go under ``out``.

    ``out`` is replaced as a whole, so nothing of an earlier run stays. With ``trajectories`` the points come
    from that text; with ``markers`` the map markers of a cluster are written as well.
    """
    if f"{points.rstrip('/')}/".startswith(f"{out.rstrip('/')}/"):
        raise ValueError("the points table may not lie in the folder that is replaced")
    if trajectories and not path_exists(spark, f"{points}/_SUCCESS"):
        write_points(read_trajectory_text(spark, trajectories), points)
    remove_path(spark, out)
    pipeline = TrajectoryPipeline(prepare_points(spark, tracks, points), params, out=out)
    result = pipeline.recommended
    # The recommendations don't need the list of similar users, but it is a stage of its own.
    pipeline.similar  # noqa: B018
    if text:
        pipeline.write_text(f"{out}/text")
    if markers is not None:
        found = stages.map_markers(pipeline.labelled_stays, markers)
        found.select(F.col("marker").alias("value")).write.text(f"{out}/markers")
    return result
