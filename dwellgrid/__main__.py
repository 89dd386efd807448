"""``python -m dwellgrid <tracks> <points> <out>``: the whole job as one command."""

from __future__ import annotations

import argparse
from typing import get_type_hints

from pyspark.sql import SparkSession

from dwellgrid.plans.pipeline import Params, run
from dwellgrid.sources.tracks import remove_path


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="dwellgrid", description=__doc__)
    args.add_argument("tracks", help="folder of <uid>/<folder>/<file> track files")
    args.add_argument("points", help="points table; read instead of the tracks if it is complete")
    args.add_argument("out", help="folder for the stage tables; replaced as a whole")
    args.add_argument("--text", action="store_true", help="write text forms as well")
    args.add_argument("--trajectories", help="trajectory text to start from instead of the tracks")
    args.add_argument("--markers", type=int, help="cluster whose map markers are written")
    kinds = get_type_hints(Params)
    for name, default in Params().__dict__.items():
        if kinds[name] is bool:
            args.add_argument(f"--{name}", action="store_true")
        else:
            args.add_argument(f"--{name.replace('_', '-')}", type=kinds[name], default=default)
    given = vars(args.parse_args(argv))
    params = Params(**{name: given[name] for name in kinds})
    spark = SparkSession.builder.appName("dwellgrid").getOrCreate()
    folder = None
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        # Beside ``out``, which is replaced, in the same store.
        folder = f"{given['out'].rstrip('/')}-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    try:
        run(
            spark, given["tracks"], given["points"], given["out"], params, given["text"],
            given["trajectories"], given["markers"],
        )
    finally:
        if folder:
            remove_path(spark, folder)


if __name__ == "__main__":
    main()
