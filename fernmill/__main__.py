"""``python -m fernmill local DATA OUT`` runs all stages over stored data, ``... report DATA FILE`` writes the report."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from fernmill.plans import modes


def main(args: list[str]) -> int:
    run = {"local": modes.local_run, "report": modes.report_file}.get(args[0] if args else "")
    if run is None or len(args) != 3:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("fernmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(spark, args[1], args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
