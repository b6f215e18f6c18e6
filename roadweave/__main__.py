"""Checks a map file from the command line: python -m roadweave map.osm --filter mapping.* --participants vehicle,bicycle. Ends with 1 where it finds something."""

from __future__ import annotations

import argparse
import sys

from .functions.projections import Origin, SphericalMercator
from .operators import validation as V


def main(args: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="roadweave", description="Checks a map file.")
    p.add_argument("map", nargs="?", help="the file")
    p.add_argument("--filter", default="", help="names or patterns of checks, separated by commas; all of them if empty")
    p.add_argument("--location", default="de", help="where the traffic rules hold")
    p.add_argument("--participants", default="vehicle", help="for whom graphs are checked, separated by commas")
    p.add_argument("--origin", nargs=2, type=float, default=(49.0, 8.4), metavar=("LAT", "LON"), help="where the map's coordinates begin")
    p.add_argument("--print", action="store_true", dest="names", help="only list the checks")
    a = p.parse_args(args)
    if a.names or not a.map:
        print("\n".join(V.available(a.filter)))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    issues = V.validate_file(spark, a.map, projector=SphericalMercator(Origin(*a.origin)), checks=a.filter, location=a.location, participants=tuple(filter(None, a.participants.split(","))))
    found = V.report(issues).orderBy("check_name", "severity").collect()  # a row for each check
    for r in found:
        print(f"{r.check_name}: {r.n} x {r.severity}")
        for m in r.messages:
            print(f"  {m}")
    return 1 if found else 0


if __name__ == "__main__":
    sys.exit(main())
