"""python -m linkspark.cli X.csv Y.csv OUT: links two record files."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators.link import encode, link_all
from .sources.records import read_records
from .spec import PEOPLE


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="For each record of X the best match in Y, if it is above the threshold.")
    p.add_argument("x")
    p.add_argument("y")
    p.add_argument("out", help="folder for the result, as CSV: x_idx and match_idx are places in the files, from 0")
    p.add_argument("--empty", default="", help="token of a missing value")
    p.add_argument("--count", type=int, nargs=2, metavar=("X", "Y"), default=(None, None), help="read at most so many records of each file")
    p.add_argument("--no-prune", action="store_true", help="score all pairs")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("linkspark").getOrCreate()
    x, y = (encode(read_records(spark, path, a.empty, n, position="idx"), PEOPLE) for path, n in zip((a.x, a.y), a.count, strict=True))
    began = time.monotonic()
    link_all(x, y, PEOPLE, not a.no_prune).sort("x_idx").write.option("header", True).csv(a.out)
    print(f"total linking time: {time.monotonic() - began:.3f} s")


if __name__ == "__main__":
    main()
