"""python -m hueweave compress FOF ARCHIVE | decompress ARCHIVE OUT [--wanted LIST] | stats ARCHIVE OUT"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from hueweave.plans.pipeline import run


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="hueweave", description=__doc__)
    modes = top.add_subparsers(dest="mode", required=True)
    p = modes.add_parser("compress", help="archive the files of a list")
    p.add_argument("fof")
    p.add_argument("archive")
    p.add_argument("-k", type=int, default=31)
    p = modes.add_parser("decompress", help="write the sequences of all or some files")
    p.add_argument("archive")
    p.add_argument("out")
    p.add_argument("-Q", "--wanted", help="a list of paths, one a line")
    p = modes.add_parser("stats", help="write k-mers per colour and popcount, simplitigs per length")
    p.add_argument("archive")
    p.add_argument("out")
    run(spark or SparkSession.builder.appName("hueweave").getOrCreate(), **vars(top.parse_args(args)))


if __name__ == "__main__":
    main()
