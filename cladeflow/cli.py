"""Command line: ``python -m cladeflow.cli FASTA_DIRECTORY [options]``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from cladeflow import __version__
from cladeflow.operators.search import MATRICES
from cladeflow.plans.run import Config, run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladeflow", description=__doc__)
    p.add_argument("fasta_directory")
    p.add_argument("-o", "--output_directory")
    p.add_argument("-p", "--phmmer", default="phmmer")
    p.add_argument("-b", "--search_backend", choices=("external", "native"), default="external")
    p.add_argument("-e", "--evalue", type=float, default=0.0001)
    p.add_argument("-x", "--substitution_matrix", choices=MATRICES, default="BLOSUM62")
    p.add_argument("--matrix_file", help="a matrix for the native search that takes the place of the named one")
    p.add_argument("--profiles", action="store_true", help="let the native search score as a profile search does")
    p.add_argument("--exact", action="store_true", help="let the native search align all pairs of sequences")
    p.add_argument("-m", "--mcl", help="accepted and not needed: clustering runs on Spark")
    p.add_argument("-c", "--cpu", type=int, help="of one search; all there are by default")
    p.add_argument("--compat", action="store_true", help="list all groups in the file of single-copy names")
    p.add_argument("--taxon_order", type=lambda x: tuple(x.split(",")), help="file names in order, by commas")
    p.add_argument("-s", "--single_copy_threshold", type=float, default=0.5)
    p.add_argument("-i", "--inflation_value", type=float, default=1.5)
    p.add_argument("--start", choices=("search_res",))
    p.add_argument("--stop", choices=("prepare", "infer", "write"))
    p.add_argument("-v", "--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    config = Config(**vars(parser().parse_args(argv)))
    spark = SparkSession.builder.appName("cladeflow").getOrCreate()
    result = run(spark, config)
    if config.stop == "prepare":
        for row in result.plan.select("command").toLocalIterator():
            print(row["command"])
    else:
        result.statistics.show(truncate=False)


if __name__ == "__main__":
    main()
