"""Run a task on one's own files: python -m ampliscope TASK --option value .. (see tasks.py; TASK --help lists its options), or one
registered query: python -m ampliscope QUERY DATA_FOLDER [OUTPUT_FOLDER]; without arguments, list both.

A query's rows are written as Parquet if an output folder is given, else the first are shown."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import tasks
from .plans.flows import QUERIES


def main(args: list[str]) -> int:
    if args and args[0] in tasks.TASKS:
        tasks.options(args[0], args[1:])
        tasks.run(SparkSession.builder.getOrCreate(), args[0], args[1:])
        return 0
    if len(args) not in (2, 3) or args[0] not in QUERIES:
        print("\n".join([*sorted(tasks.TASKS), "", *sorted(QUERIES)]))
        return 0 if not args else 2
    spark = SparkSession.builder.getOrCreate()
    found = QUERIES[args[0]](spark, args[1])
    if len(args) == 3:
        found.write.mode("errorifexists").parquet(args[2])
    else:
        found.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
