"""A SQL shell: python -m rollstore --config tables.json; statements end with a semicolon.

The config is {"tables": [...]}; a table with "parquet": PATH lies over that file.
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from .engine import Engine


def open_engine(spark: SparkSession, config: dict) -> Engine:
    engine = Engine(spark, path=config.get("path"))
    for cfg in config.get("tables", []):
        if cfg["name"] not in engine.tables:
            engine.create_table(cfg, spark.read.parquet(cfg["parquet"]) if "parquet" in cfg else None)
    return engine


def run(engine: Engine, source: TextIO, out: TextIO, header: bool = False) -> None:
    """Runs statements as they are completed; an error is printed and the next one is read."""
    text = ""
    for line in source:
        text += line
        if not text.rstrip().endswith(";"):
            continue
        try:
            for row in engine.tsv(text, header):
                out.write(row)
        except Exception as e:
            out.write(f"Error: {e}\n".split("\n\nJVM")[0])
        text = ""
        out.flush()


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--config", required=True)
    args.add_argument("--header", action="store_true")
    given = args.parse_args()
    with open(given.config) as f:
        engine = open_engine(SparkSession.builder.getOrCreate(), json.load(f))
    run(engine, sys.stdin, sys.stdout, given.header)


if __name__ == "__main__":
    main()
