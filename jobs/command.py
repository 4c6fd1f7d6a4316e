"""What the jobs' command lines share: a config file, its values by flag, a session that ends with the job."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def settings(name: str, config: str, argv: list[str] | None) -> dict:
    """The config file's values (one JSON object), those given as flags put over them. A relative path begins at the working directory."""
    first = argparse.ArgumentParser(prog=name, add_help=False)
    first.add_argument("--config", default=config)
    known, rest = first.parse_known_args(argv)
    with open(known.config, encoding="utf-8") as f:
        values = json.load(f)
    p = argparse.ArgumentParser(prog=name, parents=[first])
    for key, value in values.items():
        p.add_argument(f"--{key.replace('_', '-')}", type=type(value), default=value)
    got = vars(p.parse_args(rest))
    got.pop("config")
    if missing := [k for k, v in got.items() if v == ""]:
        p.error(f"no value for {', '.join(missing)}: set it in {known.config} or by its flag")
    return got


def main(name: str, config: str, run: Callable[..., dict], argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    values = settings(name, config, argv)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        print(json.dumps(run(spark, **values)))
    finally:
        spark.stop()
    return 0
