"""Command lines of the jobs: a configuration file, single settings over it, one session for the run."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from typing import Any

from pyspark.sql import SparkSession


def command_line(job: Callable, settings: type, name: str, arguments: list[str] | None = None) -> Any:
    """Runs job(session, settings) with what ``--config`` and the other arguments say; the session is this run's own."""
    parser = argparse.ArgumentParser(prog=name, description=job.__doc__)
    parser.add_argument("--config", default=f"{__file__.rsplit('/', 1)[0]}/{name}.json", help="JSON object of settings")
    for f in fields(settings):
        parser.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name, type={"int": int, "float": float}.get(str(f.type), str), help=f"overrides {f.name}")
    given = vars(parser.parse_args(arguments))
    with open(given.pop("config"), encoding="utf-8") as f:
        values = json.load(f) | {k: v for k, v in given.items() if v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        return job(spark, settings(**values))
    finally:
        spark.stop()
