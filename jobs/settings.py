"""Config files and log lines of the jobs."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
log = logging.getLogger("jobs")


def settings(name: str, path: str | None = None) -> dict:
    """The job's own config file, overruled by the one named; keys that the job doesn't know are refused."""
    known = json.loads((HERE / f"{name}.json").read_text(encoding="utf-8"))
    given = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return known | given


def arguments(doc: str, *paths: str) -> argparse.Namespace:
    """--config and a path argument for each name."""
    parser = argparse.ArgumentParser(description=doc.split("\n", 1)[0])
    parser.add_argument("--config", help="JSON file of settings that differ from the job's own")
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    return parser.parse_args()


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
