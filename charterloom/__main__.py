"""Command line: ``python -m charterloom --input_path DIR --output DIR [--KEY VALUE ...]``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from charterloom.config import Config


def parse(argv: list[str] | None = None) -> tuple[Config, str]:
    """Settings and output folder from arguments."""
    parser = argparse.ArgumentParser(prog="charterloom")
    parser.add_argument("--output", default="charterloom-output")
    for f in fields(Config):
        kind = type(f.default)
        convert = (lambda s: s.lower() in ("1", "true", "yes")) if kind is bool else kind
        parser.add_argument(f"--{f.name}", type=convert, default=f.default)
    args = vars(parser.parse_args(argv))
    output = args.pop("output")
    return Config(**args), output


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from charterloom.plans.pipeline import run_folders

    config, output = parse(argv)
    spark = SparkSession.builder.appName("charterloom").getOrCreate()
    result = run_folders(spark, config, output)
    print(f"threshold {result.threshold:.4f}; wrote {', '.join(result.files)}")


if __name__ == "__main__":
    main()
