"""Command line: ``python -m unifold.plans.cli --csv sheet.csv --github profile.json``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from unifold.operators.merge import GROUP
from unifold.plans.pipeline import run_pipeline
from unifold.sources.pdf import default_extractor
from unifold.sources.sinks import write_json_array


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code 1 without a source or with an unreadable config, else 0."""
    p = argparse.ArgumentParser(description="Unify person profiles from several sources")
    p.add_argument("--csv", help="CSV file of the recruiters' sheet")
    p.add_argument("--resume", help="résumé file, or a folder of .txt and .pdf files")
    p.add_argument("--github", help="code-host profile: JSON file, link or handle")
    p.add_argument("--github-token", help="accepted for compatibility; profiles are looked up offline")
    p.add_argument("--profiles", help="JSON file or folder of code-host profiles for links, handles and enrichment")
    p.add_argument("--config", help="JSON file with the projection")
    p.add_argument("--as-of", help="month (YYYY-MM) that Present means; by default this month")
    p.add_argument("--output-default", default="data/output_default.json")
    p.add_argument("--output-custom", default="data/output_custom.json")
    a = p.parse_args(argv)
    if not (a.csv or a.resume or a.github):
        print("Error: at least one of --csv, --resume and --github is needed.")
        p.print_help()
        return 1
    config = None
    if a.config:
        try:
            with open(a.config, encoding="utf-8") as f:
                config = json.load(f)
        except (OSError, ValueError) as e:
            print(f"Error: the config {a.config} can't be read: {e}")
            return 1
    spark = spark or SparkSession.builder.appName("unifold").getOrCreate()
    from unifold.sources.readers import read_github

    known = read_github(spark, a.profiles) if a.profiles else None
    result = run_pipeline(spark, a.csv, a.resume, a.github, known, config, a.as_of, default_extractor)
    print(f"{write_json_array(result.default, a.output_default, GROUP)} profiles written to {a.output_default}")
    if result.custom is not None:
        omit = config.get("on_missing") == "omit"
        print(f"{write_json_array(result.custom, a.output_custom, omit_nulls=omit)} projected profiles written to {a.output_custom}")
        for r in result.rejects.take(20):
            print(f"Warning: {r.full_name or r.candidate_id} was left out: {r.reason}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
