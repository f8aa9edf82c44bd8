"""Command line: ``python -m inkspan.cli clean|prepare|train|ingest``. Exit status 0 if all went well, else 1."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from inkspan import reach_workers
from inkspan.operators import checks
from inkspan.plans import config as K, stages


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkspan")
    sub = p.add_subparsers(dest="stage", required=True)
    c = sub.add_parser("ingest", help="documents of a folder to one marker file")
    c.add_argument("--input-dir", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--extract-zip", action="store_true")
    c = sub.add_parser("clean", help="raw marker file to cleaned corpus")
    c.add_argument("--input-dir", default="data/processed")
    c.add_argument("--output-dir", default="data/cleaned")
    c.add_argument("--skip-validation", action="store_true")
    c = sub.add_parser("prepare", help="cleaned corpus to splits")
    c.add_argument("--input-dir", default="data/cleaned")
    c.add_argument("--output-dir", default="data/prepared")
    c.add_argument("--split-strategy", choices=K.STRATEGIES, default="company")
    c.add_argument("--train-ratio", type=float, default=0.80)
    c.add_argument("--validation-ratio", type=float, default=0.10)
    c.add_argument("--test-ratio", type=float, default=0.10)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--preserve-case", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--preserve-punctuation", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--boundary-mode", choices=("special", "remove"), default="special")
    c.add_argument("--skip-statistics", action="store_true", help="accepted for compatibility; statistics are always written")
    c = sub.add_parser("train", help="marker file to tokenizer")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--vocab-size", type=int, default=8192)
    c.add_argument("--min-frequency", type=int, default=2)
    c.add_argument("--trainer", choices=("reference", "optimized"), default="reference")
    for c in sub.choices.values():
        c.add_argument("--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    log = logging.getLogger("inkspan")
    try:
        spark = spark or SparkSession.builder.appName("inkspan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        reach_workers(spark)
        if a.stage == "ingest":
            log.info("%d documents", stages.ingest(spark, a.input_dir, a.output, K.Ingestion(extract_zip=a.extract_zip)))
        elif a.stage == "clean":
            log.info("%s", stages.clean_folder(spark, a.input_dir, a.output_dir))
            if not a.skip_validation and not (found := checks.validate_corpus(spark, a.output_dir))["is_valid"]:
                log.warning("validation: %s", found["errors"])
        elif a.stage == "prepare":
            config = K.Preparation(a.split_strategy, a.train_ratio, a.validation_ratio, a.test_ratio, a.seed, a.preserve_case, a.preserve_punctuation, a.boundary_mode)
            report = stages.prepare(spark, a.input_dir, a.output_dir, config)
            log.info("%s", report["corpus_summary"])
            return int(report["status"] != "success")
        else:
            got = stages.train(spark, a.input, a.output, K.Tokenizer(a.vocab_size, a.min_frequency, trainer=a.trainer))
            log.info("%s", got["statistics"])
            return int(not got["validation"]["is_valid"] or got["round_trip_failures"] > 0)
    except Exception:
        log.exception("%s failed", a.stage)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
