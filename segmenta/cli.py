"""Annotates stored segments: python -m segmenta.cli SEGMENTS VERSES OUT [--narrations CSV] [--profile NAME] [--SETTING VALUE ...].

Every setting of ``plans.config`` is an option; switches have a form with ``--no-``.
"""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import fields
from logging.handlers import RotatingFileHandler

from pyspark.sql import SparkSession

from .plans.annotate import annotate
from .plans.config import Settings, settings
from .sinks import transcripts
from .sources import corpora, segments

log = logging.getLogger("segmenta")


def configure_logging(verbose: bool = False, file: str | None = None) -> None:
    """Console, and a file that rotates at 5 MB and keeps three."""
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if file:
        handlers.append(RotatingFileHandler(file, maxBytes=5_000_000, backupCount=3, encoding="utf-8"))
    logging.basicConfig(level=logging.DEBUG if verbose else logging.INFO, handlers=handlers, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)


def add_settings(parser: argparse.ArgumentParser) -> list[str]:
    """An option for each setting; unset ones leave it to the preset.  Returns the names."""
    names = []
    for field in fields(Settings):
        if field.name == "profile":
            continue
        names.append(field.name)
        option, kind = "--" + field.name.replace("_", "-"), type(field.default)
        if kind is bool:
            parser.add_argument(option, dest=field.name, action=argparse.BooleanOptionalAction, default=None)
        elif kind is tuple:
            parser.add_argument(option, dest=field.name, type=lambda x: tuple(map(float, x.split(","))), default=None)
        else:
            parser.add_argument(option, dest=field.name, type=kind, default=None)
    return names


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="segmenta", description=__doc__)
    parser.add_argument("segments")
    parser.add_argument("verses")
    parser.add_argument("out")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json"])
    parser.add_argument("--narrations")
    parser.add_argument("--profile", default="default")
    parser.add_argument("--verify", dest="enable_hadith_verification", action="store_true", default=None)
    parser.add_argument("--verbose", action="store_true")
    parser.add_argument("--log-file")
    names = add_settings(parser)
    args = parser.parse_args(argv)
    configure_logging(args.verbose, args.log_file)
    try:
        spark = SparkSession.builder.appName("segmenta").getOrCreate()
        given = {name: getattr(args, name) for name in names if getattr(args, name) is not None}
        told = None
        if args.narrations:
            corpora.write_narrations(corpora.read_narrations(spark, args.narrations), f"{args.out}/narrations")
            told = corpora.numbered(corpora.stored_narrations(spark, f"{args.out}/narrations"))
        found = annotate(segments.read(spark, args.segments, args.format), corpora.read_verses(spark, args.verses), told, settings(args.profile, **given))
        found.write.mode("overwrite").parquet(f"{args.out}/segments")
        stored = spark.read.parquet(f"{args.out}/segments")
        for name, render in (("txt", transcripts.txt), ("srt", transcripts.srt), ("json", transcripts.json_array), ("flagged", transcripts.flagged)):
            transcripts.write_files(render(stored), f"{args.out}/{name}")
        transcripts.diagnostics(stored).write.mode("overwrite").json(f"{args.out}/diagnostics")
    except KeyboardInterrupt:
        return 130
    except Exception:
        log.exception("the run failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
