"""Command line.

``detect|boundaries|sanitize FILES.parquet OUT``, ``format FMT RECORDS.parquet OUT``, ``verify RECORDS.parquet OUT``,
``sanitize-records RECORDS.parquet OUT``, ``extract FILES.parquet OUT --backend module:function [--format FMT]``,
``batch FOLDER OUT --reader NAME --backend ...`` and ``capabilities``. A backend is a function ``(prompt, max_tokens) -> Answer``;
a reader is registered by the module that ``--plugin`` names.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from . import pipeline
from .operators import sanitize, sectionize
from .sinks import layouts


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerloom")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("detect", "boundaries", "sanitize"):
        s = sub.add_parser(name)
        s.add_argument("source")
        s.add_argument("out")
    s = sub.add_parser("format")
    s.add_argument("format", choices=layouts.FORMATS)
    s.add_argument("source")
    s.add_argument("out")
    for name in ("verify", "sanitize-records"):
        s = sub.add_parser(name)
        s.add_argument("source")
        s.add_argument("out")
    for name in ("extract", "batch"):
        s = sub.add_parser(name)
        s.add_argument("source")
        s.add_argument("out")
        s.add_argument("--backend", required=True)
        s.add_argument("--format", choices=layouts.FORMATS)
        s.add_argument("--family")
        s.add_argument("--retries", type=int, default=2)
        s.add_argument("--parallel", type=int)
        s.add_argument("--max-output-tokens", type=int)
        s.add_argument("--keep-numbers", action="store_true")
        s.add_argument("--no-verify", action="store_true")
        s.add_argument("--plugin", action="append", default=[])
        if name == "batch":
            s.add_argument("--reader", required=True)
            s.add_argument("--image-reader")
            s.add_argument("--vision-reader")
            s.add_argument("--pattern", default="*.pdf")
    sub.add_parser("capabilities")
    a = p.parse_args(args)
    if a.what == "capabilities":
        print(pipeline.capabilities())
        return 0
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    try:
        _run(spark, a)
    except (ValueError, KeyError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _load(name: str):
    module, _, attribute = name.partition(":")
    found = importlib.import_module(module)
    return getattr(found, attribute) if attribute else found


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    write = lambda tables: [t.write.mode("overwrite").parquet(f"{a.out}/{name}") for name, t in tables.items()]
    if a.what in ("extract", "batch"):
        for plugin in a.plugin:
            _load(plugin)
        options = pipeline.Options(family=a.family, max_output_tokens=a.max_output_tokens, retries=a.retries, parallel=a.parallel, redact=not a.keep_numbers, verify=not a.no_verify)
        backend = _load(a.backend)
        if a.what == "batch":
            out = pipeline.extract_batch(spark, a.source, a.reader, backend, options, a.pattern, image_reader=a.image_reader, vision_reader=a.vision_reader)
        else:
            out = pipeline.extract(spark.read.parquet(a.source), backend, options)
        write(out)
        if a.format:
            _formatted(pipeline.formattable(out["records"]), a.format, f"{a.out}/{a.format}")
        return
    df = spark.read.parquet(a.source)
    if a.what == "format":
        _formatted(df, a.format, a.out)
    elif a.what == "verify":
        write(pipeline.verified(layouts.parsed(df), df))
    else:
        run = {"detect": pipeline.detect, "boundaries": pipeline.boundaries, "sanitize": lambda d: sanitize.sanitize_text(sectionize.pages(d)).drop("text"), "sanitize-records": sanitize.sanitize_extractions}[a.what]
        run(df).write.mode("overwrite").parquet(a.out)


def _formatted(records, fmt: str, out: str) -> None:
    for name, table in layouts.format_records(records, fmt).items():
        flat = table.select(*[c.cast("string").alias(n) if t.startswith(("struct", "array", "map")) else c for (n, t), c in zip(table.dtypes, (table[n] for n in table.columns))])
        flat.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")


if __name__ == "__main__":
    sys.exit(main())
