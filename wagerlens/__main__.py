"""python -m wagerlens build | generate | ingest | refresh | reconcile"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def build(args) -> int:
    from .operators.legs import drop_repeats
    from .plans import payload
    from .sources.exports import read_exports

    built = payload.build(drop_repeats(read_exports(_session(), args.raw)))
    try:
        failures = payload.check(built.payload)
        for line in failures:
            print(line, file=sys.stderr)
        if args.check:
            return int(bool(failures) or payload.drifted(built, args.out))
        if not failures:
            payload.write(built, args.out)
        return int(bool(failures))
    finally:
        built.release()


def generate(args) -> int:
    from .sources.sinks import write_events
    from .streaming.events import generate as events

    write_events(events(_session(), args.events, seed=args.seed), args.sink, brokers=args.brokers, topic=args.topic)
    return 0


def ingest(args) -> int:
    from .streaming.events import ingest as run, read_event_files, read_event_log, read_event_rows
    from .streaming.watch import run_until_idle

    spark = _session()
    if args.brokers:
        source = read_event_log(spark, args.brokers, args.topic)
    elif args.rows:
        source = read_event_rows(spark, args.source, args.checkpoint, max_rows=args.rows)
    else:
        source = read_event_files(spark, args.source, streaming=True)
    start = lambda: run(source, args.log, args.checkpoint, drain=not (args.follow or args.idle))
    if args.idle:
        watch = run_until_idle(start, spark, args.idle)
        print(json.dumps({"rows": watch.rows, "batches": watch.batches, "position": watch.position, "lag": watch.lag}))
    else:
        start().awaitTermination()
    return 0


def refresh(args) -> int:
    from .plans.artifacts import check_invariants
    from .streaming import cadence
    from .streaming.events import read_log
    from .streaming.refresh import refresh as run, write

    spark = _session()
    if args.turns:
        cadence.run(lambda: read_log(spark, args.log), args.out, tuple(args.classes), where=args.where or None, turns=args.turns if args.turns > 0 else None, check=check_invariants)
        return 0
    made = run(read_log(spark, args.log), tuple(args.classes), where=args.where or None)
    failures = check_invariants(made)
    for line in failures:
        print(line, file=sys.stderr)
    if not failures:
        write(made, args.out)
    return int(bool(failures))


def reconcile(args) -> int:
    from .operators.reconcile import canonical, reconcile as run, summary
    from .sources.feeds import load_alpha, load_beta
    from .plans.artifacts import plain, rows_of
    from .sources.sinks import write_json_rows

    spark = _session()
    result = run(load_alpha(spark, args.alpha), load_beta(spark, args.beta))
    if args.parquet:
        canonical(result).write.mode("overwrite").parquet(str(Path(args.out) / "canonical"))
        result.reviews.write.mode("overwrite").parquet(str(Path(args.out) / "reviews"))
    else:
        for rows, name in ((canonical(result), "canonical"), (result.reviews, "reviews")):
            write_json_rows((plain(r) for r in rows.toLocalIterator()), Path(args.out) / f"{name}.json")
    print(json.dumps(rows_of(summary(result))))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wagerlens")
    commands = parser.add_subparsers(required=True)

    def command(name, run, **options):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for option, settings in options.items():
            sub.add_argument(f"--{option}", **settings)

    text = {"default": ""}
    command("build", build, raw={"required": True}, out={"required": True}, check={"action": "store_true"})
    command("generate", generate, events={"type": int, "default": 10_000}, seed={"type": int, "default": 7}, sink={"required": True}, brokers=text, topic=text)
    command("ingest", ingest, source=text, log={"required": True}, checkpoint={"required": True}, brokers=text, topic=text, follow={"action": "store_true"}, idle={"type": float, "default": 0.0}, rows={"type": int, "default": 0})
    command("refresh", refresh, log={"required": True}, out={"required": True}, classes={"type": int, "nargs": "+", "default": [1, 2, 3]}, where=text, turns={"type": int, "default": 0})
    command("reconcile", reconcile, alpha={"required": True}, beta={"required": True}, out={"required": True}, parquet={"action": "store_true"})
    args = parser.parse_args(argv)
    if getattr(args, "rows", 0) and not (args.follow or args.idle):
        parser.error("--rows takes one batch a trigger: give --idle or --follow")
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
