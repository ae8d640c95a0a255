"""Command line: ``python -m orrery parse TEXT``, ``query NAME FOLDER``, ``refresh FEED SNAPSHOT STORE``, ``cluster CHIPS OUT``, ``verify-audit LOG``, ``queries``."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime


def _parse(args: argparse.Namespace) -> int:
    from orrery.plans.parser import parse

    now = datetime.fromisoformat(args.now.replace("Z", "+00:00")) if args.now else None
    print(json.dumps(parse(args.text, now).as_dict(), indent=1, ensure_ascii=False))
    return 0


def _queries(_: argparse.Namespace) -> int:
    from orrery.queries import QUERIES

    print(*sorted(QUERIES), sep="\n")
    return 0


def _query(args: argparse.Namespace) -> int:
    from orrery.queries import QUERIES
    from orrery.session import session

    df = QUERIES[args.name](session(), args.folder)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.rows, truncate=False)
    return 0


def _refresh(args: argparse.Namespace) -> int:
    """A snapshot through validation and scope into the next version of a store."""
    from orrery.operators import ingest
    from orrery.schemas import schema
    from orrery.session import session
    from orrery.sources import feeds
    from orrery.streaming.observations import current_version

    spark = session()
    held = current_version(spark, args.store)
    old = spark.createDataFrame([], schema("events")) if held is None else spark.read.parquet(held[1])
    area = json.loads(open(args.area).read())["coordinates"] if args.area else None
    judged = ingest.judged(feeds.read(spark, args.feed, args.snapshot), area, args.country).cache()
    number = 0 if held is None else held[0] + 1
    at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    ingest.stored(old, judged, at, args.feed if args.replace else None).write.mode("overwrite").parquet(f"{args.store}/version={number}")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{args.store}/done={number}")
    print(json.dumps([r.asDict() for r in ingest.counters(judged).collect()]))
    return 0


def _cluster(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from orrery.functions import vector
    from orrery.operators import clusters
    from orrery.session import session

    chips = session().read.parquet(args.chips).where(vector.invalid_reason(F.col("embedding"), args.size).isNull())
    clusters.built(chips.select(F.col("chip_px").alias("family"), "id", "embedding")).write.mode("overwrite").parquet(args.out)
    return 0


def _verify(args: argparse.Namespace) -> int:
    from orrery.operators.governance import verified_chain
    from orrery.session import session

    wrong = verified_chain(session().read.parquet(args.log)).limit(100).collect()
    for r in wrong:
        print(r.id, r.problem)
    return int(bool(wrong))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="orrery", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, f, *names: str, **options: object) -> argparse.ArgumentParser:  # noqa: ANN001
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        for n in names:
            p.add_argument(n)
        for o, default in options.items():
            flag = "--" + o.replace("_", "-")
            p.add_argument(flag, action="store_true") if default is False else p.add_argument(flag, default=default, type=type(default) if default is not None else str)
        return p

    command("parse", _parse, "text", now=None)
    command("queries", _queries)
    command("query", _query, "name", "folder", out=None, rows=20)
    command("refresh", _refresh, "feed", "snapshot", "store", area=None, country=None, replace=False)
    command("cluster", _cluster, "chips", "out", size=512)
    command("verify-audit", _verify, "log")
    args = top.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
