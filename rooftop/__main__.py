"""Run one table job from the command line (also through ``spark-submit``).

    python -m rooftop addresses --entrances s3a://b/entrances --buildings s3a://b/buildings \
        --municipalities s3a://b/municipalities --out s3a://b/addresses
    python -m rooftop capacity --addresses ... --replies ... --out ...
    python -m rooftop adoption --capacity ... --out ...            (one table, partitioned by adoption)
    python -m rooftop roofs --capacity ... --out ...
    python -m rooftop emissions --roofs ... --out ... [--scenarios path]
    python -m rooftop requests --addresses ... --out ... [--catalogue path --model NAME]
    python -m rooftop clean --register buildings --raw raw.csv --out path
    python -m rooftop catalogue --raw catalogue.csv --out path
    python -m rooftop approved --raw approved.csv --out path
    python -m rooftop irradiance --raw raw.csv --hourly out1 --labelled out2
    python -m rooftop nearest --addresses ... --replies ... --out ...
    python -m rooftop readings --raw raw.csv --out good --rejects bad
    python -m rooftop deliver --table path --name 2024-03 --raw path      (a delivery of a table)

Inputs and outputs are Parquet unless ``--in-format`` / ``--out-format`` say
otherwise; outputs are overwritten.  ``--stamped`` writes them as stamped builds
instead, ``--job-id`` as appends that count once, and ``--as-of`` reads inputs that are
stamped builds as they were at a time; ``--delivered`` reads tables of deliveries.
``--preview`` shows rows first.  The session is taken with ``getOrCreate()``, so
master and settings come from ``spark-submit``.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from .sources.builds import AppendOnceTable, StampedTable
from .sources.deliveries import Deliveries
from .sources.tables import Format, SaveMode, TableIn, TableOut


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m rooftop", description=__doc__.split("\n\n")[0])
    p.add_argument("--in-format", default="parquet", choices=[f.value for f in Format])
    p.add_argument("--out-format", default="parquet", choices=[f.value for f in Format])
    p.add_argument("--preview", type=int, default=0, help="show that many rows of each output before writing")
    how = p.add_mutually_exclusive_group()
    how.add_argument("--stamped", action="store_true", help="outputs are stamped builds (kept beside the earlier ones)")
    how.add_argument("--job-id", default=None, help="append the outputs, once for this id")
    given = p.add_mutually_exclusive_group()
    given.add_argument("--as-of", default=None, help="inputs are stamped builds: read them at 'YYYY-MM-DD HH:MM:SS', or 'now'")
    given.add_argument("--delivered", action="store_true", help="inputs are tables of deliveries")
    sub = p.add_subparsers(dest="job", required=True)

    a = sub.add_parser("addresses")
    for name in ("entrances", "buildings", "municipalities", "out"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--city", default=None, help="substring of the municipality name (default: the fixed city)")
    a.add_argument("--limit", type=int, default=None, help="keep the first rows only (default: all)")
    a.add_argument("--top-n", default="merge", choices=["merge", "tree"],
                   help="'tree' for very large inputs without a city filter")

    c = sub.add_parser("capacity")
    for name in ("addresses", "replies", "out"):
        c.add_argument(f"--{name}", required=True)

    d = sub.add_parser("adoption")
    d.add_argument("--capacity", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--bernoulli", action="store_true", help="independent draws instead of keyed, nested ones")
    d.add_argument("--exact", action="store_true", help="exactly the share of each municipality's households")
    d.add_argument("--seed", type=int, default=0)

    r = sub.add_parser("roofs")
    r.add_argument("--capacity", required=True)
    r.add_argument("--out", required=True)

    e = sub.add_parser("emissions")
    e.add_argument("--roofs", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--scenarios", default=None, help="table of scenarios (name + Scenario fields)")

    q = sub.add_parser("requests")
    q.add_argument("--addresses", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--catalogue", default=None)
    q.add_argument("--model", default=None)
    q.add_argument("--endpoint", default=None)

    k = sub.add_parser("clean")
    k.add_argument("--register", required=True, choices=["municipalities", "entrances", "buildings"])
    k.add_argument("--raw", required=True, help="raw CSV export")
    k.add_argument("--out", required=True)

    g = sub.add_parser("catalogue")
    g.add_argument("--raw", required=True, help="CSV, one row per model, its name in the column 'index'")
    g.add_argument("--out", required=True)

    v = sub.add_parser("approved")
    v.add_argument("--raw", required=True, help="CSV, copied as it is")
    v.add_argument("--out", required=True)

    i = sub.add_parser("irradiance")
    i.add_argument("--raw", required=True)
    i.add_argument("--hourly", required=True)
    i.add_argument("--labelled", required=True)
    i.add_argument("--tz", default="UTC")

    n = sub.add_parser("nearest")
    n.add_argument("--addresses", required=True)
    n.add_argument("--replies", required=True, help="request_id, lat, lon, body")
    n.add_argument("--out", required=True)

    w = sub.add_parser("readings")
    w.add_argument("--raw", required=True, help="logger CSV with a header line")
    w.add_argument("--out", required=True)
    w.add_argument("--rejects", required=True)

    t = sub.add_parser("deliver")
    t.add_argument("--table", required=True, help="folder of the deliveries")
    t.add_argument("--name", required=True, help="name of the delivery; one of that name is kept")
    t.add_argument("--raw", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans import solar_jobs as J

    spark = SparkSession.builder.appName(f"rooftop-{args.job}").getOrCreate()

    def tin(path: str):
        if args.as_of is not None:
            return StampedTable(path).at(None if args.as_of == "now" else datetime.fromisoformat(args.as_of))
        if args.delivered:
            return Deliveries(path)
        return TableIn(path, format=Format(args.in_format))

    def tout(path: str, partition_by: str | None = None):
        fmt = Format(args.out_format)
        if args.stamped:
            return StampedTable(path, partition_by or (), fmt)
        if args.job_id is not None:
            return AppendOnceTable(path, fmt).output(args.job_id)
        return TableOut(path, format=fmt, mode=SaveMode.OVERWRITE, build_datetime=False, partition_by=partition_by)

    preview = {"preview": args.preview}

    if args.job == "addresses":
        kw = {} if args.city is None else {"city": args.city}
        if args.limit is not None:
            kw["limit"] = args.limit
        J.addresses_job(spark, tin(args.entrances), tin(args.buildings), tin(args.municipalities),
                        tout(args.out), top_n_strategy=args.top_n, **kw, **preview)
    elif args.job == "capacity":
        J.capacity_job(spark, tin(args.addresses), tin(args.replies), tout(args.out), **preview)
    elif args.job == "nearest":
        J.nearest_yield_job(spark, tin(args.addresses), tin(args.replies), tout(args.out), **preview)
    elif args.job == "readings":
        print(J.readings_job(spark, TableIn(args.raw, format=Format.CSV), tout(args.out), tout(args.rejects)))
    elif args.job == "deliver":
        new = Deliveries(args.table).deliver(tin(args.raw).read(spark), args.name, Format(args.out_format))
        print("delivered" if new else "was delivered before")
    elif args.job == "adoption":
        J.adoption_job(spark, tin(args.capacity), tout(args.out, partition_by="adoption"),
                       keyed=not args.bernoulli, seed=args.seed, exact=args.exact, **preview)
    elif args.job == "roofs":
        J.roofs_job(spark, tin(args.capacity), tout(args.out), **preview)
    elif args.job == "emissions":
        J.emissions_job(spark, tin(args.roofs), tout(args.out),
                        **({} if args.scenarios is None else {"scenarios": tin(args.scenarios)}), **preview)
    elif args.job == "requests":
        J.requests_job(spark, tin(args.addresses), tout(args.out),
                       catalogue=None if args.catalogue is None else tin(args.catalogue),
                       model_name=args.model, endpoint=args.endpoint, **preview)
    elif args.job == "clean":
        J.clean_registers_job(spark, {args.register: TableIn(args.raw, format=Format.CSV, infer_schema=False)},
                              {args.register: tout(args.out)}, **preview)
    elif args.job == "catalogue":
        J.catalogue_job(spark, args.raw, tout(args.out))
    elif args.job == "approved":
        J.approved_panels_job(spark, TableIn(args.raw, format=Format.CSV, infer_schema=False), tout(args.out))
    elif args.job == "irradiance":
        total = J.irradiance_job(spark, args.raw, args.hourly, args.labelled, args.tz).first()[0]
        print(f"total_kwh={total}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
