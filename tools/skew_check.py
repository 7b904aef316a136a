"""Hot-key check for the address dedup, on data derived from the given tables.

Usage: python tools/skew_check.py [sf_dir]
Runs ``latest_addresses`` on the stand-in entrances as they are, then with a
third of them pointed at one building, and prints the records each shuffle
wrote (from Spark's event log in a fresh scratch folder).  With the hot key,
the exchange before the dedup should carry no more records than without it:
the hot building's entrances are reduced inside each map task.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(sf_dir: str) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    log_dir = tempfile.mkdtemp(prefix="run-skew-")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false").config("spark.sql.shuffle.partitions", "8")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from rooftop.operators.addresses import latest_addresses
    from rooftop.plans import standins as S

    ent = S.entrances(spark, sf_dir)
    hot = ent.withColumn("propertyRegistrationNumberIdentifier",
                         F.when(F.pmod(F.col("objectId"), F.lit(3)) == 0, F.lit(1).cast("long"))
                         .otherwise(F.col("propertyRegistrationNumberIdentifier")))
    b, m = S.buildings(spark, sf_dir), S.municipalities(spark, sf_dir)
    for label, e in (("as given", ent), ("one third on one building", hot)):
        spark.sparkContext.setJobGroup(label, label)
        n = latest_addresses(e, b, m, building_types=None, city=None, limit=None).count()
        print(f"{label}: {e.count()} entrances in, {n} address rows out")
    spark.stop()

    group_of, written = {}, {}
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if not os.path.isfile(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        group_of[sid] = g
                elif ev.get("Event") == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    acc = {a["Name"]: a.get("Value") for a in info.get("Accumulables", [])}
                    recs = int(acc.get("internal.metrics.shuffle.write.recordsWritten", 0) or 0)
                    if recs:
                        written[info["Stage ID"]] = recs
    for sid in sorted(written):
        print(f"{group_of.get(sid)}: stage {sid} wrote {written[sid]} shuffle records")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
