"""python -m tessera JOB input=path ... [parameter=value ...] out=folder"""

from __future__ import annotations

import inspect
import sys

from pyspark.sql import SparkSession

from tessera.plans.jobs import JOBS
from tessera.sources import lineage, records


def main(arguments: list[str]) -> int:
    if not arguments or arguments[0] not in JOBS:
        print(f"{__doc__}\nJobs: {', '.join(JOBS)}")
        return 2
    job = JOBS[arguments[0]]
    given = dict(a.split("=", 1) for a in arguments[1:])
    out = given.pop("out")
    spark = SparkSession.builder.appName(f"tessera {arguments[0]}").getOrCreate()
    inputs, parameters = {}, {}
    for name, p in inspect.signature(job).parameters.items():
        if name not in given:
            continue
        if p.default is inspect.Parameter.empty and given[name].endswith((".parquet", ".jsonl")):
            inputs[name] = records.read_table(spark, given[name])
        else:
            kind = type(p.default) if p.default not in (inspect.Parameter.empty, None) else str
            parameters[name] = kind(given[name])
    results = job(**inputs, **parameters)
    for name, df in results.items():
        records.write_table(df, f"{out}/{name}.parquet")
    found = {n: lineage.table_digest(spark.read.parquet(f"{out}/{n}.parquet")) for n in results}
    text = lineage.manifest_json(lineage.manifest({n: lineage.table_digest(df) for n, df in inputs.items()}, found, {"job": arguments[0], **parameters}))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{out}/manifest")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
