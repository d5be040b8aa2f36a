"""Command line: mask files under one mapping, restore texts, list tokens, check a dictionary.

    python -m veilspark mask FILE... --dictionary terms.yaml --out DIR
    python -m veilspark unmask FILE... --mapping DIR/mapping
    python -m veilspark debug FILE... [--dictionary terms.yaml]
    python -m veilspark check --dictionary terms.yaml
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _request(spark: SparkSession, files: list[str]) -> DataFrame:
    from veilspark.plans.service import request

    return request(spark, parts=[{"id": f, "file_path": f} for f in files])


def _entries(spark: SparkSession, path: str | None) -> DataFrame | None:
    from veilspark.sources.codecs import read_dictionary

    return read_dictionary(spark, Path(path).read_text(encoding="utf-8")) if path else None


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from veilspark.operators import audit, channels
    from veilspark.plans import service

    options = argparse.ArgumentParser(prog="veilspark", description=__doc__.splitlines()[0])
    options.add_argument("verb", choices=["mask", "unmask", "debug", "check"])
    options.add_argument("files", nargs="*")
    options.add_argument("--dictionary")
    options.add_argument("--out", default="masked")
    options.add_argument("--mapping")
    options.add_argument("--level", default="strong")
    given = options.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("veilspark").getOrCreate()
    entries = _entries(spark, given.dictionary)
    if given.verb == "check":
        spelled = entries.select("canonical", "partial", F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("place", "surface"))
        found = audit.redundancy(spelled.withColumn("ordinal", F.struct("canonical", "place"))).where("duplicate or too_short")
        found.select("canonical", "surface", "duplicate", "too_short").show(1000, truncate=False)
        return int(found.limit(1).count() > 0)
    if given.verb == "mask":
        out = service.mask_request(_request(spark, given.files), entries, level=given.level)
        for name in ("masked_parts", "mapping", "pending"):
            out[name].write.mode("overwrite").json(f"{given.out}/{name}")
        out["masked_parts"].show(truncate=False)
        return 0
    texts = service.resolved(service.checked(_request(spark, given.files))).select("bundle_id", "part_id", F.array_join("chunks", "\n\n").alias("text"))
    if given.verb == "unmask":
        fields = "bundle_id string, placeholder string, canonical string, surfaces array<string>"
        service.unmask_request(texts, spark.read.schema(fields).json(given.mapping)).select("part_id", "restored").show(truncate=False)
        return 0
    toks = channels.tokens(texts)
    if entries is not None:
        hits = channels.dictionary_hits(texts, channels.terms(entries)).select("part_id", F.col("start").alias("s"), F.col("end").alias("e"), "canonical")
        toks = toks.join(hits, (toks["part_id"] == hits["part_id"]) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left").drop(hits["part_id"], "s", "e")
    toks.orderBy("part_id", "i").show(100_000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
