"""Stages that a later run takes up where an earlier one broke off.

A stage's tables are written below a folder that is named after the stage and a fingerprint of its inputs, and a manifest is
written when all of them are complete. A run that finds the manifest reads the tables; one that finds none, or other
inputs, builds them. Tables of a stage are inputs of the next one, so a change anywhere leads to new folders from there on.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosescreen.sources.writers import write_stage

Tables = dict[str, DataFrame]


def fingerprint(df: DataFrame) -> str:
    """What tells whether a table is the same as in an earlier run: its schema, and its files with sizes and times.

    A table without files is known by the hash of its rows. Filters and joins between files and table are not part of it;
    name what changes in them by a stage's ``version``.
    """
    files = sorted(df.inputFiles())
    found = hashlib.sha256(df.schema.json().encode())
    if files:
        context = df.sparkSession.sparkContext
        paths = context._jvm.org.apache.hadoop.fs.Path
        for file in files:
            path = paths(file)
            status = path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path)
            found.update(f"{file} {status.getLen()} {status.getModificationTime()}".encode())
    else:
        # sums do not depend on the order of rows, nor do repeated rows cancel out
        low = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        sums = df.select(low.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        found.update(repr(tuple(sums)).encode())
    return found.hexdigest()


class Run:
    """Stages of one study below ``folder``; ``built`` and ``resumed`` name what this run has made or found."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.built: list[str] = []
        self.resumed: list[str] = []

    def _manifest(self, place: str) -> dict | None:
        try:
            rows = self.spark.read.text(f"{place}/manifest").collect()
        except AnalysisException:  # not there
            return None
        return json.loads(rows[0]["value"]) if rows else None

    def stage(self, name: str, inputs: Tables, build: Callable[[], Tables], version: str = "1") -> Tables:
        """The tables that ``build`` gives for ``inputs``, written or read back.

        ``version`` stands for everything else they depend on, such as parameters.
        """
        marks = {k: fingerprint(df) for k, df in sorted(inputs.items())}
        key = hashlib.sha256(json.dumps([name, version, marks]).encode()).hexdigest()[:16]
        place = f"{self.folder}/{name}-{key}"
        manifest = self._manifest(place)
        if manifest is None:
            tables = build()
            places = {k: f"table-{i}" for i, k in enumerate(tables)}
            for k, df in tables.items():
                write_stage(df, f"{place}/{places[k]}")
            manifest = {"stage": name, "version": version, "inputs": marks, "tables": places}
            line = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
            line.coalesce(1).write.mode("overwrite").text(f"{place}/manifest")
            self.built.append(name)
        else:
            self.resumed.append(name)
        return {k: self.spark.read.parquet(f"{place}/{at}") for k, at in manifest["tables"].items()}
