"""A run's tables by name, kept in one folder: what is whole is read again, what is missing is made. Runs may follow on earlier ones."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Stage tables under ``folder``; ``settings`` are what they were made with, ``previous`` is the folder of the run before.

    A table counts as whole once Spark has marked it as written, so a run that was killed goes on at its first unfinished stage. Opening a folder with
    other settings or another previous run is an error.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: dict | None = None, previous: str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        known = self.header()
        if known is None:
            self.settings, self.previous = settings or {}, previous.rstrip("/") if previous else None
            line = json.dumps({"settings": self.settings, "previous": self.previous}, sort_keys=True)
            spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/run")
            return
        self.settings, self.previous = known["settings"], known["previous"]
        if settings is not None and settings != self.settings:
            raise ValueError(f"{self.folder} was made with {self.settings}, not {settings}")
        if previous is not None and previous.rstrip("/") != self.previous:
            raise ValueError(f"{self.folder} follows on {self.previous}, not {previous}")

    def header(self) -> dict | None:
        return json.loads(self.spark.read.text(f"{self.folder}/run").first()[0]) if self.whole("run") else None

    def whole(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, made by ``make`` unless it is whole."""
        if not self.whole(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def chain(self) -> list[Stages]:
        """This run and those it follows on, the latest first; one that is met again, or isn't there, ends it."""
        out, seen = [self], {self.folder}
        while (at := out[-1].previous) and at not in seen:
            run = object.__new__(Stages)
            run.spark, run.folder = self.spark, at
            known = run.header()
            if known is None:
                break
            run.settings, run.previous = known["settings"], known["previous"]
            out.append(run)
            seen.add(at)
        return out

    def find(self, name: str) -> DataFrame:
        """The table in the latest run that has it."""
        for run in self.chain():
            if run.whole(name):
                return self.spark.read.parquet(f"{run.folder}/{name}")
        raise FileNotFoundError(f"no table {name!r} in {', '.join(r.folder for r in self.chain())}")
