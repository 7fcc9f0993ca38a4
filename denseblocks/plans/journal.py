"""The journal of a search: what a new driver needs to go on after the last finished pass.

A folder of the shared storage holds the tables that the search has written (alive
values, tuples, members) and one small manifest per step, written under another name and
renamed once it is whole. The newest manifest names the tables that count; the others
are leftovers of a pass that did not end. Older manifests are deleted as new ones appear.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Journal:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._step = self._newest() or 0

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _steps(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _newest(self) -> int | None:
        return max(self._steps(), default=None)

    def load(self) -> dict | None:
        """The newest manifest, None in a new folder."""
        step = self._newest()
        if step is None:
            return None
        text = self.spark.read.text(f"{self.folder}/manifest-{step:09d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def save(self, state: dict) -> None:
        self._step += 1
        name, draft = f"manifest-{self._step:09d}.json", self._path(f"_draft-{self._step:09d}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode("utf-8")))
        finally:
            out.close()
        if not self._fs.rename(draft, self._path(name)):
            raise OSError(f"could not write {self.folder}/{name}")
        for step in self._steps()[:-2]:  # the one before stays until the next
            self._fs.delete(self._path(f"manifest-{step:09d}.json"), False)
