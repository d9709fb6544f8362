"""Claims: who may change a target just now.

A claim is a file of the next generation, made with create-without-overwrite, in
a folder that every writer of the target uses.  It ends with a second file.  A
claim whose owner has not been heard of for ``stale_after`` seconds may be passed
over by the next generation; the owner notices that before its next change
(``check``) and stops.  Only short steps run under a claim, never the writing of
a load's rows.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

STALE_AFTER, WAIT, POLL = 3600.0, 1800.0, 0.5


class ClaimLost(RuntimeError):
    """Another run has taken over the target."""


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath, jvm


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, p, _ = filesystem(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = filesystem(spark, path)
    return bool(fs.exists(p))


def age(spark: SparkSession, path: str) -> float:
    """Seconds since the file was last touched."""
    fs, p, _ = filesystem(spark, path)
    return time.time() - fs.getFileStatus(p).getModificationTime() / 1000


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    fs, p, _ = filesystem(spark, path)
    out = fs.create(p, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p, _ = filesystem(spark, path)
    stream = fs.open(p)
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return text


class Claim:
    """``with Claim(spark, folder) as claim``: the folder's target is ours."""

    def __init__(self, spark: SparkSession, folder: str, stale_after: float = STALE_AFTER,
                 wait: float = WAIT, poll: float = POLL):
        self.spark, self.folder, self.token = spark, folder, uuid.uuid4().hex
        self.stale_after, self.wait, self.poll = stale_after, wait, poll
        self.generation = 0

    def _latest(self) -> int:
        return max((int(n.partition(".")[0]) for n in names_in(self.spark, self.folder) if n.endswith(".claim")), default=0)

    def _file(self, generation: int, kind: str = "claim") -> str:
        return f"{self.folder}/{generation:012d}.{kind}"

    def _free(self, generation: int) -> bool:
        return (generation == 0 or path_exists(self.spark, self._file(generation, "done"))
                or age(self.spark, self._file(generation)) > self.stale_after)

    def _take(self, generation: int) -> bool:
        try:
            write_text(self.spark, self._file(generation), self.token, overwrite=False)
        except Py4JJavaError:  # someone else made it
            return False
        # Where storage lets two writers create one file, the later one holds it.
        return read_text(self.spark, self._file(generation)) == self.token

    def __enter__(self) -> "Claim":
        until = time.time() + self.wait
        while True:
            latest = self._latest()
            if self._free(latest) and self._take(latest + 1):
                self.generation = latest + 1
                return self
            if time.time() > until:
                raise TimeoutError(f"{self.folder} is held by another run")
            time.sleep(self.poll)

    def check(self) -> None:
        """Before each change: still ours, and heard of."""
        if self._latest() != self.generation or read_text(self.spark, self._file(self.generation)) != self.token:
            raise ClaimLost(self.folder)
        fs, p, _ = filesystem(self.spark, self._file(self.generation))
        fs.setTimes(p, int(time.time() * 1000), -1)

    def __exit__(self, *error) -> None:
        write_text(self.spark, self._file(self.generation, "done"), self.token)
        fs, _, jvm = filesystem(self.spark, self.folder)
        for name in names_in(self.spark, self.folder):
            if int(name.partition(".")[0]) < self.generation:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), False)
