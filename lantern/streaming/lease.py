"""One run at a time: a lease on a folder that all machines share, with a fencing number.

A lease is a file whose creation fails where it exists already, which the file system decides for all machines.
Its name holds a number that rises with each lease. A holder renews it; one that is silent longer than
its time has lost it, and the next run takes the next number. Writers that note the number refuse
what comes with a lower one (`fence`), so a run that was thought dead can't do harm when it wakes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


class Refused(RuntimeError):
    """Another run holds the lease, or a later one has taken it over."""


@dataclass
class Lease:
    """A held lease: `number` rises from run to run."""

    leases: Leases
    number: int
    owner: str

    def renew(self) -> None:
        """Prolong the lease; refused if another run has taken over since."""
        if self.leases._newest() != self.number:
            raise Refused(f"lease {self.number} was taken over")
        self.leases._write(f"{self.number:012d}.beat", {"owner": self.owner, "at": self.leases.clock()}, True)

    def release(self) -> None:
        self.leases._write(f"{self.number:012d}.done", {"owner": self.owner}, True)

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class Leases:
    """The leases of one kind of run, in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str, lasts: float = 600.0, clock: Callable[[], float] = time.time) -> None:
        self.lasts, self.clock = lasts, clock
        jvm = spark._jvm
        self._path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}" if name else folder)
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path())

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path())]

    def _newest(self) -> int:
        return max((int(n.partition(".")[0]) for n in self._names() if n.endswith(".lease")), default=0)

    def _write(self, name: str, value: dict, over: bool) -> None:
        out = self._fs.create(self._path(name), over)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()) or b"{}")
        finally:
            stream.close()

    def live(self) -> int | None:
        """The number of the lease that a living run holds."""
        number, names = self._newest(), set(self._names())
        if not number or f"{number:012d}.done" in names:
            return None
        beat = f"{number:012d}.beat"
        # A file that is just being written has no time yet: its run lives.
        at = self._read(beat if beat in names else f"{number:012d}.lease").get("at", self.clock())
        return number if self.clock() - at < self.lasts else None

    def acquire(self) -> Lease:
        """Take the lease; refused while another run holds it."""
        held = self.live()
        if held is not None:
            raise Refused(f"lease {held} is held")
        number, owner = self._newest() + 1, uuid.uuid4().hex
        try:
            self._write(f"{number:012d}.lease", {"owner": owner, "at": self.clock()}, False)
        except Exception as error:  # another run was first
            raise Refused(f"lease {number} went to another run") from error
        return Lease(self, number, owner)

    def fence(self, number: int) -> None:
        """Refuse work under a number that is no longer the newest."""
        if number < self._newest():
            raise Refused(f"lease {number} is older than lease {self._newest()}")
