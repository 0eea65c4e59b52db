"""Snapshot layouts, headers and external archives of arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .arrays import arrays
from .fixtures import Header

#: Folder and file of a snapshot in each suite. Fixed values; suite B has one file and no folder.
LAYOUTS = {
    "A": ("{root}/snapdir_{snapshot:03d}/", "{root}/snapdir_{snapshot:03d}/snap_{snapshot:03d}.{chunk}.hdf5"),
    "B": ("{root}/snapshots/snap_{sim}_{snapshot}.hdf5", "{root}/snapshots/snap_{sim}_{snapshot}.hdf5"),
    "C": ("{root}/snapshots/flamingo_{snapshot:04d}/swift_snapshot_{snapshot:04d}/", "{root}/snapshots/flamingo_{snapshot:04d}/flamingo_{snapshot:04d}.hdf5"),
}
#: Snapshot numbers of the external archives by redshift. Fixed values.
ARCHIVE_SNAPSHOTS = {0.0: 264, 0.5: 214, 1.0: 179}


def location(root: str, suite: str, snapshot: int, sim: str | None = None, chunk: int = 0, folder: bool = False) -> str:
    """Where a snapshot's file lies, or with ``folder`` its chunks; ValueError for an unknown suite."""
    if suite not in LAYOUTS:
        raise ValueError(f"unknown suite: {suite}")
    if suite == "B" and not sim:
        raise ValueError("suite B needs the simulation's name")
    return LAYOUTS[suite][0 if folder else 1].format(root=root.rstrip("/"), snapshot=snapshot, sim=sim, chunk=chunk)


def header_of(attributes: DataFrame, suite: str, n: int = 64) -> Header:
    """The header from a table of one row of attributes, in the first suite's units.

    Suite C has lengths in cMpc without h; ValueError if there isn't one row.
    """
    rows = attributes.take(2)
    if len(rows) != 1:
        raise ValueError("a header has one row")
    r: Row = rows[0]
    h = float(r["h"])
    box = float(r["box"]) * (1000 * h if suite == "C" else 1)
    return Header(box, h, float(r["omega_m"]), float(r["omega_b"]), float(r["redshift"]), n)


def particle_counts(attributes: DataFrame, suite: str) -> DataFrame:
    """(ptype, n) of all files. Suite C's totals overflow 32 bits; there the counts of its one virtual file hold."""
    source = "n_this_file" if suite == "C" else "n_total"
    return attributes.select(F.posexplode(source).alias("ptype", "n")).groupBy("ptype").agg((F.max("n") if suite != "C" else F.sum("n")).cast("long").alias("n"))


def archive_snapshot(z: float) -> int:
    if z not in ARCHIVE_SNAPSHOTS:
        raise ValueError(f"no archive at redshift {z}")
    return ARCHIVE_SNAPSHOTS[z]


def array_parts(spark: SparkSession, pattern: str, columns: tuple[str, ...], **options) -> DataFrame:
    """(part, idx, columns) of arrays stored as .npy files ``…part<number>_of…``, each read in ranges by several tasks.

    ``part`` and ``idx`` give the order of the arrays put together. A file of one dimension fills the first column.
    """
    return arrays(spark, pattern, "part int, idx long, " + ", ".join(f"{c} double" for c in columns), **options)
