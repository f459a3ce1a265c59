"""Which version of each day of a visits table counts: a small manifest beside the days.

The visits of a day lie in `visit_day=D/version=N`. A day begins with version 0; whoever rewrites or forgets it
writes the next version beside it and then names that one in a new manifest. Manifests are numbered files that
appear whole under their name and are never changed, so a reader sees every day in one version, and all changes of a
manifest at once. A run that ends before its manifest is there has changed nothing that counts. Folders
of versions that no longer count stay for a while, for readers that began before, and are then removed.

One writer at a time; readers at any time.
"""

import json
import time
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from footfall.schemas import PARTITION_COLUMN, VERSION_COLUMN
from footfall.sources.files import children, exists, read_text, remove, rename, write_text

# Spark does not read folders with such a name as part of the table.
MANIFESTS = "_versions"
# Where the table's summaries are (sources/summaries.py), by kind and then in the folders of the days.
SUMMARIES = "_summaries"
# How long a version that no longer counts stays for its readers.
KEEP_REPLACED = timedelta(hours=1)
# Manifests that are left beside the last.
EARLIER_MANIFESTS = 3


@dataclass(frozen=True)
class Manifest:
    """`current` names the days whose version is not 0, `replaced` folders to be removed: day, version, since when."""

    number: int
    current: dict[str, int]
    replaced: list[tuple[str, int, float]]

    def version(self, day: date | str) -> int:
        return self.current.get(str(day), 0)


def day_folder(path: str, day: date | str, version: int | None = None) -> str:
    folder = f"{path}/{PARTITION_COLUMN}={day}"
    return folder if version is None else f"{folder}/{VERSION_COLUMN}={version}"


def day_names(spark: SparkSession, path: str) -> list[str]:
    """Days that have a folder."""
    start = f"{PARTITION_COLUMN}="
    return [name[len(start) :] for name in children(spark, path) if name.startswith(start)]


def read_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The last manifest; None where the table does not exist or is older than versions."""
    numbers = [name for name in children(spark, f"{path}/{MANIFESTS}") if name.endswith(".json")]
    if not numbers:
        return None
    said = json.loads(read_text(spark, f"{path}/{MANIFESTS}/{numbers[-1]}"))
    return Manifest(int(numbers[-1][:-5]), said["current"], [tuple(folder) for folder in said["replaced"]])


def manifest_to_write_by(spark: SparkSession, path: str) -> Manifest:
    """The last manifest, or the first one of a new table or of one older than versions."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        for day in day_names(spark, path):
            _adopt(spark, path, day)
        manifest = _write(spark, path, Manifest(0, {}, []))
    return manifest


def _adopt(spark: SparkSession, path: str, day: str) -> None:
    """Move the files of a day into its version 0; running it again goes on where it stopped."""
    for name in children(spark, day_folder(path, day)):
        if not name.startswith(f"{VERSION_COLUMN}="):
            rename(spark, f"{day_folder(path, day)}/{name}", f"{day_folder(path, day, 0)}/{name}")


def _write(spark: SparkSession, path: str, manifest: Manifest) -> Manifest:
    name = f"{path}/{MANIFESTS}/{manifest.number:012}.json"
    if exists(spark, name):
        raise OSError(f"another writer has changed {path}")
    write_text(spark, f"{name}.tmp", json.dumps({"current": manifest.current, "replaced": manifest.replaced}))
    rename(spark, f"{name}.tmp", name)
    return manifest


def commit(spark: SparkSession, path: str, manifest: Manifest, changes: dict[str, int]) -> Manifest:
    """From now on these days have these versions; all of them at once."""
    since = time.time()
    replaced = [*manifest.replaced, *[(day, manifest.version(day), since) for day in changes]]
    return _write(spark, path, Manifest(manifest.number + 1, manifest.current | changes, replaced))


def sweep(spark: SparkSession, path: str, keep: timedelta = KEEP_REPLACED) -> None:
    """Remove folders of versions that have not counted for a while, and days of which nothing is left."""
    manifest = read_manifest(spark, path)
    over = [] if manifest is None else [f for f in manifest.replaced if f[2] <= time.time() - keep.total_seconds()]
    if not over:
        return
    current = dict(manifest.current)
    for day, version, _ in over:
        # Their summaries first: a day that begins anew must find none.
        for kind in children(spark, f"{path}/{SUMMARIES}"):
            remove(spark, day_folder(f"{path}/{SUMMARIES}/{kind}", day, version))
        remove(spark, day_folder(path, day, version))
    for day in {day for day, _, _ in over}:
        if not children(spark, day_folder(path, day)):
            remove(spark, day_folder(path, day))
            current.pop(day, None)
    left = [folder for folder in manifest.replaced if folder not in over]
    last = _write(spark, path, Manifest(manifest.number + 1, current, left))
    for name in children(spark, f"{path}/{MANIFESTS}"):
        if name < f"{last.number - EARLIER_MANIFESTS:012}":
            remove(spark, f"{path}/{MANIFESTS}/{name}")


def version_of_day(manifest: Manifest) -> Column:
    """The version that counts of a row's day."""
    if not manifest.current:
        return F.lit(0)
    days, versions = zip(*sorted(manifest.current.items()))
    changed = F.map_from_arrays(
        F.array(*[F.lit(date.fromisoformat(day)) for day in days]), F.array(*[F.lit(version) for version in versions])
    )
    return F.coalesce(F.try_element_at(changed, F.col(PARTITION_COLUMN)), F.lit(0))
