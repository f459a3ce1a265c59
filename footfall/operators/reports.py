"""What an ingest read and what it left out."""

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from footfall.operators.requests import REASONS, judge
from footfall.sources.access_log import clean_lines, parse_lines

KEPT = "kept"


@dataclass(frozen=True)
class Report:
    """Lines and bytes that were read, and how many lines were left out for each reason or "kept".

    Blank lines are read but neither kept nor left out for a reason.
    """

    lines: int = 0
    bytes: int = 0
    reasons: dict[str, int] = field(default_factory=dict)

    def plus(self, other: "Report") -> "Report":
        names = self.reasons.keys() | other.reasons.keys()
        reasons = {name: self.reasons.get(name, 0) + other.reasons.get(name, 0) for name in sorted(names)}
        return Report(self.lines + other.lines, self.bytes + other.bytes, reasons)


class Watch:
    """Counts what passes while it is stored, so that no pass of its own is needed.

    The counts are those of the first action over the watched rows. Where an executor is lost, lines of its
    tasks that run again may count twice; `drop_reasons` counts exactly.
    """

    def __init__(self) -> None:
        self._lines, self._reasons = Observation(), Observation()

    def lines(self, lines: DataFrame) -> DataFrame:
        ended = F.sum(F.octet_length("value") + F.lit(1))
        return lines.observe(self._lines, F.count(F.lit(1)).alias("lines"), ended.alias("bytes"))

    def judged(self, judged: DataFrame) -> DataFrame:
        each = [F.count_if(F.col("drop_reason") == reason).alias(reason) for reason in REASONS]
        return judged.observe(self._reasons, *each, F.count_if(F.col("drop_reason").isNull()).alias(KEPT))

    def report(self, most_bytes: int | None = None) -> Report:
        """What was counted, after the action. `most_bytes` is the size of the files where it is known: the last line
        of a file may lack its end."""
        read, reasons = self._lines.get, self._reasons.get
        size = read["bytes"] or 0
        size = size if most_bytes is None else min(size, most_bytes)
        return Report(read["lines"], size, {name: n for name, n in sorted(reasons.items()) if n})


def consumed_per_file(lines: DataFrame) -> DataFrame:
    """Lines and bytes of every file read, line ends included; `lines` straight from read_lines.

    The last line of a file may lack its end, so no file counts more bytes than it has.
    """
    ended = F.sum(F.octet_length("value") + F.lit(1))
    return (
        lines.groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count("*").alias("lines"), F.least(ended, F.max("_metadata.file_size")).alias("bytes"))
        .orderBy("file")
    )


def drop_reasons(lines: DataFrame, internal_proxies: Iterable[str] = ()) -> DataFrame:
    """How many lines were left out for each reason, and how many were "kept"."""
    judged = judge(parse_lines(clean_lines(lines)), internal_proxies)
    return judged.groupBy(F.coalesce("drop_reason", F.lit(KEPT)).alias("drop_reason")).agg(
        F.count("*").alias("lines")
    )
