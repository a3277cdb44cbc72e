"""RINEX 2 and 3 observation files as one row per satellite and epoch.

Files are read through Spark's own readers, so any store Spark knows will do.
read_observations takes a file as one task's work; read_epochs cuts files of
version 3 at their epochs, so that one large file is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Which observation stands for each role, the most preferred first, by system.
PRIORITIES = {
    "G": {"l1": ("L1W", "L1C", "L1P", "L1"), "l2": ("L2W", "L2L", "L2C", "L2P", "L2"), "c1": ("C1W", "C1C", "C1P", "C1", "P1"), "c2": ("C2W", "C2L", "C2C", "C2P", "C2", "P2"), "s1": ("S1C", "S1W", "S1"), "s2": ("S2W", "S2X", "S2P", "S2C", "S2")},
    "R": {"l1": ("L1P", "L1C"), "l2": ("L2P", "L2C"), "c1": ("C1P", "C1C"), "c2": ("C2P", "C2C"), "s1": ("S1P", "S1C"), "s2": ("S2P", "S2C")},
    "E": {"l1": ("L1C",), "l2": ("L5Q", "L5X", "L5C"), "c1": ("C1C",), "c2": ("C5Q", "C5X", "C5C"), "s1": ("S1C",), "s2": ("S5Q", "S5X", "S5C")},
    "C": {"l1": ("L2I", "L1C", "L1P"), "l2": ("L6I", "L6C", "L7I", "L7Q"), "c1": ("C2I", "C1C"), "c2": ("C6I", "C6C", "C7I"), "s1": ("S2I", "S1C"), "s2": ("S6I", "S6C", "S7I")},
}
ROLES = ("l1", "l2", "c1", "c2", "s1", "s2")
#: Phase roles fall back to any code of these bands.
BANDS = {"l1": ("L1",), "l2": ("L2", "L5", "L6", "L7")}

OBSERVATIONS = T.StructType(
    [T.StructField("station", T.StringType()), T.StructField("system", T.StringType()), T.StructField("sat", T.StringType()), T.StructField("prn", T.IntegerType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("epoch", T.LongType())]
    + [T.StructField(r, T.DoubleType()) for r in ROLES]
)
HEADERS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("path", "station", "version", "receiver", "antenna")]
    + [T.StructField(n, T.DoubleType()) for n in ("interval_s", "x", "y", "z", "h", "e", "n")]
    + [T.StructField("obs_types", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("unsupported", T.ArrayType(T.StringType()))]
)


class Header:
    """What the lines up to END OF HEADER say."""

    def __init__(self, lines: Iterator[str]):
        self.version, self.station, self.receiver, self.antenna = "", "", "", ""
        self.interval, self.position, self.offset = None, (None, None, None), (None, None, None)
        self.types: dict[str, list[str]] = {}
        system = ""
        for line in lines:
            body, label = line[:60], line[60:].strip()
            if label == "END OF HEADER":
                break
            if label == "RINEX VERSION / TYPE":
                self.version, system = body[:9].strip(), body[40:41].strip()
            elif label == "MARKER NAME":
                self.station = body.strip()[:4].upper()
            elif label == "REC # / TYPE / VERS":
                self.receiver = body[20:40].strip()
            elif label == "ANT # / TYPE":
                self.antenna = body[20:40].strip()
            elif label == "APPROX POSITION XYZ":
                self.position = numbers(body, 3)
            elif label == "ANTENNA: DELTA H/E/N":
                self.offset = numbers(body, 3)
            elif label == "INTERVAL":
                self.interval = number(body)
            elif label == "SYS / # / OBS TYPES":
                if body[:1].strip():
                    current = self.types.setdefault(body[0], [])
                current += body[6:].split()
            elif label == "# / TYPES OF OBSERV":
                self.types.setdefault("*", []).extend(body[6:].split())

    @property
    def modern(self) -> bool:
        return float(self.version or 3) >= 3

    def of(self, system: str) -> list[str]:
        return self.types.get(system) or self.types.get("*", [])

    def places(self, system: str) -> dict[str, int]:
        """Place of each role among the system's observations: by priority for phases, by the file's order for the rest."""
        kinds, out = [k.upper() for k in self.of(system)], {}
        for role, wanted in PRIORITIES[system].items():
            found = [i for i, k in enumerate(kinds) if k in wanted]
            if role in BANDS:
                found.sort(key=lambda i: wanted.index(kinds[i]))
                found = found or [i for i, k in enumerate(kinds) if k.startswith(BANDS[role])]
            if found:
                out[role] = found[0]
        return out


def number(text: str) -> float | None:
    """A number; blank or not one is missing, and so is zero."""
    try:
        return float(text) or None
    except ValueError:
        return None


def numbers(text: str, n: int) -> tuple:
    found = [float(x) for x in text.split()[:n]]
    return tuple(found + [None] * (n - len(found)))


def values(line: str, places: dict[str, int]) -> dict[str, float | None]:
    return {role: number(line[16 * i : 16 * i + 14]) for role, i in places.items()}


def epochs_of_version_3(lines: Iterator[str]) -> Iterator[tuple[datetime, list[tuple[str, str]]]]:
    for line in lines:
        if not line.startswith(">"):
            continue
        flag, n = int(line[31:32].strip() or 0), int(line[32:35])
        rows = [next(lines, "") for _ in range(n)]
        if flag <= 1:
            yield moment(line[2:29].split()), [(r[:3].replace(" ", "0"), r[3:]) for r in rows]


def epochs_of_version_2(lines: Iterator[str], n_types: int) -> Iterator[tuple[datetime, list[tuple[str, str]]]]:
    """Satellites run on over lines of twelve, their values over lines of five."""
    per = max(1, -(-n_types // 5))
    for line in lines:
        if not line.strip():
            continue
        flag, n = int(line[28:29].strip() or 0), int(line[29:32].strip() or 0)
        if flag > 1:
            for _ in range(n):
                next(lines, "")
            continue
        names = line[32:68]
        for _ in range((n - 1) // 12):
            names += next(lines, "")[32:68]
        sats = [(names[3 * i : 3 * i + 3]) for i in range(n)]
        rows = ["".join(next(lines, "").ljust(80)[:80] for _ in range(per)) for _ in sats]
        parts = line[:26].split()
        year = int(parts[0])
        parts[0] = str(year + (1900 if year >= 80 else 2000))
        yield moment(parts), [((s[0].strip() or "G") + s[1:].replace(" ", "0"), r) for s, r in zip(sats, rows, strict=True)]


def moment(parts: list[str]) -> datetime:
    year, month, day, hour, minute = map(int, parts[:5])
    return datetime(year, month, day, hour, minute) + timedelta(seconds=round(float(parts[5]), 6))


def observations(text: str, name: str = "", systems: str = "GREC", max_epochs: int | None = None, step: int = 30) -> Iterator[tuple]:
    """Rows of OBSERVATIONS; satellites of other systems are skipped as they are read."""
    lines = iter(text.splitlines())
    head = Header(lines)
    station = head.station or name[:4].upper()
    places = {s: head.places(s) for s in systems if head.of(s)}
    found = epochs_of_version_3(lines) if head.modern else epochs_of_version_2(lines, len(head.types.get("*", [])))
    for k, (ts, rows) in enumerate(found):
        if max_epochs is not None and k >= max_epochs:
            return
        epoch = round((ts.hour * 3600 + ts.minute * 60 + ts.second + ts.microsecond / 1e6) / step) + 1
        for sat, line in rows:
            if sat[0] in places:
                got = values(line, places[sat[0]])
                yield (station, sat[0], sat, int(sat[1:]), ts, epoch, *(got.get(r) for r in ROLES))


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of files, directories or patterns."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")


def base_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def read_observations(spark: SparkSession, paths: str | list[str], systems: str = "GREC", max_epochs: int | None = None) -> DataFrame:
    """OBSERVATIONS of all files. Files without an observation give no rows."""

    def parse(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(observations(bytes(content).decode("utf-8", "ignore"), base_name(path), systems, max_epochs))
                yield pd.DataFrame(rows, columns=OBSERVATIONS.names)

    return files(spark, paths).mapInPandas(parse, OBSERVATIONS)


#: Headers that are broadcast at most, and bytes they may have; salts that epochs are dealt out by beyond that.
HEADERS_SENT, HEADER_BYTES, SALTS = 200_000, 32 << 20, 64


def epoch_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, start, value): the text of each epoch of version 3, from behind its mark to before the next one; what is before the first one is the header. start: byte at which the piece of the file begins that it was read with."""
    lines = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", "true").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def layouts(blocks: DataFrame, systems: str) -> DataFrame:
    """(path, station, places) of the files of epoch_blocks: for each of systems the place of each of ROLES among its values, -1 for none."""

    def parse(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            rows = []
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                h = Header(iter(text.splitlines()))
                places = {s: [h.places(s).get(r, -1) for r in ROLES] for s in systems if h.of(s)}
                if h.modern:
                    rows.append((path, h.station or base_name(path)[:4].upper(), places))
            yield pd.DataFrame(rows, columns=["path", "station", "places"])

    schema = "path string, station string, places map<string, array<int>>"
    return blocks.where((F.col("start") == 0) & F.contains("value", F.lit("END OF HEADER"))).mapInPandas(parse, schema)


def read_epochs(spark: SparkSession, paths: str | list[str], systems: str = "GREC", since: str | None = None, until: str | None = None, step: int = 30) -> DataFrame:
    """OBSERVATIONS of files of version 3, as read_observations gives them, cut into pieces of spark.sql.files.maxPartitionBytes.

    A task holds an epoch at a time. Epochs before since and from until on (times as
    text) and other systems go before their values are read. Epochs with an event
    flag, and files of other versions, give no rows. Headers come from the files' first pieces; if
    there are few they are broadcast, otherwise epochs meet them by file and a salt.
    """
    blocks = epoch_blocks(spark, paths)
    line = F.transform(F.split("value", "\n"), lambda x: F.rtrim(x))
    parts = F.split(F.trim(F.substring(F.get("l", F.lit(0)), 2, 27)), " +")
    part = lambda k: F.get(parts, F.lit(k)).try_cast("int")
    flag, many = F.coalesce(F.trim(F.substring(F.get("l", F.lit(0)), 31, 1)).try_cast("int"), F.lit(0)), F.trim(F.substring(F.get("l", F.lit(0)), 32, 3)).try_cast("int")
    rows = blocks.where(~F.contains("value", F.lit("END OF HEADER"))).select("path", line.alias("l")).where(flag <= 1)
    second = F.round(F.get(parts, F.lit(5)).try_cast("double"), 6)
    rows = rows.select("path", F.try_make_timestamp_ntz(*map(part, range(5)), F.lit(0)).alias("ts"), second.alias("second"), F.slice("l", F.lit(2), F.greatest(many, F.lit(0))).alias("l"))
    rows = rows.withColumn("ts", F.timestamp_add("MICROSECOND", F.round(F.col("second") * 1e6).cast("long"), F.col("ts"))).where("ts is not null")
    for bound, keep in ((since, lambda t: F.col("ts") >= t), (until, lambda t: F.col("ts") < t)):
        if bound is not None:
            rows = rows.where(keep(F.lit(bound).cast("timestamp_ntz")))
    rows = rows.select("path", "ts", F.explode(F.filter("l", lambda x: F.contains(F.lit(systems), F.substring(x, 1, 1)) & (F.trim(x) != ""))).alias("v"))

    heads = layouts(blocks, systems)
    files_, size = heads.agg(F.count("*"), F.sum(F.length("path") + 64 * F.size("places"))).first()
    if files_ <= HEADERS_SENT and (size or 0) <= HEADER_BYTES:
        rows = rows.join(F.broadcast(heads), "path")
    else:
        salted = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["path", "_salt"])
    sat = F.replace(F.substring("v", 1, 3), F.lit(" "), F.lit("0"))
    rows = rows.withColumns({"sat": sat, "at": F.col("places")[F.substring("v", 1, 1)]}).where("at is not null")
    value = lambda k: F.nullif(F.trim(F.substr(F.col("v"), 4 + 16 * F.get("at", F.lit(k)), F.lit(14))).try_cast("double"), F.lit(0.0))
    of_day = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.extract(F.lit("SECOND"), F.col("ts")).cast("double")
    return rows.select(
        "station", F.substring("sat", 1, 1).alias("system"), "sat", F.substring("sat", 2, 2).try_cast("int").alias("prn"), "ts", (F.rint(of_day / step) + 1).cast("long").alias("epoch"),
        *[F.when(F.get("at", F.lit(k)) >= 0, value(k)).alias(role) for k, role in enumerate(ROLES)],
    )


def header_row(path: str, text: str) -> tuple:
    h = Header(iter(text.splitlines()))
    known = {k: v for k, v in h.types.items() if k in PRIORITIES or k == "*"}
    return (path, h.station or base_name(path)[:4].upper(), h.version, h.receiver, h.antenna, h.interval, *h.position, *h.offset, known, sorted(set(h.types) - set(known)))


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """HEADERS of all files; unsupported lists systems this library has no bands for."""

    def parse(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            rows = [header_row(p, bytes(c).decode("utf-8", "ignore")) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=HEADERS.names)

    return files(spark, paths).mapInPandas(parse, HEADERS)


def with_carriers(obs: DataFrame) -> DataFrame:
    """obs with both carrier frequencies of each satellite."""
    from ..functions import signal as X

    f1, f2 = X.carriers(F.col("system"), F.col("prn"))
    return obs.withColumn("f1", f1).withColumn("f2", f2)
