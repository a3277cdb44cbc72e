"""Control plane: projects, tasks and results as small Parquet tables, validation rules, the command registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import product
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sinks.files import convert, swap_in, table_there, upsert

Names = Sequence[str]


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


SCHEMAS = {
    "projects": "project_id string, name string, roots array<string>, created_at timestamp, updated_at timestamp",
    "stations": "project_id string, station string, x double, y double, z double, receiver string, antenna string, systems array<string>, first_date date, last_date date",
    "files": "project_id string, path string, name string, kind string, station string, date date, size long",
    "tasks": "task_id string, project_id string, config string, status string, chain string, created_at timestamp, updated_at timestamp",
    "sub_tasks": "task_id string, station string, date date, system string, status string",
    "logs": "task_id string, level string, message string, logged_at timestamp",
    "results": "result_id string, task_id string, metric string, station string, system string, path string, least double, most double, mean double, p95 double, missing double, events long, flags array<string>, created_at timestamp",
    "templates": "name string, config string, updated_at timestamp",
    "settings": "key string, value string",
}
KEYS = {"projects": ["project_id"], "stations": ["project_id", "station"], "files": ["project_id", "path"], "tasks": ["task_id"], "sub_tasks": ["task_id", "station", "date", "system"], "logs": ["task_id", "logged_at", "message"], "results": ["result_id"], "templates": ["name"], "settings": ["key"]}
CHILDREN = {"projects": {"stations": "project_id", "files": "project_id", "tasks": "project_id"}, "tasks": {"sub_tasks": "task_id", "logs": "task_id", "results": "task_id"}}


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Catalog:
    """Tables below one folder of any store that Spark writes to; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def there(self, name: str) -> bool:
        return table_there(self.spark, self.path(name))

    def read(self, name: str) -> DataFrame:
        if self.there(name):
            return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
        return self.spark.createDataFrame([], SCHEMAS[name])

    def put(self, name: str, rows: DataFrame | Sequence[dict]) -> DataFrame:
        """Adds rows, in place of those with the same key."""
        kinds = schema(SCHEMAS[name])
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([tuple(r.get(f) for f in kinds.names) for r in rows], kinds)
        return upsert(self.spark, self.path(name), df.select(*kinds.names), KEYS[name])

    def replace_for(self, name: str, parent: str, value: Any, rows: DataFrame) -> DataFrame:
        """All rows of one parent, put in place of those it had."""
        kept = self.read(name).where(F.col(parent) != F.lit(value))
        return self.write(name, kept.unionByName(rows.select(*kept.columns)))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table anew beside the old one, then swaps them."""
        swap_in(self.spark, df, self.path(name))
        return self.read(name)

    def delete(self, name: str, key: str, value: Any) -> None:
        """Deletes rows and, by the same key, all that hangs on them."""
        gone = self.read(name).where(F.col(key) == F.lit(value))
        for child, by in CHILDREN.get(name, {}).items():
            for r in gone.select(by).distinct().collect():
                self.delete(child, by, r[0])
        if self.there(name):
            self.write(name, self.read(name).where(F.col(key) != F.lit(value)))

    def newest(self, name: str, by: str, limit: int | None = None) -> DataFrame:
        rows = self.read(name).orderBy(F.desc(by), *KEYS[name])
        return rows if limit is None else rows.limit(limit)


@dataclass
class TaskConfig:
    project_id: str
    stations: list[str]
    systems: list[str]
    metrics: list[str]
    first: str
    last: str
    sampling: str = "STANDARD_30S"
    parameters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Issue:
    code: str
    blocks: bool
    detail: str = ""


#: Metrics that need more than observations, and what they need.
NEEDS = {"AATR": ("SP3",), "IAATR": ("SP3",), "S4C": ("SP3",), "CROT": ("SP3",), "DIXSG": ("SP3",), "SIGMA_PHI_F": ("SP3", "CLK", "ATX")}


def validate(config: TaskConfig, stations: DataFrame, files: DataFrame, settings: dict | None = None) -> tuple[list[Issue], str]:
    """(issues, chain level) of a task; what is compared with files are joins on station and day."""
    settings, issues = settings or {}, []
    for value, code in ((config.project_id.strip(), "PROJECT_ID_REQUIRED"), (config.stations, "STATION_IDS_REQUIRED"), (config.systems, "SYSTEMS_REQUIRED"), (config.metrics, "METRICS_REQUIRED")):
        if not value:
            issues.append(Issue(code, True))
    if config.first > config.last:
        issues.append(Issue("DATE_RANGE_INVALID", True, f"{config.first} > {config.last}"))
    if config.sampling != "STANDARD_30S" and not settings.get("enableExperimental1sResample"):
        issues.append(Issue("EXPERIMENTAL_1S_DISABLED", True))
    if "SIGMA_PHI_F" in config.metrics and set(config.systems) - {"GPS"} and not settings.get("enableNonGpsSigmaPhiF"):
        issues.append(Issue("NON_GPS_SIGMA_PHI_DISABLED", True))
    if "DIXSG" in config.metrics and len(config.stations) < 2:
        issues.append(Issue("DIXSG_NEEDS_TWO_STATIONS", True))
    if any(i.blocks for i in issues):
        return issues, "INCOMPLETE"
    spark = stations.sparkSession
    wanted = spark.createDataFrame([(s.upper(),) for s in config.stations], "station string")
    unknown = wanted.join(stations.select(F.upper("station").alias("station")), "station", "left_anti").collect()
    if unknown:
        issues.append(Issue("STATION_NOT_FOUND", True, ",".join(sorted(r.station for r in unknown))))
    days = wanted.select("station", F.explode(F.sequence(F.lit(config.first).cast("date"), F.lit(config.last).cast("date"), F.expr("interval 1 day"))).alias("date"))
    obs = files.where("kind = 'OBS'").select("station", "date").distinct()
    for r in days.join(obs, ["station", "date"], "left_anti").orderBy("station", "date").toLocalIterator():
        issues.append(Issue("OBS_FILE_MISSING", True, f"{r.station} {r.date}"))
    kinds = files.where("date is null").agg(F.collect_set("kind").alias("k")).first().k
    per_day = {str(r.date): set(r.k) | set(kinds) for r in files.where("date is not null").groupBy("date").agg(F.collect_set("kind").alias("k")).collect()}
    levels = []
    for r in days.select("date").distinct().orderBy("date").collect():
        there = per_day.get(str(r.date), set(kinds))
        for metric in config.metrics:
            lacking = [k for k in NEEDS.get(metric, ()) if k not in there]
            if lacking:
                fallback = lacking == ["SP3"] and "NAV" in there and settings.get("enableNavDegradedMode")
                issues.append(Issue("NAV_FALLBACK" if fallback else f"{metric}_PRODUCTS_MISSING", not fallback, f"{r.date}: {','.join(lacking)}"))
        levels.append("FORMAL" if {"SP3", "CLK", "ATX"} <= there else "EXPERIMENTAL" if "SP3" in there else "DEGRADED" if "NAV" in there else "INCOMPLETE")
    worst = max(levels, key=("FORMAL", "EXPERIMENTAL", "DEGRADED", "INCOMPLETE").index, default="INCOMPLETE")
    return issues, worst


def sub_tasks(spark: SparkSession, task_id: str, config: TaskConfig) -> DataFrame:
    """A row for every station, day and system of a task."""
    rows = [(task_id, s.upper(), y) for s, y in product(config.stations, config.systems)]
    days = F.sequence(F.lit(config.first).cast("date"), F.lit(config.last).cast("date"), F.expr("interval 1 day"))
    return spark.createDataFrame(rows, "task_id string, station string, system string").select("task_id", "station", F.explode(days).alias("date"), "system", F.lit("PENDING").alias("status"))


@dataclass
class Response:
    success: bool
    data: Any = None
    code: str = ""
    message: str = ""


class Commands:
    """Functions by channel name; what they raise becomes a response."""

    def __init__(self):
        self.known: dict[str, Callable[[dict], Any]] = {}

    def register(self, channel: str, f: Callable[[dict], Any]) -> None:
        self.known[channel] = f

    def dispatch(self, channel: str, payload: dict | None = None) -> Response:
        if channel not in self.known:
            return Response(False, code="CHANNEL_NOT_FOUND", message=channel)
        try:
            return Response(True, self.known[channel](payload or {}))
        except LookupError as e:
            return Response(False, code="NOT_FOUND", message=str(e))
        except Exception as e:  # noqa: BLE001  the envelope carries any failure to the caller
            return Response(False, code="UNHANDLED_EXCEPTION", message=f"{type(e).__name__}: {e}")


def merged(base: dict, over: dict) -> dict:
    """over laid on base, nested dictionaries key by key."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


DEFAULTS = {"thresholds": {"ROTI": 0.5, "AATR": 0.2, "IAATR": 0.2, "DIXSG": 0.5, "SIGMA_PHI_F": 0.05, "S4C": 0.25}, "enableNonGpsSigmaPhiF": False, "enableExperimental1sResample": False, "enableNavDegradedMode": False}


def commands(catalog: Catalog) -> Commands:
    """The public channels over a catalog."""
    import json

    bus, c = Commands(), catalog

    def one(name: str, key: str, value: Any) -> dict:
        row = c.read(name).where(F.col(key) == F.lit(value)).first()
        if row is None:
            raise LookupError(f"{name} {value}")
        return row.asDict(True)

    def rows(df: DataFrame, limit: int = 2000) -> list[dict]:
        return [r.asDict(True) for r in df.limit(limit).collect()]

    def settings() -> dict:
        stored = {r.key: json.loads(r.value) for r in c.read("settings").collect()}
        return merged(DEFAULTS, stored)

    def create_project(p: dict) -> dict:
        row = {"project_id": uuid4().hex, "name": p["name"], "roots": p.get("roots", []), "created_at": now(), "updated_at": now()}
        c.put("projects", [row])
        return row

    def scan_files(p: dict) -> dict:
        from ..sources.scan import scan

        project = one("projects", "project_id", p["project_id"])
        found = scan(c.spark, project["roots"]).withColumn("project_id", F.lit(p["project_id"]))
        c.replace_for("files", "project_id", p["project_id"], found)
        return {r.kind: r["count"] for r in c.read("files").where(F.col("project_id") == p["project_id"]).groupBy("kind").count().collect()}

    def check(p: dict) -> dict:
        config = TaskConfig(**p["config"])
        mine = lambda t: c.read(t).where(F.col("project_id") == config.project_id)
        issues, chain = validate(config, mine("stations"), mine("files"), settings())
        return {"issues": issues, "chain": chain, "valid": not any(i.blocks for i in issues)}

    def create_task(p: dict) -> dict:
        found = check(p)
        if not found["valid"]:
            raise ValueError(", ".join(sorted({i.code for i in found["issues"] if i.blocks})))
        row = {"task_id": uuid4().hex, "project_id": p["config"]["project_id"], "config": json.dumps(p["config"]), "status": "PENDING", "chain": found["chain"], "created_at": now(), "updated_at": now()}
        c.put("tasks", [row])
        c.put("sub_tasks", sub_tasks(c.spark, row["task_id"], TaskConfig(**p["config"])))
        return row

    def set_status(status: str, allowed: Names) -> Callable[[dict], dict]:
        def go(p: dict) -> dict:
            row = one("tasks", "task_id", p["task_id"])
            if row["status"] not in allowed:
                raise ValueError(f"a task that is {row['status']} cannot become {status}")
            if status == "STOPPED":
                c.spark.sparkContext.cancelJobGroup(row["task_id"])
            row |= {"status": status, "updated_at": now()}
            c.put("tasks", [row])
            return row

        return go

    def save_template(p: dict) -> dict:
        there = c.read("templates").where(F.col("name") == p["name"]).count()
        name, how = p["name"], p.get("strategy", "REJECT")
        if there and how == "REJECT":
            raise ValueError(f"template {name} exists")
        if there and how == "CREATE_NEW":
            name = f"{name}-{uuid4().hex[:6]}"
        row = {"name": name, "config": json.dumps(p["config"]), "updated_at": now()}
        c.put("templates", [row])
        return row

    handlers = {
        "project.create": create_project,
        "project.open": lambda p: one("projects", "project_id", p["project_id"]),
        "project.update": lambda p: c.put("projects", [one("projects", "project_id", p["project_id"]) | p | {"updated_at": now()}]) and None,
        "project.list": lambda p: rows(c.newest("projects", "updated_at")),
        "project.delete": lambda p: c.delete("projects", "project_id", p["project_id"]),
        "project.scanFiles": scan_files,
        "project.getStations": lambda p: rows(c.read("stations").where(F.col("project_id") == p["project_id"]).orderBy("station")),
        "settings.get": lambda p: settings(),
        "settings.getDefaults": lambda p: DEFAULTS,
        "settings.update": lambda p: c.put("settings", [{"key": k, "value": json.dumps(v)} for k, v in p.items()]) and settings(),
        "task.validate": check,
        "task.create": create_task,
        "task.start": set_status("RUNNING", ("PENDING", "PAUSED")),
        "task.pause": set_status("PAUSED", ("RUNNING",)),
        "task.resume": set_status("RUNNING", ("PAUSED",)),
        "task.stop": set_status("STOPPED", ("RUNNING", "PAUSED", "PENDING")),
        "task.retry": set_status("PENDING", ("FAILED", "STOPPED")),
        "task.list": lambda p: rows(c.newest("tasks", "created_at")),
        "task.get": lambda p: one("tasks", "task_id", p["task_id"]),
        "task.delete": lambda p: c.delete("tasks", "task_id", p["task_id"]),
        "task.getLogs": lambda p: rows(c.read("logs").where(F.col("task_id") == p["task_id"]).orderBy("logged_at")),
        "result.list": lambda p: rows(c.newest("results", "created_at")),
        "result.getSeries": lambda p: c.spark.read.parquet(one("results", "result_id", p["result_id"])["path"]),
        "result.export": lambda p: convert(c.spark, one("results", "result_id", p["result_id"])["path"], p["target"]),
        "template.list": lambda p: rows(c.read("templates").orderBy("name")),
        "template.get": lambda p: one("templates", "name", p["name"]),
        "template.save": save_template,
        "template.delete": lambda p: c.delete("templates", "name", p["name"]),
    }
    for channel, f in handlers.items():
        bus.register(channel, f)
    return bus
