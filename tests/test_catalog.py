import pytest
from pyspark.sql import functions as F

from tecflow.catalog import tables as C


@pytest.fixture
def bus(spark, tmp_path):
    return C.commands(C.Catalog(spark, str(tmp_path / "catalog")))


def config(project, **over):
    return {"project_id": project, "stations": ["YEL2"], "systems": ["GPS"], "metrics": ["ROTI"], "first": "2024-03-24", "last": "2024-03-24"} | over


def test_project_task_lifecycle(spark, bus, tmp_path):
    roots = tmp_path / "data"
    roots.mkdir()
    for n in ("yel20840.24o", "igs20240840000.sp3"):
        (roots / n).write_text("x")
    project = bus.dispatch("project.create", {"name": "p", "roots": [str(roots)]}).data["project_id"]
    assert bus.dispatch("project.scanFiles", {"project_id": project}).data == {"OBS": 1, "SP3": 1}
    cat = C.Catalog(spark, str(tmp_path / "catalog"))
    cat.put("stations", [{"project_id": project, "station": "YEL2"}])
    found = bus.dispatch("task.validate", {"config": config(project)}).data
    assert found["valid"] and found["chain"] == "EXPERIMENTAL"
    bad = bus.dispatch("task.validate", {"config": config(project, stations=["YEL2", "NONE"], metrics=["SIGMA_PHI_F"], last="2024-03-25")}).data
    assert {"STATION_NOT_FOUND", "OBS_FILE_MISSING", "SIGMA_PHI_F_PRODUCTS_MISSING"} <= {i.code for i in bad["issues"]} and not bad["valid"]
    task = bus.dispatch("task.create", {"config": config(project)}).data["task_id"]
    assert cat.read("sub_tasks").where(F.col("task_id") == task).count() == 1
    assert bus.dispatch("task.start", {"task_id": task}).data["status"] == "RUNNING"
    assert bus.dispatch("task.start", {"task_id": task}).code == "UNHANDLED_EXCEPTION"
    assert bus.dispatch("task.stop", {"task_id": task}).data["status"] == "STOPPED"
    bus.dispatch("project.delete", {"project_id": project})
    assert not bus.dispatch("task.list").data and cat.read("sub_tasks").count() == 0


def test_required_fields_and_switches(spark, bus):
    codes = lambda **o: {i.code for i in bus.dispatch("task.validate", {"config": config("p", **o)}).data["issues"]}
    assert codes(stations=[], systems=[], metrics=[]) == {"STATION_IDS_REQUIRED", "SYSTEMS_REQUIRED", "METRICS_REQUIRED"}
    assert "DATE_RANGE_INVALID" in codes(last="2024-01-01")
    assert "NON_GPS_SIGMA_PHI_DISABLED" in codes(systems=["GAL"], metrics=["SIGMA_PHI_F"])
    assert "DIXSG_NEEDS_TWO_STATIONS" in codes(metrics=["DIXSG"])


def test_settings_templates_and_unknown_channels(bus):
    assert bus.dispatch("no.such").code == "CHANNEL_NOT_FOUND"
    assert bus.dispatch("task.get", {"task_id": "x"}).code == "NOT_FOUND"
    bus.dispatch("settings.update", {"thresholds": {"ROTI": 0.7}})
    assert bus.dispatch("settings.get").data["thresholds"] == C.DEFAULTS["thresholds"] | {"ROTI": 0.7}
    assert bus.dispatch("template.save", {"name": "t", "config": {"a": 1}}).success
    assert not bus.dispatch("template.save", {"name": "t", "config": {}}).success
    assert bus.dispatch("template.save", {"name": "t", "config": {"a": 2}, "strategy": "OVERWRITE"}).data["name"] == "t"
    assert bus.dispatch("template.save", {"name": "t", "config": {}, "strategy": "CREATE_NEW"}).data["name"] != "t"
    assert len(bus.dispatch("template.list").data) == 2
