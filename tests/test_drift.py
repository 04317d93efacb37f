import json

from recordweave.operators import drift
from test_references import ENTITIES, SCHEMAS


def schema(name, version, **fields):
    return (name, version, json.dumps({"fields": fields}), "", f"2025-0{min(version, 9)}-01")


def text(d, **more):
    return {"type": "string", "description": d} | more


def entity(i, version, doc, seq=1):
    return (f"r{i}", "thing", version, doc if doc is None else json.dumps(doc), i % 7 == 0, "", "", seq, [], [])


def changes(spark, entities, schemas):
    found = drift.p2_found(spark.createDataFrame(entities, ENTITIES).selectExpr("*", "1 AS path", "2 AS value", "3 AS version"), spark.createDataFrame(schemas, SCHEMAS))
    return {(r.version, r.field, r.change, r.former_field) for r in found.where("record_type = 'thing'").collect()}


ONE = {"place": text("Town or district of the work."), "size": {"type": "integer", "description": "Units in hand."}, "note": text("Remark of the trader.")}
TWO = {"venue": text("District or town where the work is done."), "size": {"type": "string", "description": "Units in hand."}, "note": ONE["note"], "fee": {"type": "number", "description": "Charge."}}


def test_declared_changes_and_repeated_registration(spark):
    schemas = [schema("thing", 1, **ONE), schema("thing", 4, **TWO), schema("thing", 4, **TWO)]
    assert changes(spark, [], schemas) == {(4, "venue", "renamed", "place"), (4, "size", "retyped", ""), (4, "fee", "added", "")}
    assert changes(spark, [], [schema("thing", 1, **ONE), schema("thing", 2, size=ONE["size"], note=ONE["note"])]) == {(2, "place", "removed", "")}


def test_undeclared_changes(spark):
    places = ["north", "south", "east", "west", "mid"]
    rows = [entity(i, 1, {"place": places[i % 5], "size": i, "note": "n"}) for i in range(40)]
    rows += [entity(i, 2, {"site": places[i % 5], "size": str(i) if i % 4 == 0 else i + 0.5, "extra": [i], "rare": 1 if i == 41 else None, "note": None}) for i in range(40, 80)]
    rows += [entity(i, 3, {"site": places[i % 5], "size": str(i), "extra": [i], "note": "back"}) for i in range(80, 120)]
    rows += [entity(40, 2, {"ghost": 1}, seq=0), entity(200, 2, None)]  # an older row of an id; a row without a doc
    schemas = [schema("thing", v, **ONE) for v in (1, 2, 3)]
    assert changes(spark, rows, schemas) == {(2, "site", "renamed", "place"), (2, "size", "retyped", ""), (2, "extra", "unregistered", ""), (2, "note", "removed", "")}


def test_consistent_table_reports_failed_casts(spark):
    rows = [entity(1, 1, {"place": "north", "size": 3}), entity(2, 2, {"venue": "south", "size": "many", "fee": "free", "odd": 1})]
    schemas = spark.createDataFrame([schema("thing", 1, **ONE), schema("thing", 2, **TWO)], SCHEMAS)
    got = {r.id: r for r in drift.consistent_table(spark.createDataFrame(rows, ENTITIES), schemas, "thing").collect()}
    assert (got["r1"].venue, got["r1"].size, got["r1"].failed_casts) == ("north", "3", [])
    assert (got["r2"].venue, got["r2"].fee, got["r2"].failed_casts, got["r2"].other) == ("south", None, ["fee"], {"odd": "1"})


def test_consistent_values_of_every_type(spark, tmp_path):
    from recordweave.queries.training import QUERIES

    rows = [entity(1, 1, {"place": "north", "size": 3}), entity(2, 2, {"venue": "south", "size": "many", "fee": "free", "odd": 1, "gone": None}), (*entity(3, 1, {"place": "west", "stray": [1]})[:1], "other", *entity(3, 1, {"place": "west", "stray": [1]})[2:])]
    schemas = [schema("thing", 1, **ONE), schema("thing", 2, **TWO), schema("other", 1, **ONE)]
    spark.createDataFrame(rows, ENTITIES).write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame(schemas, SCHEMAS).write.parquet(f"{tmp_path}/schemas.parquet")
    got = {tuple(r) for r in QUERIES["p2_values"](spark, str(tmp_path)).collect()}
    assert got == {
        ("thing", "r1", 1, "venue", "north", False, True), ("thing", "r1", 1, "size", "3", False, True), ("thing", "r2", 2, "venue", "south", False, True), ("thing", "r2", 2, "size", "many", False, True),
        ("thing", "r2", 2, "fee", None, True, True), ("thing", "r2", 2, "odd", "1", False, False), ("other", "r3", 1, "place", "west", False, True), ("other", "r3", 1, "stray", "[1]", False, False),
    }
    assert drift.consistent_values(spark.createDataFrame([], ENTITIES), spark.createDataFrame([], SCHEMAS)).count() == 0


def test_empty(spark):
    assert drift.p2_found(spark.createDataFrame([], ENTITIES), spark.createDataFrame([], SCHEMAS)).count() == 0


def test_files_and_nested_paths(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, ENTITIES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/entities.parquet")
        return {p.name for p in (tmp_path / "entities.parquet").glob("*.parquet")}

    usual = [entity(i, 1, {"place": "north", "size": i, "made": {"by": {"whom": "x"}, "on": 1}}) for i in range(20)]
    (first,) = write(usual)
    write([entity(i, 1, {"place": "south", "size": i, "made": {"by": {"whom": "y"}, "on": 2}}) for i in range(20, 40)])
    (second,) = {p.name for p in (tmp_path / "entities.parquet").glob("*.parquet")} - {first}
    before = {p.name for p in (tmp_path / "entities.parquet").glob("*.parquet")}
    (odd,) = write([entity(i, 1, {"size": "many", "made": {"by": {"whom": "z"}, "at": 1}}) for i in range(40, 50)]) - before
    entities = spark.read.parquet(f"{tmp_path}/entities.parquet")
    stats = drift.path_statistics(drift.current_records(entities))
    paths = {(r.file, r.path, r.json_type): r.n for r in stats.collect()}
    assert paths[first, "made.by.whom", "string"] == 20 and paths[odd, "made.at", "integer"] == 10 and paths[odd, "", ""] == 10
    assert (odd, "made.on", "integer") not in paths
    found = {(r.file, r.path, r.change): r.n for r in drift.file_changes(stats).collect()}
    assert found == {(odd, "place", "removed"): 10, (odd, "size", "retyped"): 10, (odd, "made.at", "added"): 10, (odd, "made.on", "removed"): 10, (first, "made.at", "removed"): 20, (second, "made.at", "removed"): 20}
    schemas = spark.createDataFrame([schema("thing", 1, **ONE)], SCHEMAS)
    assert {tuple(r) for r in drift.failed_casts(entities, schemas).collect()} == {(odd, "thing", 1, "size", 10, 10)}
