import json

import pytest
from garden import BEDS, PLANTS, SOILS
from pyspark.sql import functions as F

from quern.database import Database
from quern.errors import Conflict, Forbidden, NotFound, RequestError
from quern.operators import metrics
from quern.sources.log import BufferedLog, EncryptedLog, MemoryLog, ParquetLog
from quern.streaming import feed

JOINS = [{"earth": {"from": "soils", "on": "soil"}}, {"place": {"from": "beds", "on": "bed"}}]


class Clock:
    def __init__(self, now=86_400_000):
        self.now = now

    def __call__(self):
        return self.now


@pytest.fixture(scope="module")
def db(spark):
    db = Database(spark, clock=Clock())
    for name, data in (("soils", SOILS), ("beds", BEDS), ("plants", PLANTS)):
        db.set({"collection": name, "data": data})
    return db


def keys(db, **body):
    return [d["_key"] for d in db.get({"collection": "plants", **body})]


def those(test):
    return {k for k, p in PLANTS.items() if test(p)}


@pytest.mark.parametrize("where, test", [
    ({"seed.origin.region": {"$ne": "north"}}, lambda p: p["seed"]["origin"]["region"].lower() != "north"),
    ({"name": {"$contains": "AGE"}}, lambda p: "age" in p["name"].lower()),
    ({"uses": {"$contains": "bees"}}, lambda p: "bees" in p["uses"]),
    ({"name": "LOVAGE"}, lambda p: p["name"] == "Lovage"),
    ({"height": {"$gte": 40, "$lessThan": 90}}, lambda p: 40 <= p["height"] < 90),
    ({"height": {"$oneOf": [30, 67, 1]}}, lambda p: p["height"] in (30, 67, 1)),
    ({"name": {"$nin": ["MINT", "dill"]}}, lambda p: p["name"] not in ("mint", "Dill")),
    ({"name": {"$notIn": []}}, lambda p: True),
    ({"$or": [{"name": "tansy"}, {"hardy": False}, {"seed.grams": {"$gt": 1.4}}]}, lambda p: p["name"] == "tansy" or not p["hardy"] or p["seed"]["grams"] > 1.4),
    ([{"hardy": True}, {"seed.origin.year": {"$lte": 2004}}], lambda p: p["hardy"] and p["seed"]["origin"]["year"] <= 2004),
    ({}, lambda p: True),
])
def test_where(db, where, test):
    assert set(keys(db, where=where)) == those(test)


def test_empty_membership_is_not_found(db):
    with pytest.raises(NotFound):
        db.get({"collection": "plants", "where": {"name": {"$in": []}}})


@pytest.mark.parametrize("where, test", [
    ({"place.edge": {"$in": ["BRICK"]}}, lambda p: BEDS[p["bed"]]["edge"] == "Brick"),
    ({"earth.drains": True}, lambda p: SOILS.get(p["soil"], {}).get("drains") is True),
    ({"earth.absent": {"$eq": None}}, lambda p: True),
    ({"earth.ph": {"$ne": 4.5}}, lambda p: SOILS.get(p["soil"], {}).get("ph") != 4.5),
])
def test_where_on_a_joined_field(db, where, test):
    assert {r["_key"] for r in db.find({"collection": "plants", "joins": JOINS, "where": where}).collect()} == those(test)


def test_joins_in_one_element_and_in_many(db):
    """Of an element's members the first object that names a source counts."""
    one = db.find({"collection": "plants", "joins": [{"note": {"x": 1}, "earth": {"from": "soils", "on": "soil"}, "place": {"from": "beds", "on": "bed"}}]})
    assert "earth" in one.columns and "place" not in one.columns
    rows = db.find({"collection": "plants", "joins": JOINS, "order": "asc"}).select("_key", F.try_variant_get("earth", "$.depth", "int").alias("depth"), F.try_variant_get("place", "$.sun", "int").alias("sun")).collect()
    assert [(r["depth"], r["sun"]) for r in rows] == [(SOILS.get(p["soil"], {}).get("depth"), BEDS[p["bed"]]["sun"]) for p in PLANTS.values()]


def test_sorts(db):
    by_height = sorted(PLANTS, key=lambda k: (-PLANTS[k]["height"], k))
    assert keys(db, sort={"field": "height", "order": "desc"}) == by_height
    rows = db.find({"collection": "plants", "joins": JOINS, "sort": {"field": "place.sun", "order": "desc"}}).select(F.try_variant_get("place", "$.sun", "int").alias("sun")).collect()
    assert [r["sun"] for r in rows] == sorted((BEDS[p["bed"]]["sun"] for p in PLANTS.values()), reverse=True)
    assert keys(db) == list(PLANTS)[::-1]
    assert keys(db, order="asc", offset=2, count=3) == list(PLANTS)[2:5]
    assert [d["_key"] for d in (json.loads(x) for x in db.page("plants", 3, 1).toJSON().collect())] == list(PLANTS)[::-1][1:4]


def test_scans_that_share_a_pass(db):
    bodies = [{"collection": "plants", "where": {"hardy": True}, "count": 2}, {"collection": "plants", "order": "asc", "offset": 1, "count": 3}, {"collection": "plants", "where": {"name": {"$in": []}}}, {"collection": "plants", "where": {"height": {"$gt": 60}}}]
    got = {}
    for r in db.many(bodies).collect():
        got.setdefault(r["request"], {})[r["place"]] = r["_key"]
    for n, b in enumerate(bodies):
        alone = [r["_key"] for r in db.find(b).collect()]
        assert [got.get(n, {}).get(k) for k in range(1, len(alone) + 1)] == alone and len(got.get(n, {})) == len(alone)
    with pytest.raises(RequestError):
        db.many([bodies[0], {"collection": "soils"}])


def test_projection(db):
    p = PLANTS["plant_3"]
    assert db.get({"collection": "plants", "keys": "plant_3", "fields": ["seed.origin.year", "height", "none"]}) == {"_v": 1, "height": p["height"], "seed": {"origin": {"year": 2003}}}
    left = db.get({"collection": "plants", "keys": "plant_3", "excludedFields": ["seed.origin", "uses", "soil", "bed"]})
    assert left == {"_v": 1, "name": "fennel", "height": p["height"], "hardy": p["hardy"], "seed": {"grams": 0.75}}
    assert db.get({"collection": "plants", "keys": "plant_3", "fields": []}) == {"_v": 1}
    assert db.get({"collection": "plants", "keys": "plant_3", "fields": ["_createdAt"]})["_createdAt"] == "1970-01-02T00:00:00Z"


@pytest.mark.parametrize("body", [
    {"count": 1001}, {"fields": [], "excludedFields": []}, {"order": "sideways"}, {"order": "asc", "sort": "height"}, {"extra": 1}, {"where": {"a": {"$like": "x"}}},
    {"where": {"a..b": 1}}, {"where": {"$or": [{"it's": 1}]}}, {"where": {"$and": [{"$or": [{'a"b': 1}]}]}}, {"keys": "a b"}, {"joins": {}}, {"where": "x"}, {"fields": ["a."]},
])
def test_requests_that_are_refused(db, body):
    assert db.request("get", {"collection": "plants", **body})["statusCode"] == 400


def test_other_refusals(db):
    assert db.request("get", {"collection": "system"})["statusCode"] == 400 and db.request("get", {"collection": "no_such"})["statusCode"] == 404
    assert db.request("set", {"collection": "plants", "data": {"a": {"_seq": 1}}})["statusCode"] == 400
    assert db.request("update", {"collection": "plants", "data": {"plant_1": 7}})["statusCode"] == 400
    assert db.request("set", {"collection": "plants", "data": 7})["statusCode"] == 400


def test_mixed_types(spark):
    db = Database(spark)
    values = {"v": "seven", "w": 7, "x": [7, 8], "y": 70, "z": None}
    db.set({"collection": "mixed", "data": {k: {"size": x} if x is not None else {} for k, x in values.items()}})
    assert {d["_key"] for d in db.get({"collection": "mixed", "where": {"size": {"$gt": 6}}})} == {"w", "y"}
    assert [d["_key"] for d in db.get({"collection": "mixed", "sort": ["size", "none"]})] == ["v", "w", "y", "x", "z"]


def test_versions_and_update(spark):
    db = Database(spark)
    db.set({"collection": "beds", "data": {k: {"n": 0, "deep": {"a": 1, "b": 2}} for k in "pqrs"}})
    assert db.update({"collection": "beds", "data": {"p": {"deep": {"a": 9}}, "none": {"n": 1}}}) == {"count": 1}
    assert db.get({"collection": "beds", "keys": "p"}) == {"_v": 2, "n": 0, "deep": {"a": 9}}
    with pytest.raises(Conflict):  # q comes before r and stays applied, s comes after it
        db.update({"collection": "beds", "data": {"s": {"n": 5}, "r": {"_v": 7, "n": 5}, "q": {"_v": 1, "n": 5}}})
    assert [(d["_key"], d["_v"], d["n"]) for d in db.get({"collection": "beds", "order": "asc"})] == [("p", 2, 0), ("q", 2, 5), ("r", 1, 0), ("s", 1, 0)]
    before = db.next_ord
    db.update({"collection": "beds", "data": {k: {"n": 6} for k in "pqrs"}})
    assert db.next_ord == before + 6  # one batch
    db.set({"collection": "beds", "data": {"p": {"n": 1}}})
    assert db.get({"collection": "beds", "keys": "p"}) == {"_v": 4, "n": 1}


def test_deletes_and_caps(spark):
    db = Database(spark)
    db.set({"collection": "rows", "data": {f"r{n}": {"even": n % 2 == 0} for n in range(8)}})
    assert db.delete({"collection": "rows", "where": {"even": True}, "count": 3}) == {"count": 3}
    left = ["r1", "r3", "r5", "r6", "r7"]
    assert [d["_key"] for d in db.get({"collection": "rows", "order": "asc"})] == left
    db.delete({"collection": "rows", "count": 1, "order": "desc"})
    assert db.delete({"collection": "rows", "keys": ["r1", "none"]}) == {"count": 2}
    assert [d["_key"] for d in db.get({"collection": "rows", "order": "asc"})] == left[1:-1]
    db.delete({"collection": "rows", "drop": True})
    with pytest.raises(NotFound):
        db.get({"collection": "rows"})
    for names in ("klmno", "pq"):
        db.set({"collection": "last", "data": {k: {"t": k} for k in names}, "maxSize": 4})
    assert [d["_key"] for d in db.get({"collection": "last"})] == ["q", "p", "o", "n"]


def test_extends_and_uuid_keys(spark):
    db = Database(spark)
    db.set({"collection": "soils", "data": SOILS})
    out = db.set({"collection": "pots", "data": [{"n": n, "extends": {"earth": f"soils.soil-{n}", "lid": "lids.none", "odd": "soils"}} for n in (2, 9)]})
    docs = [db.get({"collection": "pots", "keys": k}) for k in out["keys"]]
    assert docs == [{"_v": 1, "n": 2, "earth": SOILS["soil-2"]}, {"_v": 1, "n": 9}] and out["keys"][0][14] == "7"


def test_expiry_and_sweep(spark):
    clock = Clock()
    db = Database(spark, clock=clock)
    db.set({"collection": "brief", "data": {"a": {"x": 1}}, "ttl": 20})
    db.set({"collection": "lasting", "data": {"a": {"x": 1}}})
    assert db.next_expiry() == clock.now + 20_000 and db.sweep() == []
    clock.now += 20_000
    with pytest.raises(NotFound):
        db.get({"collection": "brief"})
    assert db.stats({"collection": "brief"}).first()["count"] == 0
    assert db.sweep() == ["brief"] and db.sweep() == []
    db.set({"collection": "brief", "data": {"a": {"x": 2}}})
    assert db.get({"collection": "brief", "keys": "a"}) == {"_v": 1, "x": 2} and db.get({"collection": "lasting", "keys": "a"})["x"] == 1


def test_clear(spark):
    db = Database(spark)
    db.schema({"collection": "a", "schema": {"type": "object", "required": ["x"]}})
    db.set({"collection": "a", "data": {"k": {"x": 1}}})
    db.set({"collection": "b", "data": {"k": {"y": 1}}})
    assert db.clear() == {"cleared": 2} and list(db.catalog) == []
    again = Database(spark, db.log)
    assert again.state().count() == 0
    again.set({"collection": "a", "data": {"k": {"z": 1}}})  # its schema is gone
    assert again.get({"collection": "a", "keys": "k"}) == {"_v": 1, "z": 1}


SCHEMA = {
    "type": "object", "required": ["kind"], "minProperties": 2, "maxProperties": 4, "definitions": {"size": {"type": "number", "multipleOf": 0.5, "minimum": 1}},
    "properties": {"kind": {"enum": ["pot", "tray"]}, "size": {"$ref": "#/definitions/size"}, "tags": {"type": "array", "uniqueItems": True, "contains": {"const": "in use"}}, "made": {"format": "date"}, "lid": {"not": {"type": "null"}}},
    "oneOf": [{"required": ["size"]}, {"required": ["tags"]}], "anyOf": [{"properties": {"kind": {"const": "pot"}}}, {"properties": {"size": {"maximum": 3}}}],
    "additionalProperties": {"type": "boolean"},
}


@pytest.mark.parametrize("doc, good", [
    ({"kind": "pot", "size": 4.5}, True), ({"kind": "pot", "size": 4.2}, False), ({"kind": "pot", "size": 0.5}, False), ({"kind": "jar", "size": 2}, False),
    ({"kind": "pot"}, False), ({"kind": "pot", "size": 2, "tags": ["in use"]}, False), ({"kind": "pot", "tags": ["in use", "x"]}, True), ({"kind": "pot", "tags": ["x", "x", "in use"]}, False),
    ({"kind": "pot", "tags": ["x"]}, False), ({"kind": "tray", "size": 2}, True), ({"kind": "tray", "size": 5}, False), ({"kind": "pot", "size": 2, "made": "2020-02-30"}, True),
    ({"kind": "pot", "size": 2, "made": "2020-2-3"}, False), ({"kind": "pot", "size": 2, "lid": None}, False), ({"kind": "pot", "size": 2, "lid": 1}, True), ({"kind": "pot", "size": 2, "more": True}, True),
    ({"kind": "pot", "size": 2, "more": 1}, False), ({"kind": "pot", "size": 2, "a": True, "b": True, "c": True}, False),
])
def test_schema_keywords(spark, doc, good):
    from quern.functions.jsonschema import valid

    row = spark.createDataFrame([(json.dumps(doc),)], "d string").select(valid(F.parse_json("d"), SCHEMA).alias("ok")).first()
    assert row["ok"] is good


def test_schema_guards_writes(spark):
    db = Database(spark)
    db.schema({"collection": "pots", "schema": SCHEMA})
    db.set({"collection": "pots", "data": {"a": {"kind": "pot", "size": 2}}})
    for bad in ({"kind": 1, "size": 2}, {"size": 2}):
        with pytest.raises(RequestError):
            db.set({"collection": "pots", "data": {"b": bad}})
    assert db.request("update", {"collection": "pots", "data": {"a": {"kind": "jar"}}})["statusCode"] == 400
    for unknown in ({"typ": "object"}, {"$ref": "#/none"}, {"properties": {"a": {"$ref": "#"}}}):
        assert db.request("schema", {"collection": "pots", "schema": unknown})["statusCode"] == 400
    assert db.stats({"collection": "pots"}).first()["count"] == 1


def test_snapshot_recovery_and_reopening(spark, tmp_path):
    clock, path = Clock(), str(tmp_path / "log")
    db = Database(spark, ParquetLog(spark, path), clock)
    start = clock.now
    db.set({"collection": "two", "data": {"k1": {"n": 1}}})
    clock.now += 70
    db.set({"collection": "one", "data": {"k2": {"n": 2}}})
    assert [r["key"] for r in db.recover(to_time=start + 30).collect()] == ["k1"]
    assert [r["key"] for r in db.recover(to_seq=3).collect()] == ["k1"]
    db.snapshot()
    assert [r["key"] for r in db.recover(to_seq=1).collect()] == ["k2"]  # by collection, then sequence number
    db.set({"collection": "two", "data": {"k1": {"n": 3}}})
    again = Database(spark, ParquetLog(spark, path), clock)
    assert again.get({"collection": "two", "keys": "k1"}) == {"_v": 2, "n": 3}
    again.set({"collection": "two", "data": {"k3": {"n": 4}}})
    assert again.get({"collection": "two", "keys": "k3", "fields": ["_seq"]})["_seq"] == 1


@pytest.mark.parametrize("damage", ["cut", "lost"])
def test_a_damaged_snapshot_falls_back_to_the_log(spark, tmp_path, damage):
    path = tmp_path / "log"
    db = Database(spark, ParquetLog(spark, str(path)))
    db.set({"collection": "c", "data": {f"k{n}": {"n": n} for n in range(6)}})
    db.snapshot()
    db.set({"collection": "c", "data": {"k6": {"n": 6}}})
    for f in (path / "g1" / "snapshot").glob("*.parquet"):
        f.write_bytes(f.read_bytes()[:40]) if damage == "cut" else f.unlink()
    for f in (path / "g1" / "snapshot").glob(".*.crc"):
        f.unlink()
    again = Database(spark, ParquetLog(spark, str(path)))
    assert again.log.base == 0 and again.log.generation == 1 and again.stats({"collection": "c"}).first()["count"] == 7
    again.set({"collection": "c", "data": {"k7": {"n": 7}}})
    assert Database(spark, ParquetLog(spark, str(path))).stats({"collection": "c"}).first()["count"] == 8


def test_torn_batch_is_discarded(spark):
    log = MemoryLog(spark)
    db = Database(spark, log)
    db.set({"collection": "c", "data": {"a": {"x": 1}}})
    log.rows = log.rows.where("cmd != 'TX_COMMIT'")
    assert Database(spark, log).state().count() == 0


def test_buffered_log(spark):
    inner = MemoryLog(spark)
    log = BufferedLog(inner, 3)
    db = Database(spark, log)
    for n in range(2):
        db.set({"collection": "c", "data": {f"k{n}": {"n": n}}})
    assert inner.read().count() == 0 and db.stats({"collection": "c"}).first()["count"] == 2
    db.set({"collection": "c", "data": {"k2": {"n": 2}}})
    assert inner.read().where("cmd = 'INSERT'").count() == 3 and not log.held
    inner.append = lambda rows: 1 / 0
    db.set({"collection": "c", "data": {"k3": {"n": 3}}})
    with pytest.raises(RequestError):
        log.flush()
    assert db.request("set", {"collection": "c", "data": {"k4": {"n": 4}}})["statusCode"] == 503
    assert db.stats({"collection": "c"}).first()["count"] == 4


def test_encrypted_log(spark):
    inner = MemoryLog(spark)
    db = Database(spark, EncryptedLog(inner, "open sesame", 1000))
    db.set({"collection": "secrets", "data": {"keyname": {"word": "visible"}}})
    seen = " ".join(str(r) for r in inner.read().collect())
    assert not any(x in seen for x in ("visible", "secrets", "keyname", "INSERT"))
    assert Database(spark, EncryptedLog(inner, "open sesame", 1000)).get({"collection": "secrets", "keys": "keyname"})["word"] == "visible"
    assert Database(spark, EncryptedLog(inner, "another", 1000)).state().count() == 0
    db.snapshot()
    assert Database(spark, EncryptedLog(inner, "open sesame", 1000)).get({"collection": "secrets", "keys": "keyname"})["word"] == "visible"
    other = MemoryLog(spark)
    EncryptedLog(other, "open sesame", 1000)
    assert other.read().first()["value"] != inner.read().where("cmd = 'KEY_SALT'").first()["value"]


def test_scopes(db):
    body = {"collection": "plants", "order": "asc"}
    assert [d["_key"] for d in db.get(body, ["read:plants:plant_2", "read:plants:plant_6"])] == ["plant_2", "plant_6"]
    assert len(db.get(body, ["read:plants:plant*"])) == len(PLANTS)
    for refused, scopes in ((body, ["write:plants:*"]), ({"collection": "plants", "keys": ["plant_3"]}, ["read:plants:plant_2"])):
        with pytest.raises(Forbidden):
            db.get(refused, scopes)


def test_metrics(db):
    docs, heights = db.catalog["plants"].documents(), [p["height"] for p in PLANTS.values()]
    of = lambda kind, where=None: metrics.metric(docs, {"type": kind, "field": "height"}, where).first()["result"]
    assert (of("COUNT"), of("SUM"), of("MIN"), of("MAX")) == (len(heights), sum(heights), min(heights), max(heights))
    assert of("COUNT", {"hardy": True}) == len(those(lambda p: p["hardy"])) and of("AVG") == pytest.approx(sum(heights) / len(heights))
    assert {r["collection"]: r["count"] for r in db.stats({}).collect()} == {"soils": len(SOILS), "beds": len(BEDS), "plants": len(PLANTS), None: len(SOILS) + len(BEDS) + len(PLANTS)}


def test_other_events(spark):
    db = Database(spark)
    db.schema({"collection": "c", "schema": {"type": "object"}})
    db.set({"collection": "c", "data": {"a": {"x": 1}}, "ttl": 5})
    assert {r["event"] for r in feed.events(db.log.read()).collect()} == {"SCHEMA_SET", "change", "ttl_expiry"}


def test_change_feed_as_a_stream(spark, tmp_path):
    db = Database(spark, ParquetLog(spark, str(tmp_path / "log")))
    db.set({"collection": "c", "data": {"a": {"x": 1}}})
    db.delete({"collection": "c", "keys": "a"})
    db.drop("c")
    stream = feed.as_json(feed.events(feed.log_stream(spark, f"{db.log.folder}/log"), ["c"]))
    run = stream.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    found = sorted((json.loads(r["value"]) for r in spark.table("changes").collect()), key=str)
    assert [(e["event"], e["key"], e["new_v"]) for e in found] == [("change", "*", None), ("change", "a", 1), ("change", "a", None)] or {(e["key"], e["new_v"]) for e in found} == {("*", None), ("a", 1), ("a", None)}


def test_idle_expiry_as_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m) as at, 'c' as collection from values (0), (5), (60), (200) as t(m)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = feed.idle_expiry(stream, "10 minutes").writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    assert sorted(r["writes"] for r in spark.table("idle").collect()) == [1, 2]
