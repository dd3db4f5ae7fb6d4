import json

import pytest

from idloom.operators.registry import Registry, ingested, linted

META = "http://json-schema.org/draft-07/schema#"
CRATE, CRATE2, LID = "gts.yard.stock.crate.box.v1~", "gts.yard.stock.crate.box.v2~", "gts.yard.stock.part.lid.v1~"
B17, B18 = f"{CRATE}yard.stock.crate.b17.v1.0", f"{CRATE}yard.stock.crate.b18.v1.0"


def schema(own, props, required=(), **more):
    return {"$$id": own, "$$schema": META, "type": "object", "properties": props, "required": list(required), **more}


def registry(spark, docs):
    return Registry.of(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "seq long, content string"))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def pairs(spark, *rows, names="old string, new string"):
    return spark.createDataFrame(list(rows), names)


def box(own=B17, **more):
    return {"gtsId": own, "tare": 4} | more


#: A whole number of kilograms and at most two seals.
SPEC = {"tare": {"type": "integer", "minimum": 1}, "seals": {"type": "array", "items": {"type": "string"}, "maxItems": 2}}


def test_last_content_first_position(spark):
    r = registry(spark, [{"id": "a", "v": 1}, {"id": "b"}, {"id": "a", "v": 2}])
    assert [(x.id, x.ord, json.loads(x.content).get("v")) for x in r.entities.orderBy("ord").collect()] == [("a", 0, 2), ("b", 1, None)]
    assert json.loads(r.get("a").first().content)["v"] == 2 and [x.id for x in r.ids(0).collect()] == ["a"] and [x.id for x in r.ids(-1, clamp=False).collect()] == ["a"]


def test_instances(spark):
    wrong = {f"{CRATE}yard.stock.crate.b{i}.v1.0": (more, error) for i, (more, error) in enumerate([
        ({"tare": 0}, "/tare must be >= 1"),
        ({"seals": ["r", "s", "t"]}, "/seals must NOT have more than 2 items"),
        ({"seals": ["r", 7]}, "/seals/1 must be string"),
        ({"tare": 2.5}, "/tare must be integer"),
    ])}
    lone = "gts.x.y.z.t.v1~x.y.z.u.v1"
    r = registry(spark, [schema(CRATE, SPEC, ["tare"]), box(), {"gtsId": B18, "seals": []}, {"id": "loose"}, {"gtsId": lone}, *(box(i, **more) for i, (more, _) in wrong.items())])
    got = {x.id: x for x in r.validate_instances(ids(spark, B17, B18, "loose", "none", lone, *wrong)).collect()}
    assert got[B17].ok and got[B17].error == ""
    assert got[B18].error == "/ must have required property 'tare'"
    assert got["loose"].error == "No schema found for instance: loose" and got["none"].error == "Entity not found: none"
    assert got[lone].error == "Schema not found: gts.x.y.z.t.v1~"
    assert {i: got[i].error for i in wrong} == {i: e for i, (_, e) in wrong.items()}


def test_references_between_schemas(spark):
    r = registry(spark, [schema(LID, {"hinges": {"type": "integer", "multipleOf": 2}}), schema(CRATE, {"lid": {"$ref": f"gts://{LID}"}}), box(lid={"hinges": 3})])
    assert r.validate_instances(ids(spark, B17)).first().error == "/lid/hinges must be multiple of 2"


def test_reference_constraints(spark):
    bay = {"type": "string", "x-gts-ref": "gts.yard.*"}
    kind = {"x-gts-ref": "/$$id", "type": "string"}
    lost = f"{LID}yard.stock.part.gone.v3"
    many = {B17: box(bay=CRATE, kind=B17), B18: box(B18, bay=lost), f"{CRATE}a.b.c.d.v1": box(f"{CRATE}a.b.c.d.v1", bay="dock 4")}
    r = registry(spark, [schema(CRATE, SPEC | {"bay": bay, "kind": kind}), *many.values()])
    got = {x.id: x.error for x in r.validate_instances(ids(spark, *many)).collect()}
    why = "x-gts-ref validation failed: "
    assert list(map(got.get, many)) == ["", f"{why}Referenced entity '{lost}' not found in registry", f"{why}Value 'dock 4' is not a valid GTS identifier"]


def test_relationships_and_graph(spark):
    gone = f"{LID}yard.stock.part.gone.v1.0"
    r = registry(spark, [schema(CRATE, {"lid": {"$ref": f"gts://{LID}"}}), box(lid={"$ref": gone}, bays=[CRATE, "dock"])])
    x = {y.id: y for y in r.relationships(ids(spark, B17, "none")).collect()}
    assert x[B17].relationships == sorted([CRATE, gone]) and x[B17].brokenReferences == [gone]
    assert x["none"].error == "Entity not found: none"
    tree = json.loads(r.graph(ids(spark, B17)).first().tree)
    assert tree["refs"]["lid.$ref"] == {"id": gone, "errors": ["Entity not found"]} and tree["refs"]["bays[0]"]["id"] == CRATE and tree["schema_id"] == {"id": CRATE}
    assert {(y.id, y.ref) for y in r.broken_references().collect()} == {(B17, gone), (CRATE, META), (CRATE, LID)}


@pytest.mark.parametrize(
    ("props", "required", "library", "registry_"),
    [
        (SPEC | {"marks": {"type": "array"}}, ["tare"], ([], []), ([], [])),
        ({"seals": SPEC["seals"], "gross": {"type": "integer"}}, ["gross"], (["Required property 'tare' removed in new schema"], ["New required property 'gross' added"]), (["Added required properties: gross"], ["Removed required properties: tare"])),
        (SPEC | {"tare": {"type": "number", "minimum": 1}}, ["tare"], ([], ["Property 'tare' type incompatibly changed from integer to number"]), (["Property 'tare' type changed from integer to number"],) * 2),
        (SPEC | {"seals": {"type": "array", "items": {"type": "string"}, "maxItems": 1}}, ["tare"], ([], []), (["Property 'seals' maxItems decreased from 2 to 1"], [])),
    ],
)
def test_compatibility(spark, props, required, library, registry_):
    r = registry(spark, [schema(CRATE, SPEC, ["tare"]), schema(CRATE2, props, required)])
    for flavor, (b, f), direction in (("library", library, "upgrade"), ("registry", registry_, "unknown")):
        x = r.compatibility(pairs(spark, (CRATE, CRATE2)), flavor).first()
        assert (x.backward_errors, x.forward_errors, x.is_fully_compatible, x.direction) == (b, f, not b and not f, direction)


def test_compatibility_of_missing(spark):
    r = registry(spark, [schema(CRATE, SPEC)])
    x = r.compatibility(pairs(spark, (CRATE, CRATE2))).first()
    assert x.backward_errors == [f"New schema not found: {CRATE2}"] and x.forward_errors == [] and not x.is_forward_compatible
    assert r.compatibility(pairs(spark, (CRATE, CRATE2)), "registry").first().forward_errors == ["Schema not found"]


def test_cast(spark):
    marks = {"marks": {"type": "array", "default": ["none"]}}
    lid = {"lid": {"type": "object", "properties": {"color": {"type": "string", "default": "grey"}}, "additionalProperties": False}}
    minor = "gts.yard.stock.crate.box.v1.0~yard.stock.crate.b17.v1.0"
    stated = box(f"{CRATE}yard.stock.crate.b19.v1.0", **{"$schema": CRATE})
    r = registry(spark, [schema(CRATE, SPEC, ["tare"]), schema(CRATE2, SPEC | marks | lid, ["tare"]), box(extra=1), box(minor), box(B18, lid={"hinges": 2}), stated])
    to = lambda own, flavor: r.cast(pairs(spark, (own, CRATE2), names="id string, to string"), flavor).first()
    assert to(minor, "library").error == "Source schema not found: gts.yard.stock.crate.box.v1.0~"
    x = to(B17, "library")
    assert x.ok and json.loads(x.result) == {"gtsId": B17.replace("v1.0", "v2.0"), "tare": 4, "marks": ["none"]}
    x = to(B18, "registry")
    assert x.ok and json.loads(x.casted_entity) == box(B18, lid={"color": "grey"}, marks=["none"]) and x.added_properties == ["lid.color", "marks"] and x.removed_properties == ["lid.hinges"]
    assert to(stated["gtsId"], "registry").error == "Source must be an instance, not a schema"


def test_query_and_attributes(spark):
    docs = [{"gtsId": f"gts.{v}.b.c.d.v1~{v}.b.c.e.v1.{i}", "n": i, "load": {"unit": "kg", "steps": [1, {"k": None}]}} for i, v in enumerate(("a", "a", "b"))]
    r = registry(spark, docs)
    assert r.query_result("gts.a.*")["count"] == 2 and r.query_result("gts.a.*[n=1]")["items"] == [json.dumps(docs[1])]
    assert r.query_result("gts.a.*", 1)["count"] == 1 and r.query_result("a*")["error"]
    assert r.query("gts.a.*", None).count() == r.query("gts.a.*", float("nan")).count() == 2
    with pytest.raises(ValueError, match="unbounded"):
        r.query_result("gts.a.*", None)
    assert r.query_response("gts.a.*", 1) == {"error": "", "count": 1, "limit": 1, "results": [json.dumps(docs[0])]} and r.query_response("a*")["error"]
    assert [x.id for x in r.query_ids("gts.*", 2).collect()] == [docs[0]["gtsId"], docs[1]["gtsId"]] and r.query_bool(lambda q: q("gts.*") & ~q("gts.a.*")).count() == 1
    own = docs[0]["gtsId"]
    want = {"load.unit": '"kg"', "load.steps[1].k": "null", "load.steps.0": "1", "load.steps.length": "2", "load.steps[9]": None, "missing": None, "": json.dumps(docs[0], separators=(",", ":"))}
    got = {x.path: x for x in r.attributes(spark.createDataFrame([(own, p) for p in want], "id string, path string")).collect()}
    assert {p: x.value for p, x in got.items()} == want and got["load.steps[1].k"].resolved and not got["missing"].resolved
    at = {x.path: x for x in r.attributes_at(spark.createDataFrame([(f"{own}@n",), ("no at",)], "at string")).collect()}
    assert at["n"].value == "0" and at["no at"].error == "Invalid attribute path: missing @"


def test_saved_registry_prunes_scans(spark, tmp_path, capsys):
    docs = [{"gtsId": f"gts.{v}.b.c.d.v1~{v}.b.c.e.v1.{i}"} for i, v in enumerate("aab")] + [{"id": "plain"}]
    registry(spark, docs).save(str(tmp_path / "r"))
    saved = Registry.load(spark, str(tmp_path / "r"))
    assert [x.ord for x in saved.query("gts.a.*", None).collect()] == [0, 1] and saved.query_ids("gts.*").count() == 3
    saved.query("gts.a.*", None).explain()
    assert "EqualTo(first_vendor,a)" in capsys.readouterr().out


BASE = "gts.yard.stock.crate.base.v1~"
CHILD = f"{BASE}yard.stock.crate.child.v1~"


@pytest.mark.parametrize(
    ("base", "child", "error"),
    [
        ({"properties": {"n": {"type": "string", "maxLength": 5}}}, {"n": {"type": "string", "maxLength": 4}}, ""),
        ({"properties": {"n": {"type": "string", "maxLength": 5}}}, {"n": {"type": "string", "maxLength": 6}}, "Property 'n' loosens 'maxLength' from 5 to 6"),
        ({"properties": {"n": {"type": "string", "maxLength": 5}}}, {"n": {"type": "string"}}, "Property 'n' drops constraint 'maxLength'"),
        ({"properties": {"n": {"type": "string", "maxLength": 5}}}, {"n": {"type": "string", "minLength": 1}}, ""),
        ({"properties": {"n": {"type": "string"}}}, {"n": False}, "Property 'n' is set to false but exists in base"),
        ({"properties": {"n": {"type": "string"}}}, {"n": {"type": ["string", "null"]}}, "Property 'n' widens type from 'string' to array"),
        ({"properties": {}, "additionalProperties": False}, {"m": {}}, "Property 'm' not in base and base has additionalProperties: false; Base has additionalProperties: false but derived does not restate it"),
        ({"properties": {"n": {"enum": ["a", "b"]}}}, {"n": {"enum": ["c"]}}, "Property 'n' enum value 'c' not in base enum"),
        ({"properties": {"n": {"minimum": 3}}}, {"n": {"const": 2}}, "Property 'n' const 2 violates base minimum 3"),
    ],
)
def test_parents(spark, base, child, error):
    r = registry(spark, [{"$$id": BASE, "$$schema": META, "type": "object"} | base, {"$$id": CHILD, "$$schema": META, "allOf": [{"$$ref": f"gts://{BASE}"}, {"properties": child}]}])
    assert r.validate_schemas(ids(spark, CHILD)).first().error == error


def test_cycles_and_missing_parents(spark):
    r = registry(spark, [{"$$id": CHILD, "$$schema": META, "allOf": [{"$ref": f"gts://{BASE}"}]}, {"$$id": BASE, "$$schema": META, "allOf": [{"$ref": f"gts://{CHILD}"}]}, {"$$id": CRATE, "$$schema": META, "allOf": [{"$ref": "gts://none"}]}])
    got = {x.id: x.error for x in r.validate_schemas(ids(spark, CHILD, CRATE)).collect()}
    assert got == {CHILD: f"Cyclic reference detected: {CHILD}", CRATE: "Parent schema not found: none"}


TS = {"type": "object", "properties": {"color": {"type": "string"}, "size": {"type": "integer", "default": 1}}, "additionalProperties": False}


@pytest.mark.parametrize(
    ("base", "child", "schema_error", "entity_error"),
    [
        ({"x-gts-traits-schema": TS}, {"x-gts-traits": {"color": "red"}}, "", ""),
        ({"x-gts-traits-schema": TS}, {}, "trait property 'color' is not resolved: no value provided and no default defined", "Entity defines x-gts-traits-schema but no x-gts-traits values are provided"),
        ({"x-gts-traits-schema": TS}, {"x-gts-traits": {"color": 5}}, "trait validation: /color must be string", ""),
        ({"x-gts-traits-schema": TS, "x-gts-traits": {"color": "red"}}, {"x-gts-traits": {"color": "blue"}}, "", ""),
        ({}, {"x-gts-traits": {"color": "blue"}}, "x-gts-traits values provided but no x-gts-traits-schema is defined in the inheritance chain", ""),
        ({"x-gts-traits-schema": TS}, {"x-gts-traits": {"color": "a"}, "x-gts-traits-schema": {"properties": {"size": {"default": 2}}}}, f"trait schema default for 'size' in '{CHILD}' overrides default set by ancestor", "Trait schema must set additionalProperties: false for entity validation"),
        ({"x-gts-traits-schema": {"type": "array"}}, {}, 'x-gts-traits-schema must have type "object", got "array"', "Entity defines x-gts-traits-schema but no x-gts-traits values are provided"),
    ],
)
def test_traits(spark, base, child, schema_error, entity_error):
    r = registry(spark, [{"$$id": BASE, "$$schema": META} | base, {"$$id": CHILD, "$$schema": META, "allOf": [{"$$ref": f"gts://{BASE}"}]} | child])
    assert r.validate_schemas(ids(spark, CHILD)).first().error == schema_error
    assert r.validate_entity_traits(ids(spark, CHILD)).first().error == entity_error


def test_locked_traits(spark):
    leaf = f"{CHILD}yard.stock.crate.leaf.v1~"
    r = registry(spark, [{"$$id": BASE, "$$schema": META, "x-gts-traits-schema": TS}, {"$$id": CHILD, "$$schema": META, "x-gts-traits": {"color": "red"}}, {"$$id": leaf, "$$schema": META, "x-gts-traits": {"color": "blue"}}])
    assert r.validate_schemas(ids(spark, leaf)).first().error == f"trait 'color' in '{leaf}' overrides value set by ancestor"


def test_entities(spark):
    r = registry(spark, [schema(BASE, {}), {"id": f"{BASE}yard.stock.crate.x.v1.0"}])
    got = {x.id: (x.ok, x.entity_type, x.error) for x in r.validate_entities(ids(spark, BASE, f"{BASE}yard.stock.crate.x.v1.0", "none")).collect()}
    assert got == {BASE: (True, "schema", ""), f"{BASE}yard.stock.crate.x.v1.0": (True, "instance", ""), "none": (False, "unknown", "Entity not found: none")}


def test_lint_and_ingest(spark):
    cases = [
        ({"$schema": META}, "Schema must have a $id or $$id field"),
        ({"$schema": META, "$id": BASE}, "Schema $id with GTS identifier must use gts:// URI format (e.g., gts://gts.vendor.pkg.ns.type.v1~)"),
        ({"$schema": META, "$id": "x"}, "Schema $id must be a valid GTS identifier with gts:// URI format"),
        ({"$schema": META, "$id": "gts://gts.a.*"}, "Schema $id cannot contain wildcards"),
        ({"$schema": META, "$id": "gts://bad"}, "Schema $id is not a valid GTS identifier: bad"),
        ({"$schema": META, "$id": f"gts://{BASE}", "a": {"b": [{"$ref": BASE}]}}, "Invalid $ref at a/b[0]/$ref: GTS references must use gts:// URI format"),
        ({"$schema": META, "$id": f"gts://{BASE}", "a": {"$ref": "http://x.org"}}, "Invalid $ref at a/$ref: external HTTP references are not allowed"),
        ({"$schema": META, "$id": f"gts://{BASE}", "a": {"$ref": "#/b"}}, None),
        ({"id": "x"}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)], "i int, content string")
    assert {r.i: r.lint for r in linted(df).collect()} == {i: e for i, (_, e) in enumerate(cases)}
    got = {r.i: (r.status, r.reason) for r in ingested(df, validate=True).collect()}
    assert got[7] == (200, None) and got[8] == (422, "Instance must have a valid GTS ID or type field") and got[0][0] == 422
    bad = {"$schema": META, "$id": f"gts://{BASE}", "properties": {"p": {"x-gts-ref": "q"}}}
    row = ingested(spark.createDataFrame([(json.dumps(bad),), ("{}",)], "content string")).collect()
    assert row[0].reason == "x-gts-ref validation failed: properties/p/x-gts-ref: Invalid x-gts-ref value: 'q' must start with 'gts.' or '/'" and row[1].status == 400
