import datetime
import hashlib
import json
import urllib.error
import urllib.parse
import urllib.request

import pytest
from pyspark.sql import functions as F

from tests.lending import LIB, MAPPING, OPENED, ROOT, library, volumes
from trellis import cli
from trellis.errors import MappingError, QueryRejected, ServiceError, UnsupportedFeature
from trellis.functions import geo
from trellis.functions.values import Value, constant
from trellis.plans.cache import PlanCache
from trellis.server import Gateway
from trellis.sources.mapping import load_r2rml
from trellis.sparql import ast as A


@pytest.fixture(scope="module")
def lib(spark):
    return library(spark)


def rows(engine, text):
    return sorted((tuple(r) for r in engine.query(text).collect()), key=str)


def test_averages_of_branches(lib):
    got = rows(lib, "SELECT ?t (COUNT(?v) AS ?n) (AVG(?p) AS ?a) WHERE { ?v a lib:Volume ; lib:keptAt ?b ; lib:pages ?p . ?b lib:town ?t } GROUP BY ?t HAVING (AVG(?p) > 260) ORDER BY DESC(?a)")
    by = {f"Town {'ABCDE'[k]}": [v[2] for v in volumes() if v[4] == 11 + k] for k in range(4)}
    want = sorted(((t, len(p), sum(p) / len(p)) for t, p in by.items() if sum(p) / len(p) > 260), key=str)
    assert got == want and 0 < len(want) < 4


def test_star_is_one_scan(lib):
    plan = lib.explain("SELECT ?n ?p WHERE { ?v lib:title ?n ; lib:pages ?p ; lib:blurb ?x ; a lib:Volume }", "plan")
    assert "scan of volume for 4 pattern(s)" in plan and "Join" not in plan


def test_reference_over_parent_key_needs_no_join(lib):
    assert len(rows(lib, "SELECT ?v ?b WHERE { ?v lib:home ?b }")) == 54
    assert "Join" not in lib.explain("SELECT ?v ?b WHERE { ?v lib:home ?b }", "plan").split("Physical Plan")[1].split("(1)")[0]


def test_null_makes_no_triple(lib):
    with_blurb = sum(v[5] is not None for v in volumes())
    assert len(rows(lib, "SELECT ?v WHERE { ?v lib:blurb ?x }")) == with_blurb < 54
    assert sum(r[1] is None for r in rows(lib, "SELECT ?v ?x WHERE { ?v a lib:Volume OPTIONAL { ?v lib:blurb ?x } }")) == 54 - with_blurb
    assert rows(lib, "SELECT (COUNT(?x) AS ?n) WHERE { ?v a lib:Volume OPTIONAL { ?v lib:blurb ?x } }") == [(with_blurb,)]


def test_constants(lib):
    assert rows(lib, f"SELECT ?t WHERE {{ <{ROOT}volume/17> lib:title ?t }}") == [(volumes()[16][1],)]
    assert rows(lib, "SELECT ?v WHERE { ?v lib:title 'Comet 2' }") == [(22,)]
    assert rows(lib, "SELECT ?v WHERE { ?v lib:medium 'vellum' }") == []
    assert len(rows(lib, "SELECT ?v WHERE { ?v lib:medium 'paper' }")) == 54
    assert rows(lib, f"SELECT ?v WHERE {{ ?v lib:lentTo <{ROOT}reader/9> }}") == []


def test_union_and_minus_laws(lib):
    a, b = "{ ?v lib:keptAt 12 }", "{ ?v lib:pages ?p FILTER(?p > 200) }"
    assert len(rows(lib, f"SELECT ?v WHERE {{ {a} UNION {b} }}")) == len(rows(lib, f"SELECT ?v WHERE {a}")) + len(rows(lib, f"SELECT ?v WHERE {b}"))
    assert rows(lib, f"SELECT ?v WHERE {{ {a} MINUS {{ ?x lib:shelfRoom ?y }} }}") == rows(lib, f"SELECT ?v WHERE {a}")
    kept, gone = rows(lib, f"SELECT ?v WHERE {{ {a} FILTER EXISTS {b} }}"), rows(lib, f"SELECT ?v WHERE {{ {a} FILTER NOT EXISTS {b} }}")
    assert kept and gone and sorted(kept + gone, key=str) == rows(lib, f"SELECT ?v WHERE {a}")


def test_joins_on_unbound_variables_are_equi_joins(lib):
    text = "SELECT ?v ?x WHERE { ?v lib:pages ?p OPTIONAL { ?v lib:blurb ?x } OPTIONAL { ?w lib:blurb ?x ; lib:sequelOf ?v } }"
    assert "Left" in lib.explain(text, "plan") and "BroadcastNestedLoopJoin LeftOuter" not in lib.explain(text, "plan")


def test_paths_over_cycles_end(spark):
    from trellis.engine import Engine

    e = Engine(spark, prefixes={"ex": LIB})
    e.register_table("edge", spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "a int, b int"))
    e.load_flat_mapping(spark.createDataFrame([(LIB + "to", "edge", ROOT + "n{a}", "b")], "predicate string, table_name string, subject_template string, object_col string"))
    plus = rows(e, "SELECT ?a ?b WHERE { ?a ex:to+ ?b }")
    assert len(plus) == 10 and len(set(plus)) == 10
    assert set(plus) <= set(rows(e, "SELECT ?a ?b WHERE { ?a ex:to* ?b }"))
    assert rows(e, "SELECT ?b WHERE { <http://library.test/n1> ex:to+ ?b }") == [(1,), (2,), (3,)]
    assert rows(e, "SELECT ?a WHERE { ?a ex:to{2} <http://library.test/n1> }") == [(2,)]
    e.max_path_depth = 1
    assert len(rows(e, "SELECT ?a ?b WHERE { ?a ex:to+ ?b }")) == 4


def test_sequels(lib):
    before = {v[0]: v[6] for v in volumes() if v[6]}
    want = set()
    for v in before:
        at = v
        while at in before:
            at = before[at]
            want.add((v, at))
    assert set(rows(lib, "SELECT ?v ?w WHERE { ?v lib:sequelOf+ ?w }")) == want


def test_dates_and_language(lib):
    since = OPENED + datetime.timedelta(weeks=30)
    assert len(rows(lib, f"SELECT ?v WHERE {{ ?v lib:acquired ?d FILTER(?d >= '{since}'^^xsd:date) }}")) == sum(v[3] >= since for v in volumes())
    assert rows(lib, "SELECT DISTINCT (LANG(?t) AS ?l) (DATATYPE(?t) AS ?k) WHERE { ?b lib:town ?t }") == [("nl", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")]


def test_errors_leave_variables_unbound(lib):
    assert rows(lib, "SELECT DISTINCT (1/0 AS ?a) (xsd:integer('x') AS ?b) WHERE { ?e a lib:Branch }") == [(None, None)]
    assert rows(lib, "SELECT ?v WHERE { ?v lib:pages ?p FILTER(?p / 0 > 1) }") == []


def test_case_of_variables(lib):
    assert lib.query("SELECT ?v ?V WHERE { ?v lib:title 'Tide 0' . ?V lib:title 'Quartz 0' }").collect()[0][:] == (1, 2)


def test_forms(lib):
    assert lib.ask("ASK { ?v lib:pages ?p FILTER(?p > 440) }") and not lib.ask("ASK { ?v lib:pages 1 }")
    want = [(str(v[0]), LIB + "in", ["attic", "cellar", "hall", "attic"][v[4] - 11]) for v in volumes() if v[0] < 4]
    assert rows(lib, "CONSTRUCT { ?v lib:in ?r } WHERE { ?v lib:blurb ?x ; lib:keptAt ?b . ?b lib:shelfRoom ?r FILTER(?v < 4) }") == want
    assert {r[1] for r in rows(lib, f"DESCRIBE <{ROOT}branch/13>")} >= {LIB + "town", LIB + "shelfRoom"}
    assert lib.construct_bindings("CONSTRUCT { ?v lib:x ?p } WHERE { ?v lib:blurb ?p }").columns == ["v", "p"]


def test_results_json(lib):
    out = lib.sparql_json("SELECT ?b ?t ?r WHERE { ?b lib:town ?t ; lib:shelfRoom ?r FILTER(?b = 12) }")
    assert out["head"]["vars"] == ["b", "t", "r"] and out["results"]["bindings"][0]["t"] == {"type": "literal", "value": "Town B", "xml:lang": "nl"}
    text = "".join(lib.stream_json("SELECT ?v ?x WHERE { ?v a lib:Volume OPTIONAL { ?v lib:blurb ?x } }", size=7))
    assert len(json.loads(text)["results"]["bindings"]) == 54
    assert [len(p) for p in lib.pages("SELECT ?v WHERE { ?v a lib:Volume }", 20)] == [20, 20, 14]


def test_inspection_and_cache(lib):
    lib.clear_cache()
    for _ in range(3):
        lib.parse("SELECT ?v WHERE { ?v a lib:Volume }")
    stats = lib.cache_stats()
    assert stats["hits"] >= 2 and stats["entries"] == 1
    assert {c["@id"] for c in lib.inspect_ontology()["@graph"]} >= {LIB + "Volume", LIB + "pages"}
    assert lib.inspect_mappings().count() == len(lib.store.all_rules())
    assert lib.inspect_metadata()["branch"]["columns"]["room"] == "string"
    for form in ("text", "json", "dot", "mermaid"):
        assert "Query" in lib.explain("SELECT ?v WHERE { ?v a lib:Volume }", form)


def test_mappings_from_files_and_tables(spark, tmp_path):
    from trellis.engine import Engine

    (tmp_path / "map.ttl").write_text(MAPPING, encoding="utf-8")
    whole = Engine(spark).load_mapping_file(str(tmp_path / "map.ttl"))
    assert whole == Engine(spark).load_mapping_table(spark.createDataFrame([("lib", MAPPING)], "name string, ttl_content string")) > 10


def test_command_line(spark, tmp_path, capsys):
    for name in ("volume", "branch", "loan"):
        library(spark).tables[name].write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "map.ttl").write_text(MAPPING, encoding="utf-8")
    common = ["--mapping", str(tmp_path / "map.ttl"), "--data", str(tmp_path)]
    assert cli.main(["validate", str(tmp_path / "map.ttl")]) == 0 and "3 maps" in capsys.readouterr().out
    text = f"PREFIX lib: <{LIB}> SELECT ?t WHERE {{ ?b lib:town ?t }}"
    assert cli.main(["query", *common, text]) == 0
    assert len(json.loads(capsys.readouterr().out)["results"]["bindings"]) == 5
    assert cli.main(["translate", *common, "--format", "text", text]) == 0 and "Projection" in capsys.readouterr().out
    assert cli.main(["materialize", *common, "--output", str(tmp_path / "out"), "--format", "parquet"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).filter(f"predicate = '{LIB}town'").count() == 5
    assert cli.main(["query", *common, "SELECT"]) == 1 and "error" in capsys.readouterr().err


def test_cache_evicts_and_expires():
    now = [0.0]
    cache = PlanCache(2, 10.0, lambda: now[0])
    for key in "aba":
        cache.get(key, lambda: key)
    cache.get("c", lambda: 1)
    assert list(cache.entries) == ["a", "c"] and cache.evictions == 1
    now[0] = 11.0
    cache.get("a", lambda: 2)
    assert cache.misses == 4


def test_rejects():
    from trellis.engine import validate

    for bad in ("SELECT \x00", "SELECT `x`", " ", "x" * 300_000):
        with pytest.raises(QueryRejected):
            validate(bad)


def test_unusable_rules_and_bad_mappings(spark, lib):
    with pytest.raises(MappingError):
        load_r2rml("<http://a> <http://b> <http://c> .")
    with pytest.raises(UnsupportedFeature):
        lib.query("SELECT (NOPE(?v) AS ?x) WHERE { ?v a lib:Volume }")


def test_services(lib, spark):
    with pytest.raises(ServiceError):
        lib.query("SELECT ?x WHERE { SERVICE <http://nowhere.invalid/> { ?x ?y ?z } }")
    lib.services.register("http://here/", lambda text: {"results": {"bindings": [{"v": {"type": "literal", "value": "22", "datatype": "http://www.w3.org/2001/XMLSchema#integer"}, "t": {"type": "literal", "value": "rare"}}]}})
    assert rows(lib, "SELECT ?n ?t WHERE { ?v lib:title ?n SERVICE <http://here/> { ?v lib:tag ?t } }") == [("Comet 2", "rare")]


def test_gateway(lib):
    gateway = Gateway(lib, port=0, workers=2).start()
    base = f"http://127.0.0.1:{gateway.port}"
    try:
        ask = urllib.parse.urlencode({"query": "ASK { ?v a lib:Volume }"})
        with urllib.request.urlopen(f"{base}/sparql?{ask}") as reply:
            assert json.load(reply) == {"head": {}, "boolean": True} and reply.headers["Access-Control-Allow-Origin"] == "*"
        with urllib.request.urlopen(urllib.request.Request(f"{base}/sparql", b"SELECT ?b WHERE { ?b a lib:Branch }")) as reply:
            assert len(json.load(reply)["results"]["bindings"]) == 5
        with urllib.request.urlopen(f"{base}/ontology") as reply:
            assert json.load(reply)["stats"]["classes"] == 2
        for path, status in (("/sparql?query=SELEC", 400), ("/nope", 404), ("/sql?query=SELECT+1", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(base + path)
            assert e.value.code == status
    finally:
        gateway.stop()


def test_sql_answers_are_whole(lib):
    gateway = Gateway(lib, port=0, workers=1, allow_sql=True).start()
    try:
        text = urllib.parse.urlencode({"query": "SELECT id, CAST(NULL AS STRING) AS none FROM range(12345)"})
        with urllib.request.urlopen(f"http://127.0.0.1:{gateway.port}/sql?{text}") as reply:
            found = json.load(reply)
        assert len(found) == 12345 and found[-1] == {"id": 12344, "none": None}
    finally:
        gateway.stop()


def test_iri_mode_keeps_classes_apart(spark):
    e = library(spark, node_mode="iri")
    assert e.query("SELECT ?v WHERE { ?v lib:title 'Tide 0' }").collect()[0][0] == ROOT + "volume/1"
    assert e.query("SELECT ?t WHERE { ?v lib:title 'Tide 0' ; lib:home ?b . ?b lib:town ?t }").collect()[0][0] == "Town B"


def test_functions_may_be_registered(lib):
    lib.register_function(LIB + "third", lambda x: x / 3, 1, 1)
    assert rows(lib, "SELECT (lib:third(?p) AS ?h) WHERE { ?v lib:title 'Tide 0' ; lib:pages ?p }") == [((60 + 37) / 3,)]
    lib.register_function("SHOUT", lambda x: F.upper(x), 1, 1)
    assert rows(lib, "SELECT (SHOUT(?t) AS ?h) WHERE { ?v lib:title ?t FILTER(?v = 1) }") == [("TIDE 0",)]


def test_hashes_of_more_bits(lib):
    text = "SELECT (SHA384(?t) AS ?a) (SHA512(?t) AS ?b) WHERE { ?v lib:title ?t FILTER(?v = 1) }"
    assert rows(lib, text) == [(hashlib.sha384(b"Tide 0").hexdigest(), hashlib.sha512(b"Tide 0").hexdigest())]


@pytest.mark.parametrize(
    ("name", "a", "b", "want"),
    [
        ("within", "POINT(1 1)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True), ("within", "POINT(0 1)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", False), ("touches", "POINT(0 1)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),
        ("overlaps", "POLYGON((0 0,10 0,10 10,0 10,0 0))", "POLYGON((5 5,15 5,15 15,5 15,5 5))", True), ("contains", "POLYGON((0 0,10 0,10 10,0 10,0 0))", "POLYGON((1 1,2 1,2 2,1 2,1 1))", True),
        ("crosses", "LINESTRING(0 0,10 10)", "LINESTRING(5 0,5 10)", True), ("crosses", "LINESTRING(-5 5,15 5)", "POLYGON((0 0,10 0,10 10,0 10,0 0))", True), ("equals", "LINESTRING(0 0,1 1)", "LINESTRING(1 1,0 0)", True),
        ("disjoint", "POINT(0 0)", "POINT(1 1)", True), ("intersects", "LINESTRING(0 0,10 10)", "POLYGON((6 6,10 6,10 10,6 10,6 6))", True), ("touches", "POLYGON((0 0,5 0,5 5,0 5,0 0))", "POLYGON((5 0,9 0,9 5,5 5,5 0))", True),
        ("within", "nonsense", "POINT(0 0)", None), ("within", "POINT(0 2)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", False), ("contains", "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POINT(2 2)", False),
        ("within", "LINESTRING(0 0,2 0)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", False), ("within", "LINESTRING(0 0,2 2)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True), ("within", "POINT(1 0)", "LINESTRING(0 0,2 0)", True),
    ],
)
def test_geometry(name, a, b, want):
    assert geo.shape_relation(name, a, b) is want


SHAPES = ["POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,3 1,3 3,1 3,1 1))", "POLYGON((0 0,4 0,2 1,4 4,0 0))", "LINESTRING(0 0,4 0,4 3)", "LINESTRING(0 0,2 0,2 2,0 0)", "POINT(1 1)", "BUFFER(POINT(2 2),1.5)", "BUFFER(LINESTRING(0 0,4 0),1.0)", "nonsense"]


@pytest.mark.parametrize("wkt", SHAPES)
def test_points_against_shapes_in_columns(spark, wkt):
    """Column arithmetic gives what the general relation gives; other shapes in the column go to the general one."""
    texts = [f"POINT({x / 2} {y / 2})" for x in range(-2, 11) for y in range(-2, 11)] + ["SRID=4326;POINT(2 0)", "LINESTRING(0 0,1 1)", "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts], "g string")
    g, c = Value(F.col("g"), "string"), constant(A.Literal(wkt))
    names = ("within", "contains", "intersects", "disjoint", "touches", "equals", "overlaps", "crosses")
    found = df.select("g", *(geo.relate(n, g, c).alias(n) for n in names), *(geo.relate(n, c, g).alias(n + "_back") for n in names)).collect()
    for r in found:
        for n in names:
            assert r[n] == geo.shape_relation(n, r["g"], wkt), (n, r["g"])
            assert r[n + "_back"] == geo.shape_relation(n, wkt, r["g"]), (n, r["g"])


def test_distance():
    assert geo.shape_distance("POINT(0 0)", "LINESTRING(3 -1,3 9)") == 3.0
    assert geo.shape_distance("POLYGON((0 0,2 0,2 2,0 2,0 0))", "POINT(1 1)") == 0.0
