"""The catalogue: SPARQL queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.engine import Engine
from trellis.sources.mapping import TableInfo
from trellis.streaming import windows

V = "http://example.org/vkg/"
FLAGSHIP = "agg_avg_by_nation"

# class, logical table, subject template, predicate -> column (or template of another class)
_MAPS = [
    ("Region", "region", "region/{r_regionkey}", {"regionName": "r_name"}),
    ("Nation", "nation", "nation/{n_nationkey}", {"nationName": "n_name", "inRegion": "region/{n_regionkey}"}),
    ("Customer", "customer", "customer/{c_custkey}", {"custName": "c_name", "acctBal": "c_acctbal", "segment": "c_mktsegment", "custNation": "nation/{c_nationkey}"}),
    ("Supplier", "supplier", "supplier/{s_suppkey}", {"suppName": "s_name", "suppBal": "s_acctbal", "suppNation": "nation/{s_nationkey}"}),
    ("Part", "part", "part/{p_partkey}", {"partName": "p_name", "brand": "p_brand", "partType": "p_type", "size": "p_size", "retailPrice": "p_retailprice"}),
    ("Order", "orders", "order/{o_orderkey}", {"orderStatus": "o_orderstatus", "totalPrice": "o_totalprice", "orderDate": "o_orderdate", "priority": "o_orderpriority", "placedBy": "customer/{o_custkey}"}),
    ("LineItem", "lineitem", "_:line/{l_orderkey}/{l_linenumber}", {
        "ofOrder": "order/{l_orderkey}", "ofPart": "part/{l_partkey}", "bySupplier": "supplier/{l_suppkey}", "quantity": "l_quantity", "extendedPrice": "l_extendedprice",
        "discount": "l_discount", "tax": "l_tax", "returnFlag": "l_returnflag", "lineStatus": "l_linestatus", "shipDate": "l_shipdate"}),
    ("Event", "events", "event/{event_id}", {"eventTime": "ts", "eventUser": "user_id", "eventType": "event_type", "eventValue": "value"}),
    ("Document", "documents", "document/{doc_id}", {"lang": "lang", "source": "source", "nChars": "n_chars", "docText": "text"}),
    ("Label", "labels", "label/{doc_id}", {"quality": "quality", "toxic": "toxic", "labelOf": "document/{doc_id}"}),
    ("Page", "pages", "page/{page_id}", {"url": "url"}),
    ("PartEdge", "SELECT p_partkey, CAST(floor(p_partkey / 10) AS BIGINT) AS parent FROM part WHERE p_partkey >= 10", "part/{p_partkey}", {"subPartOf": "part/{parent}"}),
    ("Site", "SELECT c_custkey, concat('POINT(', c_custkey % 100, ' ', CAST(floor(c_custkey / 100) AS BIGINT), ')') AS wkt FROM customer", "site/{c_custkey}", {"asWKT": "wkt"}),
    ("Turn", "SELECT conv_id * 1000 + turn AS node, conv_id * 1000 + turn + 1 AS following, conv_id, turn FROM conversations", "turn/{node}", {"nextTurn": "turn/{following}", "turnOf": "conv_id", "turnNumber": "turn"}),
]
_GRAPHS = {"Region": V + "graph/geography", "Nation": V + "graph/geography", "Event": V + "graph/activity"}
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id"}
_PARQUET = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations"]

ONTOLOGY = f"""
@prefix v: <{V}> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
v:Party a owl:Class ; rdfs:label "Party" . v:Customer a owl:Class ; rdfs:subClassOf v:Party . v:Supplier a owl:Class ; rdfs:subClassOf v:Party .
v:Order a owl:Class . v:Buyer a owl:Class . v:balance a owl:DatatypeProperty . v:acctBal rdfs:subPropertyOf v:balance . v:suppBal rdfs:subPropertyOf v:balance .
v:placedBy a owl:ObjectProperty ; rdfs:domain v:Order ; rdfs:range v:Buyer . v:placed a owl:ObjectProperty ; owl:inverseOf v:placedBy .
"""


def mapping() -> str:
    """The R2RML document of the driver tables."""
    out = [f"@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix v: <{V}> .\n"]
    for name, table, subject, predicates in _MAPS:
        blank = subject.startswith("_:")
        template = subject[2:] if blank else subject
        source = f'rr:sqlQuery """{table}"""' if table.startswith("SELECT") else f'rr:tableName "{table}"'
        graph = f" ; rr:graph <{_GRAPHS[name]}>" if name in _GRAPHS else ""
        objects = "".join(f' ;\n  rr:predicateObjectMap [ rr:predicate v:{p} ; rr:objectMap [ ' + (f'rr:template "{V}{o}"' if "{" in o else f'rr:column "{o}"') + " ] ]" for p, o in predicates.items())
        out.append(f'<#{name}> rr:logicalTable [ {source} ] ;\n  rr:subjectMap [ rr:template "{V}{template}" ; rr:class v:{name}{" ; rr:termType rr:BlankNode" if blank else ""}{graph} ]{objects} .\n')
    return "\n".join(out)


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """An engine over the tables of a folder."""
    found = Engine(spark, prefixes={"v": V}, **options)
    found.register_parquet(sf_dir, _PARQUET, {t: TableInfo(primary_key=(k,)) for t, k in _KEYS.items()})
    found.load_mapping(mapping())
    found.load_ontology(ONTOLOGY)
    return found


@dataclass(frozen=True)
class Entry:
    sparql: str
    sql: str | None
    options: tuple = ()
    run: Callable[[Engine, str], DataFrame] | None = None


_CATALOGUE: dict[str, Entry] = {}


def _add(name: str, sparql: str, sql: str | None, run: Callable[[Engine, str], DataFrame] | None = None, **options) -> None:
    _CATALOGUE[name] = Entry(sparql, sql, tuple(options.items()), run)


# scans and filters --------------------------------------------------------------
_add("scan_bgp", "SELECT ?c ?name ?bal WHERE { ?c v:custName ?name ; v:acctBal ?bal }", "SELECT c_custkey AS c, c_name AS name, c_acctbal AS bal FROM customer")
_add("const_object", "SELECT ?c ?name WHERE { ?c v:segment 'BUILDING' ; v:custName ?name }", "SELECT c_custkey AS c, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("const_subject", "SELECT ?name ?bal WHERE { <http://example.org/vkg/customer/7> v:custName ?name ; v:acctBal ?bal }", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 7")
_add("const_iri_object", "SELECT ?c WHERE { ?c v:custNation <http://example.org/vkg/nation/3> }", "SELECT c_custkey AS c FROM customer WHERE c_nationkey = 3")
_add("type_scan", "SELECT ?s WHERE { ?s a v:Supplier }", "SELECT s_suppkey AS s FROM supplier")
_add("filter_numeric", "SELECT ?c ?bal WHERE { ?c v:acctBal ?bal FILTER(?bal > 5000) }", "SELECT c_custkey AS c, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000")
_add("filter_string_eq", "SELECT ?o WHERE { ?o v:priority ?p FILTER(?p = '1-URGENT') }", "SELECT o_orderkey AS o FROM orders WHERE o_orderpriority = '1-URGENT'")
_add("filter_and_or_not", "SELECT ?p ?s WHERE { ?p v:size ?s ; v:brand ?b FILTER((?s < 10 || ?s > 40) && !(?b = 'Brand#11')) }", "SELECT p_partkey AS p, p_size AS s FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT p_brand = 'Brand#11'")
_add("filter_neq", "SELECT ?o ?s WHERE { ?o v:orderStatus ?s FILTER(?s != 'F') }", "SELECT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'")
_add("filter_in", "SELECT ?p ?s WHERE { ?p v:size ?s FILTER(?s IN (1, 5, 9)) }", "SELECT p_partkey AS p, p_size AS s FROM part WHERE p_size IN (1, 5, 9)")
_add("filter_not_in", "SELECT ?c ?g WHERE { ?c v:segment ?g FILTER(?g NOT IN ('BUILDING', 'MACHINERY')) }", "SELECT c_custkey AS c, c_mktsegment AS g FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_add("filter_date_range", "SELECT ?o ?t WHERE { ?o v:orderDate ?d ; v:totalPrice ?t FILTER(?d >= '1995-01-01T00:00:00'^^xsd:dateTime && ?d < '1996-01-01T00:00:00'^^xsd:dateTime) }", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_add("arith_bind", "SELECT ?o ?net WHERE { ?l v:ofOrder ?o ; v:extendedPrice ?p ; v:discount ?d BIND(?p * (1 - ?d) AS ?net) }", "SELECT l_orderkey AS o, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
_add("arith_assoc", "SELECT ?p ?x WHERE { ?p v:size ?s BIND(?s - 3 - 2 * ?s / 4 AS ?x) }", "SELECT p_partkey AS p, p_size - 3 - 2 * p_size / 4.0::double AS x FROM part")
_add("unary_minus", "SELECT ?c ?neg WHERE { ?c v:acctBal ?b BIND(-?b AS ?neg) }", "SELECT c_custkey AS c, -c_acctbal AS neg FROM customer")
_add("bind_sequence", "SELECT ?p ?y WHERE { ?p v:size ?s BIND(?s + 1 AS ?x) BIND(?x * 2 AS ?y) FILTER(?y > 50) }", "SELECT p_partkey AS p, (p_size + 1) * 2 AS y FROM part WHERE (p_size + 1) * 2 > 50")
_add("select_star", "SELECT * WHERE { ?r v:regionName ?name }", "SELECT r_regionkey AS r, r_name AS name FROM region")
_add("unit_relation", "SELECT ?x ?y WHERE { BIND(1 + 1 AS ?x) BIND('a' AS ?y) }", "SELECT 2::bigint AS x, 'a' AS y")
_add("empty_relation", "SELECT ?s ?o WHERE { ?s v:noSuchPredicate ?o }", "SELECT NULL::varchar AS s, NULL::varchar AS o WHERE false")
_add("blank_node_pattern", "SELECT ?name WHERE { ?n v:inRegion [ v:regionName 'ASIA' ] ; v:nationName ?name }", "SELECT n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
_add("object_list", "SELECT ?n WHERE { ?n v:inRegion <http://example.org/vkg/region/1> , ?r }", "SELECT n_nationkey AS n FROM nation WHERE n_regionkey = 1")
_add("join_condition_object", "SELECT ?o ?t WHERE { ?l v:quantity ?q ; v:ofOrder ?o . ?o v:totalPrice ?t FILTER(?q >= 50) }", "SELECT l_orderkey AS o, o_totalprice AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 50")

# joins --------------------------------------------------------------------------
_add("join_two", "SELECT ?c ?name WHERE { ?c v:custNation ?n . ?n v:nationName ?name }", "SELECT c_custkey AS c, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey")
_add("join_four_chain", "SELECT ?o ?reg WHERE { ?o v:placedBy ?c . ?c v:custNation ?n . ?n v:inRegion ?r . ?r v:regionName ?reg }", "SELECT o_orderkey AS o, r_name AS reg FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
_add("join_star_merge", "SELECT ?o ?s ?t ?p WHERE { ?o v:orderStatus ?s . ?o v:totalPrice ?t . ?o v:priority ?p . ?o a v:Order }", "SELECT o_orderkey AS o, o_orderstatus AS s, o_totalprice AS t, o_orderpriority AS p FROM orders")
_add("join_lineitem_all", "SELECT ?name (SUM(?e) AS ?rev) WHERE { ?l v:ofOrder ?o ; v:bySupplier ?s ; v:extendedPrice ?e . ?o v:placedBy ?c . ?c v:custNation ?n . ?s v:suppNation ?n . ?n v:nationName ?name } GROUP BY ?name", "SELECT n_name AS name, sum(l_extendedprice) AS rev FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
_add("cross_join_scalar_subquery", "SELECT ?c ?b WHERE { ?c v:acctBal ?b { SELECT (AVG(?x) AS ?a) WHERE { ?d v:acctBal ?x } } FILTER(?b > ?a) }", "SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
_add("theta_join_values", "SELECT ?c ?seg WHERE { ?c v:segment ?seg ; v:acctBal ?b VALUES (?target ?least) { ('BUILDING' 5000) ('MACHINERY' 9000) } FILTER(?seg = ?target && ?b >= ?least) }", "SELECT c_custkey AS c, c_mktsegment AS seg FROM customer JOIN (VALUES ('BUILDING', 5000), ('MACHINERY', 9000)) t(g, m) ON c_mktsegment = g AND c_acctbal >= m")
_add("optional_basic", "SELECT ?c ?o WHERE { ?c a v:Customer OPTIONAL { ?o v:placedBy ?c ; v:priority '1-URGENT' } }", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
_add("optional_filter", "SELECT ?c ?o WHERE { ?c v:acctBal ?b OPTIONAL { ?o v:placedBy ?c ; v:totalPrice ?t FILTER(?t > 100000 && ?b > 0) } }", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 AND c_acctbal > 0")
_add("optional_nested", "SELECT ?n ?c ?o WHERE { ?n v:nationName ?x OPTIONAL { ?c v:custNation ?n ; v:segment 'BUILDING' OPTIONAL { ?o v:placedBy ?c ; v:orderStatus 'P' } } }", "SELECT n_nationkey AS n, c_custkey AS c, o_orderkey AS o FROM nation LEFT JOIN (customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P') ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'")
_add("optional_multi", "SELECT ?d ?q ?src WHERE { ?d v:lang 'en' OPTIONAL { ?l v:labelOf ?d ; v:quality ?q } OPTIONAL { ?d v:source ?src FILTER(?src = 'src1') } }", "SELECT d.doc_id AS d, quality AS q, CASE WHEN source = 'src1' THEN source END AS src FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE lang = 'en'")
_add("optional_shared_unbound", "SELECT ?n ?s ?p WHERE { ?n v:nationName ?x OPTIONAL { ?s v:suppNation ?n ; v:suppBal ?b FILTER(?b > 9000) } OPTIONAL { ?s v:suppName ?p ; v:suppBal ?y FILTER(?y < 9500) } }", "SELECT n_nationkey AS n, coalesce(a.s_suppkey, b.s_suppkey) AS s, b.s_name AS p FROM nation LEFT JOIN supplier a ON a.s_nationkey = n_nationkey AND a.s_acctbal > 9000 LEFT JOIN supplier b ON (a.s_suppkey IS NULL OR a.s_suppkey = b.s_suppkey) AND b.s_acctbal < 9500")
_add("join_shared_unbound", "SELECT ?n ?s ?p WHERE { { ?n v:nationName ?x OPTIONAL { ?s v:suppNation ?n ; v:suppBal ?b FILTER(?b > 9000) } } { ?s v:suppName ?p ; v:suppBal ?y FILTER(?y > 8000) } }", "SELECT n_nationkey AS n, b.s_suppkey AS s, b.s_name AS p FROM nation LEFT JOIN supplier a ON a.s_nationkey = n_nationkey AND a.s_acctbal > 9000 JOIN supplier b ON (a.s_suppkey IS NULL OR a.s_suppkey = b.s_suppkey) AND b.s_acctbal > 8000")
_add("minus_unbound", "SELECT ?n ?s WHERE { ?n v:nationName ?x OPTIONAL { ?s v:suppNation ?n ; v:suppBal ?b FILTER(?b > 9000) } MINUS { ?s v:suppBal ?y FILTER(?y > 9400) } }", "SELECT n_nationkey AS n, a.s_suppkey AS s FROM nation LEFT JOIN supplier a ON a.s_nationkey = n_nationkey AND a.s_acctbal > 9000 WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_suppkey = a.s_suppkey AND b.s_acctbal > 9400)")
_add("exists_shared_unbound", "SELECT ?n ?s WHERE { ?n v:nationName ?x OPTIONAL { ?s v:suppNation ?n ; v:suppBal ?b FILTER(?b > 9000) } FILTER EXISTS { ?s v:suppBal ?y FILTER(?y > 9400) } }", "SELECT n_nationkey AS n, a.s_suppkey AS s FROM nation LEFT JOIN supplier a ON a.s_nationkey = n_nationkey AND a.s_acctbal > 9000 WHERE EXISTS (SELECT 1 FROM supplier b WHERE (a.s_suppkey IS NULL OR b.s_suppkey = a.s_suppkey) AND b.s_acctbal > 9400)")
_add("minus_basic", "SELECT ?c WHERE { ?c a v:Customer MINUS { ?o v:placedBy ?c ; v:orderStatus 'F' } }", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_add("minus_filter", "SELECT ?p WHERE { ?p v:brand ?b MINUS { ?p v:size ?s FILTER(?s > 25) } }", "SELECT p_partkey AS p FROM part WHERE NOT p_size > 25")
_add("minus_no_shared", "SELECT ?r WHERE { ?r v:regionName ?x MINUS { ?n v:nationName ?y } }", "SELECT r_regionkey AS r FROM region")
_add("exists", "SELECT ?c ?n WHERE { ?c v:custName ?n FILTER EXISTS { ?o v:placedBy ?c ; v:totalPrice ?t FILTER(?t > 200000) } }", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_add("not_exists", "SELECT ?p WHERE { ?p a v:Part FILTER NOT EXISTS { ?l v:ofPart ?p ; v:returnFlag 'R' ; v:quantity ?q FILTER(?q > 40) } }", "SELECT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
_add("exists_nested", "SELECT ?n WHERE { ?n v:nationName ?x FILTER EXISTS { ?c v:custNation ?n FILTER NOT EXISTS { ?o v:placedBy ?c ; v:orderStatus 'O' } } }", "SELECT n_nationkey AS n FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O'))")
_add("exists_outer_filter", "SELECT ?c WHERE { ?c v:acctBal ?b FILTER EXISTS { ?o v:placedBy ?c ; v:totalPrice ?t FILTER(?t > ?b * 40) } }", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
_add("exists_outer_in_or", "SELECT ?c WHERE { ?c v:acctBal ?b FILTER(?b > 9500 || EXISTS { ?o v:placedBy ?c ; v:totalPrice ?t FILTER(?t > ?b * 40) }) }", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9500 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
_add("exists_nested_outermost", "SELECT ?c WHERE { ?c v:acctBal ?b FILTER EXISTS { ?o v:placedBy ?c ; v:totalPrice ?t FILTER EXISTS { ?l v:ofOrder ?o ; v:extendedPrice ?x FILTER(?x * 2 > ?t && ?x > ?b) } } }", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice * 2 > o_totalprice AND l_extendedprice > c_acctbal))")
_add("exists_bind", "SELECT ?c ?e WHERE { ?c v:acctBal ?b BIND(EXISTS { ?o v:placedBy ?c ; v:totalPrice ?t FILTER(?t > ?b * 40) } AS ?e) }", "SELECT c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40) AS e FROM customer")
_add("exists_bind_outer_only", "SELECT ?n ?e WHERE { ?n v:nationName ?x BIND(EXISTS { ?c v:custNation ?n FILTER(STRLEN(?x) > 6) } AS ?e) }", "SELECT n_nationkey AS n, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND length(n_name) > 6) AS e FROM nation")
_add("exists_unbound", "SELECT ?n ?s WHERE { ?n v:nationName ?x OPTIONAL { ?s v:suppNation ?n ; v:suppBal ?b FILTER(?b > 9000) } FILTER(?x = 'NATION_1' || EXISTS { ?s v:suppBal ?y ; v:suppNation ?m FILTER(?y < 9500 && ?m >= ?n) }) }", "SELECT n_nationkey AS n, s.s_suppkey AS s FROM nation LEFT JOIN supplier s ON s_nationkey = n_nationkey AND s_acctbal > 9000 WHERE n_name = 'NATION_1' OR EXISTS (SELECT 1 FROM supplier z WHERE (s.s_suppkey IS NULL OR z.s_suppkey = s.s_suppkey) AND z.s_acctbal < 9500 AND z.s_nationkey >= n_nationkey)")
_add("exists_union_outer", "SELECT ?c WHERE { ?c v:acctBal ?b FILTER EXISTS { { ?o v:placedBy ?c ; v:totalPrice ?t FILTER(?t > ?b * 45) } UNION { ?c v:segment ?g FILTER(?b < 500) } } }", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 45) OR (c_acctbal < 500 AND c_mktsegment IS NOT NULL)")
_add("not_exists_outer_in_or", "SELECT ?c WHERE { ?c v:acctBal ?b FILTER(?b < 0 || NOT EXISTS { ?o v:placedBy ?c ; v:totalPrice ?t FILTER(?t > ?b * 30) }) }", "SELECT c_custkey AS c FROM customer WHERE c_acctbal < 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)")
_add("exists_or_filter", "SELECT ?c WHERE { ?c v:acctBal ?b FILTER(?b > 9500 || EXISTS { ?o v:placedBy ?c ; v:priority '2-HIGH' ; v:orderStatus 'P' }) }", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9500 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '2-HIGH' AND o_orderstatus = 'P')")

# aggregates -----------------------------------------------------------------------
_add(FLAGSHIP, "SELECT ?nation (COUNT(?c) AS ?n) (AVG(?bal) AS ?avg) WHERE { ?c v:custNation ?k ; v:acctBal ?bal . ?k v:nationName ?nation } GROUP BY ?nation HAVING (COUNT(?c) > 1) ORDER BY ?nation", "SELECT n_name AS nation, count(c_custkey) AS n, avg(c_acctbal) AS avg FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(c_custkey) > 1")
_add("count_star", "SELECT (COUNT(*) AS ?n) WHERE { ?l a v:LineItem }", "SELECT count(*) AS n FROM lineitem")
_add("count_distinct", "SELECT ?u (COUNT(DISTINCT ?t) AS ?kinds) WHERE { ?e v:eventUser ?u ; v:eventType ?t } GROUP BY ?u", "SELECT user_id AS u, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
_add("sum_avg_min_max", "SELECT ?f (SUM(?q) AS ?s) (AVG(?p) AS ?a) (MIN(?p) AS ?lo) (MAX(?q) AS ?hi) WHERE { ?l v:returnFlag ?f ; v:quantity ?q ; v:extendedPrice ?p } GROUP BY ?f", "SELECT l_returnflag AS f, sum(l_quantity) AS s, avg(l_extendedprice) AS a, min(l_extendedprice) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag")
_add("sum_distinct", "SELECT ?b (SUM(DISTINCT ?s) AS ?x) WHERE { ?p v:brand ?b ; v:size ?s } GROUP BY ?b", "SELECT p_brand AS b, sum(DISTINCT p_size)::bigint AS x FROM part GROUP BY p_brand")
_add("group_multi", "SELECT ?f ?s (COUNT(*) AS ?n) WHERE { ?l v:returnFlag ?f ; v:lineStatus ?s } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL")
_add("group_only", "SELECT ?b WHERE { ?p v:brand ?b } GROUP BY ?b", "SELECT DISTINCT p_brand AS b FROM part")
_add("group_expr", "SELECT ?y (COUNT(?o) AS ?n) WHERE { ?o v:orderDate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
_add("implicit_group", "SELECT ?g (COUNT(?c) AS ?n) WHERE { ?c v:segment ?g }", "SELECT c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1")
_add("having_multi", "SELECT ?b (COUNT(?p) AS ?n) WHERE { ?p v:brand ?b ; v:size ?s } GROUP BY ?b HAVING (COUNT(?p) > 2 && AVG(?s) > 20)", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 2 AND avg(p_size) > 20")
_add("having_hidden_agg", "SELECT ?c WHERE { ?o v:placedBy ?c ; v:totalPrice ?t } GROUP BY ?c HAVING (SUM(?t) > 1000000)", "SELECT o_custkey AS c FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000")
_add("group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) WHERE { ?k v:inRegion ?r ; v:nationName ?n } GROUP BY ?r", "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_add("group_concat_distinct", "SELECT ?u (GROUP_CONCAT(DISTINCT ?t; SEPARATOR=',') AS ?types) WHERE { ?e v:eventUser ?u ; v:eventType ?t } GROUP BY ?u", "SELECT user_id AS u, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
_add("sample", "SELECT ?r (SAMPLE(?n) AS ?one) WHERE { ?k v:inRegion ?r ; v:nationName ?n } GROUP BY ?r", "SELECT n_regionkey AS r, min(n_name) AS one FROM nation GROUP BY n_regionkey")
_add("agg_of_expr", "SELECT ?f (SUM(?p * (1 - ?d)) AS ?net) (SUM(?p) / COUNT(?p) AS ?mean) WHERE { ?l v:returnFlag ?f ; v:extendedPrice ?p ; v:discount ?d } GROUP BY ?f", "SELECT l_returnflag AS f, sum(l_extendedprice * (1 - l_discount)) AS net, sum(l_extendedprice) / count(*) AS mean FROM lineitem GROUP BY l_returnflag")
_add("agg_empty", "SELECT (COUNT(?o) AS ?n) (SUM(?t) AS ?s) WHERE { ?o v:totalPrice ?t ; v:orderStatus 'none' }", "SELECT 0::bigint AS n, 0::double AS s")

# modifiers ------------------------------------------------------------------------
_add("distinct", "SELECT DISTINCT ?u ?t WHERE { ?e v:eventUser ?u ; v:eventType ?t }", "SELECT DISTINCT user_id AS u, event_type AS t FROM events")
_add("reduced", "SELECT REDUCED ?s WHERE { ?o v:orderStatus ?s }", "SELECT o_orderstatus AS s FROM orders")
_add("order_limit", "SELECT ?c ?b WHERE { ?c v:acctBal ?b } ORDER BY DESC(?b) ?c LIMIT 10", "SELECT c_custkey AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
_add("order_multi_desc", "SELECT ?o ?s ?t WHERE { ?o v:orderStatus ?s ; v:totalPrice ?t } ORDER BY ?s ?t DESC ?o LIMIT 25", "SELECT o_orderkey AS o, o_orderstatus AS s, o_totalprice AS t FROM orders ORDER BY s, t DESC, o LIMIT 25")
_add("order_expr", "SELECT ?p ?s WHERE { ?p v:size ?s } ORDER BY ABS(?s - 25) ?p LIMIT 15", "SELECT p_partkey AS p, p_size AS s FROM part ORDER BY abs(p_size - 25), p_partkey LIMIT 15")
_add("offset_limit", "SELECT ?p WHERE { ?p a v:Part } ORDER BY ?p LIMIT 20 OFFSET 30", "SELECT p_partkey AS p FROM part ORDER BY p_partkey LIMIT 20 OFFSET 30")
_add("order_unbound", "SELECT ?c ?o WHERE { ?c a v:Customer OPTIONAL { ?o v:placedBy ?c ; v:orderStatus 'P' } } ORDER BY ?o ?c LIMIT 40", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' ORDER BY o NULLS FIRST, c LIMIT 40")
_add("topk", "SELECT ?name (SUM(?t) AS ?total) WHERE { ?o v:placedBy ?c ; v:totalPrice ?t . ?c v:custName ?name } GROUP BY ?name ORDER BY DESC(?total) ?name LIMIT 5", "SELECT c_name AS name, sum(o_totalprice) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_name ORDER BY total DESC, name LIMIT 5")
_add("distinct_order_limit", "SELECT DISTINCT ?b WHERE { ?p v:brand ?b } ORDER BY DESC(?b) LIMIT 4", "SELECT DISTINCT p_brand AS b FROM part ORDER BY b DESC LIMIT 4")

# sets -----------------------------------------------------------------------------
_add("union_two", "SELECT ?x ?b WHERE { { ?x v:acctBal ?b FILTER(?b > 9000) } UNION { ?x v:suppBal ?b FILTER(?b < 0) } }", "SELECT c_custkey AS x, c_acctbal AS b FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
_add("union_three", "SELECT ?n WHERE { { ?r v:regionName ?n } UNION { ?k v:nationName ?n } UNION { ?s v:suppName ?n } }", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier")
_add("union_with_outer_bgp", "SELECT ?name ?x WHERE { ?n v:nationName ?name { ?x v:custNation ?n ; v:acctBal ?b FILTER(?b > 9000) } UNION { ?x v:suppNation ?n } }", "SELECT n_name AS name, c_custkey AS x FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 UNION ALL SELECT n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
_add("union_missing_vars", "SELECT ?c ?s WHERE { { ?c v:segment 'BUILDING' } UNION { ?s v:suppBal ?b } }", "SELECT c_custkey AS c, NULL::bigint AS s FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT NULL, s_suppkey FROM supplier")
_add("union_nested", "SELECT ?x WHERE { { ?x v:size 1 } UNION { { ?x v:size 2 } UNION { ?x v:size 3 } } }", "SELECT p_partkey AS x FROM part WHERE p_size IN (1, 2, 3)")
_add("values_single", "SELECT ?c ?n WHERE { VALUES ?c { <http://example.org/vkg/customer/1> <http://example.org/vkg/customer/5> } ?c v:custName ?n }", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_custkey IN (1, 5)")
_add("values_multi", "SELECT ?o ?s ?p WHERE { ?o v:orderStatus ?s ; v:priority ?p VALUES (?s ?p) { ('F' '1-URGENT') ('O' '5-LOW') } }", "SELECT o_orderkey AS o, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')")
_add("values_undef", "SELECT ?p ?b ?s WHERE { ?p v:brand ?b ; v:size ?s VALUES (?b ?s) { ('Brand#11' UNDEF) (UNDEF 7) } }", "SELECT p_partkey AS p, p_brand AS b, p_size AS s FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT p_partkey, p_brand, p_size FROM part WHERE p_size = 7")
_add("values_empty", "SELECT ?p WHERE { ?p a v:Part VALUES ?p { } }", "SELECT p_partkey AS p FROM part WHERE false")
_add("values_trailing", "SELECT ?p ?s WHERE { ?p v:size ?s } VALUES ?s { 3 4 }", "SELECT p_partkey AS p, p_size AS s FROM part WHERE p_size IN (3, 4)")

# subqueries -----------------------------------------------------------------------
_add("subselect_group_join", "SELECT ?name ?n WHERE { ?c v:custName ?name { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o v:placedBy ?c } GROUP BY ?c } FILTER(?n > 5) }", "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n > 5")
_add("subselect_correlated", "SELECT ?c ?b ?a WHERE { ?c v:custNation ?n ; v:acctBal ?b { SELECT (AVG(?x) AS ?a) WHERE { ?d v:custNation ?n ; v:acctBal ?x } } FILTER(?b > ?a) }", "SELECT c_custkey AS c, c_acctbal AS b, a FROM customer c JOIN (SELECT c_nationkey, avg(c_acctbal) AS a FROM customer GROUP BY 1) g ON g.c_nationkey = c.c_nationkey WHERE c_acctbal > a", correlated_subselect=True)
_add("subselect_nested", "SELECT ?m WHERE { { SELECT (MAX(?n) AS ?m) WHERE { { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o v:placedBy ?c } GROUP BY ?c } } } }", "SELECT max(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
_add("subselect_topk", "SELECT ?name ?b WHERE { { SELECT ?c ?b WHERE { ?c v:acctBal ?b } ORDER BY DESC(?b) ?c LIMIT 3 } ?c v:custName ?name }", "SELECT c_name AS name, c_acctbal AS b FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3)")

# paths ----------------------------------------------------------------------------
_PART_TREE = "WITH RECURSIVE e AS (SELECT p_partkey AS s, p_partkey // 10 AS o FROM part WHERE p_partkey >= 10), r(s, o) AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON e.s = r.o)"
_add("path_seq", "SELECT ?c ?reg WHERE { ?c v:custNation/v:inRegion/v:regionName ?reg }", "SELECT c_custkey AS c, r_name AS reg FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
_add("path_alt", "SELECT ?x ?n WHERE { ?x v:custNation|v:suppNation ?n }", "SELECT c_custkey AS x, c_nationkey AS n FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
_add("path_inverse", "SELECT ?c ?o WHERE { ?c ^v:placedBy ?o }", "SELECT o_custkey AS c, o_orderkey AS o FROM orders")
_add("path_seq_inverse", "SELECT ?n (COUNT(?o) AS ?k) WHERE { ?n ^v:custNation/^v:placedBy ?o } GROUP BY ?n", "SELECT c_nationkey AS n, count(*) AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_add("path_plus", "SELECT ?p ?a WHERE { ?p v:subPartOf+ ?a }", f"{_PART_TREE} SELECT s AS p, o AS a FROM r")
_add("path_plus_constant", "SELECT ?p WHERE { ?p v:subPartOf+ <http://example.org/vkg/part/1> }", f"{_PART_TREE} SELECT s AS p FROM r WHERE o = 1")
_add("path_star", "SELECT ?p ?a WHERE { ?p v:subPartOf* ?a }", f"{_PART_TREE} SELECT s AS p, o AS a FROM r UNION SELECT s, s FROM e UNION SELECT o, o FROM e")
_add("path_opt", "SELECT ?p ?a WHERE { ?p v:subPartOf? ?a }", f"{_PART_TREE} SELECT s AS p, o AS a FROM e UNION SELECT s, s FROM e UNION SELECT o, o FROM e")
_add("path_range", "SELECT ?p ?a WHERE { ?p v:subPartOf{2,3} ?a }", "WITH e AS (SELECT p_partkey AS s, p_partkey // 10 AS o FROM part WHERE p_partkey >= 10) SELECT a.s AS p, b.o AS a FROM e a JOIN e b ON b.s = a.o UNION SELECT a.s, c.o FROM e a JOIN e b ON b.s = a.o JOIN e c ON c.s = b.o")
_add("path_neg", f"SELECT ?s ?o WHERE {{ GRAPH <{V}graph/geography> {{ ?s !(v:nationName|a|v:regionName) ?o }} }}", "SELECT n_nationkey AS s, n_regionkey AS o FROM nation")
_add("path_nested", "SELECT ?x ?name WHERE { ?x (v:custNation|v:suppNation)/v:nationName ?name }", "SELECT c_custkey AS x, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
_add("path_turns", "SELECT ?a (COUNT(?b) AS ?n) WHERE { ?a v:nextTurn+ ?b } GROUP BY ?a", "WITH RECURSIVE e AS (SELECT DISTINCT conv_id * 1000 + turn AS s, conv_id * 1000 + turn + 1 AS o FROM conversations), r(s, o) AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON e.s = r.o) SELECT s AS a, count(*) AS n FROM r GROUP BY s")

# functions ------------------------------------------------------------------------
_add("fn_string", "SELECT ?c (UCASE(?n) AS ?u) (LCASE(?n) AS ?l) (STRLEN(?n) AS ?k) (SUBSTR(?n, 1, 4) AS ?h) (SUBSTR(?n, 5) AS ?t) (CONCAT(?n, '-', STR(?c)) AS ?x) WHERE { ?c v:custName ?n }", "SELECT c_custkey AS c, upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS k, substr(c_name, 1, 4) AS h, substr(c_name, 5) AS t, c_name || '-' || c_custkey AS x FROM customer")
_add("fn_string_search", "SELECT ?p ?n WHERE { ?p v:partName ?n ; v:partType ?t FILTER(CONTAINS(?n, 'ed w') && STRSTARTS(?t, 'S') || STRENDS(?n, 'ring') || REGEX(?t, 'promo', 'i')) }", "SELECT p_partkey AS p, p_name AS n FROM part WHERE (contains(p_name, 'ed w') AND starts_with(p_type, 'S')) OR ends_with(p_name, 'ring') OR regexp_matches(p_type, '(?i)promo')")
_add("fn_contains", "SELECT ?p (CONTAINS(?n, 'l ') AS ?a) (STRSTARTS(?n, 's') AS ?b) (STRENDS(?n, 't') AS ?c) (REGEX(?n, '^[a-m].* r') AS ?d) WHERE { ?p v:partName ?n }", "SELECT p_partkey AS p, contains(p_name, 'l ') AS a, starts_with(p_name, 's') AS b, ends_with(p_name, 't') AS c, regexp_matches(p_name, '^[a-m].* r') AS d FROM part")
_add("fn_seconds", "SELECT ?e (xsd:double(SECONDS(?t)) AS ?s) (TIMEZONE(?t) AS ?z) WHERE { ?e v:eventTime ?t }", "SELECT event_id AS e, (date_part('microsecond', ts) / 1e6)::double AS s, 0::bigint AS z FROM events")
_add("fn_cast_more", "SELECT ?p (xsd:double(xsd:decimal(?r)) AS ?a) (xsd:float(?s) AS ?b) (xsd:integer(STRDT(SUBSTR(?n, 7), xsd:integer)) AS ?c) (STRDT(SUBSTR(?n, 7), xsd:integer) + 1 AS ?d) WHERE { ?p v:retailPrice ?r ; v:size ?s ; v:brand ?n }", "SELECT p_partkey AS p, p_retailprice::decimal(38,18)::double AS a, p_size::float AS b, substr(p_brand, 7)::bigint AS c, substr(p_brand, 7)::bigint + 1 AS d FROM part")
_add("fn_cast_dates", "SELECT ?o (xsd:date(?d) AS ?a) (xsd:dateTime(SUBSTR(STR(?d), 1, 10)) AS ?b) (xsd:date('nothing') AS ?c) WHERE { ?o v:orderDate ?d }", "SELECT o_orderkey AS o, o_orderdate::date AS a, date_trunc('day', o_orderdate) AS b, NULL::date AS c FROM orders")
_add("fn_compare_functions", "SELECT ?p (EQ(?s, 5) AS ?a) (NEQ(?s, 5) AS ?b) (LT(?s, 5) AS ?c) (LTE(?s, 5) AS ?d) (GT(?s, 5) AS ?e) (GTE(?s, 5) AS ?f) WHERE { ?p v:size ?s }", "SELECT p_partkey AS p, p_size = 5 AS a, p_size <> 5 AS b, p_size < 5 AS c, p_size <= 5 AS d, p_size > 5 AS e, p_size >= 5 AS f FROM part")
_add("having_no_group", "SELECT (COUNT(?c) AS ?n) WHERE { ?c v:acctBal ?b } HAVING (COUNT(?c) > 10)", "SELECT count(*) AS n FROM customer HAVING count(*) > 10")
_add("from_named", f"SELECT ?g ?n FROM NAMED <{V}graph/geography> WHERE {{ GRAPH ?g {{ ?x v:regionName ?n }} }}", f"SELECT '{V}graph/geography' AS g, r_name AS n FROM region")
_add("fn_strbefore_after", "SELECT ?o (STRBEFORE(?p, '-') AS ?a) (STRAFTER(?p, '-') AS ?b) (STRBEFORE(?p, '~') AS ?z) WHERE { ?o v:priority ?p }", "SELECT o_orderkey AS o, split_part(o_orderpriority, '-', 1) AS a, substr(o_orderpriority, instr(o_orderpriority, '-') + 1) AS b, '' AS z FROM orders")
_add("fn_replace_regex", "SELECT ?p (REPLACE(?b, '[0-9]+', 'N') AS ?x) (REPLACE(?b, 'brand', 'B', 'i') AS ?y) WHERE { ?p v:brand ?b }", "SELECT p_partkey AS p, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS x, regexp_replace(p_brand, 'brand', 'B', 'gi') AS y FROM part")
_add("fn_encode_uri", "SELECT ?b (ENCODE_FOR_URI(CONCAT(?b, ' a/b*')) AS ?x) WHERE { ?p v:brand ?b } GROUP BY ?b", "SELECT DISTINCT p_brand AS b, replace(p_brand, '#', '%23') || '%20a%2Fb%2A' AS x FROM part")
_add("fn_math", "SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?u) (FLOOR(?b) AS ?d) (ROUND(?b) AS ?r) (MOD(?c, 7) AS ?m) WHERE { ?c v:acctBal ?b }", "SELECT c_custkey AS c, abs(c_acctbal) AS a, ceil(c_acctbal)::bigint AS u, floor(c_acctbal)::bigint AS d, round(c_acctbal) AS r, c_custkey % 7 AS m FROM customer")
_add("fn_datetime", "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) (TZ(?d) AS ?z) WHERE { ?o v:orderDate ?d }", "SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS k, hour(o_orderdate) AS h, minute(o_orderdate) AS i, 'Z' AS z FROM orders")
_add("fn_date_difference", "SELECT ?o (?d - '1992-01-01'^^xsd:date AS ?n) WHERE { ?o v:orderDate ?d }", "SELECT o_orderkey AS o, date_diff('day', DATE '1992-01-01', o_orderdate::date) AS n FROM orders")
_add("fn_if_coalesce_bound", "SELECT ?c (IF(?b > 0, 'plus', 'minus') AS ?s) (COALESCE(?o, -1) AS ?x) (BOUND(?o) AS ?has) WHERE { ?c v:acctBal ?b OPTIONAL { ?o v:placedBy ?c ; v:orderStatus 'P' } }", "SELECT c_custkey AS c, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS s, coalesce(o_orderkey, -1) AS x, o_orderkey IS NOT NULL AS has FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
_add("fn_hash", "SELECT ?n (MD5(?x) AS ?a) (SHA1(?x) AS ?b) (SHA256(?x) AS ?c) WHERE { ?n v:nationName ?x }", "SELECT n_nationkey AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation")
_add("fn_cast", "SELECT ?p (xsd:string(?s) AS ?t) (xsd:double(?s) AS ?d) (xsd:integer(SUBSTR(?b, 7)) AS ?i) (xsd:integer(?b) AS ?bad) (xsd:boolean('true') AS ?y) WHERE { ?p v:size ?s ; v:brand ?b }", "SELECT p_partkey AS p, p_size::varchar AS t, p_size::double AS d, try_cast(substr(p_brand, 7) AS bigint) AS i, NULL::bigint AS bad, true AS y FROM part")
_add("fn_type_tests", "SELECT ?n (ISIRI(?n) AS ?a) (ISLITERAL(?x) AS ?b) (ISNUMERIC(?x) AS ?c) (ISBLANK(?n) AS ?d) (DATATYPE(?x) AS ?e) (LANG(?x) AS ?f) (SAMETERM(?x, ?x) AS ?g) WHERE { ?n v:nationName ?x }", "SELECT n_nationkey AS n, true AS a, true AS b, false AS c, false AS d, 'http://www.w3.org/2001/XMLSchema#string' AS e, '' AS f, true AS g FROM nation")
_add("fn_lang", "SELECT ?n (LANG(STRLANG(?x, 'en-GB')) AS ?l) (LANGMATCHES(LANG(STRLANG(?x, 'en-GB')), 'en') AS ?m) (IRI(CONCAT('http://x/', ?x)) AS ?i) WHERE { ?n v:nationName ?x }", "SELECT n_nationkey AS n, 'en-GB' AS l, true AS m, 'http://x/' || n_name AS i FROM nation")
_add("fn_error_unbound", "SELECT ?p (?s / (?s - ?s) AS ?x) (?b + 1 AS ?y) WHERE { ?p v:size ?s ; v:brand ?b }", "SELECT p_partkey AS p, NULL::double AS x, NULL::double AS y FROM part")
_add("fn_now_rand_uuid", "SELECT ?r (NOW() AS ?t) (RAND() AS ?x) (STRUUID() AS ?u) WHERE { ?r v:regionName ?n }", None)


_EDGES_SQL = "SELECT c_custkey AS s, 'http://example.org/edge/knows' AS p, c_custkey // 3 AS o FROM customer WHERE c_custkey >= 3 UNION ALL SELECT c_custkey, 'http://example.org/edge/likes', c_nationkey FROM customer"


def _edges(e: Engine, text: str) -> DataFrame:
    """With a generic table of edges for predicates that no mapping names."""
    customer = e.catalog.table("customer")
    e.register_table("rdf_triples", customer.filter("c_custkey >= 3").selectExpr("c_custkey AS s", "'http://example.org/edge/knows' AS p", "CAST(floor(c_custkey / 3) AS BIGINT) AS o").union(customer.selectExpr("c_custkey", "'http://example.org/edge/likes'", "CAST(c_nationkey AS BIGINT)")))
    return e.query("PREFIX e: <http://example.org/edge/> " + text)


_add("edges_triple", "SELECT ?a ?b ?n WHERE { ?a e:knows ?b . ?b e:likes ?x . ?x v:nationName ?n }", f"WITH t AS ({_EDGES_SQL}) SELECT k.s AS a, k.o AS b, n_name AS n FROM t k JOIN t l ON l.s = k.o AND l.p LIKE '%likes' JOIN nation ON n_nationkey = l.o WHERE k.p LIKE '%knows'", run=_edges)
_add("edges_path_plus", "SELECT ?a ?b WHERE { ?a e:knows+ ?b }", f"WITH RECURSIVE t AS ({_EDGES_SQL}), r(s, o) AS (SELECT s, o FROM t WHERE p LIKE '%knows' UNION SELECT r.s, t.o FROM r JOIN t ON t.s = r.o AND t.p LIKE '%knows') SELECT s AS a, o AS b FROM r", run=_edges)
_add("edges_path_alt", "SELECT ?a ?b WHERE { ?a (e:knows/e:likes|^e:knows) ?b }", f"WITH t AS ({_EDGES_SQL}) SELECT k.s AS a, l.o AS b FROM t k JOIN t l ON l.s = k.o AND l.p LIKE '%likes' WHERE k.p LIKE '%knows' UNION ALL SELECT o, s FROM t WHERE p LIKE '%knows'", run=_edges)


def _udf(e: Engine, text: str) -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def tenth(x: pd.Series) -> pd.Series:
        return x * 0.1

    e.register_function(V + "tenth", tenth, 1, 1)
    e.register_function("TWICE", lambda x: x * 2, 1, 1)
    return e.query(text)


_add("fn_custom_udf", "SELECT ?c (v:tenth(?b) AS ?x) (TWICE(?b) AS ?y) WHERE { ?c v:acctBal ?b }", "SELECT c_custkey AS c, c_acctbal * 0.1::double AS x, c_acctbal * 2 AS y FROM customer", run=_udf)



def _udaf(e: Engine, text: str) -> DataFrame:
    e.register_aggregate("MEDIAN", F.median)
    return e.query(text)


_add("fn_custom_aggregate", "SELECT ?g (MEDIAN(?b) AS ?m) WHERE { ?c v:segment ?g ; v:acctBal ?b } GROUP BY ?g HAVING (MEDIAN(?b) > 0)", "SELECT c_mktsegment AS g, median(c_acctbal) AS m FROM customer GROUP BY 1 HAVING median(c_acctbal) > 0", run=_udaf)

# graphs, forms ----------------------------------------------------------------------
_add("var_predicate", "SELECT ?p ?o WHERE { <http://example.org/vkg/nation/3> ?p ?o }", f"SELECT '{V}nationName' AS p, n_name AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '{V}inRegion', n_regionkey::varchar FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{V}Nation'")
_add("var_class", "SELECT ?c (COUNT(?s) AS ?n) WHERE { ?s a ?c } GROUP BY ?c", " UNION ALL ".join(f"SELECT '{V}{name}' AS c, count(*) AS n FROM ({table if table.startswith('SELECT') else 'SELECT 1 FROM ' + table})" for name, table, _, _ in _MAPS).replace("concat('POINT(', c_custkey % 100, ' ', CAST(floor(c_custkey / 100) AS BIGINT), ')')", "1"))
_add("named_graph", f"SELECT ?n WHERE {{ GRAPH <{V}graph/geography> {{ ?r v:regionName ?n }} }}", "SELECT r_name AS n FROM region")
_add("named_graph_var", "SELECT ?g (COUNT(?t) AS ?k) WHERE { GRAPH ?g { ?e v:eventType ?t } } GROUP BY ?g", f"SELECT '{V}graph/activity' AS g, count(*) AS k FROM events")
_add("from_graph", f"SELECT ?x ?n FROM <{V}graph/geography> WHERE {{ ?x v:nationName ?n OPTIONAL {{ ?e v:eventType ?n }} }}", "SELECT n_nationkey AS x, n_name AS n FROM nation")
_add("describe_iri", "DESCRIBE <http://example.org/vkg/region/2>", f"SELECT '2' AS subject, '{V}regionName' AS predicate, r_name AS object FROM region WHERE r_regionkey = 2 UNION ALL SELECT '2', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{V}Region'")
_add("describe_var", "DESCRIBE ?s WHERE { ?s v:suppBal ?b FILTER(?b > 9000) }", f"WITH x AS (SELECT * FROM supplier WHERE s_acctbal > 9000) SELECT s_suppkey::varchar AS subject, '{V}suppName' AS predicate, s_name AS object FROM x UNION ALL SELECT s_suppkey::varchar, '{V}suppNation', s_nationkey::varchar FROM x UNION ALL SELECT s_suppkey::varchar, '{V}suppBal', s_acctbal::varchar FROM x UNION ALL SELECT s_suppkey::varchar, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{V}Supplier' FROM x")
_add("construct", "CONSTRUCT { ?n v:label ?x . ?n v:part ?r } WHERE { ?n v:nationName ?x ; v:inRegion ?r }", f"SELECT n_nationkey::varchar AS subject, '{V}label' AS predicate, n_name AS object FROM nation UNION ALL SELECT n_nationkey::varchar, '{V}part', n_regionkey::varchar FROM nation")
_add("construct_iri", "CONSTRUCT { ?n v:part ?r } WHERE { ?n v:inRegion ?r }", f"SELECT '{V}nation/' || n_nationkey AS subject, '{V}part' AS predicate, '{V}region/' || n_regionkey AS object FROM nation", node_mode="iri")
_add("ask_true", "ASK { ?c v:acctBal ?b FILTER(?b > 9000) }", "SELECT count(*) > 0 AS boolean FROM customer WHERE c_acctbal > 9000")
_add("ask_false", "ASK { ?c v:acctBal ?b FILTER(?b > 1e12) }", "SELECT false AS boolean")
_add("json_rows", "SELECT ?r ?n WHERE { ?r v:regionName ?n }", """SELECT '{"r":' || r_regionkey || ',"n":"' || r_name || '"}' AS json FROM region""", run=lambda e, q: e.json_rows(q))
_add("iri_mode_join", "SELECT ?c ?name WHERE { ?c v:custNation ?n . ?n v:nationName ?name }", f"SELECT '{V}customer/' || c_custkey AS c, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey", node_mode="iri")


def _service(e: Engine, text: str) -> DataFrame:
    other = Engine(e.spark, prefixes={"v": V})
    other.tables.update(e.tables)
    other.load_mapping(mapping())
    e.services.register("http://example.org/other", other.sparql_json)
    return e.query(text)


_add("service", "SELECT ?c ?name WHERE { ?c v:custNation ?n ; v:segment 'BUILDING' SERVICE <http://example.org/other> { ?n v:nationName ?name } }", "SELECT c_custkey AS c, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'", run=_service)
_add("service_silent", "SELECT ?r WHERE { ?r v:regionName ?n SERVICE SILENT <http://example.org/missing> { ?n v:x ?y } }", "SELECT r_regionkey AS r FROM region")

# reasoning --------------------------------------------------------------------------
_add("subclass", "SELECT (COUNT(?p) AS ?n) WHERE { ?p a v:Party }", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
_add("subproperty", "SELECT ?p ?b WHERE { ?p v:balance ?b FILTER(?b > 9500) }", "SELECT c_custkey AS p, c_acctbal AS b FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 9500")
_add("inverse_of", "SELECT ?c ?o WHERE { ?c v:placed ?o }", "SELECT o_custkey AS c, o_orderkey AS o FROM orders")
_add("domain_range", "SELECT (COUNT(DISTINCT ?b) AS ?n) WHERE { ?b a v:Buyer }", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
_add("reasoned_star", "SELECT ?p ?b WHERE { ?p a v:Party ; v:balance ?b FILTER(?b < -900) }", "SELECT c_custkey AS p, c_acctbal AS b FROM customer WHERE c_acctbal < -900 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < -900")

# geometry -----------------------------------------------------------------------------
_SITE = "(SELECT c_custkey, c_custkey % 100 AS x, c_custkey // 100 AS y FROM customer)"
_add("geo_within", "SELECT ?s WHERE { ?s v:asWKT ?g FILTER(geof:sfWithin(?g, 'POLYGON((10 -1, 20 -1, 20 40, 10 40, 10 -1))'^^geo:wktLiteral)) }", f"SELECT c_custkey AS s FROM {_SITE} WHERE x > 10 AND x < 20 AND y > -1 AND y < 40")
_add("geo_contains", "SELECT ?s WHERE { ?s v:asWKT ?g FILTER(geof:sfContains('POLYGON((0 -1, 5 -1, 5 3, 0 3, 0 -1))'^^geo:wktLiteral, ?g)) }", f"SELECT c_custkey AS s FROM {_SITE} WHERE x > 0 AND x < 5 AND y > -1 AND y < 3")
_add("geo_intersects", "SELECT ?s WHERE { ?s v:asWKT ?g FILTER(geof:sfIntersects(?g, 'LINESTRING(0 0, 50 0)'^^geo:wktLiteral)) }", f"SELECT c_custkey AS s FROM {_SITE} WHERE y = 0 AND x <= 50")
_add("geo_distance", "SELECT ?s ?d WHERE { ?s v:asWKT ?g BIND(geof:distance(?g, 'POINT(50 5)'^^geo:wktLiteral, uom:metre) AS ?d) FILTER(?d < 10) }", f"SELECT c_custkey AS s, sqrt((x - 50) * (x - 50) + (y - 5) * (y - 5)) AS d FROM {_SITE} WHERE (x - 50) * (x - 50) + (y - 5) * (y - 5) < 100")
_add("geo_buffer", "SELECT ?s WHERE { ?s v:asWKT ?g FILTER(geof:sfWithin(?g, geof:buffer('POINT(30 2)'^^geo:wktLiteral, 4, uom:metre))) }", f"SELECT c_custkey AS s FROM {_SITE} WHERE (x - 30) * (x - 30) + (y - 2) * (y - 2) <= 16")
_add("geo_point", "SELECT ?p (geof:distance(POINT(?s, ?s), 'POINT(0 0)'^^geo:wktLiteral) AS ?d) (geof:intersects(POINT(?s, 5), 'LINESTRING(0 5, 20 5)'^^geo:wktLiteral) AS ?i) (geof:sfEquals(POINT(?s, 7), 'POINT(9 7)'^^geo:wktLiteral) AS ?e) WHERE { ?p v:size ?s }", "SELECT p_partkey AS p, sqrt(2.0 * p_size * p_size) AS d, p_size BETWEEN 0 AND 20 AS i, p_size = 9 AS e FROM part")
_add("geo_srid", "SELECT ?s WHERE { ?s v:asWKT ?g FILTER(geof:sfWithin(CONCAT('SRID=4326;', ?g), 'SRID=4326;POLYGON((10 -1, 20 -1, 20 40, 10 40, 10 -1))'^^geo:wktLiteral)) }", f"SELECT c_custkey AS s FROM {_SITE} WHERE x > 10 AND x < 20 AND y > -1 AND y < 40")
_add("geo_lines_and_areas", "SELECT ?p (geof:sfCrosses(CONCAT('LINESTRING(0 0, ', STR(?s), ' 0)'), 'POLYGON((10 -5, 20 -5, 20 5, 10 5, 10 -5))'^^geo:wktLiteral) AS ?c) (geof:sfOverlaps(CONCAT('POLYGON((0 0, ', STR(?s), ' 0, ', STR(?s), ' 9, 0 9, 0 0))'), 'POLYGON((10 -5, 20 -5, 20 5, 10 5, 10 -5))'^^geo:wktLiteral) AS ?o) (geof:sfEquals(CONCAT('POLYGON((0 0, ', STR(?s), ' 0, ', STR(?s), ' 9, 0 9, 0 0))'), 'POLYGON((9 0, 9 9, 0 9, 0 0, 9 0))'^^geo:wktLiteral) AS ?e) WHERE { ?p v:size ?s FILTER(?s > 0) }", "SELECT p_partkey AS p, p_size > 10 AS c, p_size > 10 AS o, p_size = 9 AS e FROM part WHERE p_size > 0")
_add("geo_disjoint_touches", "SELECT ?s (geof:sfDisjoint(?g, 'POLYGON((10 -1, 20 -1, 20 40, 10 40, 10 -1))'^^geo:wktLiteral) AS ?d) (geof:sfTouches(?g, 'POLYGON((10 -1, 20 -1, 20 40, 10 40, 10 -1))'^^geo:wktLiteral) AS ?t) WHERE { ?s v:asWKT ?g }", f"SELECT c_custkey AS s, NOT (x BETWEEN 10 AND 20 AND y BETWEEN -1 AND 40) AS d, x BETWEEN 10 AND 20 AND y BETWEEN -1 AND 40 AND (x IN (10, 20) OR y IN (-1, 40)) AS t FROM {_SITE}")

# windows --------------------------------------------------------------------------------
_add("win_rank", "SELECT ?c ?g (RANK() OVER (PARTITION BY ?g ORDER BY DESC(?b)) AS ?k) (ROW_NUMBER() OVER (PARTITION BY ?g ORDER BY DESC(?b) ?c) AS ?n) WHERE { ?c v:segment ?g ; v:acctBal ?b }", "SELECT c_custkey AS c, c_mktsegment AS g, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS k, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer")
_add("win_running_sum", "SELECT ?y ?n (SUM(?n) OVER (ORDER BY ?y) AS ?run) WHERE { { SELECT ?y (COUNT(?o) AS ?n) WHERE { ?o v:orderDate ?d } GROUP BY (YEAR(?d) AS ?y) } }", "SELECT y, n, sum(n) OVER (ORDER BY y)::bigint AS run FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)")
_add("win_percent_rank", "SELECT ?c (PERCENT_RANK() OVER (PARTITION BY ?n ORDER BY ?b) AS ?p) (?b - AVG(?b) OVER (PARTITION BY ?n) AS ?diff) WHERE { ?c v:custNation ?n ; v:acctBal ?b }", "SELECT c_custkey AS c, percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS p, c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS diff FROM customer")

# streams: a bounded run over the events table must give the batch answer ---------------------
_add("stream_window_count", "", "SELECT time_bucket(INTERVAL 1 day, ts) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL", run=windows.daily_counts)
_add("stream_watermark", "", "SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, event_type AS kind, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 10 minutes GROUP BY ALL", run=windows.hourly_counts)


_engines: dict[tuple, Engine] = {}


def _shared_engine(spark: SparkSession, sf_dir: str, options: tuple) -> Engine:
    """One engine per session, folder and options, as a server would keep it."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, options)
    if key not in _engines:
        _engines[key] = engine(spark, sf_dir, **dict(options))
    return _engines[key]


def _of(name: str, entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if entry.run:
            return entry.run(engine(spark, sf_dir, **dict(entry.options)), entry.sparql or sf_dir)
        return _shared_engine(spark, sf_dir, entry.options).query(entry.sparql)

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _of(name, entry) for name, entry in _CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in _CATALOGUE.items() if entry.sql}
