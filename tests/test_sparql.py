import pytest

from trellis.errors import QuerySyntaxError
from trellis.sparql import ast as A
from trellis.sparql.lexer import tokens, unquote
from trellis.sparql.parser import parse
from trellis.sources.mapping import load_r2rml
from trellis.sources.ontology import load_ontology


def only(text):
    return parse("PREFIX x: <http://x/> SELECT * WHERE { " + text + " }").where.elements


def test_tokens_tell_iris_from_comparisons():
    assert [t.kind for t in tokens("?a < ?b && <http://x/>")] == ["var", "op", "var", "op", "iri"]
    assert unquote(r'"a\nbA"') == "a\nbA"
    assert unquote("'''it's'''") == "it's"


def test_shorthands():
    assert len(only("?s x:p 1, 2 ; a x:C .")) == 3
    blank = only("?s x:p [ x:q 'v'@en ]")
    assert isinstance(blank[0].subject, A.Blank) and blank[0].object.lang == "en"
    assert [t.predicate.value.rsplit("#")[-1] for t in only("?s x:p (1 2)")][:4] == ["first", "rest", "first", "rest"]


def test_path_precedence():
    path = only("?s x:a/^x:b*|x:c ?o")[0].predicate
    assert isinstance(path, A.Alternative) and isinstance(path.options[0], A.Sequence)
    assert path.options[0].steps[1] == A.Inverse(A.Repeat(A.Iri("http://x/b"), 0, None))
    assert only("?s (x:a|x:b){2,} ?o")[0].predicate.most is None


def test_arithmetic_is_left_associative():
    e = only("FILTER(1 - 2 - 3 * 4 = 5)")[0].condition
    assert e.op == "=" and e.left.op == "-" and e.left.left.op == "-" and e.left.right.op == "*"


def test_modifiers_and_windows():
    q = parse("SELECT DISTINCT ?a (SUM(?b) OVER (PARTITION BY ?a ORDER BY DESC(?c)) AS ?s) WHERE { ?a ?b ?c } GROUP BY ?a HAVING (COUNT(*) > 1) ORDER BY ?a DESC LIMIT 3 OFFSET 4")
    assert q.distinct and q.limit == 3 and q.offset == 4 and q.order_by == ((A.Var("a"), True),)
    assert q.projection[1].expression.over.order[0][1]


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?a WHERE { ?a ?b }", "SELECT ?a { ?a ?b ?c", "ASK { ?a y:b 1 }", "SELECT ?a { ?a ?b ?c } LIMIT x"])
def test_errors_name_the_place(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_ontology_saturation():
    o = load_ontology("""@prefix x: <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
      x:A a owl:Class ; rdfs:subClassOf x:B . x:B rdfs:subClassOf x:C ; owl:disjointWith x:A . x:p a owl:ObjectProperty , owl:FunctionalProperty ; rdfs:domain x:A ; owl:inverseOf x:q . x:r rdfs:subPropertyOf x:p . x:s a owl:SymmetricProperty .""")
    assert o.classes_of("http://x/C") == ["http://x/C", "http://x/B", "http://x/A"]
    assert set(o.properties_of("http://x/q")) == {("http://x/q", False), ("http://x/p", True), ("http://x/r", True)}
    assert ("some", "http://x/r", False) in o.concepts_of("http://x/C")
    assert ("http://x/s", True) in o.properties_of("http://x/s")
    assert "http://x/p" in o.functional and o.inconsistent_pairs() == [("http://x/A", "http://x/B")]


def test_mapping_terms():
    store = load_r2rml("""@base <http://b/> . @prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix x: <http://x/> .
      <#M> rr:logicalTable [ rr:tableName "t" ] ; rr:subjectMap [ rr:template "http://x/{a}/{b}" ; rr:class x:C ; rr:graph x:g ] ;
        rr:predicateObjectMap [ rr:predicate x:p ; rr:objectMap [ rr:column "c" ; rr:datatype x:d ] ] ; rr:predicateObjectMap [ rr:predicate x:q ; rr:object x:o ] .""")
    rule = store.rules["http://x/p"][0]
    assert rule.subject.columns == ("a", "b") and rule.subject.shape == "http://x/{}/{}" and rule.graph == "http://x/g"
    assert rule.subject.key_of("http://x/12/z") == "12" and rule.subject.key_of("http://y/12/z") is None
    assert store.rules["http://x/q"][0].object.value == A.Iri("http://x/o") and "http://x/C" in store.classes
