"""A lending library: a schema, rows and a mapping of its own, for tests of whole queries."""

from __future__ import annotations

import datetime

from trellis.engine import Engine

LIB = "http://library.test/ns#"
ROOT = "http://library.test/"
OPENED = datetime.date(2019, 3, 4)
SHELVES = ["attic", "cellar", "hall"]
TITLES = ["Moss", "Tide", "Quartz", "Ember", "Fjord", "Willow", "Comet", "Saffron"]
MAPPING = f"""
@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix lib: <{LIB}> .
<#Branch> rr:logicalTable [ rr:tableName "branch" ] ; rr:subjectMap [ rr:template "{ROOT}branch/{{code}}" ; rr:class lib:Branch ] ;
  rr:predicateObjectMap [ rr:predicate lib:town ; rr:objectMap [ rr:column "town" ; rr:language "nl" ] ] ;
  rr:predicateObjectMap [ rr:predicate lib:shelfRoom ; rr:objectMap [ rr:column "room" ] ] .
<#Volume> rr:logicalTable [ rr:tableName "volume" ] ; rr:subjectMap [ rr:template "{ROOT}volume/{{shelfmark}}" ; rr:class lib:Volume ] ;
  rr:predicateObjectMap [ rr:predicate lib:title , lib:label ; rr:objectMap [ rr:column "title" ] ] ;
  rr:predicateObjectMap [ rr:predicate lib:pages ; rr:objectMap [ rr:column "pages" ] ] ;
  rr:predicateObjectMap [ rr:predicate lib:acquired ; rr:objectMap [ rr:column "acquired" ] ] ;
  rr:predicateObjectMap [ rr:predicate lib:blurb ; rr:objectMap [ rr:column "blurb" ] ] ;
  rr:predicateObjectMap [ rr:predicate lib:sequelOf ; rr:objectMap [ rr:column "precursor" ] ] ;
  rr:predicateObjectMap [ rr:predicate lib:medium ; rr:object "paper" ] ;
  rr:predicateObjectMap [ rr:predicate lib:keptAt ; rr:objectMap [ rr:column "branch_code" ] ] ;
  rr:predicateObjectMap [ rr:predicate lib:home ; rr:objectMap [ rr:parentTriplesMap <#Branch> ; rr:joinCondition [ rr:child "branch_code" ; rr:parent "code" ] ] ] .
<#Loan> rr:logicalTable [ rr:sqlQuery "SELECT shelfmark, reader, renewals FROM loan WHERE renewals < 4" ] ; rr:subjectMap [ rr:template "{ROOT}volume/{{shelfmark}}" ] ;
  rr:predicateObjectMap [ rr:predicate lib:lentTo ; rr:objectMap [ rr:template "{ROOT}reader/{{reader}}" ] ] .
"""


def volumes() -> list[tuple]:
    """Shelfmark, title, pages, acquired, branch, blurb (none for multiples of nine), precursor."""
    return [
        (n, f"{TITLES[n % len(TITLES)]} {n // len(TITLES)}", 60.0 + (n * 37) % 400, OPENED + datetime.timedelta(weeks=n), 11 + n % 4, None if n % 9 == 0 else f"about {TITLES[n % 8].lower()}", n - 8 if n > 8 else None)
        for n in range(1, 55)
    ]


def library(spark, **options) -> Engine:
    """54 volumes in four of five branches."""
    engine = Engine(spark, prefixes={"lib": LIB}, **options)
    engine.register_table("volume", spark.createDataFrame(volumes(), "shelfmark int, title string, pages double, acquired date, branch_code int, blurb string, precursor int"))
    engine.register_table("branch", spark.createDataFrame([(11 + i, f"Town {'ABCDE'[i]}", SHELVES[i % 3]) for i in range(5)], "code int, town string, room string"))
    engine.register_table("loan", spark.createDataFrame([(n % 13 + 1, n % 5, n % 6) for n in range(36)], "shelfmark int, reader int, renewals int"))
    engine.load_mapping(MAPPING)
    return engine
