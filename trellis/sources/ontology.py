"""OWL 2 QL ontologies: hierarchies, inverses, domains and ranges, saturated on the driver."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from trellis.sources.turtle import read
from trellis.sparql import ast as A

#: A class expression: ("class", iri), or ("some", property, inverse) for the subjects (objects) of a property.
Concept = tuple


@dataclass
class Ontology:
    classes: set[str] = field(default_factory=set)
    object_properties: set[str] = field(default_factory=set)
    datatype_properties: set[str] = field(default_factory=set)
    functional: set[str] = field(default_factory=set)
    labels: dict[str, str] = field(default_factory=dict)
    comments: dict[str, str] = field(default_factory=dict)
    sub_class: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))  # parent -> children
    sub_property: dict[str, set[tuple[str, bool]]] = field(default_factory=lambda: defaultdict(set))  # parent -> (child, inverse)
    domain: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))  # property -> classes
    range: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    disjoint: set[frozenset] = field(default_factory=set)
    characteristics: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    version: int = 0

    def properties_of(self, iri: str) -> list[tuple[str, bool]]:
        """Properties, and whether inverted, whose triples are triples of ``iri`` too (itself first)."""
        found, todo = {(iri, False): None}, [(iri, False)]
        while todo:
            name, inverse = todo.pop()
            for child, flipped in sorted(self.sub_property.get(name, ())):
                step = (child, inverse != flipped)
                if step not in found:
                    found[step] = None
                    todo.append(step)
            if "symmetric" in self.characteristics.get(name, ()) and (name, not inverse) not in found:
                found[(name, not inverse)] = None
        return list(found)

    def classes_of(self, iri: str) -> list[str]:
        """The class and all classes below it."""
        found, todo = {iri: None}, [iri]
        while todo:
            for child in sorted(self.sub_class.get(todo.pop(), ())):
                if child not in found:
                    found[child] = None
                    todo.append(child)
        return list(found)

    def concepts_of(self, iri: str) -> list[Concept]:
        """Everything whose members are members of the class: classes below it, subjects or objects of properties."""
        found: dict[Concept, None] = {}
        for c in self.classes_of(iri):
            found[("class", c)] = None
            for sides, inverse in ((self.domain, False), (self.range, True)):
                for prop in sorted(p for p, cs in sides.items() if c in cs):
                    for name, flipped in self.properties_of(prop):
                        if not (inverse and name in self.datatype_properties):
                            found[("some", name, inverse != flipped)] = None
        return list(found)

    def is_subclass(self, child: str, parent: str) -> bool:
        return child in self.classes_of(parent)

    def inconsistent_pairs(self) -> list[tuple[str, str]]:
        """Disjoint classes of which one is below the other."""
        return sorted(tuple(sorted(p)) for p in self.disjoint if len(p) == 2 and any(self.is_subclass(a, b) for a in p for b in p if a != b))

    def merge(self, other: Ontology) -> None:
        for name in ("classes", "object_properties", "datatype_properties", "functional", "disjoint"):
            getattr(self, name).update(getattr(other, name))
        self.labels.update(other.labels)
        self.comments.update(other.comments)
        for name in ("sub_class", "sub_property", "domain", "range", "characteristics"):
            for key, value in getattr(other, name).items():
                getattr(self, name)[key] |= value
        self.version += 1


def load_ontology(text: str) -> Ontology:
    """The ontology of a Turtle document."""
    o = Ontology()
    for subject, properties in read(text).items():
        if not isinstance(subject, A.Iri):
            continue
        iri, kinds = subject.value, {getattr(t, "value", "") for t in properties.get(A.TYPE, [])}

        def iris(name: str, of=properties) -> list[str]:
            return [x.value for x in of.get(name, []) if isinstance(x, A.Iri)]

        if kinds & {A.OWL + "Class", A.RDFS + "Class"}:
            o.classes.add(iri)
        if A.OWL + "ObjectProperty" in kinds:
            o.object_properties.add(iri)
        if A.OWL + "DatatypeProperty" in kinds:
            o.datatype_properties.add(iri)
        for kind, name in (("Functional", "functional"), ("InverseFunctional", "inverse_functional"), ("Transitive", "transitive"), ("Symmetric", "symmetric"), ("Asymmetric", "asymmetric"), ("Reflexive", "reflexive"), ("Irreflexive", "irreflexive")):
            if f"{A.OWL}{kind}Property" in kinds:
                o.characteristics[iri].add(name)
                if name == "functional":
                    o.functional.add(iri)
        for literal in properties.get(A.RDFS + "label", []):
            o.labels[iri] = str(literal.value)
        for literal in properties.get(A.RDFS + "comment", []):
            o.comments[iri] = str(literal.value)
        for parent in iris(A.RDFS + "subClassOf"):
            o.sub_class[parent].add(iri)
        for same in iris(A.OWL + "equivalentClass"):
            o.sub_class[same].add(iri)
            o.sub_class[iri].add(same)
        for parent in iris(A.RDFS + "subPropertyOf"):
            o.sub_property[parent].add((iri, False))
        for same in iris(A.OWL + "equivalentProperty"):
            o.sub_property[same].add((iri, False))
            o.sub_property[iri].add((same, False))
        for other in iris(A.OWL + "inverseOf"):
            o.sub_property[iri].add((other, True))
            o.sub_property[other].add((iri, True))
        o.domain[iri] |= set(iris(A.RDFS + "domain"))
        o.range[iri] |= set(iris(A.RDFS + "range"))
        for other in iris(A.OWL + "disjointWith"):
            o.disjoint.add(frozenset((iri, other)))
    return o
