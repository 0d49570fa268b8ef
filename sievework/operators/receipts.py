"""Rules over JSON receipts held in VARIANT columns; rules are rows of a table.

Every path that a rule names is read from its document once, into a map of JSON texts. Then
the rules, a constant array, are tried on that map within the row. So any number of
receipts takes one pass without a shuffle, and all broken rules come back as rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a rule asks of the value at its path.
KINDS = ("required", "digest", "equals", "alike", "same_digest", "mentions", "begins", "always")
_SCHEMA = (
    "array<struct<kind: string, name: string, at: string, expected: string, other: string, other_name: string, "
    "needs: array<string>>>"
)


@dataclass(frozen=True)
class Rule:
    """One rule about the value at ``path`` of ``document``.

    ``required``: it is neither absent, null nor "". ``digest``: it is a SHA-256 digest.
    ``equals``: its JSON text is that of ``expected``, so numbers, texts and flags never mix.
    ``alike``: it equals the text at ``other``, if both are texts. ``same_digest``: it is a digest and equals
    ``other``. ``mentions``, ``begins``: a text that holds or begins with ``expected``. ``always``: broken as it stands.
    The rule applies where all documents in ``needs`` are there.
    """

    kind: str
    document: str
    path: tuple[str, ...] = ()
    expected: Any = None
    other: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    name: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no such kind of rule: {self.kind}")

    def row(self) -> dict[str, Any]:
        text = self.expected if self.kind in ("mentions", "begins") else json.dumps(self.expected, ensure_ascii=False)
        return {
            "kind": self.kind, "name": self.name or ".".join((self.document, *self.path)),
            "at": place(self.document, *self.path), "expected": text, "other": place(*self.other) if self.other else None,
            "other_name": ".".join(self.other), "needs": list(self.needs or (self.document,)),
        }


def rules_from(rows: Iterable[dict[str, Any]], baseline: dict[str, Any] | None = None) -> list[Rule]:
    """Rules of a table, such as a JSON file holds; ``baseline`` in a row names the expected value."""
    found = []
    for row in rows:
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if k != "baseline"}
        if "baseline" in row:
            if row["baseline"] not in (baseline or {}):
                raise ValueError(f"no baseline value {row['baseline']}")
            given["expected"] = baseline[row["baseline"]]
        found.append(Rule(**given))
    return found


def table_of(rules: Iterable[Rule]) -> list[dict[str, Any]]:
    """The rows that ``rules_from`` reads back."""
    return [{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(r).items()} for r in rules]


def place(document: str, *path: str) -> str:
    return document + ":" + "".join(f"['{part}']" for part in path)


def literal(doc: Column, *path: str) -> Column:
    """The JSON text of a value; NULL if absent."""
    return F.to_json(F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in path), "variant"))


def broken_rules(documents: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, position, error) of every broken rule; documents are VARIANT columns, NULL where one is not there."""
    names = sorted({n for r in rules for n in (r.document, *r.needs, *r.other[:1]) if n})
    wanted = sorted({(r.document, *r.path) for r in rules if r.path} | {r.other for r in rules if r.other})
    there = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))
    facts = F.map_from_arrays(
        F.array(*[F.lit(place(*w)) for w in wanted]).cast("array<string>"),
        F.array(*[literal(F.col(doc), *path) for doc, *path in wanted]).cast("array<string>"),
    )
    read = documents.select(key, there.alias("_there"), facts.alias("_facts"))
    table = F.from_json(F.lit(json.dumps([r.row() for r in rules], ensure_ascii=False)), _SCHEMA)
    tried = F.transform(table, lambda r: F.when(F.forall(r["needs"], lambda n: F.array_contains("_there", n)), _error(r)))
    return read.select(key, F.posexplode(tried).alias("position", "error")).filter("error is not null")


def _error(rule: Column) -> Column:
    value, other = F.try_element_at("_facts", rule["at"]), F.try_element_at("_facts", rule["other"])
    name, kind, expected = rule["name"], rule["kind"], rule["expected"]
    blank = F.coalesce(value, F.lit("null")).isin("null", '""')
    digest = F.coalesce(value.rlike('^"[0-9a-f]{64}"$'), F.lit(False))
    differs = F.concat(name, F.lit(" differs from "), rule["other_name"])
    texts = value.startswith('"') & other.startswith('"')
    holds = {
        "mentions": F.lower(value).contains(F.lower(expected)),
        "begins": value.startswith(F.concat(F.lit('"'), expected)),
    }
    result = F.when((kind == "required") & blank, F.concat(name, F.lit(": no value")))
    result = result.when((kind == "digest") & blank, F.concat(name, F.lit(": no digest")))
    result = result.when(kind.isin("digest", "same_digest") & ~digest, F.concat(name, F.lit(": not a SHA-256 digest")))
    result = result.when((kind == "same_digest") & ~value.eqNullSafe(other), differs)
    result = result.when((kind == "alike") & F.coalesce(texts & (value != other), F.lit(False)), differs)
    result = result.when(
        (kind == "equals") & ~value.eqNullSafe(expected),
        F.concat(name, F.lit(": "), F.coalesce(value, F.lit("nothing")), F.lit(" instead of "), expected),
    )
    for which, held in holds.items():
        result = result.when(
            (kind == which) & ~F.coalesce(held, F.lit(False)), F.concat(name, F.lit(f": {which} nothing like "), expected)
        )
    return result.when(kind == "always", name)
