"""Label rules kept as rows of a table: read by the driver, checked, and compiled to one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.rules import Rule, apply_rules
from panelspark.operators.warehouse import ContractError

RULE_SCHEMA = "version string, rule_set string, priority int, kind string, texts array<string>, also string, code string"
KINDS = ("equals", "prefix", "contains")
#: Rules are literals of a plan, so a table may hold this many.
MAX_RULES = 2000

RuleBook = dict[tuple[str, str], tuple[Rule, ...]]


def rule_rows(spark: SparkSession, book: RuleBook) -> DataFrame:
    """A table of the rules in ``book``, keyed by version and rule set; the order of a set is its priority."""
    rows = [(v, s, i, r.kind, list(r.texts), r.also, r.code) for (v, s), rules in book.items() for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def read_rules(table: DataFrame) -> RuleBook:
    """The rules of a table in order of priority; unknown kinds, rules without a text, and equal priorities stop the read."""
    rows = table.select("version", "rule_set", "priority", "kind", "texts", "also", "code").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ContractError(f"more than {MAX_RULES} rules")
    book: dict[tuple[str, str], list[tuple[int, Rule]]] = {}
    for r in rows:
        if r["kind"] not in KINDS or not r["texts"] or r["code"] is None or r["kind"] == "prefix" and len(r["texts"]) > 1:
            raise ContractError(f"no rule: {r.asDict()}")
        rules = book.setdefault((r["version"], r["rule_set"]), [])
        if any(p == r["priority"] for p, _ in rules):
            raise ContractError(f"two rules of priority {r['priority']} in {r['version']}/{r['rule_set']}")
        rules.append((r["priority"], Rule(r["code"], r["kind"], tuple(r["texts"]), r["also"])))
    return {key: tuple(rule for _, rule in sorted(rules, key=lambda pair: pair[0])) for key, rules in book.items()}


def coded(label: Column, rule_set: Column, version: str, book: RuleBook) -> Column:
    """The code of a label under the rule set that its row names; NULL for a set the version lacks."""
    case = F
    for (v, name), rules in sorted(book.items()):
        if v == version:
            case = case.when(rule_set == name, apply_rules(label, rules))
    return F.lit(None).cast("string") if case is F else case
