"""Ordered label rules compiled to one CASE expression (no join, stays in codegen)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.cells import norm_label, strip_footnotes


@dataclass(frozen=True)
class Rule:
    """``code`` applies when the label equals / starts with / contains one of ``texts``.

    ``also`` adds a substring that must be present as well.
    """

    code: str
    kind: str
    texts: tuple[str, ...]
    also: str | None = None

    def matches(self, label: Column) -> Column:
        if self.kind == "equals":
            hit = label.isin(*self.texts)
        elif self.kind == "prefix":
            hit = label.startswith(self.texts[0])
        else:
            hit = label.contains(self.texts[0])
            for text in self.texts[1:]:
                hit = hit | label.contains(text)
        return hit & label.contains(self.also) if self.also else hit


# Employment labels, in order of precedence.
EMPLOYMENT_RULES = (
    Rule("EB1", "equals", ("1st",)),
    Rule("EB2", "equals", ("2nd",)),
    Rule("EB3", "equals", ("3rd",)),
    Rule("EB4", "equals", ("4th",)),
    Rule("EB3_OW", "prefix", ("other worker",)),
    Rule("EB4_RW", "contains", ("religious", "religiuos")),
    Rule("EB4_TRANS", "contains", ("translator",)),
    Rule("EB5_RURAL", "contains", ("set aside", "set-aside"), "rural"),
    Rule("EB5_HIGHUNEMP", "contains", ("set aside", "set-aside"), "high unemployment"),
    Rule("EB5_INFRA", "contains", ("set aside", "set-aside"), "infrastructure"),
    Rule("EB5_UNRESERVED", "contains", ("set aside", "set-aside")),
    Rule("EB5_UNRESERVED", "contains", ("unreserved",)),
    Rule("EB5_TEA", "contains", ("targeted employment",)),
    Rule("EB5_PILOT", "contains", ("pilot prog",)),
    Rule("EB5_NONRC", "contains", ("non-regional center",)),
    Rule("EB5_RC", "contains", ("regional center",)),
    Rule("EB5", "equals", ("5th",)),
)

# Family labels.
FAMILY_RULES = (
    Rule("1", "equals", ("1st", "f1")),
    Rule("2A", "equals", ("2a", "2nd-a", "2nda", "f2a")),
    Rule("2B", "equals", ("2b", "2nd-b", "2ndb", "f2b")),
    Rule("3", "equals", ("3rd", "f3")),
    Rule("4", "equals", ("4th", "4rd", "f4")),
)

# Region labels and their two-letter codes.
REGION_RULES = (
    Rule("africa", "contains", ("africa",)),
    Rule("asia", "contains", ("asia",)),
    Rule("europe", "contains", ("europe",)),
    Rule("north_america", "contains", ("north america",)),
    Rule("oceania", "contains", ("oceania",)),
    Rule("south_america_caribbean", "contains", ("south america",)),
)
REGION_CODES = {
    "africa": "AF",
    "asia": "AS",
    "europe": "EU",
    "north_america": "NA",
    "oceania": "OC",
    "south_america_caribbean": "SA",
}

# Area column headers (normalised substrings).
AREA_RULES = (
    Rule("india", "contains", ("india",)),
    Rule("china", "contains", ("china",)),
    Rule("mexico", "contains", ("mexico",)),
    Rule("philippines", "contains", ("philippines",)),
    Rule("all_chargeability", "contains", ("except those listed",)),
)


def apply_rules(label: Column, rules: tuple[Rule, ...]) -> Column:
    """First matching rule wins; NULL when none applies.

    The label is bound once by a one-element ``transform``; spelled out per rule it would be
    recomputed for every branch and outgrow a generated method.
    """

    def case(text: Column) -> Column:
        out = F.when(rules[0].matches(text), rules[0].code)
        for rule in rules[1:]:
            out = out.when(rule.matches(text), rule.code)
        return out.otherwise(F.lit(None).cast("string"))

    return F.transform(F.array(label), case)[0]


def canonical_category(raw: Column, rules: tuple[Rule, ...]) -> Column:
    return apply_rules(strip_footnotes(norm_label(raw)), rules)


def panel_category(block: Column, raw: Column) -> Column:
    """Panel code of a raw row label: family levels carry an F prefix."""
    return F.when(block == "family", F.concat(F.lit("F"), canonical_category(raw, FAMILY_RULES))).otherwise(
        canonical_category(raw, EMPLOYMENT_RULES)
    )


def region_slug(raw: Column) -> Column:
    return apply_rules(norm_label(raw), REGION_RULES)


def area_slug(header: Column) -> Column:
    return apply_rules(norm_label(header), AREA_RULES)
