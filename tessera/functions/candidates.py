"""Column functions that normalise parts of rule candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V


def _first(cases: list[tuple[Column, str]], last: str) -> Column:
    head, *rest = cases
    return reduce(lambda c, p: c.when(p[0], F.lit(p[1])), rest, F.when(head[0], F.lit(head[1]))).otherwise(F.lit(last))


def component_type(field: Column, value: Column, raw: Column) -> Column:
    """Model and module patterns first, then aliases by whole words in field and value, then in the raw text too."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    primary = F.lower(F.concat(text(field), F.lit(" "), text(value)))
    everything = F.concat(primary, F.lit(" "), F.lower(text(raw)))
    is_os = lambda t: F.contains(t, F.lit("windows server")) | F.contains(t, F.lit("vmware esxi"))
    matches = lambda p: F.trim(text(value)).rlike(f"(?i){p}") | F.trim(text(field)).rlike(f"(?i){p}")
    aliases = lambda t: [(t.rlike(rf"\b{a}\b"), n) for a, n in V.COMPONENT_ALIASES]
    cases = [(matches(V.SWITCH_MODEL), "device_model"), (matches(V.NETWORK_MODULE), "network_module"), (F.contains(everything, F.lit("cisco ios xe")), "network_os"), (is_os(primary), "os")]
    return _first([*cases, *aliases(primary), *aliases(everything), (is_os(everything), "os")], "unknown")


def operator(text: Column, strict: bool = True) -> Column:
    """The first alias contained; installed if none. Not ``strict``: valid symbols pass as they are."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = _first([(F.contains(low, F.lit(a)), n) for a, n in V.OPERATOR_ALIASES], "installed")
    return found if strict else F.when(low.isin("!=", "in", "not_in", "exists", "not_exists", "not_supported", "must_not", "matches"), low).otherwise(found)


def rule_type(kind: Column, source: Column) -> Column:
    low, name = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    has = lambda *w: reduce(lambda a, b: a & b, [F.contains(low, F.lit(x)) for x in w])
    cases = [
        (has("switch model", "introductory release"), "model_support_min_version"),
        (has("network module", "introductory release"), "network_module_support_min_version"),
        (has("not supported"), "unsupported_feature"),
        (has("do not") | has("must not"), "operational_warning"),
    ]
    return _first([*cases, *[(name == a, n) for a, n in V.RULE_TYPE_ALIASES]], "min_version_constraint")


def severity(text: Column) -> Column:
    low = F.lower(F.coalesce(F.nullif(text, F.lit("")), F.lit("unknown")))
    return _first([(low == a, n) for a, n in V.SEVERITY_ALIASES], "info")


def condition_logic(text: Column) -> Column:
    return F.when(F.lower(text).isin("or", "any"), "OR").otherwise("AND")


def grounded(text: Column, values: Column) -> Column:
    """The values that don't occur in the text, both with white space collapsed and in lower case."""
    form = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "") & ~F.contains(form(text), form(v)))


def review_tier(status: Column, level: Column, confidence: Column, warnings: Column) -> Column:
    """individual below 0.83 or with warnings, auto for pending hard blocks from 0.93, else batch; silent severities are read one by one."""
    enforcement = enforcement_type(level)
    alone = (F.coalesce(confidence, F.lit(0.0)) < 0.83) | (F.size(warnings) > 0) | (enforcement == "silent")
    return F.when(alone, "individual").when((status == "pending_review") & (confidence >= 0.93) & (enforcement == "hard_block"), "auto").otherwise("batch")


def enforcement_type(level: Column) -> Column:
    return F.when(level.isin("critical", "blocker"), "hard_block").when(level == "warning", "soft_warning").otherwise("silent")
