"""Versions: normal form and scheme, comparison with padding, release parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import slug

_DOTTED = r"^[0-9]+(\.[0-9]+){1,3}$"


def _plain_parts(v: Column) -> Column:
    """Dotted numbers without leading zeros; null if a part is no number."""
    return F.when(v.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.regexp_replace(v, r"(^|(?<=\.))0+(?=[0-9])", ""))


def normalise(raw: Column, context: Column | None = None) -> Column:
    """Struct (norm, scheme). Never fails: a letter behind a plain version makes a named release."""
    v = F.trim(raw)
    ios = F.contains(F.lower(F.coalesce(context, F.lit(""))), F.lit("cisco ios xe")) if context is not None else F.lit(False)
    bare = F.regexp_replace(v, "^[vV]+", "")
    semantic = bare.rlike(r"^[0-9]+(\.[0-9]+)+$") & _plain_parts(bare).isNotNull()
    is_ios = v.rlike(r"(?i)^[0-9]+(\.[0-9]+){1,3}[a-z]?$")
    named = v.rlike("[A-Za-z]") & ~v.rlike(r"(?i)^v?[0-9]")
    wild = F.endswith(F.lower(bare), F.lit(".x"))
    pick = lambda a, b, c, d, e: F.when(ios & is_ios, a).when(ios, b).when(named, e).when(wild, c).when(semantic, d).otherwise(e)
    norm = pick(v, slug(v), bare, _plain_parts(bare), slug(v))
    scheme = pick(*map(F.lit, ("cisco_ios_xe", "cisco_ios_xe_unknown", "wildcard", "semantic", "named_release")))
    empty = F.coalesce(raw, F.lit("")) == ""
    return F.struct(F.when(~empty, norm).alias("norm"), F.when(~empty, scheme).alias("scheme"))


def key(version: Column) -> Column:
    """A string that sorts as versions do, of any count of numbers with any count of digits (up to 9999), then the letter; null for anything that isn't a version.

    Each number stands behind its length, numbers of zero at the end are left out as shorter versions are padded with them, and a
    blank, which sorts before digits, ends the numbers.
    """
    body = F.regexp_extract(F.trim(version), r"(?i)^([0-9]+(?:\.[0-9]+)*)[a-z]?$", 1)
    letter = F.lower(F.regexp_extract(F.trim(version), r"(?i)^[0-9]+(?:\.[0-9]+)*([a-z]?)$", 1))
    short = F.regexp_replace(body, r"(^|\.)0*(\.0+)*$", "")
    numbers = F.transform(F.split(short, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    told = F.array_join(F.transform(numbers, lambda p: F.concat(F.lpad(F.length(p).cast("string"), 4, "0"), p)), "")
    return F.when(body != "", F.concat(F.when(short == "", "").otherwise(told), F.lit(" "), letter))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; shorter versions are padded with zeros, then the letter decides; what is no version counts as 0. Null if one is null."""
    x, y = (F.coalesce(key(v), F.lit(" ")) for v in (a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(x < y, -1).when(x > y, 1).otherwise(0).cast("int")


def satisfies(installed: Column, operator: Column, required: Column) -> Column:
    """Three-valued: null where the installed version is missing or the two can't be compared."""
    wild = F.endswith(F.lower(required), F.lit(".x"))
    prefix = F.substring(required, F.lit(1), F.length(required) - 1)
    comparable = key(installed).isNotNull() & key(required).isNotNull()
    c = compare(installed, required)
    by = F.when(operator == ">=", c >= 0).when(operator == ">", c > 0).when(operator == "<=", c <= 0).when(operator == "<", c < 0).when(operator == "==", c == 0).when(operator == "!=", c != 0)
    equal = F.lower(installed) == F.lower(required)
    return (
        F.when(installed.isNull(), F.lit(None).cast("boolean"))
        .when(operator == "installed", True)
        .when(wild, F.startswith(installed, prefix))
        .when(comparable, by)
        .when(operator == "==", equal)
        .when(operator == "!=", ~equal)
    )


def extract(text: Column) -> Column:
    """The first dotted version, or named release, in a text."""
    model = F.trim(text).rlike(f"(?i){V.SWITCH_MODEL}") | F.trim(text).rlike(f"(?i){V.NETWORK_MODULE}")
    dotted = F.nullif(F.regexp_extract(text, r"(?i)\b(v?[0-9]+(?:\.[0-9]+)+(?:\.x|[a-z])?)\b", 1), F.lit(""))
    named = F.nullif(F.regexp_extract(text, r"(?i)(Windows Server [0-9]{4}(?: R2)?|VMware ESXi [0-9]+(?:\.[0-9]+)?\.x)", 1), F.lit(""))
    return F.when(~model, F.coalesce(dotted, named))


def ios_xe_release(text: Column) -> Column:
    """Struct (family, version, scheme) of a network OS release."""
    pattern = r"(?i)Cisco\s+IOS\s+XE(?:\s+([A-Za-z]+))?\s+([0-9]+(?:\.[0-9]+){1,3}[a-z]?)\b"
    train = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    version = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    loose = F.nullif(F.regexp_extract(text, r"(?i)\b([0-9]+(?:\.[0-9]+){1,3}[a-z]?)\b", 1), F.lit(""))
    family = F.when(F.lower(train).isin(*V.IOS_XE_TRAINS), train)
    return F.struct(family.alias("family"), F.coalesce(version, loose).alias("version"), F.when(version.isNotNull(), "cisco_ios_xe").otherwise("cisco_ios_xe_unknown").alias("scheme"))


def satisfies_keyed(installed: Column, key_installed: Column, operator: Column, required: Column, key_required: Column) -> Column:
    """``satisfies`` with both keys at hand."""
    wild = F.endswith(F.lower(required), F.lit(".x"))
    comparable = key_installed.isNotNull() & key_required.isNotNull()
    a, b = key_installed, key_required
    by = F.when(operator == ">=", a >= b).when(operator == ">", a > b).when(operator == "<=", a <= b).when(operator == "<", a < b).when(operator == "==", a == b).when(operator == "!=", a != b)
    equal = F.lower(installed) == F.lower(required)
    return (
        F.when(installed.isNull(), F.lit(None).cast("boolean"))
        .when(operator == "installed", True)
        .when(wild, F.startswith(installed, F.substring(required, F.lit(1), F.length(required) - 1)))
        .when(comparable, by)
        .when(operator == "==", equal)
        .when(operator == "!=", ~equal)
    )
