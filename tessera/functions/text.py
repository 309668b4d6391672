"""Column functions over text, all built in."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from html import unescape as unescape_html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True if a word occurs as a substring; false for null text."""
    found = [F.contains(text, F.lit(w)) for w in words]
    return F.coalesce(reduce(lambda a, b: a | b, found, F.lit(False)), F.lit(False))


def hits(text: Column, words: Iterable[str]) -> Column:
    """The words that occur, in the order given."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def compact(text: Column) -> Column:
    """White space collapsed to single spaces and cut at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def excerpt(text: Column, size: int = 500) -> Column:
    return F.substring(compact(text), 1, size)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))


def token_estimate(text: Column) -> Column:
    """Four thirds of the words, rounded down, one at least."""
    return F.greatest(F.lit(1), F.floor(word_count(text) * 4 / 3).cast("int"))


#: Characters that count as white space, for trimming; and as a class of regular expressions.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: References that most texts have, looked for before the table of all.
_COMMON = ("&lt;", "&gt;", "&quot;", "&#39;", "&nbsp;")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that stands in the plan, and is worked out, once."""
    return F.transform(F.array(value), f)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _referred(code: Column) -> Column:
    """The character of a numeric reference, by the rules of HTML: Windows-1252 from 128 to 159, nothing for what is no character."""
    latin = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    dropped = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
        .when(code.between(128, 159), F.element_at(F.array(*map(F.lit, latin)), (code - 127).cast("int")))
        .when(dropped, "")
        .otherwise(plain)
    )


def _resolved(piece: Column, names: Column) -> Column:
    """A piece that begins with ``&``, its reference replaced by what it stands for; ``names`` is a text of all names and values."""
    ref = F.regexp_extract(piece, r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
    rest = F.substring(piece, F.length(ref) + 2, F.lit(2**31 - 1))
    digits = F.regexp_extract(ref, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
    is_hex = ref.rlike("^#[xX]")
    code = F.when(F.length(digits) > 8, F.lit(0x110000)).when(digits == "", F.lit(0)).when(is_hex, F.conv(digits, 16, 10).cast("long")).otherwise(F.conv(digits, 10, 10).cast("long"))

    def valued(name: Column) -> Column:
        key = F.concat(F.lit("\x01"), name, F.lit("\x02"))
        at = F.instr(names, key)
        return F.when(at > 0, F.substring_index(F.substring(names, at + F.length(key), F.lit(8)), "\x01", 1))

    # names without a semicolon count as the beginning of longer words, the longest first
    longest = max(len(n) for n in html5 if not n.endswith(";"))
    sizes = F.filter(F.sequence(F.lit(longest), F.lit(2), F.lit(-1)), lambda n: (n < F.length(ref)) & valued(F.left(ref, n)).isNotNull())
    begun = let(F.get(sizes, F.lit(0)), lambda n: F.concat(valued(F.left(ref, n)), F.substring(ref, n + 1, F.lit(32))))
    named = F.coalesce(valued(ref), begun, F.concat(F.lit("&"), ref))
    common = F.when(F.startswith(piece, F.lit("&amp;")), F.concat(F.lit("&"), F.substring(piece, 6, 2**31 - 1)))
    for name in _COMMON:
        common = common.when(F.startswith(piece, F.lit(name)), F.concat(F.lit(unescape_html(name)), F.substring(piece, len(name) + 1, 2**31 - 1)))
    return common.when(~F.startswith(piece, F.lit("&")) | (ref == ""), piece).when(F.startswith(ref, F.lit("#")), F.concat(_referred(code), rest)).otherwise(F.concat(named, rest))


def unescape(text: Column) -> Column:
    """Character references of HTML 5 as what they stand for, in a single pass, so ``&amp;lt;`` gives ``&lt;``."""
    names = F.lit("".join(f"\x01{n}\x02{v}" for n, v in html5.items()) + "\x01")

    def resolved(t: Column) -> Column:
        whole = let(names, lambda n: F.array_join(F.transform(F.split(t, "(?=&)"), lambda p: _resolved(p, n)), ""))
        return F.when(F.contains(t, F.lit("&")), whole).otherwise(t)

    return let(text, resolved)


def dedupe_key(text: Column) -> Column:
    return compact(F.lower(unescape(text)))


def clean(text: Column) -> Column:
    """Unescaped, bullets and dashes as ``-``, runs of blanks as one, three or more line ends as two, trimmed."""
    t = F.translate(unescape(text), "•–— ", "--- ")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.trim(t)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def lookup_form(text: Column) -> Column:
    """Lower case, ``_`` and a hyphen inside a word as spaces, collapsed."""
    t = F.replace(F.lower(F.trim(text)), F.lit("_"), F.lit(" "))
    return compact(F.regexp_replace(t, r"(?<=\w)-(?=\w)", " "))


def is_heading(line: Column) -> Column:
    """A line that opens a section: marked by ``#``, numbered, a version title or a known title."""
    s = F.trim(line)
    known = F.rtrim(F.lower(s), F.lit(":")).isin(*V.SECTION_TITLES)
    return F.coalesce((s != "") & (F.startswith(s, F.lit("#")) | s.rlike(r"^[0-9]+(\.[0-9]+)*\.\s+\S+") | s.rlike(r"(?i)^version\s+v?[0-9]+(\.[0-9]+)*") | known), F.lit(False))


def zone_of_title(title: Column) -> Column:
    """Zone by section title without numbering; body if unknown."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(title), r"^[# :]+|[# :]+$", ""), r"^[0-9]+(\.[0-9]+)*\.\s*", "")
    return F.when(plain.isin(*V.SECTION_TITLES), F.replace(plain, F.lit(" "), F.lit("_"))).otherwise("body")


def is_version_or_date(text: Column) -> Column:
    s = F.trim(text)
    return s.rlike(r"(?i)^v?[0-9]+(\.[0-9]+)+(\.x)?$") | s.rlike(r"^[0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}$") | s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | s.rlike(r"^[0-9]+$")


def is_label(text: Column) -> Column:
    """A known metadata label, or up to four words without digit or sentence mark."""
    s = F.regexp_replace(F.trim(text), r"^:+|:+$", "")
    return F.lower(s).isin(*V.METADATA_LABELS) | (~s.rlike(r"[.!?]") & (word_count(s) <= 4) & ~s.rlike("[0-9]"))


def is_suspicious(text: Column, chunk_type: Column) -> Column:
    """Whether a piece is too thin to become a chunk."""
    words, low = word_count(text), F.lower(text)
    thin = (words <= 2) & ~contains_any(low, V.RULE_KEYWORDS) & ~text.rlike(r"[.!?]")
    one_line_heading = ~F.contains(text, F.lit("\n")) & is_heading(text)
    # versions, dates and labels have four words at most
    return F.when(F.coalesce(text, F.lit("")) == "", True).when(chunk_type == "document_metadata", False).otherwise(((words <= 4) & (is_version_or_date(text) | is_label(text) | thin)) | one_line_heading)


def signal_score(text: Column, zone: Column, chunk_type: Column) -> Column:
    """Struct (score, signals, likelihood) of how much a text looks like a rule. Components count as substrings."""
    score, signals = score_and_signals(F.lower(F.coalesce(text, F.lit(""))), zone, chunk_type)
    return F.struct(score.alias("score"), signals.alias("signals"), likelihood(score).alias("likelihood"))


def score_and_signals(low: Column, zone: Column, chunk_type: Column) -> tuple[Column, Column]:
    """How much a text in lower case looks like a rule, and what tells so."""
    metadata = (zone == "document_metadata") | (chunk_type == "document_metadata")
    overview = (zone == "overview") | (chunk_type == "overview")
    parts = [
        (contains_any(low, V.REQUIRE_WORDS), 3, F.array(F.lit("requires/required/must"))),
        (contains_any(low, V.UNSUPPORTED_WORDS), 3, F.array(F.lit("unsupported/incompatible"))),
        (contains_any(low, V.MINIMUM_WORDS), 2, F.array(F.lit("minimum/or later"))),
        (contains_any(low, V.FIX_WORDS), 2, F.array(F.lit("fix/support/back-flashing"))),
        (contains_any(low, V.COMPONENT_WORDS), 1, hits(low, V.COMPONENT_WORDS)),
        (low.rlike(V.VERSION), 1, F.array(F.lit("version_pattern"))),
        (metadata, -3, F.array(F.lit("metadata_penalty"))),
        (overview, -2, F.array(F.lit("overview_penalty"))),
    ]
    none = F.array().cast("array<string>")
    score = reduce(lambda a, b: a + b, [F.when(c, F.lit(n)).otherwise(0) for c, n, _ in parts])
    return score, F.concat(*[F.when(c, s).otherwise(none) for c, _, s in parts])


def likelihood(score: Column) -> Column:
    return F.when(score >= 5, "high").when(score >= 2, "medium").otherwise("low")


def chunk_type(text: Column, zone: Column) -> Column:
    low = F.lower(text)
    rule = contains_any(low, (*V.REQUIRE_WORDS, *V.UNSUPPORTED_WORDS, *V.MINIMUM_WORDS))
    return (
        F.when((zone == "overview") & ~rule, "overview")
        .when(contains_any(low, V.UNSUPPORTED_WORDS), "unsupported_configuration")
        .when(F.contains(low, F.lit("with ")) & contains_any(low, V.REQUIRE_WORDS), "compound_requirement")
        .when(contains_any(low, V.MINIMUM_WORDS), "minimum_version_requirement")
        .when(contains_any(low, V.REQUIRE_WORDS), "compatibility_requirement")
        .when(contains_any(low, V.FIX_PHRASES), "fixed_issue")
        .when(zone == "overview", "overview")
        .when(zone != "body", zone)
        .otherwise("prose")
    )


def zone_override(zone: Column, kind: Column, text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(kind == "unsupported_configuration", "unsupported_configurations")
        .when(kind.isin("minimum_version_requirement", "compatibility_requirement", "compound_requirement"), "compatibility_requirements")
        .when(kind == "fixed_issue", "fixed_issues")
        .when(~zone.isin("body", "unknown"), zone)
        .when(contains_any(low, ("before upgrading", "after upgrading")), "upgrade_requirements")
        .otherwise(zone)
    )


def llm_usage(kind: Column, zone: Column, level: Column, send_medium: bool = False) -> Column:
    rules = ("minimum_version_requirement", "compatibility_requirement", "compound_requirement", "unsupported_configuration", "component_table_row", "fixed_issue", "known_issue_fixed")
    return (
        F.when((kind == "document_metadata") | (zone == "document_metadata"), "global_context")
        .when((kind == "overview") | (zone == "overview"), "background_context")
        .when(kind == "rejected", "ignore")
        .when(kind.isin(*rules), F.when(level.isin("high", "medium"), "rule_extraction").otherwise("evidence_only"))
        .when((level == "high") | ((level == "medium") & F.lit(send_medium)), "rule_extraction")
        .when((level == "low") & (zone != "unknown"), "evidence_only")
        .otherwise("ignore")
    )


def zone_confidence(zone: Column, score: Column) -> Column:
    return F.when(zone == "unknown", F.lit(0.25)).when(zone.isin("document_metadata", "overview"), F.lit(0.9)).otherwise(F.least(F.lit(0.95), 0.55 + F.greatest(score, F.lit(0)) * 0.06))


def classification_signals(zone: Column, text: Column) -> Column:
    first = F.when(zone != "unknown", F.array(F.concat(F.lit("classified as "), zone))).otherwise(F.array().cast("array<string>"))
    return F.concat(first, F.transform(hits(F.lower(text), V.BODY_SIGNALS), lambda w: F.concat(F.lit("body contains "), w)))


def table_hint(text: Column) -> Column:
    """Up to 1: words of tables, columns by bars or tabs, and three lines of four words."""
    low = F.lower(text)
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    wide = F.size(F.filter(F.split(text, "\n"), lambda line: word_count(line) >= 4))
    score = F.when(contains_any(low, V.TABLE_WORDS), 0.5).otherwise(0.0) + F.when((count("|") >= 4) | (count("\t") >= 4), 0.4).otherwise(0.0) + F.when(wide >= 3, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def sentences(text: Column) -> Column:
    """Split behind ``.``, ``!`` or ``?`` where a capital or a digit follows."""
    return F.filter(F.transform(F.split(compact(text), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: s != "")


def field(text: Column, name: str) -> Column:
    """The value of ``name: value`` in a row of ``header: value | header: value``; null if it's not there."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i){name}:\s*(.*?)(?:\s+\|\s+[A-Z][A-Za-z0-9 /()+-]*:|$)", 1)), F.lit(""))


def lane(text: Column, zone: Column) -> Column:
    """Struct (lane, table_schema, confidence, headers) for a chunk's text."""
    low = F.lower(text)
    compacted = compact(low)
    headers = F.regexp_extract_all(text, F.lit(V.TABLE_HEADER), 1)
    header_text = F.lower(F.array_join(headers, " "))
    junk = (compacted == "") | compacted.isin("copyright", "table of contents") | compacted.rlike("^[0-9]{1,4}$")
    both = lambda a, b: F.contains(low, F.lit(a)) & F.contains(low, F.lit(b))
    feature = F.contains(low, F.lit("not supported")) & (F.contains(header_text, F.lit("feature")) | F.startswith(low, F.lit("feature:")))
    cases = [
        (junk, "ignore", "unknown_table", 0.9),
        (zone.isin("document_metadata", "overview", "title"), "context_only", "unknown_table", 0.8),
        (both("switch model", "introductory release"), "deterministic_support_matrix", "cisco_switch_model_introductory_release", 0.95),
        (both("network module", "introductory release"), "deterministic_support_matrix", "cisco_network_module_introductory_release", 0.95),
        (feature, "deterministic_table_rule", "unsupported_feature_matrix", 0.9),
        (F.contains(header_text, F.lit("rommon")) & F.contains(header_text, F.lit("version")), "deterministic_support_matrix", "rommon_version_matrix", 0.75),
        (contains_any(low, V.RULE_LANGUAGE), "llm_prose_rule", "unknown_table", 0.4),
    ]
    pick = lambda i, last: reduce(lambda c, row: c.when(row[0], F.lit(row[i])), cases[1:], F.when(cases[0][0], F.lit(cases[0][i]))).otherwise(F.lit(last))
    return F.struct(pick(1, "evidence_only").alias("lane"), pick(2, "unknown_table").alias("table_schema"), pick(3, 0.4).alias("confidence"), headers.alias("headers"))
