"""JSON in answers of models: repair by a scan of brackets, and the payload of an envelope, as Variant.

The scan folds over the pieces of a text, brackets, quotes, backslashes and what stands between them,
with depth and string state as all that is carried. So a bracket in a string doesn't count, and no pattern has to guess nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import BLANK, let, strip
from tessera.plans.registry import query, table
from tessera.plans.stages import once

FENCE = rf"(?is)^```(?:json)?{BLANK}*(.*?){BLANK}*```$"
#: A JSON value that is no object or array.
SCALAR = r'(?s)^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|"(\\.|[^"\\])*")$'


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r'[\\"\[\]{}]|[^\\"\[\]{}]+'), 0)


def _closing(pieces: Column, start: Column) -> Column:
    """The place of the bracket that closes the one at place ``start``, from 0; null if none does. Only brackets of its kind count."""
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(None).cast("int").alias("last"))

    def scan(opener: Column, closer: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            depth = s["depth"] + F.when(~s["quoted"] & (p["t"] == opener), 1).when(~s["quoted"] & (p["t"] == closer), -1).otherwise(0)
            quoted = F.when(s["escaped"], s["quoted"]).otherwise(F.when(p["t"] == '"', ~s["quoted"]).otherwise(s["quoted"]))
            escaped = s["quoted"] & ~s["escaped"] & (p["t"] == "\\")
            ended = ~s["quoted"] & (p["t"] == closer) & (depth == 0)
            new = F.struct(depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), F.when(ended, p["i"]).alias("last"))
            return F.when(s["last"].isNotNull(), s).otherwise(new)

        numbered = F.transform(pieces, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        return F.aggregate(F.slice(numbered, start + 1, F.size(pieces)), begin, step, lambda s: s["last"])

    return let(F.get(pieces, start), lambda o: scan(o, F.when(o == "{", "}").otherwise("]")))


def first_balanced(text: Column) -> Column:
    """The first object or array in a text whose bracket is closed; null if there is none."""

    def found(p: Column) -> Column:
        starts = F.array_compact(F.transform(p, lambda t, i: F.when(t.isin("{", "["), i)))
        none = F.lit(None).cast("struct<first: int, last: int>")
        first = F.aggregate(starts, none, lambda acc, i: F.when(acc.isNotNull(), acc).otherwise(let(_closing(p, i), lambda e: F.when(e.isNotNull(), F.struct(i.alias("first"), e.alias("last"))))))
        return let(first, lambda f: F.when(f.isNotNull(), F.array_join(F.slice(p, f["first"] + 1, f["last"] - f["first"] + 1), "")))

    return let(_pieces(text), found)


def parse(text: Column) -> Column:
    """A text that is one JSON value and nothing else, as Variant; null otherwise, and where an object has a key twice."""

    def whole(t: Column) -> Column:
        nested = let(_pieces(t), lambda p: _closing(p, F.lit(0)) == F.size(p) - 1)
        return F.when(t.rlike(SCALAR) | (t.rlike(r"^[\[{]") & F.coalesce(nested, F.lit(False))), F.try_parse_json(t))

    # white space as JSON has it
    return let(F.btrim(text, F.lit(" \t\n\r")), whole)


def unfenced(text: Column) -> Column:
    """What a code fence around a whole text holds, or the text, stripped."""
    return let(strip(text), lambda s: F.when(s.rlike(FENCE), strip(F.regexp_extract(s, FENCE, 1))).otherwise(s))


def repair(answers: DataFrame, column: str = "text") -> DataFrame:
    """``answers`` with data, a Variant, and way: as it is, unfenced, extracted, or null where no JSON is found.

    * The text itself counts if it is JSON, else what its code fence holds, else the first balanced object or array in that. A balanced
      part that is no JSON is not repaired, and later ones aren't looked at.
    * Null and empty texts have none. A JSON null is data. Texts of any length are read whole.
    """
    plain = once(answers, plain_=F.col(column), bare_=unfenced(F.col(column)))
    tried = once(plain, as_is_=parse(F.col("plain_")), fence_=parse(F.col("bare_")))
    part = once(tried, part_=F.when(F.col("as_is_").isNull() & F.col("fence_").isNull(), parse(first_balanced(F.col("bare_")))))
    way = F.when(F.col("as_is_").isNotNull(), "as it is").when(F.col("fence_").isNotNull(), "unfenced").when(F.col("part_").isNotNull(), "extracted")
    return part.select(*answers.columns, F.coalesce("as_is_", "fence_", "part_").alias("data"), way.alias("way"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def payload(envelopes: DataFrame, column: str = "text") -> DataFrame:
    """``envelopes`` with data, the object in a model service's JSON response, or error where there is none.

    An object under ``response`` counts, or one in its text, repaired if need be; else an object in the text at ``message.content``, which
    must be JSON; else the envelope itself. Errors: not_an_object, response_without_json, response_not_an_object, content_without_json.
    """
    read = once(envelopes, e_=parse(F.col(column)))
    parts = once(read, r_=F.try_variant_get("e_", "$.response", "variant"), m_=F.try_variant_get("e_", "$.message.content", "variant"))
    texts = once(parts, rt_=F.when(_is_text(F.col("r_")), F.try_variant_get("r_", "$", "string")), mt_=F.when(_is_text(F.col("m_")), F.try_variant_get("m_", "$", "string")))
    found = repair(texts, "rt_").withColumnsRenamed({"data": "rd_", "way": "rw_"})
    ready = once(found, md_=parse(F.col("mt_")))
    e, r, rd, md = (F.col(c) for c in ("e_", "r_", "rd_", "md_"))
    error = (
        F.when(~_is_object(e), "not_an_object").when(_is_object(r), None).when(F.col("rt_").isNotNull() & rd.isNull(), "response_without_json")
        .when(F.col("rt_").isNotNull() & ~_is_object(rd), F.when(F.col("rw_") == "as it is", "response_not_an_object").otherwise("response_without_json")).when(F.col("rt_").isNotNull(), None).when(F.col("mt_").isNotNull() & md.isNull(), "content_without_json")
    )
    data = F.when(_is_object(r), r).when(_is_object(rd), rd).when(_is_object(md), md).otherwise(e)
    return once(ready, error=error, data=data).select(*envelopes.columns, F.when(F.col("error").isNull(), F.col("data")).alias("data"), "error")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Events' properties as a model may answer them, in one of six ways."""
    p, i = F.col("props"), F.col("event_id")
    forms = [p, F.concat(F.lit("```json\n"), p, F.lit("\n```")), F.concat(F.lit('Sure: {"event": '), p, F.lit(', "note": "a } in \\"text\\""} and {more}')), F.concat(F.lit('{"cut": ['), p), F.concat(F.lit("["), p, F.lit(", 1] then "), p), F.concat(p, F.lit(" "), p)]
    text = F.element_at(F.array(*forms), (F.pmod(i, F.lit(len(forms))) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", text.alias("text"))


_SQL_K = "json_extract_string(props, '$.k')"


@query("json_repair", f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'as it is' WHEN 1 THEN 'unfenced' ELSE 'extracted' END AS way, {_SQL_K} AS k FROM events""")
def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    found = repair(_answers(spark, sf))
    k = F.coalesce(*(F.try_variant_get("data", path, "string") for path in ("$.k", "$.event.k", "$[0].k")))
    return found.select("event_id", "way", k.alias("k"))


@query("json_envelope", f"""SELECT event_id, CASE WHEN event_id % 5 = 3 THEN 'content_without_json' WHEN event_id % 5 = 4 THEN 'response_not_an_object' END AS error, CASE WHEN event_id % 5 < 3 THEN {_SQL_K} END AS k FROM events""")
def json_envelope(spark: SparkSession, sf: str) -> DataFrame:
    p, i = F.col("props"), F.col("event_id")
    quoted = F.to_json(F.struct(F.concat(F.lit("It is "), p).alias("response")))
    forms = [F.concat(F.lit('{"response": '), p, F.lit("}")), quoted, F.to_json(F.struct(F.struct(p.alias("content")).alias("message"))), F.lit('{"message": {"content": "no"}}'), F.lit('{"response": "[1]"}')]
    text = F.element_at(F.array(*forms), (F.pmod(i, F.lit(len(forms))) + 1).cast("int"))
    found = payload(table(spark, sf, "events").select("event_id", text.alias("text")))
    return found.select("event_id", "error", F.try_variant_get("data", "$.k", "string").alias("k"))
