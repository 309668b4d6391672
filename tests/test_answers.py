"""JSON in answers against a plain scan, character by character."""

import json
import random

from pyspark.sql import functions as F

from tessera.operators import answers


def loads(text):
    def pairs(p):
        if len({k for k, _ in p}) < len(p):
            raise ValueError  # a key twice
        return dict(p)

    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=lambda _: 1 / 0), True
    except (ValueError, ZeroDivisionError, RecursionError):
        return None, False


def balanced(text):
    for start, opener in enumerate(text):
        if opener not in "{[":
            continue
        depth, quoted, escaped = 0, False, False
        for end in range(start, len(text)):
            c = text[end]
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == opener:
                depth += 1
            elif c == "}]"["{[".index(opener)]:
                depth -= 1
                if not depth:
                    return text[start : end + 1]
    return None


def plain(text):
    data, ok = loads(text)
    if ok:
        return "as it is", data
    bare = text.strip()
    if bare.startswith("```") and bare.endswith("```") and len(bare) >= 6:
        inner = bare[3:-3]
        bare = (inner[4:] if inner[:4].lower() == "json" else inner).strip()
    data, ok = loads(bare)
    if ok:
        return "unfenced", data
    data, ok = loads(balanced(bare) or "")
    return ("extracted", data) if ok else (None, None)


def repaired(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "n int, text string, data_ string, way_ int")
    got = {r["n"]: r for r in answers.repair(df).select("n", "way", F.to_json("data").alias("j")).collect()}
    return [(got[i]["way"], None if got[i]["j"] is None else json.loads(got[i]["j"])) for i in range(len(texts))]


def test_repair_equals_a_plain_scan(spark):
    texts = ['{"a": 1}', '```json\n{"a": 2}\n```', 'so: {"a": {"b": 3}} ok', "no", "", " null ", '"x"', "5", "5 6", '{"a": 1} x', '{"a":1}{"b":2}', "[1, 2] and {", '{"a": "}"} {"b": 1}', '```\n[1]\n``` ', "{'a': 1} [2]", '\\{"a": 1}', '{"a": "\\"}"}x', "[[1]", '{"a":1,"a":2}', "NaN", '{ [1] }', '"\\" {" {"c": 1}', "[" * 50 + "]" * 50]
    r = random.Random(4)
    texts += ["".join(r.choice(['{"k": ', "}", "[", "]", '"', "\\", "1", ", ", "x", '"a}"', "\n", "```", "{}", "null"]) for _ in range(r.randrange(1, 12))) for _ in range(400)]
    for text, got in zip(texts, repaired(spark, texts), strict=True):
        assert got == plain(text), text
    assert repaired(spark, [None]) == [(None, None)]
    long = "word " * 20000 + '{"a": ["' + "x" * 50000 + '"]} tail'
    assert repaired(spark, [long])[0][1] == {"a": ["x" * 50000]}


def test_payload(spark):
    cases = [
        ('{"response": {"a": 1}}', {"a": 1}, None), ('{"response": "{\\"a\\": 2}"}', {"a": 2}, None), ('{"response": "so {\\"a\\": 3}."}', {"a": 3}, None), ('{"response": "[1]"}', None, "response_not_an_object"), ('{"response": "so [1]"}', None, "response_without_json"),
        ('{"response": "none"}', None, "response_without_json"), ('{"response": 5, "message": {"content": "{\\"a\\": 4}"}}', {"a": 4}, None), ('{"message": {"content": "so {\\"a\\": 5}"}}', None, "content_without_json"), ('{"message": {"content": "[1]"}, "b": 1}', {"message": {"content": "[1]"}, "b": 1}, None),
        ('{"message": "x"}', {"message": "x"}, None), ("[1]", None, "not_an_object"), ("no", None, "not_an_object"), (None, None, "not_an_object"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "n int, text string")
    got = {r["n"]: r for r in answers.payload(df).select("n", "error", F.to_json("data").alias("j")).collect()}
    for i, (text, data, error) in enumerate(cases):
        assert (got[i]["j"] and json.loads(got[i]["j"]), got[i]["error"]) == (data, error), text
