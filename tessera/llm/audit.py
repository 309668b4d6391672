"""How filters interact: what each would remove in every order, counted by walking the trie of orders.

The orders of a set of filters form a trie, in which a node is what passed the filters above it.
What is left doesn't depend on the order of those filters, so nodes with one unordered prefix
share a state. The trie is walked depth-first: a state's survivors are a persisted DataFrame,
made from its parent's by one filter, and the removals of all edges below it are counted in one
pass by part. A state that was counted before isn't walked again. So 2**n - 1 passes stand for
n! orders, and at most n survivor DataFrames are held at a time.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drop, scratch, table
from tessera.plans.catalogue import small

#: The filters of ``failures``, one column each.
FILTERS = ("A", "B", "C", "D", "E")
#: Texts that recur and labels, up to which they are broadcast; beyond it rows meet them by shuffle.
REPEATED, LABELLED = 100_000, 200_000
#: White space between words, for trimming and splitting.
SPACE, SPACES = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"
EDGE = "struct<filter: string, removed: bigint, good_lost: bigint, toxic_lost: bigint>"
COUNTED = "part string, survivors long, {}, state string"


def _marks(docs: DataFrame) -> DataFrame:
    """What the text of each row tells: columns A to D and a digest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(SPACE))
    held = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)))
    n = F.size("words")
    return held.select(
        "doc_id",
        "part",
        (n < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * n).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, source, text) by what it fails: part, A, B, C, D, E, good and toxic.

    A: under 200 words. B: fewer than half of the words distinct. C: more than 2 of 100 code points in
    A-Z. D: one of ``#$%&*|``. E: the text equals that of a row with a smaller doc_id. Words are case-sensitive
    and parted by ASCII white space. good and toxic tell if ``labels`` (doc_id, quality, toxic) has a 1.

    * Null text: the empty text. Null source: the part "". Null doc_id: never fails E, nor makes others fail it, and has no labels.
    * Rows that share doc_id and text don't fail E by each other; of several labels of a doc_id a 1 counts.
    * Texts are read whole at any length; an empty table gives none; other columns are not read.
    """
    marks = table(_marks(docs), "marks")
    first = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = table(first, "firsts")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("doc_id is not null")
    known = table(known, "known")
    found = marks.join(small(firsts, REPEATED), "digest", "left").join(small(known, LABELLED), "doc_id", "left")
    told = lambda c: F.coalesce(c, F.lit(False))
    out = table(found.select("part", "A", "B", "C", "D", told(F.col("first") < F.col("doc_id")).alias("E"), told(F.col("good")).alias("good"), told(F.col("toxic")).alias("toxic")), "failures")
    drop(marks, firsts, known)
    return out


def _state(passed: Sequence[str]) -> str:
    return ",".join(sorted(passed))


def edges(flags: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """What each filter removes from each state, by part: part, state, survivors, filter, removed, good_lost, toxic_lost.

    ``state`` names the filters passed before, in alphabetical order. A part without survivors has no row.
    """
    at, counted = scratch(flags.sparkSession, "edges"), set()
    counts = [F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good_lost"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost")).alias(f"edge_{k}") for k, f in enumerate(filters)]

    def visit(passed: tuple[str, ...], survivors: DataFrame) -> None:
        counted.add(_state(passed))
        left = [f for f in filters if f not in passed]
        survivors.persist()
        # all filters are counted, also those that passed and remove nothing: so each state runs the same compiled code
        rows = survivors.groupBy("part").agg(F.count("*").alias("survivors"), *counts).withColumn("state", F.lit(_state(passed)))
        rows.write.mode("append").parquet(at)
        for f in left:
            if len(left) > 1 and _state((*passed, f)) not in counted:
                visit((*passed, f), survivors.where(~F.col(f)))
        survivors.unpersist()

    visit((), flags)
    each = F.array(*(f"edge_{k}" for k in range(len(filters))))
    found = flags.sparkSession.read.schema(COUNTED.format(", ".join(f"edge_{k} {EDGE}" for k in range(len(filters))))).parquet(at)
    return found.select("part", "state", "survivors", F.inline(each)).where(~F.array_contains(F.split("state", ","), F.col("filter")))


def audit(flags: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Every order of ``filters``, boolean columns of ``flags`` (part, good, toxic besides) that tell which rows fail.

    A row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley. Each is exact, and zero where nothing is left to remove.

    * An empty table gives an empty result. Parts are never null if they come from ``failures``; a null one is a part like others.
    * Parts of any size and number: counts are summed in tasks before they meet by part.
    """
    n = len(filters)
    depth = F.when(F.col("state") == "", 0).otherwise(F.size(F.split("state", ",")))
    orders_after = F.factorial(depth) * F.factorial(n - 1 - depth)  # orders in which the state stands right before the filter
    shares = [F.coalesce(F.sum(F.when(F.col("filter") == f, F.col("removed") * orders_after)), F.lit(0)) for f in filters]
    entry = F.struct(F.concat_ws(">", "state", "filter"), F.struct("survivors", "removed", "good_lost", "toxic_lost"))
    parts = edges(flags, filters).groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("e"), F.map_from_arrays(F.array(*map(F.lit, filters)), F.array(*shares)).alias("shapley"))  # n * 2**(n - 1) entries a part
    orders = F.from_json(F.lit(json.dumps(list(itertools.permutations(filters)))), "array<array<string>>")
    steps = parts.select("*", F.explode(orders).alias("order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    steps = steps.withColumn("filter", F.get("order", F.col("step") - 1)).withColumn("before", F.array_join(F.array_sort(F.slice("order", F.lit(1), F.col("step") - 1)), ","))

    def of(state, field: str):
        return F.coalesce(F.col("e")[F.concat_ws(">", state, "filter")][field], F.lit(0))

    others = F.array_join(F.array_sort(F.array_except("order", F.array("filter"))), ",")
    removed = of(F.col("before"), "removed")
    return steps.select(
        "part",
        F.array_join("order", "").alias("filter_order"),
        "step",
        (of(F.col("before"), "survivors") - removed).alias("kept"),
        removed.alias("removed"),
        (of(F.lit(""), "removed") - removed).alias("redundant"),
        of(others, "removed").alias("unique_fails"),
        of(F.col("before"), "good_lost").alias("good_lost"),
        of(F.col("before"), "toxic_lost").alias("toxic_lost"),
        F.col("shapley")[F.col("filter")].alias("shapley"),
    )
