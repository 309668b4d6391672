"""Vector retrieval: validation, cosine top-k, cutoffs, answer confidence, routing and their evaluations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import contains_any
from tessera.plans.registry import query, table

#: Largest query side that is broadcast; beyond it the search runs over blocks of queries.
BROADCAST_QUERIES = 4096
#: Vectors that meet a block of queries at once, and vectors of a task.
CHUNK, TASK = 1024, 1 << 16
#: Scores count to nine digits.
GRID = 1e9


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that aren't null and hold only finite values."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(ok)


def _units(embedding: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dim`` doubles of length 1 (or 0, if all are 0), and how many components each vector has."""
    sizes = pc.list_value_length(embedding).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    if (sizes == dim).all():
        out[:] = flat.reshape(-1, dim)
    else:
        for i, at in enumerate(np.cumsum(sizes) - sizes):
            n = min(sizes[i], dim)  # one of more than ``dim`` components meets no query of its size
            out[i, :n] = flat[at : at + n]
    for length in (lambda v: np.abs(v).max(axis=1, initial=0.0), lambda v: np.sqrt((v * v).sum(1))):
        n = length(out)
        out /= np.where(n > 0, n, 1)[:, None]
    return out, sizes


def _search(qids: np.ndarray, q: np.ndarray, q_sizes: np.ndarray, k: int) -> Callable:
    """One partition's nearest vectors, which come by ascending vec_id: at most ``k`` of each query."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # no pair at or below its query's bound is among the k best; a later vector of equal score has a larger id
        bound = np.full(len(qids), -np.inf)
        at, key, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        kept: pa.Table | None = None  # vec_id and label of what is kept
        for batch in rows:
            for start in range(0, batch.num_rows, CHUNK):
                some = batch.slice(start, CHUNK)
                ids = some["vec_id"].to_numpy(zero_copy_only=False)
                v, sizes = _units(some["embedding"], q.shape[1])
                scores = q @ v.T
                if (sizes != q.shape[1]).any() or (q_sizes != q.shape[1]).any():
                    scores[q_sizes[:, None] != sizes[None, :]] = 0.0
                first, last = np.searchsorted(qids, ids), np.searchsorted(qids, ids, "right")
                for j in np.flatnonzero(last > first):
                    scores[first[j] : last[j], j] = -np.inf
                may = scores > bound[:, None]
                many = np.count_nonzero(may, axis=1) > k
                r, c = np.nonzero(may & ~many[:, None])
                r, c = [r], [c]
                wide = np.flatnonzero(many)
                for i in range(0, len(wide), 256):
                    mine = wide[i : i + 256]
                    best = np.argsort(-np.rint(scores[mine] * GRID), axis=1, kind="stable")[:, :k]
                    r.append(np.repeat(mine, best.shape[1]))
                    c.append(best.ravel())
                r, c = np.concatenate(r), np.concatenate(c)
                fine = scores[r, c] > -np.inf
                r, c = r[fine], c[fine]
                if not len(r):
                    continue
                at, score = np.concatenate([at, r]), np.concatenate([score, scores[r, c]])
                key = np.concatenate([key, np.rint(scores[r, c] * GRID).astype(np.int64)])
                found = pa.table({"vec_id": some["vec_id"], "label": some["label"]}).take(pa.array(c))
                kept = pa.concat_tables([kept, found]).combine_chunks() if kept is not None else found
                # what was kept comes first and in order of ids, so a stable sort leaves ties to the smaller one
                order = np.lexsort((-key, at))
                group = at[order]
                starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
                order, full = order[place < k], order[place == k - 1]
                bound[at[full]] = (key[full] + (0.5 - 1e-6)) / GRID
                at, key, score, kept = at[order], key[order], score[order], kept.take(pa.array(order))
        if len(at):
            kept = kept.combine_chunks()
            yield pa.record_batch([pa.array(qids[at]), kept["vec_id"].chunk(0), kept["label"].chunk(0), pa.array(score), pa.array(key)], ["query_id", "vec_id", "label", "score", "key"])

    return run


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, block: int = BROADCAST_QUERIES) -> DataFrame:
    """(query_id, vec_id, label, score, rank): the ``k`` nearest vectors of each query other than itself, by cosine, ties to the smaller id.

    A vector of length 0 has score 0 with every other, and so have vectors of different sizes. Scores are equal if they are to nine digits.
    Queries (query_id, embedding) meet the vectors in blocks of ``block``, which the driver holds one at a time, as products of matrices: a task holds
    a block, the products with ``CHUNK`` vectors and the ``k`` best so far of each query. Only these are shuffled, ``k`` a query and partition.
    """
    spark = vectors.sparkSession
    base = usable(vectors.select("vec_id", "label", "embedding")).where("vec_id is not null")
    asked = usable(queries.select("query_id", "embedding")).where("query_id is not null")
    count = asked.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // TASK))
    dealt = base.repartition(tasks, "vec_id").sortWithinPartitions("vec_id")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = f"query_id long, vec_id {kinds['vec_id']}, label {kinds['label']}, score double, key long"
    n = max(1, -(-count // block))
    found = spark.createDataFrame([], schema)
    for b in range(n if count else 0):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).orderBy("query_id").toArrow().combine_chunks()
        if not some.num_rows:
            continue
        embedding = some["embedding"].chunk(0)
        unit, sizes = _units(embedding, max(1, pc.max(pc.list_value_length(embedding)).as_py()))
        held = spark.sparkContext.broadcast((some["query_id"].to_numpy().astype(np.int64), unit, sizes, k))

        def run(rows: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            yield from _search(*held.value)(rows)

        found = found.union(dealt.mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("key")
    return top if least is None else top.where(F.col("score") >= least)


def select_relevant(found: DataFrame, k: int = 5, least: float = 0.50, below_top: float = 0.10) -> DataFrame:
    """Of each query the ``k`` best whose score reaches ``least`` and the best less ``below_top``."""
    w = Window.partitionBy("query_id")
    order = w.orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("top", F.max("score").over(w)).withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.round("score", 9) >= F.round(F.greatest(F.lit(least), F.col("top") - below_top), 9))).drop("top")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


SQL_NEAR = """
base AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, b.vec_id, b.label, list_dot_product(q.v, b.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v))) AS score FROM base q JOIN base b ON q.vec_id <> b.vec_id WHERE q.vec_id % 25 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10)"""


@query("vector_topk", f"WITH {SQL_NEAR} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM near WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return cosine_top_k(_queries(spark, sf), table(spark, sf, "embeddings"), 5).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("vector_topk_cutoff", f"""
WITH {SQL_NEAR}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM near)
SELECT query_id, vec_id, rank FROM t WHERE rank <= 5 AND round(score, 9) >= round(greatest(0.3, top - 0.1), 9)""")
def vector_topk_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return select_relevant(cosine_top_k(_queries(spark, sf), table(spark, sf, "embeddings"), 10), 5, 0.3).select("query_id", "vec_id", "rank")


@query("vector_threshold", f"WITH {SQL_NEAR} SELECT query_id, count(*) AS hits, min(vec_id) AS first_id FROM near WHERE score >= 0.3 GROUP BY query_id")
def vector_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return cosine_top_k(_queries(spark, sf), table(spark, sf, "embeddings"), 10, 0.3).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("vec_id").alias("first_id"))


@query("answer_confidence", f"""
WITH {SQL_NEAR} SELECT query_id, count(*) AS evidence, round(avg(score), 6) AS mean_score, CASE WHEN avg(score) >= 0.4 THEN 'HIGH' WHEN avg(score) >= 0.33 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM near WHERE rank <= 5 GROUP BY query_id""")
def answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return confidence(cosine_top_k(_queries(spark, sf), table(spark, sf, "embeddings"), 5), 0.4, 0.33)


def confidence(found: DataFrame, high: float = 0.75, medium: float = 0.60) -> DataFrame:
    mean = F.avg("score")
    return found.groupBy("query_id").agg(F.count("*").alias("evidence"), F.round(mean, 6).alias("mean_score"), F.when(mean >= high, "HIGH").when(mean >= medium, "MEDIUM").otherwise("LOW").alias("confidence"))


@query("label_retrieval_eval", f"""
WITH {SQL_NEAR}, p AS (SELECT n.query_id, avg(CASE WHEN n.label = e.label THEN 1.0 ELSE 0 END) AS precision_at_5, max(score) AS best FROM near n JOIN embeddings e ON n.query_id = e.vec_id WHERE rank <= 5 GROUP BY n.query_id)
SELECT count(*) AS queries, round(avg(precision_at_5), 6) AS mean_precision, round(avg(best), 6) AS mean_best, sum(CASE WHEN best >= 0.3 THEN 1 ELSE 0 END) AS relevant FROM p""")
def label_retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    near = cosine_top_k(_queries(spark, sf), vectors, 5).join(vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    per = near.groupBy("query_id").agg(F.avg(F.when(F.col("label") == F.col("own"), 1.0).otherwise(0.0)).alias("p"), F.max("score").alias("best"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("p"), 6).alias("mean_precision"), F.round(F.avg("best"), 6).alias("mean_best"), F.sum(F.when(F.col("best") >= 0.3, 1).otherwise(0)).alias("relevant"))


@query("search_combined", f"""
WITH {SQL_NEAR}, both_ AS (SELECT query_id, vec_id, score, label % 2 AS side, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY round(score, 9) DESC, vec_id) AS r FROM pairs),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM both_ WHERE r <= 5)
SELECT query_id, vec_id, side, rank FROM m WHERE rank <= 5""")
def search_combined(spark: SparkSession, sf: str) -> DataFrame:
    # the best of all are among the best of each side, so one search over both gives them
    near = cosine_top_k(_queries(spark, sf), table(spark, sf, "embeddings"), 5)
    return near.select("query_id", "vec_id", (F.col("label") % 2).alias("side"), "rank")


@query("exact_or_semantic", f"""
WITH {SQL_NEAR}, exact AS (SELECT vec_id AS query_id, vec_id FROM embeddings WHERE vec_id % 25 = 0 AND label < 5)
SELECT query_id, vec_id, 'exact' AS how FROM exact UNION ALL SELECT query_id, vec_id, 'semantic' FROM near WHERE rank <= 1 AND query_id NOT IN (SELECT query_id FROM exact)""")
def exact_or_semantic(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    exact = vectors.where("vec_id % 25 = 0 AND label < 5").select(F.col("vec_id").alias("query_id"), "vec_id", F.lit("exact").alias("how"))
    near = cosine_top_k(_queries(spark, sf), vectors, 1).select("query_id", "vec_id", F.lit("semantic").alias("how"))
    return exact.unionByName(near.join(exact, "query_id", "left_anti"))


@query("embedding_validate", """
SELECT count(*) AS vectors, count(*) - count(DISTINCT vec_id) AS duplicate_ids, count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS not_finite, count(*) FILTER (label IS NULL) AS missing_metadata FROM embeddings""")
def embedding_validate(spark: SparkSession, sf: str) -> DataFrame:
    return validate(table(spark, sf, "embeddings"), 64)


def validate(vectors: DataFrame, dim: int) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    bad = ~F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.agg(F.count("*").alias("vectors"), (F.count("*") - F.countDistinct("vec_id")).alias("duplicate_ids"), n(F.size("embedding") != dim).alias("wrong_size"), n(bad).alias("not_finite"), n(F.col("label").isNull()).alias("missing_metadata"))


@query("collection_verify", "SELECT count(*) AS points, count(*) FILTER (label = 3) AS layer3, count(DISTINCT label) AS collections, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS size_ok FROM embeddings")
def collection_verify(spark: SparkSession, sf: str) -> DataFrame:
    size = F.size("embedding")
    return table(spark, sf, "embeddings").agg(F.count("*").alias("points"), F.count(F.when(F.col("label") == 3, 1)).alias("layer3"), F.countDistinct("label").alias("collections"), ((F.min(size) == 64) & (F.max(size) == 64)).alias("size_ok"))


@query("payload_scroll", "SELECT vec_id, label, 1.0 AS score FROM embeddings WHERE label = 7 ORDER BY vec_id LIMIT 20")
def payload_scroll(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("label = 7").orderBy("vec_id").limit(20).select("vec_id", "label", F.lit(1.0).alias("score"))


@query("upsert_latest", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def latest(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The newest row of each key, as an upsert leaves it."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in newest])
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def route(text: Column, domain: list[str], compatibility: list[str], both: list[str]) -> Column:
    """DOMAIN, COMPATIBILITY or HYBRID by terms; HYBRID where neither or both sides have one."""
    low = F.lower(text)
    d, c = contains_any(low, domain), contains_any(low, compatibility)
    return F.when(contains_any(low, both), "HYBRID").when(c & ~d, "COMPATIBILITY").when(d & ~c, "DOMAIN").otherwise("HYBRID")


@query("retrieval_route", """
SELECT conv_id, turn, CASE WHEN contains(t, 'zzz') THEN 'HYBRID' WHEN (contains(t, 'ion') OR contains(t, 'the ')) AND NOT contains(t, 'ing') THEN 'COMPATIBILITY' WHEN contains(t, 'ing') AND NOT (contains(t, 'ion') OR contains(t, 'the ')) THEN 'DOMAIN' ELSE 'HYBRID' END AS route
FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')""")
def retrieval_route(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", route(F.col("text"), ["ing"], ["ion", "the "], ["zzz"]).alias("route"))


@query("semantic_text", """
SELECT p_partkey, concat_ws(chr(10) || chr(10), 'Name: ' || p_name, 'Type: ' || p_type, 'Aliases: ' || coalesce(nullif(p_brand, ''), 'None documented'), 'Keywords: ' || array_to_string(string_split(p_name, ' '), ', ')) AS document FROM part""")
def semantic_text(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(c, F.lit("")), F.lit("None documented")))
    doc = F.concat_ws("\n\n", part("Name", F.col("p_name")), part("Type", F.col("p_type")), part("Aliases", F.col("p_brand")), part("Keywords", F.array_join(F.split("p_name", " "), ", ")))
    return table(spark, sf, "part").select("p_partkey", doc.alias("document"))


@query("search_quality_report", f"""
WITH {SQL_NEAR}, q AS (SELECT query_id, count(*) FILTER (score >= 0.35) AS n, avg(score) FILTER (score >= 0.35) AS s FROM near GROUP BY query_id)
SELECT count(*) AS queries, round(avg(n), 6) AS mean_results, count(*) FILTER (n = 0) AS empty_queries, round(avg(s), 6) AS mean_similarity, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END), 6) AS success_rate FROM q""")
def search_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    near = cosine_top_k(_queries(spark, sf), table(spark, sf, "embeddings"), 10)
    hit = F.col("score") >= 0.35
    per = near.groupBy("query_id").agg(F.count(F.when(hit, 1)).alias("n"), F.avg(F.when(hit, F.col("score"))).alias("s"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("n"), 6).alias("mean_results"), F.count(F.when(F.col("n") == 0, 1)).alias("empty_queries"), F.round(F.avg("s"), 6).alias("mean_similarity"), F.round(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)), 6).alias("success_rate"))
