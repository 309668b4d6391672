"""Language identification: averaged hashed subword embeddings and a linear softmax, fitted by
stochastic gradient descent in numpy, with a calibrated rejection limit.

A subword is a run of two to four characters of the lower-cased text in which only the ends
may be a word's border. Subwords are hashed into buckets; a text is the mean of its buckets'
embeddings. As the softmax is linear, embeddings times weights give each bucket one number
per language, and a text's scores are means of these over all its subwords, whole texts always.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tessera.llm.sampling import held_out, per_class
from tessera.llm.shared import mapper
from tessera.llm.shingles import pieces

BUCKETS = 1 << 16
UND = "und"
#: Labelled documents of each language that fitting reads, chosen by hash of the id.
SAMPLE = 600
#: Share of accepted sample texts that the rejection limit keeps.
KEEP = 0.999

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each subword length its buckets and their places, where the places of each text begin, and its number of letters.

    Each text has a border of its own on both sides, so its subwords are the same in any company.
    """
    low = [(t or "").lower() for t in texts]
    joined = " " + "  ".join(low) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.concatenate([[0], np.cumsum(sizes + 2)])[:-1]
    count = np.concatenate([[0], np.cumsum(letter)])
    letters = count[starts + 1 + sizes] - count[starts + 1]
    p = np.where(letter, points, 0).astype(np.uint32)
    found = []
    for n in (2, 3, 4):
        m = len(p) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        ok = np.ones(m, bool)
        for j in range(n):
            h = (h ^ p[j : j + m]) * np.uint32(0x01000193 * 2 * n + 1)
            if 0 < j < n - 1:
                ok &= letter[j : j + m]
        if n == 2:
            ok &= letter[:m] | letter[1 : 1 + m]
        at = np.flatnonzero(ok)
        h = h[at]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        found.append(((h >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1), at))
    return found, starts, letters


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    all_of = [b for b, _ in subwords([text])[0]]
    x = np.concatenate(all_of) if all_of else np.zeros(0, np.int64)
    ids, n = np.unique(x, return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    limit: float  # score below which a text is rejected
    seen: np.ndarray  # 1 for buckets that fitting met

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; und and 0 for null or no letter, and for all where no language was learned.

        The score is the calibrated probability times the share of subwords that fitting met, so a text in
        a script or vocabulary of its own scores low however clear its softmax is.
        """
        names: list[str] = []
        best = np.zeros(len(texts))
        if not self.languages:
            return [UND] * len(texts), best
        for a, b in pieces(texts):
            found, starts, letters = subwords(texts[a:b])
            total, n, met = np.zeros((b - a, len(self.languages))), np.zeros(b - a), np.zeros(b - a)
            for buckets, at in found:
                bounds = np.searchsorted(at, starts)
                some = np.flatnonzero(np.diff(np.append(bounds, len(at))) > 0)
                if not len(some):
                    continue
                for k in range(len(self.languages)):
                    total[some, k] += np.add.reduceat(self.scores[k][buckets], bounds[some], dtype=np.float64)
                met[some] += np.add.reduceat(self.seen[buckets], bounds[some], dtype=np.float64)
                n[some] += np.diff(np.append(bounds, len(at)))[some]
            z = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            top = z.argmax(axis=1)
            for i in range(b - a):
                ok = letters[i] > 0
                names.append(self.languages[top[i]] if ok else UND)
                best[a + i] = z[i, top[i]] * met[i] / max(1, n[i]) if ok else 0.0
        return names, best


def fit(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 12, rate: float = 0.5, batch: int = 64, seed: int = 5) -> Model:
    """Embeddings and softmax by SGD over shuffled batches; one text in five only calibrates the temperature and the limit."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    xs = [_counts(t) for t in texts]
    order = rng.permutation(len(xs))
    check, train = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps = max(1, epochs * math_ceil(len(train), batch))
    step = 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for a in range(0, len(train), batch):
            rows = train[a : a + batch]
            lr = rate * (1 - step / steps)
            step += 1
            mean = np.stack([xs[i][1] @ emb[xs[i][0]] if len(xs[i][0]) else np.zeros(dim, np.float32) for i in rows])
            z = mean @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = p @ w.T
            w -= lr * 4 * (mean.T @ p) / len(rows)
            bias -= lr * p.mean(axis=0) / 10
            for i, g in zip(rows, back, strict=True):
                emb[xs[i][0]] -= lr * 8 * np.outer(xs[i][1], g)
    unseen = np.ones(BUCKETS, bool)
    for i in train:
        unseen[xs[i][0]] = False
    emb[unseen] = 0  # an unknown script scores as the bias alone, which the limit rejects
    scores = np.ascontiguousarray((emb @ w).T)
    model = Model(languages, scores, bias, 1.0, 0.0, (~unseen).astype(np.float32))
    if len(check) >= 20:
        z = np.stack([scores[:, xs[i][0]] @ xs[i][1] + bias if len(xs[i][0]) else bias for i in check]).astype(float)
        grid = np.geomspace(1e-3, 20, 80)

        def loss(t: float) -> float:
            s = z / t
            s -= s.max(axis=1, keepdims=True)
            return float(-(s[np.arange(len(check)), y[check]] - np.log(np.exp(s).sum(axis=1))).mean())

        model.temperature = float(min(grid, key=loss))
        best = np.sort(model.predict([texts[i] for i in check])[1])
        model.limit = min(0.5, float(best[int((1 - KEEP) * len(best))]) * 0.9)
    return model


def math_ceil(n: int, d: int) -> int:
    return -(-n // d)


def learnable(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of the labelled documents that aren't held out."""
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)).select("doc_id", "text", "lang")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fitted on at most ``sample`` documents, and ``sampling.BYTES``, of each non-null lang among those that aren't held out.

    Without any labelled document there is nothing to learn, and the model answers und to every text.
    """
    some = learnable(docs)
    rows = per_class(some, some, "lang", "doc_id", sample).orderBy("doc_id", "lang").collect()
    if not rows:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.float32), 1.0, 1.0, np.zeros(BUCKETS, np.float32))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and accepted appended, replacing columns of these names.

    Null text or text without a letter: und, score 0, not accepted. Any length, whole text.
    Every row gets its own answer, also repeated ones and null doc_id; empty in, empty out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS and the number of languages
    out = docs.drop("lang_pred", "score", "accepted")
    schema = StructType([*out.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])

    def make():
        m = held.value

        def step(rows: pa.Table) -> pa.Table:
            names, best = m.predict(rows["text"].to_pylist())
            ok = [bool(s >= m.limit and n != UND) for n, s in zip(names, best, strict=True)]
            return rows.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(best)).append_column("accepted", pa.array(ok))

        return step

    return out.mapInArrow(mapper(make), schema)
