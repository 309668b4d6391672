"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words counts their common subsequences of up to ``ORDER`` characters, each
gap weighted by ``DECAY`` and normalised, so an insult with gaps or inserted characters stays
close to itself; border marks make prefixes and endings count. The Nystroem map whitens a word's
kernel values at the landmarks by the landmarks' own kernel matrix. A text's features are the
largest of its words' in each dimension, which does not thin out in long texts; a linear machine
trained by stochastic subgradient on the hinge loss separates them, and a logistic fit turns
margins into scores.

Landmarks are words of the training texts that tell toxic from other texts, found by document
counts in bounded samples. The kernel is computed for each pair that may reach ``LEAST``: what a
landmark's subsequences of some of its letters weigh is a bound for words that lack the others.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.sampling import held_out, per_class
from tessera.llm.shared import mapper

ORDER, DECAY = 4, 0.75
#: Power of the normalised kernel, which is a kernel again: near matches stay, loose ones fade. Values below ``LEAST``, of a
#: normalised kernel below 0.5, count as 0: an insult with two inserted characters, or with each one doubled, has a value.
POWER, LEAST = 2, 0.25
LANDMARKS, RATIO = 160, 15
#: Labelled documents of each class that fitting reads.
SAMPLE = 3000
#: A token is cut into overlapping windows of this many characters, half of it apart.
LONGEST = 32
#: Bytes of chunks and features that a worker keeps, and characters of a chunk that is kept at most.
KNOWN, KEPT = 96 << 20, 64
_ENTRY = 250

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_ASCII = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]*\s+){3,}[^\W\d_](?!\w)")
_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")


#: Single letters of the Latin, Greek and Cyrillic blocks.
_SINGLE = {chr(c) for c in range(0x500) if chr(c).isalpha()}


def words_of(chunk: str) -> list[str]:
    """A chunk between white space as words: without marks at its ends, with and without marks inside, long ones in windows."""
    found = [chunk]
    if not chunk.isalnum():
        w = chunk.strip(_ASCII)
        if not w.isalnum():
            w = _EDGE.sub("", w)
        found = [w]
        if w and not w.isalnum():
            found.append("".join(c for c in w if c.isalnum()))
    out = []
    for w in found:
        if len(w) <= LONGEST:
            out.append(w)
        else:
            out += [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    return [w for w in out if w]


def chunks(text: str | None) -> set[str]:
    """Distinct lower-cased chunks between white space; four or more single letters in a row are a chunk as well."""
    low = (text or "").lower()
    if not low.isascii() and _INVISIBLE.search(low):
        low = _INVISIBLE.sub("", low)
    found = set(low.split())
    if len(_SINGLE & found) > 2:
        found |= {"".join(c for c in m if c.isalpha()) for m in _SPELLED.findall(low)}
    return found


def tokens(text: str | None) -> set[str]:
    """Distinct words of a text."""
    return {w for c in chunks(text) for w in words_of(c)}


def _points(words: list[str], width: int) -> np.ndarray:
    """Words as rows of code points, 0 behind the end."""
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def _codes(words: list[str], width: int) -> np.ndarray:
    """Marked words as rows of code points, 0 behind the end."""
    return _points([f"^{w}$" for w in words], width)


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``a`` the codes of the classes, 32 in all, that the same row of ``b`` has too, the powers of
    ``DECAY`` for the steps from the code before, and their number. Codes of other classes match nothing in ``b``."""
    keep = (a > 0) & ((_classes(b)[:, None] >> (a % 32)) & 1).astype(bool)
    row, place = np.nonzero(keep)
    at = (np.cumsum(keep, axis=1) - 1)[row, place]
    codes, places = np.zeros_like(a), np.zeros(a.shape, np.int64)
    codes[row, at], places[row, at] = a[row, place], place
    steps = np.maximum(np.diff(places, axis=1, prepend=0), 0)
    return codes, (DECAY ** np.arange(a.shape[1] + 1)).astype(np.float32)[steps], keep.sum(axis=1)


def kernel(a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of ``a`` with the same row of ``b`` (codes, 0 behind
    the end), summed over lengths 2 to ``ORDER``, not normalised.

    Codes that one word alone has are left out, with their places kept in the steps, and pairs
    with as many left are computed together. For each two places ``match`` is what common
    subsequences ending there weigh. The sum over all places before both, faded by distance, is
    taken along one word and then along the other. All steps are by element, so a pair's value
    does not depend on the rows beside it.
    """
    out = np.zeros(len(a), np.float32)
    (x, step_x, nx), (y, step_y, ny) = _common(a, b), _common(b, a)
    order = np.lexsort((nx, ny))
    order = order[(nx[order] > 1) & (ny[order] > 1)]
    for k in range(0, len(order), block):
        rows = order[k : k + block]
        la, lb = nx[rows].max(), ny[rows].max()
        some, other = x[rows, :la].T, y[rows, :lb].T
        along_x, along_y = step_x[rows, :la].T.copy(), step_y[rows, :lb].T.copy()
        same = ((some[None] == other[:, None]) & (some[None] > 0)).astype(np.float32)
        match, total = same * np.float32(DECAY**2), np.zeros(len(rows), np.float32)
        along, before = np.empty_like(same), np.empty_like(same)
        for _ in range(ORDER - 1):
            along[0] = 0
            for j in range(1, lb):
                np.add(along[j - 1], match[j - 1], out=along[j])
                along[j] *= along_y[j]
            before[:, 0] = 0
            for i in range(1, la):
                np.add(before[:, i - 1], along[:, i - 1], out=before[:, i])
                before[:, i] *= along_x[i]
            np.multiply(same, before, out=match)
            total += match.reshape(la * lb, len(rows)).sum(axis=0)
        out[rows] = total
    return out


#: For a code that a word has so often, the logarithm of the most ways to choose some of its places, divided among them.
_WAYS = np.array([0.0] + [np.log(comb(n, n // 2)) / n for n in range(1, LONGEST + 3)])


def norm_bound(keep: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """For words, as columns, a bound B: their subsequences s over the places in ``keep`` have weights f(s) with
    sum of f(s) g(s) at most B times the norm of g, for any g. ``keep`` has all or no places of a code.

    By Cauchy-Schwarz over occurrences instead of subsequences: their squared weights need one pass
    along the word, and no subsequence occurs more often than its codes' places can be chosen, ``ways`` in logarithms.
    """
    here = keep.astype(np.float64)
    ends, total = here * DECAY**2, np.zeros(keep.shape[1])
    for _ in range(ORDER - 1):
        run, longer = np.zeros(keep.shape[1]), np.zeros_like(ends)
        for j in range(1, len(here)):
            run += ends[j - 1]
            run *= DECAY**2
            np.multiply(run, here[j], out=longer[j])
        ends = longer
        total += ends.sum(axis=0)
    return np.sqrt(total * np.exp((ways * here).sum(axis=0)))


def _least_own(length: int) -> float:
    """Least norm of a marked word of this length, which it has if no letter recurs: what recurs only adds."""
    return float(np.sqrt(kernel(*[np.arange(1, length + 1, dtype=np.uint32)[None]] * 2)[0]))


def _classes(codes: np.ndarray) -> np.ndarray:
    """The set of classes of code points of each row as bits, 32 classes in all."""
    return np.bitwise_or.reduce(np.where(codes > 0, np.uint32(1) << (codes % 32), np.uint32(0)), axis=1)


@dataclass
class Landmarks:
    words: list[str]

    def __post_init__(self) -> None:
        self.width = max(map(len, self.words), default=0) + 2
        self.codes = _codes(self.words, self.width)
        self.own = np.sqrt(kernel(self.codes, self.codes))
        self.least = np.array([0.0] * 2 + [_least_own(n) for n in range(2, LONGEST + 3)])
        self.classes = _classes(self.codes)
        self.bounds = [self._bound(i) for i in range(len(self.words))]

    def _bound(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The landmark's classes of letters, and for each set of them, as bits, what the landmark's own letters of the set weigh:
        by Cauchy-Schwarz the normalised kernel of a word without the others is at most this."""
        x = self.codes[i, : len(self.words[i]) + 2]
        inside = (np.arange(len(x)) > 0) & (np.arange(len(x)) < len(x) - 1)
        classes, times = np.unique(x[inside] % 32, return_counts=True)
        classes = classes[np.argsort(-times, kind="stable")][:10]  # the bound holds for any choice of classes
        sets = (np.arange(1 << len(classes))[:, None] >> np.arange(len(classes))) & 1
        gone = (inside & (x % 32 == classes[:, None]))[None, :, :] & (sets == 0)[:, :, None]
        codes = np.where(gone.any(axis=1), 0, x[None, :]).astype(np.uint32)
        most = np.sqrt(np.concatenate([kernel(codes[k : k + 256], codes[k : k + 256]) for k in range(0, len(codes), 256)])) / max(self.own[i], 1e-12)
        return classes, most + 1e-9

    def candidates(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (word, landmark) that may reach ``LEAST`` by the letters they share and where the word has them."""
        least = LEAST ** (1 / POWER) * (1 - 1e-3)
        letters, parts = _classes(_points(words, LONGEST)), []
        codes = np.ascontiguousarray(_codes(words, LONGEST + 2).T)
        lens, bits = (codes > 0).sum(axis=0), np.where(codes > 0, np.uint32(1) << (codes % 32), np.uint32(0))
        ways = _WAYS[sum((codes == codes[j]).astype(np.int8) for j in range(len(codes)))]
        for i, (classes, most) in enumerate(self.bounds):
            have = np.zeros(len(words), np.int64)
            for bit, c in enumerate(classes.tolist()):
                have |= ((letters >> np.uint32(c)) & 1).astype(np.int64) << bit
            near = np.flatnonzero(most[have] >= least)
            for w in (near[lens[near] <= 13], near[lens[near] > 13]):
                wide = int(lens[w].max(initial=0))
                share = norm_bound((bits[:wide, w] & self.classes[i]) > 0, ways[:wide, w]) / self.least[lens[w]]
                w = w[most[have[w]] * share >= least]
                parts.append((w, np.full(len(w), i)))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def similar(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs (word, landmark) with a value of ``LEAST`` or more, and the values, sorted by word."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(words) if self.words else 0, 4096):
            some = words[at : at + 4096]
            w, m = self.candidates(some)
            codes, lens = _codes(some, LONGEST + 2), np.fromiter(map(len, some), np.int64, len(some)) + 2
            values = np.zeros(len(w))
            for k in range(0, len(w), 8192):
                values[k : k + 8192] = kernel(self.codes[m[k : k + 8192]], codes[w[k : k + 8192]])
            may = values >= LEAST ** (1 / POWER) * (1 - 1e-3) * self.own[m] * self.least[lens[w]]
            w, m, values = w[may], m[may], values[may]
            mine, at_mine = np.unique(w, return_inverse=True)
            own = np.sqrt(kernel(codes[mine], codes[mine]))
            values = np.minimum(values / np.maximum(own[at_mine] * self.own[m], 1e-12), 1) ** POWER
            near = np.flatnonzero(values >= LEAST)
            near = near[np.argsort(w[near], kind="stable")]
            found.append((at + w[near], m[near], values[near]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


#: Features of chunks a worker has seen, by the model's stamp, and their size.
_seen: dict[bytes, dict[str, np.ndarray | None]] = {}
_held: dict[bytes, int] = {}


@dataclass
class Model:
    marks: Landmarks
    map: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def _features(self, new: list[str]) -> dict[str, np.ndarray | None]:
        """The Nystroem features of chunks: the largest of their words' in each dimension, None where all words have value 0."""
        parts = [words_of(c) for c in new]
        flat = sorted({w for p in parts for w in p})
        w, m, values = self.marks.similar(flat)
        which, row = np.unique(w, return_inverse=True)
        near = np.zeros((len(which), len(self.marks.words)))
        near[row, m] = values
        mapped = dict(zip([flat[i] for i in which.tolist()], (near @ self.map).astype(np.float32), strict=True))
        out: dict[str, np.ndarray | None] = {}
        for c, p in zip(new, parts, strict=True):
            some = [mapped[x] for x in p if x in mapped]
            out[c] = np.maximum.reduce(some) if some else None
        return out

    def values(self, texts: list[str | None]) -> np.ndarray:
        """Largest feature of each text's words in each dimension, 0 at least; zeros for a text without words."""
        stamp = self.weights.tobytes()[:64] + self.map.tobytes()[:64] + "".join(self.marks.words).encode()[:256]
        if stamp not in _seen or _held[stamp] > KNOWN:
            _seen.clear()
            _held.clear()
            _seen[stamp], _held[stamp] = {}, 0
        known = _seen[stamp]
        found = [chunks(t) for t in texts]
        made = self._features(list(set().union(*found).difference(known)))
        out = np.zeros((len(texts), len(self.marks.words)))
        for i, cs in enumerate(found):
            some = [x for c in cs if (x := made[c] if c in made else known[c]) is not None]
            if some:
                out[i] = np.maximum(np.maximum.reduce(some), 0)
        short = {c: x for c, x in made.items() if len(c) <= KEPT}
        known |= short
        _held[stamp] += sum(_ENTRY + (0 if x is None else x.nbytes) for x in short.values())
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = self.values(texts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def contexts(texts: list[str], words: set[str]) -> Counter:
    """In how many different contexts, the chunks before and behind, the texts have each of the words.

    Copies of a text, near ones too, repeat a word's context, while what is said anew stands in a new one.
    """
    found: dict[str, set[int]] = {}
    parts: dict[str, list[str]] = {}
    for t in texts:
        s = ["", *t.lower().split(), ""]
        rest = tokens(t) & words
        for i in range(1, len(s) - 1):
            if s[i] not in parts:
                parts[s[i]] = [w for w in words_of(s[i]) if w in words]
            for w in parts[s[i]]:
                found.setdefault(w, set()).add(hash((s[i - 1], s[i + 1])))
                rest.discard(w)
        for w in rest:  # spelled in single letters
            found.setdefault(w, set()).add(hash(t))
    return Counter({w: len(c) for w, c in found.items()})


def landmarks(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Words in three toxic texts and one in a hundred at least, and ``RATIO`` times as often there as in others, by log ratio weighted
    with their count. A word counts once for each context in toxic texts, so that one text's copies don't make its words telling.
    A word to which one chosen before has a kernel value is left out, as that one stands for it in the map."""
    hot, cold = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        (hot if y else cold).update(tokens(t))
    nh, nc = max(1, toxic.sum()), max(1, (~toxic).sum())
    often = {w for w, n in hot.items() if n >= max(3, nh / 100) and len(w) >= 3 and (n + 0.1) / nh >= RATIO * (cold[w] + 0.5) / nc}
    anew = contexts([t for t, y in zip(texts, toxic, strict=True) if y], often)
    hot = {w: min(hot[w], anew[w]) for w in often}
    ratio = {w: ((n + 0.1) / nh) / ((cold[w] + 0.5) / nc) for w, n in hot.items() if n >= max(3, nh / 100)}
    found = sorted((w for w in ratio if ratio[w] >= RATIO), key=lambda w: (-hot[w] * np.log(ratio[w]), w))[: 4 * most]
    near: dict[int, set[int]] = {}
    for w, m in zip(*(x.tolist() for x in Landmarks(found).similar(found)[:2]), strict=True):
        near.setdefault(w, set()).add(m)
    chosen: list[int] = []
    for k in range(len(found)):
        if len(chosen) < most and not near.get(k, set()) & set(chosen):
            chosen.append(k)
    return sorted(found[k] for k in chosen)


def fit(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS, epochs: int = 40, rate: float = 2.0, slow: float = 0.002, ridge: float = 0.1, balance: float = 0.5, reg: float = 1e-4, seed: int = 3) -> Model:
    """Hinge loss with class weights by averaged stochastic subgradient on the Nystroem map; a logistic fit on the margins."""
    marks = Landmarks(landmarks(texts, toxic, most))
    if not marks.words:
        return Model(marks, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, float(np.log((toxic.sum() + 1) / ((~toxic).sum() + 1))))
    gram = np.zeros((len(marks.words), len(marks.words)))
    w, m, values = marks.similar(marks.words)
    gram[w, m] = values
    gram = (gram + gram.T) / 2
    vals, vecs = np.linalg.eigh(gram)
    nystroem = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 0) + ridge)) @ vecs.T
    own = Model(marks, nystroem, np.zeros(len(marks.words)), 0.0, 1.0, 0.0)
    x = np.concatenate([own.values(texts[i : i + 500]) for i in range(0, len(texts), 500)])
    y = np.where(toxic, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    cost = np.where(toxic, len(y) / (2 * max(1, toxic.sum())), len(y) / (2 * max(1, (~toxic).sum())))
    cost = cost**balance
    w, b, mean_w, mean_b, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    for e in range(epochs):
        for i in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            t += 1
            lr = rate / (1 + slow * t)
            bad = y[i] * (x[i] @ w + b) < 1
            g = (cost[i] * y[i] * bad)
            w += lr * ((g @ x[i]) / len(i) - reg * w)
            b += lr * g.mean()
            if e >= epochs // 2:
                mean_w += w
                mean_b += b
    n = max(1, sum(1 for _ in range(epochs // 2, epochs)) * max(1, len(y) // 32))
    w, b = mean_w / n, mean_b / n
    margin = x @ w + b
    a, s = 1.0, 0.0
    for _ in range(300):  # a small prior keeps the slope finite on separable margins
        p = 1 / (1 + np.exp(-np.clip(a * margin + s, -40, 40)))
        d = p - toxic
        a -= 0.5 * ((d * margin).mean() + 1e-3 * (a - 2))
        s -= 0.5 * d.mean()
    return Model(marks, nystroem, w, float(b), float(max(a, 1e-3)), float(s))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fitted on at most ``sample`` labelled documents, and ``sampling.BYTES``, of each class among those that aren't held out.

    Without any the model has nothing to go by, and every text scores 0 to within 1e-17.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    rows = per_class(marked, texts, "toxic", "doc_id", sample).orderBy("doc_id").collect()
    if not rows:
        return Model(Landmarks([]), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, -40.0)
    return fit([r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity appended (a column of this name is replaced): 0 to 1, higher where toxic is likelier.

    Null and empty texts score as texts without any landmark. Whole texts of any length; every
    row gets its own score, also repeated ones and null doc_id; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS bounds its size
    out = docs.drop("toxicity")

    def make():
        m = held.value
        return lambda rows: rows.append_column("toxicity", pa.array(m.score(rows["text"].to_pylist())))

    return out.mapInArrow(mapper(make), StructType([*out.schema.fields, StructField("toxicity", DoubleType())]))
