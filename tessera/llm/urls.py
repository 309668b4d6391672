"""URL filters: rules for hosts and paths, and gradient-boosted trees on lexical features for the rest.

Features are length, host and path length, depth, digit ratios, entropy, parameter counts,
label counts and the share of blocked URLs by suffix among the labelled ones. The trees are
fitted in numpy on a bounded sample of labelled URLs; by default those are URLs that a rule
decides. Rules are found by hash lookups of a host's suffixes, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import mapper

#: Labelled URLs that fitting reads, chosen by hash.
SAMPLE = 4000
TREES, DEPTH, RATE, BINS, SMALLEST = 40, 3, 0.2, 24, 5

Rule = tuple[bool, str]  # allow, and host and path in one, as "net/de/8"


def split(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty where the URL is null or has no ``://``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def match(host: str, path: str, rules: dict[str, list[tuple[str, bool, str]]]) -> tuple[bool, str] | None:
    """The longest rule whose host is the URL's or a parent domain and whose path begins the URL's; ties are no rule's gain."""
    best: tuple[int, bool, str] | None = None
    labels = host.split(".")
    for i in range(len(labels)):
        for prefix, allow, name in rules.get(".".join(labels[i:]), ()):
            if path.startswith(prefix) and (best is None or len(name) > best[0]):
                best = (len(name), allow, name)
    return best and best[1:]


def _indexed(rules: list[Rule]) -> dict[str, list[tuple[str, bool, str]]]:
    out: dict[str, list[tuple[str, bool, str]]] = {}
    for allow, name in rules:
        host, slash, path = name.partition("/")
        out.setdefault(host, []).append((slash + path, allow, name))
    return out


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1] / len(text)
    return float(-(n * np.log2(n)).sum())


def suffix_of(host: str) -> str:
    return ".".join(host.split(".")[-2:])


def features(urls: list[str | None], hosts: list[str], paths: list[str], suffixes: dict[str, float], prior: float) -> np.ndarray:
    out = np.zeros((len(urls), 14))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        u = url or ""
        query = u.partition("?")[2].partition("#")[0]
        digits = sum(c.isdigit() for c in u)
        labels = [x for x in host.split(".") if x]
        out[i] = (
            len(u), len(host), len(path), path.count("/"), digits / max(1, len(u)), sum(c.isdigit() for c in host) / max(1, len(host)),
            _entropy(u), _entropy(host), query.count("&") + bool(query), len(query), len(labels), host.count("-"),
            max(map(len, labels), default=0), suffixes.get(suffix_of(host), prior),
        )
    return out


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss, on features cut into bins at quantiles."""

    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)  # heap order: feature or -1, bin, value
    base: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        # both labels weigh the same, as rules name mostly what is to be blocked
        weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
        self.base = 0.0
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        b = self._binned(x)
        score = np.full(len(y), self.base)
        for _ in range(TREES if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (y - p), weight * p * (1 - p)
            tree: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (DEPTH + 1) - 1)
            node = np.zeros(len(y), int)
            for k in range(len(tree)):
                mine = np.flatnonzero(node == k)
                if not len(mine):
                    continue
                g, h = grad[mine].sum(), hess[mine].sum()
                best = (1e-6, -1, 0)
                if k < 2**DEPTH - 1 and len(mine) >= 2 * SMALLEST:
                    for j in range(b.shape[1]):
                        n = len(self.cuts[j]) + 1
                        gs, hs, ns = (np.bincount(b[mine, j], weights=w, minlength=n).cumsum()[:-1] for w in (grad[mine], hess[mine], np.ones(len(mine))))
                        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                        gain[(ns < SMALLEST) | (len(mine) - ns < SMALLEST)] = -1
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), j, int(gain.argmax()))
                tree[k] = (best[1], best[2], RATE * g / (h + 1))
                if best[1] >= 0:
                    node[mine] = 2 * k + 1 + (b[mine, best[1]] > best[2])
            score += np.array([t[2] for t in tree])[node]
            self.trees.append(tree)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[node]
                go = f >= 0
                node = np.where(go, 2 * node + 1 + (b[np.arange(len(x)), np.maximum(f, 0)] > cut[node]), node)
            out += value[node]
        return 1 / (1 + np.exp(-out))


@dataclass
class Model:
    trees: Trees
    suffixes: dict[str, float]
    prior: float

    def score(self, urls: list[str | None], hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        return self.trees.score(features(urls, hosts, paths, self.suffixes, self.prior))


def fit(urls: list[str], hosts: list[str], paths: list[str], blocked: np.ndarray) -> Model:
    prior = float(blocked.mean()) if len(blocked) else 0.5
    by: dict[str, list[float]] = {}
    for h, y in zip(hosts, blocked, strict=True):
        by.setdefault(suffix_of(h), []).append(float(y))
    suffixes = {s: (sum(v) + 4 * prior) / (len(v) + 4) for s, v in by.items()}
    return Model(Trees().fit(features(urls, hosts, paths, suffixes, prior), blocked.astype(float)), suffixes, prior)


def example_labels(n: int = 1500, seed: int = 11) -> list[tuple[str, bool]]:
    """Labelled URLs made by a rule, for use where no labels are at hand: plain ones of short spoken names, shallow
    paths and at most two parameters, and blocked ones of hyphenated or digit-laden hosts, long random tokens and many parameters."""
    rng = np.random.default_rng(seed)
    syllables = [c + v for c in "bdfghklmnprstvw" for v in "aeiou"] + [v + c for v in "aeio" for c in "nrst"]
    token = lambda size, of: "".join(rng.choice(list(of), size))
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    ends = ["com", "net", "org", "info", "example.com", "example.net", "example.org"]
    out: list[tuple[str, bool]] = []
    for i in range(n):
        if i % 2:
            front = rng.choice(["", "www.", "blog.", "m."])
            path = "/".join([*(rng.choice(["en", "de", "fr", "es", "news", "docs"], 1)), *(word() for _ in range(rng.integers(0, 2))), str(rng.integers(1, 1000))])
            tail = rng.choice(["", "", "/", ".html", "?page=2", "?page=2&ref=x", "?utm_source=feed", "#top"])
            out.append((f"https://{front}{word()}.{rng.choice(ends)}/{path}{tail}", False))
        else:
            host = "-".join(word() for _ in range(rng.integers(2, 5))) if rng.random() < 0.6 else word() + token(rng.integers(3, 9), "0123456789")
            path = "/".join([rng.choice(["en", "de", "fr", "es", "go", "out"]), *(token(rng.integers(4, 14), "abcdefghij0123456789") for _ in range(rng.integers(0, 4)))])
            tail = "?" + "&".join(f"{token(2, 'abcdxyz')}={token(rng.integers(2, 12), 'abcdef0123456789')}" for _ in range(rng.integers(1, 6))) if rng.random() < 0.5 else f"/{rng.integers(1, 1000)}"
            out.append((f"http://{rng.choice(['', 'www.'])}{host}.{rng.choice(ends)}/{path}{tail}", True))
    return out


def _matched(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    host, path = split(F.col("url"))
    parts = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    index = _indexed(rules)

    def step(t: pa.Table) -> pa.Table:
        found = [match(h, p, index) for h, p in zip(t["host"].to_pylist(), t["path"].to_pylist(), strict=True)]
        return t.append_column("rule", pa.array([f and f[1] for f in found], pa.string())).append_column("allow", pa.array([f and f[0] for f in found], pa.bool_()))

    return parts.mapInArrow(mapper(lambda: step), f"{parts._jdf.schema().toDDL()}, rule string, allow boolean")


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of ``pages`` (page_id, url).

    ``labelled`` has url and blocked (boolean); without it, URLs that a rule decides are the labels.
    verdict is the rule's, else block where the trees' score is 0.5 or more. score is the trees' for every row.

    * Null URL, or one without ``://``: host and path empty, so no rule; judged by the trees.
    * Repeated rows are judged each; null page_ids are kept; an empty table gives an empty result.
    * Columns other than page_id and url are not read.
    """
    found = _matched(pages, rules)
    if labelled is None:
        marked = found.where("rule is not null").select("url", "host", "path", (~F.col("allow")).alias("blocked"))
    else:
        host, path = split(F.col("url"))
        marked = labelled.where("url is not null and blocked is not null").select("url", host.alias("host"), path.alias("path"), "blocked")
    rows = marked.distinct().orderBy(F.xxhash64("url"), "url", "blocked").limit(sample).collect()
    model = fit([r["url"] for r in rows], [r["host"] for r in rows], [r["path"] for r in rows], np.array([bool(r["blocked"]) for r in rows], bool))
    held = pages.sparkSession.sparkContext.broadcast(model)  # bounded by ``sample``

    def make():
        m = held.value

        def step(t: pa.Table) -> pa.Table:
            s = m.score(*(t[c].to_pylist() for c in ("url", "host", "path")))
            allow = [a if a is not None else p < 0.5 for a, p in zip(t["allow"].to_pylist(), s, strict=True)]
            out = t.select(["page_id", "host", "path", "rule"])
            return out.append_column("verdict", pa.array(["allow" if a else "block" for a in allow], pa.string())).append_column("score", pa.array(s))

        return step

    page_id = pages.schema["page_id"].dataType.simpleString()
    return found.mapInArrow(mapper(make), f"page_id {page_id}, host string, path string, rule string, verdict string, score double")
