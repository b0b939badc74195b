"""Personal data: pattern spans, and a skip-chain conditional random field on top.

Base spans are the leftmost, non-overlapping matches of four patterns (email, ip, card, phone) that pass their checks; they are always reported. The
field labels each white-space token with one of these kinds or none. Its potentials: a log-linear unary term on the shapes of the token and its
neighbours and on the word before, a transition matrix between neighbours, and two skip matrices between each token that holds a digit or an @ and
the next one that is the same, or that has the same shape, however distant. Sum-product messages run along all edges for ROUNDS rounds, so that evidence for one
occurrence reaches the others. Tokens of base spans are held at their labels; runs of other tokens of one kind whose marginals are at least SURE and that touch no
base span are added. The patterns' checks are not features, so the field can find what a check or a neighbour's digits made a pattern miss.

All weights are learned together by pseudo-likelihood: each token given the labels of its chain and skip neighbours. Learning uses at most MAX_TRAIN
documents that hold a digit or an @ (those of the least hash of their id), labelled by the base spans. Every text is searched whole, in time that grows with its
length: patterns start only where their needed sign or the first digit of a run is. A text without digit and @ cannot hold any span, so it is passed over.

Rows: null and empty texts have no spans. Null and repeated ids are kept, each row by itself. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# The kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_TRAIN = 2000
ROUNDS = 6
SURE = 0.97
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that fails at its start fails inside too, so it is tried once.
_IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MAYBE_IP = re.compile(r"[0-9]\.[0-9]")
_MAYBE_EMAIL = re.compile(r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]")
_LONG = re.compile(r"(?:[0-9][\x20-]?){11}[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL: from each @ to both sides, never back over an earlier @ or match."""
    at, done = text.find("@"), 0
    while at >= 0:
        size = _LOCAL.match(text[done:at][::-1]).end()
        found = _DOMAIN.match(text, at + 1) if size else None
        if found:
            yield at - size, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and kind. Each pattern runs only where a needed part of it is there."""
    out = []
    if _MAYBE_EMAIL.search(text):
        out += [(a, 0, b) for a, b in emails(text)]
    if _MAYBE_IP.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP_RUN.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
    if _LONG.search(text):
        for m in _CARD_RUN.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return sorted(out)


def _shape(token: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: f"9{{{min(len(m[0]), 20)}}}", re.sub(r"[^\W\d_]+", "a", token))
    return s[:40]


def features(tokens: list[str]) -> list[tuple[str, ...]]:
    """Each token's own shape, its neighbours' shapes, and the word before it if that has a sign that announces something."""
    own = [_shape(t) if not t.isalpha() else "a" for t in tokens]
    last = len(own) - 1
    before = lambda i: tokens[i - 1][:20].lower() if i and tokens[i - 1][-1] in ":=" else ""
    return [(f"s{own[i]}", f"p{own[i - 1] if i else '^'}", f"n{own[i + 1] if i < last else '$'}", f"w{before(i)}") for i in range(len(tokens))]


def skip_edges(tokens: list[str], feats: list[tuple[str, ...]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(same, alike): pairs of each token with a digit or other sign and the one before it that is equal, else that has an equal shape."""
    last: dict[str, int] = {}
    edges: tuple[list, list] = ([], [])
    for i, t in enumerate(tokens):
        if feats[i][0] == "sa":
            continue
        for kind, key in enumerate(("=" + t.lower(), "~" + feats[i][0])):
            if key in last:
                edges[kind].append((last[key], i))
                break
        last["=" + t.lower()] = last["~" + feats[i][0]] = i
    return edges


def observed(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """Tokens, their offsets and the base label of each (0: none)."""
    found = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    labels = np.zeros(len(found), np.int64)
    starts = np.array([a for _, a, _ in found])
    for s, kind, e in spans:
        i = max(0, int(np.searchsorted(starts, s, "right")) - 1)
        while i < len(found) and found[i][1] < e:
            if found[i][2] > s:
                labels[i] = kind + 1
            i += 1
    return [t for t, _, _ in found], [(a, b) for _, a, b in found], labels


LABELS = len(KINDS) + 1


class Field:
    """Log-potentials: unary by feature, transition between neighbours, and one symmetric matrix for each kind of skip edge."""

    def __init__(self, unary: dict[str, np.ndarray], transition: np.ndarray, skip: np.ndarray) -> None:
        self.unary, self.transition, self.skip = unary, transition, skip
        self.cache: dict[tuple[str, ...], np.ndarray] = {}

    def scores(self, feats: list[tuple[str, ...]]) -> np.ndarray:
        out = np.empty((len(feats), LABELS))
        for i, f in enumerate(feats):
            u = self.cache.get(f)
            if u is None:
                u = sum((self.unary[x] for x in f if x in self.unary), np.zeros(LABELS))
                if len(self.cache) < 100_000:
                    self.cache[f] = u
            out[i] = u
        return out

    def marginals(self, tokens: list[str], feats: list[tuple[str, ...]], labels: np.ndarray) -> np.ndarray:
        """Loopy sum-product over the chain and the skip edges; tokens in base spans are held at their label."""
        u = self.scores(feats)
        u[labels > 0] = -50.0
        u[labels > 0, labels[labels > 0]] = 0.0
        n = len(u)
        same, alike = skip_edges(tokens, feats)
        edges = np.array([(i, i + 1) for i in range(n - 1)] + same + alike, np.int64).reshape(-1, 2)
        a, b = edges[:, 0], edges[:, 1]
        kind = np.repeat([0, 1, 2], [n - 1, len(same), len(alike)])
        table_ = np.exp(np.stack([self.transition, *self.skip]) - max(self.transition.max(), self.skip.max()))
        right, left = np.zeros((len(edges), LABELS)), np.zeros((len(edges), LABELS))
        parts = [np.flatnonzero(kind == k) for k in range(3)]
        for _ in range(ROUNDS):
            belief = u.copy()
            np.add.at(belief, b, right)
            np.add.at(belief, a, left)
            out = [belief[a] - left, belief[b] - right]
            out = [np.exp(x - x.max(1, keepdims=True)) for x in out]
            for k, at in enumerate(parts):
                right[at] = np.log(out[0][at] @ table_[k] + 1e-30)
                left[at] = np.log(out[1][at] @ table_[k].T + 1e-30)
            right -= right.max(1, keepdims=True)
            left -= left.max(1, keepdims=True)
        belief = u.copy()
        np.add.at(belief, b, right)
        np.add.at(belief, a, left)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def instances(text: str) -> Iterator[tuple]:
    """For each token of a text: its features, its label, and the labels of its neighbours by edge: left, right, same (before, after), alike (before, after); -1: none there."""
    tokens, _, labels = observed(text, base_spans(text))
    feats, y = features(tokens), labels.tolist()
    near = [[y[i - 1] if i else -1, y[i + 1] if i + 1 < len(y) else -1, -1, -1, -1, -1] for i in range(len(y))]
    for k, edges in enumerate(skip_edges(tokens, feats)):
        for i, j in edges:
            near[j][2 + 2 * k], near[i][3 + 2 * k] = y[i], y[j]
    return zip(feats, y, map(tuple, near))


def fit(seen: Counter, steps: int = 400, rate: float = 0.5, penalty: float = 1e-6) -> Field:
    """All weights by pseudo-likelihood (Adagrad on the counts of distinct instances, with a squared penalty)."""
    rows = sorted(seen.items())
    names = sorted({x for (f, _, _), _ in rows for x in f})
    at = {x: i for i, x in enumerate(names)}
    hot = np.array([[at[x] for x in f] for (f, _, _), _ in rows], np.int64).reshape(-1, 4)
    y = np.array([label for (_, label, _), _ in rows], np.int64)
    # A label of -1 (no neighbour) points to a row of zeros.
    near = np.array([m for (_, _, m), _ in rows], np.int64).reshape(-1, 6)
    there = (near >= 0)[:, :, None]
    near = np.maximum(near, 0)
    n = np.array([c for _, c in rows], float)
    n /= max(n.sum(), 1)
    w, t, skip = np.zeros((max(1, len(names)), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((2, LABELS, LABELS))
    parts = [w, t, skip]
    speed = [np.full(x.shape, 1e-10) for x in parts]
    for _ in range(steps if len(rows) else 0):
        pulls = [t[near[:, 0]], t.T[near[:, 1]], skip[0][near[:, 2]], skip[0][near[:, 3]], skip[1][near[:, 4]], skip[1][near[:, 5]]]
        z = w[hot].sum(1) + sum(x * there[:, k] for k, x in enumerate(pulls))
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= n[:, None]
        g = [np.zeros_like(x) for x in parts]
        for j in range(hot.shape[1]):
            np.add.at(g[0], hot[:, j], p)
        np.add.at(g[1], near[:, 0], p * there[:, 0])
        np.add.at(g[1].T, near[:, 1], p * there[:, 1])
        for k in range(2):
            for j in (2 + 2 * k, 3 + 2 * k):
                np.add.at(g[2][k], near[:, j], p * there[:, j])
            g[2][k] = (g[2][k] + g[2][k].T) / 2
        for x, d, v in zip(parts, g, speed):
            d += penalty * x
            v += d * d
            x -= rate * d / np.sqrt(v)
    return Field({x: w[i] for x, i in at.items()}, t, skip)


def _evidence(text: str):
    return F.col(text).rlike("[0-9@]")


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_docs: int = MAX_TRAIN) -> Field:
    picked = docs.where(_evidence(text)).select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(max_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(instances(t))
        rows = [("\t".join(f), y, ",".join(map(str, m)), c) for (f, y, m), c in seen.items()]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["f", "y", "near", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked.distinct()), "id").where(_evidence("text")).select("text")
    found = rows.mapInArrow(count, "f string, y long, near string, n long").groupBy("f", "y", "near").agg(F.sum("n").alias("n")).collect()
    return fit(Counter({(tuple(r["f"].split("\t")), r["y"], tuple(map(int, r["near"].split(",")))): r["n"] for r in found}))


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added ones, each (start, kind, end)."""
    base = base_spans(text)
    tokens, at, labels = observed(text, base)
    if not tokens:
        return base, []
    p = field.marginals(tokens, features(tokens), labels)
    best = p.argmax(1)
    ok = (labels == 0) & (best > 0) & (p[np.arange(len(best)), best] >= SURE)
    added, i = [], 0
    for i in np.flatnonzero(ok):
        text_i = tokens[i]
        if text_i.isalpha():
            continue
        a, b = at[i]
        if any(s < b and a < e for s, _, e in base):
            continue
        if added and added[-1][1] == best[i] - 1 and i and added[-1][2] == at[i - 1][1] and best[i - 1] == best[i]:
            added[-1] = (added[-1][0], added[-1][1], b)
        else:
            added.append((a, int(best[i]) - 1, b))
    return base, added


def _render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_spans, spans, n_spans) of each row; the counts by kind are those of base spans, n_spans that of all."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    counts = [f"n_{k}" for k in KINDS]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            n, base_text, full, every = np.zeros((b.num_rows, len(KINDS)), np.int64), [], [], np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column("text")):
                t = t.as_py()
                if t is None:
                    base_text.append("")
                    full.append("")
                    continue
                base, added = all_spans(t, model)
                for _, k, _ in base:
                    n[i, k] += 1
                base_text.append(_render(base))
                full.append(_render(base + added))
                every[i] = len(base) + len(added)
            yield pa.record_batch([b.column("id"), *(pa.array(n[:, j]) for j in range(len(KINDS))), pa.array(base_text, pa.string()), pa.array(full, pa.string()), pa.array(every)], ["id", *counts, "base_spans", "spans", "n_spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.when(_evidence(text), F.col(text)).alias("text"))
    return rows.mapInArrow(find, f"id {kind}, {', '.join(f'{c} long' for c in counts)}, base_spans string, spans string, n_spans long").withColumnRenamed("id", id_col)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans", "n_spans")
