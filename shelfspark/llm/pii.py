"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans of four kinds. A conditional random field then labels the suspicious
tokens of each document (runs of non-space characters with a digit or ``@``) and may add spans.
Its graph has chain edges between neighbouring suspicious tokens and skip edges from each token to
the last one before it that is the same (letters and digits alone) or similar (same digits, same
mail user, or same mail domain), however far away. Tokens in base spans are fixed to their kind;
loopy sum-product messages carry that along the edges, so that repeats get consistent labels.
Every token has at most three edges backwards, so work is linear in the text.

The field's weights maximise the pseudo-likelihood on a bounded sample (``sample_rows`` documents
that hold a suspicious token, those of least hash), labelled by the base spans; half of what it
counts are tokens with hidden shapes, which earn the skip edges their weights. Every whole text
is searched; most text is never a node.

Defined cases: null text counts as empty and has no spans; spans of different kinds may overlap,
added ones never overlap spans of their kind; repeated rows are searched each; without any sample
nothing is added; other columns are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SUSPECT = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_SOME = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The pattern matches that pass their checks, by start, then kind."""
    if not _SOME.search(text):
        return []
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        # the leftmost start for this @: its run of local characters, not before the last match
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- the graph of one document

FEATURES = 24
CHAIN, SAME, SIMILAR = 0, 1, 2
MILD = 1.0  # agreement of same and similar tokens where a sample says nothing of it


def _features(token: str, before: str) -> list[float]:
    digits = sum(c in "0123456789" for c in token)
    letters = any(c.isalpha() for c in token)
    dots, dashes, at = token.count("."), token.count("-"), token.count("@")
    return [
        1.0, at == 1, at > 1, token[:1] == "+", "+" in token[1:], digits == 0, 0 < digits <= 3, 4 <= digits <= 7, 8 <= digits <= 9, 10 <= digits <= 13, 14 <= digits <= 19, digits > 19,
        dots == 1, dots == 2, dots == 3, dots > 3, dashes == 1, dashes > 1, "(" in token or ")" in token, letters, not letters and digits > 0, at == 1 and "." in token.partition("@")[2], before[-1:] == ":", digits in (14, 15, 16) and luhn(re.sub("[^0-9]", "", token)),
    ]


class Graph:
    """Suspicious tokens of many documents as one graph of separate parts."""

    def __init__(self) -> None:
        self.x: list[list[float]] = []
        self.fixed: list[int] = []
        self.edges: list[tuple[int, int, int]] = []
        self.tokens: list[tuple[int, int, int]] = []  # document, start, end

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        seen: dict[tuple, int] = {}
        last_end = -1
        ahead = [[s for s in base if s[1] == k] for k in range(len(KINDS))]  # a kind's spans never overlap
        at = [0] * len(KINDS)
        for m in _SUSPECT.finditer(text):
            start, end = m.span()
            while end > start + 1 and text[end - 1] in ".,;:!?\"'":
                end -= 1
            token, i = text[start:end], len(self.x)
            for k, spans in enumerate(ahead):
                while at[k] < len(spans) and spans[at[k]][2] <= start:
                    at[k] += 1
            over = [spans[n] for spans, n in zip(ahead, at) if n < len(spans) and spans[n][0] < end]
            label = min(over)[1] + 1 if over else 0
            self.x.append(_features(token, text[max(0, start - 2) : start].rstrip()))
            self.fixed.append(label)
            self.tokens.append((doc, start, end))
            if last_end >= 0 and not text[last_end:start].strip(" \t.,;:"):
                self.edges.append((i - 1, i, CHAIN))
            last_end = end
            plain = re.sub("[^0-9a-z@]", "", token.lower())
            user, _, domain = token.lower().partition("@")
            digits = re.sub("[^0-9]", "", token)
            keys = [(SAME, plain)]
            if domain:
                keys += [(SIMILAR, "u" + user)] if len(user) > 2 else []
                keys += [(SIMILAR, "d" + domain)] if len(domain) > 3 else []
            elif len(digits) >= 7:
                keys.append((SIMILAR, "n" + digits))
            linked: set[int] = set()
            for key in keys:
                j = seen.get(key)
                if j is not None and j not in linked:
                    self.edges.append((j, i, key[0]))
                    linked.add(j)
                seen[key] = i

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges = np.array(self.edges, np.int64).reshape(-1, 3)
        return np.array(self.x, float).reshape(-1, FEATURES), np.array(self.fixed, np.int64), edges


class Field:
    """Weights of the field: unary, chain table, and agreement on same and similar tokens."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, agree: np.ndarray):
        self.unary, self.chain, self.agree = unary, chain, agree

    def tables(self) -> np.ndarray:
        eye = np.eye(len(KINDS) + 1)
        return np.stack([self.chain, self.agree[0] * eye, self.agree[1] * eye])

    @classmethod
    def fit(cls, graph: Graph, steps: int = 250, rate: float = 0.05, decay: float = 2e-3) -> Field:
        """Maximise the pseudo-likelihood of the base labels. A token outside the base spans that
        repeats one inside them is neither labelled nor counted: whether it is personal data is
        what the field has to tell. Tokens with skip edges are counted a second time with their
        shape hidden (all features but the constant), so that the edges have to tell their labels
        and the agreement of same and of similar tokens is learned from the data."""
        x, y, edges = graph.arrays()
        n, k = len(x), len(KINDS) + 1
        tied = edges[edges[:, 2] != CHAIN]
        touched = np.zeros(n, bool)
        touched[tied[y[tied[:, 1]] > 0, 0]] = True
        touched[tied[y[tied[:, 0]] > 0, 1]] = True
        unclear = (y == 0) & touched
        around = cls._around(graph, np.eye(k)[y] * ~unclear[:, None])
        hide = np.flatnonzero((around[1:].sum((0, 2)) > 0) & ~unclear)
        hidden = np.zeros((len(hide), FEATURES))
        hidden[:, 0] = 1
        clear = np.flatnonzero(~unclear)
        x, one = np.concatenate([x[clear], hidden]), np.eye(k)[np.concatenate([y[clear], y[hide]])]
        around = np.concatenate([around[:, clear], around[:, hide]], 1)
        counts = np.full(len(x), 1 / max(1, len(x)))
        w, c, a = np.zeros((FEATURES, k)), np.zeros((k, k)), np.full(2, MILD)
        state = [np.zeros_like(p) for p in (w, c, a, w, c, a)]
        for t in range(1, steps + 1):
            _, grads = cls.loss(x, one, around, counts, w, c, a, decay)
            for i, (param, g) in enumerate(zip((w, c, a), grads)):
                state[i] = 0.9 * state[i] + 0.1 * g
                state[i + 3] = 0.999 * state[i + 3] + 0.001 * g * g
                param -= rate * (state[i] / (1 - 0.9**t)) / (np.sqrt(state[i + 3] / (1 - 0.999**t)) + 1e-8)
        return cls(w, c, np.maximum(a, 0))

    @staticmethod
    def _around(graph: Graph, seen: np.ndarray) -> np.ndarray:
        """Per edge kind, the sums of the neighbours' rows of ``seen``."""
        _, _, edges = graph.arrays()
        out = np.zeros((3, *seen.shape))
        for t in range(3):
            e = edges[edges[:, 2] == t]
            np.add.at(out[t], e[:, 0], seen[e[:, 1]])
            np.add.at(out[t], e[:, 1], seen[e[:, 0]])
        return out

    @staticmethod
    def loss(x: np.ndarray, one: np.ndarray, around: np.ndarray, counts: np.ndarray, w: np.ndarray, c: np.ndarray, a: np.ndarray, decay: float) -> tuple[float, list[np.ndarray]]:
        """The penalised negative log pseudo-likelihood, and its gradient in w, symmetric c and a."""
        logits = x @ w + around[0] @ c + a[0] * around[1] + a[1] * around[2]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        total = p.sum(1, keepdims=True)
        value = -(counts * ((logits - np.log(total)) * one).sum(1)).sum() + decay / 2 * ((w * w).sum() + (c * c).sum() + ((a - MILD) ** 2).sum())
        d = (p / total - one) * counts[:, None]
        g_c = around[0].T @ d
        return float(value), [x.T @ d + decay * w, (g_c + g_c.T) / 2 + decay * c, np.array([(around[s] * d).sum() for s in (1, 2)]) + decay * (a - MILD)]

    def marginals(self, graph: Graph, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Label probabilities of every token by loopy sum-product messages."""
        x, fixed, edges = graph.arrays()
        k = len(KINDS) + 1
        unary = x @ self.unary
        unary[fixed > 0] = -20.0
        unary[np.flatnonzero(fixed > 0), fixed[fixed > 0]] = 20.0
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.exp(self.tables())[np.concatenate([edges[:, 2], edges[:, 2]])]
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), k))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, target, message)
            cavity = belief[source] - message[back]
            cavity = np.exp(cavity - cavity.max(1, keepdims=True))
            new = np.log(np.einsum("ek,ekl->el", cavity, table) + 1e-30)
            new -= new.max(1, keepdims=True)
            done = np.abs(new - message).max() < 1e-4 if len(new) else True
            message = damping * message + (1 - damping) * new
            if done:
                break
        belief = unary
        np.add.at(belief, target, message)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)


def added_spans(graph: Graph, field: Field, texts: list[str], base: list[list[Span]], sure: float = 0.5) -> list[list[Span]]:
    """Spans that the field adds: joined neighbours of one kind outside the base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    if not graph.x:
        return out
    p = field.marginals(graph)
    label = p.argmax(1)
    chained = {b for _, b, t in graph.edges if t == CHAIN}
    for i, (doc, start, end) in enumerate(graph.tokens):
        kind = int(label[i]) - 1
        if kind < 0 or graph.fixed[i] or p[i, label[i]] < sure:
            continue
        while start < end and text_edge(texts[doc][start]):
            start += 1
        if any(s[1] == kind and s[0] < end and s[2] > start for s in base[doc]) or start >= end:
            continue
        mine = out[doc]
        if i in chained and mine and mine[-1][1] == kind and graph.tokens[i - 1][2] == mine[-1][2]:
            mine[-1] = (mine[-1][0], kind, end)
        else:
            mine.append((start, kind, end))
    return out


def text_edge(c: str) -> bool:
    return c in "\"'(<[{"


# ---------------------------------------------------------------- the job

def train(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> Field | None:
    """Fit on the documents of least hash that hold a digit or an @; their ids are chosen first."""
    ids = docs.filter(F.col(text).rlike("[0-9@]")).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(19), "doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", text).join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_only_tokens(text), "doc_id long, text string")
    rows = rows.orderBy(F.xxhash64(F.lit(19), "doc_id", "text"), "doc_id", "text").limit(sample_rows).toArrow()  # an id may repeat
    graph = Graph()
    pairs = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()), key=lambda r: (r[0] is None, r))
    for n, (_, body) in enumerate(pairs):
        graph.add(n, body, base_spans(body))
    return Field.fit(graph) if graph.x else None


def _only_tokens(text: str):
    """Keep the parts of a text around suspicious tokens: what the fit needs, far less than whole
    texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for body in batch.column(1).to_pylist():
                parts, end = [], 0
                for m in _SUSPECT.finditer(body or ""):
                    parts.append((" \n " if m.start() > end + 40 else body[end : m.start()]) + m[0])
                    end = m.end()
                kept.append("".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return run


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: array of (kind, start, end, base), by start, then kind;
    places in code points, the end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(begin, end - begin).to_pylist()]
                base = [base_spans(t) for t in texts]
                graph = Graph()
                if field is not None:
                    for n, t in enumerate(texts):
                        if _SOME.search(t):
                            graph.add(n, t, base[n])
                more = added_spans(graph, field, texts, base)
                spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted([(*x, True) for x in b_] + [(*x, False) for x in m_])] for b_, m_ in zip(base, more)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def detect(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    return find(docs, train(docs, text, sample_rows), text)


def _is(kind: str):
    return lambda x: x == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
