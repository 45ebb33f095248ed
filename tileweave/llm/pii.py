"""Personal data in texts: patterns, and a skip-chain conditional random field that keeps labels consistent.

Patterns find e-mail addresses, IP numbers, card numbers and phone numbers. The field then labels every word
that holds a digit or ``@``: neighbours in the text share a chain potential, and words of a document that
repeat (as they are, or in their digits) share a skip potential however far apart. Loopy message passing
gives each word's marginal; a word that no pattern found, but that is labelled with confidence, adds a
span. So a number that one place spells in full is also found where the text repeats a part of it.

The field is trained piecewise on a bounded sample of documents, with the patterns' labels: softmax weights
for a word's shape, and association scores for the two kinds of edges.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .frames import lowest

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: documents, and characters of one (longer ones are labelled, not trained on).
TRAIN_DOCS, TRAIN_CHARS = 1500, 12_000
#: Least marginal of an added word; rounds and damping of the messages.
CONFIDENCE, ROUNDS, DAMPING = 0.9, 12, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only: from inside it a match would continue in the same way.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'.,;:!?()[]{}<>=|"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    # From one @ to the next: the address starts where its run of local characters starts, but not before the last match's end.
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' matches in order; kinds are positions in ``KINDS``."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p) <= 255 if len(p) < 20 else not p.strip("0") for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Nodes:
    """Words with a digit or ``@``: trimmed extent, ordinal among all words, label by the patterns (0: none)."""

    start: list[int]
    end: list[int]
    ordinal: np.ndarray
    label: np.ndarray
    text: list[str]


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> Nodes:
    start, end, ordinal, words = [], [], [], []
    for k, m in enumerate(_WORD.finditer(text)):
        w = m.group()
        if "@" in w or _DIGIT.search(w):
            left, right = len(w) - len(w.lstrip(_EDGE.replace("(", "") if ")" in w else _EDGE)), len(w.rstrip(_EDGE))
            left = 0 if left >= right else left
            start.append(m.start() + left)
            end.append(m.start() + max(right, left + 1))
            ordinal.append(k)
            words.append(text[start[-1] : end[-1]])
    label = np.zeros(len(start), np.int64)
    k = 0
    reach = sorted((a, b, kind + 1) for a, kind, b in base)
    for i in range(len(start)):
        while k < len(reach) and reach[k][1] <= start[i]:
            k += 1
        for a, b, kind in reach[k : k + 4]:
            if a < end[i] and start[i] < b and not label[i]:
                label[i] = kind
    return Nodes(start, end, np.array(ordinal, np.int64), label, words)


_STEPS = (1, 2, 3, 4, 6, 10, 14, 20)


def features(words: list[str]) -> np.ndarray:
    """Shape of each word: one-hot digit count and dot count, and a few marks."""
    rows = np.zeros((len(words), len(_STEPS) + 4 + 8))
    for i, w in enumerate(words):
        n = len(_DIGIT.findall(w))
        rows[i, max(sum(n >= s for s in _STEPS) - 1, 0)] = 1
        rows[i, len(_STEPS) + min(w.count("."), 3)] = 1
        rest = len(_STEPS) + 4
        rows[i, rest:] = (1, "@" in w, w[0] == "+", "-" in w, any(c.isalpha() for c in w), n == len(w), "=" in w or '"' in w, n == 0)
    return rows


def edges_of(nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring words, and of consecutive words with equal spelling or equal digits (4 at least)."""
    chain = np.flatnonzero(np.diff(nodes.ordinal) == 1)
    last, skip = {}, []
    for i, w in enumerate(nodes.text):
        digits = "".join(_DIGIT.findall(w))
        keys = {w.lower()} if len(w) >= 5 else set()
        if len(digits) >= 4 and "@" not in w:
            keys |= {"#" + digits, "#" + digits[-7:]}
        for k in sorted(keys):
            if k in last:
                skip.append((last[k], i))
            last[k] = i
    return np.stack([chain, chain + 1], 1).reshape(-1, 2), np.array(sorted(set(skip)), np.int64).reshape(-1, 2)


@dataclass
class Field:
    """Weights of the shapes (features x labels) and scores of the edges (labels x labels)."""

    weight: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Loopy sum-product over one document; words labelled by a pattern are held at their label."""
        unary = features(nodes.text) @ self.weight
        held = nodes.label > 0
        unary[held] = -30.0
        unary[held, nodes.label[held]] = 0.0
        chain, skip = edges_of(nodes)
        ends = np.concatenate([chain, skip])
        if not len(ends):
            return _softmax(unary)
        score = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        score = np.concatenate([score, score.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        messages = np.zeros((len(source), unary.shape[1]))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, messages)
            into = belief[source] - messages[back]
            new = _logsum(into[:, :, None] + score)
            new -= new.max(axis=1, keepdims=True)
            messages = DAMPING * messages + (1 - DAMPING) * new
        belief = unary.copy()
        np.add.at(belief, target, messages)
        return _softmax(belief)


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], steps: int = 300, rate: float = 0.5) -> Field:
    """Piecewise training: softmax of the shapes by gradient steps, edge scores as smoothed associations of labels."""
    n = len(KINDS) + 1
    xs, ys, chain, skip = [], [], np.full((n, n), 0.5), np.full((n, n), 0.2) + 5.0 * np.eye(n)
    for text in texts:
        nodes = nodes_of(text, base_spans(text))
        if nodes.text:
            xs.append(features(nodes.text))
            ys.append(nodes.label)
            for pairs, table in zip(edges_of(nodes), (chain, skip)):
                np.add.at(table, (nodes.label[pairs[:, 0]], nodes.label[pairs[:, 1]]), 1.0)
    width = features([]).shape[1]
    x, y = (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros((0, width)), np.zeros(0, np.int64))
    weight = np.zeros((width, n))
    for _ in range(steps if len(y) else 0):
        miss = _softmax(x @ weight)
        miss[np.arange(len(y)), y] -= 1
        weight -= rate * (x.T @ miss / len(y) + 1e-3 * weight)

    def association(table):
        joint = (table + table.T) / (table + table.T).sum()
        return np.clip(np.log(joint / np.outer(joint.sum(1), joint.sum(0))), -3, 3)

    return Field(weight, association(chain), association(skip))


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans of the words that only the field labels; neighbours with one label are one span.

    A word counts if skip edges tie it to one that a pattern found: shape alone is no evidence.
    """
    nodes = nodes_of(text, base)
    if not nodes.text or not nodes.label.any():
        return []
    tied, skip = nodes.label > 0, edges_of(nodes)[1]
    for a, b in [*skip, *skip[::-1]]:
        tied[a] = tied[b] = tied[a] or tied[b]
    if (tied == (nodes.label > 0)).all():
        return []
    sure = field.marginals(nodes)
    label = np.where(sure.max(axis=1) >= CONFIDENCE, sure.argmax(axis=1), 0)
    out = []
    for i in np.flatnonzero((label > 0) & (nodes.label == 0) & tied):
        joins = out and out[-1][3] == i - 1 and label[i - 1] == label[i] and nodes.ordinal[i] == nodes.ordinal[i - 1] + 1
        if joins:
            out[-1] = (out[-1][0], out[-1][1], nodes.end[i], i)
        else:
            out.append((nodes.start[i], int(label[i]) - 1, nodes.end[i], i))
    return [(a, kind, b) for a, kind, b, _ in out]


def spell(spans) -> str:
    """``kind:start:end`` by start, then kind, joined by commas."""
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Field:
    """Trains on the ``train_docs`` documents with a digit or ``@`` whose texts hash lowest."""
    rows = docs.where(F.length("text") <= chars).where(F.col("text").rlike("[0-9@]")).select("text")
    picked = lowest(rows, F.xxhash64("text"), train_docs).distinct().collect()
    return train(sorted(r["text"] for r in picked))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id``, counts of the patterns' spans, ``base_sha256`` of their list and ``spans`` with the field's ones.

    Every row is judged alone: repeated rows give equal results, null texts count as empty; a document in
    which no pattern matches has no spans at all.
    """
    kind = next(f.dataType for f in docs.schema if f.name == "doc_id")
    longs = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    schema = T.StructType([T.StructField("doc_id", kind), *longs, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = base + added_spans(text, base, field) if base else base
                per = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                rows.append((*per, hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans)))
            found = [pa.array([r[i] for r in rows], pa.int64() if i < len(KINDS) else pa.string()) for i in range(len(KINDS) + 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
