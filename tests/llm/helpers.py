"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, start=0):
    """A documents table of texts (or of (doc_id, text))."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 2}", len(t or "")) for i, t in rows], DOCS)


def clashing(docs):
    """The table with more columns, named like the operators' own."""
    out = docs
    for name in ("words", "later", "lines", "kept_lines", "doc_key", "text_sign", "node", "label", "passed_doc_id", "copied_doc_id", "h1", "pos", "score", "n", "grp", "kept"):
        out = out.selectExpr("*", f"'{name}' as {name}")
    return out


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, k):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def classes(texts, k, num, den):
    """{doc_id: (set size, smallest linked id)} over all pairs."""
    sets, parent = {i: shingle_set(t, k) for i, t in texts}, {i: i for i, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w, seen, repeated = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def dedup_lines(texts, span=3):
    """{doc_id: text} after removal of later windows, in order of id."""
    first, out = {}, {}
    for i, text in sorted(texts):
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - span + 1):
            window = tuple(lines[p : p + span])
            if "".join(window).strip(" ") and first.setdefault(window, (i, p)) != (i, p):
                gone |= set(range(p, p + span))
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out
