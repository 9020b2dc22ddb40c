"""Plain Python versions of the operators, for small inputs, and the rows that tests share."""

from __future__ import annotations

import re
from collections import defaultdict

import xxhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators use inside or return; a table may have them too.
CLASHING = {"size": 1, "taken": 2, "kept": True, "y": 3, "score": 0.5, "fp": 4, "a": 5, "n": 6, "row_key": 7, "component_id": 8, "ids": "z", "h": 9}
KINDS = {int: "long", bool: "boolean", float: "double", str: "string"}


def table(spark, rows, clashing=True):
    """Documents from (doc_id, text, source) rows, with columns whose names clash."""
    more = CLASHING if clashing else {}
    schema = "doc_id long, text string, source string, lang string, n_chars long" + "".join(f", {k} {KINDS[type(v)]}" for k, v in more.items())
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), *more.values()) for i, t, s in rows], schema)


def edge_rows():
    """Nulls in any column, empty and blank texts, ties, repeated rows, very long texts."""
    long = " ".join(f"w{k % 997} v{k % 13}" for k in range(30000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "One two  three", "b"), (5, "one TWO\tthree", "b"), (6, "one", None), (6, "one", None),
        (None, "no id here at all", "c"), (None, None, None), (7, long, "a"), (8, long + " end", "a"), (9, "ünï cödé Ärger — 測試 🙂", "d"), (10, "<|endoftext|> special", "d"),
        (11, "one two three", "b"), (12, long, "b"), (13, "a\x85b c", "d"),
    ]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def removed(docs, window=13):
    """{doc_id: (words, kept words)} for distinct, non-null ids."""
    split = {i: words(t) for i, t in docs}
    least = {}
    for i, w in sorted(split.items()):
        for k in range(len(w) - window + 1):
            least.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = len(w), [x for k, x in enumerate(w) if k not in gone]
    return out


def groups(keys):
    out = defaultdict(list)
    for k, v in keys:
        out[k].append(v)
    return out
