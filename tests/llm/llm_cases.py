"""Plain Python versions and odd inputs for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

CLASHING = ("n_words", "_text", "_row", "key", "sid", "label", "score", "first", "_doc", "g", "rid", "_lines")

WORD_LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [
        (1, "one two three four five six", "en"), (1, "one two three four five six", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "en"),
        (5, long, "de"), (6, long, "de"), (7, "ONE two\n\nthree é ß 😀 four\n", None), (None, "no id at all, but some words", "fr"), (None, None, None),
        (8, "x" * 50000, "en"), (9, "a\nb\na\nb\n", "en"),
    ]
    extra = tuple(range(len(CLASHING)))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHING)
    return spark.createDataFrame([(*r, "s", 0, *extra) for r in rows], schema), len(rows)


def no_docs(spark):
    return odd_docs(spark)[0].where("false")


def base_counts(text):
    t = text or ""
    words = WORD_SPACE.findall(t)
    lines = [x for x in t.split("\n") if WORD_SPACE.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, inside = {}, set()
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                inside |= {i, i + 1, i + 2}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), len(lines),
        sum(c.isupper() and c.lower() != c for c in t),
    )


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def dedup(docs: list[tuple], least: int) -> list:
    """Cleaned texts of (id, text) rows with unique ids in ascending order."""
    space = " \t\n\x0b\x0c\r"
    first = {}
    for d, t in docs:
        for n, x in enumerate(t.split("\n") if t is not None else []):
            if x.strip(space):
                first.setdefault(x.strip(space), (d, n))
    known = list(first)
    near = {x for x in known if len(x) >= least and any(len(y) >= least and first[y] < first[x] and within_one_edit(x, y) for y in known if y != x)}
    out = []
    for d, t in docs:
        if t is None:
            out.append(None)
            continue
        keep = [x for n, x in enumerate(t.split("\n")) if not (s := x.strip(space)) or (s not in near and first[s] == (d, n))]
        out.append("\n".join(keep))
    return out


def shingles(text, size):
    words = WORD_SPACE.findall(ascii_lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def groups(docs: list[tuple], size: int, percent: int) -> dict:
    """Component (smallest id) of each id."""
    sets = {d: shingles(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def hits(text, items, window=10):
    """Words, hit words and the items with a window in the text."""
    words = WORD_LOW.findall(ascii_lower(text or ""))
    hit, found = set(), set()
    for name, t in items:
        w = WORD_LOW.findall(ascii_lower(t or ""))
        k = min(window, len(w))
        wanted = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in wanted:
                hit |= set(range(i, i + k))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


def changed(rnd: random.Random, x: str) -> str:
    b = list(x)
    kind, p = rnd.random(), rnd.randrange(len(b))
    if kind < 0.4:
        b[p] = rnd.choice("abcdefgh")
    elif kind < 0.7:
        b.insert(p, rnd.choice("abcdefgh"))
    else:
        del b[p]
    return "".join(b)
