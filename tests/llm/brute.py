"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def documents(spark, texts, extra=None):
    """A documents table of (doc_id, text) pairs; extra: further columns as a dict of name -> value."""
    rows = [(i, t, "en", "s", None if t is None else len(t), *(extra or {}).values()) for i, t in texts]
    kinds = {str: "string", int: "long"}
    fields = "".join(f", `{name}` {kinds[type(value)]}" for name, value in (extra or {}).items())
    return spark.createDataFrame(rows, DOCUMENT + fields)


def removed(texts, length):
    """doc_id -> (words, removed, kept words joined) for distinct doc_ids."""
    words = {d: (t or "").encode().split() for d, t in texts}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i:i + length]), d)
    out = {}
    for d, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < d:
                keep[i:i + length] = [False] * length
        out[d] = (len(w), len(w) - sum(keep), b" ".join(x for x, k in zip(w, keep) if k))
    return out


def shingles(text):
    w = (text or "").encode().translate(_LOWER).split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def components(texts, percent=80):
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets = {d: shingles(t) for d, t in texts}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}
