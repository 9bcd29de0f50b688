from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def component_of(ids, links):
    """The smallest id that each id reaches."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, n):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def near_links(texts, n, percent):
    """Links of a dict id: text, by an inverted index of shingles."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    index: dict = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    common: dict = {}
    for ids in index.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[a, b] = common.get((a, b), 0) + 1
    return sets, [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
