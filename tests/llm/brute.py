"""Plain restatements of what the operators compute, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

#: Characters that are words of their own: Thai, Lao, Myanmar, Khmer, kana, Han.
ALONE = "\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u3040-\u9fff\uf900-\ufaff\U00020000-\U00033fff"
WORD = re.compile(rf"[{ALONE}]|(?:(?![{ALONE}])[0-9a-z\u0080-\U0010ffff])+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(ws: list[str], size: int = 5) -> list[tuple]:
    return [tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []


def classes(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_classes(docs: list[tuple[int, str]], threshold: float = 0.8) -> tuple[dict, dict]:
    """doc_id -> class, and every similarity over 0.3, by weighted Jaccard of TF-IDF shingles."""
    tf = {i: Counter(shingles(words(t))) for i, t in docs}
    df = Counter(s for c in tf.values() for s in c)
    n = len(docs)
    weight = {s: 1 + min(255, max(0, round(255 * math.log((n + 1) / (d + 1)) / math.log(n + 1)))) / 255 for s, d in df.items()}
    holders = defaultdict(list)
    for i, c in tf.items():
        for s in c:
            holders[s].append(i)
    total = {i: sum(k * weight[s] for s, k in c.items()) for i, c in tf.items()}
    common = Counter()
    for s, who in holders.items():
        for x in range(len(who)):
            for y in range(x):
                common[min(who[x], who[y]), max(who[x], who[y])] += weight[s] * min(tf[who[x]][s], tf[who[y]][s])
    sims = {p: c / (total[p[0]] + total[p[1]] - c) for p, c in common.items()}
    links = [p for p, s in sims.items() if s >= threshold]
    empty = sorted(i for i, c in tf.items() if not c)
    return classes(tf, links + list(zip(empty, empty[1:]))), {p: s for p, s in sims.items() if s > 0.3}


def passage_classes(docs: list[tuple[int, str]], threshold: float = 0.8, min_words: int = 20) -> set[tuple[int, int, int, int]]:
    """(doc_id, line, doc_id and line of the paragraph that stays) of repeated paragraphs."""
    sets = {}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if len(ws := words(line)) >= min_words:
                sets[i, k] = set(shingles(ws))
    holders = defaultdict(list)
    for p, s in sets.items():
        for x in s:
            holders[x].append(p)
    pairs = {(a, b) for who in holders.values() for a in who for b in who if a < b}
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    found = defaultdict(list)
    for p, c in classes(sets, links).items():
        found[c].append(p)
    return {(*p, *min(ps)) for ps in found.values() if len({d for d, _ in ps}) > 1 for p in ps}


def run_starts(docs: list[tuple[int, str]], size: int = 51) -> set[tuple[int, int]]:
    """(doc_id, number of the first word) of all runs of `size` words that another document holds."""
    ws, holders = {i: words(t) for i, t in docs}, defaultdict(set)
    for i, w in ws.items():
        for k in range(len(w) - size + 1):
            holders[tuple(w[k : k + size])].add(i)
    return {(i, k) for i, w in ws.items() for k in range(len(w) - size + 1) if len(holders[tuple(w[k : k + size])]) > 1}


def run_words(docs: list[tuple[int, str]], size: int = 51) -> set[tuple[int, int]]:
    """(doc_id, number of a word) of all words in those runs."""
    return {(i, k + j) for i, k in run_starts(docs, size) for j in range(size)}


def alike_elsewhere(docs: list[tuple[int, str]], doc_id: int, first: int, size: int, threshold: float = 0.8) -> bool:
    """Whether another document holds `size` words like those of doc_id from `first` on."""
    own = set(shingles(words(dict(docs)[doc_id])[first : first + size]))
    for i, t in docs:
        ws = words(t) if i != doc_id else []
        at = [k for k, s in enumerate(shingles(ws)) if s in own]
        for k in {max(0, a - b) for a in at for b in range(size)}:
            other = set(shingles(ws[k : k + size]))
            if len(own & other) >= threshold * len(own | other):
                return True
    return False
