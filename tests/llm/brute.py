"""Plain single-machine versions of the corpus operators, to hold results against."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(UPPER)


def words(text):
    return (text or "").encode().split()


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, distance=4):
    """The smallest id that links reach from each row."""
    fps = np.array(fps, np.uint64)
    left, out = set(range(len(fps))), [None] * len(fps)
    while left:
        wave, seen = [left.pop()], []
        while wave:
            k = wave.pop()
            seen.append(k)
            near = [j for j in left if int(fps[k] ^ fps[j]).bit_count() <= distance]
            left -= set(near)
            wave += near
        known = [ids[k] for k in seen if ids[k] is not None]
        for k in seen:
            out[k] = min(known) if known else None
    return out


def substrings(rows, size=35):
    """(doc_id, n_words, n_removed, kept) of each (doc_id, text)."""
    each = [words(t) for _, t in rows]
    counts = Counter(tuple(w[s : s + size]) for w in each for s in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, each):
        gone = set()
        for s in range(len(w) - size + 1):
            if counts[tuple(w[s : s + size])] > 1:
                gone.update(range(s, s + size))
        out.append((doc, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def quality(rows, line_docs, line_share, min_words=50, keep_share=0.5):
    """As quality_rules, of (doc_id, source, text)."""
    hosts, lines = Counter(s or "" for _, s, _ in rows), defaultdict(set)
    norm = lambda x: b" ".join(x.encode().split()).decode().lower()
    for k, (_, s, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if x.encode().split():
                lines[s or "", norm(x)].add(k)
    out = []
    for doc, s, t in rows:
        t = t or ""
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        full = [x for x in t.split("\n") if x.encode().split()]
        gone = sum(len(x.encode().split()) for x in full if len(lines[s or "", norm(x)]) > max(line_docs, line_share * hosts[s or ""]))
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        kept = not failed and not (gone and (len(w) - gone < min_words or len(w) - gone < keep_share * len(w)))
        out.append((doc, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(again), failed, gone, kept))
    return out


def article(page):
    """The blocks of a page's article element, by the library's parser."""

    class Reader(HTMLParser):
        blocks, inside = [[]], False

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag == "br":
                self.blocks[-1].append(" ")
            elif tag != "b":
                self.blocks.append([])

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            if tag != "b":
                self.blocks.append([])

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1].append(data)

    reader = Reader()
    reader.blocks = [[]]
    reader.feed(page)
    reader.close()
    lines = (" ".join("".join(b).split()) for b in reader.blocks)
    return "\n".join(x for x in lines if x)


def kneser_ney(counts, order, discount, letter):
    """word -> (log-likelihood under the letter model, log ratio of the two classes), of word -> (ordinary, toxic)."""
    seen = [Counter() for _ in range(order + 1)]
    for w in counts:
        s = "\x02" * (order - 1) + w + "\x03"
        seen[order].update(s[i : i + order] for i in range(len(w) + 1))
    for n in range(order - 1, 0, -1):
        seen[n].update(g[1:] for g in seen[n + 1])

    def chance(gram):
        if not gram:
            return letter
        same = {g: n for g, n in seen[len(gram)].items() if g[:-1] == gram[:-1]}
        return (max(same.get(gram, 0) - discount, 0) + discount * len(same) * chance(gram[1:])) / sum(same.values())

    known = {g: np.log(chance(g)) for g in seen[order]}
    total = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    kinds = [sum(c[k] > 0 for c in counts.values()) for k in (0, 1)]
    out = {}
    for w, c in counts.items():
        s = "\x02" * (order - 1) + w + "\x03"
        b = sum(known[s[i : i + order]] for i in range(len(w) + 1))
        p = [max(c[k] - discount, 0) / total[k] + discount * kinds[k] / total[k] * np.exp(b) for k in (0, 1)]
        out[w] = (b, np.log(p[1] / p[0]))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
