"""Plain versions of the operators, over all pairs or all positions, to test against."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def jaccard_components(rows, threshold=80):
    """{doc_id: (set size, component)} over all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [(d, s) for d, s in sets if s and d is not None]
    for i, (d, s) in enumerate(live):
        for e, t in live[:i]:
            both = len(s & t)
            if 100 * both >= threshold * (len(s) + len(t) - both):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def repeats(rows, length=400):
    """[(doc_id, bytes, removed, runs, kept)] from all windows."""
    data = [(d, (t or "").encode()) for d, t in rows]
    windows = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if windows[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def base_counts(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def contained(docs, items, threshold=80):
    out = set()
    for i, text in items:
        s = shingles(text)
        for d, t in docs:
            if i is not None and d is not None and s and 100 * (n := len(s & shingles(t))) >= threshold * len(s):
                out.add((d, i, len(s), n))
    return sorted(out)


def boilerplate(rows, min_sites):
    """[(doc_id, lines, kept text)] for rows (doc_id, text, site)."""
    sites, first = defaultdict(set), {}
    for d, t, site in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            line = line.strip(" ")
            if line:
                sites[line] |= {site} - {None}
                place = (d is not None, d or 0, i)
                first[line] = min(first.get(line, place), place)
    out = []
    for d, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        keep = [x for i, x in enumerate(lines) if not ((y := x.strip(" ")) and len(sites[y]) >= min_sites and first[y] != (d is not None, d or 0, i))]
        out.append((d, len(lines), None if t is None else "\n".join(keep)))
    return out


def language_vector(text, letter_vector):
    """The bundle of a text's letter trigrams, one after the other; None without a letter."""
    seq = [0]
    for ch in text or "":
        low = ch.lower() if ord(ch) <= 0xFFFF else ch
        letter = ord(low if len(low) == 1 else ch) if ch.isalpha() else 0
        if letter or seq[-1]:
            seq.append(letter)
    seq.append(0)
    vectors = [np.roll(letter_vector(a), 2).astype(int) * np.roll(letter_vector(b), 1) * letter_vector(c) for a, b, c in zip(seq, seq[1:], seq[2:]) if b]
    return sum(vectors) if vectors else None


def languages(rows, letter_vector):
    """doc_id: (held_out, language, score) of (doc_id, text, lang) rows; learns from those that aren't held out."""
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    vectors = {d: language_vector(t, letter_vector) for d, t, _ in rows}
    sums = {}
    for d, _, lang in rows:
        if lang is not None and not held[d] and vectors[d] is not None:
            sums[lang] = sums.get(lang, 0) + vectors[d]
    out = {}
    for d, v in vectors.items():
        cosines = [(float(v @ p) / np.linalg.norm(v) / np.linalg.norm(p), lang) for lang, p in sorted(sums.items())] if v is not None else []
        score, lang = max(cosines, key=lambda x: x[0], default=(0.0, "und"))
        out[d] = (held[d], lang, max(0.0, score))
    return out
