"""Plain versions of the operators' contracts, for small tables."""

import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {i + j for i, window in enumerate(windows) if counts[window] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(char in "#*$%&|<>" for char in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def shingles(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(rows, size=4, percent=85):
    """{position: set of positions} of (key, text) rows, by comparing all pairs."""
    sets = [shingles(text, size) for _, text in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    members = {}
    for i, g in enumerate(group):
        members.setdefault(g, set()).add(i)
    return {i: members[g] for i, g in enumerate(group)}, [len(s) for s in sets]


def jump(key, shards):
    """Lamping and Veach's jump hash of an unsigned key."""
    key %= 1 << 64
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def remainder(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


def targets(sizes, weights, share=1.5, most=2.0):
    """Sizes by source to targets; a share at most twice its size, the excess shared again until none is above."""
    left, open_, found = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not full:
            for i in open_:
                found[i] = left * weights[i] / total
            break
        for i in full:
            found[i] = most * sizes[i]
        left -= sum(found[i] for i in full)
        open_ -= full
    return found
