"""Plain versions of the operators, for small inputs."""

from itertools import combinations

import xxhash


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """doc -> smallest doc linked to it, from (doc, fingerprint) pairs."""
    label = {d: d for d, _ in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for (d, f), (e, g) in combinations(fps, 2):
        if (f ^ g).bit_count() <= 3:
            u, v = sorted((root(d), root(e)))
            label[v] = u
    return {d: root(d) for d, _ in fps}


def near_duplicate_roots(texts):
    return set(classes([(d, fingerprint(t)) for d, t in texts.items()]).values())


def without_copied_lines(texts, min_words):
    """Delete every line in a run of at least ``min_words`` words that occurred before."""
    lines = {d: t.split("\n") for d, t in sorted(texts.items())}
    words = {d: [len(x.split()) for x in own] for d, own in lines.items()}
    starts = {}                                         # line -> places, in order
    dead = {d: set() for d in lines}
    for d, own in lines.items():
        for i in range(len(own)):
            best = 0
            for e, j in starts.get(own[i], ()):
                n = 0
                while i + n < len(own) and j + n < len(lines[e]) and own[i + n] == lines[e][j + n]:
                    n += 1
                best = max(best, n)
            if sum(words[d][i:i + best]) >= min_words:
                dead[d].update(range(i, i + best))
            starts.setdefault(own[i], []).append((d, i))
    return {d: "\n".join(x for i, x in enumerate(own) if i not in dead[d]) for d, own in lines.items()}
