"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
import zlib

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def base_spans(text):
    text, out = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for no, (kind, pattern, flags) in enumerate((("assign", assign, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0), ("hex", r"[0-9a-f]+", 0))):
        for m in re.finditer(pattern, text, flags):
            size = len(m[2]) if no == 0 else len(m[0])
            if size >= (6, 20, 24)[no]:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def exact(rows):
    groups = {}
    for i, text in rows:
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), i))
    out = {}
    for norm, group in groups.items():
        keep = min(group)[1]
        for _, i in group:
            out[i] = (keep, len(group), i == keep, sha(norm))
    return out


def lines(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(WS).translate(LOWER)
    held = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(k, set()).add(i)
    out = {}
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(k := key(x)) >= min_chars and len(held[k]) >= min_docs and i != max(held[k]))]
        out[i] = (len(own), len(own) - len(kept), sha("\n".join(kept)))
    return out


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, n, t100):
    """doc -> (set size, smallest linked id); links by 100 * intersection >= t100 * union."""
    sets = {i: shingles(x, n) for i, x in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t100 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def targets(sizes, weights=(5, 2, 1), limit=3):
    """Source -> target, by reserving caps again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * share > limit * sizes[s]]
        if not over:
            return fixed | {s: w[s] * share for s in rest}
        fixed |= {s: limit * sizes[s] for s in over}
