"""Each contract in plain Python over whole lists of rows: slow, and independent of the library."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower(text: str | None) -> str:
    return (text or "").translate(A_TO_Z)


def luhn(digits: str) -> bool:
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def pii(rows: list[tuple]) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        spans = base_spans(text)
        listed = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans)
        out.append((doc_id, *(sum(s[1] == k for s in spans) for k in range(4)), sha(listed)))
    return out


def tokens(text: str | None) -> list[str]:
    return [*WORD.findall(lower(text)), ""]


def scores(rows: list[tuple], strength: float, order: int) -> list[tuple]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of a hierarchical Dirichlet model."""

    def held(doc_id: int | None) -> bool:
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0

    count: Counter = Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            seq = ["<s>"] * (order - 1) + tokens(text)
            for n in range(1, order):
                count[("<s>",) * n] += 1
            for i in range(order - 1, len(seq)):
                for n in range(1, order + 1):
                    gram = tuple(seq[i - n + 1 : i + 1])
                    if gram != ("<s>",) * n:
                        count[gram] += 1
    single = {g[0]: c for g, c in count.items() if len(g) == 1 and g != ("<s>",)}
    total, size = sum(single.values()), len(single)

    def p(gram: tuple) -> float:
        if len(gram) == 1:
            return (single.get(gram[0], 0) + 0.1) / (total + 0.1 * (size + 1))
        return (count[gram] + strength * p(gram[1:])) / (count[gram[:-1]] + strength)

    out = []
    for doc_id, text in rows:
        own = tokens(text)
        seq = ["<s>"] * (order - 1) + own
        full = sum(math.log10(p(tuple(seq[i : i + order]))) for i in range(len(own)))
        base = sum(math.log10(p((t,))) for t in own)
        out.append((doc_id, held(doc_id), len(own), sum(single.get(t, 0) > 0 for t in own), total, base, full))
    return out


def shingles(text: str | None, size: int = 5) -> set[tuple]:
    words = WORD.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_components(rows: list[tuple], size: int = 5) -> list[tuple]:
    sets = [frozenset(shingles(t, size)) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for token in s:
            holders[token].append(i)
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common: Counter = Counter()
        for token in s:
            common.update(j for j in holders[token] if j > i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[top(i)] = top(j)
    low: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[top(i)] = min(low.get(top(i), doc_id), doc_id)
    return [(doc_id, len(s), low.get(top(i)) if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def quality(rows: list[tuple]) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        seen: set[str] = set()
        repeated_lines = 0
        for line in text.split("\n"):
            if WORD.search(line):
                repeated_lines += line in seen
                seen.add(line)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(grams)
        hit = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        out.append((doc_id, len(words), sum(map(len, words)), symbols, repeated_lines, len(hit), failed))
    return out


def contamination(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    windows = defaultdict(set)
    for item_id, text in items:
        words = TERM.findall(lower(text))
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i : i + size])].add("" if item_id is None else str(item_id))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        words = TERM.findall(lower(text))
        hit, names = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                found = windows.get(tuple(words[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    names |= found
        out.append((doc_id, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def repeats(rows: list[tuple], depth: int = 200) -> list[tuple]:
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if count[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def archive(rows: list[tuple]) -> list[tuple]:
    """page_id, bytes, digest, type, refers_to from (page_id, url, html)."""
    first: dict[bytes, int] = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(first.get(data, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        known = first.get(data)
        revisit = known is not None and page_id != known
        out.append((page_id, len(data), sha(data), "revisit" if revisit else "response", known if revisit else None))
    return out


def kept_passages(rows: list[tuple], window: int = 50) -> list[tuple]:
    """doc_id, n_words, n_removed, kept_sha256, longest: a null id comes after all others."""
    order = [math.inf if doc_id is None else doc_id for doc_id, _ in rows]
    words = [WORD.findall(text or "") for _, text in rows]
    longest, gone = [0] * len(rows), [set() for _ in rows]
    size = window
    while any(len(own) >= size for own in words):
        low: dict[tuple, float] = {}
        for at, own in zip(order, words):
            for i in range(len(own) - size + 1):
                key = tuple(own[i : i + size])
                low[key] = min(low.get(key, math.inf), at)
        for k, (at, own) in enumerate(zip(order, words)):
            for i in range(len(own) - size + 1):
                if low[tuple(own[i : i + size])] < at:
                    longest[k] = size
                    if size == window:
                        gone[k].update(range(i, i + size))
        size *= 2
    return [
        (doc_id, len(own), len(out), sha(" ".join(w for i, w in enumerate(own) if i not in out)), far)
        for (doc_id, _), own, out, far in zip(rows, words, gone, longest)
    ]


def clusters(rows: list[tuple], k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> list[tuple]:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, in Python integers."""
    kept = [
        (i, [math.floor(scale * float(c)) for c in v])
        for i, v in rows
        if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)
    ]
    centroids = [x for _, x in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def assign() -> list[tuple[int, int]]:
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        placed = assign()
        for n in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, placed) if c == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    placed = assign()
    per = Counter()
    for d, c in placed:
        per[c] += d
    digests = [sha(",".join(map(str, c))) for c in centroids]
    return [(i, c, d, per[c], sum(per.values()), digests[c]) for (i, _), (d, c) in zip(kept, placed)]
