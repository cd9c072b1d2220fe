"""Plain versions of the operators' contracts, for small inputs only."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def components(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def shingles(found: list[str]) -> set[tuple[str, ...]]:
    if not found:
        return set()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def repeats(docs: dict[int, str | None], width: int = 100) -> dict[int, tuple[list[tuple[int, int]], bytes]]:
    """Removed runs and remaining bytes of every text."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(docs):
        body = (docs[doc] or "").encode()
        covered = np.zeros(len(body) + 2, np.int64)
        for i in range(len(body) - width + 1):
            window = body[i : i + width]
            if window in seen:
                covered[i] += 1
                covered[i + width] -= 1
            seen.add(window)
        gone = np.concatenate([[False], np.cumsum(covered)[: len(body)] > 0, [False]])
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        kept = bytes(np.frombuffer(body, np.uint8)[~gone[1:-1]]) if body else b""
        out[doc] = (runs, kept)
    return out


def near(docs: dict[int, str | None], least: int = 85) -> dict[int, tuple[int, int]]:
    """Set size and component of every text."""
    sets = {d: shingles(words((t or "").translate(LOWER))) for d, t in docs.items()}
    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    common = Counter(p for ds in holders.values() for p in combinations(sorted(ds), 2))
    links = [p for p, n in common.items() if 100 * n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    comp = components(docs, links)
    return {d: (len(sets[d]), comp[d]) for d in docs}


def line_dedup(docs: dict[int, str | None], least: int = 80) -> dict[int, str | None]:
    placed = [(d, i, x) for d in sorted(docs) if docs[d] is not None for i, x in enumerate(docs[d].split("\n"))]
    sets = [shingles(words(x.translate(LOWER))) for _, _, x in placed]
    by_token: dict = {}
    gone = set()
    for j, s in enumerate(sets):
        if not s:
            continue
        shared = Counter(k for t in s for k in by_token.get(t, ()))
        if any(100 * n >= least * (len(s) + len(sets[k]) - n) for k, n in shared.items()):
            gone.add(j)
        for t in s:
            by_token.setdefault(t, []).append(j)
    kept: dict = {d: ([] if t is not None else None) for d, t in docs.items()}
    for j, (d, _, x) in enumerate(placed):
        if j not in gone:
            kept[d].append(x)
    return {d: None if x is None else "\n".join(x) for d, x in kept.items()}


MARKUP = re.compile(r"[#*$%&|<>{}\\^~_=]")
SEPARATORS = re.compile(r"[|»›•]")
PHRASES = re.compile(
    "cookie policy|accept cookies|enable javascript|javascript is disabled|sign up for our newsletter|skip to content|"
    "click here to|share on facebook|follow us on|back to top|add to cart|lorem ipsum",
    re.I | re.A,
)


def line_fails(line: str) -> bool:
    line = line.strip(SPACE)
    if not line:
        return False
    n = len(words(line))
    shouts = sum(w.endswith("!!") for w in words(line))
    separators = len(SEPARATORS.findall(line))
    return (
        len(MARKUP.findall(line)) * 10 > len(line)
        or (shouts >= 3 and shouts * 3 >= n)
        or (separators >= 2 and separators * 4 >= n)
        or (n >= 4 and line[-1] not in ".!?…:;\"'”’»)]。！？" and not re.search(r"[.,:;?!…#*`(){}=]", line))
        or (len(line) <= 200 and n <= 12 and bool(PHRASES.search(line)))
    )


def quality(text: str | None) -> dict:
    found = words(text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    repeated = {i + j for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    kept = [x for x in (text or "").split("\n") if not line_fails(x)]
    chars = sum(map(len, found))
    failed = len(found) < 20 or 100 * len(repeated) > 30 * len(found)
    lost = 100 * (chars - sum(len(w) for x in kept for w in words(x))) > 50 * chars
    return {
        "n_words": len(found),
        "word_chars": chars,
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "base_failed": failed,
        "kept": not failed and not lost,
        "cleaned": "\n".join(kept),
    }


def licence_places(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
    return len(found), sorted(places)


def licences(text: str | None, templates: dict, label_of, least: float = 0.6) -> dict[str, float]:
    """Labels whose template stands in a text, tried at every shift, with the best share of words in place."""
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    spaced = f" {' '.join(found)} "
    out: dict[str, float] = {}
    for name, (body, keys) in templates.items():
        want = body.split()
        if not any(f" {k} " in spaced for k in keys):
            continue
        for shift in range(1 - len(want), len(found)):
            share = sum(0 <= shift + j < len(found) and found[shift + j] == w for j, w in enumerate(want)) / len(want)
            if share >= least:
                out[label_of(name)] = max(out.get(label_of(name), 0.0), share)
    return out


def similar_vectors(rows: list[tuple], least: float = 0.93) -> dict[int, tuple[int, int]]:
    """Links and component of every (id, label, vector)."""
    good = {}
    for i, label, v in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, float))
    links = []
    for a, b in combinations(sorted(good), 2):
        (la, va), (lb, vb) = good[a], good[b]
        if la == lb and len(va) == len(vb) and va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= least:
            links.append((a, b))
    comp = components([r[0] for r in rows], links)
    n = Counter(x for p in links for x in p)
    return {r[0]: (n[r[0]], comp[r[0]]) for r in rows}


def unigram(docs: dict[int, str | None]) -> dict[int, tuple[bool, int, int, int, float]]:
    import math

    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    tokens = {d: [*words((t or "").translate(LOWER)), None] for d, t in docs.items()}
    counts = Counter(w for d in docs if not held[d] for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    return {
        d: (held[d], len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        for d, t in tokens.items()
    }


def mix(h: int) -> int:
    m = (1 << 64) - 1
    for _ in range(2):
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & m
    return h ^ h >> 32


def symbol_logs(text: str, model: tuple) -> list[float]:
    """log10 probability of every byte and of the end symbol, bit by bit."""
    codes, cells, parts, logs = model
    symbols = [*text.encode(), 256]
    out, space = [], None
    for i, s in enumerate(symbols):
        key = (symbols[i - 1] if i else 256) * 257 + s
        contexts = []
        for k in (2, 4, 7):
            wanted = min(max(i - space if space is not None else 7, 1), 7) if k == 7 else k
            reach = min(wanted, i)
            contexts.append(mix(int.from_bytes(bytes(symbols[i - reach : i]), "little") + (reach << 56) + (k << 60)) >> 32)
        total = 0.0
        for j in range(codes.start[key], codes.start[key] + codes.length[key]):
            own = [int(cells[k][((c + int(codes.node[j])) & 0xFFFFFFFF) >> 12]) for k, c in enumerate(contexts)]
            gate = (own[0] % 4 * 4 + own[1] % 4) * 4 + own[2] % 4
            mixed = sum(np.float32(parts[k][gate * 256 + c]) for k, c in enumerate(own))
            level = int(np.rint((min(max(mixed, np.float32(-8)), np.float32(8)) + np.float32(8)) * np.float32(8)))
            total += float(logs[(int(codes.bit[j]) * 64 + gate) * 129 + level])
        out.append(total)
        if s < 256 and s in SPACE.encode():
            space = i
    return out


def mixed_score(text: str | None, model: tuple, counts: Counter, mass: float) -> float:
    """The score of a text, word after word."""
    import math

    text = text or ""
    logs = symbol_logs(text, model)
    raw = text.encode()
    at, score, before = 0, 0.0, None
    forms: Counter = Counter()
    won, met = Counter(), Counter()
    for n, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", raw)):
        word, gap = m[0], raw[at : m.start()]
        spelled = sum(logs[at : m.end()])
        at = m.end()
        c = counts[word.decode().translate(LOWER)]
        rest = word[1:]
        capital = 65 <= word[0] <= 90
        form = (gap == b"\n", capital) if gap in (b" ", b"\n") and not any(65 <= x <= 90 for x in rest) else None
        known = math.log10(c / mass) + math.log10((forms[form] + 0.5) / (n + 2.5)) if form and c else -math.inf
        gate = 0 if before is None else sum(before >= x for x in (1, 32, 1024))
        weight = (won[gate] + 1) / (met[gate] + 2)
        high = max(spelled, known)
        score += high + math.log10(weight * 10 ** (known - high) + (1 - weight) * 10 ** (spelled - high))
        won[gate] += 1 / (1 + 10 ** min(max(spelled - known, -300), 300))
        met[gate] += 1
        forms[form] += 1
        before = c
    return score + sum(logs[at:])
