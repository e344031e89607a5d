"""Plain versions of the operators, one document at a time, for tests."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def simhash(text: str | None, width: int = 4) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], bits: int = 4) -> dict[int, int]:
    """doc -> smallest doc reachable over fingerprints that differ in `bits` at most."""
    first: dict[int, int] = {}
    for doc, fp in sorted(prints.items()):
        first.setdefault(fp, doc)
    parent = {d: d for d in first.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    each = list(first.items())
    for i, (a, da) in enumerate(each):
        for b, db in each[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(da), find(db)
                parent[max(x, y)] = min(x, y)
    return {doc: find(first[fp]) for doc, fp in prints.items()}


def shingle_sets(texts: dict[int, str | None], width: int = 5) -> dict[int, frozenset]:
    out = {}
    for doc, text in texts.items():
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out[doc] = frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()
    return out


def near_copies(texts: dict[int, str | None]) -> dict[int, int]:
    """doc -> smallest doc reachable over pairs of a Jaccard similarity of 0.8 at least."""
    sets = shingle_sets(texts)
    own = {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if own[a] != own[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((own[a], own[b]))
                own = {d: low if c == high else c for d, c in own.items()}
    return own


def pieces(ids: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc)."""
    cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
    out = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        out.append((k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))))
    return out


def repeated_bytes(texts: list[tuple[int, str | None]], width: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """doc -> n_bytes, n_removed, n_spans, sha256 of what is left."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(texts, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            window = data[i : i + width]
            if window in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(window)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        left = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out
