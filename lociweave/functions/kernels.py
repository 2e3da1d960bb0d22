"""Sequence kernels that column expressions can't state: infix edit distance, local search, pairwise alignment."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: Pairs whose edit distances are taken in one go.
PAIRS = 4096

# Which symbols match beside themselves.
DNA_EQUAL = {"N": "ACGT", "A": "N", "C": "N", "G": "N", "T": "N"}
PROTEIN_EQUAL = {"X": "ACDEFGHIKLMNPQRSTVWYBZ", "B": "DN", "Z": "EQ", "D": "B", "N": "B", "E": "Z", "Q": "Z"}
COMPLEMENT = str.maketrans("ACGTRYKMBVDHSWNacgtrykmbvdhswn", "TGCAYRMKVBHDSWNtgcayrmkvbhdswn")


def reverse_complement(s: str) -> str:
    return s[::-1].translate(COMPLEMENT)


def infix_distance(query: str, target: str, most: int, equal: dict[str, str] | None = None) -> int | None:
    """Least edits between the query and any stretch of the target (bit-parallel, one step per symbol), None beyond ``most``."""
    m = len(query)
    if not m:
        return 0
    symbols: dict[str, int] = {}
    for i, c in enumerate(query):
        for x in {c, *(equal or {}).get(c, "")}:
            symbols[x] = symbols.get(x, 0) | 1 << i
    every = (1 << m) - 1
    wild = symbols.get("X", 0) if equal is PROTEIN_EQUAL else 0
    up, down, score, best, top = every, 0, m, m, 1 << m - 1
    for c in target:
        eq = every if equal is PROTEIN_EQUAL and c == "X" else symbols.get(c, 0) | wild
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & every
        right, left = down | (every & ~(d0 | up)), d0 & up
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        best = min(best, score)
        right = (right << 1) & every
        left = (left << 1) & every
        up, down = left | (every & ~(d0 | right)), right & d0
    return best if best <= most else None


def infix_identity(a: str, b: str, dna: bool = False) -> float:
    """Identity of the shorter sequence somewhere in the longer; 0 where more than half of it differs; DNA on both strands."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    equal, most = (DNA_EQUAL if dna else PROTEIN_EQUAL), int(0.5 * len(short))
    found = [infix_distance(short, long, most, equal)]
    if dna:
        found.append(infix_distance(reverse_complement(short), long, most, equal))
    found = [x for x in found if x is not None]
    return 1 - min(found) / len(short) if found else 0.0


def _letters(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings one after the other, length of each)."""
    strings = strings.cast(pa.large_string())
    if not strings.null_count and len(strings):
        _, places, data = strings.buffers()
        ends = np.frombuffer(places, np.int64)[strings.offset : strings.offset + len(strings) + 1]
        flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
        if not (flat > 127).any():
            return flat, np.diff(ends)
    each = [x or "" for x in strings.to_pylist()]
    return np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, each), np.int64, len(each))


def _padded(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of code points per string, zeros behind it."""
    width = int(size.max(initial=0))
    if len(flat) == width * len(size):
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), flat.dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _matches(dna: bool, query: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whether each symbol of the query matches each of the target."""
    same = query[:, None] == target
    for c, others in (DNA_EQUAL if dna else PROTEIN_EQUAL).items():
        same |= (query == ord(c))[:, None] & np.isin(target, [ord(x) for x in others])
    return same if dna else same | (query == ord("X"))[:, None] | (target == ord("X"))


def _infix_distances(query: np.ndarray, m: np.ndarray, target: np.ndarray, n: np.ndarray, dna: bool) -> np.ndarray:
    """``infix_distance`` of pairs, a row each, whose queries fill equally many words of 64 bits."""
    pairs, words = len(m), (query.shape[1] + 63) // 64
    seen = lambda x: np.flatnonzero(np.bincount(x.ravel()))
    known, met = seen(query), seen(target) if target.size else np.zeros(0, np.int64)
    code = np.zeros(int(known.max()) + 1, np.int64)
    code[known] = np.arange(len(known))
    rows = code[query]
    place = np.zeros(int(met.max(initial=0)) + 1, np.int64)
    place[met] = np.arange(len(met))
    bits = np.zeros((pairs, 64 * words), bool)
    inside = np.arange(query.shape[1]) < m[:, None]
    table = np.empty((words, len(met), pairs), np.uint64)
    for i, which in enumerate(_matches(dna, known, met).T):
        bits[:, : query.shape[1]] = which[rows] & inside
        table[:, i] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T
    table = table.reshape(words, -1)
    at = place[target].T * pairs + np.arange(pairs)
    one, last = np.uint64(1), np.uint64(63)
    top = ((m - 1) % 64).astype(np.uint64)
    up, down = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64)
    score, best = m.astype(np.int64), m.astype(np.int64)
    ragged = int(n.min(initial=0)) < len(at)
    for t, spot in enumerate(at):
        carry = right_in = left_in = None
        for w in range(words):
            eq, u, d = table[w][spot], up[w], down[w]
            x = eq | d
            part = x & u
            total = part + u
            if words > 1:
                over = total < part
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            d0 = (total ^ u) | x
            right, left = d | ~(d0 | u), d0 & u
            if w == words - 1:
                score += ((right >> top) & one).astype(np.int64) - ((left >> top) & one).astype(np.int64)
            moved_right, moved_left = right << one, left << one
            if right_in is not None:
                moved_right |= right_in
                moved_left |= left_in
            if words > 1:
                right_in, left_in = right >> last, left >> last
            up[w], down[w] = moved_left | ~(d0 | moved_right), moved_right & d0
        best = np.minimum(best, np.where(n > t, score, best) if ragged else score)
    return best


def infix_identities(a: pa.Array, b: pa.Array, dna: bool = False) -> np.ndarray:
    """``infix_identity`` of each pair, many at a time: the same bit-parallel steps over arrays of pairs."""
    out = np.zeros(len(a))
    complement = np.arange(256, dtype=np.uint8)
    for x, y in COMPLEMENT.items():
        complement[x] = y
    for lo in range(0, len(a), PAIRS):
        flats, sizes = zip(*(_letters(x.slice(lo, PAIRS)) for x in (a, b)), strict=True)
        both = [_padded(f, s) for f, s in zip(flats, sizes, strict=True)]
        words = (np.minimum(*sizes) + 63) // 64
        for first, w in {(f, w) for f in (True, False) for w in np.unique(words).tolist() if w}:
            mine = np.flatnonzero((words == w) & ((sizes[0] <= sizes[1]) == first))
            if not len(mine):
                continue
            m, n = (s[mine] for s in (sizes if first else sizes[::-1]))
            query, target = (s[mine] for s in (both if first else both[::-1]))
            query, target = query[:, : int(m.max())], target[:, : int(n.max())]
            edits = _infix_distances(query, m, target, n, dna)
            if dna:
                back = np.take_along_axis(query, np.maximum(m[:, None] - 1 - np.arange(query.shape[1]), 0), 1)
                back = np.where(back < 256, complement[np.minimum(back, 255)], back)
                edits = np.minimum(edits, _infix_distances(back, m, target, n, dna))
            out[lo + mine] = np.where(edits <= (0.5 * m).astype(np.int64), 1 - edits / m, 0.0)
    return out


def infix_align(query: str, target: str, wild: str = "EN") -> tuple[int, list[tuple[int, int]]]:
    """Least edits, and (start, end) of each stretch of the target that attains them; ``wild`` letters match any base, an N of the query too."""
    q, t = np.frombuffer(query.encode(), np.uint8), np.frombuffer(target.encode(), np.uint8)
    n = len(t)
    at = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), at.copy()
    free = np.isin(t, np.frombuffer(wild.encode(), np.uint8))
    for c in q:
        cost = np.where((t == c) | free | (c == ord("N")), 0, 1)
        diag, down = row[:-1] + cost, row[1:] + 1
        step = np.concatenate([[row[0] + 1], np.minimum(diag, down)])
        from_ = np.concatenate([[begin[0]], np.where(diag <= down, begin[:-1], begin[1:])])
        low = step - at
        best = np.minimum.accumulate(low)
        source = np.maximum.accumulate(np.where(low == best, at, 0))
        row, begin = best + at, from_[source]
    least = int(row.min())
    return least, [(int(begin[e]), int(e)) for e in np.flatnonzero(row == least)]


def search_dna(window: str, query: str, prop_match: float, identity: float) -> tuple[str, tuple[int, int], int] | None:
    """Best hit of a gene in a window on either strand: (sequence on the gene's strand, (start, end) in the window, strand).

    The window is padded so that a gene may hang over its ends; an N matches any base. Of equally good places the one of
    the least signed distance of its ends from the centre counts. Where the window has a run of 20 N, the hit is also
    tried without what stands before the first and without what stands after the last, and the best of the three counts.
    """
    pad = len(query) // 2
    whole = "E" * pad + window.upper() + "E" * pad
    query = query.upper()
    best = None
    for strand, text in ((1, whole), (-1, reverse_complement(whole))):
        edits, places = infix_align(query, text)
        centre = len(text) / 2
        start, end = min(places, key=lambda p: (min(centre - p[0], centre - p[1]), p))
        for form in dict.fromkeys((text, _FIRST.sub(lambda m: "X" * len(m[0]), text, 1), _LAST.sub(lambda m: "X" * len(m[0]), text, 1))):
            stretch = form[start:end]
            masked = stretch.count("X")
            n = len(stretch) - masked - stretch.count("E")
            if not n or n / len(query) <= prop_match or sum(stretch.count(c) for c in "ACGT") / len(query) <= prop_match:
                continue
            same = 1 - (edits - masked) / n
            if same <= identity or best is not None and same * n <= best[0]:
                continue
            low, high = (start, end) if strand > 0 else (len(text) - end, len(text) - start)
            best = (same * n, re.sub("[XE]", "N", stretch).strip("N"), (max(0, low - pad), min(len(window), high - pad)), strand)
    return best[1:] if best else None


# what a run of 20 N cuts off
_FIRST, _LAST = re.compile("^[ACGTEX]*N{20}"), re.compile("N{20}[ACGTEX]*$")


def global_align(a: str, b: str, gap: int = 2, mismatch: int = 1) -> tuple[str, str]:
    """Least-cost global alignment; of equal ways a diagonal step first, then a gap in b."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), np.int64)
    cost[0] = np.arange(m + 1) * gap
    cost[:, 0] = np.arange(n + 1) * gap
    y, at = np.frombuffer(b.encode(), np.uint8), np.arange(m + 1) * gap
    for i in range(1, n + 1):
        step = np.minimum(cost[i - 1, :-1] + np.where(y == ord(a[i - 1]), 0, mismatch), cost[i - 1, 1:] + gap)
        cost[i] = np.minimum.accumulate(np.concatenate([[cost[i, 0]], step]) - at) + at
    i, j, x, z = n, m, [], []
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            x.append(a[i])
            z.append(b[j])
        elif i and cost[i, j] == cost[i - 1, j] + gap:
            i -= 1
            x.append(a[i])
            z.append("-")
        else:
            j -= 1
            x.append("-")
            z.append(b[j])
    return "".join(reversed(x)), "".join(reversed(z))


def centre_star(sequences: list[str]) -> list[str]:
    """Multiple alignment around the first of the longest sequences."""
    if not sequences:
        return []
    c = max(range(len(sequences)), key=lambda i: (len(sequences[i]), -i))
    centre, rows = sequences[c], {c: sequences[c]}
    for i, s in enumerate(sequences):
        if i == c:
            continue
        x, y = global_align(centre.replace("-", ""), s)
        merged, old, new, k = [], list(centre), list(x), 0
        adds: list[int] = []
        i1 = i2 = 0
        row = []
        while i1 < len(old) or i2 < len(new):
            if i1 < len(old) and old[i1] == "-" and not (i2 < len(new) and new[i2] == "-"):
                merged.append("-")
                row.append("-")
                i1 += 1
            elif i2 < len(new) and new[i2] == "-" and not (i1 < len(old) and old[i1] == "-"):
                merged.append("-")
                adds.append(len(merged) - 1)
                row.append(y[i2])
                i2 += 1
            else:
                merged.append(old[i1])
                row.append(y[i2])
                i1, i2 = i1 + 1, i2 + 1
        for key, r in rows.items():
            out, k = [], 0
            gaps = set(adds)
            for p in range(len(merged)):
                if p in gaps:
                    out.append("-")
                else:
                    out.append(r[k])
                    k += 1
            rows[key] = "".join(out)
        centre, rows[i] = "".join(merged), "".join(row)
        rows[c] = centre
    return [rows[i] for i in range(len(sequences))]


def codon_align(protein: str, dna: str) -> str:
    """A gapped protein's codons: three bases a letter, three gaps a gap."""
    out, k = [], 0
    for c in protein:
        out.append("---" if c == "-" else dna[k : k + 3])
        k += 0 if c == "-" else 3
    return "".join(out)
