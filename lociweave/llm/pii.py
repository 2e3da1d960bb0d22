"""Personal data in texts: fixed patterns, and a skip-chain conditional random field over everything that looks like it.

The nodes of a document's field are its mentions: the patterns' spans, whose labels are fixed, and other numbers and
addresses. Neighbours are linked in a chain; a mention is also linked to the last one before it that is equal or
similar (the same digits or the same last ones, the same user or host), and to one such mention of each label that
the patterns fixed, before or after it, however far. Loopy message passing until nothing changes gives each mention
its label probabilities, so that a number written in full once labels its short forms elsewhere, however many they
are. Weights are learned by pseudo-likelihood on documents from a seeded generator, some of them with many repeats.
Mentions have any length, and no number of rounds, mentions or repeats ends anything.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepared, table, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
# fixed patterns; the possessive marks only spare attempts that can't succeed
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Other mentions: addresses, numbers in groups, other numbers.
_SPACE = re.compile(r"[\s@]")
NUMBER = re.compile(r"(?:\+?[0-9]{1,3}[ -]?)?\([0-9]{2,4}\)[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9])|[0-9]{4}(?: [0-9]{4}){3}(?![0-9])|\+?[0-9](?:[().+/-]{0,2}[0-9])*+")
#: The least probability of an added span: of unseen generated documents that finds 99 percent, and under 0.5 percent of the other mentions.
LEAST = 0.7
#: Message passing ends when no message changes by more; its damping grows each so many rounds, as messages in loops may swing, so that it always ends.
TOLERANCE, DAMPING, CALM = 1e-4, 0.3, 200
BUCKETS = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost address at each @: all of the run of user characters before it that no earlier address holds."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by kind, then start; a failing match is dropped and not tried again."""
    out = [(s, e, "email") for s, e in emails(text)]
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Runs without white space on both sides of an @ that has some before it; the next begins after the last."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not (text[start - 1].isspace() or text[start - 1] == "@"):
            start -= 1
        if start < at:
            m = _SPACE.search(text, at + 1)
            end = m.start() if m else len(text)
            yield start, end
        at = text.find("@", max(end, at + 1))


@dataclass
class Mention:
    start: int
    end: int
    text: str
    label: int  # -1: to be found


def mentions(text: str, base: list[tuple[int, int, str]]) -> list[Mention]:
    """Nodes in order: the base spans, and other mentions clear of them."""
    taken = [(s, e) for s, e, _ in base]
    out = [Mention(s, e, text[s:e], LABELS.index(k)) for s, e, k in base]
    for spans in (addresses(text), (m.span() for m in NUMBER.finditer(text))):
        held = sorted(taken)
        i = reach = 0
        for s, e in spans:
            while i < len(held) and held[i][0] < e:
                reach = max(reach, held[i][1])
                i += 1
            if reach <= s:
                taken.append((s, e))
                out.append(Mention(s, e, text[s:e], -1))
    return sorted(out, key=lambda x: (x.start, x.end, x.label))


def features(m: Mention, before: str, after: str) -> np.ndarray:
    """What one mention shows of itself and its surroundings."""
    t = m.text
    digits = "".join(c for c in t if "0" <= c <= "9")
    n = len(digits)
    parts = t.split(".")
    word = re.findall(r"[^\W\d_]+", before.lower())
    f = np.zeros(24 + BUCKETS)
    f[0] = 1
    f[1 + min(7, sum(n >= k for k in (1, 4, 7, 9, 11, 13, 16)))] = 1
    f[9:24] = [
        "@" in t, "@" in t and "." in t.partition("@")[2].strip("."), t.startswith("+"), "(" in t, "-" in t, " " in t, len(parts) == 4 and all(p.isdigit() for p in parts),
        len(parts) == 2, 12 < n and luhn(digits), all(p.isdigit() and len(p) <= 3 for p in parts), before[-1:].isalpha(), after[:1].isalpha(), "/" in t, after[:1] == "%", n == 4 and digits[:2] in ("19", "20"),
    ]
    f[24 + (int(hashlib.md5(word[-1].encode()).hexdigest()[:8], 16) % BUCKETS if word else 0)] = 1
    return f


def keys(m: Mention) -> list[str]:
    """Mentions that share one of these are equal or similar."""
    if "@" in m.text:
        user, _, host = m.text.lower().strip(".,;:()<>").partition("@")
        return [f"u{user}", f"h{host}"] if host else [f"u{user}"]
    d = "".join(c for c in m.text if "0" <= c <= "9")
    return [f"d{d}", *([f"l{d[-7:]}"] if len(d) >= 7 else [])] if len(d) >= 4 else []


def edges(nodes: list[Mention]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, kind): 0 for the chain, 1 for skips to the last equal or similar mention and to the first of each fixed label."""
    out = [(i - 1, i, 0) for i in range(1, len(nodes))]
    held = [keys(m) for m in nodes]
    fixed: dict[str, dict[int, int]] = {}
    for i, m in enumerate(nodes):
        for k in held[i] if m.label >= 0 else ():
            fixed.setdefault(k, {}).setdefault(m.label, i)
    last: dict[str, int] = {}
    seen = set()
    for i, m in enumerate(nodes):
        for k in held[i]:
            for j in (last.get(k, i), *(fixed.get(k, {}).values() if m.label < 0 else ())):
                if j != i and (min(i, j), max(i, j)) not in seen:
                    seen.add((min(i, j), max(i, j)))
                    out.append((j, i, 1))
            last[k] = i
    a = np.array(out, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


@dataclass
class Field:
    """Weights of features by label, and of label pairs along both kinds of edges."""

    node: np.ndarray
    pair: np.ndarray

    def marginals(self, nodes: list[Mention], f: np.ndarray) -> np.ndarray:
        """Label probabilities of a document's mentions by loopy message passing; fixed labels stay."""
        own = f @ self.node.T
        for i, m in enumerate(nodes):
            if m.label >= 0:
                own[i] = -50.0
                own[i, m.label] = 0.0
        a, b, kind = edges(nodes)
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pair = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        say = np.zeros((len(src), len(LABELS)))
        damping = DAMPING
        for t in itertools.count(1) if len(src) else ():
            heard = own.copy()
            np.add.at(heard, dst, say)
            x = (heard[src] - say[back])[:, :, None] + pair
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            far = np.abs(new - say).max()
            say = damping * say + (1 - damping) * new
            if far < TOLERANCE:
                break
            if t % CALM == 0:
                damping = (1 + damping) / 2
        heard = own.copy()
        np.add.at(heard, dst, say)
        p = np.exp(heard - heard.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def generated(n: int, seed: int) -> list[tuple[list[Mention], np.ndarray, np.ndarray]]:
    """Documents with mentions, features and true labels: full forms, their short forms elsewhere, and other numbers."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choices("0123456789", k=k))
    syllable = lambda: r.choice(["an", "the", "re", "on", "ti", "er", "lich", "ver", "que", "ment", "os", "in", "al", "es", "st"])
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 3)))

    def card() -> str:
        while True:
            x = d(16)
            if luhn(x):
                return x

    def entity() -> tuple[str, str, list[str]]:
        kind = r.choice(KINDS)
        if kind == "email":
            u, h = f"{word()}.{r.randint(1, 99)}", f"mail{r.randint(1, 9)}.example"
            return kind, f"{u}@{h}.com", [f"{u}@{h.split('.')[0]}", f"{u}@"]
        if kind == "ip":
            x = ".".join(str(r.randint(0, 255)) for _ in range(4))
            return kind, x, [x.replace(".", "-"), f"{x}/24"]
        if kind == "card":
            x = card()
            return kind, x, [f"{x[:4]}.{x[4:8]}.{x[8:12]}.{x[12:]}", f"{x[:4]}/{x[4:8]}/{x[8:12]}/{x[12:]}"]
        a, b, c = d(3), "555", d(4)
        return kind, f"+1 ({a}) {b}-{c}", [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"{b}-{c}"]

    def other() -> str:
        return r.choice([
            lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: str(r.randint(1, 99)), lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            lambda: f"{r.randint(1, 999)}.{d(2)}", lambda: d(r.randint(5, 8)), lambda: f"{d(3)}-{d(3)}", lambda: d(16), lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{word()}@", lambda: f"{r.randint(300, 999)}.{d(3)}.{d(2)}.{d(2)}", lambda: d(r.randint(9, 14)),
        ])()

    out = []
    while len(out) < n:
        items: list[tuple[str, int]] = []
        for _ in range(r.randint(1, 3)):
            kind, full, short = entity()
            items.append((full, LABELS.index(kind)))
            items += [(r.choice(short), LABELS.index(kind)) for _ in range(r.randint(0, 3) if r.random() < 0.95 else r.randint(4, 60))]
        items += [(other(), 0) for _ in range(r.randint(0, 6))]
        r.shuffle(items)
        text, marks = "", []
        for x, y in items:
            text += " ".join(word() for _ in range(r.randint(1, 5))) + " "
            marks.append((len(text), len(text) + len(x), y))
            text += x + r.choice([" ", ", ", ". ", " "])
        base = base_spans(text)
        nodes = mentions(text, base)
        truth = [m.label if m.label >= 0 else next((y for s, e, y in marks if s < m.end and m.start < e), 0) for m in nodes]
        out.append((nodes, np.array([features(m, text[max(0, m.start - 24) : m.start], text[m.end : m.end + 2]) for m in nodes]), np.array(truth)))
    return out


@functools.lru_cache(maxsize=4)
def trained(n: int = 800, seed: int = 17, rounds: int = 150) -> Field:
    """Learns node and edge weights by pseudo-likelihood: each label given its mention and its neighbours' labels."""
    docs = generated(n, seed)
    f, y = np.concatenate([x[1] for x in docs]), np.concatenate([x[2] for x in docs])
    starts = np.cumsum([0] + [len(x[0]) for x in docs[:-1]])
    parts = [[v + (s if i < 2 else 0) for i, v in enumerate(edges(x[0]))] for s, x in zip(starts, docs, strict=True)]
    a, b, kind = (np.concatenate([p[i] for p in parts]) for i in range(3))
    k = len(LABELS)
    one = np.eye(k)[y]
    seen = np.zeros((len(y), 2, k))  # labels of the neighbours by kind of edge
    np.add.at(seen, (a, kind), one[b])
    np.add.at(seen, (b, kind), one[a])
    w = {"node": np.zeros((k, f.shape[1])), "pair": np.zeros((2, k, k))}
    m = {x: np.zeros_like(v) for x, v in w.items()}
    v = {x: np.zeros_like(u) for x, u in w.items()}
    for t in range(1, rounds + 1):
        sym = (w["pair"] + w["pair"].transpose(0, 2, 1)) / 2
        z = f @ w["node"].T + np.einsum("nel,eyl->ny", seen, sym)
        p = np.exp(z - z.max(1, keepdims=True))
        e = (p / p.sum(1, keepdims=True) - one) / len(y)
        pair = np.einsum("ny,nel->eyl", e, seen)
        grad = {"node": e.T @ f + 2e-4 * w["node"], "pair": (pair + pair.transpose(0, 2, 1)) / 2 + 2e-4 * w["pair"]}
        for x in w:  # Adam
            m[x] = 0.9 * m[x] + 0.1 * grad[x]
            v[x] = 0.999 * v[x] + 0.001 * np.square(grad[x])
            w[x] = w[x] - 0.1 * (m[x] / (1 - 0.9**t)) / (np.sqrt(v[x] / (1 - 0.999**t)) + 1e-8)
    return Field(w["node"], (w["pair"] + w["pair"].transpose(0, 2, 1)) / 2)


def added_spans(text: str, base: list[tuple[int, int, str]], field: Field) -> list[tuple[int, int, str]]:
    """Mentions clear of the base spans that the field labels as personal data."""
    if "@" not in text and not re.search("[0-9]", text):
        return []
    nodes = mentions(text, base)
    if all(m.label >= 0 for m in nodes):
        return []
    p = field.marginals(nodes, np.array([features(m, text[max(0, m.start - 24) : m.start], text[m.end : m.end + 2]) for m in nodes]))
    return [(m.start, m.end, LABELS[int(q[1:].argmax()) + 1]) for m, q in zip(nodes, p, strict=True) if m.label < 0 and q[1:].max() >= LEAST]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (KINDS.index(x[2]), x[0], x[1])))


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = texts(batch)
            base = [base_spans(x) for x in items]
            every = [joined([*b, *added_spans(x, b, shared.value)]) for x, b in zip(items, base, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([sum(x[2] == k for x in b) for b in base], pa.int64()) for k in KINDS), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array(every)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return scan


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the patterns' spans by kind, their digest, and all spans as kind:start:end.

    Offsets are code points. Null and empty texts have no spans; very long ones are one field; repeated documents give
    a row each; no documents: no rows; other columns are ignored, whatever their names.
    """
    prepared(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # a few hundred weights
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(shared), f"doc_id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
