"""Secrets in texts: fixed patterns, and a character convolutional network over other candidates with their context.

The network sees a candidate and what stands around it as characters; a long one in overlapping windows over its
whole length, of which the best counts. It is trained in numpy on labelled findings
from a seeded generator (secrets of many makes against identifiers, versions, addresses, numbers), scaled to
calibrated probabilities on findings that it was not trained on, and cut at the highest threshold that keeps the
asked recall there. It scores every candidate; the patterns' spans stay whatever it says.
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

# fixed patterns
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "learned")

#: What the network is asked about: runs of so many characters or more, and what the patterns' spans leave of them.
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
BEFORE, INSIDE, AFTER = 24, 40, 8
#: Characters from a window to the next, and windows scored at once.
STEP, AT_ONCE = 20, 4096
WIDTH = BEFORE + INSIDE + AFTER
RECALL = 0.98
FINDINGS = 6000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; a match that is too short is dropped and not tried again."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def candidates(text: str, held: list[tuple[int, int, str]] = ()) -> list[tuple[int, int]]:
    """Spans for the network: runs, without what the patterns' spans hold of them."""
    out, i = [], 0
    held = sorted(held)
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while i < len(held) and held[i][1] <= at:
            i += 1
        for s, e, _ in itertools.takewhile(lambda x: x[0] < end, itertools.islice(held, i, None)):
            if s - at >= SHORTEST:
                out.append((at, s))
            at = max(at, e)
        if end - at >= SHORTEST:
            out.append((at, end))
    return out


def windows(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The parts of a span that the network sees, which cover it; the last one ends with it."""
    last = max(start, end - INSIDE)
    for at in range(start, last, STEP):
        yield at, at + INSIDE
    yield last, end


def symbols(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the characters in and around a window: printable ASCII, one code for others, 0 for nothing."""
    window = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start:end].ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
    codes = np.array([ord(c) for c in window])
    return np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 31, 96)).astype(np.uint8)


@dataclass
class Network:
    """Character embedding, one convolution, maximum and mean pooling, one output; then calibration and threshold."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, dim = self.filters.shape[1] // self.embed.shape[1], self.embed.shape[1]
        e = self.embed[x]
        windows = np.lib.stride_tricks.sliding_window_view(e, size, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, size * dim)
        return windows, np.maximum(0, windows @ self.filters.T + self.bias)

    @staticmethod
    def pooled(h: np.ndarray) -> np.ndarray:
        return np.concatenate([h.max(1), h[:, BEFORE : BEFORE + INSIDE].mean(1)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.pooled(self.hidden(x)[1]) @ self.out + self.out_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([sigmoid(self.scale * self.logits(x[i : i + 128]) + self.shift) for i in range(0, len(x), 128)] or [np.zeros(0)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Symbols of the windows, the windows' labels and the label of generated findings: half are secrets.

    A window of a secret inside a longer run is labelled by what it holds of the secret; -1 if that is too little to tell.
    """
    r = random.Random(seed)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = ["an", "the", "re", "on", "ti", "er", "lich", "ver", "que", "ment", "cion", "os", "in", "al", "to", "es", "ar", "st"]
    some = lambda a, k: "".join(r.choices(a, k=k))
    onsets, vowels, codas = "b c d f g h j k l m n p r s t v w z bl br ch cl cr dr fl fr gl gr kn kr ph pl pr qu sch schl schw sh sk sl sp spr st str th tr tz zw".split(), "a e i o u y ai au ea ee ei eu ie io oo ou".split(), ["", "", "", "", *"b ch ck d f ff g h ht k l lch ld ll lt m mm n nd ng nn ns nt p r rch rd rg rm rn rs rt s ss st t tt tz x".split()]
    syllable = lambda: r.choice(syllables) if r.random() < 0.4 else r.choice(onsets) + r.choice(vowels) + r.choice(codas)
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))

    def path() -> str:
        return "/".join(r.choice([word, word, lambda: f"{word()}{r.choice('-_')}{word()}", lambda: str(r.randint(1, 9999)), lambda: f"{word()}{r.randint(1, 99)}"])() for _ in range(r.randint(4, 40)))

    def secret() -> tuple[str, str, str, str, str]:
        value = r.choice([
            lambda: some(chars, r.randint(20, 64)), lambda: some(chars + "+/", r.randint(30, 80)) + "=" * r.randint(0, 2),
            lambda: some("0123456789ABCDEF", r.choice([32, 40, 64])), lambda: r.choice(["ghp_", "sk-", "xoxb-", "glpat-"]) + some(chars, r.randint(20, 40)),
            lambda: some(chars + "-_", r.randint(24, 48)), lambda: "-".join(some("0123456789ABCDEF", 4) for _ in range(6)),
            lambda: some(chars + "+/", r.randint(100, 900)) + "=" * r.randint(0, 2), lambda: some(chars[:52], r.randint(20, 48)),
            *[lambda: some("0123456789abcdef", r.choice([32, 40, 64]))] * 2, lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
        ])()
        if len(value) < 100 and r.random() < 0.15:  # inside a longer run
            first = path() + r.choice("/=")
            rest = r.choice(["", "/" + path()])
            return r.choice(["http:/", words(2) + " ", ""]), value, r.choice(["", " ", '"', ".", "\n"]) + words(1), first, rest
        before = r.choice([words(3) + " ", words(2) + " key ", words(2) + " bearer ", "auth: ", "private_key=", words(1) + ' credential "', "KEY=", "pwd is ", 'token = "', ""])
        return before, value, r.choice(["", " ", '"', ".", "\n"]) + words(1), "", ""

    def plain() -> tuple[str, str, str, str, str]:
        value = r.choice([
            lambda: f"{word()}_{word()}_{word()}_{r.randint(1, 99)}", lambda: f"{word()}-{word()}-{word()}-{r.randint(1990, 2030)}",
            lambda: f"{word()}/{word()}/{word()}/{r.randint(1, 999)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}",
            lambda: "".join(word() for _ in range(5)) + str(r.randint(0, 9)), lambda: f"{word()}{r.randint(1, 9)}=" + "=" * r.randint(8, 20),
            lambda: f"{word().upper()}{word().upper()}-{r.randint(100, 999)}-{word().upper()}", lambda: "-" * r.randint(8, 20) + f"{word()}{r.randint(1, 9)}",
            lambda: f"{word()}{word()}{word()}-v{r.randint(1, 9)}_{r.randint(0, 9)}_{r.randint(0, 9)}", lambda: f"{r.randint(10**8, 10**9)}-{r.randint(10**6, 10**7)}{word()}",
            lambda: f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}x", lambda: "".join(word().capitalize() for _ in range(4)) + str(r.randint(1, 99)),
            path, path, *[lambda: "".join(word() for _ in range(r.randint(3, 9)))] * 4, *[lambda: "".join(word() for _ in range(r.randint(3, 7))).capitalize()] * 2, lambda: r.choice("_-").join(word() for _ in range(r.randint(4, 9))),
            lambda: r.choice("-=_+/") * r.choice([r.randint(16, 40), r.randint(16, 900)]), lambda: some("0123456789", r.randint(16, 40)), lambda: r.choice([some("0123456789", 2), word(), r.choice(chars)]) * r.randint(16, 60),
            lambda: "-".join(some("0123456789", r.randint(2, 5)) for _ in range(r.randint(4, 6))), lambda: "".join(word() for _ in range(r.randint(4, 7))).upper(), lambda: "".join(word().capitalize() for _ in range(r.randint(4, 8))),
        ])()
        return r.choice([words(3) + " ", words(2) + ": ", "http:/", words(1) + "@", words(2) + ', "', ""]), value, r.choice(["", " ", ".", ",", "\n", '"']) + words(1), "", ""

    out = []
    while len(out) < n:
        label = len(out) % 2
        a, v, b, first, rest = secret() if label else plain()
        run = first + v + rest
        if len(run) < SHORTEST:
            continue
        text, start = a + run + b, len(a) + len(first)  # of the secret
        at = list(windows(len(a), len(a) + len(run)))
        shared = [min(e, start + len(v)) - max(s, start) for s, e in at]
        clear = [e + AFTER <= start or start + len(v) <= s - BEFORE for s, e in at]
        y = [(1 if n >= min(SHORTEST, len(v)) else 0 if c else -1) if label else 0 for n, c in zip(shared, clear, strict=True)]
        out.append((np.array([symbols(text, s, e) for s, e in at]), np.array(y), label))
    return out


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of the labelled windows of generated findings."""
    made = findings(n, seed)
    x, y = np.concatenate([f[0] for f in made]), np.concatenate([f[1] for f in made])
    return x[y >= 0], y[y >= 0]


@functools.lru_cache(maxsize=4)
def trained(n: int = FINDINGS, recall: float = RECALL, seed: int = 11) -> Network:
    """Trains on two thirds of the findings, calibrates and sets the threshold on the rest."""
    made = findings(n, seed)
    held, made = made[2 * n // 3 :], made[: 2 * n // 3]
    # a long finding weighs no more than some short ones
    x, y = np.concatenate([f[0][:12] for f in made]), np.concatenate([f[1][:12] for f in made])
    x, y = x[y >= 0], y[y >= 0]
    cut = len(x)
    g = np.random.default_rng(seed)
    dim, size, k = 8, 5, 24
    net = Network(g.normal(0, 0.3, (97, dim)), g.normal(0, 0.2, (k, size * dim)), np.zeros(k), g.normal(0, 0.2, 2 * k), 0.0)
    names = ("embed", "filters", "bias", "out", "out_bias")
    m = {a: 0.0 for a in names}
    v = {a: 0.0 for a in names}
    t = 0
    for _ in range(6):
        order = g.permutation(cut)
        for i in range(0, cut, 64):
            at = order[i : i + 64]
            xb, yb = x[at], y[at]
            windows, h = net.hidden(xb)
            p = net.pooled(h)
            d = (sigmoid(p @ net.out + net.out_bias) - yb) / len(at)
            grad = {"out": p.T @ d + 1e-4 * net.out, "out_bias": d.sum()}
            dh = np.zeros_like(h)
            top = h.argmax(1)
            rows, cols = np.indices(top.shape)
            dh[rows, top, cols] += d[:, None] * net.out[:k]
            dh[:, BEFORE : BEFORE + INSIDE] += (d[:, None] * net.out[k:])[:, None, :] / h[:, BEFORE : BEFORE + INSIDE].shape[1]
            dh *= h > 0
            flat = dh.reshape(-1, k)
            grad["filters"] = flat.T @ windows.reshape(len(flat), -1)
            grad["bias"] = flat.sum(0)
            dw = (flat @ net.filters).reshape(len(at), -1, size, dim)
            de = np.zeros((len(at), WIDTH, dim))
            for j in range(size):
                de[:, j : j + dw.shape[1]] += dw[:, :, j]
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], xb, de)
            t += 1
            for a in names:  # Adam
                m[a] = 0.9 * m[a] + 0.1 * grad[a]
                v[a] = 0.999 * v[a] + 0.001 * np.square(grad[a])
                setattr(net, a, getattr(net, a) - 0.01 * (m[a] / (1 - 0.9**t)) / (np.sqrt(v[a] / (1 - 0.999**t)) + 1e-8))
    z, yc = np.array([net.logits(f[0]).max() for f in held]), np.array([f[2] for f in held])
    for _ in range(300):  # calibration: logistic regression on the logit
        e = sigmoid(net.scale * z + net.shift) - yc
        net.scale -= 0.1 * float(np.mean(e * z)) / (1 + float(np.mean(z * z)))
        net.shift -= 0.1 * float(np.mean(e))
    found = np.sort(np.array([net.probability(f[0]).max() for f in held])[yc == 1])
    net.threshold = float(found[min(len(found) - 1, int((1 - recall) * len(found) + 1e-9))]) if len(found) else 1.0
    return net


def all_spans(items: list[str], net: Network) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, probability) of each text's spans: the patterns', and the candidates clear of them that the network accepts.

    The network scores all of them; the patterns' spans stay at any score.
    """
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in items]
    asked: list[tuple[int, int, int, str]] = []
    best: list[float] = []
    rows, of = [], []

    def score() -> None:
        for j, p in zip(of, net.probability(np.array(rows)) if rows else (), strict=True):
            best[j] = max(best[j], float(p))
        rows.clear()
        of.clear()

    for i, x in enumerate(items):
        base = base_spans(x)
        for s, e, k in [*base, *((s, e, "learned") for s, e in candidates(x, base))]:
            asked.append((i, s, e, k))
            best.append(0.0)
            for a, b in windows(s, e):
                rows.append(symbols(x, a, b))
                of.append(len(best) - 1)
                if len(rows) >= AT_ONCE:
                    score()
    score()
    for (i, s, e, k), p in zip(asked, best, strict=True):
        if k != "learned" or p >= net.threshold:
            out[i].append((s, e, k, round(p, 6)))
    return [sorted(x, key=lambda v: (v[0], KINDS.index(v[2]), v[1])) for x in out]


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, *_ in spans)


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans(texts(batch), shared.value)
            base = [[x for x in f if x[2] != "learned"] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([sum(x[2] == k for x in b) for b in base], pa.int64()) for k in KINDS[:3]), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(f) for f in found]), pa.array([[x[3] for x in f] for f in found], pa.list_(pa.float64()))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"],
            )

    return scan


def secrets(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Per document: doc_id, counts of the patterns' spans by kind, their digest, all spans as kind:start:end, and the
    network's probability of each.

    Offsets are code points. Null and empty texts have no spans; repeated documents give a row each; other columns
    are ignored.
    """
    prepared(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained(recall=recall))  # a few thousand weights
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(shared), f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, scores array<double>")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
