import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from lociweave.llm import components, decontaminate, mixing, pii, queries, secrets, simhash, token_counts, token_file, topk, toxicity, warc
from lociweave.llm.common import table, written

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
ODD = [
    (None, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", "en", "a", 3), (3, "same text here now and then", "en", None, 1), (3, "same text here now and then", "en", None, 1),
    (4, "same text here now and then", "de", "b", 1), (5, LONG, "en", "b", 1), (6, "é́ \U0001f600 <|endoftext|> x", "fr", "c", 1), (7, None, "fr", "c", 1), (8, "a\x1cb don't", None, "c", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def rows(df):
    return [tuple(r) for r in df.collect()]


def clash(df):
    """Extra columns whose names the operators use inside."""
    for c in ("hits", "fp", "size", "m", "base", "extra", "terms", "toxic", "held_out", "digest", "member", "n_words", "_fp", "_id", "_s", "source_size"):
        df = df.withColumn(c, df["doc_id"] * 0)
    return df


# 1


def brute_secrets(t):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_secret_patterns_and_digest(spark, docs):
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    for d in docs.collect():
        b = brute_secrets(d.text)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in b).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for s, e, k in b) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in b) for k in secrets.KINDS[:3])
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice(["token", "Secret", "api_key", "=", ":", " ", '"', "abcdefgh", "0a" * 17, "AKIA", "Z9" * 7, "ſecret", "-", "é"]) for _ in range(r.randint(1, 12)))
        assert secrets.base_spans(t) == brute_secrets(t), t


def test_network_on_unseen_findings():
    net = secrets.trained()
    x, y = secrets.labelled_findings(800, 123)
    p = net.probability(x) >= net.threshold
    assert p[y == 1].mean() > 0.9 and p[y == 0].mean() < 0.03
    t = "the key is ghp_a8Fk29xLq0ZpR7sT3uVw1YbC4dE5 and more"
    assert any(k == "learned" for _, _, k, _ in secrets.all_spans([t], net)[0])
    t = "token = 0123456789abcdef0123456789abcdef"
    assert [k for _, _, k, _ in secrets.all_spans([t], net)[0]] == ["assign", "hex"]


def test_network_keeps_the_asked_recall():
    held, unseen = (([f[0] for f in found if f[2]]) for found in (secrets.findings()[2 * secrets.FINDINGS // 3 :], secrets.findings(4000, 321)))
    for recall in (0.9, secrets.RECALL, 0.99, 0.999):
        net = secrets.trained(recall=recall)
        kept = [np.mean([net.probability(x).max() >= net.threshold for x in found]) for found in (held, unseen)]
        assert recall <= kept[0] < recall + 0.005 and kept[1] > recall - 0.01, (recall, kept)


def test_candidates_of_any_length_and_make():
    net, r = secrets.trained(), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    blob, key, path = "".join(r.choices(letters + "0123456789+/", k=1500)) + "==", "".join(r.choices(letters + "0123456789", k=36)), "/an/the/re/on/" * 12
    url = f"{path}{key}{path}"  # the secret stands in the middle
    for run in (blob, url, "".join(r.choices(letters, k=32))):
        assert [x[:3] for x in secrets.all_spans([f"see {run} and"], net)[0]] == [(4, 4 + len(run), "learned")], run
    for run in (path * 2, "-" * 600, "Donaudampfschifffahrtsgesellschaft"):
        assert secrets.all_spans([f"see {run} and"], net)[0] == [], run
    text = "x" * 20 + "/" + "AKIA" + "Z9" * 8 + "/" + key
    assert secrets.candidates(text, secrets.base_spans(text)) == [(0, 21), (41, len(text))]
    for n in (16, 40, 41, 60, 61, 999):
        seen = {i for s, e in secrets.windows(7, 7 + n) for i in range(s, e)}
        assert seen == set(range(7, 7 + n))


def test_secrets_of_odd_rows(spark, odd):
    long = ("word " * 200_000) + "token=" + "aB3" * 20
    more = spark.createDataFrame([(20, long, "en", "a", 1), (21, 'api_key = "0123456789abcdefXYZ"', None, None, None)], DOC)
    got = rows(secrets.secrets(clash(odd.unionAll(more))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"))
    assert len(got) == len(ODD) + 2
    empty = hashlib.sha256(b"").hexdigest()
    assert all(x[1:] == (0, 0, 0, empty, "") for x in got if x[0] in (None, 1, 2, 7))
    assert [x[1] for x in got if x[0] in (20, 21)] == [1, 1] and f"assign:{5 * 200_000}:{len(long)}" in next(x[5] for x in got if x[0] == 20)
    assert secrets.secrets(odd.limit(0)).count() == 0


def test_network_finds_the_secrets_of_documents(spark):
    """Recall on the values that the patterns find in documents, which the network scores like any other candidate."""
    got = secrets.op1_secrets(spark, "/root/testdata/sf0.1").collect()
    p = [p for r in got for x, p in zip(r.spans.split(","), r.scores) if not x.startswith("learned")]
    assert len(p) > 100 and np.mean(np.array(p) >= secrets.trained().threshold) > 0.9


# 2


def test_counts_of_no_rows(spark, odd):
    assert token_counts.token_counts(clash(odd).limit(0)).count() == 0
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd).collect() if r.doc_id in (None, 1, 7)} == {None: (0, 0, False), 1: (0, 0, False), 7: (0, 0, False)}


def test_words_learned_together_count_alike():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(14)
    part = lambda: "".join(r.choices(["th", "ing", "an", "é", "ß", "Q", "日", "ab", "x"], k=r.randint(1, 6)))
    items = [" ".join(part() + r.choice(["", "", ",", ".", "$$$", "&&&", ",###", "'s", "2", "_", "<|endoftext|>"]) for _ in range(r.randint(0, 60))) + r.choice(["", "\n", "  x"]) for _ in range(150)]
    count = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    for x, got in zip(items, count.many(items)):
        assert len(got) == len(x) and (not x or got[-1] == len(whole.encode(x, add_special_tokens=False).ids)), x
        for i in r.sample(range(1, len(x) + 1), min(5, len(x))):
            assert got[i - 1] == len(whole.encode(x[:i], add_special_tokens=False).ids), x[:i]


def test_prefix_tables_are_exact(spark, odd):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    parts = [*"ab 's\n\t.é1", "'re", "'ll", "<|endoftext|>", "<|", "the ", "  ", "\r\n", "日本", "\x1c"]
    for _ in range(150):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 20)))
        assert count.counts(t).tolist() == [len(whole.encode(t[:i], add_special_tokens=False).ids) for i in range(1, len(t) + 1)], t
    for r_ in token_counts.token_counts(clash(odd)).collect():
        texts = [d[1] or "" for d in ODD if d[0] == r_.doc_id]
        assert r_.n_tokens in [len(whole.encode(t, add_special_tokens=False).ids) for t in texts] and r_.n_bytes in [len(t.encode()) for t in texts]
        assert r_.over_limit == (r_.n_tokens > 1024)
    n = count.counts(LONG)
    assert n[token_counts.within(n, 1024) - 1] <= 1024 < n[token_counts.within(n, 1024)]


# 3


def test_machine_learns_pairs_and_held_out_rows_stay_out(spark, sf, docs):
    r = np.random.default_rng(1)
    data = []
    for _ in range(1200):
        a, b = r.random(2) < 0.4
        data.append((np.unique(np.array([*r.integers(10, 60, 6), *([1] if a else []), *([2] if b else [])], np.int32)), int(a and b)))
    m = toxicity.train(data)
    at = {int(t): i for i, t in enumerate(m.terms)}
    both, one = m.score(np.array([at[1], at[2]])), max(m.score(np.array([at[1]])), m.score(np.array([at[2]])))
    assert both > 0.9 and one < 0.2
    got = {x.doc_id: x for x in toxicity.toxicity(docs, table(spark, sf, "labels")).collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for i, x in got.items())


def test_machine_finds_terms_that_tell_nothing_alone():
    for seed, rule in ((1, lambda a, b: a ^ b), (2, lambda a, b: a & b), (3, lambda a, b: 1 - (a ^ b))):
        r, data = np.random.default_rng(seed), []
        for _ in range(4000):
            a, b = r.random(2) < 0.5
            data.append((np.unique(np.array([*r.integers(10, 60, 6), *([1] if a else []), *([2] if b else [])], np.int32)), int(rule(int(a), int(b)))))
        m = toxicity.train(data)
        at = {int(t): i for i, t in enumerate(m.terms)}
        for a in (0, 1):
            for b in (0, 1):
                score = m.score(np.array([at[t] for t, on in ((1, a), (2, b)) if on], np.int64))
                assert (score >= 0.7) == bool(rule(a, b)), (seed, a, b, score)


def test_scores_equal_the_sum_over_pairs(spark, sf, docs):
    labels = table(spark, sf, "labels")
    m = toxicity.learned(docs, labels)
    place = {int(t): i for i, t in enumerate(m.terms)}
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    for d in docs.collect():
        hashed = {zlib.crc32(x.encode()) % toxicity.BUCKETS for w in re.findall(r"[^\W_]+", d.text.lower()) for x in {w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k)}}
        on = sorted(place[t] for t in hashed if t in place)
        z = m.bias + sum(float(m.weights[i]) for i in on) + sum(float(np.dot(m.vectors[i], m.vectors[j])) for k, i in enumerate(on) for j in on[:k])
        assert got[d.doc_id] == pytest.approx(1 / (1 + np.exp(-min(30, max(-30, z)))), abs=1e-9)


def test_repeated_labelled_documents_count_once(spark):
    d = spark.createDataFrame([(i % 6, f"bad word{j}" if i % 2 else f"good word{j}") for j in range(40) for i in range(6)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    seen = []
    real, toxicity.train = toxicity.train, lambda x: seen.append(len(x)) or real(x)
    try:
        first, again = (toxicity.learned(d.repartition(n), lab, 3) for n in (1, 7))
    finally:
        toxicity.train = real
    assert seen[0] == seen[1] <= 3 and np.array_equal(first.terms, again.terms) and first.bias == again.bias


def test_toxicity_holds_on_unseen_rows(spark):
    sf = "/root/testdata/sf0.1"
    lab = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    got = [(lab[r.doc_id], r.predicted) for r in toxicity.op3_toxicity(spark, sf).where("held_out").collect() if r.doc_id in lab]
    n = Counter(got)
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.75 and n[0, 1] / (n[0, 1] + n[0, 0]) < 0.01


def test_toxicity_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in toxicity.toxicity(clash(odd), none).collect()} == {0.5}
    bad = spark.createDataFrame([(None, 1, 1), (3, 1, None), (3, 1, 1), (3, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, bad).count() == len(ODD)


# 4


def fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w, total = {s: i % 3 + 1 for i, s in enumerate(order)}, float(sum(sizes.values()))
    out, free = {}, set(order)
    while free:
        level = total / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            total -= out[s]
            free.remove(s)
    return out


def test_mix_meets_targets_and_repeats(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = mixing.mix(docs).collect()
    d = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.collect()}
    sizes = Counter()
    for n, s in d.values():
        sizes[s] += n
    want, taken = fill(sizes), Counter()
    for r in got:
        n, s = d[r.doc_id]
        assert (r["size"], r.source_size) == (n, sizes[s]) and r.target == pytest.approx(want[s]) and r.taken % max(1, n) == 0 and r.taken <= 3 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) < 0.05 * want[s] + 30 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(rows(mixing.mix(docs)))


def test_flight_keeps_totals_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    r = random.Random(6)
    d = spark.createDataFrame([("s", i, r.choice([3, 5, r.randint(3, 400)])) for i in range(700)] + [("t", i, 7) for i in range(300)], "source string, doc_id long, size long")
    p = mixing.plan(d)
    got = p.selectExpr("source", "size * (base * m + extra) as t", "target", "m").groupBy("source").agg({"t": "sum", "target": "max"}).collect()
    assert all(abs(x["sum(t)"] - x["max(target)"]) <= 40 for x in got)
    few = spark.createDataFrame([("s", i, r.choice([3, 3, 5, 80, 400])) for i in range(700)] + [("t", i, 7) for i in range(300)], "source string, doc_id long, size long")
    got = mixing.plan(few).selectExpr("source", "size * (base * m + extra) as t", "target", "m").groupBy("source").agg({"t": "sum", "target": "max"}).collect()
    assert all(abs(x["sum(t)"] - x["max(target)"]) <= 400 for x in got)  # with few sizes the last one can be the largest
    size = np.arange(40, 0, -1)
    q = mixing.fly(np.full(40, 0.3), size, 1)
    assert q.sum() == pytest.approx(12) and (q @ size) == pytest.approx(0.3 * 820) and ((q > 0) & (q < 1)).sum() <= 2


def test_every_document_keeps_its_probability():
    g = np.random.default_rng(4)
    for n in (1, 2, 5, 12, 40, 200):
        for p in (np.full(n, 0.3), g.uniform(0.05, 0.95, n)):
            size = np.sort(g.choice([3, 3, 3, 17, 50, 81, 400, 2000], n))[::-1]
            seeds = 400 if n == 200 else 3000
            got = np.array([mixing.fly(p, size, seed, True) for seed in range(seeds)])
            assert set(np.unique(got)) <= {0.0, 1.0} and len({tuple(x) for x in got}) > 1
            assert np.abs(got.mean(0) - p).max() < 4.5 * np.sqrt(0.25 / seeds)  # 0.11 and 0.04
            assert np.abs(got.sum(1) - p.sum()).max() < 2 and (n < 200 or np.abs(got @ size - p @ size).max() <= 17)


def test_mix_of_odd_rows_and_copies(spark, odd):
    assert mixing.mix(clash(odd)).count() == len(ODD)
    many = spark.createDataFrame([(1, "a b c", "en", "x", 5)] * 90 + [(2, "a b c d", "en", "y", 5)] * 10, DOC)
    kept = mixing.mixed(clash(many))
    assert kept.columns == clash(many).columns
    taken = {r.doc_id: r[1] for r in mixing.mix(many).groupBy("doc_id").sum("taken").collect()}
    assert {r.doc_id: r["count"] * (2 + r.doc_id) for r in kept.groupBy("doc_id").count().collect()} == taken
    assert mixing.mix(odd.limit(0)).count() == 0


# 5


def test_windows_in_small_blocks_equal_brute_force(spark):
    r = random.Random(8)
    word = lambda: r.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(r.choice([1, 4, 12, 14])))) for i in range(12)] + [(3, None), (None, "q r s"), (20, "")]
    data = [(i, " ".join([*(word() for _ in range(40)), *(["Q", "r", "s"] if i % 3 == 0 else []), *(items[i % 12][1].upper().split())])) for i in range(30)] + [(40, None), (41, ""), (42, "a"), (42, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = []
    for i, t in data:
        w = re.findall(r"[0-9a-z]+", (t or "").lower())
        hit, own = set(), set()
        for item, x in items:
            v = re.findall(r"[0-9a-z]+", (x or "").lower())
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        own |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    for block in (1 << 20, 20):
        assert sorted(rows(decontaminate.contamination(docs, bench, block))) == sorted(want)
    small = decontaminate.longest_matches(docs, bench, 20)
    assert sorted((r.doc_id, r.hits.n_words, sum(e - s for s, e in r.hits.spans), len(r.hits["items"])) for r in small.collect()) == sorted(x[:4] for x in want)
    kept = decontaminate.decontaminate(clash(docs), bench, 20)
    assert kept.columns == clash(docs).columns and sorted(r[0] for r in kept.collect()) == sorted(x[0] for x in want if not x[5])


def test_longest_matches_equal_brute_force():
    r = random.Random(1)
    split = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    for trial in range(200):
        word = lambda k=r.randint(1, 7): r.choice("abcdefg"[:k])
        items = [(str(i), " ".join(word() for _ in range(r.choice([0, 1, 3, 9, 10, 11, 14, 30])))) for i in range(r.randint(1, 8))]
        texts = [" ".join([*(word() for _ in range(r.randint(0, 30))), *r.choice(items)[1].upper().split(), *["zzz"] * r.randint(0, 1), *(word() for _ in range(r.randint(0, 12)))]) for _ in range(r.randint(1, 6))]
        block = decontaminate.build_block(items)
        found = decontaminate.shard_matches(texts, block)
        for d, t in enumerate(texts):
            w, best, end, want = split(t), {}, -1, []
            for _, x in items:
                v = split(x)
                n = min(10, len(v))
                for a in range(len(v) - n + 1 if v else 0):
                    for b in range(len(w) - n + 1):
                        if w[b : b + n] == v[a : a + n]:
                            k = n
                            while n == 10 and a + k < len(v) and b + k < len(w) and v[a + k] == w[b + k]:
                                k += 1
                            best[b] = max(best.get(b, 0), k)
            for b in sorted(best):
                if b + best[b] > end:
                    want.append((b, best[b]))
                    end = b + best[b]
            got = [m for m in found.longest if m[0] == d]
            assert [m[1:3] for m in got] == want, trial
            assert all(split(dict(items)[block.items[i]])[j : j + n] == w[s : s + n] for _, s, n, i, j in got)


def test_texts_are_dropped_by_the_matches_of_suffix_arrays(monkeypatch):
    long, short = " ".join(f"a{i}" for i in range(14)), "one two three"
    block = decontaminate.build_block([("L", long), ("S", short)])
    texts = [f"x {long} y", "x " + " ".join(long.split()[2:12]), f"{short} one two", "one two", " ".join(long.split()[:9]), "", short]
    searched, real = [], decontaminate._longest
    monkeypatch.setattr(decontaminate, "_longest", lambda *x: searched.append(real(*x)) or searched[-1])
    assert decontaminate._hit(texts, block).tolist() == [True, True, True, False, False, False, True]
    assert sorted(m[2] for found in searched for m in found if m[0] in (1, 2, 6)) == [3, 3, 10]
    monkeypatch.setattr(decontaminate, "_longest", lambda *x: [])
    assert not decontaminate._hit(texts, block).any()


def test_longest_matches_of_two_items_stay_two(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    bench = spark.createDataFrame([("A", a), ("B", b)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {a} {b} y"), (1, f"x {a} {b} y"), (2, "x " + " ".join(a.split()[1:]) + " y"), (3, None)], "doc_id long, text string")
    for block in (1 << 20, 10):
        got = sorted((r.doc_id, [tuple(m) for m in r.hits.longest]) for r in decontaminate.longest_matches(docs, bench, block).collect())
        assert got == [(1, [(1, 12, "A", 0), (13, 12, "B", 0)])] * 2 + [(2, [(1, 11, "A", 1)]), (3, [])]


def test_contamination_of_odd_rows(spark, odd, sf):
    assert decontaminate.contamination(clash(odd), table(spark, sf, "benchmark")).count() == len(ODD)
    assert not any(r.contaminated for r in decontaminate.contamination(odd, table(spark, sf, "benchmark").limit(0)).collect())


# 6


def test_salvage_recovers_what_is_whole():
    data = [warc.record(i, f"http://x/{i}", b"<p>" + bytes([65 + i]) * 500, hashlib.sha256(b"<p>" + bytes([65 + i]) * 500).hexdigest()) for i in range(5)]
    for pack in (warc.member, lambda x: x):
        parts = [pack(x) for x in data]
        whole = b"".join(parts)
        assert [warc.page_row(r)[0] for r in warc.salvage(whole)[0]] == [0, 1, 2, 3, 4] and not warc.salvage(whole)[1]
        at = len(parts[0]) + len(parts[1]) // 2
        broken = bytearray(whole)
        broken[at : at + 3] = b"\0\0\0"
        got, gaps = warc.salvage(bytes(broken))
        assert [warc.page_row(r)[0] for r in got] == [0, 2, 3, 4] and sum(n for _, n, _ in gaps) == len(parts[1])
        got, gaps = warc.salvage(b"junk" + whole[:-7])
        assert [warc.page_row(r)[0] for r in got] == [0, 1, 2, 3] and gaps[0][:2] == (0, 4) and gaps[-1][0] + gaps[-1][1] == len(whole) - 3
    assert warc.salvage(b"") == ([], [])


def test_salvage_keeps_whole_records_of_a_damaged_member():
    r = random.Random(8)
    bodies = [bytes(r.randrange(256) for _ in range(3000)) for _ in range(6)]
    parts = [warc.record(i, None, b, hashlib.sha256(b).hexdigest()) for i, b in enumerate(bodies)]
    ids = lambda data: [warc.page_row(x)[0] for x in warc.salvage(data)[0]]
    whole = warc.member(b"".join(parts))
    assert ids(whole) == [0, 1, 2, 3, 4, 5] and warc.salvage(whole)[1] == []
    bad = bytearray(parts[2])
    bad[-50] ^= 1  # one block digest fails
    packed = warc.member(b"".join([*parts[:2], bytes(bad), *parts[3:]]))
    assert ids(packed + whole) == [0, 1, 3, 4, 5, 0, 1, 2, 3, 4, 5]
    assert warc.salvage(packed)[1] == [(0, len(bad), "wrong block digest")]
    cut = whole[: len(whole) // 2]
    assert ids(cut) == [0, 1] and warc.salvage(cut)[1][-1] == (0, len(cut), "member without an end")
    broken = bytearray(whole)
    broken[-8] ^= 1  # the CRC
    assert ids(bytes(broken) + warc.member(parts[0])) == [0, 1, 2, 3, 4, 5, 0]
    stored = bytearray(warc.member(b"".join(parts), 0))  # holds the records as they are
    stored[-8] ^= 1
    assert ids(bytes(stored)) == [0, 1, 2, 3, 4, 5]
    flat = warc.member(b"".join(parts[:1] + [warc.record(9, None, b"<p>" * 4000, "")]) + b"".join(parts[1:]))
    torn = flat[: len(flat) // 2] + b"\xff" * 40 + flat[len(flat) // 2 + 40 :]
    assert ids(torn)[:3] == [0, 9, 1]


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 150
    pages = [(5, "u\r\nv é", big), (3, "u", big), (9, None, big), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", big), (4, "u", "é" * 60 + "\0\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first", "3 as n")
    warc.write_archives(df, f"file://{tmp_path}/a", 400)
    got = {r.page_id: tuple(r)[1:] for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()}
    for i, _, h in pages:
        b = (h or "").encode()
        to = 3 if i in (5, 9, None) else None
        assert got[i] == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if to else "response", to)
    assert warc.quarantined(spark, f"file://{tmp_path}/a").count() == 0
    warc.write_archives(df.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_foreign_archives(spark, tmp_path):
    import base64
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()

    def make(headers, block):
        return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    uuid = "<urn:uuid:00000000-0000-0000-0000-000000000001>"
    kind = ("Content-Type", "application/http; msgtype=response")
    info = make([("WARC-Type", "warcinfo"), ("WARC-Record-ID", uuid), ("Content-Type", "application/warc-fields")], b"software: x\r\n")
    good = make([("WARC-Type", "response"), ("WARC-Record-ID", uuid), kind, ("WARC-Payload-Digest", sha1(b"<p>a"))], http + b"<p>a")
    wrong = make([("WARC-Type", "response"), ("WARC-Record-ID", uuid), kind, ("WARC-Payload-Digest", sha1(b"<p>b"))], http + b"<p>c")
    packed = make([("WARC-Type", "response"), ("WARC-Record-ID", uuid), kind, ("WARC-Payload-Digest", sha1(b"plain"))], http[:-2] + b"Content-Encoding: br\r\n\r\nxyz")
    plain = make([("WARC-Record-ID", uuid)], b"no type")
    visit = make([("WARC-Type", "revisit"), ("WARC-Record-ID", uuid), kind, ("WARC-Payload-Digest", sha1(b"<p>a")), ("WARC-Refers-To", uuid)], http)
    parts = [info, good, wrong, packed, plain, visit]
    want = Counter([(None, 13, "warcinfo"), (None, 4, "response"), (None, 3, "response"), (None, 7, "unknown"), (None, None, "revisit")])
    for i, data in enumerate((b"".join(parts), b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts)))):
        (tmp_path / f"{i}.warc").write_bytes(data)
        got = Counter((r.page_id, r.payload_bytes, r.record_type) for r in warc.read_archives(spark, f"file://{tmp_path}/{i}.warc").collect())
        assert got == want
        assert [r.reason for r in warc.quarantined(spark, f"file://{tmp_path}/{i}.warc").collect()] == ["wrong payload digest"]


def test_archive_files_are_bounded(spark, tmp_path):
    r = random.Random(5)
    big = ["".join(r.choices("abcdefghijklmnop", k=200_000)) for _ in range(6)]
    pages = [(i, "u", "".join(r.choices("abcdefghij", k=100))) for i in range(5000)] + [(10_000 + i, "u", x) for i, x in enumerate(big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/a", 250_000)
    assert max(p.stat().st_size for p in (tmp_path / "a").glob("part-*")) < 700_000
    got = {x.page_id: x.payload_digest for x in warc.read_archives(spark, f"file://{tmp_path}/a").collect()}
    assert got == {i: hashlib.sha256(h.encode()).hexdigest() for i, _, h in pages}


# 7


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    r = np.random.default_rng(3)
    v = r.normal(0, 0.4, (300, 16)).astype(np.float32)
    v[100:180] = v[100]
    data = [(i, v[i].tolist()) for i in range(300)]
    odd = [(600, None), (650, [None, 1.0]), (700, [float("nan")] * 16), (None, v[0].tolist()), (750, []), (800, [0.5]), (850, [1e12] * 16)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as label")
    own = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e in data + odd if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in own:
        if q % 50 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own[q], own[c])))), c) for c in own if c != q)[:5]
            want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s)]
    for block in (16_384, 2):
        assert sorted(rows(topk.top_k(df, query_block=block))) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


# 8


def brute_prints(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def brute_components(f):
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(f))]


def test_near_duplicates_equal_brute_force(spark, odd, docs):
    for df in (clash(odd), docs):
        d = df.select("doc_id", "text").collect()
        f = brute_prints([r.text for r in d])
        c = brute_components(f)
        least = {}
        for r, k in zip(d, c):
            least[k] = min([x for x in (least.get(k), r.doc_id) if x is not None], default=None)
        want = sorted(((r.doc_id, f"{x:016x}", least[k]) for r, x, k in zip(d, f, c)), key=str)
        assert sorted(rows(simhash.near_duplicates(df)), key=str) == want
        kept = simhash.deduplicate(df)
        assert kept.columns == df.columns and kept.count() == len(set(c))
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_in_blocks_keep_components(spark, monkeypatch):
    r = random.Random(12)
    f = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(60):
            f.add(x)
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
    f = sorted(f)
    signed = np.array(f, np.uint64).view(np.int64).tolist()
    want = brute_components(f)
    for block in (2048, 4):
        monkeypatch.setattr(simhash, "BLOCK", block)
        # the kernels run here, since a worker has its own BLOCK
        key_fp = sorted(map(tuple, simhash.signatures(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()))
        import pyarrow as pa

        def batches(n):
            for i in range(0, len(key_fp), n):
                yield pa.RecordBatch.from_pydict({"key": [k for k, _ in key_fp[i : i + n]], "fp": [x for _, x in key_fp[i : i + n]]})

        met = pa.Table.from_batches(list(simhash._meet(batches(1000)))).to_pylist()
        tasks = [m for m in met if m["left"] is not None]
        assert bool(tasks) == (block == 4)
        more = pa.Table.from_batches(list(simhash._compare([pa.RecordBatch.from_pylist(tasks)]))).to_pylist() if tasks else []
        links = [(m["a"], m["b"]) for m in met + more if m["a"] is not None]
        got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long"))))
        mine = [got.get(x, x) for x in signed]
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_components_of_paths_and_loops(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = dict(rows(components.components(spark.createDataFrame(e, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 9


def brute_pii(x):
    digits = lambda t: re.sub(r"[^0-9]", "", t)
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m[0])) <= 15]


def test_personal_data_patterns_and_digest(spark, docs, odd):
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for d in docs.collect():
        b = brute_pii(d.text)
        assert got[d.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in b).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for s, e, k in b} <= set(got[d.doc_id].spans.split(",")) and got[d.doc_id].n_card == sum(k == "card" for *_, k in b)
    r = random.Random(3)
    for _ in range(5000):
        x = "".join(r.choice(["1", "22", "300", ".", ".", "@", "a", "b.c", "_", "%", "+", "-", " ", "(", ")", "4111111111111111", "5", "\n", "é", "007"]) for _ in range(r.randint(1, 25)))
        assert pii.base_spans(x) == brute_pii(x), x
    assert pii.personal_data(clash(odd)).count() == len(ODD)
    assert pii.base_spans("9" * 30_000 + ".1.1.1") == []


def test_field_uses_distant_mentions():
    f = pii.trained()
    seen = "call +1 (213) 555-7713 at noon in 1999 " + "some words " * 50 + "or 213-555-7713 again, version 3.0"
    b = pii.base_spans(seen)
    assert [seen[s:e] for s, e, _ in pii.added_spans(seen, b, f)] == ["213-555-7713"]
    alone = "or 213-555-7713 again, version 3.0"
    assert pii.added_spans(alone, [], f) == []
    right = wrong = total = clean = 0
    for nodes, x, y in pii.generated(150, 77):
        for m, p, k in zip(nodes, f.marginals(nodes, x), y):
            if m.label < 0:
                hit = p[1:].max() >= pii.LEAST
                total, right = total + (k > 0), right + (k > 0 and hit and p[1:].argmax() + 1 == k)
                clean, wrong = clean + (k == 0), wrong + (k == 0 and hit)
    assert right / total > 0.8 and wrong / clean < 0.02


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 13, 30, 100])
def test_field_labels_all_of_any_number_of_repeats(n):
    f = pii.trained()
    for form in ("213-555-7713", "(213) 555-7713", "555-7713"):
        full, short = "call +1 (213) 555-7713 please", [f"or {form} now and then"] * n
        for parts in ([full, *short], [*short, full], [*short[: n // 2], full, *short[n // 2 :]]):
            text = "\n".join(parts)
            assert len(pii.added_spans(text, pii.base_spans(text), f)) == n
    assert pii.added_spans("\n".join(["or 213-555-7713 now and then"] * n), [], f) == []


def test_addresses_of_any_length():
    r = random.Random(9)
    for _ in range(3000):
        x = "".join(r.choice(["a", "b.c", "@", "@", " ", "\n", "é", ">", "\u2003"]) for _ in range(r.randint(1, 20)))
        assert list(pii.addresses(x)) == [m.span() for m in re.finditer(r"[^\s@]+@[^\s@]*", x)], x
    long = "write to " + "u" * 5000 + ".12@mail3.example.com or " + "u" * 5000 + ".12@mail3 now"
    b = pii.base_spans(long)
    assert [e - s for s, e, _ in b] == [5021] and [e - s for s, e, _ in pii.added_spans(long, b, pii.trained())] == [5009]


def test_personal_data_of_odd_rows(spark, odd):
    got = {r.doc_id: r for r in pii.personal_data(clash(odd)).collect()}
    assert len(got) == len({d[0] for d in ODD}) and all(got[i].spans == "" and got[i].base_sha256 == hashlib.sha256(b"").hexdigest() for i in (None, 1, 2, 7))
    assert pii.personal_data(odd.limit(0)).count() == 0


# 10


def test_token_files_round_trip(spark, odd, docs, tmp_path):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 1]
    for n, df in enumerate((clash(odd), docs)):
        token_file.write_token_files(df, path := f"file://{tmp_path}/{n}")
        got = rows(token_file.token_digests(spark, path))
        start = 0
        for i, s, k, crc in sorted(got, key=lambda r: r[1]):
            assert s == start
            start += k
        want = Counter((r.doc_id, len(x := ids(r.text)), zlib.crc32(np.array(x, "<u4").tobytes())) for r in df.collect())
        assert Counter((i, k, c) for i, _, k, c in got) == want
        order = [r[0] for r in sorted(got, key=lambda r: r[1])]
        assert order == sorted(order, key=lambda x: (x is not None, x))
        one = token_file.read_token_files(spark, path).where("doc_id = 5").collect()
        assert one[0]["ids"] == ids(next(r.text for r in df.collect() if r.doc_id == 5))


def test_chunked_ids_equal_the_library():
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    enc = token_file.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(5)
    parts = ["Word", "word,", "don't", "IT'S", ".", ",.", "x2", "é", "é", "İ", "ΟΔΟΣ", "日本", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", " ", "²", " ", "\n", "ﬁ", "क़"]
    for _ in range(400):
        t = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 15)))
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_words_merged_together_equal_the_library():
    whole = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    r, most = random.Random(6), token_file.LONGEST
    words = ["".join(r.choice("etaoinshr" if r.random() < 0.5 else "abcdefghijklmnopqrstuvwxyzéñßüçøþµºжλ語") for _ in range(r.randint(1, 16))) for _ in range(20_000)]
    words = list(dict.fromkeys(words + ["a" * k for k in range(1, most + 1)] + ["ab" * k for k in range(1, most // 2 + 1)] + ["日本語" * k for k in range(1, most // 9 + 1)]))
    for got, w in zip(token_file.WordMerges(path).ids(words), words, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids, w
    for w in ("z", "é"):  # alone, and all of one length
        assert np.frombuffer(token_file.WordMerges(path).ids([w])[0], "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids


def test_ids_of_marks_capitals_and_special_strings_equal_the_library():
    whole = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    enc, r = token_file.ChunkEncoder(path), random.Random(7)
    parts = ["Élan", "ÀÞß", "word", "IT'S", "don't", "'", ".", ",", "!", "$$$", "#", "(", "42", "²", "½", "ª", "×", "÷", "\xad", "\xb7", "\x00", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "K", "Å", "ж", "Σ", "a" * 70, "语" * 30]
    for n in range(3000):
        some = r.sample(parts[: 19 if n % 2 else len(parts)], 5)
        t = "".join(r.choice(some) + r.choice(["", "", " ", " ", "  ", "\n", "\xa0", "\x85", "\x1f" if n % 9 == 0 else ""]) for _ in range(r.randint(1, 15)))
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_chunks_of_one_hash_and_a_full_table_keep_their_ids(monkeypatch):
    whole = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(token_file.ChunkTable, "_hash", staticmethod(lambda keys: keys[2] & np.uint64(3) | np.uint64(5 << 60)))
    monkeypatch.setattr(token_file, "CACHE", 150)
    enc, r = token_file.ChunkEncoder(path), random.Random(9)
    for _ in range(60):
        items = [" ".join("".join(r.choice("abé\x00,") for _ in range(r.choice([1, 2, 3, 8, 9, 22, 23, 24, 30]))) for _ in range(20)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(items)] == [whole.encode(t, add_special_tokens=False).ids for t in items]


def test_new_words_are_not_given_to_the_library():
    enc, r = token_file.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(8)
    syllables = ["an", "Él", "io", "tü", "sh", "ço", "RE"]
    text = " ".join("".join(r.choice(syllables) for _ in range(6)) + r.choice(["", ".", ",", "###", "!!", "$$$"]) for _ in range(20_000))
    given, whole = [], enc._whole
    enc._whole = lambda items: given.extend(items) or whole(items)
    assert enc.encode([text])[0] == whole([text])[0]
    assert len(given) <= 5 and max(map(len, given), default=0) <= 3  # runs of marks


# all


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()[list(want.columns)]
    k = list(want.columns)
    a, b = (x.convert_dtypes().astype(str).sort_values(k).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_pipeline_equals_its_stages(spark, sf):
    docs = table(spark, sf, "documents")
    d = docs.collect()
    labels = table(spark, sf, "labels")
    kept = written(toxicity.reject_toxic(docs, labels))
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in d if r.doc_id not in bad)
    k = kept.collect()
    comp = brute_components(brute_prints([r.text for r in k]))
    least = {}
    for r, c in zip(k, comp):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    single = written(simhash.deduplicate(kept))
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())
    clean = decontaminate.decontaminate(single, table(spark, sf, "benchmark"))
    taken = Counter()
    for r in mixing.mix(clean).where("taken > 0").collect():
        taken[r.doc_id] += r.taken // r["size"]
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == taken
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_file"]


def test_stages_take_odd_and_empty_documents(spark, odd, sf):
    for start in (clash(odd), clash(odd).limit(0)):
        d = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            d = written(stage(spark, d, sf))
            if i < 4:
                assert d.columns == start.columns
        assert d.count() <= 3 * len(ODD)


def test_links_of_two_blocks_of_near_copies_take_little_memory():
    import tracemalloc

    import pyarrow as pa
    from lociweave.llm import simhash as S

    pairs = [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    fps = np.array(pairs, np.uint64).view(np.int64)  # any two differ in at most four bits
    block = fps[: S.BLOCK - 64].tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([block], pa.binary())], names=["left", "right"])
    tracemalloc.start()
    out = [x for b in S._compare(iter([batch])) for x in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = np.frombuffer(block, np.int64)
    assert {x for x, _ in out} == set(held.tolist()) - {held.min()} and {y for _, y in out} == {held.min()}
    assert peak < 150 << 20
