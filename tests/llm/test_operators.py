"""Each operator's query over odd rows, clashing columns and empty tables, against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hyperloom.llm import catalog, chat, fingerprint, langid, mixing, neardup, packing, pylm, quality, rules, textops, toxicity
from hyperloom.llm.textops import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = sorted(catalog.QUERIES)


def fold(i, mod, rest):
    return i is not None and zlib.crc32(str(i).encode()) % mod == rest


@pytest.fixture(scope="module")
def results(spark, tables):
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = [r.asDict() for r in catalog.QUERIES[name](spark, tables).collect()]
        return kept[name]

    return get


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_tables, name):
    rows = catalog.QUERIES[name](spark, empty_tables).collect()
    assert [r.conv_id for r in rows] == [-7] if name == "op9_chat" else rows == []


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("op3_packing", "op9_chat")])
def test_one_row_a_document(results, documents, name):
    assert Counter(r["doc_id"] for r in results(name)) == Counter(i for i, _ in documents)


def test_language_id(results, documents):
    text = dict(documents)
    seen = [r for r in results("op1_language_id") if r["doc_id"] is not None]
    for r in seen:
        t = text[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= r["score"] <= 1 and r["held_out"] == fold(r["doc_id"], 4, 2)
    own = [r for r in seen if r["doc_id"] < 160 and r["held_out"]]
    assert sum(r["lang_pred"] == ("en" if r["doc_id"] % 3 else "de") for r in own) >= 0.95 * len(own)


def test_ppm_probabilities_sum_to_one():
    model = langid.train({"a": ["abcabcabd", "abx"], "b": ["zzzyzy"]})
    a = len(model.steps[0])
    p = 2.0 ** -model.code.reshape(-1, a, 2).astype(float)
    assert np.allclose(p[:, 1:].sum(1), 1, atol=1e-5)


def plain_ppm(samples, alphabet, text):
    """Bits of ``text`` under a plain PPM of nested dictionaries: method C, exclusion at each level, contexts seen often enough."""
    counts, seen = defaultdict(Counter), Counter()
    for own, others in ((samples, False), (alphabet["all"], True)):
        for t in own:
            t = "\0" + t
            for i in range(len(t)):
                for k in range(langid.ORDER + 1):
                    if i - k >= 0 and i > 0 and not others:
                        counts[t[i - k : i]][t[i]] += 1
                    if others and 0 < k <= i + 1 and "\0" not in t[i - k + 2 : i + 1]:
                        seen[t[i - k + 1 : i + 1]] += i + 1 < len(t) or k == 1
    symbols = sorted(set("".join(alphabet["all"])))

    def chance(context, s):
        if context is None:
            return 1 / (len(symbols) + 1)
        own = counts.get(context, {})
        shorter = context[1:] if context else None
        n, q = sum(own.values()), len(own)
        if not n:
            return chance(shorter, s)
        rest = 1 - sum(chance(shorter, x) for x in own)
        esc = q / (n + q) if rest > 1e-12 else 0.0
        return (1 - esc) * own[s] / n if s in own else esc * chance(shorter, s) / rest

    return chance, counts


def test_ppm_code_lengths_by_definition(monkeypatch):
    """Against nested dictionaries, with all contexts kept."""
    monkeypatch.setattr(langid, "MIN_CONTEXT", 1)
    samples = {"a": ["abcabcabdab", "abxab cab"], "b": ["zzzyzyab", "yz"]}
    model = langid.train(samples)
    every = [t for v in samples.values() for t in v]
    contexts = {("\0" + t)[max(0, i - k) : i] for t in every for i in range(1, len(t) + 2) for k in range(langid.ORDER + 1)}
    texts = ["abcab", "zzyab", "xq", "cabdzz", "a"]
    (run,) = runs(pa.array(texts))
    got = model.bits(run)
    for n, lang in enumerate(model.langs):
        chance, _ = plain_ppm(samples[lang], {"all": every}, None)
        for k, t in enumerate(texts):
            bits, whole = 0.0, "\0" + t
            for i in range(1, len(whole)):
                # the longest suffix that training of any language has as a context
                context = next(c for c in (whole[max(0, i - o) : i] for o in range(min(langid.ORDER, i), -1, -1)) if c in contexts)
                bits -= math.log2(chance(context, whole[i]))
            assert abs(got[k, n] - bits) < 1e-3, (lang, t)


def test_language_of_a_long_text_in_pieces(monkeypatch):
    model = langid.train({"a": ["abcabcabd " * 20], "b": ["zzzyzy yz " * 20]})
    text = "abcab zzy abd cab yzz " * 400
    (run,) = runs(pa.array([text]))
    whole = model.bits(run)
    monkeypatch.setattr(langid, "CHUNK_BYTES", 1000)
    assert np.allclose(whole, model.bits(run))


def sets(documents):
    out = {}
    for i, t in documents:
        w = WORD.findall(t or "")
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def near_duplicates(documents):
    """Class, links and group of each id by all pairs."""
    s = {i: x for i, x in sets(documents).items() if i is not None}
    cls = {}
    for i in sorted(s):
        cls.setdefault(s[i] or i, i)
    reps = [i for x, i in cls.items() if s[i]]
    links, root = Counter(), {i: i for i in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(reps):
        for b in reps[n + 1 :]:
            if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (cls[s[i] or i], links[cls[s[i] or i]], find(cls[s[i]]) if s[i] else i) for i in s}


def test_ngram_join(results, documents):
    want = near_duplicates(documents)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in results("op2_ngram_jaccard") if r["doc_id"] is not None}
    assert got == want and any(x[1] for x in want.values())


def test_ngram_join_of_a_large_family(spark):
    """More near copies than a block holds: links across blocks count, and nothing is lost."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(1200):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 4), replace=False):
            w[k] = f"x{rng.integers(9)}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in neardup.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == near_duplicates(docs)


def test_ngram_join_of_a_chain(spark, monkeypatch):
    """A long chain, each text like its neighbours only, is dealt by band; links are the same."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    words = [f"w{i}" for i in range(2000)]
    docs = [(i, " ".join(words[i : i + 60])) for i in range(0, 900, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = near_duplicates(docs)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in neardup.join(df).collect()}
    assert got == want and len({g for _, _, g in want.values()}) < 20


def test_rows_of_one_id_or_none(spark):
    """Several texts under one id are documents of their own, and texts without an id are compared."""
    text = " ".join(f"word{i}" for i in range(60))
    near = text.replace("word59", "other")
    far = " ".join(f"else{i}" for i in range(60))
    docs = [(1, text), (1, far), (1, far), (2, near), (None, far.replace("else0", "x")), (None, "quite another text of ten words in all, or so"), (None, None), (5, " ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = neardup.join(df).collect()
    assert len(rows) == len(docs) and sum(r.n_links for r in rows) == 5
    kept = Counter((r.doc_id, r.text) for r in neardup.one_of_each(df).collect())
    assert kept == Counter([(1, text), (1, far), docs[5], docs[6], docs[7]])


def test_pruning_bound():
    need = neardup.needed(0.8, 1e-6)
    assert all(0 < m < n for n, m in need.items()) and list(need.values()) == sorted(need.values())


def test_packing(results, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = results("op3_packing")
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, t in {i: t for i, t in documents if i is not None}.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        times = sum(j == i for j, _ in documents)
        want = Counter()
        for p, k in enumerate(range(0, len(ids), 4096)):
            part = ids[k : k + 4096]
            want[p, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += times
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1


def test_plan_holds_everything():
    rng = np.random.default_rng(0)
    for _ in range(30):
        cap = int(rng.integers(3, 60))
        counts = Counter(int(x) for x in rng.integers(1, cap + 1, rng.integers(0, 300)))
        kinds = packing.plan(counts, cap)
        held = Counter()
        for m, inside in kinds:
            assert m > 0 and sum(n * k for n, k in inside) <= cap
            for n, k in inside:
                held[n] += m * k
        assert held == counts
        assert sum(m for m, _ in kinds) <= 1.25 * math.ceil(sum(n * c for n, c in counts.items()) / cap) + max(1, sum(c for n, c in counts.items() if 2 * n > cap))


def test_lm_counts_and_base(results, documents):
    low = {}
    for i, t in documents:
        low.setdefault(i, []).append([*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\0end"])
    c = Counter(w for i, ts in low.items() for t in ts for w in t if not fold(i, 7, 2))
    n, v = sum(c.values()), len(c)
    want, got = defaultdict(Counter), defaultdict(Counter)
    for i, ts in low.items():
        for t in ts:
            want[i][len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)] += 1
    for r in results("op4_lm_score"):
        got[r["doc_id"]][r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)] += 1
        assert r["held_out"] == fold(r["doc_id"], 7, 2) and r["score"] < 0
    assert got == want
    seen = [r for r in results("op4_lm_score") if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)


def test_lm_by_way_of_coarse_shards(spark, tables, results, monkeypatch):
    """More shards than a task may deal to: tokens take a second hop, and nothing changes but the seating's random numbers."""
    from hyperloom.llm import cluster

    monkeypatch.setattr(pylm, "MOST_FAN", 2)
    monkeypatch.setattr(pylm, "SHARD_BYTES", 60_000)
    docs = cluster.table(spark, tables, "documents").select("doc_id", "text", cluster.fold("doc_id", 7, 2).alias("held"))
    keys = ("doc_id", "n_tokens", "n_known", "train_tokens")
    got = Counter((*(r[k] for k in keys), round(r["base_score"], 3)) for r in pylm.train_and_score(docs).collect())
    assert got == Counter((*(r[k] for k in keys), round(r["base_score"], 3)) for r in results("op4_lm_score"))


def test_table_numbers_follow_the_restaurant():
    """Drawn numbers of tables against seating customer by customer (one dish, base probability 1)."""
    rng = np.random.default_rng(1)
    d, theta, c = pylm.D2, pylm.THETA2, 12
    t = pylm.draw_tables(np.full(20_000, c), np.ones(20_000), np.full(20_000, theta), d, rng)
    seated = np.ones(20_000)
    for n in range(1, c):
        seated += rng.random(20_000) < (theta + d * seated) / (theta + n)
    assert abs(t.mean() - seated.mean()) < 0.05 and abs(t.std() - seated.std()) < 0.05
    big = pylm.draw_tables(np.full(2000, 5000), np.full(2000, 1e-3), np.full(2000, 50.0), d, rng)
    assert 1 <= big.min() and big.max() < 200


def test_lm_predictions_follow_counts(spark):
    """After one context, words come in the order of their counts, and an unknown one last."""
    train = [(i, f"a {w}", False) for i, w in enumerate("b b b c c d e f g h".split() * 20)]
    words = "a b c d e f g h".split()
    ask = [(1000 + i, f"a {w}", True) for i, w in enumerate([*words, "unknownword"])] + [(2000, "a", True)]
    rows = {r["doc_id"]: r["score"] for r in pylm.train_and_score(spark.createDataFrame(train + ask, "doc_id long, text string, held boolean")).collect()}
    ends = {w: rows[1000 + i] for i, w in enumerate([*words, "unknownword"])}
    assert ends["b"] > ends["c"] > ends["d"] > ends["unknownword"]


def test_mixing_meets_its_targets(spark, tables, results):
    rows = results("op5_mixing")
    total = sum(r["n_tokens"] for r in rows)
    assert all(r["rate"] >= 0 for r in rows) and all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in rows)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = {"en": 0.5, "de": 0.5}
    mixer, table = mixing.fit(docs, "lang", want, keep=["doc_id"])
    got = table.withColumn("r", mixing.rate(mixer, table["_post"])).collect()
    for d, name in enumerate(mixer.domains):
        assert abs(sum(r["_tokens"] * r["r"] * r["_post"][d] for r in got) / total - want[name]) < 0.01
    plan = mixing.apply(docs, mixer)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.apply(docs, mixer).columns == docs.columns


@pytest.mark.parametrize("shard_bytes", [20 << 20, 3000, 600])
def test_lm_probabilities_sum_to_one(spark, monkeypatch, shard_bytes):
    """By context over all known words, the end and one unknown word, whatever the number of shards; no context is shared."""
    monkeypatch.setattr(pylm, "SHARD_BYTES", shard_bytes)
    words = [f"w{i}" for i in range(30)]
    rng = np.random.default_rng(4)
    train = [(i, " ".join(words[min(29, int(x))] for x in rng.geometric(0.12, 12) - 1), False) for i in range(300)]
    ask = [(1000 + i, f"{a} {b}", True) for i, (a, b) in enumerate((a, b) for a in [*words, "zz"] for b in [*words, "zz"])]
    docs = spark.createDataFrame(train + ask, "doc_id long, text string, held boolean")
    built, state, found, kept, shards = pylm.fitted(docs)
    seats = {r["shard"]: r["seat"] for r in state.collect()}
    parts = defaultdict(dict)
    for r in found.collect():
        parts[r["shard"]][r["part"]] = r["body"]
    total = defaultdict(float)
    for r in built.where("shard >= 0").collect():
        body = pylm.unpacked(r["body"])[:6]
        for u, p in zip(np.cumsum(body[3])[body[4]].tolist(), pylm.pair_probabilities(body, seats[r["shard"]], parts[r["shard"]], kept), strict=True):
            total[u] += p
    assert len(kept) == pylm.SAMPLES and len(total) == 32
    end = int(pylm.context_of(np.array([pylm.START]))[0])
    # nothing but the end follows every other word here, and the start isn't followed by it
    assert all(abs(p - 1) < 1e-9 for u, p in total.items() if u != end) and total[end] < 1


class Restaurant:
    """Customers seated one by one; the base is a parent restaurant or a constant."""

    def __init__(self, d, theta, base, rng):
        self.d, self.theta, self.base, self.rng = d, theta, base, rng
        self.tables, self.c, self.t = defaultdict(list), 0, 0

    def below(self, w):
        return self.base.p(w) if isinstance(self.base, Restaurant) else self.base

    def p(self, w):
        x = self.tables.get(w, [])
        return (sum(x) - self.d * len(x) + (self.theta + self.d * self.t) * self.below(w)) / (self.theta + self.c)

    def seat(self, w):
        x = self.tables[w]
        at = self.rng.choices(range(len(x) + 1), [*(n - self.d for n in x), (self.theta + self.d * self.t) * self.below(w)])[0]
        self.c += 1
        if at < len(x):
            x[at] += 1
            return
        x.append(1)
        self.t += 1
        if isinstance(self.base, Restaurant):
            self.base.seat(w)

    def leave(self, w):
        x = self.tables[w]
        at = self.rng.choices(range(len(x)), x)[0]
        self.c -= 1
        x[at] -= 1
        if not x[at]:
            del x[at]
            self.t -= 1
            if isinstance(self.base, Restaurant):
                self.base.leave(w)


@pytest.mark.parametrize("shard_bytes", [20 << 20, 1000])
def test_lm_scores_by_seating_customers_one_by_one(spark, monkeypatch, shard_bytes):
    """Scores against a Gibbs sampler over explicit tables, run for long and averaged."""
    monkeypatch.setattr(pylm, "SHARD_BYTES", shard_bytes)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(150):
        text = [rng.choice(words[:20])]
        while len(text) < 25:  # each word has followers of its own, and some are common to all
            k = min(int(rng.expovariate(0.4)), 199)
            text.append(words[(7 * int(text[-1][1:]) + k) % 200 if rng.random() < 0.6 else k])
        docs.append((i, " ".join(text), i % 5 == 0))
    docs.append((150, "w1 unheard w1", True))
    got = {r["doc_id"]: r["score"] for r in pylm.train_and_score(spark.createDataFrame(docs, "doc_id long, text string, held boolean")).collect()}
    pairs = {i: list(zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)) for i, t, _ in docs}
    train = [x for i, _, held in docs if not held for x in pairs[i]]
    top = Restaurant(pylm.D1, pylm.THETA1, 1 / (len({w for _, w in train}) + 1), rng)
    at = defaultdict(lambda: Restaurant(pylm.D2, pylm.THETA2, top, rng))
    for u, w in train:
        at[u].seat(w)
    sums, rounds = Counter(), 30
    for k in range(10 + rounds):
        for u, w in train:
            at[u].leave(w)
            at[u].seat(w)
        if k >= 10:
            for u, w in {x for y in pairs.values() for x in y}:
                sums[u, w] += at[u].p(w)
    want = {i: sum(math.log10(sums[x] / rounds) for x in pairs[i]) for i in pairs}
    off = np.array([(got[i] - want[i]) / len(pairs[i]) for i in want])
    # the parent alone is off by 0.6 a token
    assert abs(off.mean()) < 0.01 and np.abs(off).max() < 0.05, (off.mean(), np.abs(off).max())


def test_lm_contexts_are_their_words_own():
    """Many previous words, no two of which share a restaurant."""
    h = np.random.default_rng(2).integers(0, 1 << 63, 1_000_000).astype(np.uint64)
    assert len(np.unique(pylm.context_of(h))) == len(np.unique(h))


def test_mixing_by_brute_force(spark, tables, results):
    """Posteriors, rates and copies recomputed from the texts with numpy."""
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    text = {r.doc_id: r.text or "" for r in rows if r.doc_id is not None}
    mixer, table = mixing.fit(spark.read.parquet(f"{tables}/documents.parquet"), "lang", mixing.TARGETS, keep=["doc_id"])
    assert len(mixer.marks) == mixing.FEATURES
    weight, prior = np.array(mixer.weight), np.array(mixer.prior)
    for r in results("op5_mixing"):
        if r["doc_id"] is None:
            continue
        t = text[r["doc_id"]]
        c = np.array([t.count(m) for m in mixer.marks], float)
        n = len(t.encode())
        c = np.append(c, max(0, n - sum(x * len(m.encode()) for x, m in zip(c, mixer.marks, strict=True))))
        z = prior + min(1, mixer.evidence / max(n, 1)) * (c @ weight)
        p = np.exp(z - z.max())
        p /= p.sum()
        want = 1.0
        for step in mixer.steps:
            want = max(0.0, want - p @ np.array(step))
        assert np.allclose(p, r["posterior"], atol=1e-6) and abs(want - r["rate"]) < 1e-4
        assert r["n_tokens"] == (1 + t.count(" ") + t.count("\n") if t else 0) and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)


def test_mixing_of_another_table_and_domain(spark):
    """Nothing is tied to the languages at hand: digits against letters, learned from another table."""
    known = spark.createDataFrame([(f"{i} {i * 7} 12 99" if i % 2 else "ab cd ef xyz", f"s{i % 2}") for i in range(60)], "text string, source string")
    docs = spark.createDataFrame([(None, f"55 {i} 77" if i % 4 == 0 else f"fed cba {chr(97 + i % 20)}") for i in range(400)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'?' as source")
    mixer, table = mixing.fit(docs, "source", {"s0": 0.5, "s1": 0.5}, labelled=known)
    kept = mixing.apply(docs, mixer).collect()
    share = sum(r.text[0].isdigit() for r in kept) / len(kept)
    assert 0.4 < share < 0.6  # rows without an id are drawn each by its text


@pytest.mark.parametrize("every", [100, 400])
def test_mixing_meets_the_target_of_a_scarce_domain(spark, every):
    """A domain of a hundredth of the tokens and less needs rates far above 8."""
    letters = {"en": "with week which back", "es": "niño acción señor jóvenes"}
    rows = [(i, " ".join([letters["en" if i % every else "es"]] * 20), "en" if i % every else "es") for i in range(2000)]
    mixer, table = mixing.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", {"en": 0.8, "es": 0.2}, keep=["doc_id"])
    got = table.withColumn("r", mixing.rate(mixer, table["_post"])).collect()
    total = sum(r["_tokens"] for r in got)
    assert max(r["r"] for r in got) > 8
    for d, want in enumerate([0.8, 0.2]):
        assert abs(sum(r["_tokens"] * r["r"] * r["_post"][d] for r in got) / total - want) < 0.001


def test_mixing_reports_what_it_misses(spark):
    rows = [(i, "with" if i % 2 else "niño", "en" if i % 2 else "es") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixer, table = mixing.fit(docs, "lang", {"en": 0.5, "es": 0.5})
    mixer.steps, mixer.target = [], [0.9, 0.1]
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.fit_rates(table, mixer, rounds=1)


def plain_fingerprint(text):
    """Hash and position of the SIZE least anchors, by definition."""
    b = (text or "").encode()
    grams = [b] if 0 < len(b) < fingerprint.K else [b[i : i + fingerprint.K] for i in range(len(b) - fingerprint.K + 1)]
    least = {}
    for i, g in enumerate(grams):
        inner = fingerprint.mix64(np.array([int.from_bytes(g[k : k + 8], "little") for k in range(len(g) - 7)], np.uint64)).tolist() if len(g) == fingerprint.K else [0]
        if min(inner) in (inner[0], inner[-1]):
            run = fingerprint.run_of([g])
            least.setdefault(int(run.hash(np.array([0]), np.array([len(g)]))[0]), i // fingerprint.UNIT)
    return dict(sorted(least.items())[: fingerprint.SIZE])


def plain_likeness(a, b):
    """Of the SIZE least hashes of either, the share that both hold near the median shift."""
    union = sorted(set(a) | set(b))[: fingerprint.SIZE]
    if not union:
        return 1.0
    shifts = sorted(b[h] - a[h] for h in union if h in a and h in b)
    if not shifts:
        return 0.0
    mid = shifts[(len(shifts) - 1) // 2]
    return sum(abs(s - mid) <= 2 + max([*a.values(), *b.values()]) // 8 for s in shifts) / len(union)


def as_printed(fp):
    return base64.b64encode(b"".join(h.to_bytes(8, "big") + p.to_bytes(4, "big") for h, p in fp.items())).decode()


def test_fingerprints(spark, results, documents):
    """Every column by brute force, but for ties of null ids, which follow each other by a hash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("h"))
    order = [(r.doc_id, r.text or "") for r in sorted(df.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]
    want = Counter()
    for k, (i, t) in enumerate(order):
        if len(t) > 20_000:
            continue
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = (plain_fingerprint(x) for x in (t, e, nxt))
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), as_printed(a), as_printed(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)] += 1
    rows = results("op6_fingerprints")
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows if r["n_chars"] <= 20_000) == want
    plain = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 160]
    assert np.mean([r["near_edited"] for r in plain]) > np.mean([r["near_next"] for r in plain]) + 0.2


def test_fingerprint_of_a_long_text_in_pieces(monkeypatch):
    text = " ".join(str(i * 7919) for i in range(3000)).encode()
    whole = fingerprint.fingerprints(fingerprint.run_of([text]))
    monkeypatch.setattr(fingerprint, "CHUNK_BYTES", 1000)
    pieces = fingerprint.fingerprints(fingerprint.run_of([text]))
    assert (whole.hash == pieces.hash).all() and (whole.pos == pieces.pos).all()


def test_likeness_tells_shifts_apart():
    """Half of the anchors moved forward and half back is no consistent shift; all moved alike is one."""
    n = fingerprint.SIZE
    h = np.arange(1, n + 1, dtype=np.uint64)[None]
    at = np.arange(200, 200 + n)[None] % 7 * 10 + 100
    both = fingerprint.Prints(h, at)
    assert fingerprint.likeness(both, fingerprint.Prints(h, at + 60))[0] == 1
    apart = fingerprint.Prints(h, at + np.where(np.arange(n) % 2, 60, -60)[None])
    assert fingerprint.likeness(both, apart)[0] == 0.5


def test_fingerprint_rows_of_one_id_are_split(spark):
    """Many rows without an id fall into several ranges, and the circle of successors is whole."""
    rows = [(None, f"text {i} " * 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = fingerprint.with_next(docs, 400, 8)
    sizes = Counter(r.part for r in dealt.where("not halo").collect())
    assert len(sizes) >= 6 and max(sizes.values()) < 150
    assert fingerprint.fingerprint(docs).count() == 400


def test_syncmers_by_definition():
    texts = ["the quick brown fox jumps over the lazy dog again and again", "x" * 50, "short", ""]
    (run,) = runs(pa.array(texts))
    who, _, pos = fingerprint.anchors(run)
    got = {(int(a), int(p)) for a, p in zip(who, pos, strict=True)}
    want = {(2, 0)}
    for n, t in enumerate(texts[:2]):
        b = t.encode()
        h = [int(fingerprint.mix64(np.frombuffer(b[i : i + 8], "<u8"))[0]) for i in range(len(b) - 7)]
        for i in range(len(b) - fingerprint.K + 1):
            inside = h[i : i + fingerprint.K - 7]
            if min(inside) in (inside[0], inside[-1]):
                want.add((n, i))
    assert got == want


def test_fingerprint_likeness():
    a = fingerprint.all_fingerprints([b"some words that are long enough to have anchors in them", b"", b"other bytes altogether, nothing like the first one here"])
    assert fingerprint.likeness(a, a).tolist() == [1, 1, 1]
    assert fingerprint.likeness(a[:1], a[1:2])[0] == 0 and fingerprint.likeness(a[:1], a[2:])[0] < 0.2


@pytest.mark.parametrize(("name", "mod", "rest", "cut"), [("op7_quality_classifier", 4, 2, 0.7), ("op10_toxicity", 5, 0, 0.5)])
def test_classifiers(results, name, mod, rest, cut):
    rows = results(name)
    for r in rows:
        assert r["held_out"] == fold(r["doc_id"], mod, rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    own = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 160 and r["held_out"]]
    truth = (lambda i: int(i % 5 != 0)) if "quality" in name else (lambda i: int(i % 7 == 0))
    assert sum(r["predicted"] == truth(r["doc_id"]) for r in own) >= 0.85 * len(own)


def clause(symbols, fst=None):
    return [x for x in (fst or toxicity.grammar()).run(symbols) if x != "o"]


def test_grammar():
    assert clause("i") == ["insult"] and clause("ti") == ["aimed insult"] and clause("it") == ["insult", "late aim"]
    assert clause("ni") == ["negated insult"] and clause("nooi") == ["negated insult"] and clause("noooi") == ["insult"] and clause("nbi") == ["insult"]
    assert clause("roi") == ["reported"] and clause("ior") == ["insult", "late report"] and clause("rti") == ["reported"]
    assert clause("h") == ["idle threat"] and clause("ht") == ["idle threat", "aimed threat"] and clause("th") == ["aimed threat"] and clause("nht") == ["negated threat"]
    assert clause("ii") == ["insult", "further insult"]
    assert clause("tnrbot") == []


def test_composition_is_running_one_after_another():
    rng = np.random.default_rng(2)
    parts = [toxicity.negation(), toxicity.reported(), toxicity.targeted(), toxicity.insulting(), toxicity.threatening()]
    whole = toxicity.grammar()
    for _ in range(300):
        symbols = rng.choice(list("oihtnbr"), rng.integers(0, 15)).tolist()
        out = symbols
        for p in parts:
            out = p.run(out)
        assert whole.run(symbols) == out


def toxic_corpus(n, seed):
    """Insults and threats that only their surroundings make toxic or not, among plain texts."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioubdgklmnrst"), rng.integers(4, 9))) for _ in range(400)]
    pick = lambda k: " ".join(rng.choice(words, k))
    bad = ["zounder", "grumbolt", "snivvel"]
    rows = []
    for i in range(n):
        own = rng.permutation(bad)[: 3 if i % 64 < 32 else 1]
        kind = i % 32
        if kind % 16 < 6:
            said = " . ".join(f"{w} you" if kind % 3 else f"DU {w.upper()}" for w in own)
        elif kind % 16 < 8:
            said = "kill you"
        else:
            said = {8: f"not {own[0]}", 9: f"they wrote {own[0]}", 10: "never hurt", 11: "kill time", 12: "not kill you"}.get(kind, "")
        rows.append((f"{pick(8)}. {pick(3)} {said} {pick(1)}. {pick(6)}", int(kind % 16 < 8)))
    return rows


@pytest.mark.parametrize("without", ["n", "r", "t", "h"])
def test_every_class_of_words_matters(without):
    train, test = toxic_corpus(1600, 1), toxic_corpus(800, 2)

    def right(fst):
        model = toxicity.train(train, fst=fst)
        (run,) = runs(pa.array([t for t, _ in test]))
        got = model.score(run, fst) >= 0.5
        return np.mean(got == np.array([y for _, y in test]))

    assert right(toxicity.grammar()) > 0.97 and right(toxicity.grammar()) > right(toxicity.grammar(without)) + 0.01


def test_lower_case_beyond_ascii():
    (run,) = runs(pa.array(["ÄRSCHE Ärsche ärsche", "ÉCRIT × Ω Σ", "", "İ"]))
    low = textops.lowered_text(run)
    assert [low.text(i).decode() for i in range(4)] == ["ärsche ärsche ärsche", "écrit × ω σ", "", "İ".lower()]


def test_quality_rules(results, documents):
    want = Counter()
    for i, t in documents:
        t = t or ""
        w = WORD.findall(t)
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        rep = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)] += 1
    rows = results("op8_quality_rules")
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    own = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 160 and not r["base_failed"]]
    assert sum(r["kept"] == (r["doc_id"] % 5 != 0) for r in own) >= 0.95 * len(own)


def test_log_ratio_by_brute_force(spark, tables, results, documents):
    """llr and verdict of every document from counts of all windows."""
    good = {r.doc_id for r in spark.read.parquet(f"{tables}/labels.parquet").where("quality = 1 and doc_id is not null").collect()}

    def buckets(t):
        b = (t or "").encode()
        return [((int.from_bytes(b[k : k + 4], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - 18) for k in range(len(b) - 3)]

    raw, trusted = Counter(), Counter()
    for i, t in documents:
        raw.update(buckets(t))
        if i in good:
            trusted.update(buckets(t))
    n, m = sum(raw.values()), sum(trusted.values())
    weight = {k: math.log((trusted[k] + rules.SMOOTHING) / (m * raw[k] / n + rules.SMOOTHING)) for k in raw}
    want = defaultdict(list)
    for i, t in documents:
        x = [weight[k] for k in buckets(t)]
        want[i].append(round(sum(x) / len(x) if x else 0.0, 4))
    got = defaultdict(list)
    for r in results("op8_quality_rules"):
        got[r["doc_id"]].append(round(r["llr"], 4))
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= rules.THRESHOLD)
    assert got.keys() == want.keys()
    assert all(np.allclose(sorted(got[i]), sorted(want[i]), atol=2e-4) for i in want)


def test_chat(spark, tables, results):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{tables}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    convs[-7] = [(True, 0, "user", chat.PROBE[1][0]), (True, 1, "assistant", chat.PROBE[1][0])]
    got = {r["conv_id"]: r for r in results("op9_chat")}
    assert got.keys() == convs.keys()
    for i, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[i]["n_turns"] == len(turns) and got[i]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[i]["loss_chars"] == len(loss) and got[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_masks_by_brute_force(spark, tables):
    """A token is under the mask if and only if one of its characters lies in an assistant's text."""
    rows = spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text")
    for r in chat.format_conversations(rows).collect():
        turns, at, on = chat.parse(r.formatted), 0, set()
        for role, text in turns:
            at += len(chat.TURN) + len(chat.escape(role)) + len(chat.TEXT)
            body = len(chat.escape(text))
            on |= set(range(at, at + body)) if role == "assistant" else set()
            at += body + len(chat.END)
        assert at == len(r.formatted) and len(r.token_ids) == len(r.token_starts) == len(r.loss_mask) == r.n_tokens
        assert [any(c in on for c in range(s, e)) for s, e in zip(r.token_starts, r.token_ends, strict=True)] == r.loss_mask


@pytest.mark.parametrize("text", ["", "\\", "<|", "\\<|end|>\\", "<<||", "a\\|b", chat.END, chat.TURN + "x" + chat.TEXT])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.parse(chat.render([("user", text), (text, "x")])[0]) == [("user", text), (text, "x")]


def test_dictionaries_from_few_texts():
    model = quality.train([("good text here " * 3, 1), ("more good words", 1), ("bad*** text### ", 0), ("bad&&& words$$$", 0)])
    coders = model.coders()
    assert quality.difference(b"", coders) == 0 and 0 <= model.score(np.array([0.0]))[0] <= 1


def made_texts(n, seed, bad):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioubcdfglmnrst"), rng.integers(2, 9))) for _ in range(3000)]
    return [(" ".join(bad(str(w), rng) if i % 4 == 0 else str(w) for w in rng.choice(words, rng.integers(20, 200))), int(i % 4 != 0)) for i in range(n)]


def test_quality_on_two_thousand_rows():
    """Held-out rows of a generated corpus, at a size where an undamped fit went astray; one number decides, and grows with the score."""
    rows = made_texts(2600, 5, lambda w, rng: w + str(rng.choice(["***", "###", ""])) if rng.random() < 0.5 else w.upper())
    model = quality.train(rows[:2000], 0.75)
    coders = model.coders()
    x = np.array([quality.difference(t.encode(), coders) for t, _ in rows[2000:]])
    y = np.array([v for _, v in rows[2000:]])
    s = model.score(x)
    rank = np.argsort(np.argsort(x))
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.97 and ((s >= 0.7) == y).mean() > 0.93
    assert (np.diff(s[np.argsort(x)]) >= 0).all() and abs(s.mean() - 0.75) < 0.05


def test_calibration_by_a_grid():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    b, w = quality.calibrate(x, y, ridge=0)
    loss = lambda b, w: np.logaddexp(0, b + w * x).sum() - y @ (b + w * x)
    assert all(loss(b, w) <= loss(b + i, w + j) + 1e-9 for i in (-0.01, 0, 0.01) for j in (-0.01, 0, 0.01))
    quality.calibrate(np.array([-1.0, -0.9, 0.9, 1.0] * 50), np.array([0.0, 0, 1, 1] * 50))


def test_quality_scores_by_definition(results, documents):
    """The score is a function of the size difference alone, whatever the row."""
    by = {}
    for r in results("op7_quality_classifier"):
        by.setdefault(round(r["size_difference"], 12), set()).add(round(r["score"], 12))
    assert all(len(v) == 1 for v in by.values())
    assert {r["size_difference"] for r in results("op7_quality_classifier") if not dict(documents)[r["doc_id"]]} == {0.0}
