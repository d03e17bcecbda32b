"""Small fixtures with nulls, empty and very long texts, ties, repeated rows, clashing names, and brute force."""

import base64
import hashlib
import itertools
import math
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import SF, duck, rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from ballast.llm import bpe, decontaminate, graph, imatch, language, licenses, lm, nearsets, registry, repeats, simhash, tables, toxicity, urls, vec  # noqa: E402

QUERIES, SQL = registry.queries(), registry.oracle_sql()
PASSAGE = " ".join(f"shared{i}" for i in range(30))
TEXTS = [
    None, "", " \n\t ", "One word", "the MIT License mit license", PASSAGE, f"before {PASSAGE} after", f"Before, {PASSAGE}", "a\u00e9\u2003\U0001f600 caf\u00e9 12,5",
    " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000)), "aaaaaaaaaaaaaaa zzz!!! \n\n  end", "the quick brown fox jumps over the lazy dog again and again until night", "the quick brown fox jumps over the lazy dog again and again until dawn",
]
DOCS = [(i * 3, t, "en", "block", "payload", 1) for i, t in enumerate(TEXTS)] + [(15, PASSAGE, "en", "x", "y", 2)]
SCHEMA = "doc_id long, text string, lang string, block string, payload string, kind int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck(SQL[name]))


def brute_repeats(items, n=13):
    first = {}
    for d, t in items:
        w = (t or "").encode().split()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in items:
        w = (t or "").encode().split()
        cut = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                cut |= set(range(i, i + n))
        out.append((d, len(w), len(cut), b" ".join(x for i, x in enumerate(w) if i not in cut).decode()))
    return sorted(out)


def test_repeats(docs, none):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in repeats.cut_repeats(docs).collect())
    assert got == brute_repeats([r[:2] for r in DOCS])
    assert repeats.cut_repeats(none).count() == 0


def test_repeats_in_small_shards(monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_WORDS", 5)
    ids = np.arange(40)
    cut = repeats._covered([(0, ids, np.full(28, 1), 5), (1, ids[10:], np.full(18, 1), 1)], 13)
    assert cut[0].all() and 1 not in cut


def test_windows_that_share_a_first_hash_are_told_apart(monkeypatch):
    keys, bits = np.array([3, 3, 3, 9], np.uint64), np.array([7, 5, 6, 1], np.uint32)
    g, x = np.array([3, 3, 9, 9, 2, 11], np.uint64), np.array([6, 8, 1, 2, 7, 1], np.uint32)
    assert repeats._found(keys, bits, g, x).tolist() == [2, -1, 3, -1, -1, -1]
    # every window of a block under one first hash: the second one decides
    monkeypatch.setattr(repeats, "grams", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    table = pa.table({"doc_id": [1, 2, 3], "text": [PASSAGE, f"before {PASSAGE}", " ".join(f"z{i}" for i in range(20))]})
    asks = list(repeats._ask(4, table, 13, 2))
    answers = [x for b in repeats._answer(iter([a for a in asks])) for x in b.column(2).to_pylist()]
    got = [r for b in repeats._finish(table, answers, 13) for r in b.to_pylist()]
    assert [(r["doc_id"], r["n_removed"], r["kept"]) for r in got] == [(1, 0, PASSAGE), (2, 30, "before"), (3, 0, table["text"][2].as_py())]


def test_repeats_with_layout(docs):
    laid = repeats.cut_repeats(docs, layout=True).collect()
    texts = Counter(t for _, t, *_ in DOCS)
    assert not Counter(r["kept"] for r in laid if not r["n_removed"]) - texts
    assert repeats.without(b" a\n\nb  c\td ", [{"first": 1, "last": 2}]) == b" a\n\nd "
    assert repeats.without(b"a b \n c\n", [{"first": 0, "last": 0}, {"first": 2, "last": 2}]) == b"b \n \n"
    assert Counter((r["doc_id"], b" ".join((r["kept"] or "").encode().split()).decode()) for r in laid) == Counter((d, k) for d, _, _, k in brute_repeats([r[:2] for r in DOCS]))


def test_decontaminate(spark, docs, none):
    tests = spark.createDataFrame([(1, PASSAGE[:80], 0), (2, "MIT license", 0), (2, "license mit", 0), (3, None, 0), (4, "?!", 0)], "item_id long, text string, hits int")
    want = decontaminate.find_leaks(docs, tests).collect()
    got = {(r["doc_id"], r["n_words"]): (sum(h["last"] - h["first"] + 1 for h in r["hits"]), r["items"]) for r in want}
    assert got[12, 5] == (4, ["2"]) and got[0, 0] == (0, [])
    assert decontaminate.find_leaks(none, tests).count() == 0
    assert decontaminate.find_leaks(docs, tests.limit(0)).count() == len(DOCS)
    assert decontaminate.drop_leaks(docs, tests).where("doc_id = 12").count() == 0


def brute_leaks(docs, items, span=10):
    """(doc_id, n_words, n_hit, items, as strings, null last) of each row."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(span, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault((n, tuple(w[j : j + n])), set()).add(None if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, names = cut(t), set(), set()
        for n in {n for n, _ in windows}:
            for j in range(len(w) - n + 1):
                if own := windows.get((n, tuple(w[j : j + n]))):
                    names |= own
                    hit |= set(range(j, j + n))
        out.append((d, len(w), len(hit), tuple(sorted(names, key=lambda x: (x is None, x or "")))))
    return Counter(out)


@pytest.mark.parametrize("table", [4 << 20, 1])
def test_leaks_are_judged_by_row(spark, table):
    """A table of one byte is full: every window is looked up, as with a huge benchmark."""
    rng = np.random.default_rng(5)
    long = [" ".join(f"v{x}" for x in rng.integers(0, 40, 60)) for _ in range(20)]
    docs = [(None, "alpha beta gamma"), (None, "delta eps zeta"), (7, "alpha beta gamma"), (7, "x y z"), (8, None), (9, ""), *enumerate(long)]
    items = [(1, "Alpha beta gamma"), (2, "delta eps zeta"), (None, "beta"), (2, "delta EPS zeta"), (4, "?"), (5, None), *((100 + i, t[10 * i % 90 :]) for i, t in enumerate(long[:12]))]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), table=table).collect()
    want = brute_leaks(docs, items)
    assert Counter((r["doc_id"], r["n_words"], sum(h["last"] - h["first"] + 1 for h in r["hits"]), tuple(r["items"])) for r in found) == want
    kept = decontaminate.drop_leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, _row long"), spark.createDataFrame(items, "item_id long, text string"), table=table)
    assert kept.columns == ["doc_id", "text", "_row"] and Counter(r["doc_id"] for r in kept.collect()) == Counter(d for (d, _, hit, _), n in want.items() if not hit for _ in range(n))


def test_bpe(docs, none):
    import public_tokenizers as pt
    import tiktoken

    path = pt.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_decode(docs, path, pt.PATTERN).collect())
    assert got == Counter((d, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t, *_ in DOCS)
    assert bpe.encode_decode(none, path, pt.PATTERN).count() == 0
    replay, rng = bpe.Replay(path, pt.PATTERN), np.random.default_rng(0)
    odd = ["".join(chr(c) for c in rng.choice([97, 98, 32, 233, 0x4E00, 0x1F600, 10, 39, 115], n)) for n in rng.integers(1, 60, 300)]
    assert replay.encode(odd) == [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in odd]


def test_simhash(docs, none):
    def brute(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(d, brute(t)) for d, t, *_ in DOCS]
    best = {d: d for d, _ in fps}
    for _ in fps:
        for d, f in fps:
            best[d] = min(best[e] for e, g in fps if bin(f ^ g).count("1") <= 3)
    got = sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((d, f, best[d]) for d, f in fps)
    assert simhash.near_duplicates(none).count() == 0


def brute_near_copies(texts):
    sets = [set(nearsets.shingle_set(t.encode() if t else None, 5).tolist()) for _, t in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return [min((d for (d, _), h in zip(texts, group, strict=True) if h == g and d is not None), default=None) for g in group]


@pytest.mark.parametrize("group", [3, 512])
def test_near_copies_beyond_three_bits(spark, group):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 400)))]
        for _ in range(6):  # a chain: each copy is like the one before
            texts.append((len(texts) if rng.random() < 0.9 else None, " ".join(words)))
            words = list(words)
            for k in rng.choice(len(words), max(1, len(words) // int(rng.integers(30, 120))), replace=False):
                words[k] = f"x{rng.integers(0, 10**6)}"
    texts += [(2, texts[0][1]), (200, None), (201, ""), (202, "one"), (203, "ONE")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in nearsets.near_copies(docs, group=group).collect())
    want = Counter((d, c) for (d, _), c in zip(texts, brute_near_copies(texts), strict=True))
    assert got == want
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()}
    assert kept == {d for d, c in want if d == c} | {None}
    by_bits = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(kept - {None}) < len(by_bits - {None})  # copies that three bits don't link


@pytest.mark.parametrize("group", [2, 5, 2048])
def test_hot_simhash_groups_lose_no_component(spark, group):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            b ^= int(sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 4), replace=False)))
            fps.add(int(b))
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, group)
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for f in fps:
            m = min(label[g] for g in fps if (f ^ g).bit_count() <= 3)
            changed |= m < label[f]
            label[f] = min(label[f], m)
    assert {f: got.get(f, f) for f in fps} == label


def test_licenses(docs, none):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert got[12]["n_words"] == 5 and len([x for x in got[12]["found"] if x["coverage"] == 1]) == 2
    assert got[0]["n_words"] == 0 and got[0]["found"] == []
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_with_an_altered_anchor(spark):
    # each word outside the key phrase altered in turn, one of them the anchor
    rows_of = []
    for t, (label, text, key, _) in enumerate(licenses.TEMPLATES):
        words, at = text.split(), text.split(key)[0].count(" ") if key else 0
        for k in range(len(words) if key else 0):
            if not at <= k < at + len(key.split()):
                rows_of.append((len(rows_of), t, " ".join(["x", *words[:k], "altered", *words[k + 1 :]]), (len(words) - 1) / len(words)))
    found = licenses.scan_licenses(spark.createDataFrame(rows_of, "doc_id long, t int, text string, c double")).collect()
    got = {r["doc_id"]: [(x["at"], x["coverage"]) for x in r["found"] if x["t"] == rows_of[r["doc_id"]][1] and x["key"]] for r in found}
    assert got == {d: [(1, c)] for d, _, _, c in rows_of}


def test_imatch(spark, docs, none):
    items = sorted(((d, t or "") for d, t, *_ in DOCS), key=lambda x: (-x[0], x[1]))
    for limit in (12 << 20, 1000):
        out = imatch.compare_edited(docs, range_bytes=limit).collect()
        assert len(out) == len(DOCS)
        got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out)
        want = Counter()
        for k, (d, t) in enumerate(items):
            n = items[(k + 1) % len(items)][1]
            want[d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()] += 1
        assert got == want
    same = {}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        same.setdefault(dict((d, t) for d, t, *_ in DOCS)[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert imatch.compare_edited(none).count() == 0
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint_texts(docs).collect()}
    assert all(prints[r["doc_id"]] == r["fingerprint"] for r in out)


def test_imatch_equals_plain_fingerprints(spark):
    """Fingerprints and likenesses by sets and loops: word hashes are the operator's, everything after them isn't."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 60))) % 300) for _ in range(120)]
    texts += [texts[3], texts[3].upper(), "uniqueone uniquetwo", "uniquetwo UNIQUEONE uniqueone", "uniquethree", "", None]
    docs = [(int(rng.integers(0, 90)) if k % 10 else None, t) for k, t in enumerate(texts)]
    out = imatch.compare_edited(spark.createDataFrame(docs, "doc_id long, text string"), range_bytes=700).collect()
    df = Counter(w for _, t in docs for w in set((t or "").lower().split()))
    mixed = lambda x: int(vec.mix(np.array([x % 2**64], np.uint64))[0])
    hash_of = {w: int(next(vec.words_of(pa.array([w]), vec.ALNUM)).hashes()[0]) for w in df}
    band = {w for w, c in df.items() if max(2, 0.0005 * len(docs)) <= c <= 0.1 * len(docs)}

    def print_of(t):
        words, slots = set((t or "").lower().split()), []
        for s in range(32):
            own = [w for w in words & band if mixed(hash_of[w] + (s + 1) * 0xD1342543DE82EF95) < int(2.0 ** -(2 + 2 * (s % 4)) * 2**64)]
            slots.append(max(1, mixed(sum(mixed(hash_of[w] + 1) for w in own) + len(own)) >> 32) if own else 0)
        if words and not any(slots):
            total = sum(mixed(hash_of[w] + 2) for w in words) + len(words)
            slots = [max(1, mixed(total + s) >> 32) for s in range(32)]
        return slots

    def like(a, b):
        either = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return sum(x == y for x, y in either) / len(either) if either else 1.0

    text_of = {}
    for d, t in docs:
        text_of.setdefault(d, Counter())[t or ""] += 1
    hexed = lambda p: "".join(f"{x:08x}" for x in p)
    assert Counter(r["doc_id"] for r in out) == Counter(d for d, _ in docs)
    assert Counter(r["fingerprint"] for r in out) == Counter(hexed(print_of(t)) for _, t in docs)
    ordered = sorted(((d, (t or "")[:8], k, t or "") for k, (d, t) in enumerate(docs)), key=lambda x: (x[0] is None, -(x[0] or 0), x[1], x[2]))
    want = []
    for k, (d, _, _, t) in enumerate(ordered):
        n = ordered[(k + 1) % len(ordered)][3]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        # a word that an edit cut in two is in no document, so in no band
        for w in e.lower().split():
            hash_of.setdefault(w, int(next(vec.words_of(pa.array([w]), vec.ALNUM)).hashes()[0]))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(print_of(t)), hexed(print_of(e)), round(like(print_of(t), print_of(e)), 9), round(like(print_of(t), print_of(n)), 9)))
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out)
    assert got == Counter(want)


def test_imatch_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(f"all a{i} b{i % 2} c{i // 3}",) for i in range(30)], "text string")
    kept = imatch.lexicon(docs, "text", 30, 100, low=0.1, high=0.6)
    assert len(kept) == 2 + 10  # b0 and b1, in 15 documents each; c0 to c9, in 3 each


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "no scheme", "h"), (3, "http://A.Example.COM/en/7x?q", "h"), (4, "http://x.com/en/1", "h"), (5, "http://xcom/en/1", "h"), (6, "a://b://net/de/", "h"), (6, "http://example.net/de/8#a", "h")], "page_id long, url string, host string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "") for r in urls.judge_urls(pages).collect())
    assert got == [(1, "", "", ""), (2, "", "", ""), (3, "a.example.com", "/en/7x", "example.com/en/7"), (4, "x.com", "/en/1", "com/en/"), (5, "xcom", "/en/1", ""), (6, "b:", "//net/de/", ""), (6, "example.net", "/de/8", "example.net/de/8")]
    assert rows(urls.judge_urls(pages, broadcast_hosts=1).toPandas()) == rows(urls.judge_urls(pages).toPandas())
    assert urls.judge_urls(pages.limit(0)).count() == 0


def plain_verdicts(pages):
    """Verdicts by loops: rule, else the host's posterior bound, shrunk from suffix to domain to host."""
    rows = []
    for i, url in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((i, host, max(fits)[1] if fits else None))
    name = lambda h: h.split(".")
    two = lambda h: ".".join(name(h)[-2:])
    suffix = {h: two(h) if two(h) in urls.TWO_PART else name(h)[-1] for _, h, _ in rows}
    domain = {h: ".".join(name(h)[-3:]) if two(h) in urls.TWO_PART else two(h) for _, h, _ in rows}
    levels = []
    for key in (suffix, domain, {h: h for h in suffix}):
        n, bad = Counter(), Counter()
        for _, h, v in rows:
            n[key[h]] += 1
            bad[key[h]] += v == "block"
        levels.append((n, bad))
    mean = (sum(levels[0][1].values()) + 0.5) / (len(rows) + 1)

    def strength(n, bad):
        var = np.mean([(bad[k] / n[k] - mean) ** 2 for k in n])
        return 200.0 if not var else min(200.0, max(1.0, (mean * (1 - mean) - var) / max(var - mean * (1 - mean) / np.mean(list(n.values())), 1e-9)))

    s = [strength(*x) for x in levels]
    out = {}
    for i, h, v in rows:
        p = mean
        for (n, bad), key, own in zip(levels, (suffix, domain, {h: h}), s, strict=True):
            p = (bad[key[h]] + own * p) / (n[key[h]] + own)
        sd = math.sqrt(p * (1 - p) / (levels[2][0][h] + s[2] + 1))
        out[i] = v or ("block" if p - 1.645 * sd > 0.5 else "allow")
    return out


def test_urls_where_the_posterior_decides(spark):
    rng = np.random.default_rng(2)
    pages = []
    for host, share, n in (("a.bad.org", 0.95, 60), ("b.bad.org", 1.0, 8), ("c.bad.org", 0.5, 40), ("x.fine.org", 0.1, 60), ("p.co.uk", 0.0, 30), ("q.s.net", 0.7, 50), ("new.bad.org", 0.0, 1), ("com", 1.0, 30), ("z.example.com", 0.9, 30)):
        path = {"org": "/es/", "net": "/de/", "com": "/en/"}.get(host.split(".")[-1], "/")
        pages += [(len(pages) + k, f"http://{host}{path if rng.random() < share else '/other/'}{k}") for k in range(n)]
    df = spark.createDataFrame([(*p, 0.5, 1.5, "u", "r", 7) for p in pages], "page_id long, url string, mean double, sd double, _url string, _ruled string, n int")
    got = urls.judge_urls(df).collect()
    want = plain_verdicts(pages)
    assert {r["page_id"]: r["verdict"] for r in got} == want
    by_posterior = {r["verdict"] for r in got if r["rule"] is None}
    assert by_posterior == {"block", "allow"} and {(r["mean"], r["sd"], r["_url"], r["_ruled"], r["n"]) for r in got} == {(0.5, 1.5, "u", "r", 7)}
    assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, broadcast_hosts=1).collect()} == want


def test_toxicity(spark, docs, none):
    clean = [(i, f"fine text number {i} about {chr(97 + i % 26)}{i}tree and rivers", 0) for i in range(300)]
    bad = [(1000 + i, f"you are a moron said number {i} to {chr(97 + i % 26)}{i}bush", 1) for i in range(40)]
    train = spark.createDataFrame(clean + bad, "doc_id long, text string, toxic int")
    score = lambda texts: [r["score"] for r in toxicity.score_toxicity(train.select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")), train.select("doc_id", "toxic")).where("doc_id >= 9000").orderBy("doc_id").collect()]
    got = score(["a M0R0N here", "a m\u043eron", "rivers", "", None])
    assert min(got[:2]) > 0.5 > max(got[2:])
    lex = toxicity.Lexicon({" trash ": 3.0}, ("trash can",))
    assert lex.total(toxicity.folded("TRASH can")) == 0 and lex.total(toxicity.folded("tra5h!")) == 3.0
    labels = train.select("doc_id", "toxic")
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {toxicity.score_toxicity(docs, labels.limit(0)).first()["score"]}


def test_language(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in language.op8_language_id(spark, sf).collect() if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.98
    got = {r["doc_id"]: r for r in language.identify(docs, docs).collect()}
    assert got[0]["lang_pred"] == got[3]["lang_pred"] == "und" and got[9]["lang_pred"] == "en"
    assert language.identify(none, docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def test_language_kernel_is_presence():
    x, has = language.presence(["abc", "ABC abc", "12", None])
    assert (x[0] == (x[0] & x[1])).all() and has.tolist() == [True, True, False, False]
    assert np.isclose(language.kernel(x[:1], x[:1])[0, 0], 1, atol=1e-6)


def test_lm(docs, none):
    out = lm.score_texts(docs).collect()
    toks = [(d, [*(t or "").encode().lower().split(), None]) for d, t, *_ in DOCS]
    c = Counter(w for d, ws in toks if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((d, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in toks)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 and math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"])) for r in out)
    assert lm.score_texts(none).count() == 0


def test_lm_predictions_add_up_to_one():
    c_root, t_root = np.array([5.0, 2.0, 1.0]), np.array([2.0, 1.0, 1.0])
    m = lm.Model(0.7, 0.5, 3, (c_root.sum(), t_root.sum()))
    p1 = m.parent(np.append(c_root, 0), np.append(t_root, 0))
    assert np.isclose(p1.sum(), 1)
    p = m.predict(np.array([6.0, 3.0, 0.0, 0.0]), np.array([3.0, 1.0, 0.0, 0.0]), np.full(4, 9.0), np.full(4, 4.0), p1)
    assert np.isclose(p.sum(), 1)


def log_rising(x, n, step):
    return sum(math.log(x + k * step) for k in range(n))


def exact_predictions(cells, n_words, n_contexts, d, d_root):
    """Predictive probabilities by adding up every table count of every cell and word."""
    s, s0 = lm.STRENGTH, lm.STRENGTH_ROOT
    st, st0 = tables.log_stirling(d), tables.log_stirling(d_root)
    total, out = 0.0, np.zeros((n_contexts, n_words))
    n = [sum(c for _, u, c in cells if u == v) for v in range(n_contexts)]
    for t in itertools.product(*(range(1, c + 1) for _, _, c in cells)):
        above = [sum(x for x, (w, _, _) in zip(t, cells, strict=True) if w == v) for v in range(n_words)]
        of = [sum(x for x, (_, u, _) in zip(t, cells, strict=True) if u == v) for v in range(n_contexts)]
        inner = sum(log_rising(s, x, d) for x in of) + sum(st[c, x] for x, (_, _, c) in zip(t, cells, strict=True))
        for root in itertools.product(*(range(1, c + 1) for c in above)):
            weight = math.exp(inner + log_rising(s0, sum(root), d_root) + sum(st0[c, x] for c, x in zip(above, root, strict=True)) - sum(root) * math.log(n_words + 1) - log_rising(s0, sum(above), 1))
            total += weight
            m = lm.Model(d, d_root, n_words, (sum(above), sum(root)))
            p1 = m.parent(np.array(above, float), np.array(root, float))
            for v in range(n_contexts):
                c, k = np.zeros(n_words), np.zeros(n_words)
                for x, (w, u, own) in zip(t, cells, strict=True):
                    if u == v:
                        c[w], k[w] = own, x
                out[v] += weight * m.predict(c, k, np.full(n_words, n[v]), np.full(n_words, of[v]), p1)
    return out / total


def test_lm_sampler_agrees_with_exact_enumeration():
    cells, d, d_root = [(0, 0, 4), (1, 0, 1), (0, 1, 2), (1, 1, 3), (2, 1, 1)], 0.6, 0.4
    want = exact_predictions(cells, 3, 2, d, d_root)
    rank, at, c = (np.array(x) for x in zip(*cells, strict=True))
    rng, t, root, got, sweeps = np.random.default_rng(1), np.ones(5), np.ones(3), np.zeros((2, 3)), 6000
    own = lm.Cells(rank, at, c, np.zeros(2), 3)
    n = np.bincount(at, c)
    for _ in range(sweeps):
        m = lm.Model(d, d_root, 3, (t.sum(), root.sum()))
        t, root = lm.sweep(rng, m, own, t, root, groups=5)
        m = lm.Model(d, d_root, 3, (t.sum(), root.sum()))
        p1 = m.parent(np.bincount(rank, t), root)
        of = np.bincount(at, t)
        p = np.tile(p1, (2, 1)) * (lm.STRENGTH + d * of[:, None]) / (n + lm.STRENGTH)[:, None]
        p[at, rank] += (c - d * t) / (n + lm.STRENGTH)[at]
        got += p / sweeps
    assert np.abs(got - want).max() < 0.01


@pytest.mark.parametrize(("c", "others", "p"), [(1024, 50.0, 0.05), (1024, 5000.0, 0.01), (1000, 2e5, 0.02), (700, 3.0, 1e-4)])
def test_tables_of_many_customers_follow_the_exact_law(c, others, p):
    for d in (0.3, 0.8):
        k = np.arange(c)
        logit = tables.log_stirling(d)[c, 1 : c + 1].astype(float) + np.cumsum(np.log(1 + d * (others + k))) + (k + 1) * math.log(p)
        w = np.exp(logit - logit.max())
        mean = (w * (k + 1)).sum() / w.sum()
        sd = math.sqrt((w * (k + 1 - mean) ** 2).sum() / w.sum())
        rng, n = np.random.default_rng(0), 2000
        exact = tables.draw(rng, np.full(n, c), np.full(n, others), 1.0, d, np.full(n, p))
        curve = tables._many(rng, np.full(n, float(c)), np.full(n, (1 + d * others) * p), np.full(n, p), d)
        for drawn in (exact, curve):
            assert abs(drawn.mean() - mean) < 0.1 * sd + 0.02 * mean and abs(drawn.std() - sd) < 0.15 * sd + 0.05


def test_lm_has_a_restaurant_for_every_context(spark):
    """A pair seen often after a rare word is likelier there than elsewhere, however large the rest of the corpus."""
    filler = [(i, " ".join(f"f{(i * 7 + k * k) % 500}" for k in range(400))) for i in range(60)]
    rare = [(1000 + i, "onlyhere follows") for i in range(3)]
    docs = [d for d in filler + rare if zlib.crc32(str(d[0]).encode()) % 10]
    tests = [(next(i for i in range(5000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0), "onlyhere follows"), (next(i for i in range(9000, 9999) if zlib.crc32(str(i).encode()) % 10 == 0), "f1 follows")]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(docs + tests, "doc_id long, text string")).collect()}
    assert got[tests[0][0]] > got[tests[1][0]] + 1


def test_lm_beats_the_base_on_held_out_texts(spark):
    held = [r for r in lm.op7_lm_score(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 40)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 300: 0, 100: 100, 200: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    last = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, last, SF)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        got, had = {r["doc_id"]: r["text"] for r in out.collect()}, {r["doc_id"]: r["text"] for r in last.collect()}
        if name == "simhash":
            ids = sorted(had)
            assert set(got) == set(brute_near_copies([(d, had[d]) for d in ids]))  # five words, similarity 0.8
        elif name == "substrings":
            for d, _, removed, kept in brute_repeats(sorted(had.items())):
                assert got[d].split() == kept.split() if removed else got[d] == had[d]
        elif name == "decontamination":
            assert set(got) == {r["doc_id"] for r in decontaminate.find_leaks(last, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if not r["hits"]}
        last = out
    end = corpus_pipeline.STAGES[-1][1](spark, last, SF).collect()
    assert {r["doc_id"] for r in end} == {r["doc_id"] for r in last.collect()} <= set(before)
    assert {r["decoded_sha256"] for r in end} == {hashlib.sha256(r["text"].encode()).hexdigest() for r in last.collect()}


NULLS = [(1, PASSAGE, "en", 3), (None, PASSAGE, "en", 3), (None, None, None, None), (2, None, None, 1), (None, "the mit license x", "en", 1), (3, "", None, None), (3, "", None, None)]


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([r + (9,) * 5 for r in NULLS], "doc_id long, text string, lang string, n_chars long, fp long, key long, n long, words long, component_id long")


@pytest.mark.parametrize(
    "scan",
    [licenses.scan_licenses, imatch.compare_edited, simhash.near_duplicates, lm.score_texts, repeats.cut_repeats, lambda d: language.identify(d, d), lambda d: toxicity.score_toxicity(d, d.select("doc_id", F.col("key").alias("toxic")))],
    ids=["licenses", "imatch", "simhash", "lm", "repeats", "language", "toxicity"],
)
def test_rows_of_null_id_are_answered(nulls, scan):
    assert Counter(r["doc_id"] for r in scan(nulls).collect()) == Counter(r[0] for r in NULLS)


def test_rows_of_null_id_neither_lead_nor_teach(spark, nulls):
    assert all(r["n_removed"] == 0 for r in repeats.cut_repeats(nulls).collect())
    assert all((r["held_out"] is None) == (r["doc_id"] is None) and r["train_tokens"] == 34 for r in lm.score_texts(nulls).collect())
    kept = corpus_pipeline.simhash_stage(spark, nulls, "").collect()
    assert Counter(r["doc_id"] for r in kept) == {1: 1, 2: 1, None: 3}
    assert corpus_pipeline.substring_stage(spark, nulls, "").columns == nulls.columns


def test_items_of_null_id_count(spark, nulls):
    items = spark.createDataFrame([(None, "mit license"), (4, PASSAGE)], "item_id long, text string")
    found = decontaminate.find_leaks(nulls, items).collect()
    assert sorted((r["items"] for r in found if r["hits"]), key=str) == [["4"], ["4"], [None]]
    assert decontaminate.drop_leaks(nulls, items).count() == 4


def test_labels_of_one_kind_reject_nothing(nulls):
    assert toxicity.reject_toxic(nulls, nulls.select("doc_id", F.lit(1).alias("toxic"))).count() == len(NULLS)
