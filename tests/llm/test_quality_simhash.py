import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from assaymill.llm import components, quality, simhash
from tests.llm.fixtures import edge_docs, edge_rows, empty_docs, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(found):
    windows = list(zip(found, found[1:], found[2:], strict=False))
    often = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})


def expected(docs, labels, order=1):
    """Brute force: rule columns, score."""
    found = [(d, WORD.findall(t or ""), t or "") for d, t in docs]
    good = {d for d, q in labels if q == 1 and d is not None}
    bucket = lambda g: chained(g) % quality.BUCKETS
    raw, target = Counter(), Counter()
    for d, w, _ in found:
        for g in zip(*[w[k:] for k in range(order)], strict=False):
            raw[bucket(g)] += 1
            target[bucket(g)] += d in good
    total, aimed = sum(raw.values()), sum(target.values())
    out = []
    for d, w, t in found:
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [bucket(g) for g in zip(*[w[k:] for k in range(order)], strict=False)]
        share = lambda n, of: math.log((n + 1) / (of + quality.BUCKETS))
        score = sum(round(share(target[b], aimed) - share(raw[b], total), 6) for b in grams) / max(1, len(grams)) if aimed else 0
        n = repeats(w)
        failed = len(w) < 50 or 100 * n > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, n, failed, not failed and score >= quality.THRESHOLD, score))
    return out


def chained(gram):
    seed = 42
    for g in gram:
        seed = xxhash.xxh64_intdigest(g.encode(), seed)
        seed = seed - (1 << 64) if seed >= 1 << 63 else seed
        seed &= (1 << 64) - 1
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def rounded(rows):
    rows = [(*r[:8], round(r[8], 5)) for r in map(tuple, rows)]
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_equals_brute_force_on_edge_cases(spark):
    labels = [(i, i % 2) for i in range(100, 140)] + [(None, 1), (3, None), (100, 1)]
    docs = edge_docs(spark)
    for order in (1, 2):
        got = quality.quality_rules(docs, labels_of(spark, [(*x, 0) for x in labels]), order=order).collect()
        assert rounded(got) == rounded(expected([r[:2] for r in edge_rows()], labels, order))


def test_quality_equals_brute_force_on_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert rounded(quality.op2_quality_rules(spark, sf_dir).collect()) == rounded(expected(docs, labels))


def test_every_trusted_document_counts_however_many(spark):
    n = 25_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id % 5000, ' w', id) as text").unionByName(
        spark.createDataFrame([(None, "w1 w2"), (n, "w3 w4")], "doc_id long, text string")
    )
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality").unionByName(spark.createDataFrame([(n, 0), (None, 1)], "doc_id long, quality int"))
    corpus, target = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    for doc_id, text in [(i, f"w{i % 5000} w{i}") for i in range(n)] + [(None, "w1 w2"), (n, "w3 w4")]:
        for word in text.split():
            b = chained((word,)) % quality.BUCKETS
            corpus[b] += 1
            target[b] += doc_id is not None and doc_id < n
    share = lambda n, of: math.log((n + 1) / (of + quality.BUCKETS))
    want = [share(t, sum(target)) - share(c, sum(corpus)) for c, t in zip(corpus, target, strict=True)]
    for most in (quality.BROADCAST_IDS, 100):
        assert quality.log_ratios(docs, labels, broadcast_ids=most) == pytest.approx(want, abs=1e-6)


def test_quality_separates_labelled_documents(spark):
    got = {r.doc_id: r for r in quality.op2_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    judged = [(x.quality, got[x.doc_id].kept) for x in labels if not got[x.doc_id].base_failed]
    assert sum(k for q, k in judged if q) > 0.99 * sum(q for q, _ in judged)
    assert sum(k for q, k in judged if not q) < 0.1 * sum(not q for q, _ in judged)


def test_quality_without_rows_or_labels(spark):
    none = labels_of(spark, [])
    assert quality.quality_rules(empty_docs(spark), none).collect() == []
    assert {r.score for r in quality.quality_rules(edge_docs(spark), none).collect()} == {0.0}


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def naive_fingerprint(text, n=3):
    w = WORD.findall(fold(text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def naive_components(prints, radius=3):
    """prints: (doc_id, fingerprint). The smallest doc_id of each one's component, nulls last."""
    n = len(prints)
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        least.setdefault(top(i), []).append(prints[i][0])
    small = {t: min((x for x in v if x is not None), default=None) for t, v in least.items()}
    return [small[top(i)] for i in range(n)]


def test_simhash_equals_brute_force(spark, sf_dir):
    edges = spark.createDataFrame([r[:2] for r in edge_rows()], "doc_id long, text string")
    for docs in (edges, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")):
        rows = [tuple(r) for r in docs.collect()]
        prints = [(d, naive_fingerprint(t)) for d, t in rows]
        want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, naive_components(prints), strict=True)), key=str)
        assert sorted(map(tuple, simhash.simhash_components(docs).collect()), key=str) == want


def test_tiles_lose_no_link():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype="u8")
    prints = np.unique(np.concatenate([centres, *[centres ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype="u8")) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype="u8")) for _ in range(8)]]))
    for side in (None, rng.integers(0, 2, len(prints))):
        got = simhash.Forest(len(prints))
        at = {int(p): i for i, p in enumerate(prints)}
        links = list(simhash.link_tiles(prints, side, 3, tile=32))
        for a, b in links:
            got.link(np.array([at[a]]), np.array([at[b]]))
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
        if side is not None:
            near &= side[:, None] != side[None, :]
        want = simhash.Forest(len(prints))
        want.link(*np.nonzero(near))
        assert (got.flatten() == want.flatten()).all()
        assert len(links) < len(prints)


def test_chunks_of_a_shared_block_lose_no_link(spark):
    rng = random.Random(2)
    prints = list({(7 << 48) | sum(1 << rng.randint(0, 47) for _ in range(rng.randint(1, 3))) for _ in range(400)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {}
    for rows in (8192, 50):
        links = [(r.a, r.b) for r in simhash.near_links(df, 3, chunk_rows=rows).collect()]
        forest = simhash.Forest(len(prints))
        at = {p: i for i, p in enumerate(sorted(prints))}
        for a, b in links:
            forest.link(np.array([at[a]]), np.array([at[b]]))
        roots[rows] = forest.flatten().tolist()
    assert roots[8192] == roots[50]


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **{100 + i: 100 for i in range(60)}, 299: 299, 300: 299}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one_of_each(edge_docs(spark), ["doc_id", "text"]).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert -5 in ids and not {0, 1} & set(ids)
    assert len(ids) == len(set(ids))
    assert simhash.simhash_components(empty_docs(spark)).collect() == []
    assert simhash.keep_one_of_each(empty_docs(spark), ["doc_id", "text"]).collect() == []


def test_near_copies_meet_and_others_do_not(spark):
    rng = random.Random(9)
    base = words(rng, 600).split()
    near = [*base[:300], "changed", *base[301:]]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, words(rng, 600))], "doc_id long, text string")
    kept = simhash.keep_one_of_each(docs, docs.columns, words=5, radius=7).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]


def test_similar_texts_are_linked_and_others_are_not(spark):
    rng = random.Random(31)
    rows, kept, dropped = [], set(), set()
    for i in range(60):
        base = words(rng, 300).split()
        edits = (5, 6, 12)[i % 3]
        other = base.copy()
        for at in rng.sample(range(5, 295), edits):
            other[at] = f"edit{i}x{at}"
        sets = [set(zip(*[t[k:] for k in range(5)], strict=False)) for t in (base, other)]
        alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        (dropped if alike >= 0.8 else kept).add(2 * i + 1)
        kept.add(2 * i)
    assert len(dropped) > 15 and len(kept) > 75
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in simhash.keep_one_of_each(docs, docs.columns, words=5, radius=7).collect()}
    assert got == kept


def test_one_row_of_each_component_stays_under_shared_and_null_ids(spark):
    rng = random.Random(12)
    a, b, c, d, e = (words(rng, 80) for _ in range(5))
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (7, c), (None, c), (8, d), (9, e), (None, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(docs, docs.columns, words=5, radius=7).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (9, e)], key=str)


def test_survivors_equal_brute_force_over_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        low = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        found = re.findall("[^\x20\x09-\x0d]+", low)
        sets[r.doc_id] = frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    order = sorted(sets, key=lambda i: len(sets[i]))
    for at, i in enumerate(order):
        a = sets[i]
        for j in order[at + 1 :]:
            b = sets[j]
            if len(a) < 0.8 * len(b):
                break
            if a == b or (a and len(a & b) >= 0.8 * len(a | b)):
                low, high = sorted((top(i), top(j)))
                least[high] = low
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(docs, ["doc_id", "text"], words=5).collect())
    assert kept == sorted({top(i) for i in sets})
    assert len(kept) < len(sets)
