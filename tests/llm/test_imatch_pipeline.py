import hashlib
import math
import re
from collections import Counter

import pytest

import corpus_pipeline
from assaymill.llm import imatch
from tests.llm.fixtures import edge_docs, edge_rows, empty_docs


def expected(docs):
    """Brute force: doc_id, n_chars, sha256 of the edited text, in order."""
    out = []
    for (doc_id, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return out


def test_imatch_equals_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    rows = sorted(imatch.op10_imatch_fingerprints(spark, sf_dir).collect())
    assert [tuple(r)[:3] for r in rows] == expected(docs)
    edited, following = [r.near_edited for r in rows], [r.near_next for r in rows]
    assert all(0 <= x <= 1 for x in edited + following)
    assert sum(e > n for e, n in zip(edited, following, strict=True)) > 0.8 * len(rows)
    assert sum(following) / len(rows) < 0.1 < sum(edited) / len(rows)


@pytest.mark.parametrize("part_docs", [1, 7, 4096])
def test_neighbours_meet_across_parts(spark, part_docs):
    docs = [(i * 3, f"text {i} " * (i % 5)) for i in range(40)]
    rows = imatch.neighbours(spark.createDataFrame(docs, "doc_id long, text string"), part_docs).collect()
    assert sorted(r.doc_id for r in rows if not r.extra) == [d for d, _ in docs]
    parts = {}
    for r in rows:
        parts.setdefault(r.part, []).append((r.extra, r.doc_id))
    for part in parts.values():
        ids = [d for _, d in sorted(part)]
        own = [d for e, d in sorted(part) if not e]
        assert own == list(range(own[0], own[-1] + 1, 3))
        assert ids[len(own)] == (own[-1] + 3) % 120


def test_fingerprints_and_likeness():
    terms = sorted({w.encode() for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()})
    lexicon = imatch.Lexicon(terms)
    text = "Alpha beta, gamma! delta epsilon zeta eta"
    assert lexicon.fingerprint(text) == lexicon.fingerprint("eta ZETA epsilon delta gamma beta alpha alpha unknown")
    assert lexicon.likeness(lexicon.fingerprint(text), lexicon.fingerprint(text)) == 1
    near = lexicon.likeness(lexicon.fingerprint(text), lexicon.fingerprint("alpha beta gamma delta epsilon theta"))
    far = lexicon.likeness(lexicon.fingerprint(text), lexicon.fingerprint("iota kappa lambda theta"))
    assert 0 <= far < near < 1
    assert lexicon.fingerprint("nothing known") != lexicon.fingerprint("nothing else")


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"all {'half' if i % 2 else ''} one{i} Two{i // 2}.") for i in range(40)], "doc_id long, text string")
    assert imatch.learn_lexicon(docs, 0.05, 0.6) == sorted([b"half", *[f"two{i}".encode() for i in range(20)]])


def test_imatch_of_edge_cases(spark):
    rows = imatch.imatch_fingerprints(edge_docs(spark)).collect()
    wanted = sorted(((d, t or "") for d, t, *_ in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(((r.doc_id, r.n_chars) for r in rows), key=str) == sorted(((d, len(t)) for d, t in wanted), key=str)
    order = {d: i for i, (d, _) in enumerate(wanted)}
    single = expected(wanted)
    for r in rows:
        i = order.get(r.doc_id)
        if r.doc_id not in (None, 0, 1, 1 << 40):  # their neighbours repeat or have no identifier
            assert (r.doc_id, r.n_chars, r.edited_sha256) == single[i]
    assert imatch.imatch_fingerprints(empty_docs(spark)).collect() == []
    one = imatch.imatch_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir))
    assert all(set(d.columns) == set(docs.columns) for d in seen[:-1])
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    assert len(ids[0]) > len(ids[1]) > len(ids[2]) == len(ids[3])
    assert set(ids[2]) <= set(ids[1]) <= set(ids[0])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    texts = {r.doc_id: r.text for r in seen[0].collect()}
    good = [x.doc_id for x in labels if x.quality and len(texts[x.doc_id].split()) >= 60]
    assert len(set(good) & set(ids[1])) > 0.97 * len(good)
    masked = [r.text for r in seen[3].collect()]
    assert not any('token = "' in t for t in masked)
    assert set(ids[5]) == set(ids[4]) <= set(ids[3])
    assert max(ids[4].count(i) for i in set(ids[4])) <= 2


def test_exact_and_near_copies_leave_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    texts = [r.text for r in kept]
    assert len(texts) == len(set(texts))
    by_text = {}
    for r in docs.collect():
        by_text.setdefault(r.text, []).append(r.doc_id)
    lone = {ids[0] for ids in by_text.values()}
    assert len(lone & {r.doc_id for r in kept}) > 0.9 * len(lone)


def naive_fingerprint(text, terms):
    """All subsets, one term at a time."""
    import xxhash

    fold = {c: chr(c + 32) if 65 <= c <= 90 else chr(c) if 48 <= c <= 57 or 97 <= c <= 122 else " " for c in range(128)}
    words = {w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text.translate(fold)) if w}
    held = sorted(words & set(terms))
    hash_ = {t: xxhash.xxh64_intdigest(t, 7) for t in held}
    line = lambda found: b"".join(hash_[t].to_bytes(8, "little") for t in found)
    out = xxhash.xxh64_intdigest(line(held), 13) if held else xxhash.xxh64_intdigest(b" ".join(sorted(words)), 11)
    out = [f"{out:016x}"]
    top = 1 << 64
    for k in range(imatch.LEVELS * imatch.SUBSETS):
        inside = []
        for t in held:
            m = (hash_[t] ^ (k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % top) * 0xFF51AFD7ED558CCD % top
            m = (m ^ m >> 33) * 0xC4CEB9FE1A85EC53 % top
            if (m >> 11) < 2 ** (53 - 2 * (k // imatch.SUBSETS)):
                inside.append(t)
        out.append(f"{xxhash.xxh64_intdigest(line(inside), k) % 65535 + 1:04x}" if inside else "0000")
    return "".join(out)


def naive_likeness(a, b):
    if a == b:
        return 1.0
    cells = lambda f: [f[16 + 4 * i : 20 + 4 * i] for i in range(imatch.LEVELS * imatch.SUBSETS)]
    pairs = list(zip(cells(a), cells(b), strict=True))
    levels = [pairs[i : i + imatch.SUBSETS] for i in range(0, len(pairs), imatch.SUBSETS)]
    held = [[p for p in level if p != ("0000", "0000")] for level in levels]
    from_ = max([i for i, h in enumerate(held) if len(h) >= imatch.HELD], default=0)
    used = [p for h in held[from_:] for p in h]
    return sum(x == y for x, y in used) / max(1, len(used))


def test_fingerprints_and_likenesses_equal_brute_force(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in frame.collect())
    seen = Counter(w for _, t in docs for w in imatch.terms_of(t))
    low, high = max(2, math.ceil(imatch.LOWEST * len(docs))), math.floor(imatch.HIGHEST * len(docs))
    terms = sorted(t for t, n in seen.items() if low <= n <= max(low, high))
    assert imatch.learn_lexicon(frame) == terms
    assert imatch.learn_lexicon(frame, most=50) == sorted(sorted(terms, key=lambda t: (-seen[t], t))[:50])
    rows = {r.doc_id: r for r in imatch.op10_imatch_fingerprints(spark, sf_dir).collect()}
    for (doc_id, text), (_, after) in list(zip(docs, docs[1:] + docs[:1], strict=True))[::9]:
        r, changed = rows[doc_id], text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other, following = (naive_fingerprint(t, terms) for t in (text, changed, after))
        assert (r.fingerprint, r.edited_fingerprint) == (own, other)
        assert abs(r.near_edited - naive_likeness(own, other)) < 1e-9
        assert abs(r.near_next - naive_likeness(own, following)) < 1e-9


def test_texts_of_one_identifier_come_to_several_parts(spark):
    docs = [(5, f"text {i}") for i in range(300)] + [(5, "the same")] * 50 + [(None, "x"), (9, "last")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = imatch.neighbours(frame, 20).collect()
    assert len({r.part for r in rows if r.doc_id == 5}) > 5
    assert len([r for r in rows if not r.extra]) == len(docs)
    got = imatch.imatch_fingerprints(frame).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in docs)


def test_pipeline_of_nothing(spark, sf_dir):
    docs = empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []
