import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

from assaymill.llm import audit, merkle, toxicity
from tests.llm.fixtures import SCHEMA, edge_docs, edge_rows, empty_docs, words
from tests.llm.oracle import same_as_sql

H = merkle.digest


# Merkle manifest


def naive_leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return H("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def naive_levels(nodes):
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def siblings(levels, at):
    for nodes in levels[:-1]:
        run, own = at - at % 16, at % 16
        yield "".join(nodes[run : run + own]), "".join(nodes[run + own + 1 : run + 16])
        at //= 16


def naive_manifest(rows):
    by_source = {}
    for doc_id, text, lang, source, n_chars in rows:
        low = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        leaf, seen = naive_leaf(doc_id, source, lang, n_chars, text), naive_leaf(doc_id, source, lang, n_chars, low)
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, seen, doc_id))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        by_source[source].sort(key=lambda r: r[:3])
        trees[source] = naive_levels([r[2] for r in by_source[source]])
    tops = naive_levels([trees[s][-1][0] for s in order])
    root = tops[-1][0]
    out = []
    for k, source in enumerate(order):
        for at, (_, _, leaf, seen, doc_id) in enumerate(by_source[source]):
            path = [*siblings(trees[source], at), *siblings(tops, k)]
            folded = merkle.fold(seen, path)
            proof = H("".join(a + b for a, b in path))
            out.append((doc_id, leaf, trees[source][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_paths_of_every_size_of_block():
    rng = random.Random(3)
    for n in [*range(1, 20), 255, 256, 257, 273, 600]:
        nodes = [H(str(rng.random())) for _ in range(n)]
        levels = naive_levels(nodes)
        height = len(levels) - 1
        assert merkle.top_of(nodes, height) == levels[-1][0]
        for at, path in enumerate(merkle.traverse(nodes, height)):
            assert path == list(siblings(levels, at))


def test_block_of_a_larger_tree_goes_up_whole_levels():
    nodes = [H(str(i)) for i in range(3)]
    assert merkle.top_of(nodes, 3) == H(H(H("".join(nodes))))
    assert [len(p) for p in merkle.traverse(nodes, 3)] == [3, 3, 3]
    assert [merkle.height(n) for n in (1, 2, 16, 17, 256, 257, 4096, 4097, 10**9)] == [0, 1, 1, 2, 2, 3, 3, 3, 3]


def test_treehash_holds_a_run_a_level():
    tree = merkle.Treehash(3)
    for i in range(5000):
        tree.push(H(str(i)))
        assert all(len(run) < 16 for run in tree.waiting[:-1])


def test_manifest_of_edge_rows(spark):
    docs = edge_docs(spark)
    assert manifest_rows(merkle.manifest(docs)) == naive_manifest(edge_rows())
    assert merkle.manifest(empty_docs(spark)).collect() == []
    one = spark.createDataFrame([(5, "A", None, None, None)], SCHEMA)
    assert manifest_rows(merkle.manifest(one)) == naive_manifest([(5, "A", None, None, None)])


def test_manifest_of_many_blocks_and_sources(spark):
    rng = random.Random(9)
    rows = [(i, f"Text {rng.random()}", "en", "hot" if i % 3 else f"s{i % 90}", i) for i in range(14_000)]
    rows += [(None, "Null id", None, None, None)] * 40 + [(7, "Repeated", "en", "hot", 1)] * 40
    assert manifest_rows(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == naive_manifest(rows)


def test_manifest_equals_sql(spark, sf_dir):
    same_as_sql(merkle.op11_merkle_manifest(spark, sf_dir), merkle.OP11_SQL, documents=f"{sf_dir}/documents.parquet")


# Toxicity


def test_windows_give_the_text_back():
    rng = random.Random(2)
    for text in ("", "a", "x" * 100, words(rng, 300), "é" * 40 + " " + words(rng, 20)):
        data = text.encode()
        cut = [w[len(toxicity.ANCHOR) + 1 :] for w in toxicity.windows(data)]
        assert b"".join(cut) == data
        assert all(0 < len(w) <= toxicity.WINDOW for w in cut)


def toxic_tables(spark, n=500):
    """Texts of made-up words; a third of them, spread over even and odd rows, have words of their own, too."""
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        text, bad = words(rng, rng.randint(30, 200)).split(), rng.random() < 0.3
        for _ in range(4 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["grumblefuzz", "snarkwhistle", "bumbleplonk"]))
        docs.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.learn(toxicity.sample(docs, labels))
    assert b"grumblefuzz" in model.toxic and b"grumblefuzz" not in model.ordinary
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held_out = [r for r in toxicity.score_documents(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    wrong = sum(r.predicted != truth[r.doc_id] for r in held_out)
    assert len(held_out) > 100 and wrong <= 0.03 * len(held_out)
    clean = words(random.Random(11), 4000)
    score = model.scorer()
    assert score(clean) < 0.7 <= score(clean + " you grumblefuzz snarkwhistle bumbleplonk grumblefuzz snarkwhistle bumbleplonk")


def test_no_held_out_label_and_no_other_column_is_learned_from(spark):
    docs, labels = toxic_tables(spark)
    held_out = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    turned = labels.selectExpr("doc_id", "quality", f"if({held_out}, 1 - toxic, toxic) as toxic")
    model = toxicity.learn(toxicity.sample(docs, labels))
    assert toxicity.learn(toxicity.sample(docs.selectExpr("doc_id", "text", "'xx' as lang", "'yy' as source"), turned)) == model
    found = toxicity.sample(docs, labels, toxic_docs=5, ordinary_docs=7)
    assert len(found) <= 12 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i, *_ in found)


def test_sql_files_have_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = toxicity.op12_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    bad = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    good = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good)) > 0.85
    assert sum(g >= 0.7 for g in good) <= 0.02 * len(good)


def test_toxicity_of_edge_rows(spark):
    docs, labels = edge_docs(spark), spark.createDataFrame([(0, 1), (7, 0), (None, 1), (2, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.learn(toxicity.sample(docs, marks))
        rows = toxicity.score_documents(docs, model).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in edge_rows())
        assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(empty_docs(spark), model).collect() == []


# Filter interaction audit


def naive_audit(rows, labels):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    marks = {}
    for doc_id, quality, toxic in labels:
        q, t = marks.get(doc_id, (False, False))
        marks[doc_id] = (q or quality == 1, t or toxic == 1)
    parts = {}
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        found = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(found) < 200,
            "B": 100 * len(set(found)) < 50 * len(found),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > first[text],
        }
        good, toxic = marks.get(doc_id, (False, False)) if doc_id is not None else (False, False)
        parts.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, good, toxic))
    out = {}
    for part, docs in parts.items():
        share = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                share[f] += len(gone)
                failing = [d for d in docs if f in d[0]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(d[0] == {f} for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[m] for m in audit.MEASURES] for r in df.collect()}


def test_first_failures():
    steps = audit.first_failures()
    assert steps.shape == (32, 120)
    for case in range(32):
        for o, order in enumerate(audit.ORDERS):
            want = next((s for s, f in enumerate(order) if case >> "ABCDE".index(f) & 1), 5)
            assert steps[case, o] == want


LABELS = "doc_id long, quality int, toxic int"


def test_audit_of_edge_rows(spark):
    rows = edge_rows()
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (3, 1, 1), (None, 1, 1), (999, 1, 1), *[(100 + i, i % 2, i % 3 == 0) for i in range(40)]]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got = audit.audit(edge_docs(spark), spark.createDataFrame(labels, LABELS))
    assert audit_rows(got) == naive_audit(rows, labels)
    assert audit.audit(empty_docs(spark), spark.createDataFrame([], LABELS)).collect() == []


def test_audit_with_hot_copies_and_many_parts(spark):
    rng = random.Random(13)
    copied = words(rng, 250)
    rows = [(i, copied if i % 3 == 0 else words(rng, rng.randint(150, 260)), f"l{i % 300}", "a", 1) for i in range(1200)]
    rows += [(None, copied, None, None, None)] * 30 + [(77, words(rng, 210) + " #", "l1", "a", 1) for _ in range(200)]
    labels = [(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(0, 1200, 2)] + [(77, 1, 1)]
    got = audit.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS))
    assert audit_rows(got) == naive_audit(rows, labels)


def test_rare_keys_are_joined_by_shuffling(spark):
    rows = spark.range(30_000).selectExpr("id as row", "if(id < 100, id % 2, id) as key")
    facts = spark.createDataFrame([(0, 50, "a"), (1, 50, "b"), (200, 1, "c"), (10**9, 1, "d")], "key long, met long, fact string")
    got = {r.row: r.fact for r in audit.looked_up(rows, facts, "key", "fact", 30_000).where("fact is not null").collect()}
    assert got == {**{i: "ab"[i % 2] for i in range(100)}, 200: "c"}


def test_audit_equals_sql(spark, sf_dir):
    paths = {t: f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")}
    same_as_sql(audit.op13_filter_audit(spark, sf_dir), audit.OP13_SQL, **paths)


def test_leaf_of_no_text_is_not_that_of_an_empty_one():
    assert naive_leaf(1, "a", "b", 0, None) != naive_leaf(1, "a", "b", 0, "")
    assert hashlib.sha256(b"1:1-1:b1:00:").hexdigest() == naive_leaf(1, None, "b", 0, "")
