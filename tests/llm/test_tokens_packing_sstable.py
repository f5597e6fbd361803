import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assaymill.llm import packing, sstable, tokens
from tests.llm.fixtures import edge_docs, edge_rows, empty_docs

PATH = tokens.vocabulary("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text, end):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_library(text):
    got = np.frombuffer(tokens.encoder(PATH)(text), "<u4").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text", ["don't 'RE ''s we'll!!", "ÀÉß µ×÷ª² ½", "a<|endoftext|>b <|startoftext|>", "x\x85y\xa0z\xadw", "İstanbul ΣΑΣ é", "1234 $5.00"]
)
def test_encoder_on_hard_texts(text):
    assert np.frombuffer(tokens.encoder(PATH)(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_and_still_agrees():
    encode = tokens.Encoder(PATH, words_kept=3)
    text = " ".join(f"w{i % 11}x" for i in range(200))
    assert np.frombuffer(encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_another_vocabulary_is_encoded_text_by_text():
    path = tokens.vocabulary("byte_bpe_50k.json")
    text = "Two  words, and\n<more>."
    assert np.frombuffer(tokens.encoder(path)(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def naive_first_fit(sizes, capacity):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((b for b, used in enumerate(bins) if used + sizes[i] <= capacity), len(bins))
        bins += [0] * (b == len(bins))
        out[i] = (b, bins[b])
        bins[b] += sizes[i]
    return out


def test_tournament_equals_naive_first_fit():
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 100):
        sizes = [rng.randint(1, 50) for _ in range(n)]
        assert packing.first_fit_decreasing(sizes, 50) == naive_first_fit(sizes, 50)


def test_packing_holds_every_id_once(spark):
    rows = packing.pack_documents(edge_docs(spark), group_docs=8).collect()
    want = {}
    for doc_id, text, *_ in edge_rows():
        want.setdefault(doc_id, []).append(ids_of(text, 1).tolist())
    pieces, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for doc_id, texts in want.items():
        for n in {len(t) for t in texts}:
            same = [t for t in texts if len(t) == n]
            got = sorted(pieces[doc_id, n])
            assert sorted((s, i) for t in same for s, i in cut(t)) == got
    assert sum(len(t) for x in want.values() for t in x) == sum(r.length for r in rows)


def cut(ids):
    whole = len(ids) // 2048 * 2048
    out = [(s, ids[s : s + 2048]) for s in range(0, whole, 2048)]
    return out + ([(whole, ids[whole:])] if whole < len(ids) else [])


def test_packing_pads_little(spark, sf_dir):
    rows = packing.op8_pack_sequences(spark, sf_dir).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert padding < 0.03 * sum(used.values())


def test_packing_query_equals_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = packing.op8_pack_sequences(spark, sf_dir).collect()
    want = {d: ids_of(t, 1) for d, t in texts.items()}
    seen, sequences = {}, {}
    for r in rows:
        assert r.doc_tokens == len(want[r.doc_id]) and 0 < r.length <= 2048
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    gapless = lambda spans: [s for s, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1].tolist()]
    assert all(gapless(spans) for spans in sequences.values()) and all(gapless(spans) for spans in seen.values())
    assert {d: sum(n for _, n in spans) for d, spans in seen.items()} == {d: len(w) for d, w in want.items()}
    assert max(sum(n for _, n in spans) for spans in sequences.values()) <= 2048


def test_many_rows_of_one_identifier_are_several_groups(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(300)] + [(7, "the same")] * 300, "doc_id long, text string")
    rows = packing.pack_documents(docs, group_docs=50).collect()
    assert len(rows) == 600 and len({r.sequence_id >> 32 for r in rows}) > 6


def test_equal_rows_come_to_several_shards_and_failed_attempts_go(spark, tmp_path):
    docs = spark.createDataFrame([(7, "the same text")] * 400 + [(8, "after")], "doc_id long, text string")
    (tmp_path / "_trial-old").write_text("half a shard")
    manifest = sstable.write_shards(docs, str(tmp_path), shard_docs=40)
    assert manifest.select("part").distinct().count() > 4 and not list(tmp_path.glob("_trial-*"))
    rows = sstable.read_shards(manifest, str(tmp_path)).orderBy("start").collect()
    each = len(ids_of("the same text", 2))
    assert [r.start for r in rows] == [each * i for i in range(401)] and rows[-1].doc_id == 8


def test_packing_of_nothing(spark):
    assert packing.pack_documents(empty_docs(spark)).collect() == []


def test_shard_round_trip(tmp_path):
    rng = random.Random(3)
    keys = sorted([None] + [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(300)], key=sstable.key_of)
    keys.insert(5, keys[5])
    values = [np.array([rng.randint(0, 60_000) for _ in range(rng.randint(0, 50))], "<u2") for _ in keys]
    place = tmp_path / "a.sst"
    with place.open("wb") as f:
        writer = sstable.Writer(f, 2, block_bytes=256)
        for k, v in zip(keys, values, strict=True):
            writer.add(sstable.key_of(k), v.tobytes())
        writer.finish()
    reader = sstable.Reader(place.read_bytes())
    assert len(reader.blocks) > 5 and reader.entries == len(keys)
    before = 0
    for (k, start, ids), key, value in zip(reader.scan(), keys, values, strict=True):
        assert (k, start, ids.tolist()) == (key, before, value.tolist())
        before += len(value)
    assert reader.ids == before
    for key in set(keys):
        want = [v.tolist() for k, v in zip(keys, values, strict=True) if k == key]
        assert [v.tolist() for v in reader.get(key)] == want
    misses = [k for k in range(5000) if k not in keys]
    assert all(reader.get(k) == [] for k in misses)
    assert sum(sstable.key_of(k) in reader.bloom for k in misses) < 0.05 * len(misses)
    broken = bytearray(place.read_bytes())
    broken[20] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(bytes(broken)).scan())
    with pytest.raises(ValueError):
        writer.last, writer.entries = b"\2", 1
        writer.add(b"\1", b"")


def test_shards_hold_all_documents_in_order(spark):
    place = sstable.new_place(spark, "test")
    manifest = sstable.write_shards(edge_docs(spark), place, shard_docs=10)
    assert manifest.count() > 3
    rows = sorted(sstable.read_shards(manifest, place).collect(), key=lambda r: r.start)
    wanted = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [r[0] for r in wanted]
    at = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == at
        at += len(ids)
        assert any(ids.tolist() == ids_of(text, 2).tolist() for d, text, *_ in wanted if d == r.doc_id)
    for path in (r.path for r in manifest.collect()):
        with open(path, "rb") as f:
            reader = sstable.Reader(f)
            first = next(reader.scan())[0]
            assert reader.get(first)


def test_shards_of_nothing(spark):
    place = sstable.new_place(spark, "none")
    manifest = sstable.write_shards(empty_docs(spark), place)
    assert manifest.count() == 0
    assert sstable.read_shards(manifest, place).collect() == []


def test_sstable_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    rows = sstable.op9_sstable_roundtrip(spark, sf_dir).orderBy("doc_id").collect()
    at = 0
    for r, d in zip(rows, docs, strict=True):
        ids = ids_of(d.text, 2)
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
