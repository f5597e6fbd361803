"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Two fingerprints that differ in at most ``radius`` bits agree in at least one of ``radius + 1`` blocks
of bits, so each distinct fingerprint is dealt once for each block value it has, and those that share
a value are compared all with all, tile by tile: numpy's exclusive-or and bit counts, where tiles are
cut from fingerprints ordered by population count and a pair of tiles whose population counts differ
by more than the radius is skipped. No link is lost. A block value that more than ``chunk_rows``
fingerprints share is parted by blocks of its remaining bits in the same way; where even those values are
shared by more, they are split into chunks, and each pair of chunks is compared on its own.

Where links must mean similarity (:func:`similar_components`), fingerprints are dealt by bands of minimum
hashes instead, since no 64 bits part 0.8 from 0.7, tiles are compared within a wide radius, and each pair
found is confirmed by the exact Jaccard similarity of its sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import cut, pick, rows_of
from assaymill.llm.components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
CHUNK_ROWS = 8192
TILE = 512
#: Jaccard similarity of the sets of shingles from which texts are near copies.
SIMILAR = 0.8
#: Minimum hashes: a pair of similarity 0.8 shares none of the bands in 1 of 9,000 cases, one of 0.85 in 1 of 10 million.
BANDS, BAND_ROWS = 30, 6
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), "u4") | np.uint32(1)
#: Fingerprints of sets of similarity 0.8 differ in 9.7 bits on average, with a deviation of 2.9: in over 20 bits
#: in 1 of 5,000 cases.
SIMILAR_BITS = 20
#: Shingles of a chunk of sets that are compared in one go.
CHUNK_SHINGLES = 1 << 20


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; A-Z count as a-z."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, "<u8")
    hash_ = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hash_(b" ".join(found), seed)], "<u8")
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.array([hash_(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], "<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; 0 if there are none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, "i8")
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="u2")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints = [], []
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                keys.append(doc_id)
                prints.append(fingerprint(shingle_hashes(text, words)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(np.array(prints, "<u8").view("<i8"))], names=["doc_id", "fp"]
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(make, "doc_id long, fp long")


class Forest:
    """Union-find over 0..n-1 that takes links in bulk."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flatten(self) -> np.ndarray:
        while not np.array_equal(higher := self.up[self.up], self.up):
            self.up = higher
        return self.up

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.flatten()
        a, b = root[a], root[b]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        for x, y in pairs.T.tolist():
            self.join(x, y)


def near_tiles(prints: np.ndarray, side: np.ndarray | None, radius: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of tiles of ``prints`` (unsigned 64-bit, ordered by population count) with a table of which
    pairs of theirs differ in at most ``radius`` bits.

    side: None to compare all with all, else only those of side 0 with those of side 1.
    """
    ones = np.bitwise_count(prints).astype(int)
    groups = [np.arange(len(prints))] * 2 if side is None else [np.flatnonzero(side == k) for k in (0, 1)]
    for i in range(0, len(groups[0]), tile):
        left = groups[0][i : i + tile]
        for j in range(i if side is None else 0, len(groups[1]), tile):
            right = groups[1][j : j + tile]
            if ones[right[0]] - ones[left[-1]] > radius:
                break
            if ones[left[0]] - ones[right[-1]] > radius:
                continue
            yield left, right, np.bitwise_count(prints[left][:, None] ^ prints[right][None, :]) <= radius


def link_tiles(prints: np.ndarray, side: np.ndarray | None, radius: int, tile: int = TILE) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among ``prints`` (distinct, unsigned 64-bit). side: as above."""
    order = np.argsort(np.bitwise_count(prints), kind="stable")
    prints = prints[order]
    forest = Forest(len(prints))
    for left, right, near in near_tiles(prints, None if side is None else side[order], radius, tile):
        some = np.flatnonzero(near.any(1))
        forest.link(left[some], right[near[some].argmax(1)])
        root = forest.flatten()
        near &= root[left][:, None] != root[right][None, :]
        a, b = np.nonzero(near)
        if len(a):
            forest.link(left[a], right[b])
    root = forest.flatten()
    for i in np.flatnonzero(root != np.arange(len(root))):
        yield int(prints[i]), int(prints[root[i]])


def bit_blocks(bits: list[int], blocks: int) -> list[int]:
    """Masks of as many blocks, about equally wide, of the given bits."""
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[low:high]) for low, high in zip(edges, edges[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def runs_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each combination of ``keys`` (long) of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        now = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((now[:, 1:] != now[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[a].as_py() for k in keys):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def chunk_pairs(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``chunks``, dealt to pairs of chunks: adds low, high and own. by: a column whose hash gives
    a row's own chunk. Each two rows of a group meet in one pair of chunks."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64(by), F.col("chunks")).cast("long"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
    return rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "chunks")


def near_links(distinct: DataFrame, radius: int = RADIUS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """distinct: fp (long, each once). Returns a, b: links of at most ``radius`` bits, enough of them
    to connect all that any such links connect.

    A fingerprint is dealt ``radius + 1`` times, or ``(radius + 1) ** 2`` times where it shares a block value
    with more than ``chunk_rows``: two that agree there differ in at most ``radius`` of the other bits, and
    so agree in a block of these. With radius 3 a second value stands for 28 bits, so 2 * 10^12 evenly
    spread fingerprints come to a group of ``chunk_rows``; comparing is quadratic beyond that.
    """
    n = radius + 1
    masks = bit_blocks(list(range(64)), n)
    rest = [bit_blocks([b for b in range(64) if not mask >> b & 1], n) for mask in masks]

    def dealt_by(masks_: list[int], block: str) -> Column:
        return F.array(*[F.struct(F.lit(i).cast("long").alias(block), F.col("fp").bitwiseAND(signed(m)).alias(f"{block}_value")) for i, m in enumerate(masks_)])

    dealt = distinct.select("fp", F.inline(dealt_by(masks, "block")))
    # At most (radius + 1) * 2^(64 / (radius + 1)) rows whatever the input: 262,144 for radius 3.
    large = dealt.groupBy("block", "block_value").count().where(F.col("count") > chunk_rows)
    large = cut(large.select("block", "block_value", F.lit(True).alias("large")))
    none = F.array(F.struct(F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("part_value")))
    if large.isEmpty():
        dealt = dealt.select("*", F.inline(none)).withColumn("chunks", F.lit(1))
    else:
        few = sum(1 << m.bit_count() for m in masks) <= 1 << 20
        dealt = dealt.join(F.broadcast(large) if few else large, ["block", "block_value"], "left")
        parts = F.get(F.array(*[dealt_by(m, "part") for m in rest]), F.col("block").cast("int"))
        dealt = dealt.select("block", "block_value", "fp", F.inline(F.when(F.col("large"), parts).otherwise(none)))
        keys = ["block", "block_value", "part", "part_value"]
        chunks = dealt.where("part >= 0").groupBy(*keys).count().where(F.col("count") > chunk_rows)
        chunks = cut(chunks.select(*keys, F.ceil(F.col("count") / chunk_rows).alias("chunks")))
        dealt = dealt.join(chunks, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    keys = ["block", "block_value", "part", "part_value", "low", "high"]
    dealt = chunk_pairs(dealt, "fp").select(*keys, "own", "fp")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def batch_of() -> pa.RecordBatch:
            both = np.array(found, "<u8").view("<i8").reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for run in runs_of(batches, keys):
            if run.num_rows > 1:
                side, prints = side_of(run), run["fp"].to_numpy().view("<u8")
                found.extend(link_tiles(prints, side, radius))
                if len(found) > 100_000:
                    yield batch_of()
        if found:
            yield batch_of()

    return dealt.mapInArrow(compare, "a long, b long")


def side_of(run: pa.Table) -> np.ndarray | None:
    """None where a chunk meets itself, else 0 for the rows of the lower chunk and 1 for the higher."""
    low, high = run["low"][0].as_py(), run["high"][0].as_py()
    return None if low == high else (run["own"].to_numpy() != low).astype(int)


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` bits reach, the row's own
    included. A text without a word (null, empty, blank) has fingerprint zero and links like any
    other. Equal texts have equal fingerprints and so one component. Rows that repeat stay, each
    with its component. A null doc_id is never a component_id unless its component has no other
    doc_id. An empty table gives no rows. Other columns are ignored.
    """
    prints = cut(fingerprints(docs, words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = cut(near_links(classes.select("fp"), radius))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    # Only classes that a link reaches need their component's smallest doc_id. It is written first: a join
    # of two shuffled sides is one that Spark can split where a component has very many classes.
    linked = cut(classes.join(roots, "fp"))
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = linked.join(least, "root").select("fp", "component_id")
    classes = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    classes = cut(classes)  # likewise, for a fingerprint that very many rows have
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def band_values(shingles: np.ndarray) -> np.ndarray:
    """For each band a 32-bit digest of its minimum hashes; none for a text without a word."""
    import xxhash

    if not len(shingles):
        return np.empty(0, "<i4")
    high = (shingles >> np.uint64(32)).astype("u4")
    least = np.full(len(MULTIPLIERS), np.iinfo("u4").max, "u4")
    for at in range(0, len(high), 1024):
        np.minimum(least, (MULTIPLIERS * high[at : at + 1024]).min(1), out=least)
    return np.array([xxhash.xxh32_intdigest(b.tobytes()) for b in least.reshape(BANDS, -1)], "<u4").view("<i4")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """docs: doc_id, digest, text. Returns doc_id, digest, set (a digest of the set of shingles), its fp (each
    shingle counts once), n (its size) and bands of every row."""
    import xxhash

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (text,) in rows_of(batch, "text"):
                shingles = np.unique(shingle_hashes(text, words))
                digest = np.array([fingerprint(shingles), xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], "<u8")
                rows.append((*digest.view("<i8").tolist(), len(shingles), band_values(shingles)))
            fp, whole, n, bands = zip(*rows, strict=True) if rows else ((), (), (), ())
            arrays = [pa.array(fp, pa.int64()), pa.array(whole, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "digest", "fp", "set", "n", "bands"])

    return docs.select("doc_id", "digest", "text").mapInArrow(make, "doc_id long, digest long, fp long, set long, n long, bands array<int>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """docs: set, text. Returns set and shingles (sorted 64-bit hashes, as bytes)."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(text, words)).tobytes() for (text,) in rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["set", "shingles"])

    return docs.select("set", "text").mapInArrow(make, "set long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Of the pairs (a, b) of sets those whose exact similarity is ``similar`` or more."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similarity(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) >= similar for a, b in rows_of(batch, "left", "right")
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("left")), "a")
    both = both.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(judge, "a long, b long")


def similar_links(run: pa.Table, radius: int, similar: float) -> Iterator[tuple[int, int]]:
    """Links between sets of several roots: a forest of those with a similarity of ``similar`` or more.

    run: set, fp, n, root, shingles, and low, high, own of a pair of chunks.
    """
    order = np.argsort(np.bitwise_count(run["fp"].to_numpy().view("<u8")), kind="stable")
    run, side = run.take(order), side_of(run)
    names, sizes = run["set"].to_numpy(), run["n"].to_numpy()
    forest = Forest(len(names))
    _, first, same = np.unique(run["root"].to_numpy(), return_index=True, return_inverse=True)
    forest.link(np.arange(len(names)), first[same])
    sets = [np.frombuffer(s.as_buffer(), "<u8") for s in run["shingles"]]
    for left, right, near in near_tiles(run["fp"].to_numpy().view("<u8"), None if side is None else side[order], radius):
        root = forest.flatten()
        small, large = np.minimum(sizes[left][:, None], sizes[right]), np.maximum(sizes[left][:, None], sizes[right])
        near &= (small >= similar * large) & (root[left][:, None] != root[right])
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            a, b = left[i], right[j]
            if forest.top(a) != forest.top(b) and similarity(sets[a], sets[b]) >= similar:
                forest.join(a, b)
                yield int(names[a]), int(names[b])


def open_links(rows: DataFrame, radius: int, similar: float, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """rows: band, value, set, fp, n, root, shingles. Returns a, b: links between sets of several roots of a
    band's value.

    Values whose sets have more than ``chunk_shingles`` shingles are split into chunks, and each pair of
    chunks is compared on its own, so memory is bounded by that and the longest texts. Only links leave a
    task, fewer than it has sets.
    """
    chunks = rows.groupBy("band", "value").agg(F.ceil(F.sum("n") / chunk_shingles).alias("chunks"))
    rows = rows.join(cut(chunks), ["band", "value"])
    keys = ["band", "value", "low", "high"]
    dealt = chunk_pairs(rows, "set").select(*[F.col(k).cast("long") for k in keys], "own", "set", "fp", "n", "root", "shingles")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches, keys):
            links = list(similar_links(run, radius, similar))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def similar_components(docs: DataFrame, words: int, radius: int = RADIUS, similar: float = SIMILAR) -> DataFrame:
    """docs: doc_id, digest (of the row), text. Returns doc_id, digest and root of every row: root is one
    for all sets of shingles that links of at least ``similar`` connect.

    Equal sets are one class. Links of fingerprints within ``radius`` bits propose pairs of classes. Classes
    are also dealt by the values of their bands: first each is compared with the smallest of each value it
    has, so a large group of near copies costs rows in proportion to it; then, where a value still has
    classes of several components, these are compared tile by tile. Pairs in a band are compared by
    fingerprint, within ``SIMILAR_BITS``, and by size; every pair at last by its sets. A null or empty text
    has the empty set, which is one class.
    """
    rows = cut(sketches(docs, words))
    classes = cut(rows.groupBy("set").agg(*[F.min(c).alias(c) for c in ("fp", "n", "digest")], F.any_value("bands").alias("bands")))
    dealt = classes.select("set", "fp", "n", F.posexplode("bands").alias("band", "value"))
    shared = dealt.groupBy("band", "value").agg(F.min(F.struct("set", "fp", "n")).alias("least"), F.count("*").alias("k")).where("k > 1")
    # What is joined is written first: Spark can split a hot key where both sides are bare shuffles.
    shared = cut(dealt.join(cut(shared.drop("k")), ["band", "value"]))

    fits = F.least("n", "least.n") >= similar * F.greatest("n", "least.n")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))) <= SIMILAR_BITS
    star = shared.where((F.col("set") != F.col("least.set")) & fits & close).select(F.col("least.set").alias("one"), F.col("set").alias("two"))
    # Of a fingerprint that several sets have, the smallest set stands for it.
    first = cut(classes.groupBy("fp").agg(F.min("set").alias("first")))
    linked = near_links(first.select("fp"), radius)
    linked = linked.join(first.toDF("a", "one"), "a").join(first.toDF("b", "two"), "b").select("one", "two")
    same = classes.join(first, "fp").where("set != first").select(F.col("first").alias("one"), F.col("set").alias("two"))
    proposed = star.unionByName(linked).unionByName(same)
    proposed = cut(proposed.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct())

    named = proposed.select(F.col("a").alias("set")).union(proposed.select("b")).union(shared.select("set")).distinct()
    named = classes.select("set", "digest").join(named, "set", "left_semi")
    sets = cut(shingle_sets(docs.select("digest", "text").join(named.hint("shuffle_hash"), "digest").select("set", "text"), words).dropDuplicates(["set"]))
    links = cut(confirmed(proposed, sets, similar))
    roots = cut(connected_components(links).withColumnRenamed("node", "set"))

    placed = shared.drop("least").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    open_ = placed.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    open_ = cut(placed.join(cut(open_.select("band", "value")), ["band", "value"]))
    more = cut(open_links(open_.join(sets, "set"), SIMILAR_BITS, similar))
    if not more.isEmpty():
        roots = cut(connected_components(roots.toDF("a", "b").unionByName(more)).withColumnRenamed("node", "set"))
    roots = cut(classes.select("set").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")))
    return rows.join(roots, "set").select("doc_id", "digest", "root")


def keep_one_of_each(
    docs: DataFrame, columns: list[str], words: int = SHINGLE_WORDS, radius: int = RADIUS, similar: float = SIMILAR
) -> DataFrame:
    """``columns`` (doc_id among them) of the rows that stay: of each component the one with the smallest doc_id.

    Components are those of :func:`similar_components`. One row of each stays, whatever rows of other
    components have its doc_id or also have none: rows with a doc_id before those without, then by a digest
    of ``columns`` and text.
    """
    names = [*columns, *[c for c in ("doc_id", "text") if c not in columns]]
    types = dict(docs.dtypes)
    rows = pick(docs, **{c: types.get(c, "string") for c in names})
    rows = rows.withColumn("digest", F.xxhash64(*names, *[F.col(c).isNull() for c in names]))
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "digest", F.col("text").cast("string").alias("text"))
    found = similar_components(texts, words, radius, similar)
    copies = found.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "copies"))
    stay = cut(copies.groupBy("root").agg(first.alias("row")).select("row.digest", "row.copies"))
    # The texts are dealt by digest once and not sorted: the side that is held in memory is bare digests.
    kept = rows.join(stay.select("digest").hint("shuffle_hash"), "digest", "left_semi")
    if not stay.where("copies > 1").isEmpty():
        kept = kept.dropDuplicates(["digest"])
    return kept.select(*columns)


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
