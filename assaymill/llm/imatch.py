"""I-Match document fingerprints.

Terms within a band of document frequency make up the lexicon. A text is reduced to its distinct lexicon
terms in order, and each of several randomised subsets of the lexicon gives one hash of those of its
terms that lie in the subset. Subsets come in levels of growing sparsity, so that short and long texts
both have levels at which a subset holds a few of their terms and survives a few edits.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import cut, pick, rows_of, table

#: Band of document frequency, as shares of all documents. A term needs two documents at least. Where more
#: than LEXICON terms lie in the band, its lower end rises: the lexicon is those of most documents. It is
#: broadcast, as terms, and a worker holds LEVELS x SUBSETS bytes for each.
LOWEST, HIGHEST = 0.0005, 0.1
LEXICON = 400_000
LEVELS, SUBSETS = 6, 24
#: Subsets that must hold a term at a level for texts to be compared there.
HELD = 6
PART_DOCS = 4096
MOST_PARTS = 20_000
FLUSH_TERMS = 200_000

# ASCII capitals to small letters, ASCII signs and control characters to spaces.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: str) -> set[bytes]:
    """Distinct words, folded."""
    return set(text.encode().translate(FOLD).split())


def term_hash(term: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(term, 7)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (binary) and df (documents that have it), over all rows of ``docs`` (text)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"]
            )
            seen.clear()
            return out

        for batch in batches:
            for (text,) in rows_of(batch, "text"):
                seen.update(terms_of(text or ""))
                if len(seen) >= FLUSH_TERMS:
                    yield flush()
        yield flush()

    counted = pick(docs, text="string").mapInArrow(count, "term binary, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("df"))


def learn_lexicon(docs: DataFrame, lowest: float = LOWEST, highest: float = HIGHEST, most: int = LEXICON) -> list[bytes]:
    """The terms of the band, in order: ``most`` at most, those of most documents, ties by term."""
    total = docs.count()
    least = max(2, math.ceil(lowest * total))
    band = cut(document_frequencies(docs).where(F.col("df").between(least, max(least, math.floor(highest * total)))))
    if band.count() > most:
        band = band.orderBy(F.desc("df"), "term").limit(most)
    return sorted(bytes(r["term"]) for r in band.select("term").collect())


class Lexicon:
    """Sorted terms with their hashes and the subsets they lie in."""

    def __init__(self, terms: list[bytes], levels: int = LEVELS, subsets: int = SUBSETS):
        self.levels, self.subsets = levels, subsets
        self.place = {t: i for i, t in enumerate(terms)}
        self.hashes = np.array([term_hash(t) for t in terms], "<u8")
        # A term's chance of being in a subset of level l is 4 ** -l, drawn by its hash and the subset.
        self.members = np.zeros((len(terms), levels * subsets), bool)
        for k in range(levels * subsets):
            mixed = (self.hashes ^ np.uint64((k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(33)
            mixed *= np.uint64(0xC4CEB9FE1A85EC53)
            self.members[:, k] = (mixed >> np.uint64(11)).astype(float) < 2.0 ** (53 - 2 * (k // subsets))

    def fingerprint(self, text: str) -> bytes:
        """8 bytes for all lexicon terms, then 2 for each subset; 0 where a subset holds none of them.

        Of a text without a lexicon term the 8 bytes stand for its other terms: an empty signature would
        make all such texts one.
        """
        import xxhash

        terms = terms_of(text)
        find = self.place.get
        ids = sorted(i for i in map(find, terms) if i is not None)
        if not ids:
            whole = xxhash.xxh64_intdigest(b" ".join(sorted(terms)), 11)
        else:
            whole = xxhash.xxh64_intdigest(self.hashes[ids].tobytes(), 13)
        out = [struct.pack(">Q", whole)]
        hashes, members = self.hashes[ids], self.members[ids]
        some = members.any(0)
        for k in range(members.shape[1]):
            if not some[k]:
                out.append(b"\0\0")
            else:
                h = xxhash.xxh64_intdigest(hashes[members[:, k]].tobytes(), k) % 65535 + 1
                out.append(struct.pack(">H", h))
        return b"".join(out)

    def likeness(self, a: bytes, b: bytes) -> float:
        """From 0 to 1: of the subsets that hold a term of either text, the share with equal hashes.

        Taken from the sparsest level at which ``HELD`` subsets or more hold a term, and sparser ones;
        denser ones change with every edit of a long text. Equal fingerprints are 1.
        """
        if a == b:
            return 1.0
        x = np.frombuffer(a, ">u2")[4:].reshape(self.levels, self.subsets)
        y = np.frombuffer(b, ">u2")[4:].reshape(self.levels, self.subsets)
        held = (x != 0) | (y != 0)
        counts = held.sum(1)
        usable = np.flatnonzero(counts >= HELD)
        level = usable[-1] if len(usable) else 0
        return float(((x == y) & held)[level:].sum() / max(1, counts[level:].sum()))


def edited(text: str, after: str) -> str:
    """The text with the last half of its characters replaced by as many of the next one's first."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


def neighbours(docs: DataFrame, part_docs: int = PART_DOCS) -> DataFrame:
    """doc_id, body (the text, compressed), part, extra, tie, ordered within partitions by part, extra, doc_id,
    tie: every row once, with extra 0, and after a part's rows once more the row that follows them (extra 1),
    so that each row's successor in the order of doc_id (null first, ties by text hash; after the last the
    first) stands right behind it.

    Parts are ranges of doc_id and text hash, so many texts of one doc_id come to several parts.
    """
    rows = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = max(1, min(MOST_PARTS, math.ceil(docs.count() / part_docs)))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie")
    keys = rows.select("doc_id", "tie").repartitionByRange(parts, *order)
    firsts = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("least"))
    # The least key of each part; one row a part, at most MOST_PARTS.
    bounds = sorted({tuple(r["least"]) for r in firsts.collect()})

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            found = []
            heads = set()  # of equal rows that begin a part one is enough
            for doc_id, text, tie in rows_of(batch, "doc_id", "text", "tie"):
                own = doc_id is not None, doc_id or 0, tie
                part = max(0, bisect.bisect_right(bounds, own) - 1)
                body = press(text.encode())
                found.append((doc_id, body, part, 0, tie))
                if own == bounds[part] and own not in heads:
                    heads.add(own)
                    found.append((doc_id, body, (part - 1) % len(bounds), 1, tie))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "body", "part", "extra", "tie"]
            )

    dealt = rows.mapInArrow(deal, "doc_id long, body binary, part long, extra int, tie long").repartition("part")
    return dealt.sortWithinPartitions("part", "extra", *order)


def imatch_fingerprints(docs: DataFrame, terms: list[bytes] | None = None) -> DataFrame:
    """Fingerprints of every row's text and of its edited text.

    docs: doc_id, text. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has the last half of the characters replaced by as many
    of the next document's first (all, if it has fewer), in ascending order of doc_id; after the last
    comes the first, and a table of one row is its own next. terms: a lexicon; by default that of docs.

    A null text counts as empty; texts without a lexicon term have no subset hashes and are told
    apart by a hash of their other terms. A null doc_id comes first; rows with equal doc_id go by text
    hash, and rows equal in both follow one another. An empty table gives no rows. Other columns are ignored. Equal texts have equal fingerprints.
    """
    lexicon = learn_lexicon(docs) if terms is None else sorted(terms)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = Lexicon(sent.value)
        unpress = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names
            )
            out.clear()
            return made

        last = None  # doc_id, text, fingerprint, part
        closed = None  # the part whose successor has been met
        for batch in batches:
            for doc_id, body, part, extra in rows_of(batch, "doc_id", "body", "part", "extra"):
                if extra and closed == part:
                    continue
                text = unpress(body).decode()
                own = known.fingerprint(text)
                if last is not None and last[3] == part:
                    changed = edited(last[1], text)
                    other = known.fingerprint(changed)
                    sha = hashlib.sha256(changed.encode()).hexdigest()
                    near = known.likeness(last[2], other), known.likeness(last[2], own)
                    out.append((last[0], len(last[1]), sha, last[2].hex(), other.hex(), *near))
                    if len(out) >= 1000:
                        yield batch_of()
                if extra:
                    closed, last = part, None
                else:
                    last = doc_id, text, own, part
        if out:
            yield batch_of()

    return neighbours(docs).select("doc_id", "body", "part", "extra").mapInArrow(
        compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def op10_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    return imatch_fingerprints(table(spark, sf_dir, "documents"))
