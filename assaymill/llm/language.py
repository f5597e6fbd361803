"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with known text. A text is compressed
with each dictionary, a chunk at a time, and the language with the smallest total is chosen.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import pick, rows_of, table

UNKNOWN = "und"
#: Documents of a language that its dictionary is filled from, and characters of each. These bound the
#: labelled sample: a dictionary holds at most DOCS x CHARS characters.
DOCS = 96
CHARS = 2000
#: Languages that are learned: those with most learnable documents, so the sample is at most LANGS x DOCS x CHARS.
LANGS = 256
CHUNK = 4096
LEVEL = 3
MARGIN = 0.01
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The text's words in lower case, one space between them, free of digits and signs."""
    return NOT_LETTERS.sub(" ", (text or "").lower()).strip()


def learnable(doc_id: Column) -> Column:
    """Documents that may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def learn(docs: DataFrame, docs_kept: int = DOCS, chars: int = CHARS, langs: int = LANGS) -> dict[str, bytes]:
    """A dictionary for each non-null lang of the learnable rows of ``docs`` (doc_id, text, lang).

    Identifiers of a language are dealt to ``docs_kept`` slots by hash and of each slot one piece is taken,
    from the lowest hash: a sample of fixed size that doesn't hang on the order of rows. A piece is ``chars``
    characters, from a place in the text that the hash gives. Null and empty texts and null identifiers
    aren't learned from; of rows with one identifier the first piece by code point counts, once. Of more than
    ``langs`` languages those with most documents are learned, ties by name. An empty table gives none.
    """
    rows = pick(docs, doc_id="long", lang="string", text="string").where(learnable(F.col("doc_id")))
    rows = rows.where("lang is not null and doc_id is not null")
    hash_ = F.xxhash64("doc_id", F.lit("learn"))
    length = F.length("text")
    start = F.when(length > chars, F.pmod(F.shiftright(hash_, 8), length - chars)).otherwise(0)
    piece = F.struct(hash_.alias("h"), F.col("text").substr(start.cast("int") + 1, F.lit(chars)).alias("piece"))
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).select("lang")
    pieces = rows.where(length > 0).select("lang", F.pmod(hash_, F.lit(docs_kept)).alias("slot"), piece.alias("of"))
    taken = pieces.join(F.broadcast(most), "lang", "left_semi").groupBy("lang", "slot").agg(F.min("of").alias("of"))
    found: dict[str, list] = {}
    for r in taken.collect():  # at most langs x docs_kept rows
        found.setdefault(r["lang"], []).append((r["of"]["h"], letters(r["of"]["piece"])))
    return {k: " ".join(t for _, t in sorted(v)).encode() for k, v in sorted(found.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], chunk: int = CHUNK, level: int = LEVEL):
        import zstandard

        self.chunk, self.compressors = chunk, {}
        for lang, content in dictionaries.items():
            primed = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=level)
            self.compressors[lang] = zstandard.ZstdCompressor(
                level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False
            )

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and its margin: how much smaller it is than the next, from 0 to 1."""
        if not self.compressors or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = letters(text).encode()
        chunks = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        sizes = sorted((sum(len(c.compress(x)) for x in chunks), lang) for lang, c in self.compressors.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row of ``docs`` (doc_id, text).

    score is the margin by which the chosen language's size is below the next one's, 0 to 1; accepted
    is false where it is under ``margin`` (the choice is given all the same). A text that is null or
    has no letter is ``und`` with score 0 and not accepted, as is every text when nothing was learned.
    Equal sizes choose the first language by name. Rows that repeat are all judged; an empty table
    gives no rows; other columns are ignored, and neither doc_id nor any label bears on the choice.
    """

    def classify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for batch in batches:
            out = [(doc_id, *judge(text)) for doc_id, text in rows_of(batch, "doc_id", "text")]
            keys, langs, scores = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    found = pick(docs, doc_id="long", text="string").mapInArrow(classify, "doc_id long, lang_pred string, score double")
    return found.withColumn("accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= margin))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, learn(docs))
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
