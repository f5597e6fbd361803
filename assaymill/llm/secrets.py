"""Secret scans: patterns of known kinds, and zstandard novelty in sensitive places.

A run of key characters near a word such as ``secret``, before or after it, is a candidate. Its novelty is what it adds to
the compressed size of the text around it, with a dictionary of the corpus's own identifiers and of words primed into
the compressor: names, paths and long words are cheap there, random keys cost nearly all their bytes. Incompressible candidates are
reported beside the matches of the patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import pick, rows_of, table

# The three base kinds, in the order in which spans that start together are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "novel"]

#: Words that make a place sensitive, in lower case.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "api key", "private_key",
             "private key", "access_key", "access key", "credential", "auth_key", "bearer ", "begin rsa", "connectionstring")
PLACE = re.compile("|".join(map(re.escape, SENSITIVE)), re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~$%^&*!@#-]{16,}")

#: What code around keys is made of: primes the compressor.
IDENTIFIERS = " ".join(
    f"{a}{b} {a.title()}{b.title()}" for a in ("", "client_", "access_", "private_", "public_", "my", "get", "set", "user", "db_", "aws_", "auth")
    for b in ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "credential", "config", "value", "string",
              "name", "username", "host", "port", "url", "return", "self", "const", "import", "export", "environ", "bearer")
) + " abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx ****************"

#: What parts of a path or a name stand between, and characters that a part has at least to be judged by itself.
SEPARATOR, KEY_LENGTH = re.compile("[/_.-]+"), 16
#: What stands between two = of a run, with the padding after it.
PART = re.compile(r"[^=]+=*")

#: Long words of prose, paths and code, and parts of such words: primes the compressor, too.
WORDS = """
authentication authorization authorize administrator administration application applications service services server
client customer account accounts configuration configurations settings setting environment environments production
development deployment deployments component components container kubernetes infrastructure organization organizations
international internationalization localization information management manager department documentation document
documents reference references database databases repository repositories project projects packages package modules
module source sources scripts script resources resource assets static public private internal external security secure
encryption decryption encrypted certificate certificates signature verification validation registration notification
notifications communication communications transaction transactions transport connection connections controller
controllers handler handlers manager provider providers factory interface implementation abstract exception runtime
response request requests session sessions storage bucket endpoint endpoints function functions variable variables
template templates example examples tutorial testing integration performance responsibility responsibilities
relationship understanding characteristic characteristics representative representation recommendation recommendations
government environmental professional educational traditional additional conditional national regional institution
university community technology technologies development successful successfully immediately particularly
approximately significant significantly unfortunately nevertheless straightforward self-contained well-known
state-of-the-art step-by-step end-to-end up-to-date long-term short-term user-friendly open-source
home/user/ usr/local/bin/ usr/share/ etc/ var/log/ opt/ src/main/java/com/ src/components/ lib/ node_modules/ path/to/ org/ com/ net/
en/ de/ fr/ es/ index login Login Form Page View Model Controller Service Manager Handler Factory Provider Repository
secret_file_name file_name file-name keys key-vault private-keys access-keys secret-manager password-reset reset-password
Geschwindigkeit Begrenzung begrenzung Verwaltung verwaltung Versicherung versicherung Gesellschaft gesellschaft schaften
keit heit ung ungen lich lichkeit Entwicklung entwicklung Verantwortung Bundes Regierung regierung Arbeit arbeits
Wissenschaft wissenschaftlich Sicherheit sicherheits Geheimnis Schlüssel Passwort Benutzer benutzer Zugang zugangs
anticonstitutionnellement gouvernement développement établissement administration malheureusement particulièrement
Donau Dampfschiff dampfschiff Schifffahrt schifffahrts gesellschafts Kapitän kapitän kapitaen Rechtsschutz Kraftfahrzeug Haftpflicht
haftpflicht
Lebensmittel verträglich Straßen strassen verkehrs zulassungs Ordnung ordnung Grundstücks genehmigungs zuständigkeit Betriebs betriebs
fähigkeits bescheinigung Arbeiter arbeiter Unfall unfall Gesetz gesetz ausbildungs förderungs foerderungs versicherungs
responsabilité responsabilidad desarrollo administración organización información aproximadamente particularmente
tion tions ment ments ness able ible ally ization isation ological ography ically ences ances
"""

REACH = 64
AROUND = 256
PIECE = 128
NOVELTY = 0.75

#: Names in code: words joined by _ or -, or by capitals. Without digits, and of short words, so keys aren't taken.
NAME = r"\b(?:[A-Za-z]{2,16}(?:[_-][A-Za-z]{2,16})+|[A-Za-z][a-z]{1,15}(?:[A-Z][a-z]{1,15})+)\b"
#: A text with one of these may hold code.
CODE_SIGNS = ("_", "(", "{", "=")
#: Names that are learned at most, and documents that must have one.
NAMES_KEPT, NAME_DOCS = 2048, 8

SPAN = "array<struct<kind:string,start:int,end:int,novelty:double>>"


class Novelty:
    """Marginal compressed bytes for each byte of a candidate, given what surrounds it but isn't a copy of it."""

    def __init__(self, identifiers: str = WORDS + IDENTIFIERS, level: int = 19):
        import zstandard

        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(
            level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode()))

    def __call__(self, text: str, start: int, end: int) -> float:
        """Of the whole run, or of the part of it between separators that is most novel: a key is not hidden by the path
        it ends. Copies of what is judged are left out of what surrounds it: a key that is written twice stays novel."""
        around = text[max(0, start - AROUND) : start] + text[end : end + AROUND] + "\n"
        run = text[start:end]
        value = self.marginal(around, run)
        for part in SEPARATOR.split(run):
            if value >= NOVELTY:
                break
            if KEY_LENGTH <= len(part) < len(run):
                value = max(value, self.marginal(around, part))
        return value

    def marginal(self, around: str, run: str) -> float:
        """Of a long run the mean over its pieces, each by itself in the same place: in a long run the
        code of its letters would be learned, too."""
        around = around.replace(run, "")
        alone = self.size(around)
        cuts = [*range(0, max(1, len(run) - PIECE + 1), PIECE), len(run)]
        added = sum(self.size(around + run[a:b]) - alone for a, b in zip(cuts, cuts[1:], strict=False))
        return added / len(run.encode())


def base_spans(text: str) -> list[tuple[str, int, int, float | None]]:
    """Matches of the three patterns; those of a kind don't overlap, and failing ones are dropped."""
    found = [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span(), None) for m in HEX.finditer(text)]


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of key characters. What stands before an inner = and what stands after it are two."""
    for m in CANDIDATE.finditer(text):
        for part in PART.finditer(m[0]):
            if len(part[0]) >= KEY_LENGTH:
                yield m.start() + part.start(), m.start() + part.end()


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs at most REACH from a sensitive word, before it or after."""
    places = [m.span() for m in PLACE.finditer(text)]
    at = 0
    for start, end in runs(text):
        while at < len(places) and places[at][1] + REACH < start:
            at += 1
        if any(a - REACH <= end and start <= b + REACH for a, b in near(places, at, end)):
            yield start, end


def near(places: list[tuple[int, int]], at: int, end: int) -> Iterator[tuple[int, int]]:
    """Places from number ``at`` on that begin at most REACH after ``end``."""
    while at < len(places) and places[at][0] - REACH <= end:
        yield places[at]
        at += 1


def find_spans(text: str, novelty: Novelty, threshold: float = NOVELTY) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text by start, then kind. Positions are code points, the end is exclusive."""
    low = text.lower()
    sensitive = any(word in low for word in SENSITIVE)
    found = base_spans(text) if sensitive or "AKIA" in text else [("hex", *m.span(), None) for m in HEX.finditer(text)]
    if sensitive:
        taken = sorted((s, e) for _, s, e, _ in found)
        keys: dict[str, float] = {}
        for start, end in candidates(text):
            if any(s <= start and end <= e for s, e in taken):
                continue
            value = novelty(text, start, end)
            if value >= threshold:
                keys[text[start:end]] = round(value, 4)
        # A key is one wherever it stands as a run of its own.
        for start, end in runs(text) if keys else ():
            if text[start:end] in keys and not any(s <= start and end <= e for s, e in taken):
                found.append(("novel", start, end, keys[text[start:end]]))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def learn_names(docs: DataFrame, most: int = NAMES_KEPT, least: int = NAME_DOCS) -> str:
    """The names of code that most documents have: ``most`` at most, each in ``least`` or more of all rows of
    ``docs`` (text). Null and empty texts have none, repeated rows count each time; of names in equally many
    documents the first by code point are taken."""
    rows = pick(docs, text="string")
    signs = F.lit(False)
    for sign in CODE_SIGNS:
        signs = signs | F.contains("text", F.lit(sign))
    names = rows.where(signs).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))).alias("name"))
    often = names.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return " ".join(r["name"] for r in often.orderBy(F.desc("n"), "name").limit(most).collect())


def scan_secrets(docs: DataFrame, threshold: float = NOVELTY, names: str | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end, novelty) of every row of ``docs`` (doc_id, text).

    Kinds: assign, access, hex (patterns; their novelty is null) and novel. Spans are ordered by start,
    then kind. names: what primes the compressor besides fixed words; by default the names of ``docs``
    themselves. A null or empty text has none. Rows that repeat are all scanned. An empty table gives no
    rows. Other columns are ignored. A row is scanned on its own, so no text is shuffled.
    """
    names = learn_names(docs) if names is None else names

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(f"{names} {WORDS}{IDENTIFIERS}")
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))
        for batch in batches:
            keys, spans = [], []
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                keys.append(doc_id)
                found = find_spans(text or "", novelty, threshold)
                spans.append([dict(zip(("kind", "start", "end", "novelty"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spans, kind)], names=["doc_id", "spans"])

    return pick(docs, doc_id="long", text="string").mapInArrow(scan, f"doc_id long, spans {SPAN}")


def redact(text: str | None, novelty: Novelty, mask: str = "[SECRET]", threshold: float = NOVELTY) -> str | None:
    """The text with each span, or run of spans that overlap, replaced by ``mask``."""
    if not text:
        return text
    out, at = [], 0
    for _, start, end, _ in find_spans(text, novelty, threshold):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, columns: list[str], mask: str = "[SECRET]", threshold: float = NOVELTY, names: str | None = None) -> DataFrame:
    """``columns`` of all rows of ``docs`` with secrets masked in text, and n_chars, if asked for, counted anew.

    names: as in :func:`scan_secrets`. A null text stays null (n_chars too), an empty one empty. Repeated rows
    all stay, each masked alike. An empty table gives no rows. Columns that aren't named, or whose names clash
    with a named one, are left out.
    """
    names = learn_names(docs) if names is None else names
    types = dict(docs.dtypes) | {"text": "string"}
    rows = pick(docs, **{c: types[c] for c in columns})
    schema = rows.schema

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(f"{names} {WORDS}{IDENTIFIERS}")
        at = columns.index("text")
        for batch in batches:
            texts = pa.array([redact(t, novelty, mask, threshold) for (t,) in rows_of(batch, "text")], pa.string())
            arrays = [texts if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = rows.mapInArrow(clean, schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(types["n_chars"]))
    return out.select(*columns)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of the spans in all of ``documents``."""
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )
