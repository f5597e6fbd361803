"""License scans by sentence rules.

A text is cut at sentence ends and line breaks, each piece is normalised, lines that follow one another are
looked up among known licence sentences, and the sequence of identifiers found is matched against ordered licence rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import pick, table, text_or_empty
from assaymill.llm.urls import LOWER, UPPER

END, BREAK = r"[.!?;:]+[\x20\x09-\x0D]+", r"[\x0A\x0D]+"

#: What starts a line of comment and is left of it in a normal sentence.
COMMENT = r"^(?:-+|rem|dnl)(?: |$)"

#: A tag and its value are one sentence; a line that begins with "License:" says which it is; a plus is "or later".
TAG = r"([Ss][Pp][Dd][Xx]-[Ll]icense-[Ii]dentifier):[\x20\x09]*"
FIELD = r"(^|\n)([^A-Za-z0-9\n]*)[Ll]icen[sc]e:[\x20\x09]+"
PLUS = r"(GPL-[0-9.]+)\+"

# How notices name a licence.
PHRASES = ["licensed under", "this work is licensed under", "released under", "distributed under", "available under"]
NAMES = {
    "apache-2.0": ["the apache license version 2.0", "the apache license 2.0"],
    "mit": ["the mit license", "the terms of the mit license"],
    "gpl-3.0": ["the gnu general public license version 3", "the gnu gpl version 3", "the gnu gpl v3"],
    "gpl-2.0": ["the gnu general public license version 2", "the gnu gpl version 2"],
    "bsd-3": ["the bsd 3-clause license", "the 3-clause bsd license"],
    "bsd-2": ["the bsd 2-clause license", "the 2-clause bsd license"],
    "cc-by-nc-4.0": ["cc by-nc 4.0", "a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa-4.0": ["cc by-sa 4.0", "a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-4.0": ["cc by 4.0", "a creative commons attribution 4.0 international license"],
    "mpl-2.0": ["the mozilla public license 2.0"],
    "bsl-1.0": ["the boost software license version 1.0"],
}
# Identifiers of the public list of licences, with their kinds.
TAGS = {
    "MIT": "permissive", "Apache-2.0": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "ISC": "permissive",
    "0BSD": "permissive", "Zlib": "permissive", "BSL-1.0": "permissive", "GPL-2.0-only": "copyleft", "GPL-2.0-or-later": "copyleft",
    "GPL-3.0-only": "copyleft", "GPL-3.0-or-later": "copyleft", "LGPL-2.1-or-later": "copyleft", "LGPL-3.0-or-later": "copyleft",
    "AGPL-3.0-only": "copyleft", "AGPL-3.0-or-later": "copyleft", "MPL-2.0": "copyleft", "EPL-2.0": "copyleft", "CC-BY-4.0": "permissive",
    "CC-BY-SA-4.0": "copyleft", "CC-BY-NC-4.0": "non-commercial", "CC0-1.0": "public-domain", "Unlicense": "public-domain",
}
# Identifiers that were in use before, and what they mean now.
OLD_TAGS = {f"{g}-{v}": f"{g}-{v}-only" for g, v in (("GPL", "2.0"), ("GPL", "3.0"), ("AGPL", "3.0"))} | {"LGPL-2.1": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-or-later"}
# What a sentence says is licensed, how, and how else licences are named in it.
SUBJECTS = ["this project", "this work", "this software", "this code", "this library", "this package", "this program", "this repository", "this file",
            "the project", "the software", "the code", "the library", "the source code", "source code", "all code", "code", "it", "the content"]
GRANTS = [*PHRASES, "made available under", "dual licensed under", "dual-licensed under", "license is", "licence is"]
SHORT = {
    "apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache-2.0", "apache 2.0", "apache license v2.0"],
    "mit": ["mit license", "mit licence", "mit"],
    "gpl-3.0": ["gnu general public license v3.0", "gnu general public license version 3", "gnu gpl v3", "gplv3", "gpl-3.0", "gpl v3"],
    "gpl-2.0": ["gnu general public license v2.0", "gnu general public license version 2", "gnu gpl v2", "gplv2", "gpl-2.0", "gpl v2"],
    "bsd-3": ["bsd 3-clause license", "3-clause bsd license", "bsd-3-clause", "bsd-3-clause license"],
    "bsd-2": ["bsd 2-clause license", "2-clause bsd license", "bsd-2-clause", "bsd-2-clause license"],
    "mpl-2.0": ["mozilla public license 2.0", "mozilla public license version 2.0", "mpl-2.0", "mpl 2.0"],
    "bsl-1.0": ["boost software license version 1.0", "bsl-1.0"],
    "cc-by-4.0": ["cc-by-4.0"], "cc-by-sa-4.0": ["cc-by-sa-4.0"], "cc-by-nc-4.0": ["cc-by-nc-4.0"],
}
FOUNDATION = "as published by the free software foundation"
MAY = "you can redistribute it and or modify it under the terms of the gnu {} public license"
LATER = "either version {} of the license or at your option any later version"
# Sentences of public licences and their notices, normalised, with all identifiers they hold.
TEXTS = {
    "licensed under the apache license version 2.0 the license": "apache-2.0-name",
    "you may not use this file except in compliance with the license": "apache-2.0-use",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "this program is free software": "gpl-free",
    "this library is free software": "gpl-free",
    f"{MAY.format('general')} {FOUNDATION}": "gpl-terms",
    f"{MAY.format('general')} {FOUNDATION} {LATER.format(3)}": "gpl-terms,gpl-3.0-later",
    f"{MAY.format('general')} {FOUNDATION} {LATER.format(2)}": "gpl-terms,gpl-2.0-later",
    f"{MAY.format('general')} {FOUNDATION} version 3 of the license": "gpl-terms,gpl-3.0-name",
    f"{MAY.format('general')} {FOUNDATION} version 2 of the license": "gpl-terms,gpl-2.0-name",
    f"{MAY.format('general')} version 3 {FOUNDATION}": "gpl-terms,gpl-3.0-name",
    f"{MAY.format('general')} version 2 {FOUNDATION}": "gpl-terms,gpl-2.0-name",
    f"{MAY.format('lesser general')} {FOUNDATION}": "lgpl-terms",
    f"{MAY.format('lesser general')} {FOUNDATION} {LATER.format(2.1)}": "lgpl-terms,lgpl-2.1-later",
    f"{MAY.format('lesser general')} {FOUNDATION} {LATER.format(3)}": "lgpl-terms,gpl-3.0-later",
    f"{MAY.format('affero general')} {FOUNDATION}": "agpl-terms",
    f"{MAY.format('affero general')} {FOUNDATION} {LATER.format(3)}": "agpl-terms,gpl-3.0-later",
    LATER.format(3): "gpl-3.0-later",
    LATER.format(2): "gpl-2.0-later",
    LATER.format(2.1): "lgpl-2.1-later",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-terms",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0": "epl-terms",
    "this software is provided as-is without any express or implied warranty": "zlib-warranty",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "this is free and unencumbered software released into the public domain": "unlicense-name",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means": "unlicense-grant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "all rights reserved": "rights-reserved",
    "apache license version 2.0 january 2004": "apache-2.0-title",
    "gnu general public license version 3 29 june 2007": "gpl-3.0-title",
    "gnu general public license version 2 june 1991": "gpl-2.0-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3.0-title",
    "gnu lesser general public license version 2.1 february 1999": "lgpl-2.1-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3.0-title",
    "mozilla public license version 2.0": "mpl-2.0-title",
    "eclipse public license - v 2.0": "epl-2.0-title",
}
# What the titles of full texts are titles of.
TITLES = {"apache-2.0": "Apache-2.0", "agpl-3.0": "AGPL-3.0-only", "lgpl-3.0": "LGPL-3.0-or-later", "lgpl-2.1": "LGPL-2.1-or-later",
          "gpl-3.0": "GPL-3.0-only", "gpl-2.0": "GPL-2.0-only", "mpl-2.0": "MPL-2.0", "epl-2.0": "EPL-2.0"}
SENTENCES = (
    {f"{phrase} {name}": f"{key}-name" for key, names in NAMES.items() for name in names for phrase in PHRASES}
    | {f"spdx-license-identifier {tag.lower()}": f"{tag.lower()}-spdx" for tag in TAGS}
    | TEXTS
)

#: In order: the sentences that must follow one another, the licence, its kind. The first that fits decides.
RULES = [
    *[((f"{tag.lower()}-spdx",), tag, kind) for tag, kind in TAGS.items()],
    (("gpl-free", "agpl-terms", "gpl-3.0-later"), "AGPL-3.0-or-later", "copyleft"),
    (("gpl-free", "lgpl-terms", "lgpl-2.1-later"), "LGPL-2.1-or-later", "copyleft"),
    (("gpl-free", "lgpl-terms", "gpl-3.0-later"), "LGPL-3.0-or-later", "copyleft"),
    (("gpl-free", "gpl-terms", "gpl-3.0-later"), "GPL-3.0-or-later", "copyleft"),
    (("gpl-free", "gpl-terms", "gpl-2.0-later"), "GPL-2.0-or-later", "copyleft"),
    (("gpl-3.0-name",), "GPL-3.0-only", "copyleft"),
    (("gpl-2.0-name",), "GPL-2.0-only", "copyleft"),
    (("cc-by-nc-4.0-name",), "CC-BY-NC-4.0", "non-commercial"),
    (("cc-by-sa-4.0-name",), "CC-BY-SA-4.0", "copyleft"),
    (("mpl-terms", "mpl-copy"), "MPL-2.0", "copyleft"),
    (("mpl-2.0-name",), "MPL-2.0", "copyleft"),
    (("epl-terms",), "EPL-2.0", "copyleft"),
    (("apache-2.0-name", "apache-2.0-use", "apache-2.0-copy"), "Apache-2.0", "permissive"),
    (("apache-2.0-name",), "Apache-2.0", "permissive"),
    (("bsd-terms", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause", "permissive"),
    (("bsd-terms", "bsd-names"), "BSD-3-Clause", "permissive"),
    (("bsd-3-name",), "BSD-3-Clause", "permissive"),
    (("bsd-terms", "bsd-source", "bsd-binary"), "BSD-2-Clause", "permissive"),
    (("bsd-2-name",), "BSD-2-Clause", "permissive"),
    (("bsd-terms",), "BSD-2-Clause", "permissive"),
    (("isc-grant",), "ISC", "permissive"),
    (("0bsd-grant",), "0BSD", "permissive"),
    (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), "MIT", "permissive"),
    (("mit-notice", "mit-warranty"), "MIT", "permissive"),
    (("mit-name",), "MIT", "permissive"),
    (("bsl-1.0-name",), "BSL-1.0", "permissive"),
    (("zlib-warranty",), "Zlib", "permissive"),
    (("cc-by-4.0-name",), "CC-BY-4.0", "permissive"),
    (("unlicense-name",), "Unlicense", "public-domain"),
    (("cc0-dedication",), "CC0-1.0", "public-domain"),
    *[((f"{key}-title",), tag, TAGS[tag]) for key, tag in TITLES.items()],
    (("rights-reserved",), "proprietary", "proprietary"),
]

#: Where a sentence goes on to tell where the licence is found.
TOLD = r" (?:- )?(?:please )?(?:see|refer to|as found in) .*$"
#: Identifiers of the names and tags that a sentence of a grant or an expression of tags holds.
PARTS = {name: f"{key}-name" for part in (NAMES, SHORT) for key, names in part.items() for name in names}
TAG_PARTS = {t.lower(): f"{t.lower()}-spdx" for t in TAGS} | {old.lower(): f"{now.lower()}-spdx" for old, now in OLD_TAGS.items()}


def normal(sentence: Column) -> Column:
    """Letters, digits, hyphens and inner points, A-Z lower-cased, other characters as one space."""
    small = F.translate(sentence, UPPER, LOWER)
    return F.regexp_replace(F.regexp_replace(small, r"[^a-z0-9.\-]+", " "), r"^[ .]+|[ .]+$", "")


def anchors(sentences: dict[str, str]) -> list[str]:
    """Words of which every sentence has one, few of them: at each step the word that most of the rest have."""
    left = {s: set(re.findall(r"[a-z]{7,}", s)) or set(re.findall(r"[a-z]+", s)) for s in sentences}
    chosen = []
    while left:
        every = sorted({w for words in left.values() for w in words}, key=lambda w: (-len(w), w))
        best = max(every, key=lambda w: sum(w in s for s in left))
        chosen.append(best)
        left = {s: words for s, words in left.items() if best not in s}
    return chosen


def one_of(values: list[str], space: str) -> str:
    """Any of the values, the longest that fits; ``space`` stands between their words."""
    return "(?:" + "|".join(space.join(map(re.escape, v.split())) for v in sorted(values, key=len, reverse=True)) + ")"


def grant_patterns(space: str) -> list[str]:
    """Sentences by their parts: who is licensed, if said, under what, and where that is told; and expressions of tags."""
    name, tag = one_of(list(PARTS), space), one_of(list(TAG_PARTS), space)
    subject = f"(?:{one_of(SUBJECTS, space)}{space}(?:is|are){space})?"
    more = f"(?:{space}(?:and{space}or|and|or|and{space}the|or{space}the){space}{name})*"
    told = f"(?:{space}(?:- )?(?:please )?(?:see|refer{space}to|as{space}found{space}in)[^|]*?)?"
    also = f"(?:{space}(?:or|and|with){space}[a-z0-9.-]+)+"
    return [f"{subject}{one_of(GRANTS, space)}{space}{name}{more}{told}", f"spdx-license-identifier{space}{tag}(?:{also})?"]


def parts_pattern(parts: dict[str, str]) -> str:
    return r"\b" + one_of(list(parts), " ") + r"\b"


def sentence_pattern(sentences: dict[str, str]) -> str:
    """Matches a known sentence, or one of the parts of :func:`grant_patterns`, among lines with `` | `` and sentences with
    `` || `` between them, over any number of lines, but never over the end of a sentence."""
    space = r"(?: \|)? "
    return r"(?<=\| )(?:" + "|".join([one_of(list(sentences), space), *grant_patterns(space)]) + r")(?= \|)"


def scan_licences(
    docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None
) -> DataFrame:
    """doc_id, n_known, sentence_ids, rule, license, category and all_licenses of every row of ``docs``.

    sentence_ids: identifiers of known sentences in the order of the text, joined by commas; n_known: how many. A sentence
    that grants a licence has the identifiers of all that it names, an expression of tags those of its tags.
    A sentence may be wrapped over any number of lines, each with or without a prefix of comments. rule (its
    number from 1), license and category: of the first rule whose identifiers follow one another in that
    sequence; null if none does. all_licenses: of all rules that fit, each once, in order.

    A null or empty text has no sentence: n_known 0, empty strings, nulls. Rows that repeat are all
    scanned. An empty table gives no rows. Other columns are ignored. The scan is local to a row, so
    nothing is shuffled; texts without a word of any of the sentences aren't cut up.
    """
    sentences = SENTENCES if sentences is None else sentences
    rules = RULES if rules is None else rules
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    rows = pick(docs, doc_id="long", text="string").select("doc_id", text_or_empty().alias("whole"))
    small = F.lower("whole")
    some = F.lit(False)
    for word in [*anchors(sentences), "licen", "released", "distributed", "available"]:
        some = some | F.contains(small, F.lit(word))
    tagged = F.regexp_replace(F.regexp_replace("whole", TAG, "$1 "), FIELD, "$1$2license is ")
    tagged = F.regexp_replace(tagged, PLUS, "$1-or-later")
    parts = F.when(some, F.split(tagged, END)).otherwise(F.array().cast("array<string>"))

    def lines(part: Column) -> Column:
        pieces = F.transform(F.split(part, BREAK), lambda s: F.regexp_replace(normal(s), COMMENT, ""))
        return F.array_join(F.filter(pieces, lambda s: s != ""), " | ")

    cut_up = F.array_join(F.filter(F.transform(parts, lines), lambda s: s != ""), " || ")
    rows = rows.select("doc_id", F.concat(F.lit("| "), cut_up, F.lit(" |")).alias("line"))
    found = F.regexp_extract_all("line", F.lit(sentence_pattern(sentences)), F.lit(0))
    of_parts = F.create_map(*[F.lit(x) for pair in (PARTS | TAG_PARTS).items() for x in pair])

    def identified(matched: Column) -> Column:
        sentence = F.replace(matched, F.lit(" | "), F.lit(" "))
        told = F.regexp_replace(sentence, TOLD, "")
        pattern = F.when(F.startswith(sentence, F.lit("spdx")), parts_pattern(TAG_PARTS)).otherwise(parts_pattern(PARTS))
        parts = F.transform(F.regexp_extract_all(told, pattern, F.lit(0)), lambda p: F.element_at(of_parts, p))
        return F.coalesce(F.split(F.try_element_at(known, sentence), ","), parts)

    ids = F.flatten(F.transform(found, identified))
    rows = rows.select("doc_id", ids.alias("ids"))
    rows = rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
    )
    line = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    fits = [F.contains(line, F.lit("," + ",".join(ids_) + ",")) for ids_, _, _ in rules]

    def first(values: list) -> Column:
        return F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values, strict=True)])

    every = F.array_compact(F.array(*[F.when(fit, F.lit(r[1])) for fit, r in zip(fits, rules, strict=True)]))
    return rows.select(
        "doc_id",
        "n_known",
        "sentence_ids",
        first(list(range(1, len(rules) + 1))).cast("long").alias("rule"),
        first([r[1] for r in rules]).alias("license"),
        first([r[2] for r in rules]).alias("category"),
        F.array_join(F.array_distinct(every), ",").alias("all_licenses"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """All columns of :func:`scan_licences` over all of ``documents``."""
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({n}, {quoted(',' + ','.join(i) + ',')}, {quoted(a)}, {quoted(c)})" for n, (i, a, c) in enumerate(RULES, 1))
    # Every line stands between marks of its own, and a mark of its own parts sentences: matches share none.
    space = r"(?: \| \|)? "
    pattern = quoted(r"\| (" + "|".join([one_of(list(SENTENCES), space), *grant_patterns(space)]) + r") \|")
    parts = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in (PARTS | TAG_PARTS).items())
    return f"""
with known(sentence, ids) as (values {known}), parts_of(part, id) as (values {parts}), rules(n, ids, license, category) as (values {rules}),
docs as (select row_number() over () as k, cast(doc_id as bigint) as doc_id, coalesce(text, '') as text from documents),
parts as (
  select k, generate_subscripts(parts, 1) as part_at, unnest(parts) as part
  from (select k, string_split_regex(regexp_replace(regexp_replace(regexp_replace(text, '{TAG}', '\\1 ', 'g'), '{FIELD}', '\\1\\2license is ', 'g'), '{PLUS}', '\\1-or-later', 'g'), '{END}') as parts from docs)
), lines as (
  select k, part_at, generate_subscripts(lines, 1) as line_at, unnest(lines) as line
  from (select k, part_at, string_split_regex(part, '{BREAK}') as lines from parts)
), normal as (
  select k, part_at, line_at,
         regexp_replace(
           regexp_replace(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[^a-z0-9.\\-]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'),
           '{COMMENT}', '') as line
  from lines
), joined as (
  select k, part_at, '| ' || string_agg(line, ' | | ' order by line_at) || ' |' as part
  from normal where line <> '' group by k, part_at
), matches as (
  select k, part_at, generate_subscripts(found, 1) as found_at, unnest(found) as sentence
  from (select k, part_at, regexp_extract_all(part, {pattern}, 1) as found from joined)
), whole as (
  select k, part_at, found_at, replace(sentence, ' | | ', ' ') as sentence from matches
), named as (
  select k, part_at, found_at, generate_subscripts(names, 1) as name_at, unnest(names) as part
  from (select k, part_at, found_at, regexp_extract_all(regexp_replace(sentence, {quoted(TOLD)}, ''),
          case when starts_with(sentence, 'spdx') then {quoted(parts_pattern(TAG_PARTS))} else {quoted(parts_pattern(PARTS))} end) as names
        from whole where sentence not in (select sentence from known))
), identified as (
  select w.k, w.part_at, w.found_at, known.ids from whole w join known using (sentence)
  union all
  select k, part_at, found_at, string_agg(id, ',' order by name_at) from named join parts_of using (part) group by 1, 2, 3
), found as (
  select k, string_agg(ids, ',' order by part_at, found_at) as ids from identified group by k
), fitting as (
  select f.k, r.n, r.license, r.category from found f join rules r on contains(',' || f.ids || ',', r.ids)
), best as (
  select k, min(n) as rule, arg_min(license, n) as license, arg_min(category, n) as category from fitting group by k
), every as (
  select k, string_agg(license, ',' order by n) as all_licenses
  from (select k, license, min(n) as n from fitting group by k, license) group by k
)
select d.doc_id, cast(coalesce(len(string_split(f.ids, ',')), 0) as bigint) as n_known, coalesce(f.ids, '') as sentence_ids,
       cast(b.rule as bigint) as rule, b.license, b.category, coalesce(e.all_licenses, '') as all_licenses
from docs d left join found f using (k) left join best b using (k) left join every e using (k)
"""


OP5_SQL = _sql()
