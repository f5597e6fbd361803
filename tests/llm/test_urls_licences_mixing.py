import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assaymill.llm import licences, mixing, urls
from tests.llm.fixtures import edge_docs, edge_rows, empty_docs
from tests.llm.oracle import same_as_sql

URLS = [
    None, "", "no scheme", "http://", "https://net", "https://net/", "HTTP://A.NET/x", "https://Example.NET/en/1?a=b#c",
    "https://x.example.net/en/", "https://example.net/en", "https://example.net?/en/", "https://example.com/de/x",
    "https://www.example.com/de/", "https://a.b.org/fr/", "https://org/fr/", "https://notnet/", "https://x.net./",
    "https://..net/", "ftp://é.org/fr/ü?x", "https://user@example.net:80/en/", "a://b://net/", "https://x.net/" + "y" * 20_000,
]


def naive_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS + URLS)], "page_id long, url string, URL int")
    rules = spark.createDataFrame([*urls.RULES, (None, "/", "block"), ("NET", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(pages, rules).collect()}
    assert len(got) == 2 * len(URLS)
    assert got == {i: naive_verdict(u) for i, u in enumerate(URLS + URLS)}


def test_urls_without_rows_or_rules(spark):
    pages = spark.createDataFrame([(1, "https://net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urls.judge_urls(pages, rules).collect()] == [(1, "net", "/", None, "allow")]
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame(urls.RULES, rules.schema)).collect() == []


def test_more_urls_rules_decide_alike(spark):
    rng = random.Random(3)
    hosts = ["a.b.c", "b.c", "c", "x.c", "b"]
    rules = [(rng.choice(hosts), rng.choice(["", "/", "/p", "/p/", "/p/q"]), rng.choice(["allow", "block"])) for _ in range(25)]
    pages = [(i, f"s://{rng.choice(['', 'y.', 'a.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q/r', '/pq'])}") for i in range(200)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in pages:
        host, _, path = u[4:].partition("/")
        path = "/" + path if "/" in u[4:] else ""
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert got[i] == ((best[3], best[2]) if best else (None, "allow"))


def test_url_query_equals_sql(spark, sf_dir):
    same_as_sql(urls.op4_url_filter(spark, sf_dir), urls.OP4_SQL, pages=f"{sf_dir}/pages.parquet")


LICENSED = [
    ("MIT License text.\nReleased under the MIT License.", "mit-name", "MIT"),
    ("x\nLicensed under the Apache License, Version 2.0.", "apache-2.0-name", "Apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
     "gpl-free,gpl-terms,gpl-3.0-later", "GPL-3.0-or-later"),
    ("ALL RIGHTS RESERVED!\nSPDX-License-Identifier: MIT", "rights-reserved,mit-spdx", "MIT"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\nAll rights reserved.", "gpl-2.0-or-later-spdx,rights-reserved", "GPL-2.0-or-later"),
    ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License", "cc-by-nc-4.0-name,mit-name", "CC-BY-NC-4.0"),
    ("we are licensed to sell; rights are not reserved", "", None),
]


def test_licences_by_sentence_and_rule(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LICENSED)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    for i, (_, ids, name) in enumerate(LICENSED):
        assert (got[i].sentence_ids, got[i].license) == (ids, name)
    assert got[5].all_licenses == "CC-BY-NC-4.0,MIT"


def test_every_rule_can_decide(spark):
    by_id = {i: s for s, i in licences.SENTENCES.items()}
    docs = [(n, "\n".join(by_id[i] for i in ids)) for n, (ids, _, _) in enumerate(licences.RULES)]
    got = {r.doc_id: r.license for r in licences.scan_licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {n: name for n, (_, name, _) in enumerate(licences.RULES)}


def test_licence_query_equals_sql(spark, sf_dir):
    same_as_sql(licences.op5_license_scan(spark, sf_dir), licences.OP5_SQL, documents=f"{sf_dir}/documents.parquet")
    plain = [(i, t) for i, (t, _, _) in enumerate(LICENSED)] + [r[:2] for r in edge_rows()]
    docs = spark.createDataFrame(plain, "doc_id long, text string")
    same_as_sql(licences.scan_licences(docs), licences.OP5_SQL, documents=docs.toPandas())
    assert licences.scan_licences(empty_docs(spark)).collect() == []


def naive_targets(sizes, share=1.5, most=2):
    """sizes: source -> words. Shares by weight; what a full source leaves is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        of = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] for s in full} | {s: left * weight[s] / of for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_equals_sql(spark, sf_dir):
    same_as_sql(mixing.op7_mix_sources(spark, sf_dir), mixing.OP7_SQL, documents=f"{sf_dir}/documents.parquet")


def test_mixing_meets_targets(spark):
    docs = edge_docs(spark)
    rows = mixing.mix_sources(docs, shard_words=5000).collect()
    assert len(rows) == len(edge_rows())
    sizes = Counter()
    for doc_id, text, _, source, _ in edge_rows():
        sizes[source] += len((text or "").encode().split())
    want = naive_targets(dict(sizes))
    source_of = {r[0]: r[3] for r in edge_rows() if r[0] is not None}
    for r in rows:
        assert r.taken == r.size * len(r.draws) <= 2 * r.size
        assert len({d.round for d in r.draws}) == len(r.draws)
        if r.doc_id is not None:
            assert r.target == pytest.approx(want[source_of[r.doc_id]])
            assert r.source_size == sizes[source_of[r.doc_id]]
    assert mixing.mix_sources(empty_docs(spark)).collect() == []
    again = mixing.mix_sources(docs.repartition(7), shard_words=5000).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_sources_come_near_their_targets(spark):
    folder = "/root/testdata/sf0.01"
    rows = mixing.op7_mix_sources(spark, folder).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))


def test_hypergeometric_draws_have_the_right_distribution(spark):
    good, bad, draw = 12, 30, 9
    u = (F.col("id") + 0.5) / 4000
    rows = spark.range(4000).select(mixing.hypergeometric(F.lit(good).cast("long"), F.lit(bad).cast("long"), F.lit(draw).cast("long"), u).alias("k"))
    got = Counter(r.k for r in rows.collect())
    for k in range(draw + 1):
        p = math.comb(good, k) * math.comb(bad, draw - k) / math.comb(good + bad, draw)
        assert abs(got[k] - 4000 * p) <= 2


@pytest.mark.parametrize(("good", "bad", "draw", "want"), [(0, 5, 3, 0), (5, 0, 3, 3), (4, 3, 7, 4), (4, 3, 0, 0), (1, 0, 1, 1)])
def test_hypergeometric_without_choice(spark, good, bad, draw, want):
    long = lambda n: F.lit(n).cast("long")
    assert spark.range(1).select(mixing.hypergeometric(long(good), long(bad), long(draw), F.lit(0.3))).head()[0] == want


def test_tree_keeps_quotas_and_shard_sizes(spark):
    quotas = {0: 1000, 1: 37, 2: 0, 3: 463}
    df = spark.createDataFrame(list(quotas.items()), "rank int, quota long")
    rows = mixing.shard_quotas(df, 7).collect()
    by_shard, by_rank = Counter(), Counter()
    for r in rows:
        assert r.blocks >= 0
        by_shard[r.shard] += r.blocks
        by_rank[r.rank] += r.blocks
    assert dict(by_rank) == quotas
    assert set(by_shard) == set(range(7)) and max(by_shard.values()) - min(by_shard.values()) <= 3
    assert rows == mixing.shard_quotas(df, 7).collect()


def test_dealt_documents_are_those_drawn(spark):
    docs = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    drawn = Counter()
    for r in mixing.mix_sources(docs, shard_words=5000).collect():
        drawn[r.doc_id] += len(r.draws)
    dealt = mixing.deal_documents(docs, docs.columns, shard_words=5000)
    assert dealt.columns == docs.columns
    got = Counter(r.doc_id for r in dealt.collect())
    assert got == Counter({k: n for k, n in drawn.items() if n})


def test_mixing_with_many_empty_texts_equals_sql(spark):
    texts = [(i, None if i % 6 == 0 else "" if i % 3 == 0 else "word " * (1 + i % 7)) for i in range(400)]
    docs = spark.createDataFrame([(i, f"s{i % 2}", t) for i, t in texts], "doc_id long, source string, text string")
    got = mixing.mix_sources(docs).withColumn("n_draws", F.size("draws").cast("long"))
    got = got.select("doc_id", "size", "source_size", "target", "taken", "n_draws")
    same_as_sql(got, mixing.OP7_SQL, documents=docs.toPandas())


NOTICE_TEXTS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MIT": """The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
}


def test_notices_as_they_stand_wrapped_in_comments_or_on_one_line(spark):
    rows = []
    for name, text in NOTICE_TEXTS.items():
        shapes = [text, " ".join(text.split()), "\n".join(text.split())]
        shapes += ["\n".join(prefix + line for line in text.split("\n")) for prefix in ("# ", "// ", " * ", "-- ", "REM ", "dnl ")]
        rows += [(f"{name} {i}", name, t) for i, t in enumerate(shapes)]
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {rows[r.doc_id][0]: r.license for r in licences.scan_licences(docs).collect()}
    assert got == {key: name for key, name, _ in rows}


def test_shards_get_the_blocks_that_the_tree_gives_them(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "word " * (1 + i % 5)) for i in range(600)], "doc_id long, source string, text string")
    mix = mixing.Mix(mixing.sized_documents(docs), least_shards=100, least_blocks=64)
    assert mix.shards == 100
    draws = [(r.skey, r.block, d.round, d.shard) for r in mix.draws.collect() for d in r.draws]
    assert len(draws) == len({d[:3] for d in draws})
    held = mix.held.groupBy("skey", "rank", "n", "whole").agg(F.count_if("more").alias("more"))
    quotas = {r.skey: (r["rank"], r.n * r.whole + r.more) for r in held.collect()}
    assert Counter(d[0] for d in draws) == {k: q for k, (_, q) in quotas.items()}
    tree = mixing.shard_quotas(held.selectExpr("rank", "n * whole + more as quota"), 100).collect()
    rank = {k: r for k, (r, _) in quotas.items()}
    assert Counter((rank[d[0]], d[3]) for d in draws) == {(r["rank"], r.shard): r.blocks for r in tree if r.blocks}
    sizes = Counter(d[3] for d in draws)
    assert max(sizes.values()) - min(sizes.values()) <= 7


def test_dealing_of_nothing_and_of_texts_without_words(spark):
    docs = empty_docs(spark)
    assert mixing.deal_documents(docs, docs.columns).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string").selectExpr("*", "'a' as source")
    assert mixing.deal_documents(blank, blank.columns).collect() == []


MORE_TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""" + "\n\n" + NOTICE_TEXTS["MIT"] + """ IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
}


def test_more_licences_and_sql_on_all_of_them(spark):
    texts = [(name, t) for group in (NOTICE_TEXTS, MORE_TEXTS) for name, t in group.items()]
    rows = [(i, "\n".join(prefix + line for line in t.split("\n"))) for prefix in ("", "# ", " * ", "-- ") for i, (_, t) in enumerate(texts)]
    rows += [(100, "A sentence before. " + " ".join(t.split()) + " And one after; Released under the MIT License.") for _, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licences.scan_licences(docs)
    assert {(r.doc_id, r.license) for r in got.collect() if r.doc_id < 100} == {(i, name) for i, (name, _) in enumerate(texts)}
    same_as_sql(got, licences.OP5_SQL, documents=docs.toPandas())


def test_many_texts_of_one_identifier_come_near_the_target(spark):
    rows = [(7, f"text {i} " + "word " * (i % 9), "hot") for i in range(3000)] + [(i, "a few words here", "cold") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix_sources(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 0.01 * t + 20 for s, t in target.items())
    got = mixing.mix_sources(docs).withColumn("n_draws", F.size("draws").cast("long"))
    same_as_sql(got.select("doc_id", "size", "source_size", "target", "taken", "n_draws"), mixing.OP7_SQL, documents=docs.toPandas())


AS_WRITTEN = {
    "SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only", "// SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
    "# SPDX-License-Identifier: MIT OR Apache-2.0": "MIT,Apache-2.0", "SPDX-License-Identifier: (MIT OR Apache-2.0)": "MIT,Apache-2.0",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only", "SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1-or-later",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/": "Apache-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007": "GPL-3.0-only",
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0-only",
    "This project is licensed under the MIT License - see the LICENSE.md file for details": "MIT",
    "This project is licensed under the MIT License - see the\n[LICENSE](LICENSE) file for details.": "MIT",
    "Licensed under MIT.": "MIT", "License: MIT": "MIT", "## License\n\nMIT License: see below\nLicense: Apache-2.0": "Apache-2.0",
    "Code is licensed under the Apache License, Version 2.0.": "Apache-2.0", "The code is released under the\nBSD 3-Clause License.": "BSD-3-Clause",
    "dual licensed under the MIT license and the Apache License, Version 2.0.": "Apache-2.0,MIT", "Licensed under GPLv3.": "GPL-3.0-only",
    "It is distributed under MIT or Apache-2.0.": "Apache-2.0,MIT", "this software is licensed under submit": "", "They are licensed under terms we see fit": "",
    "License: ask us": "", "the license is mitigated": "", "we see MIT people": "",
}


def test_licences_as_they_are_written(spark):
    rows = list(enumerate(AS_WRITTEN))
    around = [(100 + i, f"Some words before.\n{t}\nand some after.") for i, t in rows]
    docs = spark.createDataFrame(rows + around, "doc_id long, text string")
    got = licences.scan_licences(docs)
    found = {r.doc_id: set(filter(None, r.all_licenses.split(","))) for r in got.collect()}
    want = {i: set(filter(None, name.split(","))) for i, name in enumerate(AS_WRITTEN.values())}
    assert {i: found[i] for i in want} == want
    same_as_sql(got, licences.OP5_SQL, documents=docs.toPandas())
