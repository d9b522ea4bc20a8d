"""Each operator on odd rows, and against brute force."""

import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from textlens.llm import decontaminate, embed_dedup, langid, licenses, line_dedup, ngram_join, pieces, pii, quality, sharding
from textlens.llm.queries import OP5_SQL

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int"
ODD = [(None, "a b c d e f", "en", "s", 1, 1), (1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, "x " * 30_000, "en", "s", 1, 1), (4, "one two", "en", "s", 1, 1), (4, "one two", "en", "s", 1, 1), (5, "... !!", "fr", "t", 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def every(spark, frame):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, "short")], "item_id long, text string")
    return {
        "lines": line_dedup.dedup_lines(frame, 1), "items": decontaminate.contained_items(frame, items), "shards": sharding.assign_shards(frame, 3),
        "licences": licenses.scan_licenses(frame), "links": ngram_join.jaccard_links(frame), "pieces": pieces.encode_texts(frame, MODEL),
        "language": langid.identify(frame, langid.train_prototypes(frame)), "pii": pii.find_personal_data(frame),
        "quality": quality.score(quality.with_statistics(frame), quality.fit(quality.with_statistics(frame).withColumn("y", F.lit(1.0)))),
    }


def test_odd_rows(spark, odd):
    counts = {k: df.count() for k, df in every(spark, odd).items()}
    assert counts == dict.fromkeys(counts, len(ODD)) | {"items": 0}


def test_empty_tables(spark, odd):
    assert {df.count() for df in every(spark, odd.limit(0)).values()} == {0}


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16))
    x[200:280] = x[:80] + 0.1 * rng.standard_normal((80, 16))
    x[280:] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, []), (302, [0.0] * 16), (303, [math.nan] * 16), (304, [None] + [1.0] * 15), (305, [1.0, 2.0]), (None, x[0].tolist())]
    out = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert len(out) == len(data) and sum(out[i]["n_links"] for i in range(300)) >= 0.99 * want.sum()
    assert all(out[i]["n_links"] <= want[i] for i in range(300)) and all(out[i]["n_links"] == 0 for i in range(300, 306))
    assert out[299]["component_id"] == 0 and out[0]["kept"] and not out[None]["kept"]


def test_lines(spark):
    data = [(i, f"own {i}\n shared line \n\nend", "en", f"s{i % 4}", 1, 1) for i in range(12)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(data, SCHEMA), 4).collect()}
    assert out[0] == "own 0\n shared line \n\nend" and out[5] == "own 5\n"


def test_containment(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    import re

    sh = lambda t: {" ".join(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 4)}
    texts, tests = [(r[0], sh(r[1])) for r in docs.select("doc_id", "text").collect()], [(r[0], sh(r[1])) for r in items.select("item_id", "text").collect()]
    want = {(d, i) for d, s in texts for i, t in tests if t and len(s & t) >= 0.8 * len(t) - 1e-9}
    assert want and {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items, broadcast_rows=1).collect()} == want


def test_links(docs):
    shingler = ngram_join.Shingler()
    sets = {r[0]: set(shingler(r[1]).tolist()) for r in docs.select("doc_id", "text").collect()}
    ids = list(sets)
    want = dict.fromkeys(ids, 0)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if shared and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                want[a] += 1
                want[b] += 1
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_links(docs).collect()} == want


def test_shards(docs):
    rows = sharding.assign_shards(docs, 16).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def best(key, n):
        word = lambda s: xxhash.xxh64_intdigest(int(s).to_bytes(4, "little"), xxhash.xxh64_intdigest(str(key).encode(), 42))
        return max(range(n), key=lambda s: (-1 / math.log(((word(s) >> 11) + 0.5) / 2**53), -s))

    assert all((r["shard"], r["grown_shard"]) == (best(r["doc_id"], 16), best(r["doc_id"], 17)) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 16) and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_language_held_out(docs):
    test = langid.held_out("doc_id", 4, 2)
    out = langid.identify(docs.where(test), langid.train_prototypes(docs.where(~test))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95 and all(0 <= r["score"] <= 1 for r in out)


def test_quality_held_out(spark):
    stats = quality.with_statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labelled = stats.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").withColumn("y", F.col("quality").cast("double"))
    test = langid.held_out("doc_id", 5, 0)
    out = quality.score(labelled.where(test), quality.fit(labelled.where(~test))).collect()
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in out]) > 0.95


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(np.interp([1, 2, 3, 4], x, y)) >= 0).all() and np.interp(2.5, x, y) == 0.5


def test_base_patterns():
    text = "a@b.co, 1.2.3.4 300.1.1.1, 4111 1111 1111 1111, +1 (555) 123-4567"
    assert [s[0] for s in pii.base_spans(text)] == ["email", "ip", "card", "phone"]
    assert pii.base_spans("@x.y, a@b 9 ") == [] and pii.joined([]) == ""
    field = pii.trained()
    found = pii.added_spans("please call phone (935) 629-5341 today", [], field)
    assert found == [("phone", 18, 32)] and pii.added_spans("on 2024-05-06 and 12 of 30", [], field) == []


def test_pieces_match_the_library(docs):
    import sentencepiece

    texts = [r[0] for r in docs.select("text").collect()] + ["", " ", "  a   b\n\n c ", " " * 45 + "x", "日本 🎉 é\t\0", "x" * 300, "▁a"]
    codec = pieces.Codec(pieces.read_model(MODEL))
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts)
    got = codec.encode(texts)
    assert [list(x) for x in got] == want
    assert [codec.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_licences():
    import re

    known = {n: re.compile(f"^({p})$") for n, p in licenses.SENTENCES}
    assert known["ApacheRef"].match("licensed under the apache license version 2 0") and known["CCBYNC4"].match("licensed under cc by nc 4 0")
    assert re.search(licenses.rule_regex("MITGrant~MITNotice~AsIsMIT"), ",MITGrant,Other,MITNotice,AsIsMIT,") and not re.search(licenses.rule_regex("A~B"), ",B,A,")


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of fitness."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer.
"""
BSD3 = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from it.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""


def licences_found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan_licenses(frame).collect()}
    return [out[i]["licenses"] for i in range(len(texts))], [out[i]["sentence_ids"] for i in range(len(texts))]


def test_wrapped_licences(spark):
    marked = [m + f"\n{m}".join(MIT.split("\n")) for m in (" * ", "# ", "// ", "dnl ", "REM ", "\t-- ")]
    later = "Foo\nlicensed under the GNU General Public License version 3\nor any later version\nbar"
    single = "no full stop here\nLicensed under the MIT License\nLicensed under the Apache License, Version 2.0\nmore"
    texts = [MIT, GPL, BSD, BSD + BSD3, APACHE, *marked, MIT.replace("\n", "\r\n"), MIT.replace("\n", "\r"), later, single, "a\n" * 50_000 + GPL, "software\n" + "*\n" * 50_000 + "x"]
    found, ids = licences_found(spark, texts)
    assert found[:5] == ["MIT", "GPL", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0"] and ids[1] == "GPLFree,GPLNoWarranty"
    assert ids[4] == "ApacheRef,ApacheNoUse,ApacheCopy,AsIsBasis"
    assert found[5:13] == ["MIT"] * 8
    assert found[13:] == ["GPL-3.0-or-later", "Apache-2.0,MIT", "GPL", ""] and ids[14] == "MITRef,ApacheRef"


def test_licence_references(spark):
    tags = ["MIT", "apache-2.0", "GPL-3.0-only", "GPL-2.0+", "ISC", "(MIT OR Apache-2.0)", "GPL-2.0 WITH Classpath-exception-2.0 */", "BSD-2-Clause OR BSD-3-Clause", "NOASSERTION"]
    want = ["MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0-or-later", "ISC", "MIT,Apache-2.0", "GPL-2.0", "BSD-2-Clause,BSD-3-Clause", "unknown"]
    assert licences_found(spark, [f"/* SPDX-License-Identifier: {x}\nint a" for x in tags])[0] == want
    said = ["This project is licensed under the MIT License - see the LICENSE file for details.", "Licensed under the Apache License 2.1", "Licensed under GPL v2 or, at your option, any later version - see COPYING",
            "licensed under the MIT License\nlicensed under the Apache License 2.0 - see LICENSE\n", "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Zlib\n" + MIT]
    found, ids = licences_found(spark, said)
    assert found == ["MIT", "", "GPL-2.0-or-later", "Apache-2.0,MIT", "MIT,Zlib"] and ids[4].startswith("SPDX:MIT,SPDX:Zlib,MITGrant")


def test_short_items(spark):
    texts = ["one", "a one b", "Two, words here", "words two", "x one two three y", "p q r s", "p q r", "a p q r s t", "one two three four five six", "", None]
    items = {1: "one", 2: "two words", 3: "one two three", 4: "p q r s", 5: "one two three four five", 6: "...", 7: None}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontaminate.contained_items(frame, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    want = {(0, 1), (1, 1), (4, 1), (8, 1), (2, 2), (4, 3), (8, 3), (5, 4), (7, 4), (8, 5)}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": range(len(texts)), "text": texts}))
    con.register("benchmark", pa.table({"item_id": list(items), "text": list(items.values())}))
    assert sorted(con.execute(OP5_SQL).fetchall()) == sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"], r["containment"]) for r in out)
    assert {(r["doc_id"], r["item_id"]) for r in out} == want and len(out) == len(want) and all(r["containment"] == 1 for r in out)
