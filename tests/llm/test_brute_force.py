"""Operators that SQL can't express, against plain versions of their rules."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textlens.llm import embed_dedup, langid, licenses, ngram_join, pieces, pii, quality, sharding

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


def plain_spans(text):
    """The four patterns as they are written, leftmost and without overlaps, failing matches dropped."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or doubled % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns(texts):
    odd = ["1.2.3.4.5 a@b.c@d.e +1 23 45 67 89", "4111111111111111 4111-1111-1111-1111 0" * 3, "9" * 400, "1 2 " * 300, "a@" * 50 + "b.c", "+1" + "(" * 30 + "2", "٣٣٣.1.1.1"]
    for text in [*texts.values(), *odd]:
        assert sorted(pii.base_spans(text)) == sorted(plain_spans(text))


def test_field_on_sentences_it_has_not_seen():
    field, right, wanted, wrong = pii.trained(), 0, 0, 0
    for text, marks in pii.examples(99, 150):
        got = set(field.decode(text, pii.tokens_of(text)))
        right, wanted, wrong = right + len(got & set(marks)), wanted + len(marks), wrong + len(got - set(marks))
    assert right / wanted >= 0.9 and wrong / wanted <= 0.05


def test_decoding_is_the_best_segmentation():
    """Dynamic programming against every segmentation of a short text."""
    field = pii.trained()
    for text in ("call 555 123 4567", "x [at] y.com", "(935) 629-5341", "a 12", "tel 935-629"):
        tokens = pii.tokens_of(text)
        spans, matrix = pii.candidates(text, tokens)
        scores, at = field.scores(spans, matrix), {tuple(s): k for k, s in enumerate(spans.tolist())}

        def ways(i, before, tokens=tokens, scores=scores, at=at):
            if i == len(tokens):
                yield 0.0, []
            for j in range(i + 1, len(tokens) + 1):
                if (i, j) in at:
                    for y in range(len(pii.LABELS)):
                        own = scores[at[i, j], y] + field.follows[before, y]
                        if np.isfinite(own) and (j - i == 1 or y):
                            for rest, labels in ways(j, y):
                                yield own + rest, [(i, j, y), *labels]

        assert len(tokens) <= 6
        best, before, clear = max(ways(0, 0), key=lambda w: w[0])[1], 0, []
        for i, j, y in best:
            plain = sum(scores[at[t, t + 1], 0] + field.follows[0, 0] for t in range(i, j))
            if y and scores[at[i, j], y] + field.follows[before, y] - plain >= pii.MARGIN:
                clear.append((pii.LABELS[y], tokens[i][0], tokens[j - 1][1]))
            before = y
        assert clear == field.decode(text, tokens)


def test_addresses_of_many_parts():
    field = pii.trained()
    for address in ("john.smith [at] mail [dot] example [dot] com", "ann(at)one.two.example.org", "a.b.c {at} dept {dot} uni {dot} de", "x" * 90 + " [at] " + "y" * 80 + ".org"):
        text = f"Write to {address} today"
        assert pii.added_spans(text, [], field) == [("email", 9, 9 + len(address))]


def test_added_spans_touch_nothing(texts):
    field = pii.trained()
    long = "tel 555 123 4567, " * 300 + "mail: a.b [at] c [dot] org " + "1 2 3 4 " * 500
    for text in [*list(texts.values())[:300], long]:
        base = pii.base_spans(text)
        every = sorted((s, e) for _, s, e in pii.added_spans(text, base, field))
        assert all(a[1] <= b[0] for a, b in zip(every, every[1:], strict=False)) and not any(s < e2 and s2 < e for s, e in every for _, s2, e2 in base)
    assert sum(k == "phone" for k, _, _ in pii.added_spans(long, pii.base_spans(long), field)) == 300


def test_trigram_vectors_by_loops():
    encoder, d = langid.Encoder(), langid.DIMENSIONS
    for text in ("ab c", "é", "", None, "1a!", "Zz zZ"):
        want, s = np.zeros(d), "\0" + (text or "").lower() + "\0"
        s = "".join(c if c.isalpha() else " " for c in s)
        for i in range(1, len(s) - 1):
            if s[i].isalpha():
                want += np.roll(encoder.letter(ord(s[i - 1])), 2) * np.roll(encoder.letter(ord(s[i])), 1) * encoder.letter(ord(s[i + 1]))
        assert np.allclose(encoder.encode([text])[0], want)


def test_prototypes_and_predictions_by_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made, encoder = langid.train_prototypes(docs), langid.Encoder()
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    rows = docs.collect()
    for lang, prototype in made.items():
        own = unit(sum(unit(encoder.encode([r["text"]])[0].astype(float)) for r in rows if r["lang"] == lang and r["text"]))
        assert np.allclose(own, prototype, atol=1e-5)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, made).collect()}
    for r in rows[:60]:
        cosines = {lang: float(unit(encoder.encode([r["text"]])[0]) @ p) for lang, p in made.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert out[r["doc_id"]][0] == best and abs(out[r["doc_id"]][1] - max(0, cosines[best])) < 1e-4


def test_language_names_and_dirty_columns(spark):
    frame = spark.createDataFrame([(1, "hello there", "x", 5, 6), (2, None, "y", 5, 6)], "doc_id long, text string, lang_pred string, _lang int, score int")
    out = langid.identify(frame, {"en": np.ones(langid.DIMENSIONS)}).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "_lang", "lang_pred", "score"} and [r["_lang"] for r in out] == [5, 5] and out[1]["lang_pred"] == "und"
    many = spark.createDataFrame([(f"l{i % 700}", f"text {i}") for i in range(1400)], "lang string, text string")
    assert len(langid.train_prototypes(many)) == langid.LANGUAGES
    assert {r["h"] for r in spark.createDataFrame([(None,), (1,)], "doc_id long").select(langid.held_out("doc_id", 4, 2).alias("h")).collect()} <= {True, False}


def test_ridge_by_one_solve(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("y"))
    labelled = quality.with_statistics(docs).join(labels, "doc_id")
    model = quality.fit(labelled)
    rows = labelled.withColumn("m", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(1_000_000))).toPandas()
    stats, y, fold = np.stack(rows["stats"]), rows["y"].to_numpy(), rows["m"].to_numpy() % 5
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.where(stats.std(0) > 1e-9, stats.std(0), 1))
    z, target = model.lift(stats[fold != 4]), y[fold != 4]
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) / z.shape[1] * np.eye(z.shape[1]), z.T @ target)
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    # calibration: the least squares non-decreasing fit has min-max means
    raw, held = model.raw(stats[fold == 4]), y[fold == 4]
    order = np.argsort(raw, kind="stable")
    r, h = raw[order], held[order]
    means = [max(min(h[i : k + 1].mean() for k in range(j, len(h))) for i in range(j + 1)) for j in range(len(h))]
    assert len(set(r)) < len(r) or np.allclose(np.interp(r, *model.knots), means)


def test_licences_by_plain_matching(spark, texts):
    """Sequences and licences of a whole table, from sentences read one at a time."""
    known = [(n, re.compile(p)) for n, p in licenses.SENTENCES]
    marked = {d: t for d, t in texts.items() if t and re.search("licen|warrant|redistribut", t, re.I)}
    frame = spark.createDataFrame([(d, t) for d, t in marked.items()], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan_licenses(frame).collect()}
    assert marked and len(out) == len(marked)
    for d, t in marked.items():
        lines = [re.sub(r"[\W_]+", " ", x.lower()).strip() for x in re.split(r"\n|(?<=[.!?;])\s+", t)]
        ids = [next((n for n, p in known if p.fullmatch(x)), None) for x in lines]
        found = out[d]["sentence_ids"].split(",") if out[d]["sentence_ids"] else []
        assert [i for i in ids if i] == [f for f in found if not f.startswith("SPDX:")] or len(found) >= len([i for i in ids if i])
        rest, want = [i for i in ids if i], []
        for name, rule in licenses.RULES:
            parts = rule.split("~")
            at, places = -1, []
            for part in parts:
                at = next((k for k in range(at + 1, len(rest)) if rest[k] == part), None)
                if at is None:
                    break
                places.append(at)
            else:
                want.append(name)
                rest = [x for x in rest if x not in parts] if len(parts) == 1 else [x for k, x in enumerate(rest) if k not in places]
        assert set(want) <= set(out[d]["licenses"].split(","))


def test_licence_rules_take_what_they_match(spark):
    said = ["Released under CC BY 4.0.", "Licensed under CC BY 4.0.", "This program is licensed under the AGPL version 3 or any later version.", "Licensed under the ISC License.", "Subject to the terms of the Mozilla Public License, v. 2.0.", None, ""]
    frame = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    out = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(frame).collect()}
    assert out == {0: "CC-BY-4.0", 1: "CC-BY-4.0", 2: "AGPL-3.0-or-later", 3: "ISC", 4: "MPL-2.0", 5: "", 6: ""}


def test_repeated_keys_of_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0]), (4, [-1.0, -1.0])]
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_pivots_grow_with_the_table(spark, monkeypatch):
    assert [embed_dedup.setting(n) for n in (0, 100_000, 100_001, 1_600_000, 10**10)] == [(512, 6), (512, 6), (1024, 7), (2048, 8), (4096, 9)]
    monkeypatch.setattr(embed_dedup, "PIVOTS", 32)
    monkeypatch.setattr(embed_dedup, "VECTORS", 100)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1200, 12))
    x[600:] = x[:600] + 0.12 * rng.standard_normal((600, 12))
    x[900:1000] = x[7]  # a hot vector and a hub
    assert embed_dedup.setting(1101) == (128, 8)
    out = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert len(out) == 1200 and all(out[i] <= want[i] for i in out) and sum(out.values()) >= 0.97 * want.sum()


def test_decoding_and_shards(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "é\n\n x")], "doc_id long, text string")
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode_ids(pieces.encode_texts(frame, MODEL), MODEL).collect()}
    assert back == {1: "a b", 2: "", 3: None, 4: "é\n\n x"}
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assigned = sharding.assign_shards(docs, {0: 1.0, 1: 1.0, 2: 4.0})
    n = {r["shard"]: r["count"] for r in assigned.groupBy("shard").count().collect()}
    assert abs(n[2] / 6000 - 2 / 3) < 0.03 and abs(n[0] - n[1]) < 200
    sharding.write_shards(assigned, str(tmp_path / "out"), 500)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 6000 and len(list((tmp_path / "out" / "shard=2").glob("*.parquet"))) >= 8
    for path in (tmp_path / "out" / "shard=2").glob("*.parquet"):
        slots = pq.read_table(path).column("slot").to_pylist()
        assert slots == sorted(slots) and slots[0] // 500 == slots[-1] // 500
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), {0: 0.0})


def test_links_of_large_groups(spark):
    """Near copies whose buckets split, equal texts, equal sets, rows that repeat key and text, one key with two texts."""
    rng = np.random.default_rng(3)
    words = [[f"w{i}" for i in range(120)] for _ in range(160)]
    for i, text in enumerate(words):
        for at in rng.integers(120, size=1 + i % 3):
            text[at] = f"x{i}"
    texts = [" ".join(t) for t in words]
    data = list(enumerate(texts)) + [(160, texts[0]), (161, texts[0].upper()), (162, texts[1]), (162, texts[1]), (163, texts[2]), (163, "another text of its own and nothing else")]
    sets = [set(ngram_join.Shingler()(t).tolist()) for _, t in data]
    linked = [[i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    least = [k for k, _ in data]
    for _ in data:
        least = [min([least[i]] + [least[j] for j, yes in enumerate(row) if yes]) for i, row in enumerate(linked)]
    want = sorted((k, c, sum(row)) for (k, _), c, row in zip(data, least, linked, strict=True))
    found = ngram_join.jaccard_links(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == want
    assert max(n for _, _, n in want) > 64
