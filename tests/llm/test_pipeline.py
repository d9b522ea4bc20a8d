"""The corpus pipeline stage by stage, on odd rows, clashing names and cases planted here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textlens.llm import ngram_join

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, al="abcdefghij"):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(al), rng.integers(2, 6))) for _ in range(n))


ODD = [
    (None, words(1, 30), "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "... 123", "en", "s", 7), (4, words(2, 30), "en", "a", 1), (4, words(2, 30), "en", "a", 1),
    (5, words(2, 30), "en", "b", 1), (6, words(3, 20_000), "en", None, 1), (7, "слово " * 40, "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def clash(df):
    """Columns with the names that operators make for themselves."""
    names = ["lang_pred", "score", "known", "n_lines", "n_removed", "h", "id", "t", "r", "l", "gone", "class_id", "n_links", "item_id", "a.b"]
    return df.select("*", *[F.lit(n).alias(n) for n in names])


def kept(spark, stage, df):
    out = STAGES[stage](spark, df, SF)
    assert out.columns == df.columns or stage == "sentencepiece"
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect())


@pytest.mark.parametrize(
    ("stage", "want"),
    [
        ("language_id", [-1, 4, 4, 5, 6]),  # null, empty, no letter and another script go
        ("line_dedup", [-1, 1, 2, 3, 4, 4, 5, 6, 7]),  # no row goes
        ("near_duplicates", [-1, 1, 2, 3, 4, 4, 6, 7]),  # 5 has the text of 4; repeated keys stay together
        ("decontamination", [-1, 1, 2, 3, 4, 4, 5, 6, 7]),
        ("sentencepiece", [-1, 1, 2, 3, 4, 4, 5, 6, 7]),
    ],
)
def test_odd_rows_and_names(spark, odd, stage, want):
    if stage == "language_id":  # a training text that is not Cyrillic
        odd = odd.withColumn("lang", F.when(~F.col("doc_id").eqNullSafe(F.lit(7)), F.col("lang")))
    assert kept(spark, stage, odd) == want
    assert kept(spark, stage, clash(odd)) == want
    empty = odd.limit(0)
    assert STAGES[stage](spark, empty, SF).count() == 0


def test_other_columns_come_through(spark, odd):
    wide = clash(odd).where("doc_id >= 4 AND doc_id < 7")
    for stage in ("language_id", "line_dedup", "near_duplicates", "decontamination"):
        for r in STAGES[stage](spark, wide, SF).collect():
            assert all(r[n] == n for n in wide.columns[5:])


def test_lines_stage(spark):
    shared = "This very line is everywhere."
    rows = [(i, f"{words(i + 50, 12)}\n{shared}\n{words(i + 90, 5)}", "en", f"s{i % 9}", 0) for i in range(27)]
    out = {r["doc_id"]: r for r in STAGES["line_dedup"](spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    assert shared in out[0]["text"] and not any(shared in out[i]["text"] for i in range(1, 27)) and all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_near_duplicates_stage(spark):
    base = words(7, 200).split()
    near = base[:100] + ["changed"] + base[101:]
    rows = [(0, " ".join(base)), (1, " ".join(near)), (2, words(8, 200)), (3, " ".join(base).upper()), (4, "one two"), (5, "one two three")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert kept(spark, "near_duplicates", frame) == [0, 2, 4, 5]
    assert [r["doc_id"] for r in ngram_join.keep_one(frame, 0.6).orderBy("doc_id").collect()] == [0, 2, 4, 5]


def test_decontamination_stage(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(0, words(1, 40) + " " + item + " " + words(2, 40)), (1, words(3, 80)), (2, item)]
    assert kept(spark, "decontamination", spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)) == [1]


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and 0 < out.count() < docs.count() and out.where("NOT round_trip").count() == 0
    # what each stage keeps is what it may keep: nothing is lost beside its own rejections
    rest = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, rest, SF)
        assert new.columns == docs.columns and new.select("doc_id").exceptAll(rest.select("doc_id")).count() == 0, name
        rest = spark.createDataFrame(new.toPandas(), docs.schema)
    assert rest.count() == out.count()
