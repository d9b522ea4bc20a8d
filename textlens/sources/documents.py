"""Text sources, the UTF-8 gate and format selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Own texts for rules that the corpus tables never trigger; negative ids.
FIXTURES = [
    (-1, "weak", "It was very late. The cat Really just left. He said \"basically\" nothing."),
    (-2, "run_on", " ".join(["word"] * 41) + ". " + " ".join(["word"] * 40) + "."),
    (-3, "outlier", "Short one. Short two. Short three. " + " ".join(["word"] * 30) + "."),
    (-4, "passive", "The file was written. It was carefully reviewed by Anna. The door is closed. The door is closed by the guard. It was known by now. It is, written."),
    (-5, "senses", "I will book a room. The book is old. They lead. The lead pipe fell. Take the lead. She writes fast. A fast car. A book record lead fast dog. We book record lead fast book record lead fast dogs."),
    (-6, "proper", "Paris is big. We saw Paris.\nRome fell. 5 Apples grew.\nThe Working Agreement for Agents\n# Title Here\n\"Quoted Start of Line"),
    (-7, "segments", "\"Hi.\" Go. Hi. \"Go.\" a.b e.g. x ?!?! (Yes.) No"),
    (-8, "numbers", "1,234.5 and 3.14 and 2. then 1,,2 or 7.x"),
    (-9, "lines", "One.\n\nTwo.\nThree.\n\n\nFour. Five."),
    (-11, "agents", "It was quickly written. The lake was known by a cat. It is lost by now. The map was broken by Paris. She is being reviewed. They were closed by fast cars. It was closed by\u2028the wind. He was 5 written."),
    (-12, "thing", "A good thing came. It was unquestionably Good. One Two three."),
    (-10, "open", "The quick dog quickly connects the silent river. A mountain glows slowly."),
]


#: Inputs up to so many bytes a core are dealt out anew; larger ones have splits enough.
SMALL = 16 * 1024 * 1024


def spread(docs: DataFrame) -> DataFrame:
    """A small input over all cores, whatever its files and row groups; a large one as it is.

    A file with one row group is one task however many cores there are. Dealing out a few
    MB costs nothing; a corpus is never shuffled for it. Results don't depend on this.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(cores) if size <= cores * SMALL else docs


def corpus(spark: SparkSession, sf_dir: str, fixtures: bool = False) -> DataFrame:
    """doc_id, name, text of ``documents``, with the fixtures where asked; rows are numbered where they are read, fixtures by their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "text")
    docs = spread(docs.withColumn("_row", F.monotonically_increasing_id()))
    own = spark.createDataFrame(FIXTURES, "doc_id long, name string, text string").withColumn("_row", F.col("doc_id"))
    return docs.unionByName(own) if fixtures else docs


#: Own Markdown texts and what is prose in them.
MARKDOWN = [
    (-101, "fence", "markdown", "It is very good.\n\n```text\nIt is very bad.\n```\n\nThe end is really near.\n", "It is very good.\n\n.      \n               \n   \n\nThe end is really near.\n"),
    (-102, "span", "markdown", "Say `very much` and é `漢😀` twice, really.", "Say             and é  \u3000\u00a0\u00a0  twice, really."),
    (-103, "links", "markdown", "A [very long](http://x.y/very \"really\") link, [named][very] and <http://very.x>.\n\n[very]: http://very.y 'very'\n", "A [very long]" + " " * 26 + " link, [named]       and" + " " * 16 + ".\n\n." + " " * 27 + "\n"),
    (-104, "meta", "markdown", "---\ntitle: very\n---\n<div>\nvery\n</div>\n\nJust text.", ".  \n           \n   \n     \n    \n      \n\nJust text."),
    (-105, "plain", "plain", "It is `very` plain.", "It is `very` plain."),
    (-106, "quote", "markdown", "> It was very `really` late.\n>\n>     very\n\n- just\n\n  ~~~\n  very\n  ~~~\n", "> It was very          late.\n>\n>     .   \n\n- just\n\n  .  \n      \n     \n"),
    (-107, "none", "markdown", None, None),
]


def markdown_fixtures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([m[:2] + (m[3], m[2]) for m in MARKDOWN], "doc_id long, name string, text string, format string")


def gate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of name, bytes: strict UTF-8, never replaced."""
    valid = F.coalesce(F.is_valid_utf8(F.col("bytes").cast("string")), F.lit(False))
    good = raw.where(valid).select("name", format_of_path(F.col("name")).alias("format"), F.decode("bytes", "UTF-8").alias("text"))
    return good, raw.where(~valid).select("name", F.lit("invalid-utf8").alias("error"))


def read_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): whole files as (name, format, text); invalid UTF-8 is refused, never replaced."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.col("content").alias("bytes"))
    return gate(raw)


def in_markdown(docs: DataFrame) -> DataFrame:
    """``docs`` in Markdown, each text in a fence between two lines of prose; backticks in it become apostrophes."""
    inner = F.translate(F.coalesce("text", F.lit("")), "`", "'")
    return docs.withColumns({"text": F.concat(F.lit("Intro.\n\n```text\n"), inner, F.lit("\n```\n\nEnd.")), "format": F.lit("markdown")})


def in_linked_markdown(docs: DataFrame) -> DataFrame:
    """``docs`` in Markdown, each text in a fence behind two definitions; a line before them has a link and a code span of its name."""
    inner = F.translate(F.coalesce("text", F.lit("")), "`", "'")
    head = F.concat(F.lit("See ["), "name", F.lit("][x] and `"), "name", F.lit("`.\n\n[x]: /u\n\n[y]: /v\n\n"))
    return docs.withColumns({"text": F.concat(head, F.lit("```text\n"), inner, F.lit("\n```\n\nEnd.")), "format": F.lit("markdown")})


def in_files(docs: DataFrame) -> DataFrame:
    """name, bytes: ``docs`` as files; every third one by its id begins with a byte that is no UTF-8."""
    name = F.concat("name", F.when(F.pmod("doc_id", F.lit(2)) == 0, ".md").otherwise(".txt"))
    raw = F.encode("text", "UTF-8")
    return docs.select(name.alias("name"), F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw).alias("bytes"))


def from_text(spark: SparkSession, text: str, name: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(0, name, text)], "doc_id long, name string, text string")


def format_of_path(path: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("md", "markdown"), "markdown").otherwise("plain")


def format_of_language(language: Column) -> Column:
    return F.when(F.lower(language) == "markdown", "markdown").otherwise("plain")
