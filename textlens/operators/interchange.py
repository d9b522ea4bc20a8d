"""The interchange document of a text: one struct a document, and its canonical JSON.

Field names are in alphabetical order at every level, so that ``to_json`` is canonical.
A document's tokens end in one row, since that row is the result; nothing else of a
document is collected, and texts are not part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annotate, render, validate
from .contract import Contract

RANGE = "struct<endUtf8:int,startUtf8:int>"
TOKEN = annotate.AXES
NODE = f"struct<byteRange:{RANGE},childNodeIds:array<int>,depth:int,kind:string,nodeId:int>"
DIAGNOSTIC = f"struct<byteRange:{RANGE},code:string,message:string,severity:string>"
STEP = f"struct<compilerBuildHash:string,passId:string,ruleId:string,sourceRanges:array<{RANGE}>>"
SOURCE = "struct<contentHash:string,unitId:string,utf8ByteLength:int>"
ANALYSIS = f"struct<contractVersion:string,derivation:array<{STEP}>,diagnostics:array<{DIAGNOSTIC}>,schemaHash:string,source:{SOURCE},structure:array<{NODE}>,tokens:array<{TOKEN}>,vocabularyHash:string>"


def analyses(docs: DataFrame, contract: Contract = Contract(), keep: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """doc_id, ``keep``, bytes, analysis: every document of docs(doc_id, name, text), in one pass without an exchange.

    A null text counts as empty; ``once`` is of ``annotate.whole``. Documents whose length passes 32 bits can't be held
    by the format; analysis is null for them.
    """
    fault = contract.fault()
    if fault:
        raise ValueError(": ".join(fault))

    rows = render.with_outline(docs, ["doc_id", "name", "text", *keep], contract.contextual, once)
    rows = rows.withColumn("bytes", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).withColumn("n", F.octet_length("bytes"))
    whole = F.array(F.struct(F.col("n").alias("endUtf8"), F.lit(0).alias("startUtf8")))
    steps = [F.struct(F.lit(contract.build).alias("compilerBuildHash"), F.lit(p).alias("passId"), F.lit(r).alias("ruleId"), whole.alias("sourceRanges")) for p, r in contract.passes]
    analysis = F.struct(
        F.lit(contract.version).alias("contractVersion"), F.array(*steps).alias("derivation"), F.array().cast(f"array<{DIAGNOSTIC}>").alias("diagnostics"),
        F.lit(contract.schema_hash).alias("schemaHash"), F.struct(F.concat(F.lit("sha256:"), F.sha2("bytes", 256)).alias("contentHash"), F.col("name").alias("unitId"), F.col("n").alias("utf8ByteLength")).alias("source"),
        F.col("outline").alias("structure"), "tokens", F.lit(contract.vocabulary_hash).alias("vocabularyHash"),
    )
    return rows.select("doc_id", *keep, "bytes", F.when(F.col("n") <= 2147483647, analysis).alias("analysis"))


def projected(docs: DataFrame, contract: Contract = Contract(), classified: DataFrame | None = None) -> DataFrame:
    """doc_id, bytes, analysis, error, message of every document, accepted (error null) or refused, in one plan.

    error is MissingPassIdentity or DuplicatePassId (of the contract, for every
    document), Overflow, InvalidClassification (where ``classified``, the parts that
    ``validate.classification_errors`` checks, is given and fails) or
    InvalidProjectedDocument.
    """
    fault = contract.fault()
    if fault:
        none = [F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast(ANALYSIS).alias("analysis")]
        return docs.select("doc_id", *none, F.lit(fault[0]).alias("error"), F.lit(fault[1]).alias("message"))
    if classified is not None:
        # what is wrong with its parts meets a document as a text: analysed, it is some twenty times as large
        bad = validate.classification_errors(classified).select("doc_id", F.concat(F.lit("invalid parser/annotator classification: "), "message").alias("_wrong"))
        docs = docs.join(bad, "doc_id", "left")
    found = validate.with_errors(analyses(docs, contract) if classified is None else analyses(docs, contract, ("_wrong",), once=True), contract)
    broken = validate.report(F.col("errors"))
    kind = F.when(F.col("analysis").isNull(), "Overflow").when(F.size("errors") > 0, "InvalidProjectedDocument")
    text = F.when(F.col("analysis").isNull(), F.concat(F.lit("source length ("), F.octet_length("bytes").cast("string"), F.lit(") exceeds the 32-bit range; the document is too large to project")))
    text = text.when(F.size("errors") > 0, F.concat(F.lit("projected document violated its contract: "), broken))
    found = found.withColumn("error", kind).withColumn("message", text)
    if classified is not None:
        found = found.withColumn("error", F.when(F.col("_wrong").isNotNull(), "InvalidClassification").otherwise(F.col("error"))).withColumn("message", F.coalesce("_wrong", "message"))
    return found.select("doc_id", "bytes", "analysis", "error", "message")


def project(docs: DataFrame, contract: Contract = Contract(), classified: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, refused): the two sides of ``projected``, each a plan of its own; whoever wants both reads that."""
    found = projected(docs, contract, classified)
    return found.where("error IS NULL").select("doc_id", "bytes", "analysis"), found.where("error IS NOT NULL").select("doc_id", "error", "message")


def canonical_json(found: DataFrame) -> DataFrame:
    """doc_id, json: keys sorted, no blanks, nulls kept."""
    return found.select("doc_id", F.to_json("analysis", {"ignoreNullFields": "false"}).alias("json"))


def write(found: DataFrame, path: str) -> None:
    """Canonical JSON texts, a line each, in files that Spark commits as a whole; an existing path is refused.

    Null analyses (documents that the format can't hold) are left out.
    """
    canonical_json(found).where("json IS NOT NULL").select("json").write.text(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of what ``write`` wrote: unit (its unitId) and analysis, and the error of each line that is none."""
    lines = spark.read.text(path).select(F.lit(0).alias("doc_id"), F.col("value").alias("json"))
    good, bad = read_json(lines)
    return good.select(F.col("analysis.source.unitId").alias("unit"), "analysis"), bad.select("error")


def read_json(lines: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): doc_id and analysis of each JSON text; malformed ones are refused."""
    schema = ANALYSIS[:-1] + ",_bad:string>"
    parsed = lines.select("doc_id", F.col(json).alias("json"), F.from_json(json, schema, {"columnNameOfCorruptRecord": "_bad"}).alias("a"))
    bad = F.col("a").isNull() | F.col("a._bad").isNotNull()
    return parsed.where(~bad).select("doc_id", F.col("a").dropFields("_bad").alias("analysis")), parsed.where(bad).select("doc_id", F.lit("malformed").alias("error"))
