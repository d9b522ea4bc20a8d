"""The library's functions in SQL: a lateral table function and a column function.

    register(spark)
    spark.sql("SELECT d.doc_id, t.* FROM documents d, LATERAL tokenize_prose(d.text) t")
    spark.sql("SELECT d.doc_id, t.* FROM documents d, LATERAL inline(prose_tokens(d.text)) t")
    spark.sql("SELECT mask_markdown(text) FROM documents")

``tokenize_prose`` hands every token over as a Python row and is for few texts;
``prose_tokens`` is the same for whole tables, arrays all the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .functions import lexer
from .operators.annotate import SIZE, slices
from .operators.prose import mask_markdown

TOKEN = "pos int, lexeme string, kind string, start int, `end` int"


class TokenizeProse:
    """The tokens of one text, a row each; none for null. Memory is bounded by the text."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is None:
            return
        t = lexer.Texts(pa.array([text], pa.string()))
        yield from zip(t.pos.tolist(), t.lexemes().to_pylist(), t.kinds().to_pylist(), t.start.tolist(), t.end.tolist(), strict=True)


_TYPES = {"pos": IntegerType(), "lexeme": StringType(), "kind": StringType(), "start": IntegerType(), "end": IntegerType()}


@F.arrow_udf(ArrayType(StructType([StructField(name, kind) for name, kind in _TYPES.items()])))
def prose_tokens(texts: pa.Array) -> pa.Array:
    """The tokens of each text as a list, empty for null; cut into tokens slice by slice."""
    found = []
    for lo, hi in slices(texts, SIZE):
        t = lexer.Texts(texts.slice(lo, hi - lo))
        columns = [t.pos, t.lexemes(), t.kinds(), t.start, t.end]
        rows = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [*_TYPES])
        found.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(t.doc, np.arange(hi - lo + 1)).astype(np.int32)), rows))
    return pa.concat_arrays(found)


def register(spark: SparkSession) -> None:
    """Makes ``tokenize_prose``, ``prose_tokens`` and ``mask_markdown`` known to the session."""
    spark.udtf.register("tokenize_prose", F.udtf(TokenizeProse, returnType=TOKEN))
    spark.udf.register("prose_tokens", prose_tokens)
    spark.udf.register("mask_markdown", mask_markdown)
