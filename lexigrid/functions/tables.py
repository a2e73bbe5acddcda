"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexigrid.operators.spans import chunk_spans


class TextChunks:
    """text_chunks(text, most): (chunk, start, end, piece) of a text, or of each row of TABLE(..).

    ``most`` is a constant of 1 or more, 1000 if it is left out. A null or empty text has no chunks. Of a table the
    columns ``text`` and ``doc_id`` are read, and doc_id goes along; PARTITION BY keeps the rows of a key together.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if most is not None and (not most.isConstantExpression or not isinstance(most.value, int) or most.value < 1):
            raise ValueError("most must be a constant whole number of 1 or more")
        fields = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("chunk", "start", "end")], T.StructField("piece", T.StringType())])
        if text.isTable:
            names = {f.name: f for f in text.dataType.fields}
            if not {"doc_id", "text"} <= set(names):
                raise ValueError("the table must have doc_id and text")
            fields = T.StructType([names["doc_id"], *fields.fields])
        elif not isinstance(text.dataType, T.StringType | T.NullType):
            raise ValueError("text must be a string or a table")
        return AnalyzeResult(schema=fields)

    def eval(self, text, most: int = 1000) -> Iterator[tuple]:
        of_table = isinstance(text, T.Row)
        value, lead = (text["text"], (text["doc_id"],)) if of_table else (text, ())
        for k, (a, z) in enumerate(chunk_spans(value or "", most)):
            yield *lead, k, a, z, value[a:z]


def register(spark: SparkSession) -> None:
    """Makes text_chunks known to the session's SQL."""
    spark.udtf.register("text_chunks", F.udtf(TextChunks))
