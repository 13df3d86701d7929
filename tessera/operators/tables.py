"""Tables as text: a group's rows as one ``@tab`` block, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import values
from ..functions.canon import loose_text, table_text
from ..plans.schema import Schema
from ..values import DEFAULT, Options


def tab_aggregate(df: DataFrame, keys: list[str], cols: list[str], order: list[str], options: Options = DEFAULT, name: str = "tab") -> DataFrame:
    """The rows of each group as one text: a table from ``options.min_rows`` rows on, a list below.

    A group's text is one string in one row, so this is for groups of bounded size; write a whole table with the table sink.
    """
    e = T.StructType([df.schema[c] for c in cols])
    row = F.struct(*(F.col(c) for c in cols))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), row.alias("r")))), lambda x: x["r"])
    g = df.groupBy(*keys).agg(rows.alias("_rows"))
    return g.select(*keys, loose_text(F.col("_rows"), T.ArrayType(e), options).alias(name))


def table_header(text: Column) -> dict[str, Column]:
    """Numbers of rows and columns that a table's header gives, and its columns, without reading the rows."""
    head = F.substring_index(text, "\n", 1)
    num = lambda k: F.regexp_extract(head, rf"\s{k}=(\d+)", 1).cast("int")
    return {"rows": F.when(head.contains(" rows="), num("rows")), "cols": F.when(head.contains(" cols="), num("cols")), "columns": F.split(F.regexp_extract(head, r"\[(.*)\]", 1), " ")}


def is_complete(text: Column) -> Column:
    """Whether a table has as many rows as its header says, and its end."""
    h = table_header(text)
    rows = F.size(F.filter(F.split(text, "\n"), lambda line: line.startswith("|")))
    return F.rtrim(text).endswith("@end") & (h["rows"].isNull() | (h["rows"] == rows))


def tab_decode(df: DataFrame, column: str, fields: T.StructType, schema: Schema | None = None) -> DataFrame:
    """The rows of the tables in a text column: the other columns, ``pos``, and ``fields`` read as their types."""
    others = [c for c in df.columns if c != column]
    ddl = T.StructType([*(df.schema[c] for c in others), T.StructField("pos", T.IntegerType()), T.StructField("_json", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, text in enumerate(part[column]):
                rows = values.parse(text, schema=schema) if text is not None else []
                own = [part[c].iloc[k] for c in others]
                out += [(*own, n, values.to_json(r)) for n, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=[*others, "pos", "_json"], dtype=object)

    read = df.mapInPandas(run, ddl).withColumn("_r", F.from_json("_json", fields))
    return read.select(*others, "pos", *(F.col("_r")[f.name].alias(f.name) for f in fields.fields))


def table_of(df: DataFrame, order: list[str], options: Options = DEFAULT) -> DataFrame:
    """A small result as one table text."""
    e = T.StructType(df.schema.fields)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"])
    return df.agg(rows.alias("_rows")).select(table_text(F.col("_rows"), e, options).alias("tab"))
