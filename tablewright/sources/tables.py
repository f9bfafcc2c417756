"""Text readers and table sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import at, is_float, quoted, text_columns

# Encodings tried in order.
ENCODINGS = ["utf-8", "cp949", "euc-kr", "iso-8859-1", "latin-1"]
# Texts that mean "missing".
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
                 "NaN", "None", "n/a", "nan", "null"]


def detect_encoding(spark: SparkSession, path: str, encodings: list[str] = ENCODINGS) -> str:
    """First listed encoding in which every line of the files decodes. UTF-8 is tested in the JVM; the others line by line in tasks."""
    lines = spark.read.text(path)
    if encodings[0] == "utf-8" and lines.agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).first()["ok"] is not False:
        return "utf-8"
    tried = [e for e in encodings if e != "utf-8"]

    def test(batches):
        for b in batches:
            def fits(raw, e):
                try:
                    raw.decode(e)
                    return True
                except UnicodeDecodeError:
                    return False
            yield pd.DataFrame({f"e{i}": [all(fits(bytes(r), e) for r in b["raw"])] for i, e in enumerate(tried)})
    schema = ", ".join(f"e{i} boolean" for i in range(len(tried)))
    row = lines.select(F.col("value").cast("binary").alias("raw")).mapInPandas(test, schema).agg(
        *[F.bool_and(f"e{i}").alias(f"e{i}") for i in range(len(tried))]).first()
    return next(e for i, e in enumerate(tried) if row[f"e{i}"])


def _decoder(encoding: str):
    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: None if r is None else bytes(r).decode(encoding))
    return decode


def read_texts(spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """All columns as text, names trimmed.

    Files in other encodings than UTF-8 are parsed as Latin-1, which keeps every byte and splits like any text file,
    and their text cells are then decoded."""
    encoding = encoding or detect_encoding(spark, path)
    native = encoding in ("utf-8", "iso-8859-1", "latin-1")
    df = (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
          .option("encoding", "UTF-8" if encoding == "utf-8" else "ISO-8859-1").csv(path))
    if not native:
        decode = _decoder(encoding)
        df = df.select(*[decode(F.encode(at(c), "ISO-8859-1")).alias(c.encode("latin-1").decode(encoding)) for c in df.columns])
    return df.toDF(*[c.strip() for c in df.columns])


def blank_to_null(df: DataFrame, texts: list[str] = MISSING_TEXTS) -> DataFrame:
    """Listed texts become missing, in text columns."""
    named = set(text_columns(df))
    return df.select(*[F.when(~at(c).isin(texts), at(c)).alias(c) if c in named else at(c) for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns that wholly parse: boolean, whole number, number; dates stay text. One pass decides for all columns."""
    names = text_columns(df)
    if not names:
        return df
    row = df.selectExpr(*[x for i, c in enumerate(names) for x in (
        f"bool_and({quoted(c)} IN ('True', 'False', 'true', 'false', 'TRUE', 'FALSE')) AS b{i}",
        f"bool_and(try_cast({quoted(c)} AS BIGINT) IS NOT NULL OR {quoted(c)} IS NULL) AS i{i}",
        f"bool_and(try_cast({quoted(c)} AS DOUBLE) IS NOT NULL OR {quoted(c)} IS NULL) AS d{i}", f"count({quoted(c)}) AS n{i}")]).first()

    def cast(c):
        i = names.index(c)
        if not row[f"n{i}"]:
            return at(c).cast("double").alias(c)
        kind = "boolean" if row[f"b{i}"] else "bigint" if row[f"i{i}"] else "double" if row[f"d{i}"] else "string"
        return at(c).cast(kind).alias(c)
    return df.select(*[cast(c) if c in names else at(c) for c in df.columns])


def scan_csv(spark: SparkSession, path: str, encoding: str | None = None, missing: list[str] = MISSING_TEXTS, multi_line: bool = False) -> DataFrame:
    """CSV with header, encoding found, missing texts nulled, types inferred."""
    return infer_types(blank_to_null(read_texts(spark, path, encoding, multi_line), missing))


def scan_json_frame(texts: DataFrame, column: str, fields: list[str] | None = None) -> DataFrame:
    """Rows of column-oriented JSON tables (``{column: {index: value}}``), one table per text; no shuffle.

    ``fields`` saves the pass that finds the column names. Other columns of ``texts`` are kept."""
    frame = texts.withColumn("_f", F.from_json(at(column), "map<string,map<string,string>>"))
    if fields is None:
        fields = sorted(r["k"] for r in frame.select(F.explode(F.map_keys("_f")).alias("k")).distinct().collect())   # column names
    keys = F.array_distinct(F.flatten(F.transform(F.map_values("_f"), lambda m: F.map_keys(m))))
    rows = frame.withColumn("index", F.explode(keys))
    return rows.select(*[at(c) for c in texts.columns if c != column], "index", *[
        F.try_element_at(F.try_element_at("_f", F.lit(f)), F.col("index")).alias(f) for f in fields])


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""
    def leaves(schema: T.StructType, path: tuple = ()):
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)
    return df.select(*[F.col(".".join(quoted(p) for p in path)).alias(".".join(path)) for path in leaves(df.schema)])


def scan_json_flatten(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested JSON records (one per file, or one per line) flattened."""
    return flatten(spark.read.option("multiLine", multi_line).json(path))


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


# ---- sinks --------------------------------------------------------------------------

def sink_table(df: DataFrame, name: str, mode: str, path: str | None = None) -> str:
    writer = df.write.mode(mode)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return name


def sink_table_replace(df: DataFrame, name: str, path: str | None = None) -> str:
    """Create the table or replace its rows."""
    return sink_table(df, name, "overwrite", path)


def sink_table_append(df: DataFrame, name: str) -> str:
    """Add rows, creating the table if needed."""
    return sink_table(df, name, "append")


def sink_csv(df: DataFrame, path: str, index_by: list[str] | None = None) -> str:
    """CSV with header; ``index_by`` adds a leading 0-based ``index`` in that order."""
    if index_by:
        from ..plans.positions import ordered_positions
        rows, _ = ordered_positions(df, index_by)
        df = rows.select(F.col("_pos").alias("index"), *[at(c) for c in df.columns])
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row; NaN and null both written as null, numbers as 64 bit."""
    def clean(f):
        c = at(f.name)
        if is_float(df, f.name):
            return F.when(~F.isnan(c), c.cast("double")).alias(f.name)
        return c.cast("long").alias(f.name) if isinstance(f.dataType, T.IntegralType) else c
    fields = F.struct(*[clean(f) for f in df.schema])
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))


def sink_json_records(df: DataFrame, path: str) -> str:
    json_records(df).write.mode("overwrite").text(path)
    return path
