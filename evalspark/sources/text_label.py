"""``<sentence>@<label>`` text lines (ISO-8859-1, CRLF) -> (sentence, label id).

The text source hands over each line's bytes as they are, so they are decoded here by the file's
charset.  No character but the line end has a meaning, and no line is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.config import FINANCIAL_LABEL_TO_ID
from evalspark.functions.text import strip_ws

LINE_RE = r"(?s)^(.*)@([^@]*)$"


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """One row per line, decoded with ``encoding`` (one that writes a line feed as one byte); line
    ends (LF or CRLF) are removed."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.regexp_replace(F.decode(F.col("value").cast("binary"), encoding), r"\r\z", "").alias("value"))


def write_lines(df: DataFrame, col: str, path: str, encoding: str = "ISO-8859-1", line_sep: str = "\r\n",
                mode: str = "overwrite") -> None:
    """Write one text column as lines in ``encoding`` (the counterpart of ``read_lines``).
    Characters that ISO-8859-1 lacks become question marks."""
    text = F.col(col)
    if encoding.upper() == "ISO-8859-1":
        text = F.regexp_replace(text, r"[^\x00-\xFF]", "?")
    df.select(F.encode(text, encoding).cast("string").alias("value")).write.mode(mode).option("lineSep", line_sep).text(path)


def parse_label_lines(df: DataFrame, col: str = "value", keep=()) -> DataFrame:
    """Strip the line; drop blank lines and lines without '@'; split on the *last* '@';
    sentiment = stripped, lower-cased right part (sentence kept as is)."""
    line = strip_ws(col)
    x = df.select(*keep, line.alias("_l")).filter((F.col("_l") != "") & F.col("_l").contains("@"))
    return x.select(*keep, F.regexp_extract("_l", LINE_RE, 1).alias("sentence"),
                    F.lower(strip_ws(F.regexp_extract("_l", LINE_RE, 2))).alias("sentiment"))


def read_labelled_text(spark: SparkSession, path: str, table: dict = FINANCIAL_LABEL_TO_ID,
                       encoding: str = "ISO-8859-1", keep_unknown: bool = False) -> DataFrame:
    """S2 + P5: file -> (sentence, label id); unknown labels are dropped.  ``keep_unknown``
    gives the lenient variant: sentence stripped, label kept as its stripped lower-case word,
    nothing dropped but blank or '@'-less lines."""
    parsed = parse_label_lines(read_lines(spark, path, encoding))
    if keep_unknown:
        return parsed.select(strip_ws("sentence").alias("sentence"), F.col("sentiment").alias("label"))
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return parsed.select("sentence", F.try_element_at(m, F.col("sentiment")).alias("label")) \
        .filter(F.col("label").isNotNull())
