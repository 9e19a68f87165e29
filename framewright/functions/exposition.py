"""Exposition text of metric families, and that text read back as samples.

A family is a name, a kind (counter, gauge or histogram), a help text, and rows (label, value) or, for a histogram, (label, le, n, total, count) as
:func:`framewright.functions.metrics.histogram` lays them out. Each row carries the place of its line, so the text is put together by a sort
of rows, wherever they were made. Labels and help texts are escaped; families without rows still have their HELP and TYPE lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
_LABEL = r'[a-zA-Z_][a-zA-Z0-9_]*="(?:[^"\\]|\\.)*"'


@dataclass
class Family:
    """``label`` names the label column of ``rows``, None for a single value without one; ``digits`` are those behind the point, 0 for whole numbers."""

    name: str
    kind: str
    help: str
    rows: DataFrame
    label: str | None = None
    digits: int = 0


def escaped(text: Column) -> Column:
    """A label's value with backslash, quote and line end escaped; null is empty."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    """The value that :func:`escaped` wrote; a mark that no text holds stands for backslashes meanwhile."""
    mark = F.lit("\x00")
    text = F.replace(text, F.lit("\\\\"), mark)
    text = F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(text, mark, F.lit("\\"))


def _number(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double")) if digits else value.cast("bigint").cast("string")


def _bound(le: Column) -> Column:
    whole = le.cast("bigint").cast("string")
    return F.when(le == float("inf"), "+Inf").when(le == F.floor(le), whole).otherwise(le.cast("string"))


def _family_lines(place: int, family: Family) -> DataFrame:
    spark = family.rows.sparkSession
    heads = [(place, None, -2, 0.0, f"# HELP {family.name} {family.help}".replace("\\", "\\\\").replace("\n", "\\n")), (place, None, -1, 0.0, f"# TYPE {family.name} {family.kind}")]
    head = spark.createDataFrame(heads, "family int, label string, part int, le double, line string")
    label = F.col(family.label).cast("string") if family.label else F.lit(None).cast("string")
    tag = F.concat(F.lit(f'{family.label}="'), escaped(label), F.lit('"')) if family.label else None
    if family.kind != "histogram":
        name = F.concat(F.lit(family.name + "{"), tag, F.lit("} ")) if family.label else F.lit(family.name + " ")
        own = family.rows.select(F.lit(place).alias("family"), label.alias("label"), F.lit(0).alias("part"), F.lit(0.0).alias("le"), F.concat(name, _number(F.col("value"), family.digits)).alias("line"))
        return head.unionByName(own)
    prefix = F.concat(tag, F.lit(",")) if family.label else F.lit("")
    own_tag = F.concat(F.lit("{"), tag, F.lit("} ")) if family.label else F.lit(" ")
    bucket = F.struct(F.lit(0).alias("part"), F.concat(F.lit(family.name + "_bucket{"), prefix, F.lit('le="'), _bound(F.col("le")), F.lit('"} '), F.col("n").cast("bigint").cast("string")).alias("line"))
    total = F.struct(F.lit(1).alias("part"), F.concat(F.lit(family.name + "_sum"), own_tag, F.format_string("%.3f", F.col("total").cast("double"))).alias("line"))
    count = F.struct(F.lit(2).alias("part"), F.concat(F.lit(family.name + "_count"), own_tag, F.col("count").cast("bigint").cast("string")).alias("line"))
    lines = F.when(F.col("le") == float("inf"), F.array(bucket, total, count)).otherwise(F.array(bucket))
    own = family.rows.select(F.lit(place).alias("family"), label.alias("label"), "le", F.explode(lines).alias("x")).select("family", "label", "x.part", "le", "x.line")
    return head.unionByName(own)


def render(families: list[Family]) -> DataFrame:
    """(family, label, part, le, line) of all families in the order given: ordered by these columns, the lines are the text."""
    out = None
    for place, family in enumerate(families):
        lines = _family_lines(place, family)
        out = lines if out is None else out.unionByName(lines)
    return out


def text(lines: DataFrame) -> str:
    """The whole text, as a scrape returns it: as long as the registry, which its labels bound."""
    rows = lines.orderBy("family", F.col("label").asc_nulls_first(), "part", "le").select("line").toLocalIterator()
    return "".join(r.line + "\n" for r in rows)


def parse(lines: DataFrame, column: str = "line") -> DataFrame:
    """(metric, labels, value) of each sample line; comments, empty lines and lines of no sample go.

    Other columns of ``lines`` stay, such as the time of the scrape. The kinds stand on lines of their own: see :func:`kinds`."""
    line = F.trim(F.col(column))
    metric = F.regexp_extract(line, f"^({_NAME})", 1)
    body = F.regexp_extract(line, rf"^{_NAME}\{{(.*)\}}\s", 1)
    number = F.regexp_extract(line, rf"^{_NAME}(?:\{{.*\}})?\s+(\S+)(?:\s+-?\d+)?$", 1)
    said = F.lower("number_")
    value = F.when(said.isin("+inf", "inf"), F.lit(float("inf"))).when(said == "-inf", F.lit(float("-inf"))).when(said == "nan", F.lit(float("nan"))).otherwise(F.expr("try_cast(number_ as double)"))
    pairs = F.regexp_extract_all(F.col("body_"), F.lit(f"({_LABEL})"), F.lit(1))
    one = lambda p: F.struct(F.regexp_extract(p, "^([a-zA-Z_][a-zA-Z0-9_]*)=", 1), unescaped(F.regexp_extract(p, r'(?s)^[^=]*="(.*)"$', 1)))
    kept = [c for c in lines.columns if c != column]
    rows = lines.where(~line.startswith("#") & (F.length(line) > 0)).select(*kept, metric.alias("metric"), body.alias("body_"), number.alias("number_"))
    rows = rows.where("metric <> '' and number_ <> ''").select(*kept, "metric", F.map_from_entries(F.transform(pairs, one)).alias("labels"), value.alias("value"))
    return rows.where("value is not null")


def kinds(lines: DataFrame, column: str = "line") -> DataFrame:
    """(metric, kind) of the TYPE lines."""
    line = F.trim(F.col(column))
    rows = lines.where(line.startswith("# TYPE ")).select(F.split(line, r"\s+").alias("x"))
    return rows.where(F.size("x") == 4).select(F.get("x", F.lit(2)).alias("metric"), F.get("x", F.lit(3)).alias("kind")).distinct()
