"""Registered queries of every numeric node, sorts and score modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.plans import fields
from kvloom.plans import nodes as n
from kvloom.plans.compiler import text_index
from kvloom.plans.search import ScoreMode, matches, search
from kvloom.queries import documents, on, query, register, table, term

#: By point type: a column of part to ask, its SQL type, and a value, a range and a set that meet some rows.
_PARTS = {
    "Int": ("p_size", "INTEGER", 7, (5, 9), (1, 5, 9)),
    "Long": ("p_partkey", "BIGINT", 42, (10, 25), (3, 14, 999999)),
    "Float": ("p_price", "FLOAT", 1000.5, (950.0, 1000.0), (1000.5, 1001.5)),
    "Double": ("p_price", "DOUBLE", 1000.5, (950.0, 1000.0), (1000.5, 1001.5)),
}


def _priced(point: str) -> tuple[str, str]:
    """The column expressions in Spark and DuckDB; prices are rounded to halves."""
    column, sql_type, *_ = _PARTS[point]
    if column != "p_price":
        return column, column
    return f"cast(round(p_retailprice * 2) / 2 as {sql_type.lower()})", f"CAST(round(p_retailprice * 2) / 2 AS {sql_type})"


def _one(point: str, kind: str, nd: bool) -> None:
    column, sql_type, value, (low, high), several = _PARTS[point]
    spark_column, sql_column = _priced(point)
    made = getattr(n, f"{point}{'ND' if nd else ''}{kind}Query")
    more, more_low = (3, 0) if point in ("Int", "Long") else (3.0, 0.5)
    second_spark, second_sql = f"cast(p_partkey % 10 as {sql_type.lower()})", f"CAST(p_partkey % 10 AS {sql_type})"
    if kind == "PointSet":
        node, condition = made("v", several), f"v IN ({', '.join(map(str, several))})"
    elif kind == "PointRange":
        node = made("v", (low, more_low), (high, more)) if nd else made("v", low, high)
        condition = f"v BETWEEN {low} AND {high}" + (f" AND w BETWEEN {more_low} AND {more}" if nd else "")
    else:
        node = made("v", (value, more)) if nd else made("v", value)
        condition = f"v = {value}" + (f" AND w = {more}" if nd else "")
    if nd and kind != "PointRange":  # a pair that some rows have
        node = made("v", (low, more))
        condition = f"v = {low} AND w = {more}"

    def run(spark, d):
        df = table(spark, d, "part")
        field = F.array(F.expr(spark_column), F.expr(second_spark)) if nd else F.expr(spark_column)
        return matches(text_index(df.select("p_partkey", field.alias("v")), "p_partkey"), node).select("p_partkey", "score")

    sql = f"SELECT p_partkey, 1.0::DOUBLE AS score FROM (SELECT p_partkey, {sql_column} AS v, {second_sql} AS w FROM part) WHERE {condition}"
    register(f"qn_{point.lower()}{'_nd' if nd else ''}_{kind.removeprefix('Point').lower()}", run, sql)


for _point in _PARTS:
    for _kind in ("Term", "PointExact", "PointRange", "PointSet"):
        _one(_point, _kind, False)
        if _kind != "PointSet":
            _one(_point, _kind, True)


_KINDS = {"lang": "StringFieldStored", "source": "StringField", "n_chars": "LongPoint", "text": "TextField", "doc_id": "LongStoredField"}


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' AND n_chars BETWEEN 100 AND 2000 AND list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'und')")
def q_field_kinds(spark, d):
    """Columns by kinds of fields: exact, point and analysed ones are asked, stored ones come back."""
    df = table(spark, d, "documents")
    asked = (term("de", "lang"), n.LongPointRangeQuery("n_chars", 100, 2000), term("und"))
    q = n.BooleanQuery(tuple(n.BooleanQueryPart(x, n.Occur.MUST) for x in asked))
    return fields.given_back(matches(fields.index_of(df, "doc_id", _KINDS), q).select("doc_id"), df, "doc_id", _KINDS)


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, '{x.spark_type}' AS spark_type, {str(x.searched).lower()} AS searched, {str(x.stored).lower()} AS stored" for k, x in fields.KINDS.items()))
def q_kinds(spark, d):
    """Every kind over a column of its type: the type it gets, and whether it is searched and given back."""
    rows = []
    for kind, x in fields.KINDS.items():
        df = spark.range(1).select("id", F.lit(None).cast(x.spark_type).alias("c"))
        index = fields.index_of(df, "id", {"c": kind})
        back = fields.given_back(df.select("id"), df, "id", {"c": kind})
        held = [f.dataType.simpleString() for f in (*index.df.schema.fields, *back.schema.fields) if f.name == "c"]
        rows.append((kind, held[0], "c" in index.df.columns, "c" in back.columns))
    return spark.createDataFrame(rows, "kind string, spark_type string, searched boolean, stored boolean")


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def q_sorted_exists(spark, d):
    return on(spark, d, "documents", "doc_id", n.SortedDocFieldExistsQuery("lang")).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE lang = 'it' OR lang = 'de'")
def s_no_sort(spark, d):
    q = n.BooleanQuery(tuple(n.BooleanQueryPart(term(x, "lang"), n.Occur.SHOULD) for x in ("it", "de")))
    return search(documents(spark, d), n.QueryParams(q, sort=n.NoSort())).page


@query("""SELECT m.mode AS mode, count(*) AS rows, m.scored AS scored FROM documents, (VALUES ('complete', true), ('complete_no_scores', false), ('top_scores', true), ('no_scores', false)) m(mode, scored)
          WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'clown') GROUP BY ALL""")
def s_score_modes(spark, d):
    frames = []
    for mode in ScoreMode:
        found = matches(documents(spark, d), term("clown"), mode)
        frames.append(found.agg(F.lit(mode.value).alias("mode"), F.count(F.lit(1)).alias("rows"), F.lit("score" in found.columns).alias("scored")))
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])
