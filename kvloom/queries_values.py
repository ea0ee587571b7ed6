"""Registered queries of ranges, codecs, forms, stream terminals and helpers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.functions import codecs
from kvloom.functions.ranges import KeyRange, conjunction, disjunction, first_key, next_key
from kvloom.operators import streams
from kvloom.plans import forms
from kvloom.plans import nodes as n
from kvloom.plans.search import matches
from kvloom.queries import documents, query, table

# ranges

_PAIRS = """(VALUES (0, 'all', 'of', 3, 7), (1, 'since', 'of', 3, 7), (2, 'until', 'of', 3, 7), (3, 'of', 'of', 3, 7), (4, 'single', 'of', 3, 7), (5, 'of', 'single', 3, 7), (6, 'of', 'all', 3, 7), (7, 'single', 'single', 3, 7)) p"""
_KINDS = {"all": KeyRange.all(), "since": KeyRange.since(5), "until": KeyRange.until(5), "of": KeyRange.of(4, 9), "single": KeyRange.single(5)}
_SQL_KINDS = {"all": "true", "since": "{k} >= 5", "until": "{k} < 5", "of": "{k} >= 4 AND {k} < 9", "single": "{k} = 5"}


def _inside(kind: str) -> str:
    return _SQL_KINDS[kind].format(k="k")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, n_nationkey AS k FROM (SELECT n_nationkey, n_nationkey AS k FROM nation) WHERE ({_inside(a)}) AND ({_inside(b)})" for a in _SQL_KINDS for b in _SQL_KINDS))
def range_intersect(spark, d):
    """The keys of the common range of every pair of kinds of ranges."""
    held, frames = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), []
    for a, x in _KINDS.items():
        for b, y in _KINDS.items():
            both = x.intersect(y)
            rows = held.where(both.predicate("k")) if both else held.limit(0)
            frames.append(rows.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "k"))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, bool_and(NOT ({_inside(b)}) OR ({_inside(a)})) AS inside FROM range(-100, 100) r(k)" for a in _SQL_KINDS for b in _SQL_KINDS))
def range_encloses(spark, d):
    """Whether each kind of range holds all keys of another."""
    rows = [(a, b, x.encloses(y)) for a, x in _KINDS.items() for b, y in _KINDS.items()]
    return spark.createDataFrame(rows, "a string, b string, inside boolean")


@query("SELECT prefix, first, next FROM (VALUES ('0102', '01020000', '01030000'), ('01FF', '01FF0000', '02000000'), ('FFFF', 'FFFF0000', 'FFFFFFFF00')) v(prefix, first, next)")
def range_next_prefix(spark, d):
    rows = [(p.hex().upper(), first_key(p, 4).hex().upper(), next_key(p, 4).hex().upper()) for p in (b"\x01\x02", b"\x01\xff", b"\xff\xff")]
    return spark.createDataFrame(rows, "prefix string, first string, next string")


# codecs


@query("SELECT o_orderkey AS key, hex(unhex(format('{:016X}', o_orderkey))) AS raw, 8 AS width FROM orders")
def codec_fixed(spark, d):
    fixed = codecs.fixed(8)
    raw = fixed.decode(fixed.encode(codecs.LONG.encode(F.col("o_orderkey"))))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.hex(codecs.RAW.encode(raw)).alias("raw"), F.octet_length(raw).alias("width"))


@query("SELECT c_custkey AS key, hex(encode(c_name)) AS raw, c_name AS back FROM customer")
def codec_fixed_text(spark, d):
    text = codecs.fixed_text(18)
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), text.encode(F.col("c_name")).alias("raw"))
    return held.select("key", F.hex("raw").alias("raw"), text.decode(F.col("raw")).alias("back"))


@query("SELECT n_nationkey AS key, format('{:08X}', n_nationkey * 3) AS raw, n_nationkey AS back, true AS refused FROM nation")
def codec_mapped(spark, d):
    """A codec over a bijection, and a value that is too wide for it."""
    third = codecs.INT.mapped(lambda v: (v / 3).cast("int"), lambda v: (v * 3).cast("int"))
    try:
        spark.range(1).select(third.decode(F.unhex(F.lit("0102")))).collect()
        refused = False
    except Exception:  # noqa: BLE001  Spark's own kinds
        refused = True
    held = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), third.encode(F.col("n_nationkey")).alias("raw"))
    return held.select("key", F.hex("raw").alias("raw"), third.decode(F.col("raw")).alias("back"), F.lit(refused).alias("refused"))


@query("SELECT n_nationkey AS key, CASE n_nationkey % 3 WHEN 0 THEN '00000005' || format('{:08X}', n_nationkey) WHEN 1 THEN '00000006' || format('{:016X}', n_nationkey) ELSE '00011170' || '00000001' || hex(encode(CAST(n_nationkey % 10 AS VARCHAR))) END AS raw, CASE n_nationkey % 3 WHEN 2 THEN n_nationkey % 10 ELSE n_nationkey END::VARCHAR AS back FROM nation")
def codec_registry(spark, d):
    """Codecs by number, more than a byte's worth, registered one by one."""
    as_text = lambda c, kind: c.mapped(lambda v: v.cast("string"), lambda v: v.cast(kind))
    made, first = {}, as_text(codecs.INT, "int")
    for current in (5, 6, 70000):
        made[current] = codecs.Versioned({5: first}, 5, micro=False)
        made[current].register(6, as_text(codecs.LONG, "bigint"))
        made[current].register(70000, codecs.TEXT)
        made[current].current = current
    key = F.col("n_nationkey")
    raw = F.when(key % 3 == 0, made[5].encode(key.cast("string"))).when(key % 3 == 1, made[6].encode(key.cast("string"))).otherwise(made[70000].encode((key % 10).cast("string")))
    held = table(spark, d, "nation").select(key.alias("key"), raw.alias("raw"))
    return held.select("key", F.hex("raw").alias("raw"), made[5].decode(F.col("raw")).alias("back"))


@query("SELECT o_custkey, string_agg(o_orderstatus || '=' || last, ',' ORDER BY o_orderstatus) AS entries FROM (SELECT o_custkey, o_orderstatus, max(o_orderkey) AS last FROM orders GROUP BY ALL) GROUP BY o_custkey")
def codec_entry_set(spark, d):
    """Entries with equal keys as a set: the last one wins."""
    one = F.struct(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("key"), F.col("o_orderkey").cast("string").alias("value"))
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("all"))
    pairs = F.transform("all", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    shown = F.transform(codecs.entry_set(pairs), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return lists.select("o_custkey", F.array_join(shown, ",").alias("entries"))


@query("SELECT n_nationkey AS key, n_nationkey * 2 AS current, n_nationkey AS previous, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE format('{:016X}', n_nationkey * 2) END AS raw FROM (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0) UNION ALL SELECT n_nationkey, NULL, n_nationkey, NULL FROM nation WHERE n_nationkey % 5 = 0")
def codec_updated(spark, d):
    """An updater run over encoded values, decoded once."""
    raw, old, new = codecs.updated(codecs.LONG.encode(F.col("n_nationkey")), codecs.LONG, lambda v: F.when(v % 5 != 0, v * 2))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), new.alias("current"), old.alias("previous"), F.hex(raw).alias("raw"))


@query("""SELECT n_nationkey AS key, CASE WHEN n_regionkey = 1 THEN '01' ELSE '00' END AS response, n_regionkey = 1 AS back,
                 len(list_filter(range(1, 9), lambda i: left(format('{:016X}', n_nationkey * 1000), 2 * i) = left(format('{:016X}', n_nationkey * 1001), 2 * i))) AS common FROM nation""")
def codec_helpers(spark, d):
    a, b = codecs.LONG.encode(F.col("n_nationkey") * 1000), codecs.LONG.encode(F.col("n_nationkey") * 1001)
    response = codecs.boolean_response(F.col("n_regionkey") == 1)
    shown = [F.hex(response).alias("response"), codecs.response_boolean(response).alias("back"), codecs.common_prefix(a, b, 8).cast("long").alias("common")]
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), *shown)


@query("SELECT key, string_agg(n, ',' ORDER BY n) AS numbers FROM (SELECT DISTINCT n_regionkey AS key, unnest([n_nationkey, n_regionkey]) AS n FROM nation) GROUP BY key")
def codec_int_set(spark, d):
    """JSON arrays of ints with repeats, as sets."""
    numbers = F.to_json(F.sort_array(F.flatten(F.collect_list(F.array("n_nationkey", "n_regionkey")))))
    texts = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(numbers.alias("text"))
    return texts.select("key", F.array_join(F.transform(codecs.int_set(F.col("text")), lambda i: i.cast("string")), ",").alias("numbers"))


# forms of queries


@query("SELECT doc_id, form FROM documents, (VALUES ('json'), ('text')) f(form) WHERE lang = 'de' AND n_chars BETWEEN 100 AND 900")
def q_forms(spark, d):
    """A query through its JSON form, and as free text."""
    q = n.BooleanQuery((n.BooleanQueryPart(n.TermQuery(n.Term("lang", "de")), n.Occur.MUST), n.BooleanQueryPart(n.LongPointRangeQuery("n_chars", 100, 900), n.Occur.MUST)))
    text = n.StandardQuery("+lang:de +n_chars:[100 TO 900]", ("text",), (n.PointConfig("n_chars", n.PointType.LONG),), ("lang",))
    made = {"json": forms.from_json(forms.to_json(q)), "text": text}
    frames = [matches(documents(spark, d), x).select("doc_id", F.lit(k).alias("form")) for k, x in made.items()]
    return frames[0].unionByName(frames[1])


# streams


@query("SELECT o_orderstatus, list_sort(list(DISTINCT o_orderpriority))::VARCHAR AS priorities, count(*) AS n FROM orders GROUP BY o_orderstatus")
def stream_collect(spark, d):
    found = streams.collected(table(spark, d, "orders"), ["o_orderstatus"], priorities=F.array_sort(F.collect_set("o_orderpriority")), n=F.count(F.lit(1)))
    return found.select("o_orderstatus", F.concat(F.lit("["), F.array_join("priorities", ", "), F.lit("]")).alias("priorities"), "n")


@query("SELECT terminal, value FROM (SELECT min(event_id) AS lo, max(event_id) AS hi, count(*) AS n, sum(user_id)::BIGINT AS s FROM events), LATERAL (VALUES ('first', lo), ('last', hi), ('count', n), ('sum', s), ('list', 25), ('any', 1)) v(terminal, value)")
def stream_terminals(spark, d):
    events = table(spark, d, "events")
    rows = [
        ("first", streams.to_first(events, ["event_id"]).event_id),
        ("last", events.agg(F.max("event_id")).first()[0]),
        ("count", streams.counted(events).first().n),
        ("sum", streams.summed(events, "user_id").first().total),
        ("list", len(streams.to_list(table(spark, d, "nation")))),
        ("any", int(streams.to_any(events) is not None)),
    ]
    return spark.createDataFrame(rows, "terminal string, value long")


@query("SELECT count(*) AS executed FROM nation")
def stream_executing(spark, d):
    return spark.createDataFrame([(streams.executing(table(spark, d, "nation"), lambda rows: None, ["n_nationkey"]),)], "executed long")


@query("SELECT event_id, event_type = 'click' AND user_id < 50 AND value > 20 AS every, event_type = 'click' OR user_id < 50 OR value > 20 AS either FROM events")
def stream_predicates(spark, d):
    parts = [F.col("event_type") == "click", F.col("user_id") < 50, F.col("value") > 20]
    return table(spark, d, "events").select("event_id", conjunction(parts).alias("every"), disjunction(parts).alias("either"))


@query("SELECT n_nationkey AS key, row_number() OVER (ORDER BY md5('s' || n_nationkey), n_nationkey) AS place FROM nation")
def stream_shuffled(spark, d):
    mixed = [r.n_nationkey for r in streams.shuffled(table(spark, d, "nation"), "n_nationkey", "s").collect()]
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(mixed)], "key int, place long")


@query("SELECT turn, least(20000, 10 * CAST(pow(2, turn) AS BIGINT)) AS middle, least(14000, 7 * CAST(pow(2, turn) AS BIGINT)) AS low, least(26000, 13 * CAST(pow(2, turn) AS BIGINT)) AS high FROM range(0, 16) r(turn)")
def stream_backoff(spark, d):
    """Waits before retries, in tenths of milliseconds: the middle and both ends."""
    rows = [(t, *[round(10 * streams.backoff(t, unit=u)) for u in (0.5, 0.0, 1.0)]) for t in range(16)]
    return spark.createDataFrame(rows, "turn long, middle long, low long, high long")


@query("SELECT n_nationkey AS key, array_to_string(list_transform(range(0, 3), lambda i: n_name), ',') AS joined FROM nation")
def stream_repeated(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.array_join(streams.repeated(F.col("n_name"), 3), ",").alias("joined"))


@query("SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1")
def codec_empty(spark, d):
    """Values without content: keys alone carry what there is."""
    held = table(spark, d, "customer").select("c_mktsegment", codecs.EMPTY.encode(F.lit(None).cast("string")).alias("raw"))
    return held.where(F.octet_length("raw") == 0).groupBy(F.col("c_mktsegment").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def codec_polymorphic(spark, d):
    """Typed JSON of query nodes, there and back."""
    rows = []
    for r in table(spark, d, "region").collect():
        back = forms.from_json(forms.to_json(n.IntPointExactQuery(r.r_name, r.r_regionkey)))
        rows.append((back.value, back.field))
    return spark.createDataFrame(rows, T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))
