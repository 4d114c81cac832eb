"""Queries on record tables: projections, joins, labels, segments, folds, calendar features and event-time counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions.columns import CALENDAR, bucketize, ids_text, multi_hot, six, time_feature, time_features
from seqloom.operators import records as ops
from seqloom.operators import sequences
from seqloom.operators.series import draw_sql
from seqloom.operators.stratify import delineate as delineate_
from seqloom.operators.stratify import stratified_folds as fold_groups
from seqloom.plans import fixtures as fx
from seqloom.tables import materialize

query = fx.Registry()


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# Projections and predicates

_STOI = {"click": 3, "view": 0, "error": 7, "signup": 2}


@query("available_channels", "SELECT user_id, array_to_string(list_sort(list(DISTINCT c)), ',') AS channels FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 0 WHEN 'error' THEN 7 WHEN 'signup' THEN 2 END AS c FROM events) WHERE c IS NOT NULL GROUP BY 1")
def available_channels(spark, sf):
    stoi = F.create_map(*[F.lit(x) for pair in _STOI.items() for x in pair])
    labels = fx.table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("l"))
    return labels.select("user_id", ids_text(F.array_sort(F.filter(F.transform("l", lambda x: stoi[x]), lambda c: c.isNotNull()))).alias("channels"))


@query("channel_scatter", "SELECT o_orderkey, array_to_string([coalesce(CASE WHEN o_orderkey % 5 = 2 THEN 9 END, 0), 0, coalesce(CASE WHEN o_orderkey % 5 <> 2 THEN o_custkey % 10 END, 0), o_orderkey % 10], ',') AS slots FROM orders")
def channel_scatter(spark, sf):
    """Sources to slots by name; missing slots are zero, slots beyond the last are dropped, the last writer wins."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    entry = lambda slot, v: F.struct(slot.alias("slot"), v.cast("long").alias("v"))
    source = F.array(entry(F.when(k % 5 == 2, 0).otherwise(2), F.lit(1)), entry(F.when(k % 5 == 2, 0).otherwise(2), F.when(k % 5 == 2, 9).otherwise(c % 10)), entry(F.lit(3), k % 10), entry(F.lit(6), c))
    last = lambda i: F.get(F.reverse(F.filter(source, lambda e: e["slot"] == i)), F.lit(0))["v"]
    slots = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(last(i), F.lit(0).cast("long")))
    return fx.table(spark, sf, "orders").select("o_orderkey", ids_text(slots).alias("slots"))


@query("bucketize", "SELECT c_custkey, CASE WHEN a IS NULL THEN -1 WHEN a < 30 THEN 0 WHEN a < 40 THEN 1 WHEN a < 50 THEN 2 WHEN a < 60 THEN 3 WHEN a < 70 THEN 4 WHEN a < 80 THEN 5 ELSE 6 END AS age FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 100 END AS a FROM customer)")
def bucketize_(spark, sf):
    age = F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") / 100)
    return fx.table(spark, sf, "customer").select("c_custkey", bucketize(age, [30, 40, 50, 60, 70, 80]).alias("age"))


@query("category_map", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS category FROM customer")
def category_map(spark, sf):
    m = F.create_map(F.lit("BUILDING"), F.lit(0), F.lit("MACHINERY"), F.lit(1))
    return fx.table(spark, sf, "customer").select("c_custkey", F.coalesce(m[F.col("c_mktsegment")], F.lit(2)).alias("category"))


@query("canonicalize", "SELECT p_partkey, replace(replace(replace(lower(trim(p_name)), ' ', '_'), 'widget', 'part'), 'small', 's') AS name FROM part")
def canonicalize(spark, sf):
    name = F.lower(F.trim("p_name"))
    for a, b in ((" ", "_"), ("widget", "part"), ("small", "s")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return fx.table(spark, sf, "part").select("p_partkey", name.alias("name"))


_MEASURE = "CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE replace(CAST(CAST(c_custkey AS DOUBLE) / 2 AS VARCHAR), '.', ',') || '/' || CAST(c_nationkey AS VARCHAR) || ' mmHg' END"


_PART = "round(TRY_CAST(replace(split_part(split_part(m, ' ', 1), '/', {}), ',', '.') AS DOUBLE), 6) + 0.0"


@query("parse_measurement", f"SELECT c_custkey, {_PART.format(1)} AS a, {_PART.format(2)} AS b FROM (SELECT c_custkey, {_MEASURE} AS m FROM customer)")
def parse_measurement(spark, sf):
    """`a/b unit` as two numbers, with decimal commas; `n/a` is null."""
    half = F.replace((F.col("c_custkey").cast("double") / 2).cast("string"), F.lit("."), F.lit(","))
    m = F.when(F.col("c_custkey") % 13 == 0, "n/a").otherwise(F.concat(half, F.lit("/"), F.col("c_nationkey").cast("string"), F.lit(" mmHg")))
    part = lambda k: six(F.replace(F.split_part(F.split_part(m, F.lit(" "), F.lit(1)), F.lit("/"), F.lit(k)), F.lit(","), F.lit(".")).try_cast("double"))
    return fx.table(spark, sf, "customer").select("c_custkey", part(1).alias("a"), part(2).alias("b"))


@query("drop_invalid", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_invalid(spark, sf):
    return fx.rec(spark, sf).where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "quality", "toxic")


@query("fold_split", "SELECT part, count(*) AS n FROM (SELECT CASE WHEN f < m - 1 THEN 'train' WHEN f = m - 1 THEN 'val' ELSE 'test' END AS part FROM (SELECT doc_id % 10 AS f, max(doc_id % 10) OVER () AS m FROM documents)) GROUP BY 1")
def fold_split(spark, sf):
    rows = fx.table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("f"))
    top = rows.agg(F.max("f").alias("m"))
    part = F.when(F.col("f") < F.col("m") - 1, "train").when(F.col("f") == F.col("m") - 1, "val").otherwise("test")
    return rows.crossJoin(F.broadcast(top)).groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row with the maximum


@query("record_range", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 100 AND 300")
def record_range(spark, sf):
    return fx.table(spark, sf, "orders").where(F.col("o_custkey").between(100, 300)).select("o_orderkey")


@query("fraction_slice", "SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY f) - 1 AS rn, count(*) OVER () AS n FROM (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY 1)) WHERE rn >= floor(n * 0.25::DOUBLE) AND rn < floor(n * 0.5::DOUBLE)")
def fraction_slice(spark, sf):
    """The second quarter of the customers in the order of their first appearance."""
    first = fx.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("f"))
    n = first.agg(F.count("*").alias("n"))
    rows = sequences.row_numbers(first, ["f"], F.floor(F.col("f") / 10_000)).crossJoin(F.broadcast(n))  # one row with the count
    return rows.where((F.col("rn") - 1 >= F.floor(F.col("n") * 0.25)) & (F.col("rn") - 1 < F.floor(F.col("n") * 0.5))).select("o_custkey")


@query("static_features", f"SELECT c_custkey, {r6('CAST(c_acctbal AS FLOAT)::DOUBLE')} AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer")
def static_features(spark, sf):
    both = F.array(F.col("c_acctbal").cast("float"), F.col("c_nationkey").cast("float"))
    return fx.table(spark, sf, "customer").select("c_custkey", six(both[0].cast("double")).alias("balance"), both[1].cast("double").alias("nation"))


# Joins


@query("join_left", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def join_left(spark, sf):
    rich = fx.table(spark, sf, "customer").where("c_acctbal > 0")
    return fx.table(spark, sf, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("join_multiway", f"SELECT c_custkey, n_name, r_name, {r6('c_acctbal')} AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_multiway(spark, sf):
    c, n, r = (fx.table(spark, sf, t) for t in ("customer", "nation", "region"))
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", "n_name", "r_name", six(F.col("c_acctbal")).alias("balance"))


@query("join_semi", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_toxic FROM documents")
def join_semi(spark, sf):
    toxic = fx.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("_id")).distinct()
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return docs.join(toxic, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.col("_id").isNotNull().alias("is_toxic"))


@query("join_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join_anti(spark, sf):
    return fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("dict_encode", "SELECT p_partkey, d.id AS code, coalesce(d.id, 2) AS code_or_last FROM part LEFT JOIN (VALUES ('ECONOMY', 0), ('STANDARD', 1)) AS d(name, id) ON p_type = d.name")
def dict_encode(spark, sf):
    m = F.create_map(F.lit("ECONOMY"), F.lit(0), F.lit("STANDARD"), F.lit(1))[F.col("p_type")]
    return fx.table(spark, sf, "part").select("p_partkey", m.alias("code"), F.coalesce(m, F.lit(2)).alias("code_or_last"))


@query("asof_label", "SELECT p.user_id, p.sample, CASE WHEN a.symbol IS NULL OR a.symbol = 'error' THEN 'unk' ELSE a.symbol END AS symbol FROM (SELECT user_id, unnest(range(0, 720, 24)) AS sample FROM (SELECT DISTINCT user_id FROM events)) p ASOF LEFT JOIN ann a ON p.user_id = a.user_id AND p.sample >= a.sample")
def asof_label(spark, sf):
    marks = fx.ann(spark, sf)
    probes = fx.table(spark, sf, "events").select("user_id").distinct().withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(696).cast("long"), F.lit(24).cast("long"))))
    return ops.asof_label(marks, probes, "user_id", "sample", "symbol", "unk", ["error"])


@query("label_rollup", "SELECT o_orderkey, string_agg(r, ',' ORDER BY i) AS regions FROM (SELECT o_orderkey, 1 AS i, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT o_orderkey, 2, r_name FROM orders JOIN nation ON o_orderkey % 40 = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def label_rollup(spark, sf):
    """Codes to the class above them, in order; codes without a class drop out."""
    o, c, n, r = (fx.table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("code"), "r_name")
    codes = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.array(F.col("c_nationkey").cast("long"), F.col("o_orderkey") % 40).alias("codes"))
    each = codes.select("o_orderkey", F.posexplode("codes").alias("i", "code")).join(up, "code")
    return each.groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "r_name"))), lambda x: x["r_name"]), ",").alias("regions"))


# Labels and aggregates


@query("label_support_filter", "WITH s AS (SELECT list(l) AS itos FROM (SELECT l FROM (SELECT unnest(tags) AS l FROM rec) GROUP BY 1 HAVING count(*) >= 45)) SELECT doc_id, array_to_string(list_filter(tags, lambda x: list_contains(itos, x)), ',') AS kept FROM rec, s")
def label_support_filter(spark, sf):
    return ops.label_support(fx.rec(spark, sf), "doc_id", "tags", 45).select("doc_id", F.array_join("kept", ",").alias("kept"))


@query("label_numeric", "WITH s AS (SELECT list_sort(list(l)) AS itos FROM (SELECT l FROM (SELECT unnest(tags) AS l FROM rec) GROUP BY 1 HAVING count(*) >= 45)) SELECT doc_id, array_to_string(list_transform(list_filter(tags, lambda x: list_contains(itos, x)), lambda x: list_position(itos, x) - 1), ',') AS ids FROM rec, s")
def label_numeric(spark, sf):
    rows = ops.label_support(fx.rec(spark, sf), "doc_id", "tags", 45)
    return rows.select("doc_id", ids_text(F.transform("kept", lambda x: F.array_position("itos", x) - 1)).alias("ids"))


@query("group_collect", "SELECT group_id, array_to_string(flatten(list(tags ORDER BY doc_id)), ',') AS labels, count(*) AS n FROM rec GROUP BY 1")
def group_collect(spark, sf):
    packed = F.array_sort(F.collect_list(F.struct("doc_id", "tags")))
    rows = fx.rec(spark, sf).groupBy("group_id").agg(packed.alias("_p"), F.count("*").alias("n"))
    return rows.select("group_id", F.array_join(F.flatten(F.transform("_p", lambda x: x["tags"])), ",").alias("labels"), "n")


@query("group_first", "SELECT group_id, arg_min(quality, doc_id) FILTER (WHERE quality IS NOT NULL) AS quality, arg_min(lang, doc_id) AS lang FROM rec GROUP BY 1")
def group_first(spark, sf):
    q = F.min_by("quality", F.when(F.col("quality").isNotNull(), F.col("doc_id")))
    return fx.rec(spark, sf).groupBy("group_id").agg(q.alias("quality"), F.min_by("lang", "doc_id").alias("lang"))


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang")
def value_counts(spark, sf):
    return fx.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("symbol_file_counts", "SELECT symbol, count(DISTINCT user_id) AS n FROM ann GROUP BY 1")
def symbol_file_counts(spark, sf):
    return fx.ann(spark, sf).groupBy("symbol").agg(F.count_distinct("user_id").alias("n"))


@query("combo_counts", "SELECT combo, count(*) AS n FROM (SELECT user_id, d, array_to_string(list_sort(list(DISTINCT symbol)), '|') AS combo FROM (SELECT user_id, sample // 24 AS d, symbol FROM ann) GROUP BY 1, 2) GROUP BY 1")
def combo_counts(spark, sf):
    days = fx.ann(spark, sf).groupBy("user_id", F.floor(F.col("sample") / 24).alias("d")).agg(F.array_join(F.array_sort(F.collect_set("symbol")), "|").alias("combo"))
    return days.groupBy("combo").agg(F.count("*").alias("n"))


@query("aggregate_predictions", f"SELECT user_id, {r6('avg(s)')} AS score, user_id % 2 AS target FROM (SELECT user_id, list_avg(seq) AS s FROM win) GROUP BY 1")
def aggregate_predictions(spark, sf):
    score = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x) / F.size("seq")
    rows = fx.win(spark, sf).select("user_id", score.alias("score"), (F.col("user_id") % 2).alias("target"))
    return ops.aggregate_predictions(rows, "user_id", "score", "target").select("user_id", six(F.col("score")).alias("score"), "target")


@query("sampling_weights", f"SELECT doc_id, {r6('w / min(w) OVER ()')} AS weight FROM (SELECT doc_id, (CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) * n_chars / sum(n_chars) OVER (PARTITION BY lang) AS w FROM documents WHERE n_chars > 0)")
def sampling_weights(spark, sf):
    rows = fx.rec(spark, sf).where("n_chars > 0")
    return ops.sampling_weights(rows, "lang", "n_chars", F.when(F.col("lang") == "en", 1.0).otherwise(2.0)).select("doc_id", six(F.col("weight")).alias("weight"))


@query("distinct_entities", f"SELECT count(DISTINCT group_id) AS n, {r6('count(DISTINCT CASE WHEN toxic = 1 THEN group_id END)::DOUBLE / count(DISTINCT group_id)')} AS ratio FROM rec")
def distinct_entities(spark, sf):
    hit = F.count_distinct(F.when(F.col("toxic") == 1, F.col("group_id")))
    return fx.rec(spark, sf).agg(F.count_distinct("group_id").alias("n"), six(hit / F.count_distinct("group_id")).alias("ratio"))


@query("first_record_flag", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_first FROM orders")
def first_record_flag(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return fx.table(spark, sf, "orders").select("o_orderkey", (F.row_number().over(w) == 1).alias("is_first"))


@query("union_all", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_all(spark, sf):
    a = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("label_subset", "SELECT doc_id, array_to_string(list_filter(tags, lambda x: list_contains(['en', 'fr', 'toxic'], x)), ',') AS kept FROM rec")
def label_subset(spark, sf):
    keep = F.array(F.lit("en"), F.lit("fr"), F.lit("toxic"))
    return fx.rec(spark, sf).select("doc_id", F.array_join(F.filter("tags", lambda x: F.array_contains(keep, x)), ",").alias("kept"))


@query("multi_hot", "SELECT doc_id, CASE WHEN quality = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c0, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c1, CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c2 FROM rec")
def multi_hot_(spark, sf):
    ids = F.array_compact(F.array(F.col("quality"), F.when(F.col("toxic") == 1, 2)))
    hot = multi_hot(ids, 3)
    return fx.rec(spark, sf).select("doc_id", *[hot[i].alias(f"c{i}") for i in range(3)])


@query("flags_to_labels", "SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END, CASE WHEN lang = 'en' THEN 2 END], lambda x: x IS NOT NULL), ',') AS ids FROM rec")
def flags_to_labels(spark, sf):
    flags = [F.col("quality") == 1, F.col("toxic") == 1, F.col("lang") == "en"]
    return fx.rec(spark, sf).select("doc_id", ids_text(F.array_compact(F.array(*[F.when(f, i) for i, f in enumerate(flags)]))).alias("ids"))


@query("combine_labels", "SELECT doc_id, array_to_string(list_filter([quality, toxic], lambda x: x IS NOT NULL), ',') AS ids FROM rec")
def combine_labels(spark, sf):
    return fx.rec(spark, sf).select("doc_id", ids_text(F.array_compact(F.array("quality", "toxic"))).alias("ids"))


@query("json_map_keys", "SELECT event_id, array_to_string(json_keys(props), ',') AS keys, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_map_keys(spark, sf):
    m = F.from_json("props", "map<string,double>")
    return fx.table(spark, sf, "events").select("event_id", F.array_join(F.map_keys(m), ",").alias("keys"), m["k"].alias("k"))


@query("string_funcs", "SELECT c_custkey, lower(split_part(c_name, '#', 1)) AS stem, substr(c_name, length(c_name) - 2) AS suffix, starts_with(c_mktsegment, 'B') AS is_b, concat_ws('/', c_mktsegment, trim(split_part(c_name, '#', 2))) AS path FROM customer")
def string_funcs(spark, sf):
    return fx.table(spark, sf, "customer").select(
        "c_custkey",
        F.lower(F.split_part("c_name", F.lit("#"), F.lit(1))).alias("stem"),
        F.right("c_name", F.lit(3)).alias("suffix"),
        F.startswith("c_mktsegment", F.lit("B")).alias("is_b"),
        F.concat_ws("/", "c_mktsegment", F.trim(F.split_part("c_name", F.lit("#"), F.lit(2)))).alias("path"),
    )


_LINES = "list_value('<age>: ' || CAST(c_custkey % 90 AS VARCHAR), '<sex>: ' || CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END, '<diagnoses>', c_mktsegment || '.', c_name || '.')"


@query("parse_comments", f"SELECT c_custkey, TRY_CAST(split_part(c[1], ': ', 2) AS INTEGER) AS age, split_part(c[2], ': ', 2) AS sex, array_to_string(list_transform(c[list_position(c, '<diagnoses>') + 1 :], lambda x: x[1 : length(x) - 1]), '|') AS diagnoses FROM (SELECT c_custkey, {_LINES} AS c FROM customer)")
def parse_comments(spark, sf):
    """Tagged header lines: age, sex, and everything after the tag of diagnoses without its last character."""
    line = lambda tag, v: F.concat(F.lit(f"<{tag}>: "), v)
    k = F.col("c_custkey")
    c = F.array(line("age", (k % 90).cast("string")), line("sex", F.when(k % 2 == 0, "F").otherwise("M")), F.lit("<diagnoses>"), F.concat("c_mktsegment", F.lit(".")), F.concat("c_name", F.lit(".")))
    tagged = lambda tag: F.split_part(F.get(F.filter(c, lambda x: x.startswith(f"<{tag}>")), F.lit(0)), F.lit(": "), F.lit(2))
    after = F.slice(c, (F.array_position(c, "<diagnoses>") + 1).cast("int"), F.size(c))
    diagnoses = F.array_join(F.transform(after, lambda x: F.left(x, F.length(x) - 1)), "|")
    return fx.table(spark, sf, "customer").select("c_custkey", tagged("age").try_cast("int").alias("age"), tagged("sex").alias("sex"), diagnoses.alias("diagnoses"))


@query("record_datetime", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 0 SECOND ELSE to_seconds(o_orderkey % 86400) END END AS at FROM orders")
def record_datetime(spark, sf):
    """Date and time of day as one timestamp; no date gives none, no time means midnight."""
    k = F.col("o_orderkey")
    day = F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    seconds = F.when(k % 3 != 0, k % 86400)
    at = F.to_timestamp_ntz(F.concat(day, F.lit(" 00:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")) + F.make_dt_interval(secs=F.coalesce(seconds, F.lit(0)).cast("decimal(18,6)"))
    return fx.table(spark, sf, "orders").select("o_orderkey", at.alias("at"))


# Calendar

_CAL = {"second": "second(ts)", "minute": "minute(ts)", "hour": "hour(ts)", "weekday": "isodow(ts) - 1", "day": "day(ts)", "dayofyear": "dayofyear(ts)", "month": "month(ts)", "week": "week(ts)"}


def _feature_sql(n: str) -> str:
    _, least, span = CALENDAR[n]
    return f"round(({_CAL[n]} - {least}) / {span}.0::DOUBLE - 0.5::DOUBLE, 6) + 0.0 AS {n}"


@query("time_features", f"SELECT event_id, {', '.join(_feature_sql(n) for n in _CAL)} FROM events")
def time_features_(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", *[six(time_feature(F.col("ts"), n)).alias(n) for n in _CAL])


@query("time_features_freq", f"SELECT event_id, {', '.join(_feature_sql(n) for n in ('minute', 'hour', 'weekday', 'day', 'dayofyear'))} FROM events")
def time_features_freq(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", *[six(c).alias(n) for n, c in time_features(F.col("ts"), "15T").items()])


@query("calendar_features", "SELECT event_id, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) // 15 AS INTEGER) AS quarter FROM events")
def calendar_features(spark, sf):
    ts = F.col("ts")
    return fx.table(spark, sf, "events").select("event_id", F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour"), F.floor(F.minute(ts) / 15).cast("int").alias("quarter"))


@query("tumbling_counts", f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {r6('sum(value)')} AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    rows = fx.table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), six(F.sum("value")).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("session_counts", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_counts(spark, sf):
    rows = fx.table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# Segments and folds

_SEG = "SELECT user_id, sample AS start, coalesce(lead(sample) OVER (PARTITION BY user_id ORDER BY sample), 721) AS \"end\", symbol FROM ann"


@query("segment_list", _SEG)
def segment_list(spark, sf):
    return ops.segments(fx.ann(spark, sf), "user_id", "sample", "symbol", F.lit(720).cast("long"))


@query("segment_filter", f"SELECT user_id, start, \"end\", symbol, number FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS number FROM ({_SEG}) WHERE symbol <> 'error') WHERE \"end\" - start > 0 AND \"end\" - start >= 6")
def segment_filter(spark, sf):
    return ops.segment_filter(segment_list(spark, sf), "user_id", "symbol", "error", 6).select("user_id", "start", "end", "symbol", "number")


@query("islands", "SELECT user_id, min(sample) AS first, max(sample) AS last FROM (SELECT user_id, sample, sample - row_number() OVER (PARTITION BY user_id ORDER BY sample) AS g FROM ann) GROUP BY user_id, g")
def islands(spark, sf):
    return sequences.islands(fx.ann(spark, sf), "user_id", "sample")


@query("gap_relabel", "SELECT user_id, sample, CASE WHEN symbol = 'error' AND b = 'click' AND a = 'view' THEN 'cv' WHEN symbol = 'error' AND b = 'view' AND a = 'click' THEN 'vc' ELSE symbol END AS symbol FROM (SELECT *, lag(symbol) OVER w AS b, lead(symbol) OVER w AS a FROM ann WINDOW w AS (PARTITION BY user_id ORDER BY sample))")
def gap_relabel(spark, sf):
    names = {("click", "view"): "cv", ("view", "click"): "vc"}
    return ops.gap_relabel(fx.ann(spark, sf), "user_id", "sample", "symbol", "error", names).select("user_id", "sample", "symbol")


@query("edge_trim", "SELECT user_id, sample, symbol FROM (SELECT *, min(CASE WHEN symbol <> 'view' THEN sample END) OVER (PARTITION BY user_id) AS lo, max(CASE WHEN symbol <> 'view' THEN sample END) OVER (PARTITION BY user_id) AS hi FROM ann) WHERE sample BETWEEN lo AND hi")
def edge_trim(spark, sf):
    return ops.edge_trim(fx.ann(spark, sf), "user_id", "sample", "symbol", "view").select("user_id", "sample", "symbol")


_MARK = "CASE symbol WHEN 'click' THEN '(' WHEN 'purchase' THEN ')' ELSE symbol END"
_OPEN = "s[i] = '(' AND s[i + 1] NOT IN ('(', ')')"
_PEAK = "s[i] NOT IN ('(', ')')"


@query(
    "delineate",
    f"""WITH RECURSIVE m AS (SELECT user_id, list(sample ORDER BY sample) AS p, list({_MARK} ORDER BY sample) AS s FROM ann GROUP BY 1),
       w AS (SELECT user_id, p, s, 1 AS i, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS "end", CAST(NULL AS VARCHAR) AS kind FROM m
             UNION ALL
             SELECT user_id, p, s, i + CASE WHEN {_OPEN} AND s[i + 2] = ')' THEN 3 WHEN {_OPEN} THEN 2 WHEN {_PEAK} AND s[i + 1] = ')' THEN 2 ELSE 1 END,
                    CASE WHEN {_OPEN} OR {_PEAK} THEN p[i] END,
                    CASE WHEN {_OPEN} AND s[i + 2] = ')' THEN p[i + 2] WHEN {_OPEN} THEN p[i + 1] WHEN {_PEAK} AND s[i + 1] = ')' THEN p[i + 1] WHEN {_PEAK} THEN p[i] END,
                    CASE WHEN {_OPEN} THEN s[i + 1] WHEN {_PEAK} THEN s[i] END
             FROM w WHERE i <= len(p))
       SELECT user_id, start, "end", kind FROM w WHERE kind IS NOT NULL""",
)
def delineate(spark, sf):
    """Waves from marks: click opens, purchase closes, the rest are peaks."""
    s = F.when(F.col("symbol") == "click", "(").when(F.col("symbol") == "purchase", ")").otherwise(F.col("symbol"))
    return delineate_(fx.ann(spark, sf).select("user_id", "sample", s.alias("symbol")))


def _folds(spark, sf, ratios: list[float], **more):
    """Documents as groups: how many of each profile (its labels, joined) each fold got."""
    rows = fx.rec(spark, sf)
    fold = fold_groups(rows, "doc_id", "tags", ratios, **more)
    return rows.join(fold, "doc_id").groupBy(ids_text(F.array_sort("tags")).alias("profile"), "fold").agg(F.count("*").alias("k"))


def _shares(counts, ratios: list[float]):
    """(profile, fold, m, quota, k): every fold with its share of each profile, rounded down, and what it got."""
    m = counts.groupBy(F.col("profile").alias("_p")).agg(F.sum("k").alias("m"))
    every = m.select("_p", "m", F.posexplode(F.array(*[F.floor(F.col("m") * r + 1e-9) for r in ratios])).alias("_f", "quota"))
    both = every.join(counts, (F.col("_p") == F.col("profile")) & (F.col("_f") == F.col("fold")), "left")
    return both.select(F.col("_p").alias("profile"), F.col("_f").cast("long").alias("fold"), "m", "quota", F.coalesce("k", F.lit(0)).alias("k"))


def _shares_sql(ratios: list[float]) -> str:
    values = ", ".join(f"({i}::BIGINT, {r!r}::DOUBLE)" for i, r in enumerate(ratios))
    return f"""share AS (SELECT profile, fold, m, CAST(floor(m * ratio + 1e-9::DOUBLE) AS BIGINT) AS quota
               FROM (SELECT array_to_string(list_sort(tags), ',') AS profile, count(*) AS m FROM rec GROUP BY 1), (VALUES {values}) AS r(fold, ratio))"""


_TENTHS, _SUBSETS = [0.1] * 10, [0.8, 0.1, 0.1]


@query("stratified_folds", f"WITH {_shares_sql(_TENTHS)} SELECT label, fold, CAST(sum(m) AS BIGINT) AS total, CAST(sum(quota) AS BIGINT) AS quota, TRUE AS balanced FROM (SELECT *, unnest(string_split(profile, ',')) AS label FROM share) GROUP BY 1, 2")
def stratified_folds(spark, sf):
    """Ten folds, label by label: the documents that have it, those that a fold got for certain (no more than its share of each
    profile, rounded down), and whether what it got in all is within five documents, or a
    twentieth, of a tenth."""
    each = _shares(_folds(spark, sf, _TENTHS), _TENTHS).withColumn("label", F.explode(F.split("profile", ",")))
    out = each.groupBy("label", "fold").agg(F.sum("m").alias("total"), F.sum(F.least("quota", "k")).alias("quota"), F.sum("k").alias("k"))
    off = F.abs(F.col("k") - F.col("total") / 10)
    return out.select("label", "fold", "total", "quota", (off <= F.greatest(F.lit(5.0), F.col("total") * 0.05)).alias("balanced"))


@query("stratified_folds_batched", f"WITH {_shares_sql(_TENTHS)} SELECT profile, fold, m, quota, TRUE AS within FROM share")
def stratified_folds_batched(spark, sf):
    """What rounding leaves, in batches of about 50 groups: still every fold has its share of each profile, and of the rest no more
    than there is."""
    out = _shares(_folds(spark, sf, _TENTHS, batch=50), _TENTHS)
    rest = F.col("m") - F.sum("quota").over(Window.partitionBy("profile"))
    return out.select("profile", "fold", "m", "quota", F.col("k").between(F.col("quota"), F.col("quota") + rest).alias("within"))


@query("stratified_subsets", f"WITH {_shares_sql(_SUBSETS)} SELECT profile, fold AS subset, quota, TRUE AS within FROM share")
def stratified_subsets(spark, sf):
    """Subsets of 8:1:1."""
    out = _shares(_folds(spark, sf, _SUBSETS, seed=5), _SUBSETS)
    rest = F.col("m") - F.sum("quota").over(Window.partitionBy("profile"))
    return out.select("profile", F.col("fold").alias("subset"), "quota", F.col("k").between(F.col("quota"), F.col("quota") + rest).alias("within"))


_DRAW = draw_sql("c")


@query("kfold_roundrobin", f"SELECT c AS c_custkey, (row_number() OVER (PARTITION BY s ORDER BY {_DRAW}, c) - 1) % 10 AS fold FROM (SELECT c_custkey AS c, c_mktsegment AS s FROM customer)")
def kfold_roundrobin(spark, sf):
    return ops.kfold(fx.table(spark, sf, "customer"), "c_custkey", "c_mktsegment", 10).select("c_custkey", "fold")


@query("group_fold_consistency", f"SELECT o_orderkey, coalesce(f.fold, -1) AS fold FROM orders LEFT JOIN (SELECT c, (row_number() OVER (PARTITION BY s ORDER BY {_DRAW}, c) - 1) % 10 AS fold FROM (SELECT c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_acctbal > 0)) f ON o_custkey = c")
def group_fold_consistency(spark, sf):
    """Every record gets the fold of its group; groups without one get -1."""
    folds = ops.kfold(fx.table(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey", "c_mktsegment", 10)
    out = fx.table(spark, sf, "orders").join(folds.select("c_custkey", "fold"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("o_orderkey", F.coalesce("fold", F.lit(-1).cast("long")).alias("fold"))


@query(
    "record_pipeline",
    f"""WITH s AS (SELECT list_sort(list(l)) AS itos FROM (SELECT l FROM (SELECT unnest(tags) AS l FROM rec) GROUP BY 1 HAVING count(*) >= 45)),
       fold AS (SELECT c, (row_number() OVER (PARTITION BY 0 ORDER BY {_DRAW}, c) - 1) % 4 AS fold FROM (SELECT DISTINCT CAST(substr(group_id, 4) AS BIGINT) AS c FROM rec)),
       r AS (SELECT doc_id, group_id, n_chars, array_to_string(list_transform(list_filter(tags, lambda x: list_contains(itos, x)), lambda x: list_position(itos, x) - 1), ',') AS ids, CASE WHEN quality IS NULL THEN -1 ELSE quality END AS quality FROM rec, s WHERE n_chars > 20)
       SELECT doc_id, ids, quality, fold, {r6("(n_chars - avg(n_chars) OVER (PARTITION BY fold)) / (stddev_pop(n_chars) OVER (PARTITION BY fold) + 1e-8::DOUBLE)")} AS z FROM r JOIN fold ON c = CAST(substr(group_id, 4) AS BIGINT)""",
)
def record_pipeline(spark, sf):
    """The spine of record preparation: clean, filter labels by support, encode, fold whole groups, statistics per fold."""
    from seqloom.operators.pipeline import RecordPipeline

    prepare = RecordPipeline(key="doc_id", group="group_id", labels="tags", size="n_chars", least_support=45, least_size=21, folds=4)
    out = prepare(fx.rec(spark, sf), group_number=F.substr("group_id", F.lit(4)).cast("long"))
    return out.select("doc_id", ids_text("ids").alias("ids"), F.coalesce("quality", F.lit(-1)).alias("quality"), "fold", six(F.col("z")).alias("z"))


@query("log_label", f"SELECT doc_id, {r6('ln(n_chars)')} AS label FROM documents WHERE n_chars > 0")
def log_label(spark, sf):
    """The logarithm of a label to regress on."""
    return fx.table(spark, sf, "documents").where("n_chars > 0").select("doc_id", six(F.log("n_chars")).alias("label"))


@query("dummy_label", "SELECT doc_id, 0 AS label FROM documents")
def dummy_label(spark, sf):
    """Records without a label column get label 0."""
    return fx.table(spark, sf, "documents").select("doc_id", F.lit(0).alias("label"))


@query("drop_columns", "SELECT doc_id, lang, source FROM documents")
def drop_columns(spark, sf):
    return fx.table(spark, sf, "documents").drop("text", "n_chars")


# Preparations as chains of steps


_FOLD = draw_sql("o_orderkey")


@query(
    "prepare_exams",
    f"""SELECT o_orderkey, array_to_string(list_filter([o_orderstatus, CASE WHEN o_totalprice > 100000 THEN 'high' END, c_mktsegment], lambda x: x IS NOT NULL), ',') AS labels, fold
       FROM (SELECT *, {draw_sql("o_custkey", seed=3)} % 5 AS fold, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) JOIN customer ON c_custkey = o_custkey WHERE rn <= 3 AND fold IN (0, 2)""",
)
def prepare_exams(spark, sf):
    """At most three records of a group, matched with the group's table, with a composite label, in two of five folds."""
    from seqloom.operators import prepare
    from seqloom.operators.signal import chained

    high = F.when(F.col("o_totalprice") > 100000, "high")
    steps = prepare.recipe(
        "exams with many records",
        at_most_of_each=("o_custkey", 3, "o_orderdate", "o_orderkey"),
        matched_only=(fx.table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"),
        composite_labels=("labels", F.col("o_orderstatus"), high, F.col("c_mktsegment")),
        folds_of_groups=("o_custkey", 5, 3),
        only_folds=(0, 2),
    )
    return chained(fx.table(spark, sf, "orders"), steps).select("o_orderkey", F.array_join("labels", ",").alias("labels"), "fold")


@query(
    "prepare_first_records",
    f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey = 202 THEN 201 ELSE o_custkey END AS c, o_orderdate, o_orderstatus, o_orderpriority FROM orders WHERE NOT isnan(o_totalprice)),
       f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o_orderdate, o_orderkey) AS rn FROM r) WHERE rn = 1)
       SELECT o_orderkey, c AS o_custkey, o_orderstatus || ',' || o_orderpriority AS labels, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_FOLD}, o_orderkey) - 1) % 10 AS fold FROM f""",
)
def prepare_first_records(spark, sf):
    """The first complete record of each group, ids that mean the same one levelled, and folds within each status."""
    from seqloom.operators import prepare
    from seqloom.operators.signal import chained

    steps = prepare.recipe(
        "diagnoses with first records",
        aliased=("o_custkey", {202: 201}),
        complete=("o_totalprice",),
        composite_labels=("labels", F.col("o_orderstatus"), F.col("o_orderpriority")),
        first_of_each=("o_custkey", "o_orderdate", "o_orderkey"),
        folds_within=("o_orderstatus", "o_orderkey", 10),
    )
    return chained(fx.table(spark, sf, "orders"), steps).select("o_orderkey", "o_custkey", F.array_join("labels", ",").alias("labels"), "fold")


@query(
    "prepare_annotated",
    """WITH e AS (SELECT DISTINCT user_id, CASE WHEN symbol IN ('click', 'view') THEN 'click|view' ELSE symbol END AS x FROM ann),
       k AS (SELECT x FROM e GROUP BY 1 HAVING count(*) >= 10)
       SELECT u.user_id, coalesce(string_agg(e.x, ',' ORDER BY e.x), '') AS labels
       FROM (SELECT DISTINCT user_id FROM ann) u LEFT JOIN (SELECT * FROM e WHERE x IN (SELECT x FROM k)) e USING (user_id) GROUP BY 1""",
)
def prepare_annotated(spark, sf):
    """Labels of annotated records, two of them taken together, as far as they have support."""
    from seqloom.operators import prepare
    from seqloom.operators.signal import chained

    rows = fx.ann(spark, sf).groupBy("user_id").agg(F.collect_set("symbol").alias("symbols"))
    steps = [prepare.merged_names("symbols", prepare.merged(["click", "view"])), prepare.supported("user_id", "symbols", 10)]
    return chained(rows, steps).select("user_id", F.array_join(F.array_sort("kept"), ",").alias("labels"))


def _chained(rows, kind: str, **arguments):
    from seqloom.operators import prepare
    from seqloom.operators.signal import chained

    return chained(rows, prepare.recipe(kind, **arguments))


@query(
    "prepare_optional_labels",
    f"""WITH r AS (SELECT doc_id, source, quality + 1 AS l1, CASE WHEN toxic = 1 THEN 2 END AS l2 FROM documents JOIN labels USING (doc_id))
       SELECT doc_id, CASE WHEN source <> 'src1' THEN array_to_string(list_filter([CASE WHEN l1 IS NOT NULL THEN 'q' || (l1 - 1) END, CASE WHEN l2 IS NOT NULL THEN 't' || (l2 - 1) END], lambda x: x IS NOT NULL), ',') END AS labels,
              (row_number() OVER (PARTITION BY source ORDER BY {draw_sql("doc_id")}, doc_id) - 1) % 10 AS fold FROM r""",
)
def prepare_optional_labels(spark, sf):
    """Labels counted from 1 in optional columns: matched, counted from 0, put together, taken from what is not for training, and
    folds within each source."""
    labels = fx.table(spark, sf, "labels").select("doc_id", (F.col("quality") + 1).alias("l1"), F.when(F.col("toxic") == 1, 2).alias("l2"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    out = _chained(
        fx.table(spark, sf, "documents").select("doc_id", "source"),
        "labels in optional columns",
        matched_only=(labels, "doc_id"),
        zero_based=("l1", "l2"),
        composite_labels=("labels", name("q", "l1"), name("t", "l2")),
        labels_of_part=("labels", F.col("source") != "src1"),
        folds_within=("source", "doc_id", 10),
    )
    return out.select("doc_id", F.array_join("labels", ",").alias("labels"), "fold")


@query(
    "prepare_long_recordings",
    f"""SELECT vec_id, {r6("list_avg(list_transform(embedding[1:40], lambda v: v::DOUBLE))")} AS mean, quality, {draw_sql("label", seed=3)} % 5 AS fold
       FROM embeddings JOIN labels ON doc_id = vec_id WHERE len(list_filter(embedding, lambda v: v IS NULL OR isnan(v))) = 0""",
)
def prepare_long_recordings(spark, sf):
    """Recordings without a hole, cut to a length, matched with diagnoses, in folds of whole patients (here: of labels)."""
    diagnoses = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    rows = fx.table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = _chained(rows, "long recordings of patients", complete=("embedding",), at_most_long=("embedding", 40), matched_only=(diagnoses, "vec_id"), folds_of_groups=("label", 5, 3))
    mean = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x) / F.size("embedding")
    return out.select("vec_id", six(mean).alias("mean"), "quality", "fold")


@query(
    "prepare_collections",
    f"""WITH r AS (SELECT * FROM rec WHERE group_id IN ('src0', 'src2', 'src5') AND quality IS NOT NULL),
       k AS (SELECT x FROM (SELECT unnest(tags) AS x FROM r) GROUP BY 1 HAVING count(*) >= 8)
       SELECT doc_id, coalesce((SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT unnest(tags) AS x, generate_subscripts(tags, 1) AS i) WHERE x IN (SELECT x FROM k)), '') AS labels,
              (row_number() OVER (PARTITION BY group_id ORDER BY {draw_sql("doc_id")}, doc_id) - 1) % 10 AS fold FROM r""",
)
def prepare_collections(spark, sf):
    """Some of several collections, complete records only, labels with support, folds within each collection."""
    out = _chained(fx.rec(spark, sf), "several collections", only_datasets=("group_id", ["src0", "src2", "src5"]), complete=("quality",), supported=("doc_id", "tags", 8), folds_within=("group_id", "doc_id", 10))
    return out.select("doc_id", F.array_join("kept", ",").alias("labels"), "fold")


@query(
    "prepare_two_labels",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, [o_orderstatus, o_orderpriority] AS l, o_totalprice * 0.001::DOUBLE AS price FROM orders),
       k AS (SELECT x FROM (SELECT unnest(l) AS x FROM r) GROUP BY 1 HAVING count(*) >= 400)
       SELECT o_orderkey, array_to_string(list_filter(l, lambda x: list_contains(ks, x)), ',') AS labels, {r6("price")} AS price,
              (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_FOLD}, o_orderkey) - 1) % 10 AS fold FROM r, (SELECT list(x) AS ks FROM k)""",
)
def prepare_two_labels(spark, sf):
    """Two label columns as one list, values in another unit, labels with support, folds within the first label."""
    out = _chained(fx.table(spark, sf, "orders"), "two label columns", composite_labels=("labels", F.col("o_orderstatus"), F.col("o_orderpriority")), unit=("o_totalprice", 0.001), supported=("o_orderkey", "labels", 400), folds_within=("o_orderstatus", "o_orderkey", 10))
    return out.select("o_orderkey", F.array_join("kept", ",").alias("labels"), six(F.col("o_totalprice")).alias("price"), "fold")


@query(
    "prepare_readers",
    f"""WITH o AS (SELECT o_custkey AS c, bool_or(o_orderstatus = 'O') AS a, bool_or(o_totalprice > 400000) AS b, list_sort(list(DISTINCT o_orderpriority))[1:2] AS seen FROM orders GROUP BY 1)
       SELECT c AS c_custkey, array_to_string(list_filter([CASE WHEN a THEN 'open' END, CASE WHEN b THEN 'dear' END, CASE WHEN c_acctbal < 0 THEN 'owing' END], lambda x: x IS NOT NULL), ',') AS labels,
              array_to_string(seen, ',') AS seen, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY {draw_sql("c")}, c) - 1) % 10 AS fold FROM customer JOIN o ON c = c_custkey""",
)
def prepare_readers(spark, sf):
    """Flags that several readers gave, as labels; what they saw, cut to a length; folds within each segment."""
    o = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    reader = o.agg(F.bool_or(F.col("o_orderstatus") == "O").alias("a"), F.bool_or(F.col("o_totalprice") > 400000).alias("b"), F.array_sort(F.collect_set("o_orderpriority")).alias("seen"))
    flags = [F.when(F.col("a"), "open"), F.when(F.col("b"), "dear"), F.when(F.col("c_acctbal") < 0, "owing")]
    out = _chained(fx.table(spark, sf, "customer"), "flags of several readers", matched_only=(reader, "c_custkey"), composite_labels=("labels", *flags), at_most_long=("seen", 2), folds_within=("c_mktsegment", "c_custkey", 10))
    return out.select("c_custkey", F.array_join("labels", ",").alias("labels"), F.array_join("seen", ",").alias("seen"), "fold")


@query(
    "prepare_recordings",
    f"""WITH a AS (SELECT CASE WHEN user_id = 3 THEN 2 ELSE user_id END AS u, CASE WHEN symbol IN ('error', 'signup') THEN 'error|signup' ELSE symbol END AS x FROM ann),
       d AS (SELECT DISTINCT u, x FROM a), k AS (SELECT x FROM d GROUP BY 1 HAVING count(*) >= 5)
       SELECT u AS user_id, coalesce(string_agg(CASE WHEN x IN (SELECT x FROM k) THEN x END, ',' ORDER BY x), '') AS labels, {draw_sql("u", seed=4)} % 5 AS fold FROM d GROUP BY u""",
)
def prepare_recordings(spark, sf):
    """Annotated recordings: two ids of one patient levelled, labels merged and supported, folds of whole patients."""
    from seqloom.operators import prepare
    from seqloom.operators.signal import chained

    alias, *steps = prepare.recipe("annotated recordings", aliased=("user_id", {3: 2}), merged_names=("symbols", prepare.merged(["error", "signup"])), supported=("user_id", "symbols", 5), folds_of_groups=("user_id", 5, 4))
    rows = chained(fx.ann(spark, sf), alias).groupBy("user_id").agg(F.collect_set("symbol").alias("symbols"))
    return chained(rows, steps).select("user_id", F.array_join(F.array_sort("kept"), ",").alias("labels"), "fold")


@query(
    "prepare_waves",
    f"""WITH RECURSIVE m AS (SELECT user_id, list(sample ORDER BY sample) AS p, list(CASE symbol WHEN 'click' THEN '(' WHEN 'purchase' THEN ')' ELSE symbol END ORDER BY sample) AS s FROM ann GROUP BY 1),
       w AS (SELECT user_id, p, s, 1 AS i, NULL::BIGINT AS start, NULL::BIGINT AS "end", NULL::VARCHAR AS kind FROM m
             UNION ALL
             SELECT user_id, p, s, i + CASE WHEN {_OPEN} AND s[i + 2] = ')' THEN 3 WHEN {_OPEN} THEN 2 WHEN {_PEAK} AND s[i + 1] = ')' THEN 2 ELSE 1 END,
                    CASE WHEN {_OPEN} OR {_PEAK} THEN p[i] END,
                    CASE WHEN {_OPEN} AND s[i + 2] = ')' THEN p[i + 2] WHEN {_OPEN} THEN p[i + 1] WHEN {_PEAK} AND s[i + 1] = ')' THEN p[i + 1] WHEN {_PEAK} THEN p[i] END,
                    CASE WHEN {_OPEN} THEN s[i + 1] WHEN {_PEAK} THEN s[i] END
             FROM w WHERE i <= len(p)),
       g AS (SELECT user_id, start, kind, lag(kind) OVER o AS a, lead(kind) OVER o AS b FROM w WHERE kind IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY start)),
       n AS (SELECT user_id, start, CASE WHEN kind = 'view' AND a = 'error' AND b = 'signup' THEN 'between' ELSE kind END AS kind FROM g),
       t AS (SELECT *, min(CASE WHEN kind <> 'view' THEN start END) OVER u AS lo, max(CASE WHEN kind <> 'view' THEN start END) OVER u AS hi FROM n WINDOW u AS (PARTITION BY user_id))
       SELECT user_id, kind, count(*) AS n FROM t WHERE start BETWEEN lo AND hi GROUP BY 1, 2""",
)
def prepare_waves(spark, sf):
    """Delineated recordings: waves from marks, gaps named by their neighbours, background cut off at the ends, and how many there
    are of each kind."""
    s = F.when(F.col("symbol") == "click", "(").when(F.col("symbol") == "purchase", ")").otherwise(F.col("symbol"))
    waves = delineate_(fx.ann(spark, sf).select("user_id", "sample", s.alias("symbol"))).select("user_id", "start", "kind")
    waves = materialize(waves, "waves")  # read for ranges, neighbours on both sides, and ends
    named = ops.gap_relabel(waves, "user_id", "start", "kind", "view", {("error", "signup"): "between"})
    return ops.edge_trim(named, "user_id", "start", "kind", "view").groupBy("user_id", "kind").agg(F.count("*").alias("n"))


@query(
    "prepare_loader",
    f"""WITH s AS (SELECT list_sort(list(l)) AS itos FROM (SELECT l FROM (SELECT unnest(tags) AS l FROM rec) GROUP BY 1 HAVING count(*) >= 45)),
       r AS (SELECT doc_id, n_chars, {draw_sql("doc_id", seed=6)} % 10 AS fold, list_transform(itos, lambda x: CASE WHEN list_contains(tags, x) THEN 1 ELSE 0 END) AS hot FROM rec, s)
       SELECT CASE WHEN fold < 8 THEN 'train' WHEN fold = 8 THEN 'valid' ELSE 'test' END AS part, i AS class, count(*) AS chunks, CAST(sum(hot[i + 1]) AS BIGINT) AS positive
       FROM (SELECT fold, hot, unnest(range(0, n_chars, 1000)) AS start FROM r), (SELECT unnest(range(0, len(itos))) AS i FROM s) GROUP BY 1, 2""",
)
def prepare_loader(spark, sf):
    """From records to what a loader serves: supported labels as a vector of zeros and ones, parts by fold (all but the last two, the
    one before the last, the last), and chunks of 1,000 positions, counted by part and class."""
    rows = ops.label_support(fx.rec(spark, sf), "doc_id", "tags", 45)
    hot = F.transform("itos", lambda x: F.array_contains("tags", x).cast("int"))
    fold = F.expr(draw_sql("doc_id", seed=6)) % 10
    part = F.when(fold < 8, "train").when(fold == 8, "valid").otherwise("test")
    chunks = sequences.stride_chunks(rows.select(part.alias("part"), "n_chars", hot.alias("hot")), "n_chars", 1000)
    each = chunks.select("part", F.posexplode("hot").alias("class", "x"))
    return each.groupBy("part", F.col("class").cast("long").alias("class")).agg(F.count("*").alias("chunks"), F.sum("x").alias("positive"))
