"""Canonical relations: driver tables reshaped into the data model, once as DataFrames and once as SQL for the oracle.

Each relation has a builder (spark, sf_dir) -> DataFrame and a SQL text over the registered tables and other relations. `with_`
puts the relations that a query uses, and those that they use, before its body.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators import sequences

LENGTH, STRIDE = 20, 5
LONG, LONG_STRIDE = 100, 20
STEPS, CHANNELS = 16, 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    """(event_type, id): ids from 1 by falling count, then name."""
    return sequences.vocabulary(table(spark, sf, "events"), "event_type", base=1)


def ev(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their id and position (from 1) in the user's trace."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf, "events").join(vocab(spark, sf), "event_type").withColumn("pos", pos)


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, seq): ids of a user's events in order."""
    events = table(spark, sf, "events").join(vocab(spark, sf), "event_type")
    return sequences.collect_traces(events, "user_id", "id", ["ts", "event_id"])


def trace_text(spark: SparkSession, sf: str) -> DataFrame:
    """Traces as text lines, some with a token that is no number and some blank."""
    line = F.array_join("seq", ",")
    bad = F.when(F.col("user_id") % 19 == 0, "").when(F.col("user_id") % 17 == 0, F.concat(line, F.lit(",x"))).otherwise(line)
    return trace(spark, sf).select("user_id", bad.alias("line"))


def win(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of LENGTH ids every STRIDE positions."""
    return sequences.sliding_windows(trace(spark, sf), LENGTH, STRIDE)


def long_win(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of LONG ids every LONG_STRIDE positions, of the events of ten users together."""
    events = table(spark, sf, "events").join(vocab(spark, sf), "event_type").withColumn("team", F.floor(F.col("user_id") / 10))
    return sequences.sliding_windows(sequences.collect_traces(events, "team", "id", ["ts", "event_id"]), LONG, LONG_STRIDE)


def gen(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that stand for generated sequences (odd users)."""
    return win(spark, sf).where(F.col("user_id") % 2 == 1)


def real(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that stand for real sequences (even users)."""
    return win(spark, sf).where(F.col("user_id") % 2 == 0)


def noisy(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, pos, x): ids with a deterministic disturbance, as a generator would give."""
    return ev(spark, sf).select("user_id", "pos", (F.col("id") + F.col("value") / 100.0 - 1.0).alias("x"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, t, ch, value): embeddings as series of four channels."""
    tall = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return tall.select("vec_id", F.floor(F.col("i") / CHANNELS).alias("t"), (F.col("i") % CHANNELS).cast("long").alias("ch"), F.col("v").cast("double").alias("value"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Five pseudo-samples of each series."""
    five = series(spark, sf).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return five.select("vec_id", "t", "ch", "s", _sample(F.col("value"), F.col("s")).alias("value"))


def _sample(value: Column, s: Column) -> Column:
    return value * (1 + 0.05 * (s - 2))


def sampled(spark: SparkSession, sf: str, more: Callable[[Column], list[Column]] = lambda v: []) -> DataFrame:
    """(vec_id, t, ch, value, samples) of what is to be imputed: each value, and in order the five pseudo-samples of all values of its
    place that are not null, with `more` of each. Whole vectors are brought together by their key; places and samples are made
    where they are, so nothing as long as the table of samples is shuffled or sorted."""
    own = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") > 0)
    own = own.groupBy("vec_id").agg(F.collect_list("v").alias("own"), F.max(F.size("v")).alias("n"))
    places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.transform(F.filter("own", lambda v: F.size(v) > i), lambda v: F.get(v, i)))
    tall = own.select("vec_id", F.posexplode(places).alias("i", "values"))
    tall = tall.select("vec_id", F.floor(F.col("i") / CHANNELS).alias("t"), (F.col("i") % CHANNELS).cast("long").alias("ch"), "values").where(keep_expression() == 0)
    each = F.transform(F.filter("values", lambda v: v.isNotNull()), lambda v: F.array(*[_sample(v, F.lit(s).cast("long")) for s in range(5)], *more(v)))
    return tall.select("vec_id", "t", "ch", "values", F.array_sort(F.flatten(each)).alias("samples")).select("vec_id", "t", "ch", F.explode("values").alias("value"), "samples")


def keep_expression() -> Column:
    """A deterministic mask over (vec_id, t, ch): 1 keeps, 0 is to be imputed."""
    h = F.col("vec_id") * 7919 + F.col("ch") * 104729 + F.col("t") * 31
    return (((h % 97) % 10) >= 3).cast("int")


def mask(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, t, ch, keep)."""
    return series(spark, sf).select("vec_id", "t", "ch", keep_expression().alias("keep"))


def masked(spark: SparkSession, sf: str) -> DataFrame:
    """Series with their mask."""
    return series(spark, sf).withColumn("keep", keep_expression())


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(t, d, y): revenue by ship date, t from 1."""
    by_day = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("timestamp_ntz").alias("d")).agg(F.sum("l_extendedprice").alias("y"))
    return by_day.select(F.row_number().over(Window.orderBy("d")).cast("long").alias("t"), "d", "y")


def ann(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, sample, symbol): events as change points by hours since 2024-01-01, the last of each hour."""
    hours = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 3600).alias("sample")
    own = table(spark, sf, "events").select("user_id", hours, F.struct("ts", "event_id", "event_type").alias("_e"))
    return own.groupBy("user_id", "sample").agg(F.max("_e")["event_type"].alias("symbol"))


def rec(spark: SparkSession, sf: str) -> DataFrame:
    """Records with a group, labels and optional flags."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    both = docs.join(labels, "doc_id", "left")
    tags = F.array_compact(F.array("lang", "source", F.when(F.col("toxic") == 1, "toxic")))
    return both.select("doc_id", F.col("source").alias("group_id"), "lang", "n_chars", tags.alias("tags"), "quality", "toxic")


def sched(spark: SparkSession, sf: str, steps: int = 200) -> DataFrame:
    """(t, beta): a linear noise schedule."""
    return spark.range(steps).select(F.col("id").alias("t"), (F.lit(1e-4) + F.col("id") * F.lit((0.02 - 1e-4) / (steps - 1))).alias("beta"))


def eps_expression() -> Column:
    """Injected deterministic noise over (vec_id, t)."""
    return F.sin(F.col("vec_id") * 12.9898 + F.col("t") * 78.233)


SQL: dict[str, str] = {
    "vocab": "SELECT event_type, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS id FROM events GROUP BY event_type",
    "ev": "SELECT e.*, id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events e JOIN vocab USING (event_type)",
    "trace": "SELECT user_id, list(id ORDER BY pos) AS seq FROM ev GROUP BY user_id",
    "trace_text": "SELECT user_id, CASE WHEN user_id % 19 = 0 THEN '' WHEN user_id % 17 = 0 THEN array_to_string(seq, ',') || ',x' ELSE array_to_string(seq, ',') END AS line FROM trace",
    "win": f"SELECT user_id, st, seq[st + 1 : st + {LENGTH}] AS seq FROM (SELECT user_id, seq, unnest(range(0, len(seq) - {LENGTH} + 1, {STRIDE})) AS st FROM trace WHERE len(seq) >= {LENGTH})",
    "long_win": f"SELECT team, st, seq[st + 1 : st + {LONG}] AS seq FROM (SELECT team, seq, unnest(range(0, len(seq) - {LONG} + 1, {LONG_STRIDE})) AS st FROM (SELECT user_id // 10 AS team, list(id ORDER BY ts, event_id) AS seq FROM ev GROUP BY 1) WHERE len(seq) >= {LONG})",
    "gen": "SELECT * FROM win WHERE user_id % 2 = 1",
    "real": "SELECT * FROM win WHERE user_id % 2 = 0",
    "noisy": "SELECT user_id, pos, id + value / 100.0 - 1.0 AS x FROM ev",
    "series": f"SELECT vec_id, (i - 1) // {CHANNELS} AS t, (i - 1) % {CHANNELS} AS ch, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "samples": "SELECT vec_id, t, ch, s, value * (1 + 0.05::DOUBLE * (s - 2)) AS value FROM series, range(0, 5) AS r(s)",
    "masked": "SELECT *, CAST((((vec_id * 7919 + ch * 104729 + t * 31) % 97) % 10) >= 3 AS INTEGER) AS keep FROM series",
    "daily": "SELECT row_number() OVER (ORDER BY d) AS t, d, y FROM (SELECT l_shipdate AS d, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1)",
    "ann": "SELECT user_id, sample, arg_max(event_type, (ts, event_id)) AS symbol FROM (SELECT *, CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS sample FROM events) GROUP BY 1, 2",
    "rec": "SELECT doc_id, source AS group_id, lang, n_chars, list_filter([lang, source, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "sched": "SELECT t, 1e-4::DOUBLE + t * ((0.02::DOUBLE - 1e-4::DOUBLE) / 199) AS beta FROM range(0, 200) AS r(t)",
    "alpha": "SELECT t, beta, 1 - beta AS alpha, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_bar FROM sched",
}


def with_(body: str, recursive: bool = False) -> str:
    """The body with the relations that it names in front."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(SQL[name])
                if name not in need:
                    need.append(name)

    visit(body)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    if own:
        recursive = recursive or bool(own[1])
        body = body[own.end() :]
        return f"WITH {'RECURSIVE ' * recursive}{head}{', ' * bool(head)}{body}"
    return f"WITH {head} {body}" if head else body


Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL, put in by decorators."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = with_(sql)
            return f

        return put
