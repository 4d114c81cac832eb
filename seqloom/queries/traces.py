"""Queries on event traces: scans, vocabularies, windows, scores, and what follows a generator."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import clip, denormalize, ids_text, lcs_length, lcs_masks, minmax, nearest, positional_accuracy, quantize, rouge_recall, six
from seqloom.operators import sequences
from seqloom.operators.series import LCG_A, LCG_B, LCG_M, shuffle_key
from seqloom.operators.series import shuffled_batches as shuffled
from seqloom.operators.similarity import best_match
from seqloom.plans import fixtures as fx

query = fx.Registry()


def six_sql(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _day() -> Column:
    return F.date_trunc("day", "ts")


@query("scan_traces", "SELECT user_id, array_to_string(list_transform(string_split(trim(line), ','), lambda x: trim(x))[1:20], ',') AS seq FROM trace_text WHERE trim(line) <> '' AND len(list_filter(string_split(trim(line), ','), lambda x: TRY_CAST(trim(x) AS INTEGER) IS NULL)) = 0 AND len(string_split(trim(line), ',')) >= 20")
def scan_traces(spark, sf):
    return sequences.parse_lenient(fx.trace_text(spark, sf), "line", 20).select("user_id", ids_text("seq").alias("seq"))


@query("batch_assign", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 32 AS batch FROM events")
def batch_assign(spark, sf):
    rows = sequences.row_numbers(fx.table(spark, sf, "events"), ["ts", "event_id"], _day())
    return rows.select("event_id", F.floor((F.col("rn") - 1) / 32).alias("batch"))


def _network_sql(x: str, seed: int) -> str:
    """(select list) of x sent through the four rounds, one subquery a round; a, b and n are columns."""
    mixed = lambda v, k: f"((({v} + {shuffle_key(seed, k)}) % {LCG_M}) * (({v} + {shuffle_key(seed, k)}) % {LCG_M}) % {LCG_M} * {LCG_A} + {LCG_B}) % {LCG_M}"
    out = f"(SELECT event_id, n, a, b, {x} % a AS l, {x} // a AS r FROM {{}})"
    for k in range(4):
        side = f"(l + {mixed('r', k)}) % a AS l, r" if k % 2 == 0 else f"l, (r + {mixed('l', k)}) % b AS r"
        out = f"(SELECT event_id, n, a, b, {side} FROM {out})"
    return f"SELECT event_id, n, a, b, r * a + l AS x FROM {out}"


def _shuffle_sql(seed: int, size: int) -> str:
    sized = "(SELECT *, CAST(ceil(n / a::DOUBLE) AS BIGINT) AS b FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a FROM events))"
    again = _network_sql("x", seed).format("(SELECT * FROM w WHERE x >= n)")
    return f"WITH RECURSIVE w AS ({_network_sql('i', seed).format(sized)} UNION ALL {again}) SELECT event_id, x // {size} AS batch, x % {size} AS slot FROM w WHERE x < n"


@query("shuffled_batches", _shuffle_sql(7, 32))
def shuffled_batches(spark, sf):
    """Events in an order drawn for an epoch, in batches of 32."""
    return shuffled(fx.table(spark, sf, "events"), ["ts", "event_id"], _day(), 32, seed=7).select("event_id", "batch", "slot")


@query("trace_to_text", "SELECT user_id, array_to_string(seq, ',') AS line FROM trace")
def trace_to_text(spark, sf):
    return fx.trace(spark, sf).select("user_id", ids_text("seq").alias("line"))


@query("prefix_truncate", "SELECT user_id, array_to_string(seq[1:50], ',') AS seq FROM trace WHERE len(seq) >= 50")
def prefix_truncate(spark, sf):
    return sequences.prefix_truncate(fx.trace(spark, sf), 50).select("user_id", ids_text("seq").alias("seq"))


@query("event_histogram", "SELECT event_type, count(*) AS cnt FROM events GROUP BY 1")
def event_histogram(spark, sf):
    return fx.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("cnt"))


@query("event_frequency", "SELECT event_type, round(100.0 * cnt / sum(cnt) OVER (), 6) AS pct FROM (SELECT event_type, count(*)::DOUBLE AS cnt FROM events GROUP BY 1)")
def event_frequency(spark, sf):
    counts = event_histogram(spark, sf)
    return counts.select("event_type", six(100.0 * F.col("cnt") / F.sum("cnt").over(Window.partitionBy())).alias("pct"))


@query("length_stats", "SELECT min(n) AS min_len, max(n) AS max_len, round(avg(n), 6) AS mean_len, round(stddev_pop(n), 6) AS std_len, CAST(sum(n) AS BIGINT) AS total, min(lo) AS min_id, max(hi) AS max_id FROM (SELECT user_id, count(*) AS n, min(id) AS lo, max(id) AS hi FROM ev GROUP BY 1)")
def length_stats(spark, sf):
    per = fx.trace(spark, sf).select(F.size("seq").cast("long").alias("n"), F.array_min("seq").alias("lo"), F.array_max("seq").alias("hi"))
    return per.agg(F.min("n").alias("min_len"), F.max("n").alias("max_len"), six(F.avg("n")).alias("mean_len"), six(F.stddev_pop("n")).alias("std_len"), F.sum("n").alias("total"), F.min("lo").alias("min_id"), F.max("hi").alias("max_id"))


@query("distinct_events", "SELECT count(DISTINCT id) AS n_distinct, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM ev")
def distinct_events(spark, sf):
    ids = fx.ev(spark, sf).select("id").distinct()
    return ids.agg(F.count("*").alias("n_distinct"), ids_text(F.array_sort(F.collect_list("id"))).alias("ids"))


@query("event_vocabulary", "SELECT event_type, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS INTEGER) AS id FROM events GROUP BY 1")
def event_vocabulary(spark, sf):
    return sequences.vocabulary(fx.table(spark, sf, "events"), "event_type")


@query("vocab_inverse", "SELECT id, event_type, count(*) OVER () AS size FROM (SELECT event_type, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS INTEGER) AS id FROM events GROUP BY 1)")
def vocab_inverse(spark, sf):
    return event_vocabulary(spark, sf).select("id", "event_type", F.count("*").over(Window.partitionBy()).alias("size"))


@query("encode_traces", "SELECT user_id, array_to_string(list(id - 1 ORDER BY pos), ',') AS seq FROM ev GROUP BY 1")
def encode_traces(spark, sf):
    raw = sequences.collect_traces(fx.table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])
    return sequences.encode(raw, event_vocabulary(spark, sf), "event_type").select("user_id", ids_text("seq").alias("seq"))


@query("top_events", "SELECT event_type, count(*) AS cnt FROM events GROUP BY 1 ORDER BY cnt DESC, event_type LIMIT 10")
def top_events(spark, sf):
    return event_histogram(spark, sf).orderBy(F.desc("cnt"), "event_type").limit(10)


@query("preview", "SELECT user_id, array_to_string(seq[1:20], ',') AS head FROM trace ORDER BY user_id LIMIT 3")
def preview(spark, sf):
    return fx.trace(spark, sf).orderBy("user_id").limit(3).select("user_id", ids_text(F.slice("seq", 1, 20)).alias("head"))


@query("batch_plan", "SELECT user_id, b AS batch, least(32, n - b * 32) AS size FROM (SELECT user_id, n, unnest(range(0, (n + 31) // 32)) AS b FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1))")
def batch_plan(spark, sf):
    """As many samples as each user has events, in batches of 32 of which the last is cut to the number."""
    n = fx.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = n.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 32) - 1)))
    return rows.select("user_id", "batch", F.least(F.lit(32).cast("long"), F.col("n") - F.col("batch") * 32).alias("size"))


@query("sliding_windows", "SELECT user_id, st, array_to_string(seq, ',') AS seq FROM win")
def sliding_windows(spark, sf):
    return fx.win(spark, sf).select("user_id", "st", ids_text("seq").alias("seq"))


@query(
    "stride_chunks",
    """SELECT user_id, st AS start, least(st + 16, n) AS "end", copy FROM
       (SELECT user_id, n, unnest(range(0, n, 12)) AS st FROM (SELECT user_id, len(seq)::BIGINT AS n FROM trace)), (SELECT CAST(c AS INTEGER) AS copy FROM range(0, 2) AS r(c))
       WHERE least(st + 16, n) - st >= 8""",
)
def stride_chunks(spark, sf):
    sized = fx.trace(spark, sf).select("user_id", F.size("seq").alias("n"))
    return sequences.stride_chunks(sized, "n", 16, stride=12, least=8, copies=1).select("user_id", "start", "end", "copy")


@query("chunk_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS chunk FROM events")
def chunk_number(spark, sf):
    return fx.ev(spark, sf).select("event_id", (F.col("pos") - 1).alias("chunk"))


@query("batch_bounds", "SELECT b, b * (n // k) + least(b, n % k) AS lo, (b + 1) * (n // k) + least(b + 1, n % k) AS hi FROM (SELECT count(*) AS n, count(*) // 1000 + 1 AS k FROM events), LATERAL (SELECT unnest(range(0, k)) AS b)")
def batch_bounds(spark, sf):
    n = fx.table(spark, sf, "events").agg(F.count("*").alias("n")).withColumn("k", F.floor(F.col("n") / 1000) + 1)
    rows = n.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    bound = lambda b: b * F.floor(F.col("n") / F.col("k")) + F.least(b, F.col("n") % F.col("k"))
    return rows.select("b", bound(F.col("b")).alias("lo"), bound(F.col("b") + 1).alias("hi"))


_NEXT = "(SELECT user_id, st, seq AS a, lead(seq) OVER (PARTITION BY user_id ORDER BY st) AS b FROM win)"


def _pairs(spark, sf):
    """Each window with the user's next one."""
    return fx.win(spark, sf).select("user_id", "st", F.col("seq").alias("a"), F.lead("seq").over(Window.partitionBy("user_id").orderBy("st")).alias("b")).where("b IS NOT NULL")


def _with_lcs(spark, sf):
    return _pairs(spark, sf).withColumn("_m", lcs_masks(F.col("a"))).withColumn("lcs", lcs_length(F.col("_m"), F.size("a"), F.col("b")))


_SQL_MASK = "list_transform(range(1, 6), lambda v: CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda p: CASE WHEN {a}[p] = v THEN (1::BIGINT << (p - 1)) ELSE 0 END)) AS BIGINT))"
_SQL_LCS = "CAST(20 - bit_count(list_reduce({b}, lambda v, c: CAST(((v + (v & {m}[c])) | (v - (v & {m}[c]))) & 1048575 AS BIGINT), CAST(1048575 AS BIGINT))) AS BIGINT)"
_LCS_SQL = f"SELECT user_id, st, a, b, {_SQL_LCS.format(b='list_transform(b, lambda x: x::BIGINT)', m='m')} AS lcs FROM (SELECT *, {_SQL_MASK.format(a='a')} AS m FROM {_NEXT} WHERE b IS NOT NULL)"


@query("lcs_length", f"SELECT user_id, st, lcs FROM ({_LCS_SQL})")
def lcs_length_(spark, sf):
    return _with_lcs(spark, sf).select("user_id", "st", "lcs")


@query("rouge_l", f"SELECT user_id, st, round(lcs / 20.0::DOUBLE, 6) AS rouge_l FROM ({_LCS_SQL})")
def rouge_l(spark, sf):
    return _with_lcs(spark, sf).select("user_id", "st", six(rouge_recall(F.col("lcs"), F.col("a"), F.col("b"))).alias("rouge_l"))


@query("accuracy", f"SELECT user_id, st, round(len(list_filter(range(1, 21), lambda i: a[i] = b[i])) / 20.0::DOUBLE, 6) AS accuracy FROM {_NEXT} WHERE b IS NOT NULL")
def accuracy(spark, sf):
    return _pairs(spark, sf).select("user_id", "st", six(positional_accuracy(F.col("a"), F.col("b"))).alias("accuracy"))


@query("positional_match", f"SELECT user_id, st, CAST(len(list_filter(range(1, 21), lambda i: a[i] = b[i])) AS BIGINT) AS hits FROM {_NEXT} WHERE b IS NOT NULL")
def positional_match(spark, sf):
    hits = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda ok: ok))
    return _pairs(spark, sf).select("user_id", "st", hits.cast("long").alias("hits"))


@query("perfect_rate", f"SELECT round(avg(CAST(a = b AS INTEGER)), 6) AS perfect_rate FROM {_NEXT} WHERE b IS NOT NULL")
def perfect_rate(spark, sf):
    return _pairs(spark, sf).agg(six(F.avg((F.col("a") == F.col("b")).cast("int"))).alias("perfect_rate"))


_BEST = f"""
    pair AS (SELECT g.seq AS g, r.seq AS r FROM (SELECT DISTINCT seq FROM gen) g, (SELECT DISTINCT seq FROM real) r),
    mask AS (SELECT r, {_SQL_MASK.format(a="r")} AS m FROM (SELECT DISTINCT r FROM pair)),
    scored AS (
        SELECT g, max(len(list_filter(range(1, 21), lambda i: g[i] = r[i])) / 20.0::DOUBLE) AS accuracy,
               max({_SQL_LCS.format(b="list_transform(g, lambda x: x::BIGINT)", m="m")} / 20.0::DOUBLE) AS rouge_l
        FROM pair JOIN mask USING (r) GROUP BY g),
    best AS (SELECT user_id, st, coalesce(accuracy, 0.0) AS accuracy, coalesce(rouge_l, 0.0) AS rouge_l FROM gen LEFT JOIN scored ON scored.g = gen.seq)
"""


@query("best_match", f"WITH {_BEST} SELECT user_id, st, round(accuracy, 6) AS accuracy, round(rouge_l, 6) AS rouge_l FROM best")
def best_match_(spark, sf):
    return best_match(fx.gen(spark, sf), fx.real(spark, sf)).select("user_id", "st", six(F.col("accuracy")).alias("accuracy"), six(F.col("rouge_l")).alias("rouge_l"))


_LONG_BITS = (1 << fx.LONG) - 1


@query(
    "best_match_long",
    f"""WITH g AS (SELECT DISTINCT seq FROM long_win WHERE team % 2 = 1),
       r AS (SELECT seq, list_transform(range(1, 6), lambda v: CAST(list_sum(list_transform(range(1, {fx.LONG + 1}), lambda p: CASE WHEN seq[p] = v THEN (1::HUGEINT << (p - 1)::HUGEINT) ELSE 0::HUGEINT END)) AS HUGEINT)) AS m
             FROM (SELECT DISTINCT seq FROM long_win WHERE team % 2 = 0)),
       scored AS (
           SELECT g.seq, max(len(list_filter(range(1, {fx.LONG + 1}), lambda i: g.seq[i] = r.seq[i])) / {fx.LONG}.0::DOUBLE) AS accuracy,
                  max(({fx.LONG} - bit_count(list_reduce(list_transform(g.seq, lambda x: x::HUGEINT), lambda v, c: ((v + (v & m[c::BIGINT])) | (v - (v & m[c::BIGINT]))) & {_LONG_BITS}::HUGEINT, {_LONG_BITS}::HUGEINT))) / {fx.LONG}.0::DOUBLE) AS rouge_l
           FROM g, r GROUP BY 1)
       SELECT team, st, {six_sql('coalesce(accuracy, 0.0)')} AS accuracy, {six_sql('coalesce(rouge_l, 0.0)')} AS rouge_l FROM long_win LEFT JOIN scored USING (seq) WHERE team % 2 = 1""",
)
def best_match_long(spark, sf):
    """Windows of 100 events, longer than a word of bits: those of odd teams against those of even ones."""
    rows = fx.long_win(spark, sf)
    best = best_match(rows.where("team % 2 = 1"), rows.where("team % 2 = 0"))
    return best.select("team", "st", six(F.col("accuracy")).alias("accuracy"), six(F.col("rouge_l")).alias("rouge_l"))


_SIMILARITY = "round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy, round(avg(rouge_l), 6) AS mean_rouge, round(stddev_pop(rouge_l), 6) AS std_rouge, count(*) AS n"


@query("eval_similarity", f"WITH {_BEST} SELECT {_SIMILARITY} FROM best")
def eval_similarity(spark, sf):
    best = best_match(fx.gen(spark, sf), fx.real(spark, sf))
    stats = [six(f(c)).alias(f"{n}_{s}") for c, s in (("accuracy", "accuracy"), ("rouge_l", "rouge")) for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return best.agg(*stats, F.count("*").alias("n"))


_DISTRIBUTION = """
    gh AS (SELECT x, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM (SELECT unnest(seq) AS x FROM gen) GROUP BY x),
    rh AS (SELECT x, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM (SELECT unnest(seq) AS x FROM real) GROUP BY x),
    dist AS (SELECT round((SELECT sum(p * ln(p / q)) FROM rh JOIN gh USING (x)), 6) + 0.0 AS kl, (SELECT count(*) FROM gh) AS unique_gen, (SELECT count(*) FROM rh) AS unique_real,
             round((SELECT avg(len(seq)) FROM gen), 6) AS mean_len_gen, round((SELECT avg(len(seq)) FROM real), 6) AS mean_len_real)
"""


def _histogram(windows, name: str):
    counts = windows.select(F.explode("seq").alias("x")).groupBy("x").agg(F.count("*").alias("_n"))
    return counts.select("x", (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias(name))


@query("eval_distribution", f"WITH {_DISTRIBUTION} SELECT * FROM dist")
def eval_distribution(spark, sf):
    """Divergence of the generated from the real histogram over events that both have, unique counts and mean lengths."""
    gen, real = fx.gen(spark, sf), fx.real(spark, sf)
    p, q = _histogram(real, "p"), _histogram(gen, "q")
    kl = p.join(q, "x").agg(six(F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))).alias("kl"))
    counts = q.agg(F.count("*").alias("unique_gen")).crossJoin(p.agg(F.count("*").alias("unique_real")))  # one row each
    lengths = gen.agg(six(F.avg(F.size("seq"))).alias("mean_len_gen")).crossJoin(real.agg(six(F.avg(F.size("seq"))).alias("mean_len_real")))
    return kl.crossJoin(counts).crossJoin(lengths)


@query("eval_report", f"WITH {_BEST}, {_DISTRIBUTION} SELECT * FROM (SELECT {_SIMILARITY} FROM best), dist")
def eval_report(spark, sf):
    return eval_similarity(spark, sf).crossJoin(eval_distribution(spark, sf))  # one row each


@query("generated_summary", "SELECT min(x) AS lo, max(x) AS hi, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(DISTINCT x) AS n_unique FROM (SELECT unnest(seq) AS x FROM gen)")
def generated_summary(spark, sf):
    x = fx.gen(spark, sf).select(F.explode("seq").alias("x"))
    return x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), six(F.avg("x")).alias("mean"), six(F.stddev_pop("x")).alias("std"), F.count_distinct("x").alias("n_unique"))


@query("vocab_overlap", "SELECT count(*) AS n_both FROM (SELECT unnest(seq) AS x FROM gen INTERSECT SELECT unnest(seq) FROM real)")
def vocab_overlap(spark, sf):
    each = [w.select(F.explode("seq").alias("x")).distinct() for w in (fx.gen(spark, sf), fx.real(spark, sf))]
    return each[0].intersect(each[1]).agg(F.count("*").alias("n_both"))


@query("vocab_union", "SELECT unnest(seq) AS x FROM gen UNION SELECT unnest(seq) FROM real")
def vocab_union(spark, sf):
    each = [w.select(F.explode("seq").alias("x")).distinct() for w in (fx.gen(spark, sf), fx.real(spark, sf))]
    return each[0].union(each[1]).distinct()


def _range(df, c: str):
    """One row with the least and greatest value."""
    return df.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))


@query("minmax_normalize", "SELECT user_id, pos, round((id - lo)::DOUBLE / (hi - lo), 6) AS x FROM ev, (SELECT min(id) AS lo, max(id) AS hi FROM ev) s")
def minmax_normalize(spark, sf):
    ev = fx.ev(spark, sf)
    return ev.crossJoin(F.broadcast(_range(ev, "id"))).select("user_id", "pos", six(minmax(F.col("id"), F.col("lo"), F.col("hi"))).alias("x"))  # one row of statistics


@query("minmax_denormalize", "SELECT event_id, round(CASE WHEN hi > lo THEN value * (hi - lo) + lo ELSE value END, 6) + 0.0 AS x FROM ev, (SELECT min(id)::DOUBLE AS lo, max(id)::DOUBLE AS hi FROM ev) s")
def minmax_denormalize(spark, sf):
    ev = fx.ev(spark, sf)
    return ev.crossJoin(F.broadcast(_range(ev, "id"))).select("event_id", six(denormalize(F.col("value"), F.col("lo"), F.col("hi"))).alias("x"))


@query("quantize", "SELECT user_id, pos, CAST(round_even(x, 0) AS INTEGER) AS q FROM noisy")
def quantize_(spark, sf):
    return fx.noisy(spark, sf).select("user_id", "pos", quantize(F.col("x")).alias("q"))


@query("clip_range", "SELECT user_id, pos, greatest(least(CAST(round_even(x, 0) AS INTEGER), 5), 1) AS q FROM noisy")
def clip_range(spark, sf):
    return fx.noisy(spark, sf).select("user_id", "pos", clip(quantize(F.col("x")), F.lit(1), F.lit(5)).alias("q"))


def _vocabulary_array(spark, sf, keep: Column | None = None):
    """One row with the sorted ids."""
    v = fx.vocab(spark, sf)
    return (v if keep is None else v.where(keep)).agg(F.array_sort(F.collect_list("id")).alias("ids"))


@query("nearest_vocab", "SELECT user_id, pos, arg_min(id, (abs(id - x), id)) AS id FROM noisy, (SELECT id FROM vocab WHERE id <> 3) v GROUP BY user_id, pos")
def nearest_vocab(spark, sf):
    ids = _vocabulary_array(spark, sf, F.col("id") != 3)
    return fx.noisy(spark, sf).crossJoin(F.broadcast(ids)).select("user_id", "pos", nearest(F.col("x"), F.col("ids")).alias("id"))  # one row of ids


@query(
    "constrain_generated",
    """SELECT user_id, pos, arg_min(id, (abs(id - q), id)) AS id FROM
       (SELECT user_id, pos, greatest(least(CAST(round_even(u * (hi - lo) + lo, 0) AS INTEGER), hi), lo) AS q
        FROM (SELECT user_id, pos, value / 100.0 AS u FROM ev), (SELECT min(id) AS lo, max(id) AS hi FROM ev) s), (SELECT id FROM vocab WHERE id <> 3) v
       GROUP BY user_id, pos""",
)
def constrain_generated(spark, sf):
    """What follows a generator: back to the scale of ids, rounded, clipped, and to the nearest id in use."""
    ev = fx.ev(spark, sf)
    one = _range(ev, "id").crossJoin(_vocabulary_array(spark, sf, F.col("id") != 3))  # one row each
    lo, hi = F.col("lo"), F.col("hi")
    q = clip(quantize(denormalize(F.col("value") / 100.0, lo, hi)), lo.cast("int"), hi.cast("int"))
    return ev.crossJoin(F.broadcast(one)).select("user_id", "pos", nearest(q, F.col("ids")).alias("id"))


@query("stable_desc", "SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id DESC) AS rank FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)")
def stable_desc(spark, sf):
    counts = fx.table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    # Ranges of counts: a value of `n` comes in ranges of users, so that neither a type nor a frequent count is one task.
    coarse = F.struct(-F.col("n"), -F.floor(F.col("user_id") / 10_000))
    return sequences.row_numbers(counts, [F.desc("n"), F.desc("user_id")], coarse, "rank", by=["event_type"]).select("event_type", "user_id", "rank")


@query("longest_length", "SELECT user_id, coalesce(max(n) FILTER (WHERE n = 60), max(n)) AS n FROM (SELECT user_id, len(seq)::BIGINT // k AS n FROM trace, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY 1")
def longest_length(spark, sf):
    """The wanted length (60) if it is there, else the longest."""
    n = fx.trace(spark, sf).select("user_id", F.explode(F.array(*[F.floor(F.size("seq") / k) for k in (1, 2, 3)])).alias("n"))
    return n.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("n") == 60, F.col("n"))), F.max("n")).alias("n"))


@query("concat_remap", "SELECT part, id, CAST(dense_rank() OVER (ORDER BY part, id) - 1 AS BIGINT) AS new_id FROM (SELECT 0 AS part, o_orderkey AS id FROM orders UNION ALL SELECT 1, c_custkey FROM customer)")
def concat_remap(spark, sf):
    """Two id spaces as one contiguous one: each keeps its order, the second follows the first."""
    parts = [fx.table(spark, sf, t).select(F.lit(i).alias("part"), F.col(c).alias("id")) for i, (t, c) in enumerate((("orders", "o_orderkey"), ("customer", "c_custkey")))]
    both = parts[0].unionByName(parts[1]).distinct()
    coarse = F.struct("part", F.floor(F.col("id") / 10_000).alias("k"))
    return sequences.row_numbers(both, ["part", "id"], coarse).select("part", "id", (F.col("rn") - 1).alias("new_id"))


@query("reindex_records", "SELECT o_orderkey AS data_original, row_number() OVER (ORDER BY o_orderkey) - 1 AS data FROM orders")
def reindex_records(spark, sf):
    rows = sequences.row_numbers(fx.table(spark, sf, "orders"), ["o_orderkey"], F.floor(F.col("o_orderkey") / 10_000))
    return rows.select(F.col("o_orderkey").alias("data_original"), (F.col("rn") - 1).alias("data"))


@query("best_checkpoint", "SELECT t, round(y, 6) AS loss, round(min(y) OVER (ORDER BY t), 6) AS best, y <= min(y) OVER (ORDER BY t) AS is_best FROM daily")
def best_checkpoint(spark, sf):
    best = F.min("y").over(Window.orderBy("t"))
    return fx.daily(spark, sf).select("t", six(F.col("y")).alias("loss"), six(best).alias("best"), (F.col("y") <= best).alias("is_best"))


@query("max_checkpoint", "SELECT coalesce(max(TRY_CAST(regexp_extract(name, '^(.+)\\.pkl$', 1) AS INTEGER)), -1) AS n FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 'best.pkl' WHEN user_id % 3 = 1 THEN user_id || '.pkl' ELSE user_id || '.txt' END AS name FROM events)")
def max_checkpoint(spark, sf):
    u = F.col("user_id").cast("string")
    name = F.when(F.col("user_id") % 3 == 0, "best.pkl").when(F.col("user_id") % 3 == 1, F.concat(u, F.lit(".pkl"))).otherwise(F.concat(u, F.lit(".txt")))
    n = F.regexp_extract(name, r"^(.+)\.pkl$", 1).try_cast("int")
    return fx.table(spark, sf, "events").agg(F.coalesce(F.max(n), F.lit(-1)).alias("n"))


@query("parse_record_name", "SELECT user_id, event_id, TRY_CAST(regexp_extract(name, '^.{4}([0-9]+)_N([0-9]+)$', 1) AS BIGINT) AS exam, TRY_CAST(regexp_extract(name, '^.{4}([0-9]+)_N([0-9]+)$', 2) AS BIGINT) AS record FROM (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'broken' ELSE 'TNMG' || user_id || '_N' || event_id END AS name FROM events) WHERE regexp_matches(name, '^.{4}([0-9]+)_N([0-9]+)$')")
def parse_record_name(spark, sf):
    name = F.when(F.col("event_id") % 7 == 0, "broken").otherwise(F.concat(F.lit("TNMG"), F.col("user_id").cast("string"), F.lit("_N"), F.col("event_id").cast("string")))
    pattern = "^.{4}([0-9]+)_N([0-9]+)$"
    rows = fx.table(spark, sf, "events").withColumn("_name", name).where(F.col("_name").rlike(pattern))
    return rows.select("user_id", "event_id", *[F.regexp_extract("_name", pattern, i).try_cast("long").alias(n) for i, n in ((1, "exam"), (2, "record"))])


@query("experiment_names", "SELECT user_id, 'T' || n || '_beta0' || '0.0001' || '_betaT' || CASE WHEN n % 2 = 0 THEN '0.02' ELSE '0.5' END AS name FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def experiment_names(spark, sf):
    """The name of an experiment with as many steps as the user has events."""
    n = fx.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    last = F.when(F.col("n") % 2 == 0, "0.02").otherwise("0.5")
    return n.select("user_id", F.format_string("T%d_beta0%s_betaT%s", F.col("n"), F.lit("0.0001"), last).alias("name"))
