"""Command line over trace files: what they hold, what a loader serves, generation and its evaluation.

    python -m seqloom.cli stats PATH OUT
    python -m seqloom.cli vocabulary ROOT OUT [--name training]
    python -m seqloom.cli windows PATH OUT [--length 200] [--stride 1]
    python -m seqloom.cli batches PATH OUT [--size 32] [--epochs 1] [--seed 0] [--in-order]
    python -m seqloom.cli mask PATH OUT [--kind rm|mnr|bm] [--k 10] [--seed 1]
    python -m seqloom.cli generate REAL OUT [--samples 500] [--length 100] [--seed 0] [--weights FILE.npz] [--format text|npy]
    python -m seqloom.cli evaluate --generated PATH --real PATH --output OUT
    python -m seqloom.cli compare --generated PATH --real PATH --output OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.operators import sequences, series
from seqloom.operators.neural import TraceDenoiser, generate
from seqloom.operators.similarity import best_match
from seqloom.runtime import session, ship
from seqloom.sources import arrays, ranges, traces


def evaluate(generated, real):
    """One row: mean and deviation of the best accuracy and ROUGE-L, the share of generated rows that equal a real one, and the
    divergence of the histograms."""
    best = best_match(generated, real)
    exact = generated.join(real.select("seq").distinct().withColumn("hit", F.lit(1)), "seq", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("perfect_rate"))
    stats = [f(c).alias(f"{n}_{c}") for c in ("accuracy", "rouge_l") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]

    def share(rows, name):
        x = rows.select(F.explode("seq").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
        return x.crossJoin(F.broadcast(x.agg(F.sum("n").alias("all")))).select("x", (F.col("n") / F.col("all")).alias(name))  # one row with the sum

    kl = share(real, "p").join(share(generated, "q"), "x").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))
    return best.agg(*stats).crossJoin(exact).crossJoin(kl)  # one row each


def compare(generated, real):
    """One row on the values: how many sequences and values there are on either side, their range, and how many they share."""

    def side(rows, name):
        x = rows.select(F.explode("seq").alias("x"))
        return x.agg(F.count("*").alias(f"n_{name}"), F.count_distinct("x").alias(f"distinct_{name}"), F.min("x").alias(f"min_{name}"), F.max("x").alias(f"max_{name}"), F.avg("x").alias(f"mean_{name}"))

    both = generated.select(F.explode("seq").alias("x")).distinct().join(real.select(F.explode("seq").alias("x")).distinct(), "x")
    return side(generated, "generated").crossJoin(side(real, "real")).crossJoin(both.agg(F.count("*").alias("distinct_both")))  # one row each


def _numbered(rows):
    """(id, seq): numbers in the order of the sequences' texts, so that they do not depend on partitions; equal ones are numbered apart."""
    texts = rows.select("seq", F.array_join("seq", ",").alias("text")).withColumn("again", F.row_number().over(Window.partitionBy("text").orderBy(F.lit(0))))
    coarse = F.substring("text", 1, 6)
    return sequences.row_numbers(texts, ["text", "again"], coarse, "id").select((F.col("id") - 1).alias("id"), "seq")


def batches(rows, size: int, epochs: int, seed: int, in_order: bool):
    """(epoch, batch, slot, seq): each epoch has every sequence once, in an order of its own unless they are to stay in order."""
    own, out = _numbered(rows), None
    for epoch in range(epochs):
        if in_order:
            part = own.select(F.lit(epoch).alias("epoch"), F.floor(F.col("id") / size).alias("batch"), (F.col("id") % size).alias("slot"), "seq")
        else:
            part = series.shuffled_batches(own, ["id"], F.floor(F.col("id") / 10_000), size, seed * 10_007 + epoch).select(F.lit(epoch).alias("epoch"), "batch", "slot", "seq")
        out = part if out is None else out.unionByName(part)
    return out


def masked(rows, kind: str, k: int, seed: int):
    """(id, t, value, keep): k positions of each sequence are to be imputed: drawn one by one (rm), as one segment of each (mnr), or
    as the same segment of all (bm)."""
    tall = _numbered(rows).select(F.col("id").alias("vec_id"), F.size("seq").alias("n"), F.posexplode("seq").alias("t", "value")).withColumn("ch", F.lit(0))
    if kind == "rm":
        out = series.mask_random(tall, k, seed)
    else:
        which = series.draw(F.lit(0) if kind == "bm" else "vec_id", seed=seed) % F.ceil(F.col("n") / k)
        out = tall.withColumn("keep", (F.floor(F.col("t") / k) != which).cast("int"))
    return out.select(F.col("vec_id").alias("id"), "t", "value", "keep")


def _weights(spark, path: str | None) -> TraceDenoiser:
    if path is None:
        return TraceDenoiser.initial()
    return TraceDenoiser.load(bytes(spark.read.format("binaryFile").load(path).first().content))  # one file of a model's size


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="seqloom")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, /, *places: str, **options: object):
        p = sub.add_parser(name)
        for x in places:
            p.add_argument(x)
        for x, default in options.items():
            flag = f"--{x.replace('_', '-')}"
            if default is False:
                p.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                p.add_argument(flag, choices=default, default=default[0])
            elif default is None:
                p.add_argument(flag, default=None)
            elif default is str:
                p.add_argument(flag, required=True)
            else:
                p.add_argument(flag, type=type(default), default=default)

    command("stats", "path", "out")
    command("vocabulary", "root", "out", name="training")
    command("windows", "path", "out", length=200, stride=1)
    command("batches", "path", "out", size=32, epochs=1, seed=0, in_order=False)
    command("mask", "path", "out", kind=["rm", "mnr", "bm"], k=10, seed=1)
    command("generate", "real", "out", samples=500, length=100, seed=0, weights=None, format=["text", "npy"])
    command("evaluate", generated=str, real=str, output=str)
    command("compare", generated=str, real=str, output=str)
    args = parser.parse_args(argv)
    spark = session()
    ship(spark)
    read = lambda path: traces.scan(spark, path)
    if args.command == "stats":
        traces.write_stats(traces.require_rows(read(args.path), args.path), args.out)
    elif args.command == "vocabulary":
        traces.vocabulary_of(traces.scan_tree(spark, args.root, args.name)).write.mode("overwrite").json(args.out)
    elif args.command == "windows":
        traces.write_text(sequences.sliding_windows(traces.require_rows(read(args.path), args.path), args.length, args.stride), args.out)
    elif args.command == "batches":
        out = batches(traces.require_rows(read(args.path), args.path), args.size, args.epochs, args.seed, args.in_order)
        out.write.mode("overwrite").partitionBy("epoch").parquet(args.out)
    elif args.command == "mask":
        masked(traces.require_rows(read(args.path), args.path), args.kind, args.k, args.seed).write.mode("overwrite").parquet(args.out)
    elif args.command == "generate":
        ids = read(args.real).select(F.explode("seq").alias("id")).distinct().agg(F.array_sort(F.collect_list("id")).alias("ids"))
        made = generate(spark, args.samples, args.length, _weights(spark, args.weights), ids, args.seed)
        if args.format == "text":
            traces.write_text(made, args.out)
        else:
            ranges.register(spark)
            rows = made.select(F.lit("").alias("file"), F.col("sample").alias("row"), F.col("seq").cast("array<double>").alias("value"))
            rows.write.format("npy_ranges").mode("overwrite").save(args.out)
    else:
        what = evaluate if args.command == "evaluate" else compare
        arrays.write_json_report(what(read(args.generated), read(args.real)), args.output)


if __name__ == "__main__":
    main()
