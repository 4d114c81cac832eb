"""N-gram Jaccard self-join by vertical partitioning.

All n-grams (word shingles) have one global order: by how often their hash bucket occurs, rare first, then by hash. The order is
cut into FRAGMENTS at equal shares of the corpus, and a document's set is held as a row for each fragment. Overlaps are counted
fragment by fragment: the sets of a block meet once in each fragment, in a task of its own, which gives a matrix of partial
overlaps; the matrices of a block's fragments are added up, and the sums decide. A block holds a bounded number of sets and of
n-grams, so pairs are never rows: what leaves a block is a spanning forest of its links, or each set's number of links.

1. Documents with equal sets form a class; one of each takes part.
2. Of two sets that are similar enough, one n-gram at least is among the first few of both (prefix filter). Classes that share
   none of these with another class are alone; those that share one of at most BLOCK classes form its group.
3. The sets of classes with a more frequent one are dealt to cells by the n-grams' hash: more cells than two linked sets can
   have different n-grams, so one cell at least has the same content in both, and classes that share a cell's whole content
   form a group. That is much rarer between texts that are not alike than a shared n-gram is. So, at any size, how well the
   order tells rare n-grams from frequent ones decides how many classes are dealt to cells, in proportion, and nothing else.
4. Bitmaps stand for sets at first (a bit is the parity of the n-grams hashed to it, so bitmaps never differ in more bits than
   sets do in n-grams), and pairs whose bitmaps are close enough may link. Each class meets, in blocks, the others that share
   most with the same head (the class of a group with the least key), which joins up groups of near copies in time linear in
   their size; where a group still falls into several components, its rows meet across these.
5. Only classes that may link with another one are cut into fragments. Those of a component of (4) meet in blocks, all pairs once,
   and overlaps are counted. Where the number of links is not asked for, they meet around a head first, and after that only
   across what is not yet one component.
6. Components of all links.

No link is lost: linked classes share a prefix n-gram of a small group (2) or are both dealt to cells and share one (3), so they
are in one component of (4), and all pairs of that which are not known to be connected are counted in (5). The table of bucket
counts has a fixed size; everything else that grows with the documents stays in DataFrames and is written to the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.components import components
from seqloom.llm.store import added_up, discard, materialize
from seqloom.llm.textkernels import document_words, mix64, signed, slices, text_buffer, window_hashes
from seqloom.operators.sequences import running_sums

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
FRAGMENTS, BUCKET_BITS, PIECE = 8, 21, 1 << 16
#: Sets and n-grams on one side of a block, and sets of small groups that share a block.
BLOCK, GRAMS, PACK = 256, 1 << 20, 128
#: N-grams of at most FEW sets of a block are counted pair by pair, others as columns of a matrix, so many at once.
FEW, COLUMNS = 16, 1 << 13
#: Tasks that blocks are dealt to, about, at the most.
MOST_TASKS = 20_000
#: How often sets with too many empty cells are dealt anew.
DEALS = 4
#: Keys of sets that a task remembers, to let only the first of equal ones through.
REMEMBER = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of k words in a row of each document (of all its words if it has fewer, none if none)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    words, _, _, bounds = document_words(_LOWER[data[lo:hi]], offsets - lo)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = words[a:b]
        out.append(np.unique(window_hashes(own, min(k, len(own)))) if len(own) else own)
    return out


def set_key(shingles: np.ndarray) -> int:
    """One signed 64-bit key for equal sets."""
    with np.errstate(over="ignore"):
        total = np.array([np.add.reduce(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(shingles)) * np.uint64(0x9E3779B97F4A7C15)], np.uint64)
    return int(mix64(total).view(np.int64)[0])


@dataclass
class Order:
    """The global order: a level for each bucket, and for each level the share of all n-grams before it and in it."""

    level: np.ndarray
    before: np.ndarray
    within: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Order:
        level = np.floor(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
        weight = np.bincount(level, weights=counts, minlength=256)
        share = weight / max(1.0, weight.sum())
        return Order(level, np.cumsum(share) - share, share)

    def levels(self, shingles: np.ndarray) -> np.ndarray:
        return self.level[(shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]

    def prefix(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """The first n-grams of a set."""
        if size >= len(shingles):
            return shingles
        key = (self.levels(shingles).astype(np.uint64) << np.uint64(56)) | (mix64(shingles) >> np.uint64(8))
        return shingles[np.argpartition(key, size - 1)[:size]]

    def fragments(self, shingles: np.ndarray) -> list[np.ndarray]:
        """The set cut at equal shares of the order."""
        level = self.levels(shingles)
        place = self.before[level] + self.within[level] * ((mix64(shingles) >> np.uint64(11)).astype(np.float64) / 2.0**53)
        of = np.minimum((place * FRAGMENTS).astype(np.int64), FRAGMENTS - 1)
        order = np.argsort(of, kind="stable")
        return np.split(shingles[order], np.cumsum(np.bincount(of, minlength=FRAGMENTS))[:-1])


class _First:
    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, key: int) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) < REMEMBER:
            self.seen.add(key)
        return True


def _sets_of(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray]]:
    data, off = text_buffer(batch.column(at))
    for a, b in slices(off):
        for j, x in enumerate(shingle_sets(data, off[a : b + 1])):
            yield a + j, x


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and this task's bucket counts in compressed pieces."""
    names = ["doc_id", "key", "n", "set_key", "piece", "counts"]
    counts, first = np.zeros(1 << BUCKET_BITS, np.uint32), _First()
    for batch in batches:
        n, keys = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for j, x in _sets_of(batch, 2):
            n[j], keys[j] = len(x), set_key(x)
            if first(int(keys[j])):
                np.add.at(counts, (x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(keys), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
    used = [i for i in range(0, len(counts), PIECE) if counts[i : i + PIECE].any()]
    if used:
        null = pa.nulls(len(used), pa.int64())
        packed = [zlib.compress(counts[i : i + PIECE].astype("<u4").tobytes(), 1) for i in used]
        yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array([i // PIECE for i in used], pa.int32()), pa.array(packed, pa.binary())], names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces that a task has got, one row for each piece."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = zlib.decompress(packed.as_py())
            own = np.frombuffer(raw, "<u4" if len(raw) == 4 * PIECE else "<u8").astype(np.uint64)  # of a task, or of a level
            total[piece] = total[piece] + own if piece in total else own
    if total:
        packed = [zlib.compress(x.astype("<u8").tobytes(), 1) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], ["piece", "counts"])


def _order(pieces: DataFrame) -> Order:
    """Add up the counts of all tasks. The driver gets the sums: 2**BUCKET_BITS numbers, whatever the corpus."""
    n = (1 << BUCKET_BITS) // PIECE
    counts = np.zeros(1 << BUCKET_BITS, np.float64)
    for r in added_up(pieces.select("piece", "counts"), n, _added).collect():
        counts[r[0] * PIECE : (r[0] + 1) * PIECE] += np.frombuffer(zlib.decompress(r[1]), "<u8")
    return Order.of(counts)


def prefix_size(n: int, numerator: int, denominator: int) -> int:
    """How many of the first n-grams of a set of n must meet one of a similar set's."""
    return n - -(-n * numerator // denominator) + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity bits of a set, at least four for each n-gram; their number is a power of two."""
    size = 1 << max(6, int(4 * len(shingles) - 1).bit_length())
    place = (mix64(shingles) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=size) & 1).tobytes()


def _folded(rows: list[bytes], size: int) -> np.ndarray:
    """Bitmaps, packed, folded to `size` bits (neighbours that merge add up modulo 2)."""
    out = np.empty((len(rows), size // 8), np.uint8)
    for i, raw in enumerate(rows):
        own = np.frombuffer(raw, np.uint8)
        if len(own) > len(out[i]):
            own = np.packbits(np.unpackbits(own).reshape(size, -1).sum(axis=1) & 1)
        out[i] = own
    return out


def may_link(left: list[bytes], right: list[bytes], na: np.ndarray, nb: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Which pairs of sets, given as bitmaps and sizes, may be similar enough. False is certain.

    The intersection is half of what both sizes exceed the number of differing n-grams by, and that is at least the number of
    differing bits. Bitmaps of one length meet those of another one folded to the shorter of the two, unless the sizes say
    enough. The bits are taken in parts, whose distances are added up.
    """
    out = np.zeros((len(left), len(right)), bool)
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    for p in np.unique(la):
        for q in np.unique(lb):
            i, j = np.flatnonzero(la == p), np.flatnonzero(lb == q)
            if denominator * na[i].max() < numerator * nb[j].min() or denominator * nb[j].max() < numerator * na[i].min():
                continue
            size = 8 * int(min(p, q))
            a, b = _folded([left[x] for x in i], size), _folded([right[x] for x in j], size)
            same = np.zeros((len(i), len(j)), np.float64)
            for at in range(0, size // 8, 512):
                x, y = (1.0 - 2.0 * np.unpackbits(m[:, at : at + 512], axis=1).astype(np.float32) for m in (a, b))
                same += x @ y.T
            m, n = na[i][:, None], nb[j][None, :]
            both = np.minimum((m + n - (size - same) / 2) / 2, np.minimum(m, n))
            out[np.ix_(i, j)] = denominator * both >= numerator * (m + n - both)
    return out


def size_limits(most: int, numerator: int, denominator: int) -> np.ndarray:
    """First sizes of intervals such that sets that are similar enough lie in the same one or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * denominator // numerator + 1)
    return np.array(out, np.int64)


def cells(shingles: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Hashes of the contents of a set's cells: two sets that are similar enough and not equal have one in common.

    Two linked sets with sizes of up to `most` differ in at most `apart` n-grams, so with apart + 1 + spare cells at least
    spare + 1 have the same content in both. A set with no more than `spare` empty cells has one of them filled; sets with more
    are dealt once more, with another hash, and after DEALS times show their empty cells too. A set is dealt for the interval
    of its size and for the next one, so a pair meets in the interval of the larger set.
    """
    limits = size_limits(len(shingles), numerator, denominator)
    out = []
    with np.errstate(over="ignore"):
        for k in (len(limits) - 2, len(limits) - 1):
            most = int(limits[k]) * denominator // numerator
            apart = 2 * most * (denominator - numerator) // (denominator + numerator)
            if not apart:
                continue  # only equal sets are that similar
            spare = 1 + 3 * apart // 10
            n = apart + 1 + spare
            for deal in range(DEALS):
                salt = np.uint64((k * DEALS + deal + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                h = mix64(shingles ^ salt)
                cell = (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))
                full = cell[order[first]]
                out.append(mix64(np.add.reduceat(h[order], first) ^ mix64(full.astype(np.uint64) + salt)))
                if n - len(full) <= spare:
                    break
            else:
                empty = np.setdiff1d(np.arange(n), full).astype(np.uint64)
                out.append(mix64(mix64(empty + salt)))
    return np.unique(np.concatenate(out)) if out else shingles[:0]


def _may(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest (a, b) of what may link in each block, between different components, out of rows (of, side, set_key,
        n, component, bits) in the order of `of`."""
        block, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] != 0]
            if not left or not right:
                return
            sizes = [np.array([r[2] for r in x], np.float64) for x in (left, right)]
            good = may_link([r[4] for r in left], [r[4] for r in right], *sizes, numerator, denominator)
            good &= np.array([r[3] for r in left])[:, None] != np.array([r[3] for r in right])[None, :]
            i, j = forest(good)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.array([r[1] for r in left])[i]), pa.array(np.array([r[1] for r in right])[j])], ["a", "b"])

        for batch in batches:
            for of, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if of != block:
                    yield from done()
                    block, rows = of, []
                rows.append(row)
        yield from done()

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many members each two sets share: those of `left` with those of `right`, or with each other."""
    rows, n = left + (right or []), len(left)
    out = np.zeros((n, n if right is None else len(right)), np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    if not len(flat):
        return out
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    order = np.argsort(flat, kind="stable")
    row, flat = row[order], flat[order]
    gram = np.cumsum(np.append(0, flat[1:] != flat[:-1]))
    often = np.bincount(gram)[gram]
    few = (often > 1) & (often <= FEW)
    a, g, places = row[few], gram[few], []
    for d in range(1, min(FEW, len(a))):
        same = g[d:] == g[:-d]
        if not same.any():
            break
        i, j = a[:-d][same], a[d:][same]
        if right is None:
            places += [i * n + j, j * n + i]
        else:
            across = (i < n) & (j >= n)
            places.append(i[across] * len(right) + j[across] - n)
    if places:
        out += np.bincount(np.concatenate(places), minlength=out.size).reshape(out.shape)
    many = often > FEW
    a, g = row[many], gram[many]
    g = np.cumsum(np.append(0, g[1:] != g[:-1])) if len(g) else g
    for at in range(0, int(g[-1]) + 1 if len(g) else 0, COLUMNS):
        lo, hi = np.searchsorted(g, [at, at + COLUMNS])
        holds = np.zeros((len(rows), int(g[hi - 1]) + 1 - at), np.float32)
        holds[a[lo:hi], g[lo:hi] - at] = 1
        out += (holds[:n] @ (holds if right is None else holds[n:]).T).astype(np.int64)
    if right is None:
        np.fill_diagonal(out, 0)
    return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of partial overlaps out of rows (of, fragment, side, set_key, n, copies, grams) in the order of the first four.
    `who` has side, key, size and copies of the block's sets, the same in each of its fragments."""
    at, who, grams = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if who:
            left, right = ([g for w, g in zip(who, grams, strict=True) if w[0] != side] for side in (1, 0))
            found = overlaps(left) if who[0][0] == 2 else overlaps(left, right)
            columns = [pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([np.array(who, "<i8").tobytes()]), pa.array([zlib.compress(found.astype("<u4").tobytes(), 1)])]
            yield pa.RecordBatch.from_arrays(columns, ["of", "fragment", "who", "part"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        values, offsets = batch.column(6).values.to_numpy(), batch.column(6).offsets.to_numpy()
        for i, (of, fragment, *own) in enumerate(zip(*columns, strict=True)):
            if (of, fragment) != at:
                yield from done()
                at, who, grams = (of, fragment), [], []
            if not who or who[-1] != tuple(own):  # a set may come twice
                who.append(tuple(own))
                grams.append(values[offsets[i] : offsets[i + 1]].copy())
    yield from done()


def forest(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that connect all that the links in `good` do."""
    seen_left, seen_right = ~good.any(axis=1), ~good.any(axis=0)
    rows, columns = [], []
    for start in np.flatnonzero(~seen_left):
        if seen_left[start]:
            continue
        seen_left[start], front = True, np.array([start])
        while len(front):
            sub = good[front] & ~seen_right
            new = np.flatnonzero(sub.any(axis=0))
            rows.append(front[sub[:, new].argmax(axis=0)] if len(new) else new)
            columns.append(new)
            seen_right[new] = True
            sub = good[:, new] & ~seen_left[:, None]
            front = np.flatnonzero(sub.any(axis=1))
            rows.append(front)
            columns.append(new[sub[front].argmax(axis=1)] if len(front) else front)
            seen_left[front] = True
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _summed(numerator: int, denominator: int, number: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the parts of each block, out of rows (of, who, part) in the order of `of`: a spanning forest of the links as
        (a, b, null) and, with `number`, (a, null, how many rows the set links with in this block)."""
        block, who, total = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if who is None:
                return
            left, right = who[who[:, 0] != 1], who[who[:, 0] != 0]
            whole = left[:, 2][:, None] + right[:, 2][None, :]
            good = denominator * total >= numerator * (whole - total)
            i, j = forest(good)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(left[i, 1]), pa.array(right[j, 1]), pa.nulls(len(i), pa.int64())], ["a", "b", "m"])
            if number and len(i):
                a, m = left[:, 1], good @ right[:, 3]
                if who[0, 0] != 2:
                    a, m = np.append(a, right[:, 1]), np.append(m, left[:, 3] @ good)
                a, m = a[m > 0], m[m > 0]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(m)], ["a", "b", "m"])

        for batch in batches:
            for of, raw, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = np.frombuffer(zlib.decompress(part.as_py()), "<u4")
                if of != block:
                    yield from done()
                    block, who = of, np.frombuffer(raw.as_py(), "<i8").reshape(-1, 4).astype(np.int64)
                    total = np.zeros(((who[:, 0] != 1).sum(), (who[:, 0] != 0).sum()), np.int64)
                total += own.reshape(total.shape)
        yield from done()

    return run


def _fragments(order, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (of, fragment, side, set_key, n, copies, grams) of the sets of texts, for each block that a set is in, out of rows
        (set_key, copies, blocks, text)."""
        first, names = _First(), ["of", "fragment", "side", "set_key", "n", "copies", "grams"]
        where, sizes, flat, held = [], [], [], 0

        def rows() -> pa.RecordBatch:
            own = np.array(where, np.int64).reshape(-1, 6)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(signed(np.concatenate(flat))))
            return pa.RecordBatch.from_arrays([*(pa.array(own[:, i], kind) for i, kind in enumerate(kinds)), lists], names)

        for batch in batches:
            keys, copies, blocks = (batch.column(i).to_pylist() for i in range(3))
            for j, x in _sets_of(batch, 3):
                if not first(keys[j]):
                    continue
                parts = order.value.fragments(x)
                for block in blocks[j]:
                    where += [(block["of"], f, block["side"], keys[j], len(x), copies[j]) for f in range(fragments)]
                    sizes += [len(p) for p in parts]
                    flat += parts
                    held += len(x)
                    if held > GRAMS:
                        yield rows()
                        where, sizes, flat, held = [], [], [], 0
        if where:
            yield rows()

    return run


def _n_cells(count: Column, grams: Column) -> Column:
    return F.greatest(F.ceil(count / F.lit(BLOCK)), F.ceil(grams / F.lit(GRAMS)), F.lit(1)).cast("int")


def _all_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Blocks (of, side, set_key, n, copies) in which all rows (set_key, n, copies) of each group meet, each two once. A group
    that fits in a block shares one with others; of a larger one, each part meets itself and each other part."""
    size = rows.groupBy(group).agg(F.count("*").alias("_m"), F.sum("n").alias("_w"))
    size = materialize(size.withColumn("_cells", _n_cells(F.col("_m"), F.col("_w"))).where("_m > 1"), "near-sizes")
    rows = rows.join(size.select(group, "_cells", "_m"), group)
    shared = max(1, -(-(size.where("_cells = 1").agg(F.sum("_m")).first()[0] or 0) // PACK))
    own = F.pmod(F.xxhash64("set_key"), F.col("_cells")).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    pack = F.xxhash64(F.lit("pack"), F.pmod(F.xxhash64(group), F.lit(shared)))
    of = F.when(F.col("_cells") == 1, pack).otherwise(F.xxhash64(group, F.least("_own", "_with"), F.greatest("_own", "_with")))
    side = F.when(F.col("_own") == F.col("_with"), 2).when(F.col("_own") < F.col("_with"), 0).otherwise(1)
    return rows.select(of.alias("of"), side.alias("side"), "set_key", "n", "copies")


def _by_load(work: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with the number of their task, and how many tasks: blocks follow each other, and a task takes those that begin within its
    share of all rows, so none gets more than its share and the rest of one block."""
    work = materialize(work, "near-work")
    loads = work.groupBy("of").agg(F.count("*").alias("_rows"))
    placed = materialize(running_sums(loads, ["of"], F.shiftright("of", 52), "_rows", "_at"), "near-loads")
    total = placed.agg(F.sum("_rows")).first()[0] or 0
    share = max(2 * BLOCK, total // MOST_TASKS)
    tasks = placed.select("of", F.floor(F.col("_at") / share).cast("int").alias("_task"))
    return work.join(tasks, "of"), total // share + 1


def _around_heads(rows: DataFrame) -> DataFrame:
    """Blocks (of, side, set_key, n, copies) of the rows (head, set_key, n, copies); a head is in all blocks of its group."""
    size = rows.groupBy("head").agg(F.count("*").alias("_m"), F.sum("n").alias("_w"))
    size = materialize(size.where("_m > 1").select("head", "_m", _n_cells(F.col("_m"), F.col("_w")).alias("_cells")), "near-around")
    shared = max(1, -(-(size.where("_cells = 1").agg(F.sum("_m")).first()[0] or 0) // PACK))
    rows = rows.join(size, "head")
    last = F.col("_cells") - 1
    own = F.pmod(F.xxhash64("set_key"), F.col("_cells")).cast("int")
    rows = rows.withColumn("_at", F.explode(F.when(F.col("head") == F.col("set_key"), F.sequence(F.lit(0), last)).otherwise(F.array(own))))
    of = F.when(F.col("_cells") == 1, F.xxhash64(F.lit("pack"), F.pmod(F.xxhash64("head"), F.lit(shared)))).otherwise(F.xxhash64("head", "_at"))
    return rows.select(of.alias("of"), F.lit(2).alias("side"), "set_key", "n", "copies").distinct()


def _across(groups: DataFrame, joined: DataFrame) -> DataFrame:
    """Blocks, with `component`, in which the rows (head, set_key, n, copies) of each head's group meet those of other components:
    the parts of the largest component meet all other parts, and those meet each other."""
    here = groups.join(joined, F.col("set_key") == F.col("node"), "left").select("head", "set_key", "n", "copies", F.coalesce("label", "set_key").alias("component"))
    here = materialize(here, "near-open")
    per = here.groupBy("head", "component").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    open_ = per.groupBy("head").agg(F.max(F.struct("m", "w", "component")).alias("_top"), F.count("*").alias("_parts"), F.sum("m").alias("_m"), F.sum("w").alias("_w"))
    one = _n_cells(F.col("_top.m"), F.col("_top.w")).alias("_one")
    rest = _n_cells(F.col("_m") - F.col("_top.m"), F.col("_w") - F.col("_top.w")).alias("_rest")
    alone = (_n_cells(F.col("_m"), F.col("_w")) == 1).alias("_alone")
    open_ = materialize(open_.where("_parts > 1").select("head", F.col("_top.component").alias("_largest"), one, rest, alone), "near-open-heads")
    rows = here.join(open_, "head").withColumn("_is", F.col("component") == F.col("_largest"))
    place = F.xxhash64("set_key")
    own = F.when(F.col("_alone"), 0).when(F.col("_is"), F.pmod(place, F.col("_one"))).otherwise(F.col("_one") + F.pmod(place, F.col("_rest"))).cast("int")
    first = F.when(F.col("_is") & ~F.col("_alone"), F.col("_one")).otherwise(0)
    last = F.when(F.col("_alone"), 0).otherwise(F.col("_one") + F.col("_rest") - 1)
    rows = rows.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(first, last)))
    side = F.when(F.col("_own") == F.col("_with"), 2).when(F.col("_own") < F.col("_with"), 0).otherwise(1)
    of = F.xxhash64("head", F.least("_own", "_with"), F.greatest("_own", "_with"))
    return rows.select(of.alias("of"), side.alias("side"), "set_key", "n", "copies", "component")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = NUMERATOR, denominator: int = DENOMINATOR, links: bool = False) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least numerator / denominator.

    Returns one row for each row (repeated rows stay repeated): doc_id, n_shingles (size of the set), component_id (the smallest
    doc_id that links reach, itself included), text_key (a hash of the text), group_key (the same for all rows of a component;
    null for an empty set); with `links`, which looks at all pairs inside a component, also n_links (how many other rows a row
    links with, those of an equal set included). A-Z are lowered; words are runs of anything but ASCII white space; a text of
    fewer than WORDS words has one shingle of all of them. A null or wordless text has an empty set and links with nothing:
    its component is its own id. Rows with a null id take part; their component is the least id of those they reach, or null.
    Links of repeated ids are links of that id's rows, each judged by its own text. An empty table gives none. A long text is
    one set, with eight bytes a shingle; it fills blocks by its shingles. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))

    found = materialize(rows.mapInArrow(_classes, "doc_id long, key long, n long, set_key long, piece int, counts binary"), "near-classes")
    order = spark.sparkContext.broadcast(_order(found.where(F.col("piece").isNotNull())))
    members = found.where(F.col("piece").isNull()).select("doc_id", "key", "n", "set_key")
    real = members.where(F.col("n") > 0)
    classes = real.groupBy("set_key").agg(F.min("n").alias("n"), F.count("*").alias("copies"), F.min("key").alias("key"), F.min("doc_id").alias("doc"))
    classes = materialize(classes, "near-sets")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _First()
        for batch in batches:
            gram, key = [], []
            for _, x in _sets_of(batch, 0):
                if len(x) and first(own := set_key(x)):
                    gram.append(order.value.prefix(x, prefix_size(len(x), numerator, denominator)))
                    key.append(np.full(len(gram[-1]), own))
            if gram:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(gram))), pa.array(np.concatenate(key))], ["gram", "set_key"])

    # Whatever is joined back to its rows is written first, so that both sides have an exchange and hot keys can be split.
    grams = materialize(rows.select("text").mapInArrow(prefixes, "gram long, set_key long"), "near-prefixes")
    several = grams.groupBy("gram").agg(F.count("*").alias("m"), F.min("set_key").alias("a"), F.max("set_key").alias("b")).where(F.col("a") != F.col("b"))
    several = materialize(several.select("gram", (F.col("m") > BLOCK).alias("hot")), "near-several")
    meeting = materialize(grams.join(several, "gram").select("gram", "set_key", "hot"), "near-meeting")
    discard(grams)
    discard(several)
    met = meeting.groupBy("set_key").agg(F.max("hot").alias("hot"))
    met = materialize(classes.join(met, "set_key").select("set_key", "key", "n", "copies", "hot"), "near-met")

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _First()
        for batch in batches:
            keys, hot = (batch.column(i).to_pylist() for i in range(2))
            who, bits, own = [], [], []
            for j, x in _sets_of(batch, 2):
                if first(keys[j]):
                    who.append((keys[j], len(x)))
                    bits.append(bitmap(x))
                    own.append(signed(cells(x, numerator, denominator)) if hot[j] else None)
            if who:
                yield pa.RecordBatch.from_arrays([*(pa.array([w[i] for w in who], pa.int64()) for i in range(2)), pa.array(bits, pa.binary()), pa.array(own, pa.list_(pa.int64()))], ["set_key", "n", "bits", "cells"])

    # A set can come twice here (equal texts that tasks do not see together). Texts are joined by a merge at any size, since what
    # they are joined with grows with them.
    texts = rows.select("key", "text").join(met.hint("merge"), "key").select("set_key", "hot", "text")
    each = materialize(texts.mapInArrow(signs, "set_key long, n long, bits binary, cells array<bigint>"), "near-signs")

    shared = meeting.where(~F.col("hot")).select(F.col("gram").alias("point"), "set_key").unionByName(each.select(F.explode("cells").alias("point"), "set_key"))
    heads = shared.groupBy("point").agg(F.min("set_key").alias("head"), F.max("set_key").alias("b")).where(F.col("head") != F.col("b"))
    heads = materialize(heads.select("point", "head"), "near-heads")
    groups = shared.join(heads, "point").groupBy("head", "set_key").agg(F.count("*").alias("shared"))
    groups = materialize(groups.join(met.select("set_key", "n", "copies"), "set_key"), "near-groups")
    discard(heads)
    discard(meeting)

    def may(work: DataFrame) -> DataFrame:
        work, tasks = _by_load(work)
        both = work.join(each.select("set_key", "bits"), "set_key").select("_task", "of", "side", "set_key", "n", "component", "bits")
        both = both.repartitionById(tasks, F.col("_task")).drop("_task").sortWithinPartitions("of")
        return materialize(both.mapInArrow(_may(numerator, denominator), "a long, b long"), "near-may")

    # Step 4: each class in the group of the head that it shares most with, and each head in its own.
    nearest = groups.groupBy("set_key", "n", "copies").agg(F.max(F.struct("shared", "head")).alias("_best")).select(F.col("_best.head").alias("head"), "set_key", "n", "copies")
    groups = groups.select("head", "set_key", "n", "copies")
    nearest = nearest.where(F.col("head") != F.col("set_key")).unionByName(groups.where(F.col("head") == F.col("set_key")))
    star = may(_around_heads(materialize(nearest, "near-nearest")).withColumn("component", F.col("set_key")))
    joined = components(star)
    cross = may(_across(groups, joined))
    maybe = joined if cross.isEmpty() else components(star.unionByName(cross))
    inside = materialize(met.join(maybe, F.col("set_key") == F.col("node")).select("label", "set_key", "n", "copies", "key"), "near-inside")
    discard(each)

    # Steps 5 and 6.
    def counted(work: DataFrame) -> DataFrame:
        """Overlaps in the blocks `work` (of, side, set_key, n, copies). Side 0 meets side 1; sets of side 2 meet each other."""
        at = work.groupBy("set_key").agg(F.collect_list(F.struct("of", "side")).alias("blocks"))  # as many as its component has parts
        at = materialize(inside.select("set_key", "key", "copies").join(at, "set_key"), "near-blocks")
        own = rows.select("key", "text").join(at.hint("merge"), "key").select("set_key", "copies", "blocks", "text")
        own = own.mapInArrow(_fragments(order, FRAGMENTS), "of long, fragment int, side int, set_key long, n long, copies long, grams array<bigint>")
        parts = own.repartition("of", "fragment").sortWithinPartitions("of", "fragment", "side", "set_key").mapInArrow(_partial, "of long, fragment int, who binary, part binary")
        parts = parts.select("of", "who", "part").repartition("of").sortWithinPartitions("of")
        return materialize(parts.mapInArrow(_summed(numerator, denominator, links), "a long, b long, m long"), "near-links")

    if links:
        found = counted(_all_pairs(inside, "label"))
    else:
        around = inside.select(F.col("label").alias("head"), "set_key", "n", "copies")
        found = counted(_around_heads(around))
        found = found.unionByName(counted(_across(around, components(found.select("a", "b")))))
    final = components(found.select("a", "b"))
    named = classes.join(final, F.col("set_key") == F.col("node"), "left").select("set_key", "copies", "doc", F.coalesce("label", "set_key").alias("label"))
    named = materialize(named, "near-named")
    least = materialize(named.groupBy("label").agg(F.min("doc").alias("component_id")), "near-least")
    ids = named.join(least, "label").select("set_key", "component_id", "label", (F.col("copies") - 1).alias("n_links"))
    if links:
        others = materialize(found.groupBy("a").agg(F.sum("m").alias("m")), "near-numbers")
        ids = ids.join(others, F.col("set_key") == F.col("a"), "left").withColumn("n_links", F.col("n_links") + F.coalesce("m", F.lit(0))).drop("a", "m")
    ids = materialize(ids, "near-ids")
    for used in (named, least, inside):
        discard(used)
    out = members.join(ids, "set_key", "left")
    own = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("key").alias("text_key"),
        F.when(~own, F.col("label")).alias("group_key"),
        *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that stay when one document of each component does: the one with the least id, and
    the least hash of the text among rows that share it. Rows that repeat each other stay once. Texts without words are
    in no component and stay, and so do rows whose id is null and that link with nothing."""
    found = jaccard_components(docs, id_col, text_col)
    alone = found.where(F.col("group_key").isNull()).select("doc_id", "text_key")
    first = found.where(F.col("group_key").isNotNull()).groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("_first"))
    stay = alone.unionByName(first.select("_first.doc_id", "_first.text_key")).select(F.col("doc_id").alias("_seqloom_id"), F.col("text_key").alias("_seqloom_key")).distinct()
    rows = docs.withColumns({"_seqloom_own_id": F.col(id_col).cast("long"), "_seqloom_own_key": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    rows = rows.join(stay, F.col("_seqloom_own_id").eqNullSafe(F.col("_seqloom_id")) & (F.col("_seqloom_own_key") == F.col("_seqloom_key")), "left_semi")
    return rows.dropDuplicates(["_seqloom_own_id", "_seqloom_own_key"]).drop("_seqloom_own_id", "_seqloom_own_key")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all whole texts of `documents`, and how many others each document links with."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=True).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE_SQL = {
    "op9_jaccard_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + least({WORDS}, len(w)) - 1], ' ')) AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {WORDS - 2}))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        link AS (
            SELECT a, b FROM both_have JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
            WHERE {DENOMINATOR} * i >= {NUMERATOR} * (p.n + q.n - i)),
        reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.to_id)
        SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(to_id) AS component_id, coalesce(max(m.m), 0) AS n_links
        FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS m FROM link GROUP BY 1) m USING (doc_id)
        GROUP BY d.doc_id
    """
}
QUERIES = {"op9_jaccard_join": op9_jaccard_join}
