"""Best-fit packing by bin completion branch-and-bound.

Documents become pieces of at most ``size`` tokens. What is packed is the histogram of piece lengths: at most ``size``
rows whatever the number of documents, so the search runs on the driver over a bounded table. It takes the largest
length left, enumerates the undominated fillings of the room beside it, and packs the best filling as often as the
counts allow. A best-fit-decreasing packing is the first incumbent; fillings whose waste would bring the whole above
the incumbent's number of sequences are pruned. Every better packing becomes the incumbent and the search goes on from
there, with more fillings to a node by the turn, until the incumbent meets the bound
ceil(tokens / size), nothing is left to try, or STEPS steps are spent. Steps are counted, not timed: equal lengths give
equal packings on any machine. Pieces then find their place by their rank among pieces of the same length: ranks come from a
range-partitioned sort and partition offsets, so that a length which a third of all pieces share is still spread out.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import Workspace, read, ship

SIZE = 4096
#: Steps of the search over all (nodes, pieces tried in a filling, fillings compared); then the incumbent stands. A bound on
#: the driver's work and memory, not on what is packed. By the turn: fillings listed at a node, of these tried, and the share of the steps in percent.
STEPS = 2_000_000
TURNS = ((8, 1, 30), (32, 4, 30), (128, 16, 30), (1024, None, 10))

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram, many equal bins at a time: (lengths in a sequence, how often)."""
    open_bins: dict[int, list[list]] = {}  # room left: groups of equal bins [pattern, how many]
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not room:
            done.append((pattern, n))
            return
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):  # no bin has room: open new ones, filled with this length
                each = size // length
                if n := left // each:
                    put(size - each * length, (length,) * each, n)
                if rest := left % each:
                    put(size - rest * length, (length,) * rest, 1)
                break
            room = rooms[k]
            groups = open_bins[room]
            pattern, n = groups.pop()
            if not groups:
                del open_bins[room], rooms[k]
            each = min(room // length, max(1, left // n))
            if each * n <= left:
                put(room - each * length, pattern + (length,) * each, n)
                left -= each * n
            else:
                put(room - length, pattern + (length,), left)
                put(room, pattern, n - left)
                left = 0
    return done + [(p, n) for groups in open_bins.values() for p, n in groups]


class Budget:
    """Steps left."""

    def __init__(self, steps: int):
        self.left = steps


def fillings(room: int, lengths: list[int], counts: dict[int, int], waste: int, budget: Budget, most: int | None = None) -> list[Pattern]:
    """Undominated fillings of ``room`` from ``lengths`` (descending), the fullest first; ``most``: of the first so many
    found, in descending order of their pieces.

    A filling is dominated by another that puts larger pieces in place of its own; those with more than ``waste``
    tokens of room left are pruned. A single piece that fills the room exactly dominates all.
    """
    if counts.get(room):
        return [(room,)]
    out: list[tuple[int, Pattern]] = []
    least = lengths[-1] if lengths else room + 1
    used: list[int] = []
    taken: dict[int, int] = {}
    steps = 0
    places, left, k = [], room, 0  # the places of the pieces taken, room left, next place to try
    while True:
        full = left < least
        if not full:
            k = bisect.bisect_left(lengths, -left, k, key=lambda v: -v)
            while k < len(lengths) and taken.get(lengths[k], 0) >= counts[lengths[k]]:
                k += 1
        steps += 1
        if not full and k < len(lengths):
            x = lengths[k]
            used.append(x), places.append(k)
            taken[x] = taken.get(x, 0) + 1
            left -= x
            continue
        # nothing more fits from here on: this is a filling, unless it was left for a smaller piece that isn't there
        if full and left <= waste:
            out.append((left, tuple(used)))
        if not places or (most and (len(out) >= most or steps > 40 * most)) or steps > budget.left:
            break
        exact = full and left == 0
        x, k = used.pop(), places.pop() + 1
        taken[x] -= 1
        left += x
        if exact and places:  # smaller pieces in the last place only leave room
            x, k = used.pop(), places.pop() + 1
            taken[x] -= 1
            left += x
    if not lengths or least > room:
        out.append((room, ()))
    out = sorted(set(out), key=lambda f: (f[0], tuple(-x for x in f[1])))
    kept: list[Pattern] = []
    for _, f in out:
        steps += len(kept)
        if steps > budget.left and kept:
            break
        if not any(_dominates(g, f) for g in kept):
            kept.append(f)
    budget.left -= steps
    return kept


def _dominates(g: Pattern, f: Pattern) -> bool:
    """Whether the pieces of f can be dealt into the places of g: then g is at least as good."""
    places = sorted(g, reverse=True)
    for x in sorted(f, reverse=True):
        for k, p in enumerate(places):
            if p >= x:
                places[k] = p - x
                break
        else:
            return False
    return True


def complete_bins(counts: dict[int, int], size: int = SIZE, steps: int = STEPS) -> list[tuple[Pattern, int]]:
    """As few sequences as the search finds: (lengths in a sequence, how often), for a histogram of lengths of 1 to ``size``."""
    counts = {k: n for k, n in counts.items() if n}
    total = sum(k * n for k, n in counts.items())
    least = -(-total // size)
    incumbent = best_fit(counts, size)
    for most, wide, share in TURNS:
        best = sum(n for _, n in incumbent)
        if best <= least:
            break
        incumbent = _search(counts, size, total, least, best, Budget(steps * share // 100), most, wide) or incumbent
    return incumbent


def _search(counts: dict[int, int], size: int, total: int, least: int, best: int, budget: Budget, most: int | None, wide: int | None) -> list[tuple[Pattern, int]] | None:
    """The best packing found of fewer than ``best`` sequences, if any, by depth-first search with undoing."""
    left, lengths = dict(counts), sorted(counts)  # ascending
    spare = (best - 1) * size - total  # waste that a better packing can bear
    made: list[tuple[Pattern, int]] = []  # the path; a choice of each frame
    frames: list = []
    found, used = None, 0

    def change(pattern: Pattern, n: int) -> None:
        for x in pattern:
            before = left.get(x, 0)
            left[x] = before - n
            if not left[x]:
                del left[x]
                del lengths[bisect.bisect_left(lengths, x)]
            elif not before:
                bisect.insort(lengths, x)

    def choices():
        """Patterns and how often, for the largest length left. A frame holds these alone, not what they were found from."""
        big = lengths[-1]
        others = dict(left)
        others[big] -= 1
        out = []
        for filling in fillings(size - big, [x for x in reversed(lengths) if others[x]], others, spare, budget, most)[:wide]:
            pattern = (big, *filling)
            waste = size - sum(pattern)
            n = min(left[x] // pattern.count(x) for x in set(pattern))
            n = min(n, spare // waste) if waste else n
            if n:
                out.append((pattern, n))
        # as often as it goes; in the last turn less often, too
        return iter(out) if wide else ((pattern, k) for pattern, n in out for k in range(n, 0, -1))

    while True:
        if not lengths and spare >= 0:
            found = list(made)
            spare -= (best - used) * size
            best = used
            if best <= least:
                return found
        budget.left -= 1
        frames.append(choices() if lengths and spare >= 0 else iter(()))
        while True:
            step = next(frames[-1], None) if spare >= 0 and budget.left > 0 else None
            if step and step[1] * (size - sum(step[0])) <= spare:
                break
            if step:  # a better incumbent came meanwhile
                continue
            frames.pop()
            if not frames:
                return found
            pattern, n = made.pop()  # back to the frame below, whose choice this was
            change(pattern, -n)
            used -= n
            spare += n * (size - sum(pattern))
        pattern, n = step
        change(pattern, n)
        made.append((pattern, n))
        used += n
        spare -= n * (size - sum(pattern))


def _cut(path: str, size: int, end: int, most: int = tokens.KEPT):
    def run(batches):
        enc = tokens.encoder(path, most)
        for b in batches:
            for c in tokens.slices(b, 1):
                ids, at = enc.column(c.column(1), end)
                long = np.diff(at)
                many = -(-long // size)  # pieces of each text; every text has its end
                row = np.repeat(np.arange(c.num_rows), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * size
                length = np.minimum(size, long[row] - start)
                first = at[row] + start
                view = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(view[i:j]) for i, j in zip((4 * first).tolist(), (4 * (first + length)).tolist())]
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut(docs: DataFrame, size: int = SIZE, tokenizer: str = tokens.WORD_BPE, end: int = 1, most: int = tokens.KEPT) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of each document's ids with the end id; null text counts as empty.
    ``most``: words that a worker keeps, for memory and time alone."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer, size, end, most), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, ws: Workspace, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset (long) to pieces (doc_id, piece, length, ...), every one of 1 to ``size`` tokens.

    Repeated rows are packed each; ties among equal lengths go by doc_id and piece and, between equal rows, by chance,
    which changes no number of sequences. An empty table gives no rows; further columns stay, but for any named
    sequence_id or offset, which are replaced, and names of one underscore that this uses (_id, _part, _row, _base, _index).
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset", "_id", "_part", "_row", "_base", "_index")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = ws.put(pieces, "pieces")  # dealing by ranges reads its input twice, once for a sample
    dealt = pieces.repartitionByRange(parts, "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    dealt = ws.put(dealt.withColumn("_id", F.monotonically_increasing_id()), "sorted")
    ws.free("pieces")
    dealt = dealt.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    part = dealt.groupBy("_part").agg(F.count("*").alias("n")).select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_base"))
    counts = {r[0]: r[1] for r in dealt.groupBy("length").count().collect()}  # at most ``size`` rows
    below, upto = {}, 0
    for x in sorted(counts):
        below[x], upto = upto, upto + counts[x]
    rows, seq, seen = [], 0, dict.fromkeys(counts, 0)
    for pattern, n in complete_bins(counts, size):
        at = 0
        for x in pattern:  # this place of n sequences takes n ranks of length x
            rows.append((x, seen[x], seen[x] + n, seq, at))
            seen[x] += n
            at += x
        seq += n
    table: dict[int, tuple[list, list, list]] = {}
    for x, lo, _, s, at in rows:
        t = table.setdefault(x, ([], [], []))
        t[0].append(lo), t[1].append(s), t[2].append(at)
    sent = spark.sparkContext.broadcast((below, {x: tuple(np.array(c, np.int64) for c in t) for x, t in table.items()}))

    def run(batches):
        below, table = sent.value
        for b in batches:
            length, index = b.column("length").to_numpy(), b.column("_index").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                m = length == x
                lo, s, at = table[x]
                rank = index[m] - below[x]
                k = np.searchsorted(lo, rank, side="right") - 1
                seq[m], off[m] = s[k] + rank - lo[k], at[k]
            keep = [c for c in b.schema.names if c != "_index"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    ranked = dealt.join(F.broadcast(part), "_part").withColumn("_index", F.col("_base") + F.col("_row")).drop("_id", "_part", "_row", "_base")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_index")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, `offset` long")


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(cut(read(spark, sf_dir, "documents")), Workspace(spark, "op4"))
