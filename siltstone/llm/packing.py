"""Hierarchical packing: documents go to context-size tiers, each tier is packed, gaps of long windows take shorter documents."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written
from .token_files import default_vocabulary
from .tokens import encoder, runs, trim, with_end

TIERS = (256, 512, 1024, 2048)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, task long, window long"
#: Characters of the documents that are packed together.
MOST_CHARS = 2_000_000


class Packer:
    """Packs the documents of one task, some millions of ids at a time.

    A document longer than the longest tier gives full windows of that tier; its rest, like any shorter document, is
    routed to the smallest tier that holds it. From the longest tier down, each item opens a window of its tier; the
    gap takes the longest item that fits from the shorter tiers, again and again, and at last the head of a longer
    one, cut to fit. So windows are full powers of two. What can't fill a window waits for the next documents; only a
    task's last window may have a gap. Each tier's windows are numbered.
    """

    def __init__(self, task: int, tiers: tuple[int, ...]):
        self.task, self.tiers, self.sequences = task, sorted(tiers), 0
        self.windows = dict.fromkeys(self.tiers, 0)
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start), ascending
        self.out: list[tuple] = []

    def _emit(self, tier: int, parts: list[tuple[int, int, int]]) -> None:
        seq = self.task << 36 | self.sequences
        at = 0
        for n, doc, start in parts:
            self.out.append((doc, start, n, seq, at, tier, self.windows[tier]))
            at += n
        self.sequences += 1
        self.windows[tier] += 1

    def add(self, doc: int, n: int) -> None:
        top, start = self.tiers[-1], 0
        while n - start >= top:
            self._emit(top, [(top, doc, start)])
            start += top
        if n > start:
            self.waiting.append((n - start, doc, start))

    def pack(self, last: bool = False) -> list[tuple]:
        """(document, start, length, sequence, offset, tier, the tier's window) of the windows that are done."""
        items = sorted(self.waiting)
        total = sum(x[0] for x in items)
        while items:
            tier = next(t for t in self.tiers if t >= items[-1][0])
            if total < tier:
                if not last:
                    break
                tier = next(t for t in self.tiers if t >= total)
            room, parts = tier, []
            while room and items:
                k = bisect_right(items, (room, 1 << 62, 1 << 62))
                if k:
                    item = items.pop(k - 1)
                else:  # all are longer than the gap
                    n, doc, start = items.pop(0)
                    item = (room, doc, start)
                    insort(items, (n - room, doc, start + room))
                parts.append(item)
                room -= item[0]
                total -= item[0]
            self._emit(tier, parts)
        self.waiting = items
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_ids: int = 65_536) -> DataFrame:
    """All docs (doc_id, text) as pieces of sequences of at most max(tiers) ids. Texts aren't shuffled: a task packs what it reads.

    Step groups hold windows of one tier and the same number of ids: step_ids // tier windows each (one at least). The
    windows are numbered through all tasks, by prefix sums of the tasks' numbers, so each tier has one short group at most.
    Null or empty text is a document of the end id alone. Rows with equal or null doc_id are documents of their own.
    An empty table gives no pieces. Other columns are ignored.
    """
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # what other operators held in this worker
        enc, packer = encoder(vocabulary), Packer(TaskContext.get().partitionId(), tiers)
        held: dict[int, tuple] = {}  # of documents that have ids in wait: doc_id, ids
        made = 0

        def rows(done: list[tuple]) -> pa.RecordBatch:
            crc = [zlib.crc32(held[d][1][s : s + n].astype("<u4").tobytes()) for d, s, n, *_ in done]
            out = pa.RecordBatch.from_pydict(
                {
                    "doc_id": [held[x[0]][0] for x in done],
                    "start": [x[1] for x in done],
                    "length": [x[2] for x in done],
                    "ids_crc32": crc,
                    "doc_tokens": [len(held[x[0]][1]) for x in done],
                    "sequence_id": [x[3] for x in done],
                    "offset": [x[4] for x in done],
                    "tier": [x[5] for x in done],
                    "task": [packer.task] * len(done),
                    "window": [x[6] for x in done],
                },
                schema,
            )
            left = {x[1] for x in packer.waiting}
            for d in [d for d in held if d not in left]:
                del held[d]
            return out

        for batch in batches:
            for part in runs(pc.utf8_length(batch.column("text")).to_pylist(), MOST_CHARS):
                own = batch.slice(part[0], len(part))  # only its texts are strings of Python at a time
                ids, n = with_end(*enc.encode(own.column("text").to_pylist()), end_id)
                ends = np.cumsum(n)
                for key, a, b in zip(own.column("doc_id").to_pylist(), (ends - n).tolist(), ends.tolist(), strict=True):
                    held[made] = (key, ids[a:b].copy())
                    packer.add(made, b - a)
                    made += 1
                yield rows(packer.pack())
        yield rows(packer.pack(last=True))

    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES), "pieces")
    count = pieces.groupBy("tier", "task").agg((F.max("window") + 1).alias("n"))  # a row for each task and tier
    before = F.coalesce(F.sum("n").over(W.partitionBy("tier").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.create_map(*(F.lit(x).cast("long") for k, t in enumerate(sorted(tiers)) for x in (t, k)))
    size = F.greatest(F.lit(1), F.floor(F.lit(step_ids) / F.col("tier")))
    group = F.shiftleft(number[F.col("tier")], 40) + F.floor((F.col("before") + F.col("window")) / size)
    columns = [c for c in pieces.columns if c not in ("task", "window")]
    return pieces.join(count.select("tier", "task", before.alias("before")), ["tier", "task"]).select(*columns, group.alias("step_group"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
