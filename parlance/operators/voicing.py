"""Voiced stretches of frames: a two-state automaton with a buffer, run in blocks of an utterance and on live streams.

The buffer holds the last frames since the last turn, so what a block has to know of the past are the `buffer` frames before it, whether a stretch
is open, and how many of those frames have come since the turn: 2 * (buffer + 1) cases. A block maps each of them to the case at its end; a
walk over those small maps gives every block its own case, and the blocks then report their turns, all apart from each other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .prefix import block_of, running

BLOCK_FRAMES = 20_000
TURN_BLOCKS = 50  # turns are numbered by so many blocks of frames at a time


class Voiced:
    """Start and end of voiced stretches, frame by frame: a buffer mostly voiced opens one, a buffer mostly unvoiced closes it.

    The buffer empties at each turn; a stretch that is still open ends at the start of the last frame.
    """

    def __init__(self, duration: float, buffer: int = 10, share: float = 0.9):
        self.duration, self.most = duration, share * buffer
        self.held: deque[bool] = deque(maxlen=buffer)
        self.opened, self.seen = None, 0

    def frame(self, speech: bool) -> list[tuple[float, float]]:
        self.held.append(speech)
        self.seen += 1
        yes = sum(self.held)
        if self.opened is None and yes > self.most:
            self.opened = self.seen - len(self.held)
            self.held.clear()
        elif self.opened is not None and len(self.held) - yes > self.most:
            found = [(self.opened * self.duration, (self.seen - 1) * self.duration + self.duration)]
            self.opened = None
            self.held.clear()
            return found
        return []

    def end(self) -> list[tuple[float, float]]:
        return [] if self.opened is None else [(self.opened * self.duration, (self.seen - 1) * self.duration)]


def voiced(frames: list[bool], duration: float, buffer: int = 10, share: float = 0.9) -> list[tuple[float, float]]:
    """The stretches of a list of frames."""
    state = Voiced(duration, buffer, share)
    return [found for speech in frames for found in state.frame(speech)] + state.end()


class Block:
    """Turns of one block of frames for any case at its start. before: the last frames before it, `buffer` of them or all there are.

    A case is (open, since): whether a stretch is open, and how many frames the buffer holds. Full buffers that make a turn are found once by running sums; a
    buffer that fills up since a turn is looked up by the place of the frame that is one too many.
    """

    def __init__(self, before: str, frames: str, buffer: int, share: float):
        self.context, self.buffer, self.need = len(before), buffer, floor(share * buffer) + 1
        speech = np.frombuffer((before + frames).encode(), np.uint8) == ord("1")
        self.size, self.sides = len(speech), {}
        for opens, marks in ((False, speech), (True, ~speech)):  # an open stretch turns at unvoiced frames, a closed one at voiced
            sums = np.concatenate(([0], np.cumsum(marks)))
            full = np.flatnonzero(sums[buffer:] - sums[: max(len(sums) - buffer, 0)] >= self.need) + buffer - 1
            self.sides[opens] = sums, np.flatnonzero(marks), full

    def turn(self, is_open: bool, since: int) -> int | None:
        """Place of the frame at which the next turn comes, if it comes in this block; since: place of the buffer's first frame."""
        sums, marked, full = self.sides[is_open]
        at = sums[since] + self.need - 1
        if at < len(marked) and self.context <= marked[at] < since + self.buffer:
            return int(marked[at])
        k = np.searchsorted(full, max(since + self.buffer - 1, self.context))
        return int(full[k]) if k < len(full) else None

    def ends(self) -> list[int]:
        """The case at the end for each case at the start, as open * (buffer + 1) + held; -1 where so many frames have not been."""
        known: dict[tuple[bool, int], int] = {}
        out = []
        for is_open in (False, True):
            for held in range(self.buffer + 1):
                if held > self.context:
                    out.append(-1)
                    continue
                case, path = (is_open, self.context - held), []
                while case not in known:
                    path.append(case)
                    place = self.turn(*case)
                    if place is None:
                        known[case] = case[0] * (self.buffer + 1) + min(self.size - case[1], self.buffer)
                    else:
                        case = (not case[0], place + 1)
                for passed in path:
                    known[passed] = known[case]
                out.append(known[case])
        return out

    def turns(self, code: int) -> list[tuple[bool, int]]:
        """(opens, frame): the first frame of a stretch that opens, or the frame after one that closes, counted from the block's first frame."""
        is_open, held = divmod(code, self.buffer + 1)
        is_open, since, out = bool(is_open), self.context - held, []
        while (place := self.turn(is_open, since)) is not None:
            first = place + 1 - min(place + 1 - since, self.buffer)
            out.append((not is_open, (place + 1 if is_open else first) - self.context))
            is_open, since = not is_open, place + 1
        return out


def _mapped(df: DataFrame, schema: StructType, rows: Callable[[], Callable[[tuple], list[tuple]]]) -> DataFrame:
    """df through a function of a row that gives rows; rows() makes it once for each partition. Batches pass one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, target = rows(), to_arrow_schema(schema)
        for batch in batches:
            out = [new for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for new in own(row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(target)], schema=target)

    return df.mapInArrow(run, schema)


def voiced_segments(frames: DataFrame, duration: float = 0.03, buffer: int = 10, share: float = 0.9, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """utt_id, segment, start, end from frames (utt_id, i, is_speech) in the order of i.

    A frame's time is its place among those of its utterance. A null is_speech is unvoiced, a null i comes first, of equal i the unvoiced ones first; frames
    without an id are one utterance. An utterance is cut at multiples of `block_frames` in i (about dense, as an ordinal is) and runs in several tasks; a block is one
    string, a character for each frame.
    """
    kind = frames.schema["utt_id"].dataType
    key = StructField("utt_id", kind)
    rows = frames.select("utt_id", F.col("i").cast("double").alias("i"), F.when(F.coalesce("is_speech", F.lit(False)), "1").otherwise("0").alias("s"))
    rows = rows.withColumn("block", F.coalesce(block_of(F.col("i"), block_frames), F.lit(-(2**62))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("i").isNotNull().alias("known"), "i", "s"))), lambda x: x["s"]), "")
    blocks = rows.groupBy(F.struct("utt_id").alias("key"), "block").agg(text.alias("text"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(-buffer, -1)
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocks.select("key", "block", F.right("text", F.lit(buffer)).alias("tail"), F.length("text").cast("long").alias("n"))
    ends = ends.select("key", "block", F.right(F.array_join(F.collect_list("tail").over(before), ""), F.lit(buffer)).alias("before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), "n")
    given = blocks.join(ends.drop("n"), ["key", "block"]).select("key.utt_id", "block", "base", "before", "text")

    def maps() -> Callable[[tuple], list[tuple]]:
        return lambda r: [(r[0], r[1], Block(r[3], r[4], buffer, share).ends())]

    def walk() -> Callable[[tuple], list[tuple]]:
        utt, code, begun = None, 0, False

        def own(r: tuple) -> list[tuple]:
            nonlocal utt, code, begun
            if not begun or r[0] != utt:
                utt, code, begun = r[0], 0, True
            start, code = code, r[2][code]
            return [(r[0], r[1], start)]

        return own

    def turns() -> Callable[[tuple], list[tuple]]:
        return lambda r: [(r[0], opens, r[2] + at) for opens, at in Block(r[3], r[4], buffer, share).turns(r[5])]

    block = StructField("block", LongType())
    found = _mapped(given, StructType([key, block, StructField("ends", ArrayType(IntegerType()))]), maps)
    cases = _mapped(found.repartition("utt_id").sortWithinPartitions("utt_id", "block"), StructType([key, block, StructField("code", IntegerType())]), walk)
    cases = cases.withColumnsRenamed({"utt_id": "own", "block": "own_block"})
    placed = given.join(cases, F.col("utt_id").eqNullSafe(F.col("own")) & (F.col("block") == F.col("own_block"))).select("utt_id", "block", "base", "before", "text", "code")
    changes = _mapped(placed, StructType([key, StructField("opens", BooleanType()), StructField("at", LongType())]), turns)
    # turns alternate, and all of a stretch's places are distinct; a stretch that closes comes before one that opens at its end
    order = F.col("at") * 2 + F.col("opens").cast("int")
    numbered = running(changes.withColumn("order", order), ["utt_id"], "order", {"turn": ("count", F.lit(1))}, 2 * block_frames * TURN_BLOCKS)
    pairs = numbered.groupBy(F.struct("utt_id").alias("key"), F.floor((F.col("turn") - 1) / 2).cast("int").alias("segment")).agg(F.max(F.when(F.col("opens"), F.col("at"))).alias("a"), F.max(F.when(~F.col("opens"), F.col("at"))).alias("b"))
    total = ends.groupBy("key").agg(F.sum("n").alias("n"))
    last = (F.col("n") - 1) * duration
    return pairs.join(total, "key").select("key.utt_id", "segment", (F.col("a") * duration).alias("start"), F.coalesce((F.col("b") - 1) * duration + duration, last).alias("end"))
