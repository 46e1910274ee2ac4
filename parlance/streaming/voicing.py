"""Voiced stretches of live frames, with the state of one buffer for each utterance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.voicing import Voiced


def streaming_voiced_segments(frames: DataFrame, duration: float = 0.03, buffer: int = 10, share: float = 0.9, late: str = "10 seconds", silence_ms: int = 60_000) -> DataFrame:
    """utt_id (string), segment, start, end of a stream of frames (utt_id, i, is_speech, ts), each stretch as soon as it closes.

    Frames of an utterance have to arrive in the order of i from one micro-batch to the next; inside a batch they are sorted. A null is_speech is unvoiced, frames
    without an id are one utterance. An utterance without frames for `silence_ms` of event time is over: a stretch still open ends as in the batch
    operator, and later frames begin a new one.
    """

    def own(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        voice, segment, latest = Voiced(duration, buffer, share), 0, 0
        if state.exists:
            opened, seen, held, segment, latest = state.get
            voice.opened, voice.seen = (None if opened < 0 else opened), seen
            voice.held.extend(c == "1" for c in held)
        if state.hasTimedOut:
            state.remove()
            found = voice.end()
        else:
            rows = pd.concat(list(batches)).sort_values(["i", "is_speech"], na_position="first")
            found = [x for speech in rows["is_speech"] for x in voice.frame(speech)]
            latest = max(latest, int(rows["ms"].max()), state.getCurrentWatermarkMs())
            state.update((-1 if voice.opened is None else voice.opened, voice.seen, "".join("01"[x] for x in voice.held), segment + len(found), latest))
            state.setTimeoutTimestamp(latest + silence_ms)
        yield pd.DataFrame({"utt_id": [key[0]] * len(found), "segment": range(segment, segment + len(found)), "start": [a for a, _ in found], "end": [b for _, b in found]})

    rows = frames.withWatermark("ts", late).selectExpr("ts", "CAST(utt_id AS STRING) AS utt_id", "CAST(i AS DOUBLE) AS i", "coalesce(is_speech, false) AS is_speech", "coalesce(unix_millis(CAST(ts AS TIMESTAMP)), 0L) AS ms")
    out = "utt_id string, segment int, start double, end double"
    return rows.groupBy("utt_id").applyInPandasWithState(own, out, "opened long, seen long, held string, segment int, latest long", "append", GroupStateTimeout.EventTimeTimeout)
