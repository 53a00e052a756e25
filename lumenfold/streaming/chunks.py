"""Artifacts that arrive as chunks of bytes: one state an artifact, a row when its last chunk is in, whatever the order of arrival.

inspected_stream() keeps a summary of the chunks so far (see operators/incremental.py): a few bytes, counts and at most LOCATIONS places, not the
chunks. identified_stream() is for what cannot be told from summaries, the hash and the normal forms: it keeps each chunk as it came, once, and reads
them when all are there. An artifact none of whose missing chunks comes within `patience` has a row that says so, and its state goes. A stream with
patience looks at its timers again and again and so does not end by itself; without (None), states wait for ever, and availableNow ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import BIDI_CONTROL, DEFAULT_IGNORABLE, LOCATIONS
from ..functions.text import difference
from ..operators.incremental import COLUMNS, FINDINGS, SUMMARY, findings, merged, plain, summary

OUTPUT = "artifact_id string, byte_length long, content_sha256 string, valid_utf8 boolean, dicp_count long, dicp_first array<long>, bidi_count long, nfc_status string, nfkc_status string"
#: How long an artifact is waited for after its latest chunk, in milliseconds.
PATIENCE = 24 * 3600 * 1000
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_DICP = frozenset(c for a, b in DEFAULT_IGNORABLE for c in range(a, b + 1))


def result(artifact_id: str, content: bytes) -> dict:
    """What a whole artifact comes to; the same for any way it was cut."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = None
    dicp = [i for i, c in enumerate(text or "") if ord(c) in _DICP]
    return {
        "artifact_id": artifact_id,
        "byte_length": len(content),
        "content_sha256": hashlib.sha256(content).hexdigest(),
        "valid_utf8": text is not None,
        "dicp_count": len(dicp) if text is not None else None,
        "dicp_first": dicp[:LOCATIONS] if text is not None else None,
        "bidi_count": sum(ord(c) in BIDI_CONTROL for c in text) if text is not None else None,
        "nfc_status": "invalid" if text is None else "present" if difference(text, "NFC") else "absent",
        "nfkc_status": "invalid" if text is None else "present" if difference(text, "NFKC") else "absent",
    }


class _Patient(StatefulProcessor):
    """An artifact's chunks by number until the last one's number is known and none before it is missing."""

    def __init__(self, patience: int | None) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "next long, last long, timer long")
        self.open(handle)

    def wait(self, timers, following: int, last: int, timer: int) -> None:
        """Stores the progress and moves the artifact's one timer."""
        if timer >= 0:
            self.handle.deleteTimer(timer)
        at = -1
        if self.patience is not None:
            at = timers.getCurrentProcessingTimeInMs() + self.patience
            self.handle.registerTimer(at)
        self.progress.update((following, last, at))

    def stand(self) -> tuple[int, int, int]:
        return tuple(self.progress.get()) if self.progress.exists() else (0, -1, -1)

    def done(self, timer: int) -> None:
        if timer >= 0:
            self.handle.deleteTimer(timer)
        self.progress.clear()

    def close(self) -> None:
        pass


class _Summaries(_Patient):
    def open(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", f"s {SUMMARY}")
        self.early = handle.getMapState("early", "seq long", f"s {SUMMARY}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, last, timer = self.stand()
        whole = plain(self.so_far.get()[0]) if self.so_far.exists() else None
        for frame in rows:
            for s, is_last in zip(frame["s"], frame["is_last"], strict=True):
                s = plain(s)
                last = s["first_seq"] if is_last else last
                if s["first_seq"] == following:
                    whole, following = s if whole is None else merged(whole, s), following + 1
                elif s["first_seq"] > following:  # early: it waits for those before it
                    self.early.updateValue((s["first_seq"],), (s,))
                while self.early.exists() and self.early.containsKey((following,)):
                    whole = merged(whole, plain(self.early.getValue((following,))[0])) if whole else plain(self.early.getValue((following,))[0])
                    self.early.removeKey((following,))
                    following += 1
        if 0 <= last < following:
            self.done(timer)
            self.so_far.clear()
            self.early.clear()
            yield _row(key[0], findings(whole))
        else:
            if whole is not None:
                self.so_far.update((whole,))
            self.wait(timerValues, following, last, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        whole = plain(self.so_far.get()[0]) if self.so_far.exists() else None
        self.progress.clear()
        self.so_far.clear()
        self.early.clear()
        yield _row(key[0], dict.fromkeys(COLUMNS) | {"complete": False, "chunks": whole["chunks"] if whole else 0, "byte_length": whole["byte_length"] if whole else 0})


def _row(key: str, found: dict) -> pd.DataFrame:
    return pd.DataFrame({"artifact_id": [key], **{c: [found[c]] for c in COLUMNS}})


class _Chunks(_Patient):
    def open(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "seq long", "bytes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, last, timer = self.stand()
        for frame in rows:
            for seq, raw, is_last in zip(frame["chunk_seq"], frame["bytes"], frame["is_last"], strict=True):
                if not self.chunks.containsKey((int(seq),)):  # a chunk that was there already is a repeat
                    self.chunks.updateValue((int(seq),), (bytes(raw or b""),))
                last = int(seq) if is_last else last
        while self.chunks.containsKey((following,)):
            following += 1
        if 0 <= last < following:
            content = b"".join(bytes(self.chunks.getValue((i,))[0]) for i in range(last + 1))
            self.done(timer)
            self.chunks.clear()
            yield pd.DataFrame([result(key[0], content)])
        else:
            self.wait(timerValues, following, last, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.progress.clear()
        self.chunks.clear()
        yield pd.DataFrame([dict.fromkeys([x.split()[0] for x in OUTPUT.split(", ")]) | {"artifact_id": key[0]}])


def _stateful(chunks: DataFrame, processor: _Patient, output: str) -> DataFrame:
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # the only one that keeps several states a key
    return chunks.groupBy("artifact_id").transformWithStateInPandas(processor, output, "append", "None" if processor.patience is None else "ProcessingTime")


def inspected_stream(chunks: DataFrame, patience: int | None = PATIENCE) -> DataFrame:
    """From a stream (artifact_id, chunk_seq, bytes, is_last): one row an artifact, artifact_id and the columns of incremental.FINDINGS, in append
    mode. Chunks are summarized before they are exchanged; a repeated chunk counts once."""
    numbered = F.coalesce(F.col("chunk_seq").cast("long"), F.raise_error(F.lit("chunks need a number")).cast("long"))
    small = chunks.select("artifact_id", summary(numbered, F.col("bytes")).alias("s"), F.coalesce("is_last", F.lit(False)).alias("is_last"))
    return _stateful(small, _Summaries(patience), f"artifact_id string, {FINDINGS}")


def identified_stream(chunks: DataFrame, patience: int | None = PATIENCE) -> DataFrame:
    """From a stream (artifact_id, chunk_seq, bytes, is_last): one row an artifact with its hash and normal forms, in append mode; for an abandoned
    one all columns but artifact_id are null. Its bytes are in the state until it is whole."""
    return _stateful(chunks, _Chunks(patience), OUTPUT)
