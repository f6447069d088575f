"""Stateful processors: what a thread or a stream holds until it is complete or has been silent for long enough.

State lives in the state store (RocksDB). Segments of a stream have a key each, threads share keys by bucket, as most are small.
What is still open when a query ends is read from the store by ``open_rows`` and put out by the same expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "segment long, time long, role string, text string"
SUMS = "n long, first long, last long, spoken long, said string, ended long, ended_text string, expires long"
DELTA = "seq long, time long, reasoning string, content string"
COUNTS = "n long, last_seq long, expires long"
#: Threads are dealt over so many keys.
THREAD_BUCKETS = 8192
#: Rows of a bucket's list that are packed into one element, column by column: turning a row into state costs more than its contents.
PACKED = 4096


class _Expiring(StatefulProcessor):
    """One timer per key, moved on with the latest time seen."""

    ttl_ms: int

    def _renew(self, old: int | None, last_us: int) -> int:
        expires = -(-last_us // 1000) + self.ttl_ms
        if old != expires:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(expires)
        return expires

    def close(self) -> None:
        pass


def packed(columns: str) -> str:
    """The schema of many such rows as one, an array for each column."""
    return ", ".join("{} array<{}>".format(*c.split(" ", 1)) for c in columns.split(", "))


def _append(state, rows: list[tuple]) -> None:
    for i in range(0, len(rows), PACKED):
        state.appendValue(tuple(map(list, zip(*rows[i : i + PACKED]))))


class ThreadState(StatefulProcessor):
    """Input rows: bucket, thread, time (microseconds), role, text. A thread that expires after its last use comes out as its segments.

    A key is a bucket of threads, so that a call to the store, which costs far more than a row, serves many of them: one list has the
    sums of the bucket's open threads, one the messages of segments that are not full (both packed), and one timer stands at the first
    expiry. Full segments lie in a map, are written once and never held together.
    """

    def __init__(self, thread_type: str, ai: str, ttl_ms: int, width: int):
        self.thread_type, self.ai, self.ttl_ms, self.width = thread_type, ai, ttl_ms, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", packed(f"thread {self.thread_type}, {MESSAGE}"))
        self.full = handle.getMapState("full", f"thread {self.thread_type}, segment long", "messages array<struct<time: long, role: string, text: string>>")
        self.sums = handle.getListState("sums", packed(f"thread {self.thread_type}, {SUMS}"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, timer = self._held()
        yield from self._expired(held, timerValues.getCurrentWatermarkInMs())  # the timer comes after this batch's rows
        stored = {t for t, s in held.items() if s[0] % self.width}  # threads with messages in the history
        added: dict = {}
        waiting = 0
        for r in rows:
            thread, time, role, text = r.thread, r.time, r.role, r.text
            s = held.get(thread)
            if s is None:
                s = held[thread] = [0, time, time, None, None, None, None, None]
            added.setdefault(thread, []).append((time, role, text))
            s[0], s[1], s[2], waiting = s[0] + 1, min(s[1], time), max(s[2], time), waiting + 1
            if role == self.ai and text and (s[3] is None or (time, text) > (s[3], s[4])):
                s[3], s[4] = time, text
            if text is not None and (s[5] is None or (time, text) > (s[5], s[6])):
                s[5], s[6] = time, text
            if s[0] % self.width == 0:
                new = added.pop(thread)
                waiting -= len(new)
                if thread in stored:
                    new = self._taken({thread})[thread] + new
                    stored.discard(thread)
                self.full.updateValue((thread, s[0] // self.width - 1), (new,))
            elif waiting >= PACKED:
                self._store(held, added)
                stored.update(added)
                added, waiting = {}, 0
        self._store(held, added)
        for s in held.values():
            s[7] = -(-s[2] // 1000) + self.ttl_ms
        self._keep(held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, timer = self._held()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if timer == fired:
            yield from self._expired(held, max(fired, timerValues.getCurrentWatermarkInMs()))
            self._keep(held, None)  # a timer that has fired is gone

    def _held(self) -> tuple[dict, int | None]:
        """The sums of all open threads, and where the timer stands."""
        held = {thread: sums for columns in self.sums.get() for thread, *sums in zip(*columns)}
        return held, min((s[7] for s in held.values()), default=None)

    def _keep(self, held: dict, timer: int | None) -> None:
        self.sums.clear()
        _append(self.sums, [(thread, *s) for thread, s in held.items()])
        first = min((s[7] for s in held.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def _store(self, held: dict, added: dict) -> None:
        """Messages of segments that are not full."""
        _append(self.history, [(thread, held[thread][0] // self.width, *m) for thread, messages in added.items() for m in messages])

    def _taken(self, threads) -> dict:
        """The messages of these threads out of the history, in the order of arrival; the others stay."""
        taken, others = {thread: [] for thread in threads}, []
        for columns in self.history.get():
            for row in zip(*columns):
                if row[0] in taken:
                    taken[row[0]].append(row[2:])
                else:
                    others.append(row)
        self.history.clear()
        _append(self.history, others)
        return taken

    def _expired(self, held: dict, watermark: int) -> Iterator[Row]:
        """Put out and forget the threads whose time is over."""
        over = {thread: s for thread, s in held.items() if s[7] <= watermark}
        tails = self._taken(over) if any(s[0] % self.width for s in over.values()) else {}
        for thread, s in over.items():
            del held[thread]
            whole = s[0] // self.width
            for segment in range(whole):
                (messages,) = self.full.getValue((thread, segment))
                self.full.removeKey((thread, segment))
                yield self._row(thread, s, segment, [tuple(m) for m in messages])
            if tails.get(thread):
                yield self._row(thread, s, whole, tails[thread])

    @staticmethod
    def _row(thread, sums, segment, part) -> Row:
        n, first, last, _, said, _, ended_text, _ = sums
        part.sort(key=lambda m: tuple((x is not None, x) for x in m))
        history = [Row(time=t, role=r, text=x) for t, r, x in part]
        response = said if said is not None else (ended_text if ended_text is not None else "")
        return Row(thread=thread, segment=segment, n_messages=n, first_time=first, last_time=last, response=response, history=history)


THREAD_OUT = (
    "segment long, n_messages long, first_time long, last_time long, response string, "
    "history array<struct<time: long, role: string, text: string>>"
)


class ChunkState(_Expiring):
    """Input rows: stream, segment, seq, time (microseconds), reasoning, content, last. A key holds one segment of a stream.

    It comes out when all its deltas are there (as many as a segment has, or up to the one that is marked as the last) and otherwise
    when it has been silent for ``ttl_ms``. Of a delta that is sent twice the later one counts; what is sent again after its segment
    came out is ignored as long as the segment's silence lasts.
    """

    def __init__(self, ttl_ms: int, width: int):
        self.ttl_ms, self.width = ttl_ms, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deltas = handle.getListState("deltas", DELTA)
        self.counts = handle.getValueState("counts", COUNTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.counts.get()
        if held is not None and held[2] <= timerValues.getCurrentWatermarkInMs():
            self.handle.deleteTimer(held[2])
            if held[0] > 0:
                yield self._out(key, self._found())
            held = None
        n, last_seq, expires = held or (0, None, None)
        if n < 0:
            return
        new = []
        for r in rows:
            new.append((r.seq, r.time, r.reasoning, r.content))
            if r.last:
                last_seq = r.seq if last_seq is None else max(r.seq, last_seq)
        if not new:
            return
        self.deltas.appendList(new)
        n += len(new)
        need = self.width if last_seq is None else last_seq % self.width + 1
        if n >= need:
            found = self._found()
            if len(found) >= need:
                yield self._out(key, found)
                n = -1
        latest = max(d[1] for d in new)
        if expires is not None:
            latest = max(latest, (expires - self.ttl_ms) * 1000)
        self.counts.update((n, last_seq, self._renew(expires, latest)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        counts = self.counts.get()
        if counts is not None and counts[2] == expiredTimerInfo.getExpiryTimeInMs():
            if counts[0] > 0:
                yield self._out(key, self._found())
            self.counts.clear()

    def _found(self) -> dict[int, tuple]:
        found: dict[int, tuple] = {}
        for seq, time, reasoning, content in sorted(self.deltas.get(), key=lambda d: d[1]):
            found[seq] = (reasoning, content)
        return found

    def _out(self, key, found) -> Row:
        self.deltas.clear()
        texts = [found[s] for s in sorted(found)]
        return Row(
            stream=key[0], segment=key[1], n_deltas=len(found),
            reasoning="".join(r for r, _ in texts if r is not None), content="".join(c for _, c in texts if c is not None),
        )


CHUNK_OUT = "segment long, n_deltas long, reasoning string, content string"


def open_rows(spark: SparkSession, checkpoint: str, name: str, keys: list[str]) -> DataFrame:
    """Rows of the list state ``name`` that a stopped query has left in its store, beside the columns of their key."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    return rows.select(*[F.col(f"key.{k}").alias(k) for k in keys], F.col("list_element.*"))


def open_messages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(thread, segment, time, role, text): the messages of the threads that a stopped query has left in its store."""
    full = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "full").load()
    full = full.select("user_map_key.thread", "user_map_key.segment", F.inline("user_map_value.messages"))
    tails = open_rows(spark, checkpoint, "history", [])
    return tails.select(F.inline(F.arrays_zip(*tails.columns))).unionByName(full)


def threads_of(messages: DataFrame, ai: str) -> DataFrame:
    """Rows (thread, segment, time, role, text) to what ``ThreadState`` puts out. Histories are bounded by their segment."""

    def latest(column: Column, when: Column) -> Column:
        return F.max(F.when(when, F.struct(F.col("time").alias("t"), column.alias("x"))))

    parts = messages.groupBy("thread", "segment").agg(
        F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("b"),
        latest(F.col("text"), (F.col("role") == ai) & (F.length("text") > 0)).alias("said"), latest(F.col("text"), F.col("text").isNotNull()).alias("ended"),
        F.array_sort(F.collect_list(F.struct("time", "role", "text"))).alias("history"),
    )
    sums = parts.groupBy("thread").agg(
        F.sum("n").alias("n_messages"), F.min("a").alias("first_time"), F.max("b").alias("last_time"), F.max("said").alias("said"), F.max("ended").alias("ended")
    )
    response = F.coalesce("said.x", "ended.x", F.lit("")).alias("response")
    return parts.select("thread", "segment", "history").join(sums, "thread").select("thread", "segment", "n_messages", "first_time", "last_time", response, "history")


def chunks_of(deltas: DataFrame) -> DataFrame:
    """Rows (stream, segment, seq, reasoning, content) to what ``ChunkState`` puts out; of a delta sent twice the last one counts."""

    def joined(column: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", column))), lambda x: x[column]), "").alias(column)

    once = deltas.groupBy("stream", "segment", "seq").agg(F.max_by("reasoning", F.coalesce("time", F.lit(0))).alias("reasoning"), F.max_by("content", F.coalesce("time", F.lit(0))).alias("content"))
    return once.groupBy("stream", "segment").agg(F.count("*").alias("n_deltas"), joined("reasoning"), joined("content"))
