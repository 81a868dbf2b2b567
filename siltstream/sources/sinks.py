"""Sinks: a small interface that a user can implement, and the built-in ones."""

from __future__ import annotations

import hashlib
import re
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import has_newline, http_class

#: A status, or a status and the seconds that the receiver asks to wait.
Reply = int | tuple[int, int | None]


class Sink(ABC):
    """commit() adds ``outcome`` (committed, rejected or retry) and ``reason`` to the records of a batch, and may add
    ``retry_after`` (seconds).

    The records have ``shard_id``, ``batch_no`` and ``seq``; a batch of a shard has at most ``max_batch_size`` of them.
    commit may run again for the same records, so a sink should write them under the same keys then.
    """

    max_batch_size = 1000

    @abstractmethod
    def commit(self, batch: DataFrame) -> DataFrame: ...

    def health(self) -> tuple[str, str | None]:
        return "healthy", None


class NoopSink(Sink):
    """Accepts and discards everything."""

    def commit(self, batch: DataFrame) -> DataFrame:
        return batch.select("*", F.lit("committed").alias("outcome"), F.lit(None).cast("string").alias("reason"))


class ParquetSink(Sink):
    """A folder with one partition per epoch; a replay of an epoch replaces what it had written."""

    def __init__(self, path: str):
        self.path = path

    def commit(self, batch: DataFrame) -> DataFrame:
        if "epoch" in batch.columns:
            batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(self.path)
        else:
            batch.write.mode("append").parquet(self.path)
        return NoopSink().commit(batch)


def _plain_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*", name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name


class JdbcSink(Sink):
    """Appends one binary column.

    With ``ignore_duplicates`` the records go to a staging table of the database, and one statement there takes over
    those that the table doesn't hold; the table is never read by Spark.  ``statements`` replaces the three statements
    (create, take over, drop) where a dialect has better ones, such as INSERT IGNORE or ON CONFLICT DO NOTHING.
    """

    STATEMENTS = (
        "CREATE TABLE {staging} AS SELECT {column} FROM {table} WITH NO DATA",
        "INSERT INTO {table} ({column}) SELECT DISTINCT s.{column} FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE t.{column} = s.{column})",
        "DROP TABLE {staging}",
    )

    def __init__(self, url: str, table: str, column: str = "payload", ignore_duplicates: bool = False, statements: tuple[str, str, str] = STATEMENTS, **properties: str):
        self.url, self.table, self.column, self.ignore, self.statements, self.properties = url, _plain_name(table), _plain_name(column), ignore_duplicates, statements, properties

    def _run(self, batch: DataFrame, statement: str, staging: str) -> None:
        jvm = batch.sparkSession._jvm
        settings = jvm.java.util.Properties()
        for k, v in self.properties.items():
            settings.setProperty(k, v)
        if "driver" in self.properties:
            jvm.java.lang.Class.forName(self.properties["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, settings)
        try:
            connection.createStatement().execute(statement.format(staging=staging, table=self.table, column=self.column))
        finally:
            connection.close()

    def commit(self, batch: DataFrame) -> DataFrame:
        rows = batch.select(F.col("payload").alias(self.column))
        if not self.ignore:
            rows.write.jdbc(self.url, self.table, mode="append", properties=self.properties)
            return NoopSink().commit(batch)
        create, take_over, drop = self.statements
        staging = f"staging_{uuid.uuid4().hex[:12]}"
        self._run(batch, create, staging)
        try:
            rows.write.jdbc(self.url, staging, mode="append", properties=self.properties)
            self._run(batch, take_over, staging)
        finally:
            self._run(batch, drop, staging)
        return NoopSink().commit(batch)


def _sha256(body: bytes) -> str:
    return "sha256:" + hashlib.sha256(body).hexdigest()


def _reply(found: Reply) -> tuple[int, int | None]:
    status, wait = found if isinstance(found, tuple) else (found, None)
    return status, wait if wait is not None and 1 <= wait <= 3600 else None


def _judged(sent: DataFrame, columns: list[str]) -> DataFrame:
    kind = http_class(F.col("_status"))
    outcome = F.when(F.col("_bad"), "rejected").when(kind == "ok", "committed").when(kind == "transient", "retry").otherwise("rejected")
    reason = F.when(F.col("_bad"), "line_end").when(kind != "ok", F.concat(F.lit("status "), F.col("_status").cast("string")))
    return sent.select(*columns, outcome.alias("outcome"), reason.alias("reason"), F.col("_after").alias("retry_after"))


class HttpSink(Sink):
    """One request per record, or with ``lines`` one per batch; ``send(body, key) -> status`` is given by the caller, and
    may return (status, seconds to wait).

    Requests run where the partitions are.  By record, up to ``concurrency`` of a partition are in flight, and outcomes
    keep the order of records.  By lines, all records of a (shard, batch) are one body in order of seq, so its key is
    the same whenever the batch is sent; records that hold a line end can't be framed and are rejected.
    """

    def __init__(self, send: Callable[[bytes, str], Reply], lines: bool = False, concurrency: int = 8):
        self.send, self.lines, self.concurrency = send, lines, concurrency

    def frame(self, payloads: list[bytes]) -> tuple[bytes, str]:
        """(body, key) of a batch."""
        body = b"\n".join(payloads)
        return body, _sha256(body)

    def cannot_be_framed(self, payload: Column) -> Column:
        return has_newline(payload) if self.lines else F.lit(False)

    def commit(self, batch: DataFrame) -> DataFrame:
        send, frame, flights = self.send, self.frame, self.concurrency
        marked = batch.select("*", self.cannot_be_framed(F.col("payload")).alias("_bad"))
        schema = T.StructType([*marked.schema.fields, T.StructField("_status", T.IntegerType()), T.StructField("_after", T.IntegerType())])

        def add(part: pd.DataFrame, good: pd.Index, replies: list[tuple[int, int | None]]) -> pd.DataFrame:
            status, after = pd.Series(0, index=part.index, dtype="int32"), pd.Series(None, index=part.index, dtype="Int32")
            status[good], after[good] = [r[0] for r in replies], [pd.NA if r[1] is None else r[1] for r in replies]
            return part.assign(_status=status, _after=after)

        def by_record(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(flights) as pool:
                for part in parts:
                    bodies = [bytes(p) for p in part["payload"]]
                    yield add(part, part.index, [_reply(r) for r in pool.map(lambda b: send(b, _sha256(b)), bodies)])

        def by_batch(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("seq")
            good = part.index[~part["_bad"]]
            replies = [_reply(send(*frame([bytes(p) for p in part.loc[good, "payload"]])))] * len(good) if len(good) else []
            return add(part, good, replies)

        if not self.lines:
            return _judged(marked.mapInPandas(by_record, schema), batch.columns)
        keys = [c for c in ("epoch", "shard_id", "batch_no") if c in batch.columns]
        return _judged(marked.groupBy(*keys).applyInPandas(by_batch, schema), batch.columns)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n % 128 + 128)
        n //= 128
    return bytes([*out, n])


class ClickHouseSink(HttpSink):
    """One INSERT per batch in RowBinary, with a token by which the server drops a batch that it already holds.

    ``send(body, token)`` posts the body with ``self.statement`` as the query and the token as insert_deduplication_token.
    The token covers the length and bytes of all records in order, so it is the same for the same batch only.
    """

    def __init__(self, send: Callable[[bytes, str], Reply], table: str, column: str = "payload"):
        super().__init__(send, lines=True)
        self.statement = f"INSERT INTO {_plain_name(table)} ({_plain_name(column)}) FORMAT RowBinary"

    def frame(self, payloads: list[bytes]) -> tuple[bytes, str]:
        token = hashlib.sha256(b"".join(part for p in payloads for part in (len(p).to_bytes(8, "little"), p))).hexdigest()
        return b"".join(part for p in payloads for part in (_varint(len(p)), p)), token

    def cannot_be_framed(self, payload: Column) -> Column:
        return F.lit(False)
