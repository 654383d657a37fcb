"""Event-time versions of ordered scans: order repair within a window, running counts, first deliveries, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stranda.functions import alleles as A

ORDERED = "rid int, pos int, row_id long, ref string, alt string, late boolean"


def repaired_order(stream: DataFrame, window: int = 10_000) -> DataFrame:
    """rid, pos, row_id, ref, alt, late: each contig's records in the order of positions, as far as a window allows.

    A record is held until one more than `window` bases farther on has come, then it goes out in order; one that comes
    after its place has gone out is sent on at once and marked late. What is held at the end of a finite stream goes out
    with a record of the contig far enough on, or stays held. The state of a contig is the records of one window.
    """
    schema = "rows array<struct<pos:int,row_id:bigint,ref:string,alt:string>>, sent int"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, sent = state.get if state.exists else ([], 0)
        rows = [(r["pos"], r["row_id"], r["ref"], r["alt"]) if not isinstance(r, tuple) else tuple(r) for r in held]
        out = []
        for x in batches:
            for r in x[["pos", "row_id", "ref", "alt"]].itertuples(index=False, name=None):
                (out if r[0] < sent else rows).append((int(r[0]), int(r[1]), r[2], r[3]))
        late = [(*r, True) for r in out]
        rows.sort()
        limit = rows[-1][0] - window if rows else 0
        go = [r for r in rows if r[0] <= limit]
        rows = rows[len(go) :]
        if go:
            sent = max(sent, go[-1][0])
        state.update((rows, sent))
        done = late + [(*r, False) for r in go]
        yield pd.DataFrame([(key[0], *r) for r in done], columns=["rid", "pos", "row_id", "ref", "alt", "late"])

    rows = stream.where("rid is not null and pos is not null").select("rid", "pos", "row_id", "ref", F.array_join("alts", ",").alias("alt"))
    return rows.groupBy("rid").applyInPandasWithState(step, ORDERED, schema, "append", GroupStateTimeout.NoTimeout)


def running_types(stream: DataFrame) -> DataFrame:
    """vt, n, ts, tv: counts by variant type so far; for the output modes complete and update."""
    c = A.classified(stream).select(A.type_name(F.col("vtype")).alias("vt"), "ts", "tv")
    return c.groupBy("vt").agg(F.count("*").alias("n"), F.sum("ts").alias("ts"), F.sum("tv").alias("tv"))


def first_deliveries(stream: DataFrame, keys: list[str], at: str, lateness: str = "2 days") -> DataFrame:
    """Rows without those delivered again within the lateness; the state forgets keys older than that."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def sessions(rows: DataFrame, key: str, at: str, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """key, session_start, session_end (of the last row, without the gap), n: runs of rows no farther apart than the gap.

    Works on tables and, with a lateness, on streams. Rows with a null key are a key of their own, null times are left
    out."""
    src = rows.withWatermark(at, lateness) if lateness else rows
    g = src.where(F.col(at).isNotNull()).groupBy(F.col(key), F.session_window(F.col(at), gap).alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("session_end"))
    return g.select(key, F.col("w.start").alias("session_start"), "session_end", "n")
