"""Results per key where a few keys hold most rows: dense accumulator arrays instead of a shuffle by key.

Every input split is reduced to one array a measure, indexed by the key's code, with numpy's bincount and scatter
functions; the arrays are cut into blocks, and the blocks are summed as arrays in a distributed reduction. What moves is (splits x keys) numbers, whatever the
share of the largest key, and no task sees more rows than its split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
MAX_KEYS = 1 << 20
FAN = 32


def _coder(dictionary: dict, normal: Callable | None):
    """Codes of one Arrow column; len(dictionary) for values it doesn't name. Each distinct spelling is looked up once."""
    other = len(dictionary)

    def code(column: pa.Array) -> np.ndarray:
        encoded = column.dictionary_encode()
        codes = np.array([dictionary.get(normal(x) if normal and x is not None else x, other) for x in encoded.dictionary.to_pylist()] + [other], dtype=np.int64)
        return codes[encoded.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]

    return code


def accumulate(df: DataFrame, key: str, dictionary: dict, beg: str, end: str, normal: Callable | None = None) -> DataFrame:
    """code, n_rows, n_valid, n_bases, min_beg, max_end: sums over the rows of each key of the dictionary.

    dictionary maps keys to the codes 0..n-1 and is a fixed list of at most MAX_KEYS entries; rows with another or a
    null key count under the code n, so no row is dropped. n_valid and n_bases count rows whose closed interval is
    neither null nor reversed, min_beg and max_end are taken over those. normal brings a key to the dictionary's form.
    Codes without rows give no row; an empty table gives none.
    """
    n = len(dictionary)
    if n > MAX_KEYS:
        raise ValueError(f"{n} keys; dense accumulators take at most {MAX_KEYS}")
    width = -(-(n + 1) // BLOCK) * BLOCK
    code = _coder(dictionary, normal)
    low, high = np.iinfo(np.int64).max, np.iinfo(np.int64).min

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, valid, bases = (np.zeros(width, np.int64) for _ in range(3))
        first, last = np.full(width, low), np.full(width, high)
        for batch in batches:
            k = code(batch.column(0))
            rows += np.bincount(k, minlength=width)
            b, e = batch.column(1), batch.column(2)
            whole = b.is_valid().to_numpy(zero_copy_only=False) & e.is_valid().to_numpy(zero_copy_only=False)
            b, e = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (b, e))
            whole &= e >= b
            k, b, e = k[whole], b[whole], e[whole]
            valid += np.bincount(k, minlength=width)
            np.add.at(bases, k, e - b + 1)
            np.minimum.at(first, k, b)
            np.maximum.at(last, k, e)
        used = [i for i in range(0, width, BLOCK) if rows[i : i + BLOCK].any()]
        arrays = [pa.array([a[i : i + BLOCK] for i in used], pa.list_(pa.int64())) for a in (rows, valid, bases, first, last)]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *arrays], ["at", "n_rows", "n_valid", "n_bases", "min_beg", "max_end"])

    names = ["n_rows", "n_valid", "n_bases", "min_beg", "max_end"]
    schema = "at long, " + ", ".join(f"{c} array<long>" for c in names)
    folds = (np.add, np.add, np.add, np.minimum, np.maximum)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums the arrays of each block as they come in; what is held are the blocks of this partition, once each."""
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            columns = [batch.column(i + 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, BLOCK) for i in range(len(names))]
            for row, at in enumerate(batch.column(0).to_pylist()):
                if at in held:
                    for f, mine, c in zip(folds, held[at], columns):
                        f(mine, c[row], out=mine)
                else:
                    held[at] = [c[row].copy() for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *(pa.array([x[i] for x in held.values()], pa.list_(pa.int64())) for i in range(len(names)))], ["at", *names])

    # The reduction runs in two steps, so that the splits' arrays of one block are not all one task's to sum.
    blocks = df.select(df[key].alias("_k"), df[beg].alias("_b"), df[end].alias("_e")).mapInArrow(split, schema)
    part = blocks.repartition("at", F.pmod(F.spark_partition_id(), F.lit(FAN))).mapInArrow(fold, schema)
    whole = part.repartition("at").mapInArrow(fold, schema)
    cells = whole.select("at", F.posexplode(F.arrays_zip(*names)).alias("i", "x")).where(F.col("x.n_rows") > 0)
    valid = F.col("x.n_valid") > 0
    return cells.select((F.col("at") + F.col("i")).alias("code"), "x.n_rows", "x.n_valid", "x.n_bases", F.when(valid, F.col("x.min_beg")).alias("min_beg"), F.when(valid, F.col("x.max_end")).alias("max_end"))


def _contig_key(chrom: str) -> str:
    key = chrom.strip(" ").lower()
    return key[3:] if key.startswith("chr") else key


def per_contig(vntr: DataFrame, beds: DataFrame, contigs: DataFrame) -> DataFrame:
    """src, rid, n_rows, n_valid, n_bases, min_beg, max_end of every contig in vntr (by rid) and bed_record (by the contig
    that chrom names); rid is null for rows whose contig isn't in the list. Rows are counted as often as they stand there."""
    known = [(r[0], r[1]) for r in contigs.select("rid", "contig_name").where("rid is not null").orderBy("rid").collect()]
    code = {rid: i for i, (rid, _) in enumerate(known)}
    names = {name.lower(): code[rid] for rid, name in known if name is not None}
    spell = dict(names)
    # Names share codes with rids; both dictionaries must be as long as the list.
    by_name = {**spell, **{("", i): i for i in range(len(known)) if i not in set(names.values())}}
    rids = beds.sparkSession.createDataFrame([(i, rid) for rid, i in code.items()] or [(0, None)], "code long, rid int")
    v = accumulate(vntr, "rid", code, "beg1", "end1").select(F.lit("vntr").alias("src"), "*")
    b = accumulate(beds, "chrom", by_name, "beg1", "end1", _contig_key).select(F.lit("bed_record").alias("src"), "*")
    return v.unionByName(b).join(rids, "code", "left").select("src", "rid", "n_rows", "n_valid", "n_bases", "min_beg", "max_end")


def heavy_contigs(per: DataFrame, share: float = 0.05) -> DataFrame:
    """src, rid of the contigs with at least this share of all rows of their table, rows without a contig counted in."""
    total = F.sum("n_rows").over(Window.partitionBy("src"))  # over one row a contig, not over the tables' rows
    return per.withColumn("_all", total).where(F.col("rid").isNotNull() & (F.col("n_rows") >= F.col("_all") * share)).select("src", "rid")
