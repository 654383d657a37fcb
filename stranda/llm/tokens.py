"""Encoding of the whole corpus with the byte-level BPE of a public tokenizer, by recursive queries over token positions.

Per batch of texts DuckDB cuts the texts into words; words seen before have their ids already. The new ones become rows
(word, position, token of one byte), and a recursive query joins neighbouring tokens to the merge table and contracts
each word's leftmost pair of least rank until no pair is left; an ordered aggregation makes lists of the rows. Ids are
then gathered along the words of each text. Nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# The classes and contractions of the tokenizer's word pattern. White space is the Unicode property.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}\x{{%s}}]+|[{SPACE}]+"

SLICE = 2 << 20
CACHE_BYTES = 32 << 20

# DuckDB's expressions have no lookahead: white space before a word gives its last character to what follows, so a mark
# that the texts don't hold, a character for private use, is put before that character, and no word reaches over the mark.
CUT = f"SELECT regexp_extract_all(regexp_replace(text, '([{SPACE}])([{SPACE}][^{SPACE}])', '\\1' || $mark || '\\2', 'g'), $words) AS w FROM texts"

# Each round contracts a word's leftmost pair of least rank, and in the same round the further places of that pair that
# the next rounds would come to: of places side by side every other one from the left. A merge never makes a pair of a
# lower rank, so the ids are those of one place a round, and the rounds are as many as there are ranks, not places.
CONTRACT = """
WITH RECURSIVE bpe(word, pos, tok, open) AS (
  SELECT word, pos, tok, true FROM bytes
  UNION ALL (
    WITH near AS (
      SELECT word, pos, tok, lead(tok) OVER w AS nxt, row_number() OVER w AS n FROM bpe WHERE open WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
      SELECT n.word, n.pos, n.tok, n.n, m.rank, m.merged FROM near n LEFT JOIN merges m ON m.pair = n.tok::BIGINT * 65536 + n.nxt
    ), best AS (
      SELECT word, min(rank) AS best FROM ranked WHERE rank IS NOT NULL GROUP BY word
    ), hits AS (
      SELECT r.word, r.n, r.n - row_number() OVER (PARTITION BY r.word ORDER BY r.n) AS stretch FROM ranked r JOIN best b ON b.word = r.word AND b.best = r.rank
    ), taken AS (
      SELECT word, n FROM (SELECT word, n, row_number() OVER (PARTITION BY word, stretch ORDER BY n) % 2 = 1 AS take FROM hits) WHERE take
    )
    SELECT r.word, r.pos, CASE WHEN t.n IS NOT NULL THEN r.merged ELSE r.tok END, b.best IS NOT NULL
    FROM ranked r LEFT JOIN best b ON b.word = r.word LEFT JOIN taken t ON t.word = r.word AND t.n = r.n LEFT JOIN taken g ON g.word = r.word AND g.n = r.n - 1
    WHERE g.n IS NULL
  )
)
SELECT word, list(tok ORDER BY pos) AS ids FROM bpe WHERE NOT open GROUP BY word ORDER BY word
"""


def marks() -> Iterator[str]:
    return map(chr, (*range(0x10FFFD, 0xEFFFF, -1), *range(0xF8FF, 0xDFFF, -1)))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def load_merges(path: str = TOKENIZER) -> dict:
    """The merge table as arrays: pair (left * 65536 + right), rank = place, merged id; and the id of each byte."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right, merged = (np.array([vocab[x] for x in side], dtype=np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
    return {"pair": left * 65536 + right, "merged": merged.astype(np.int32), "byte": np.array([vocab[c] for c in byte_letters()], dtype=np.int32)}


class Encoder:
    """Ids of texts; words met once are kept, up to CACHE_BYTES, then forgotten and met anew."""

    def __init__(self, merges: dict):
        import duckdb

        self.byte = merges["byte"]
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1; SET memory_limit = '500MB'")
        n = len(merges["pair"])
        self.con.register("m", pa.table({"pair": merges["pair"], "rank": np.arange(n, dtype=np.int32), "merged": merges["merged"]}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.con.unregister("m")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.starts, self.flat, self.sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.total = 0

    def words(self, texts: pa.Array) -> pa.ListArray:
        mark = next(m for m in marks() if not pc.any(pc.match_substring(texts, m)).as_py())
        self.con.register("texts", pa.table({"text": texts}))
        out = self.con.sql(CUT, params={"mark": mark, "words": WORDS % f"{ord(mark):x}"}).to_arrow_table().column("w").combine_chunks()
        self.con.unregister("texts")
        return out.chunk(0) if isinstance(out, pa.ChunkedArray) else out

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.con.register("bytes", pa.table({"word": np.repeat(np.arange(len(raw), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "tok": self.byte[data]}))
        got = self.con.sql(CONTRACT).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("bytes")
        got = got.chunk(0) if isinstance(got, pa.ChunkedArray) else got
        edges = got.offsets.to_numpy()
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.held += sum(map(len, raw)) + 200 * len(words)
        n = np.diff(edges).astype(np.int64)
        self.starts.append(self.total + np.cumsum(n) - n)
        self.sizes.append(n)
        self.flat.append(got.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
        self.total += int(n.sum())

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids for each text; empty for an empty and for a null text."""
        words = self.words(pc.fill_null(texts, ""))
        edges = words.offsets.to_numpy() - words.offsets[0].as_py()
        encoded = words.flatten().dictionary_encode()
        spelt = encoded.dictionary.to_pylist()
        if self.held > CACHE_BYTES:
            self.forget()
        fresh = [w for w in spelt if w not in self.known]
        if fresh:
            self.learn(fresh)
            self.starts, self.sizes, self.flat = ([np.concatenate(x)] for x in (self.starts, self.sizes, self.flat))
        where = np.array([self.known[w] for w in spelt], dtype=np.int64)[encoded.indices.to_numpy()] if spelt else np.zeros(0, np.int64)
        n = self.sizes[0][where]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.starts[0][where] - (ends - n), n)
        offsets = np.concatenate([[0], ends])[edges].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.flat[0][source]))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about this many bytes of the column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def encode_corpus(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids: the token ids of each text, without special tokens (their strings are ordinary text).

    One row for each row of docs, also where doc_id is null or stands there twice; an empty or null text has an empty
    list. The merge table (50,000 rows of the vocabulary file, whatever the corpus) is broadcast.
    """
    merges = docs.sparkSession.sparkContext.broadcast(load_merges(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(merges.value)
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), encoder.encode(part.column("text"))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(ids: list[int], tokenizer: str = TOKENIZER) -> str:
    """The text of a list of ids, the inverse of the encoding."""
    with open(tokenizer, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    spelt = {i: s for s, i in vocab.items()}
    byte = {c: b for b, c in enumerate(byte_letters())}
    return bytes(byte[c] for i in ids for c in spelt[i]).decode("utf-8")
