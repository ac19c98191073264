"""Operator 6: byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A text is cut by the public split pattern. Each distinct word that a worker has
not met yet becomes rows (word, position, id), one for a byte. A recursive query
joins neighbouring ids with the merge table, contracts each word's leftmost pair
of least rank, and goes on with the words that changed until none does. The
recursion is keyed by word and position: a round replaces the rows that it
changes and keeps no older ones, so memory is one row a byte however many rounds
a word takes. An ordered aggregation over the last rows reads off ids and decoded
bytes; a document's are those of its words, one after another.

The merge table holds every way to cut a token of the vocabulary into two others,
so a pair has a rank exactly if its joined bytes have one. In words of more than
MANY_ROUNDS bytes a round contracts, from the left, every pair that has the least
rank: the same as taking them one by one if no pair that this makes can rank lower.
That holds where each token comes out of its own bytes by pairs of lower rank
(`regular` looks at each one); with any other vocabulary a round contracts the
leftmost pair alone, whatever the word's length.

Words of any length and script take this way. A query's words are of like size and
have QUERY_BYTES together; a longer word is a query of its own, whose memory grows
with that word. Null and empty texts have no tokens: n_tokens 0, and the digests
are of the empty string. Every row with a doc_id gives one row, repeated rows too;
rows without are left out, and columns beside doc_id and text are pruned. What a
worker remembers is bounded and never changes a result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foldscape.llm.common import batch, chunks, table, texts_of
from foldscape.llm.pretoken import Words, split

#: Bytes of the words in one recursive query.
QUERY_BYTES = 1 << 17
#: Memory of a query, and what a byte of a longer word adds to it.
QUERY_MB, BYTE_ROOM = 500, 400

#: Words of more bytes have all pairs of least rank contracted in a round, so that a word of a megabyte takes thousands of rounds and not a million.
MANY_ROUNDS = 256

#: A row knows its right neighbour's position and id; a row that was contracted away has no id. key: the pair's rank and place.
_LEFTMOST = """
WITH RECURSIVE t(word, pos, id, next_pos, next_id, key) USING KEY (word, pos) AS (
  SELECT f.word, f.pos, f.id, f.next_pos, f.next_id, (m.rank::BIGINT << 32) + f.pos FROM fresh f LEFT JOIN merges m ON m.l = f.id AND m.r = f.next_id
  UNION ALL
  (WITH chosen AS (
    SELECT word, (min(key) & 4294967295)::INT AS pos, (min(key) >> 32)::INT AS rank, arg_min(next_pos, key) AS gone
    FROM recurring.t WHERE key IS NOT NULL AND word IN (SELECT word FROM t) GROUP BY word
  ),
  fused AS (
    SELECT c.word, c.pos, c.rank AS id, z.next_pos, z.next_id FROM recurring.t z JOIN chosen c ON c.word = z.word AND c.gone = z.pos
    UNION ALL
    SELECT k.word, k.pos, k.id, k.next_pos, c.rank FROM recurring.t k JOIN chosen c ON c.word = k.word AND c.pos = k.next_pos
  )
  SELECT f.word, f.pos, f.id, f.next_pos, f.next_id, (m.rank::BIGINT << 32) + f.pos FROM fused f LEFT JOIN merges m ON m.l = f.id AND m.r = f.next_id
  UNION ALL SELECT word, gone, NULL, NULL, NULL, NULL FROM chosen)
)
SELECT word, list(id ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS hex
FROM t JOIN vocabulary USING (id) GROUP BY word ORDER BY word
"""
#: Pairs of least rank that overlap form runs (of one id, as in "aaaa"), of which every other one is contracted.
_EVERY = """
WITH RECURSIVE t(word, pos, id, next_pos, next_id, rank) USING KEY (word, pos) AS (
  SELECT f.word, f.pos, f.id, f.next_pos, f.next_id, m.rank FROM fresh f LEFT JOIN merges m ON m.l = f.id AND m.r = f.next_id
  UNION ALL
  (WITH best AS (SELECT word, min(rank) AS rank FROM recurring.t WHERE word IN (SELECT word FROM t) GROUP BY word HAVING min(rank) IS NOT NULL),
  hit AS (
    SELECT word, rank, k.pos, k.next_pos, lag(k.next_pos) OVER (PARTITION BY word ORDER BY k.pos) IS DISTINCT FROM k.pos AS opens
    FROM recurring.t k JOIN best USING (word, rank)
  ),
  runs AS (SELECT *, sum(opens::INT) OVER (PARTITION BY word ORDER BY pos) AS run FROM hit),
  chosen AS (SELECT word, pos, next_pos AS gone, rank FROM runs QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1),
  fused AS (
    SELECT c.word, c.pos, c.rank AS id, z.next_pos, CASE WHEN d.pos IS NOT NULL THEN c.rank ELSE z.next_id END AS next_id
    FROM recurring.t z JOIN chosen c ON c.word = z.word AND c.gone = z.pos LEFT JOIN chosen d ON d.word = z.word AND d.pos = z.next_pos
    UNION ALL
    SELECT k.word, k.pos, k.id, k.next_pos, c.rank
    FROM recurring.t k JOIN chosen c ON c.word = k.word AND c.pos = k.next_pos
    WHERE NOT EXISTS (SELECT 1 FROM chosen d WHERE d.word = k.word AND d.gone = k.pos)
  )
  SELECT f.word, f.pos, f.id, f.next_pos, f.next_id, m.rank FROM fused f LEFT JOIN merges m ON m.l = f.id AND m.r = f.next_id
  UNION ALL SELECT word, gone, NULL, NULL, NULL, NULL FROM chosen)
)
SELECT word, list(id ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS hex
FROM t JOIN vocabulary USING (id) GROUP BY word ORDER BY word
"""


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@cache
def regular(path: str) -> bool:
    """Whether every token of a rank file comes out of its own bytes by pairs of lower rank. Looked at once, on the driver."""
    ranks = ranks_of(path)
    for token, own in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, own + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank > own:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class Coder(Words):
    """Words with their ids as text and their decoded bytes, by recursive queries."""

    LIMIT = 1_000_000

    def __init__(self, path: str, every: bool):
        import duckdb

        ranks = ranks_of(path)
        cuts = [(ranks[b[:k]], ranks[b[k:]], i) for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks]
        self.every = every
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": "1", "temp_directory": ""})
        left, right, rank = (pa.array(x, pa.int32()) for x in zip(*cuts, strict=True))
        self.con.register("cuts", pa.table({"l": left, "r": right, "rank": rank}))
        self.con.register("tokens", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [b.hex() for b in ranks]}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM cuts")
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM tokens")
        super().__init__(self.by_queries)

    def clear(self) -> None:
        super().clear()
        self.id_text: list[str] = []
        self.decoded: list[bytes] = []

    def by_queries(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        ids: list = [None] * len(raw)
        decoded: list = [None] * len(raw)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        total = np.cumsum([len(raw[i]) for i in order])
        at = 0
        while at < len(order):
            room = QUERY_BYTES + (int(total[at - 1]) if at else 0)
            stop = max(at + 1, int(np.searchsorted(total, room, side="right")))
            some, at = order[at:stop], stop
            for i, (x, h) in zip(some, self.coded([raw[i] for i in some]), strict=True):
                ids[i], decoded[i] = x, h
        self.id_text += [" ".join(map(str, x)) for x in ids]
        self.decoded += decoded
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.zeros(0, np.uint32), sizes

    def coded(self, words: list[bytes]) -> Iterator[tuple[list[int], bytes]]:
        """Ids and decoded bytes of each word, by one recursive query."""
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        first = self.first[np.frombuffer(b"".join(words), np.uint8)]
        last = pos == np.repeat(sizes, sizes) - 1
        fresh = {"word": word, "pos": pos, "id": first, "next_pos": pa.array(pos + np.int32(1), mask=last), "next_id": pa.array(np.append(first[1:], np.int32(0)), mask=last)}
        self.con.execute(f"SET memory_limit = '{QUERY_MB + BYTE_ROOM * max(0, len(word) - QUERY_BYTES) // 1_000_000}MB'")
        self.con.register("fresh", pa.table(fresh))
        found = self.con.sql(_EVERY if self.every and sizes.max() > MANY_ROUNDS else _LEFTMOST).to_arrow_table()
        self.con.unregister("fresh")
        return zip(found["ids"].to_pylist(), map(bytes.fromhex, found["hex"].to_pylist()), strict=True)


@cache
def coder(path: str, every: bool) -> Coder:
    return Coder(path, every)


_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.binary())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _coded(path: str, digests: bool):
    every = regular(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, every)
        for t in chunks(batches):
            points, starts, counts = split(t["text"])
            at = own.look(points, starts)
            n = np.concatenate([[0], np.cumsum(own.size[at])])[counts]
            spans = list(zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True))
            at = at.tolist()
            ids = (" ".join([own.id_text[i] for i in at[a:b]]) for a, b in spans)
            decoded = (b"".join([own.decoded[i] for i in at[a:b]]) for a, b in spans)
            if digests:
                yield batch(_DIGESTS, t["doc_id"].combine_chunks(), np.diff(n), [hashlib.sha256(x.encode()).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in decoded])
            else:
                yield batch(_CODED, t["doc_id"].combine_chunks(), np.diff(n), list(ids), list(decoded))

    return run


def encode_decode(docs: DataFrame, rank_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, with single spaces between) and decoded (bytes) of every row of `docs`."""
    return texts_of(docs).mapInArrow(_coded(rank_path, False), "doc_id long, n_tokens long, ids string, decoded binary")


def op6_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of encode_decode's columns, taken in its tasks so that ids and texts needn't leave Python."""
    import public_tokenizers

    docs = texts_of(table(spark, sf_dir, "documents"))
    return docs.mapInArrow(_coded(public_tokenizers.path("byte_bpe_50k.tiktoken"), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
