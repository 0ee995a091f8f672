"""Encoding of a corpus with a public byte-level BPE vocabulary, by DuckDB recursive queries.

A task splits its texts into words with the vocabulary's pattern and keeps each distinct word
once. The words' bytes become token-position rows in DuckDB; a recursive query joins each pair
of neighbours with the merge table and contracts, in every word, the leftmost pair of minimum
rank, all its non-overlapping occurrences from the left at once, until no word has a pair left.
An ordered aggregation turns the rows into the id list of each word. Longer words go through the
same query as overlapping windows, whose ids join at tokens they share: time is linear in length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernmill.session import spread

#: The vocabulary's splitting pattern; a fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longer words are encoded in windows of so many bytes that overlap by half; one recursive query takes words whose
#: squared sizes, about the rows of its rounds, come to so many.
WORD_BYTES, QUERY_ROWS = 32, 6_000_000
#: Words kept by a task between batches; beyond it the store is emptied, results stay the same.
WORDS_KEPT = 400_000

#: One contraction of every word in {src}(word, pos, tok): rows of the words that had a pair.
STEP = """
    WITH pairs AS (
        SELECT s.word, s.pos, s.tok, m.made, m.rank
        FROM (SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM {src}) s
        LEFT JOIN merges m ON m.lft = s.tok AND m.rgt = s.nxt
    ), least AS (
        SELECT *, rank = min(rank) OVER (PARTITION BY word) AS hit, min(rank) OVER (PARTITION BY word) AS low FROM pairs
    ), runs AS (
        SELECT *, pos - row_number() OVER (PARTITION BY word, coalesce(hit, false) ORDER BY pos) AS run
        FROM least WHERE low IS NOT NULL
    ), chosen AS (
        SELECT *, coalesce(hit, false) AND row_number() OVER (PARTITION BY word, coalesce(hit, false), run ORDER BY pos) % 2 = 1 AS take
        FROM runs
    ), swallowed AS (
        SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM chosen
    )
    SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY pos) - 1 AS INTEGER) AS pos,
           CASE WHEN take THEN made ELSE tok END AS tok
    FROM swallowed WHERE NOT gone
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """(left, right, made) of every split of a token into two tokens; the rank is ``made``."""
    lft, rgt, made = [], [], []
    for word, rank in ranks.items():
        for k in range(1, len(word)):
            if (a := ranks.get(word[:k])) is not None and (b := ranks.get(word[k:])) is not None:
                lft.append(a), rgt.append(b), made.append(rank)
    return lft, rgt, made


def windows(size: int, width: int) -> range:
    """The starts of windows that cover ``size`` bytes; each overlaps the one before by half."""
    half = width // 2
    return range(0, max(size - half, 1), half)


def portions(words: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The words in batches of about ``most`` rows."""
    batch, size = [], 0
    for w in words:
        batch.append(w)
        size += len(w) ** 2
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class DuckBpe:
    """Encodes words with a merge table held in an in-memory DuckDB; one instance a process."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, memory: str = "300MB"):
        import duckdb
        import regex

        ranks = read_ranks(path)
        self.split = regex.compile(PATTERN).findall
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.token = {v: k for k, v in ranks.items()}
        # no disk: the work is bounded by QUERY_ROWS
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        lft, rgt, made = merge_rows(ranks)
        merges = pa.table({"lft": pa.array(lft, pa.int32()), "rgt": pa.array(rgt, pa.int32()), "made": pa.array(made, pa.int32())})
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT lft, rgt, made, made AS rank FROM merges_in")
        self.db.unregister("merges_in")
        self.known: dict[str, list[int]] = {}

    def _rows(self, words: list[bytes]) -> pa.Table:
        import numpy as np

        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(sizes)
        return pa.table(
            {
                "word": pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)),
                "pos": pa.array((np.arange(len(flat)) - np.repeat(ends - sizes, sizes)).astype(np.int32)),
                "tok": pa.array(np.asarray(self.bytes, dtype=np.int32)[flat]),
            }
        )

    def _recursive(self, words: list[bytes]) -> list[list[int]]:
        self.db.register("start", self._rows(words))
        found = self.db.sql(f"""
            WITH RECURSIVE bpe(word, round, pos, tok) AS (
                SELECT word, 0, pos, tok FROM start
                UNION ALL
                SELECT word, (SELECT max(round) FROM bpe) + 1, pos, tok FROM ({STEP.format(src="bpe")})
            ), final AS (
                SELECT word, pos, tok, round = max(round) OVER (PARTITION BY word) AS last FROM bpe
            )
            SELECT word, list(tok ORDER BY pos) AS ids FROM final WHERE last GROUP BY word ORDER BY word
        """).to_arrow_table()
        self.db.unregister("start")
        return found.column("ids").to_pylist()

    def _long(self, raw: bytes, parts: dict[bytes, list[int]], width: int) -> list[int] | None:
        """The ids of a long word from those of its overlapping windows; None if two of them share no token.

        Neighbouring tokens that stand together in the encoding of a window stand together in any
        encoding, and a row of such pairs is the encoding of its bytes. So the ids of one window up
        to a token that it shares with the next, then those of the next, are the ids of both.
        """
        out: list[int] = []
        begins: list[int] = []
        for at in windows(len(raw), width):
            ids = parts[raw[at : at + width]]
            starts = [at]
            for i in ids[:-1]:
                starts.append(starts[-1] + len(self.token[i]))
            if out:
                where = {(s, i): k for k, (s, i) in enumerate(zip(starts, ids))}
                n = len(out)
                # the shared token nearest the overlap's middle: edges of a window are the least certain
                shared = []
                while n and begins[n - 1] >= at:
                    n -= 1
                    if (k := where.get((begins[n], out[n]))) is not None:
                        shared.append((abs(begins[n] - at - width // 4), n, k))
                if not shared:
                    return None
                _, n, k = min(shared)
                del out[n:], begins[n:]
                ids, starts = ids[k:], starts[k:]
            out += ids
            begins += starts
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the words not known yet: short ones as they are, longer ones by windows."""
        new = sorted(w for w in words if w not in self.known)
        raw = {w: w.encode("utf-8", "replace") for w in new}
        self.known |= zip(new, map(self._encoded([raw[w] for w in new], WORD_BYTES).__getitem__, (raw[w] for w in new)))

    def _encoded(self, words: list[bytes], width: int) -> dict[bytes, list[int]]:
        """The ids of distinct words; windows that share no token are taken twice as wide."""
        whole = sorted({w for w in words if len(w) <= width})
        long = {w for w in words if len(w) > width}
        pieces = sorted({w[at : at + width] for w in long for at in windows(len(w), width)} - set(whole))
        done: dict[bytes, list[int]] = {}
        for batch in portions(whole + pieces, QUERY_ROWS):
            done |= zip(batch, self._recursive(batch))
        wider = []
        for w in long:
            if (ids := self._long(w, done, width)) is None:
                wider.append(w)
            else:
                done[w] = ids
        return done | self._encoded(wider, 2 * width) if wider else done

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else () for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        self.learn({w for ws in split for w in ws})
        known = self.known
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += known[w]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of an id list, by an ordered aggregation of the tokens' bytes."""
        if not ids:
            return ""
        self.db.register("ids_in", pa.table({"pos": pa.array(range(len(ids)), pa.int64()), "hex": [self.token[i].hex() for i in ids]}))
        text = self.db.execute("SELECT string_agg(hex, '' ORDER BY pos) FROM ids_in").fetchall()[0][0]
        self.db.unregister("ids_in")
        return bytes.fromhex(text).decode("utf-8", "replace")


_engines: dict[tuple[int, str], DuckBpe] = {}


def engine(path: str = DEFAULT_VOCABULARY) -> DuckBpe:
    """This process's engine; a forked worker makes its own."""
    key = (os.getpid(), path)
    if key not in _engines:
        _engines.clear()
        _engines[key] = DuckBpe(path)
    return _engines[key]


def encode(df: DataFrame, *, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    Null and empty texts have an empty list; a text that spells a special token is ordinary
    text; a null key stays null; other columns are not read.
    """
    schema = df.select(F.col(key).alias("key")).schema
    key_type = schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(vocabulary)
        for b in batches:
            # a batch of long texts is cut, so that what is held stays near the texts' size
            texts, at, n = b.column(1).to_pylist(), 0, b.num_rows
            while at < n:
                end, size = at, 0
                while end < n and size < 1_000_000:
                    size += len(texts[end] or "") + 1
                    end += 1
                ids = bpe.encode_batch(texts[at:end])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])
                at = end

    out = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {key_type}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")
