"""Packing tokenised documents into training sequences by vector best fit."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize
from sparkprep.llm.common import bounded_batches, tidy

SEQUENCE_TOKENS = 1024
END_ID = 2
SHARD_PIECES = 4_096
CACHE_WORDS = 400_000
#: A split of the text before the merges, as published with the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) of one space-delimited part.

    The vocabulary's split never joins characters across the border between a
    non-space character and a space, so a text's ids are the ids of its parts;
    parts repeat often and are looked up.  The cache is emptied when full.
    """

    def __init__(self, tokenizer_path: str) -> None:
        import tiktoken
        super().__init__()
        with open(tokenizer_path, encoding="utf-8") as f:
            tokenizer = json.load(f)
        vocabulary = tokenizer["model"]["vocab"]
        to_byte = _byte_of_char()
        ranks = {bytes(to_byte[c] for c in word): i for word, i in vocabulary.items()
                 if all(c in to_byte for c in word) and i < len(vocabulary) and not word.startswith("<|")}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in tokenizer.get("added_tokens") or []}
        if any(t[k] for t in tokenizer.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in white space, words or normalised text are not supported")
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = np.array(self.encoding.encode_ordinary(part), "<u4").tobytes()
        if len(part) <= 64:
            self[part] = ids
        return ids

    def tokenize(self, text: str) -> bytes:
        """Ids of a text in which the tokenizer's added tokens stand for themselves."""
        if self.split is None or not self.split.search(text):
            return self.encode(text)
        # odd places hold the added tokens, the text between them is encoded by itself
        return b"".join([self.added[p] if i % 2 else self.encode(p) for i, p in enumerate(self.split.split(text))])

    def encode(self, text: str) -> bytes:
        """Ids of a text whose added tokens are ordinary text."""
        parts = text.split(" ")
        if len(parts) == 1:
            return self[text]
        rest = parts[1:]
        # a run of spaces, or other white space between spaces, is split as a whole
        if "" in rest or any(p.isspace() for p in rest if p[0] <= " " or p[0] >= "\x85"):
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()
        return self[parts[0]] + b"".join([self[" " + p] for p in rest])


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids and the
    end id, cut only when longer than a sequence; then the first piece may be
    shorter and the others are full.  Null texts read as empty (one id).
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.tokenize(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % sequence_tokens or sequence_tokens, n + 1, sequence_tokens)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in columns[2:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
            .mapInArrow(tidy(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"))


def best_fit(demands: np.ndarray, capacity: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bin of every item (rows of ``demands``), largest weighted demand first.

    An item goes to the open bin with room in every dimension that is left
    with the smallest weighted residual norm (first such bin on ties); if no
    bin has room, to a new one.  Open bins whose residuals are equal act
    alike, so they are kept as one state with a queue of its bins, and the
    norm is taken once per state.
    """
    order = np.lexsort((np.arange(len(demands)), -(demands / capacity * weights).sum(axis=1)))
    bins = np.zeros(len(demands), np.int64)
    states = np.zeros((64, demands.shape[1]))
    queues: list[list[int]] = []
    index: dict[tuple, int] = {}
    free: list[int] = []
    live = np.zeros(64, bool)
    scale = weights / capacity
    opened, top = 0, 0
    for i in order:
        demand = demands[i]
        after = states[:top] - demand
        fits = live[:top] & (after >= 0).all(axis=1)
        if fits.any():
            at = np.flatnonzero(fits)
            s = at[np.argmin(((after[at] * scale) ** 2).sum(axis=1))]
            left = after[s]
            bins[i] = heapq.heappop(queues[s])
            if not queues[s]:
                live[s] = False
                del index[tuple(states[s])]
                free.append(int(s))
        else:
            bins[i], left = opened, capacity - demand
            if (left < 0).any():
                raise ValueError("an item is larger than an empty bin")
            opened += 1
        if not (left > 0).all():
            continue  # full in one dimension: closed
        key = tuple(left)
        if key not in index:
            if free:
                s = free.pop()
            else:
                s, top = top, top + 1
                queues.append([])
                if top > len(states):
                    states = np.concatenate([states, np.zeros_like(states)])
                    live = np.concatenate([live, np.zeros_like(live)])
            states[s], live[s], index[key] = left, True, int(s)
        heapq.heappush(queues[index[key]], int(bins[i]))
    return bins


def pack(pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, max_pieces: int | None = None,
         max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    A sequence holds at most ``sequence_tokens`` tokens, ``max_pieces`` pieces
    (default: as many as tokens) and attention cost ``max_attention`` (sum of
    squared lengths; default: that of one full piece).  Full pieces are
    sequences by themselves.  The others are dealt out at random over shards
    of about ``shard_pieces`` pieces and packed there by vector best fit; a
    shard leaves less than one sequence's worth of room beyond best fit's own
    loss, so the shard size is the packing's granularity, not a cap.
    """
    tokens = sequence_tokens
    capacity = np.array([tokens, max_pieces or tokens, max_attention or tokens * tokens], float)
    pieces = materialize(pieces, "pieces")
    short = F.col("length") < tokens
    n = pieces.where(short).count()
    shards = max(1, -(-n // shard_pieces))
    numbered = pieces.withColumn("_n", F.monotonically_increasing_id())
    whole = (numbered.where(~short).withColumn("sequence_id", -F.col("_n") - 1)
             .withColumn("offset", F.lit(0).cast("bigint")).drop("_n"))
    columns = pieces.columns

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_n", ignore_index=True)
        lengths = frame["length"].to_numpy(float)
        demands = np.stack([lengths, np.ones_like(lengths), lengths ** 2], axis=1)
        bins = best_fit(demands, capacity, np.array(weights))
        frame["sequence_id"] = bins + (frame["_shard"].iloc[0].astype(np.int64) << 32)
        frame["offset"] = (frame.groupby("sequence_id")["length"].cumsum() - frame["length"]).astype(np.int64)
        return frame[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    shard = F.pmod(F.xxhash64("_n"), F.lit(shards)).cast("int")
    packed = (numbered.where(short).withColumn("_shard", shard).groupBy("_shard")
              .applyInPandas(fit, f"{schema}, sequence_id bigint, offset bigint"))
    return whole.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, **options) -> DataFrame:  # noqa: ANN003
    """Tokenise and pack; one row per piece.

    Repeated rows are packed as often as they occur; an empty table gives an
    empty result; other columns of ``docs`` are not read.
    """
    return pack(token_pieces(docs, tokenizer_path, id_col, text_col, sequence_tokens, end_id),
                sequence_tokens, **options)
