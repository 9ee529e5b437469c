"""One-permutation MinHash fingerprints of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.bytehash import Hasher, mix
from sparkprep.llm.common import byte_groups, shuffle_partitions, utf8

BINS = 512
BITS = 4  # one hex digit per bin
SHINGLE = 5
SEED = 42
GROUP_BYTES = 1 << 20

_U = np.uint64
_EMPTY = _U(2**64 - 1)
_STEP = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


class MinHash:
    """Fingerprints of whole texts; one instance per Python worker."""

    def __init__(self, bins: int = BINS, shingle: int = SHINGLE, seed: int = SEED) -> None:
        if bins & (bins - 1) or bins < 2:
            raise ValueError("bins must be a power of two")
        self.bins, self.shingle = bins, shingle
        self.hasher = Hasher(seed)
        self.shift = _U(64 - bins.bit_length() + 1)
        self._visits = None

    # -- shingle hashes ---------------------------------------------------
    def _shingles(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every shingle.  Texts of fewer words give one shingle of all."""
        word = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(word & np.r_[True, ~word[:-1]] | word & edge[:-1])
        ends = np.flatnonzero(word & (np.r_[~word[1:], True] | edge[1:])) + 1
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hashes = mix(self.hasher.spans(self.hasher.prefix(data), starts, ends))
        first = np.searchsorted(starts, offsets)  # first word of every row
        counts = np.diff(first)
        rows = np.repeat(np.arange(len(counts)), counts)
        k = self.shingle
        n = len(hashes)
        out, owner = [], []
        if n >= k:
            h = hashes[:n - k + 1]
            for j in range(1, k):
                h = h * _STEP + hashes[j:n - k + 1 + j]
            whole = rows[:n - k + 1] == rows[k - 1:]
            out.append(h[whole])
            owner.append(rows[:n - k + 1][whole])
        for m in range(1, k):  # short texts
            short = np.flatnonzero(counts == m)
            if len(short):
                h = hashes[first[short]]
                for j in range(1, m):
                    h = h * _STEP + hashes[first[short] + j]
                out.append(h + _U(m))
                owner.append(short)
        return mix(np.concatenate(out)), np.concatenate(owner)

    # -- optimal densification --------------------------------------------
    def _probe(self, bins: np.ndarray, attempt: int) -> np.ndarray:
        """The bin that an empty bin looks at on its n-th attempt (2-universal)."""
        x = bins.astype(np.uint64) + _U(self.bins) * _U(attempt)
        return (mix(x * _STEP + _U(SEED)) >> self.shift).astype(np.int64)

    @property
    def visits(self) -> np.ndarray:
        """visits[i, j]: the attempt on which empty bin i first looks at bin j."""
        if self._visits is None:
            table = np.full((self.bins, self.bins), -1, np.int32)
            own, attempt = np.arange(self.bins), 0
            while (open_ := np.flatnonzero((table < 0).any(axis=1))).size:
                at = self._probe(own[open_], attempt)
                new = table[open_, at] < 0
                table[open_[new], at[new]] = attempt
                attempt += 1
            self._visits = table
        return self._visits

    def _densify(self, values: np.ndarray) -> None:
        """Fill every empty bin from the first full bin on its probe sequence."""
        full = values != _EMPTY
        counts = full.sum(axis=1)
        few = self.bins // 16
        for r in np.flatnonzero((counts > 0) & (counts <= few)):
            have, lack = np.flatnonzero(full[r]), np.flatnonzero(~full[r])
            pick = have[np.argmin(self.visits[np.ix_(lack, have)], axis=1)]
            values[r, lack] = values[r, pick]
        rows, bins = np.nonzero(~full & (counts > few)[:, None])
        attempt = 0
        while len(rows):
            at = self._probe(bins, attempt)
            hit = full[rows, at]
            values[rows[hit], bins[hit]] = values[rows[hit], at[hit]]
            rows, bins = rows[~hit], bins[~hit]
            attempt += 1

    # -- public ------------------------------------------------------------
    def digits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x bins low-order bits, has words) of texts in one buffer."""
        n = len(offsets) - 1
        digits = np.zeros((n, self.bins), np.uint8)
        some = np.zeros(n, bool)
        for a, b in byte_groups(offsets, GROUP_BYTES):
            lo, hi = offsets[a], offsets[b]
            hashes, rows = self._shingles(data[lo:hi], offsets[a:b + 1] - lo)
            values = np.full((b - a) * self.bins, _EMPTY)
            cell = rows * self.bins + (hashes >> self.shift).astype(np.int64)
            np.minimum.at(values, cell, hashes & _U(2**int(self.shift) - 1))
            values = values.reshape(b - a, self.bins)
            some[a:b] = (values != _EMPTY).any(axis=1)
            self._densify(values)
            digits[a:b] = (values & _U(2**BITS - 1)).astype(np.uint8)
        digits[~some] = 0
        return digits, some


def packed(digits: np.ndarray, some: np.ndarray) -> list[str]:
    """One hex digit per bin; a text without words has the empty string."""
    rows = _HEX[digits]
    return [r.tobytes().decode() if s else "" for r, s in zip(rows, some)]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: share of equal digits, corrected for the
    digits that agree by chance.  1 for two texts without words, 0 for one."""
    chance = 1.0 / 2**BITS
    share = (a == b).mean(axis=1)
    estimate = np.clip((share - chance) / (1.0 - chance), 0.0, 1.0)
    return np.where(a_some & b_some, estimate, (a_some == b_some).astype(float))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS,
                 shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text (null reads as empty).

    One pass without a shuffle.  Equal texts have equal fingerprints.  Texts
    shorter than a shingle are one shingle; texts without words have "".
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bins, shingle)
        for batch in batches:
            digits, some = minhash.digits(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(digits, some), pa.string())],
                                             names=["doc_id", "fingerprint"])
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
            .mapInArrow(run, f"doc_id {kind}, fingerprint string"))


def neighbour_order(docs: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """``columns`` dealt out by descending id: every partition holds a run of
    the order, sorted, and at its end (``_extra``) the row that follows it.

    Bounds come from approximate quantiles of the id column; what reaches the
    driver is one number per partition.  Rows of one id stay together; null
    ids come last.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    number = F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf")))
    ids = docs.select(number.alias("_x"))
    probs = [i / n for i in range(1, n)] or [0.5]
    found = ids.where(F.col("_x") > float("-inf")).agg(F.percentile_approx("_x", probs, 10 * n + 100)).first()[0]
    bounds = sorted(set(found or [])) or [0.0]
    splits = [float("-inf"), *bounds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_x", outputCol="_b")
    last = len(splits) - 2
    firsts = {int(last - r["_b"]): r["x"] for r in
              cut.transform(ids).groupBy("_b").agg(F.max("_x").alias("x")).collect()}
    runs = sorted(firsts)
    # the first id of each run also goes to the run before it; the very first to the last
    goes = [(firsts[b], runs[i - 1]) for i, b in enumerate(runs)]
    extra = F.lit(None).cast("int")
    if goes:
        to = F.map_from_arrays(F.lit([x for x, _ in goes]), F.lit([b for _, b in goes]))
        is_first = F.col("_x").isin([x for x, _ in goes])
        extra = F.when(is_first, F.try_element_at(to, F.col("_x")))
    rows = cut.transform(docs.select(*columns, number.alias("_x")))
    own = F.struct(F.lit(False).alias("e"), (F.lit(last) - F.col("_b")).cast("int").alias("p"))
    more = F.struct(F.lit(True).alias("e"), extra.cast("int").alias("p"))
    places = F.filter(F.array(own, more), lambda s: s["p"].isNotNull())
    rows = rows.withColumn("_to", F.explode(places)).select(
        *columns, F.col("_to.e").alias("_extra"), F.col("_to.p").alias("_place"))
    return (rows.repartitionById(max(1, last + 1), F.col("_place"))
            .sortWithinPartitions(F.col("_place"), F.col("_extra"), F.col(id_col).desc_nulls_last(), *columns[1:]))


def edit_similarity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text keeps the first half of the code points (rounded up) and
    continues with the start of the next document in descending id order
    (after the last: the first), as many code points as were cut, or all.
    ``near_edited`` and ``near_next`` compare the fingerprint with the edited
    text's and with the next document's.  Null texts read as empty; repeated
    ids are ordered by text; a table of one row is its own next document.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = neighbour_order(docs.select(F.col(id_col).alias("doc_id"),
                                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")),
                           ["doc_id", "text"], "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash()
        held: tuple | None = None  # the row whose next one has not come yet
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            extras = batch.column(2).to_pylist()
            digits, some = minhash.digits(*utf8(batch.column(1)))
            if held is not None:
                ids, texts, extras = [held[0], *ids], [held[1], *texts], [held[2], *extras]
                digits = np.concatenate([held[3][None], digits])
                some = np.r_[held[4], some]
            if not ids:
                continue
            held = (ids[-1], texts[-1], extras[-1], digits[-1], bool(some[-1]))
            n = next((i for i, e in enumerate(extras) if e), len(ids) - 1)
            n = min(n, len(ids) - 1)
            if n:
                yield from _compared(minhash, ids, texts, digits, some, n)
    schema = (f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    return rows.select("doc_id", "text", "_extra").mapInArrow(run, schema)


def _compared(minhash: MinHash, ids: list, texts: list[str], digits: np.ndarray, some: np.ndarray,
              n: int) -> Iterator[pa.RecordBatch]:
    """Result rows of the first n texts; each one's next text follows it."""
    edited = []
    for text, after in zip(texts[:n], texts[1:n + 1]):
        cut = len(text) // 2
        edited.append((text[:len(text) - cut] + after[:cut]).encode())
    offsets = np.cumsum([0, *map(len, edited)])
    e_digits, e_some = minhash.digits(np.frombuffer(b"".join(edited), np.uint8), offsets)
    own, own_some = digits[:n], some[:n]
    near = likeness(own, own_some, e_digits, e_some)
    following = likeness(own, own_some, digits[1:n + 1], some[1:n + 1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[:n]), pa.array([len(t) for t in texts[:n]], pa.int64()),
         pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(packed(own, own_some)),
         pa.array(packed(e_digits, e_some)), pa.array(near, pa.float64()), pa.array(following, pa.float64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
               "near_next"])
