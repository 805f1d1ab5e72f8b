"""Document fingerprints by I-Match: distinct terms within a band of document frequency, several lexicon subsets.

Terms are lower-cased words, known by 64-bit hashes. Document frequency is counted exactly over all documents: tasks
count their own terms, and the counts are summed by term. Every task gets the lexicon, the terms in the band. A term
of it is in 0.002 of all documents at least, so it has at most 500 times as many terms as a document has distinct ones
on average, 8 bytes each, whatever the number of documents. Each slot of a fingerprint has a random subset of it; it
holds a 16-bit hash of the text's distinct terms in the subset, sorted by their hashes, or 0 if there are none. Subsets
range from 1/4 to 1/1024 of the lexicon, so that short and long texts have slots with a single term; a last slot
takes all terms, in the band or not, and is never 0. Likeness is the share of equal slots among those that either text fills, from the smallest subsets
up to the first level at which ``ENOUGH`` slots are filled: there slots hold few terms, and a change spoils few.

Null texts are empty; empty texts have equal fingerprints. Null ids come first; rows with equal ids follow each
other by a hash of their text, equal rows by the partition that they come from, so that no number of them fills a range
of rows that one task takes. With one row the next document is the row itself; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Shares of all documents between which a term's document frequency lies.
BAND = (0.002, 0.25)
RATES = (4, 16, 64, 256, 1024)
PER_RATE = 32
SLOTS = PER_RATE * len(RATES)
#: Filled slots that a likeness needs.
ENOUGH = 12
#: Sampled ids for each range of ids, and ranges for each task, which even out what tasks get.
SAMPLE, RANGES = 4, 8
SLICE_CHARS = 4 << 20
#: Counted terms that a task holds before it passes them on.
HELD = 1 << 20

_SALT = np.random.default_rng(5).integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_LEVEL = np.array([(1 << 64) // RATES[j // PER_RATE] - 1 for j in range(SLOTS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct terms, and for each (text, term) that occurs both numbers, by text and term."""
    cut = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    n = np.diff(cut.offsets.to_numpy())
    coded = cut.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, real = pd.util.hash_array(words, categorize=False), np.array(words != "", bool)
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    codes = coded.indices.to_numpy()
    pairs = np.unique((np.repeat(np.arange(len(n)), n) * len(words) + rank[codes])[real[codes]])
    return hashes[order], pairs // len(words), pairs % len(words)


def lexicon(texts: DataFrame, band=BAND) -> np.ndarray:
    """Sorted hashes of the terms of the one column whose document frequency over all rows lies in the band."""

    @lean
    def count(batches):
        held, size = [], 0

        def summed():
            terms, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["term", "n"])

        for b in batches:
            for a in range(0, len(b), 2000):
                hashes, _, term = _terms(b.column(0).slice(a, 2000))
                df = np.bincount(term, minlength=len(hashes))
                own = np.flatnonzero(df)
                held.append((hashes[own], df[own]))
                size += len(own)
                if size > HELD:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    n_docs = texts.count()
    counts = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    within = F.col("n").between(F.lit(max(2, band[0] * n_docs)), F.lit(max(2, band[1] * n_docs)))
    found = counts.filter(within).select("term").toArrow()["term"]
    return np.sort(found.to_numpy().astype(np.int64).view(np.uint64))


def _listed(lists: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each of n lists of hashes: every hash is mixed with its place in the list."""
    order = np.argsort(lists, kind="stable")
    of = lists[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    place = np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))
    total = np.zeros(n, np.uint64)
    total[of[first]] = np.add.reduceat(_mix(hashes[order] ^ _mix(place.astype(np.uint64) + np.uint64(1))), first) if len(of) else np.zeros(0, np.uint64)
    return _mix(total + np.uint64(1))


def fingerprints(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """Slots (uint16) of each text; 0 stands for no term."""
    hashes, doc, term = _terms(texts)
    at = np.searchsorted(lexicon, hashes)
    own = np.flatnonzero(np.append(lexicon, np.uint64(0))[at] == hashes) if len(lexicon) else np.zeros(0, np.int64)
    word, slot = np.nonzero(_mix(hashes[own][:, None] ^ _SALT[None, :]) <= _LEVEL[None, :])
    members = np.bincount(word, minlength=len(own))  # slots of each lexicon term, in order
    place = np.full(len(hashes), -1)
    place[own] = np.arange(len(own))
    hit = place[term] >= 0
    d, p = doc[hit], place[term[hit]]
    count = members[p]
    first = np.cumsum(members) - members
    flat = np.repeat(first[p] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    n = len(texts) * (SLOTS + 1)
    lists = np.concatenate([np.repeat(d, count) * (SLOTS + 1) + slot[flat], doc * (SLOTS + 1) + SLOTS])
    filled = np.zeros(n, bool)
    filled[lists] = True
    filled[np.arange(len(texts)) * (SLOTS + 1) + SLOTS] = True
    short = np.maximum(_listed(lists, np.concatenate([hashes[own][word[flat]], hashes[term]]), n) >> np.uint64(48), 1).astype(np.uint16)
    return np.where(filled, short, 0).astype(np.uint16).reshape(len(texts), SLOTS + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either fills, row by row, of the smallest subsets that are filled enough."""
    same, filled = (a == b) & (a > 0), (a > 0) | (b > 0)
    by_level = lambda x: np.cumsum(np.stack([x[:, k * PER_RATE : (k + 1) * PER_RATE].sum(1) for k in reversed(range(len(RATES)))] + [x[:, -1]], 1), 1)
    same, filled = by_level(same), by_level(filled)
    at = np.where((filled >= ENOUGH).any(1), np.argmax(filled >= ENOUGH, 1), len(RATES))
    rows = np.arange(len(a))
    return same[rows, at] / filled[rows, at]


def _ranges(keys: DataFrame, n: int) -> list[tuple]:
    """Bounds that cut the keys into about n even ranges of rows, from a sample by hash of SAMPLE rows a range."""
    rows = keys.count()
    every = max(1, rows // (SAMPLE * n))
    sample = sorted(tuple(r) for r in keys.filter(F.pmod(F.xxhash64(*keys.columns, F.monotonically_increasing_id()), F.lit(every)) == 0).collect())
    return sorted(set(sample[SAMPLE - 1 :: SAMPLE]))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, role, key, doc_id, text) dealt by ranges of ids: role 0 are a range's documents, in order, and
    the row of role 1 is the document that follows the range. One shuffle of the texts."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("hash"), F.spark_partition_id().alias("of"), "doc_id", text.alias("text"))
    shared = spark.sparkContext.broadcast(_ranges(keyed.select("key", "hash", "of"), RANGES * n))  # a bound for each range

    @F.pandas_udf("int")
    def part(key: pd.Series, hash_: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_left(shared.value, x) for x in zip(key.tolist(), hash_.tolist(), of.tolist(), strict=True)], dtype=np.int32)

    keyed = keyed.withColumn("part", part("key", "hash", "of")).drop("of")
    heads = sorted((r.part, *r.head) for r in keyed.groupBy("part").agg(F.min(F.struct("key", "hash")).alias("head")).collect())
    follow = [(part, *heads[(i + 1) % len(heads)][1:]) for i, (part, *_) in enumerate(heads)]
    after = F.broadcast(spark.createDataFrame(follow, "part int, key long, hash long"))  # a row for each range
    next_ = keyed.drop("part").join(after, ["key", "hash"]).groupBy("part", "key", "hash").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    names = ["key", "hash", "doc_id", "text"]
    both = keyed.select("part", F.lit(0).alias("role"), *names).unionByName(next_.select("part", F.lit(1).alias("role"), *names))
    return both.repartition(n, "part").sortWithinPartitions("part", "role", "key", "hash", "text")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, band=BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon(docs.select("text"), band))  # bounded, see above

    def finish(ids: list, texts: list[str]):
        """All but the last text, which only follows."""
        new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own = fingerprints(pa.array(texts, pa.string()), model.value)
        other = fingerprints(pa.array(new, pa.string()), model.value)
        hexed = lambda x: [r.astype(">u2").tobytes().hex() for r in x]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids[: len(new)], pa.int64()), "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
            "fingerprint": hexed(own[:-1]), "edited_fingerprint": hexed(other),
            "near_edited": likeness(own[:-1], other), "near_next": likeness(own[:-1], own[1:]),
        })

    @lean
    def run(batches):
        ids, texts, chars, part, over = [], [], 0, None, False
        for b in batches:
            for p, role, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if p != part:
                    ids, texts, chars, part, over = [], [], 0, p, False
                if over:
                    continue
                ids.append(doc_id)
                texts.append(text or "")
                chars += len(texts[-1])
                over = role == 1
                if len(texts) > 1 and (over or chars > SLICE_CHARS):
                    yield finish(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]
                    chars = len(texts[0])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).select("part", "role", "doc_id", "text").mapInArrow(run, schema)
