"""Spelling variants by dynamic programming over sorted word lists.

Words of one length lie in a sorted list. For a query the edit matrix against a list has one band row per
distinct prefix, not per word: words that share a prefix share its rows, and the longest common prefix of
neighbours says where a row is left. The lists are walked depth by depth for a block of queries
at once; a state is a query, a range of the list with one shared prefix, and the band row of that prefix. A
range whose row exceeds one edit is skipped whole.

One edit between a word of m code points and one of m or m + 1 leaves either its first m // 2 or its last
m - m // 2 code points alone. So there are two sorts of lists, of words and of reversed words, and a query
starts at the range that has its own half; a pair that has both halves counts in the first sort only.

Lists are cut into segments of bounded size, which are stored rows. Which segments meet is read from a
directory of their first and last words, at most a few times DIRECTORY rows: segments meet if a half of a
query may lead there and their shared prefixes are within one edit.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..storage import broadcast_if_small, materialize, remove
from .common import arrow_pass, texts
from .words import ragged

#: A run of letters; all its code points are below 256.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TYPO_RATE = 97
MIN_CHARS, MIN_COUNT, LEAD = 5, 3, 2
#: Words and bytes of a segment; beyond DIRECTORY segments of this size they grow with the vocabulary.
SEGMENT_WORDS, SEGMENT_BYTES, DIRECTORY = 4096, 1 << 20, 1 << 17
#: Queries walked at once, and code points of a segment's ends that the directory knows.
QUERIES, END_CHARS = 256, 64


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all whole texts with enough code points and occurrences.

    In a run whose CRC-32 with its document's id is a multiple of TYPO_RATE one code point is left out; rows with a
    null id keep their runs. Counting combines equal words in the task that reads them.
    """
    runs = texts(docs).select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    code = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = F.pmod(code, F.char_length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = runs.select(F.when(code % TYPO_RATE == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def walk(queries: np.ndarray, words: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with query i and word j exactly one edit apart and equal in their first `start` characters.

    Both are character matrices; `words` are distinct, sorted, and as long as the queries or longer by one.
    """
    (n, m), (count, length) = queries.shape, words.shape
    longer = length - m
    lcp = np.concatenate([[-1], (words[1:] != words[:-1]).argmax(1)])
    order = np.argsort(lcp, kind="stable")
    ends = np.searchsorted(lcp[order], np.arange(-1, length + 1), "right")
    lo, hi = np.zeros(n, np.int64), np.full(n, count, np.int64)
    if start:
        heads = np.ascontiguousarray(words[:, :start]).view(f"S{start}").ravel()
        own = np.ascontiguousarray(queries[:, :start]).view(f"S{start}").ravel()
        lo, hi = np.searchsorted(heads, own, "left"), np.searchsorted(heads, own, "right")
    padded = np.concatenate([queries, np.zeros((n, 2), np.uint8)], axis=1)
    found_i, found_j = [], []
    for first in range(0, n, QUERIES):
        q = first + np.flatnonzero(lo[first:first + QUERIES] < hi[first:first + QUERIES])
        low, high = lo[q], hi[q]
        # the band row of a prefix of i characters: edits to the first i and to the first i - 1 of the query
        same, behind = np.zeros(len(q), np.int8), np.full(len(q), 2, np.int8)
        for i in range(start, length):
            if not len(q):
                break
            cuts = order[ends[i]:ends[i + 1]]  # where neighbours differ in character i
            a, b = np.searchsorted(cuts, low, "right"), np.searchsorted(cuts, high, "left")
            parent = np.repeat(np.arange(len(q)), b - a + 1)
            child = np.empty(len(parent), np.int64)
            heads = np.cumsum(b - a + 1) - (b - a + 1)
            child[heads] = low
            inner = np.ones(len(parent), bool)
            inner[heads] = False
            child[inner] = cuts[ragged(a, b - a)]
            stop = np.append(child[1:], 0)
            stop[np.append(heads[1:] - 1, len(parent) - 1)] = high
            q, c = q[parent], words[child, i]
            new = same[parent] + (c != padded[q, i])
            behind = np.minimum(same[parent] + 1, behind[parent] + (c != padded[q, i - 1])) if longer else np.full(len(q), 2, np.int8)
            live = np.minimum(new + longer, behind) <= 1
            q, low, high, same, behind = q[live], child[live], stop[live], np.minimum(new[live], 2), behind[live]
        near = (behind if longer else same) == 1
        found_i.append(q[near])
        found_j.append(low[near])
    return np.concatenate(found_i) if found_i else np.zeros(0, np.int64), np.concatenate(found_j) if found_j else np.zeros(0, np.int64)


def may_meet(a: bytes, b: bytes, longer: bool) -> bool:
    """Whether words with the shared prefixes `a` (queries) and `b` may be one edit apart."""
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    if i == n:
        return True
    return a[i:n - 1] == b[i + 1:n] if longer else a[i + 1:n] == b[i + 1:n]


def _shared(first: bytes, last: bytes) -> bytes:
    n = min(len(first), len(last))
    return first[:next((k for k in range(n) if first[k] != last[k]), n)]


def _half(side: int, length: int) -> int:
    """Characters at the start of a list's words that a query leaves alone."""
    return length // 2 if side == 0 else length - length // 2


def segments(lists: DataFrame, words: int) -> DataFrame:
    """Stored segments of the lists (side, length, key, id, n), which come sorted by their first three."""
    schema = "segment long, side int, length int, first binary, last binary, keys binary, ids binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, kind = [], None

        def close() -> pa.RecordBatch:
            nonlocal number
            keys = [k for k, _, _ in held]
            row = {
                "segment": number, "side": kind[0], "length": kind[1], "first": keys[0][:END_CHARS], "last": keys[-1][:END_CHARS],
                "keys": b"".join(keys), "ids": np.array([i for _, i, _ in held], "<i8").tobytes(), "counts": np.array([n for _, _, n in held], "<i8").tobytes(),
            }
            number += 1
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("segment", pa.int64()), ("side", pa.int32()), ("length", pa.int32()), *((c, pa.binary()) for c in ("first", "last", "keys", "ids", "counts"))]))

        for batch in batches:
            for side, length, key, own, n in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (kind != (side, length) or len(held) >= words or len(held) * length >= SEGMENT_BYTES):
                    yield close()
                    held = []
                kind = (side, length)
                held.append((key, own, n))
        if held:
            yield close()

    return materialize(arrow_pass(lists, run, schema), "word-segments")


def segment_pairs(stored: DataFrame) -> DataFrame:
    """(a, b): query segments and the segments of words as long, or longer by one, that they meet."""
    directory: dict[tuple[int, int], list[tuple[bytes, bytes, int]]] = {}
    for row in stored.select("side", "length", "first", "last", "segment").collect():  # bounded by DIRECTORY
        directory.setdefault((row["side"], row["length"]), []).append((bytes(row["first"]), bytes(row["last"]), row["segment"]))
    for own in directory.values():
        own.sort()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, length, first, last, a in zip(*(batch[c].to_pylist() for c in ("side", "length", "first", "last", "segment"))):
                half, met, common = min(_half(side, length), END_CHARS), [], _shared(first, last)
                for longer in (0, 1):
                    own = directory.get((side, length + longer), [])
                    low = bisect.bisect_left(own, first[:half], key=lambda s: s[1][:half])
                    for at in range(low, len(own)):
                        if own[at][0][:half] > last[:half]:
                            break
                        if may_meet(common, _shared(*own[at][:2]), bool(longer)):
                            met.append(own[at][2])
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array([a] * len(met), pa.int64()), pa.array(met, pa.int64())], ["a", "b"])

    return arrow_pass(stored.select("segment", "side", "length", "first", "last"), run, "a long, b long")


def near_words(words: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """(id, other, n): every word's near words with their counts, from words (id, word, n)."""
    latin = F.encode("word", "ISO-8859-1")
    both = words.select("id", "n", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), latin.alias("key")), F.struct(F.lit(1).alias("side"), F.encode(F.reverse("word"), "ISO-8859-1").alias("key")))).alias("e"))
    lists = both.select("e.side", F.octet_length("e.key").alias("length"), "e.key", "id", "n")
    lists = lists.repartitionByRange("side", "length", "key").sortWithinPartitions("side", "length", "key")
    stored = segments(lists, segment_words)

    def side(name: str) -> DataFrame:
        return stored.select(F.col("segment").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("side", "length", "keys", "ids", "counts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held(row: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return (np.frombuffer(row[f"{name}_keys"], np.uint8).reshape(-1, row[f"{name}_length"]),
                    np.frombuffer(row[f"{name}_ids"], "<i8"), np.frombuffer(row[f"{name}_counts"], "<i8"))

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                (queries, a_ids, a_n), (targets, b_ids, b_n) = held(row, "a"), held(row, "b")
                m, second = queries.shape[1], row["a_side"] == 1
                i, j = walk(queries, targets, _half(row["a_side"], m))
                wanted = a_ids[i] < b_ids[j] if targets.shape[1] == m else np.ones(len(i), bool)
                if second:  # found in the first sort if the other half is equal too
                    half = m // 2
                    wanted &= (queries[i, m - half:] != targets[j, targets.shape[1] - half:]).any(1)
                i, j = i[wanted], j[wanted]
                columns = (np.concatenate([a_ids[i], b_ids[j]]), np.concatenate([b_ids[j], a_ids[i]]), np.concatenate([b_n[j], a_n[i]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "other", "n"])

    met = segment_pairs(stored).join(side("a"), "a").join(side("b"), "b")
    return arrow_pass(met.drop("a", "b", "b_side"), run, "id long, other long, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of words with a form, from (id, form): pointers are doubled until none leads further.

    A form occurs at least twice as often as its word, so there are no circles and few rounds.
    """
    known = materialize(forms.select("id", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while not known.filter("open").isEmpty():
        ahead = known.select(F.col("id").alias("root"), F.col("root").alias("next"))
        doubled = known.filter("open").join(broadcast_if_small(ahead), "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        known = materialize(doubled.union(known.filter("not open")), "roots", replaces=known)
    return known.select("id", "root")


def spelling_groups(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, lead: int = LEAD, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's near words differ by exactly one inserted, deleted or replaced code point. Its form is the
    most frequent of them (ties: the first in code-point order) if that occurs at least `lead` times as
    often; the root is where forms end, the word itself without one.

    A null text has no words, like an empty one; long texts are read whole; repeated rows count as often as they
    stand there; other columns are not read, whatever their names; an empty table gives no rows.
    """
    counted = vocabulary(docs, min_chars, min_count).repartitionByRange("word").sortWithinPartitions("word")
    words = materialize(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    size = max(segment_words, -(-words.count() // DIRECTORY))
    best = F.max(F.struct(F.col("n"), (-F.col("other")).alias("other")))  # ids are in code-point order
    met = near_words(words, size).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = materialize(met.select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.other")).alias("best")), "near-words")
    joined = words.join(near, "id", "left")
    has_form = F.col("best_n") >= lead * F.col("n")
    placed = materialize(joined.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best")).alias("form_id"), F.when(has_form, F.col("best_n")).alias("form_n")), "word-forms")
    remove(docs.sparkSession, near._stored_at)
    ends = roots(placed.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = placed.filter("form_id is not null").join(ends, "id")
    formed = named.join(broadcast_if_small(words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))), "form_id")
    rooted = formed.join(broadcast_if_small(words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))), "root")
    columns = ("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = placed.filter("form_id is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return rooted.select(*columns).unionByName(alone)
