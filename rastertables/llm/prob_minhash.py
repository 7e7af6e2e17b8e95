"""Near duplicates by ProbMinHash, banding and verification.

A document is the weighted set of its five-word shingles, a weight being the shingle's count. Each
shingle is a Poisson process with its weight as rate; every arrival falls into one register, and the
earliest arrival's shingle is the register's value. Shingles whose next arrival is later than all
registers' earliest stop. Two documents agree in a register with their probability Jaccard similarity

    J(x, y) = sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i),

which is the common Jaccard similarity where all counts are equal.

Documents with the same weighted set are one node. Nodes that agree in all registers of a band share a
bucket. A bucket is not expanded into pairs: first its most popular node, the pivot, is compared with the
others by the exact J, and the links found join nodes to components. As a rule this leaves one component
a bucket. Where it doesn't, the nodes outside the pivot's component meet all others in blocks of bounded
size, and a block returns only its links; nodes of the pivot's component do not meet one another. So
every pair of a bucket is compared or connected otherwise, and classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import broadcast_if_small, materialize
from .common import arrow_pass, text_key, texts
from .components import components
from .words import Words, mix, word_slices

SHINGLE, THRESHOLD = 5, 0.8
#: Two nodes with J = 0.8 share no bucket with a probability of 1 in 9000.
BANDS, BAND_ROWS = 30, 6
#: Nodes and bytes of weighted sets in one block of a bucket.
BLOCK_NODES, BLOCK_BYTES = 512, 16 << 20

_EVENT = np.uint64(0x9FB21C651E98DF25)


def weighted_shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles, in order of row and hash.

    A text of fewer words is one shingle; a text without words has none.
    """
    hashes, row_of, count = words.hashes(), words.row_of(), np.diff(words.rows)
    rows, codes = [], []
    for length in range(1, size + 1):
        first, code = words.windows(hashes, length)
        row = row_of[first]
        own = np.flatnonzero(count[row] == length) if length < size else slice(None)
        rows.append(row[own])
        codes.append(code[own] + np.uint64(length))
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[heads], code[heads], np.diff(np.append(heads, len(row)))


def node_hashes(row: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each row's weighted set."""
    total = np.zeros(rows, np.uint64)
    np.add.at(total, row, mix(code ^ mix(weight.astype(np.uint64))))
    return mix(total)


def signatures(row: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """ProbMinHash values, rows x registers; rows without shingles have zeros.

    `row` must be ascending. A row's shingles together make about as many arrivals as fill all
    registers before its latest register is looked at; from then on only those that can still win go on.
    """
    q = np.full(rows * registers, np.inf)
    sizes = np.maximum(np.bincount(row, minlength=rows), 1)
    share = np.maximum(1, -(-int(registers * (np.log(registers) + 1)) // sizes))
    alive, at, made = np.arange(len(row)), np.zeros(len(row)), np.zeros(len(row), np.int64)
    events = []
    while len(alive):
        n = share[row[alive]]
        ends = np.cumsum(n)
        element = np.repeat(alive, n)
        number = np.arange(int(ends[-1])) - np.repeat(ends - n, n) + made[element]
        bits = mix(code[element] + number.astype(np.uint64) * _EVENT)
        gaps = -np.log(((bits >> np.uint64(24)) + np.uint64(1)).astype(float) * 2.0**-40) / weight[element]
        run = np.cumsum(gaps)
        start = np.concatenate([[0.0], run[ends[:-1] - 1]])
        times = run - np.repeat(start - at[alive], n)
        place = row[element] * registers + ((bits & np.uint64(0xFFFFFF)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
        early = np.flatnonzero(times < q[place])
        np.minimum.at(q, place[early], times[early])
        events.append((place[early], times[early], element[early]))
        at[alive], made[alive] = times[ends - 1], made[alive] + n
        latest = q.reshape(rows, registers).max(1)
        alive = alive[at[alive] < latest[row[alive]]]
        share = np.ones(rows, np.int64) if np.isfinite(latest[row[alive]]).all() else share
    values = np.zeros(rows * registers, np.uint64)
    for place, times, element in events:
        won = times == q[place]
        values[place[won]] = code[element[won]]
    return values.reshape(rows, registers)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    factors = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    joined = (values.reshape(len(values), bands, rows) * factors).sum(2, dtype=np.uint64)
    return mix(joined + mix(np.arange(bands, dtype=np.uint64)))


def similarity(a_code: np.ndarray, a: np.ndarray, b_code: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets with ascending codes."""
    _, i, j = np.intersect1d(a_code, b_code, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[i].astype(float), b[j].astype(float)
    only_a, only_b = float(a.sum()) - x.sum(), float(b.sum()) - y.sum()
    shapes, times = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    total = 0.0
    for (u, v), n in zip(shapes, times):
        total += n / (only_a / u + only_b / v + (np.maximum(shapes[:, 0] / u, shapes[:, 1] / v) * times).sum())
    return total


def describe(docs: DataFrame, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, text_key, node, keys): the hash of each document's weighted set and its band keys.

    `node` and `keys` are null for texts without words and for rows with a null id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            for low, high, words in word_slices(batch["text"]):
                n = high - low
                row, code, weight = weighted_shingles(words)
                keys = band_keys(signatures(row, code, weight, n, bands * band_rows), bands, band_rows)
                void = (np.bincount(row, minlength=n) == 0) | ~ids[low:high]
                nodes = pa.array(node_hashes(row, code, weight, n).view(np.int64), mask=void)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)), mask=pa.array(void))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(low, n), batch["text_key"].slice(low, n), nodes, lists], ["doc_id", "text_key", "node", "keys"])

    return arrow_pass(docs.withColumn("text_key", text_key()), run, "doc_id long, text_key long, node long, keys array<long>")


def weighted_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, codes, counts) of the wanted (doc_id, node), as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words in word_slices(batch["text"]):
                row, code, weight = weighted_shingles(words)
                ends = np.searchsorted(row, np.arange(high - low + 1))
                own = pa.array(node_hashes(row, code, weight, high - low).view(np.int64))
                codes = [code[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                counts = [weight[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]
                part = pa.RecordBatch.from_arrays([own, pa.array(codes, pa.binary()), pa.array(counts, pa.binary())], ["node", "codes", "counts"])
                yield part.filter(pc.equal(own, batch["node"].slice(low, high - low)))

    return arrow_pass(docs.join(broadcast_if_small(wanted), "doc_id").select("text", "node"), run, "node long, codes binary, counts binary")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, j) of distinct pairs of nodes, j their exact similarity.

    v is the side that many pairs share: its join is last, where adaptive execution splits it.
    """
    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("codes").alias(f"{name}_codes"), F.col("counts").alias(f"{name}_counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                similarity(np.frombuffer(a.as_py(), "<u8"), np.frombuffer(m.as_py(), "<u4"), np.frombuffer(b.as_py(), "<u8"), np.frombuffer(n.as_py(), "<u4"))
                for a, m, b, n in zip(*(batch[c] for c in ("u_codes", "u_counts", "v_codes", "v_counts")))
            ]
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(found, pa.float64())], ["u", "v", "j"])

    return arrow_pass(pairs.join(side("u"), "u").join(side("v"), "v"), run, "u long, v long, j double")


def pivot_links(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of nodes to their buckets' pivots, and (key, node, pivot) of all other nodes."""
    tops = members.groupBy("key").agg(F.max(F.struct("rank", "node"))["node"].alias("v"))
    met = materialize(members.join(tops, "key").filter("node <> v").select("key", F.col("node").alias("u"), "v"), "bucket-members")
    compared = compare(met.select("u", "v").distinct(), sets).filter(F.col("j") >= threshold)
    return materialize(compared.select("u", "v"), "pivot-links"), met.select("key", F.col("u").alias("node"), F.col("v").alias("pivot"))


def block_links(frame: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Links that connect a block's nodes of different components, fewer than its nodes: those outside the pivot's one, and all.

    Shared shingles are counted by matrix products over shingles that occur twice at least. Where all counts
    are equal this gives J; otherwise the shared mass bounds J, and pairs within the bound are compared.
    """
    frame = frame.drop_duplicates("node").sort_values("outer", ascending=False, kind="stable")
    codes = [np.frombuffer(c, "<u8") for c in frame["codes"]]
    counts = [np.frombuffer(c, "<u4") for c in frame["counts"]]
    node, label, n, outer = frame["node"].to_numpy(), frame["label"].to_numpy(), len(frame), int(frame["outer"].sum())
    size = np.array([len(c) for c in codes])
    plain = np.array([(c == c[0]).all() for c in counts])
    _, column, often = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    mass = np.concatenate([c / c.sum() for c in counts])
    row, used = np.repeat(np.arange(n), size), often[column] > 1
    new = np.cumsum(often > 1) - 1
    row, column, mass = row[used], new[column[used]], mass[used]
    order = np.argsort(column, kind="stable")
    row, column, mass = row[order], column[order], mass[order]
    shared, mine, theirs = np.zeros((outer, n)), np.zeros((outer, n)), np.zeros((outer, n))
    for low in range(0, int(new[-1]) + 1 if len(new) else 0, 2048):
        part = slice(*np.searchsorted(column, [low, low + 2048]))
        has, weight = np.zeros((n, 2048), np.float32), np.zeros((n, 2048), np.float32)
        has[row[part], column[part] - low], weight[row[part], column[part] - low] = 1, mass[part]
        shared += has[:outer] @ has.T
        if not plain.all():
            mine += weight[:outer] @ has.T
            theirs += has[:outer] @ weight.T
    wanted = (label[:outer, None] != label[None]) & ((np.arange(n) >= outer)[None] | (np.arange(outer)[:, None] < np.arange(n)[None]))
    both = plain[:outer, None] & plain[None]
    linked = wanted & both & (shared / (size[:outer, None] + size[None] - shared) >= threshold)
    for i, j in zip(*np.nonzero(wanted & ~both & (np.minimum(mine, theirs) >= threshold - 1e-3))):
        linked[i, j] = similarity(codes[i], counts[i], codes[j], counts[j]) >= threshold
    i, j = spanning_forest(linked)
    return pd.DataFrame({"u": node[i], "v": node[j]})


def spanning_forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer than n of the links of n nodes (the first ones' rows of a symmetric matrix) that connect the same nodes."""
    rows, n = linked.shape
    both = np.zeros((n, n), bool)
    both[:rows] = linked
    both |= both.T
    new, edges = np.ones(n, bool), []
    for root in range(rows):
        waiting = [root] if new[root] else []
        new[root] = False
        while waiting:
            at = waiting.pop()
            reached = np.flatnonzero(both[at] & new)
            new[reached] = False
            edges.append(np.column_stack([np.full(len(reached), at), reached]))
            waiting += reached.tolist()
    found = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    return found[:, 0], found[:, 1]


def rest_links(members: DataFrame, links: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Further links (u, v) in buckets that `links` leave in more than one component."""
    found = components(links).withColumnRenamed("component", "label")

    def labelled(frame: DataFrame, node: str, name: str) -> DataFrame:
        joined = frame.join(found.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left")
        return joined.withColumn(name, F.coalesce(name, node))

    marked = labelled(labelled(members, "node", "label"), "pivot", "pivot_label")
    marked = marked.withColumn("outer", F.col("label") != F.col("pivot_label")).drop("pivot", "pivot_label")
    sized = marked.join(sets.select("node", (F.octet_length("codes") * 3 / 2).alias("size")), "node")
    outer = F.col("outer")

    def blocks(of: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(of) / BLOCK_NODES), F.ceil(F.sum(F.when(of, F.col("size")).otherwise(0)) / BLOCK_BYTES))

    buckets = sized.groupBy("key").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"),
        blocks(outer).cast("int").alias("outside"), blocks(~outer).cast("int").alias("inside"),
    ).filter("n > 1 and low < high").drop("n", "low", "high")
    alive = sized.drop("size").join(buckets, "key")
    block = F.pmod(F.xxhash64("node"), F.when(outer, F.col("outside")).otherwise(F.col("inside"))).cast("int")
    # every outer block meets itself, the outer blocks after it (numbers from 0), and the inner ones (below 0)
    upto = F.sequence(F.lit(0), F.col("outside") - 1)
    first = F.transform(F.filter(upto, lambda k: k >= F.col("block")), lambda k: F.struct(F.col("block").alias("a"), k.alias("b")))
    second = F.transform(F.filter(upto, lambda k: k < F.col("block")), lambda k: F.struct(k.alias("a"), F.col("block").alias("b")))
    inner = F.when(F.col("inside") > 0, F.transform(F.sequence(F.lit(1), F.col("inside")), lambda k: F.struct(
        F.col("block").alias("a"), (-k).alias("b")))).otherwise(F.array())
    meetings = F.when(outer, F.concat(first, second, inner)).otherwise(
        F.transform(upto, lambda k: F.struct(k.alias("a"), (-1 - F.col("block")).alias("b"))))
    placed = alive.withColumn("block", block).select("key", "node", "label", "outer", F.explode(meetings).alias("m"))
    grouped = placed.select("key", "m.*", "node", "label", "outer").join(sets, "node").groupBy("key", "a", "b")
    return grouped.applyInPandas(lambda frame: block_links(frame, threshold), "u long, v long")


def near_links(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v) links that connect all nodes of a bucket which pairs of at least `threshold` connect.

    `members` has (key, node, rank): buckets with two nodes or more; a larger rank makes a pivot earlier.
    """
    links, others = pivot_links(members, sets, threshold)
    return links.union(materialize(rest_links(others, links, sets, threshold), "block-links"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, class_id, class_size, kept, text_key) of every row.

    A class holds the documents that links of at least `threshold` connect, among them all with equal
    weighted sets; class_id is its smallest doc_id, and that row is kept (rows that repeat this id
    too). Texts without words and rows with a null id are classes of their own. Words are parted
    by white space and compared unchanged.
    """
    rows = texts(docs)
    described = materialize(describe(rows, bands, band_rows), "signatures")
    nodes = described.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    nodes = materialize(nodes, "near-nodes")
    placed = nodes.select("node", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").count().filter("count > 1")
    members = materialize(placed.join(shared, "key"), "near-buckets")
    ranks = members.groupBy("node").agg(F.sum("count").alias("rank"))
    members = members.drop("count").join(ranks, "node")
    sets = materialize(weighted_sets(rows, ranks.join(nodes, "node").select("doc_id", "node")), "weighted-sets")
    found = components(near_links(members, sets, threshold))
    labelled = nodes.drop("keys").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = labelled.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    labelled = labelled.join(classes, "component").select("node", "class_id", "class_size")
    class_id = F.coalesce("class_id", "doc_id")
    return described.select("doc_id", "text_key", "node").join(labelled, "node", "left").select(
        "doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.col("doc_id").eqNullSafe(class_id).alias("kept"), "text_key",
    )
