"""Secrets in texts by a trigram inverted index.

Every rule is a regular expression. Its parse tree gives a Boolean query of trigrams any match must
contain (an OR of ANDs, in lower case). The index keeps, for each segment of rows and each trigram a
rule can ask for, the ids of the rows that hold it; intersecting postings gives a rule's candidates,
and only these are searched with the expression. A rule without mandatory trigrams searches all rows.

The index is built and stored in one pass. Candidates join the documents by broadcast while their
counted number allows, beyond that by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shipping import ship_package
from ..storage import broadcast_if_small, materialize
from .common import free_name, arrow_pass, texts, worker_cache
from .words import row_slices, text_buffer


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches whose `group` has at least `least` characters.

    `quick`, if given, has the same matches but for those that are too short.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    quick: str = ""


# The rules every scan must have.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24, quick=r"[0-9a-f]{24,}"),
)
#: Further kinds of keys with a form of their own.
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
SEGMENT_ROWS = 4096
_MOST_STRINGS = 64

Query = frozenset  # of clauses, each a frozenset of trigrams; a query holds if one clause's trigrams all occur
EVERYTHING: Query = frozenset([frozenset()])


def _either(*queries: Query) -> Query:
    clauses = frozenset().union(*queries)
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > _MOST_STRINGS:  # either side alone is a weaker, valid query
        return min(a, b, key=len)
    return _either(frozenset(x | y for x, y in product(a, b)))


def _holding(strings: Iterable[str]) -> Query:
    """Query of texts that contain one of the strings."""
    grams = [frozenset(s.lower()[i:i + 3] for i in range(len(s) - 2)) for s in strings]
    return _either(frozenset(grams)) if grams else EVERYTHING


def _strings(nodes) -> set[str] | None:
    """All strings the nodes match, if they are few."""
    found = {""}
    for op, value in nodes:
        name = str(op)
        if name == "LITERAL":
            part = {chr(value)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            part = {chr(v) for _, v in value}
        elif name == "SUBPATTERN":
            part = _strings(value[-1])
        elif name == "BRANCH":
            parts = [_strings(b) for b in value[1]]
            part = None if None in parts else set().union(*parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
            part = _strings(value[2])
            part = part and part | {""} if value[0] == 0 else part
        else:
            part = None
        if part is None or len(found) * len(part) > _MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, part)}
    return found


def _required(nodes) -> Query:
    query, run = EVERYTHING, {""}
    for node in nodes:
        name, value = str(node[0]), node[1]
        if name == "AT":
            continue
        part = _strings([node])
        if part is not None and len(run) * len(part) <= _MOST_STRINGS:
            run = {a + b for a, b in product(run, part)}
            continue
        query, run = _both(query, _holding(run)), {""}
        if name == "SUBPATTERN":
            query = _both(query, _required(value[-1]))
        elif name == "BRANCH":
            query = _both(query, _either(*map(_required, value[1])))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0]:
            query = _both(query, _required(value[2]))
        elif part is not None:
            run = part
    return _both(query, _holding(run))


def trigram_query(pattern: str) -> Query:
    """Trigrams a match must contain, as clauses; EVERYTHING if there are none."""
    return _required(re._parser.parse(pattern))


def trigrams(rules: Iterable[Rule]) -> list[str]:
    """All trigrams the rules can ask for."""
    return sorted({g for rule in rules for clause in trigram_query(rule.pattern) for g in clause})


def build_index(docs: DataFrame, grams: list[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Stored postings (segment, gram, doc_ids) of the given trigrams, in lower case.

    A segment is at most `segment_rows` rows that were read together, so no posting is longer. Rows
    with a null id are in no posting; null texts hold no trigram.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        number = np.zeros(1 << 24, np.uint8 if len(grams) < 255 else np.uint16)
        for i, gram in enumerate(grams):
            a, b, c = gram.encode("latin-1")
            number[a << 16 | b << 8 | c] = i + 1
        fold = np.arange(256, dtype=np.uint32)
        fold[65:91] += 32
        names = pa.array(grams)
        for whole in batches:
            for at in range(0, whole.num_rows, segment_rows):
                batch = whole.slice(at, segment_rows)
                batch = batch.filter(batch["doc_id"].is_valid())
                data, offsets = text_buffer(batch["text"])
                pairs = []
                for low, high in row_slices(offsets):
                    text = fold[data[offsets[low]:offsets[high]]]
                    found = number[text[:-2] << 16 | text[1:-1] << 8 | text[2:]]
                    places = np.flatnonzero(found)
                    row = np.searchsorted(offsets, places + offsets[low], "right") - 1
                    inside = places + offsets[low] + 3 <= offsets[row + 1]
                    pairs.append(np.unique(found[places[inside]].astype(np.int64) << 32 | row[inside]))
                pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
                gram, row = (pairs >> 32) - 1, pairs & 0xFFFFFFFF
                heads = np.flatnonzero(np.diff(gram, prepend=-1))
                postings = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)), pa.int32()), batch["doc_id"].take(pa.array(row)))
                segment = pa.array([uuid.uuid4().hex] * len(heads), pa.string())
                yield pa.RecordBatch.from_arrays([segment, names.take(pa.array(gram[heads])), postings], ["segment", "gram", "doc_ids"])

    return materialize(arrow_pass(texts(docs), run, "segment string, gram string, doc_ids array<long>"), "trigram-index")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, mask): bit i tells that rule i can match; rules that search all rows are left out."""
    asked = index.filter(F.col("gram").isin(trigrams(rules)))
    postings = asked.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("gram", "doc_ids"))).alias("postings"))
    nothing = F.array().cast("array<long>")

    def rows_of(clause: frozenset) -> Column:
        lists = [F.coalesce(F.col("postings")[g], nothing) for g in sorted(clause)]
        return reduce(F.array_intersect, lists)

    def hits(query: Query, bit: int) -> Column:
        docs = reduce(F.array_union, map(rows_of, sorted(query, key=sorted)))
        return F.transform(docs, lambda doc: F.struct(doc.alias("doc_id"), F.lit(bit).alias("bit")))

    queries = [trigram_query(rule.pattern) for rule in rules]
    found = [hits(query, 1 << i) for i, query in enumerate(queries) if query != EVERYTHING]
    if not found:
        return index.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("mask")).limit(0)
    return postings.select(F.explode(F.concat(*found)).alias("hit")).select("hit.*").groupBy("doc_id").agg(F.bit_or("bit").alias("mask"))


def find_spans(text: str, rules: tuple[Rule, ...], compiled: list[re.Pattern], mask: int) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in order, of the rules whose bit is set."""
    spans = []
    for i, (rule, pattern) in enumerate(zip(rules, compiled)):
        if mask >> i & 1:
            spans += [(m.start(), i, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return sorted(spans)


def replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every span replaced, those that overlap together."""
    parts, done = [], 0
    for start, _, end in spans:
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def _verified(docs: DataFrame, rules: tuple[Rule, ...], mark: str) -> tuple[DataFrame, str]:
    """docs with a column of the spans of its texts, and the text without them if there are any; and that column's name.

    Only texts go to Python. Needs doc_id and text; other columns stay behind.
    """
    found = materialize(candidates(build_index(docs, trigrams(rules)), rules), "secret-candidates")
    everywhere = sum(1 << i for i, rule in enumerate(rules) if trigram_query(rule.pattern) == EVERYTHING)
    all_rules, own, result = (1 << len(rules)) - 1, free_name(docs, "_mask"), free_name(docs, "_found")
    mask = F.when(F.col("doc_id").isNull(), all_rules).otherwise(F.coalesce(F.col(own), F.lit(0)).bitwiseOR(F.lit(everywhere)))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def search(text: pa.Array, masks: pa.Array) -> pa.Array:
        worker_cache("")
        compiled = [re.compile(rule.quick or rule.pattern, re.ASCII) for rule in rules]
        spans, cleaned = [], []
        for one, bits in zip(text, masks.to_pylist()):
            one = one.as_py() or ""
            own = find_spans(one, rules, compiled, bits)
            spans.append([{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in own])
            cleaned.append(replaced(one, own, mark) if own else None)
        return pa.StructArray.from_arrays([pa.array(spans, pa.list_(span)), pa.array(cleaned, pa.string())], names=["spans", "cleaned"])

    search.__annotations__ = {"text": pa.Array, "masks": pa.Array, "return": pa.Array}
    ship_package(docs.sparkSession)
    kind = "struct<spans:array<struct<kind:string,start:int,end:int>>,cleaned:string>"
    marked = docs.join(broadcast_if_small(found.withColumnRenamed("mask", own)), "doc_id", "left").withColumn(own, mask)
    return marked.withColumn(result, F.arrow_udf(search, kind).asNondeterministic()("text", own)).drop(own), result


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of docs and `spans`, the matches of every rule in order of start and rule.

    Places count code points, ends are exclusive. Null and empty texts have no spans; a row with a
    null doc_id is searched with all rules; rows that share an id are searched with the rules of any.
    """
    found, result = _verified(docs.drop("spans"), rules, "")
    return found.withColumn("spans", F.col(result)["spans"]).drop(result)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of its texts replaced, and `redacted`; overlapping spans go together.

    All rows stay, with their other columns; an own column `redacted` is replaced. A null text stays null, an empty one
    empty; long texts are searched whole, rows that repeat a doc_id with the rules of any; an empty table stays empty.
    """
    found, result = _verified(docs, rules, mark)
    cleaned = F.col(result)["cleaned"]
    return found.withColumns({"text": F.coalesce(cleaned, "text"), "redacted": cleaned.isNotNull()}).drop(result)
