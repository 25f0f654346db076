"""Exact Jaccard join of documents on word n-grams through a token-group matrix.

1. Every document's set of shingle hashes is made from its whole text. Documents
   with equal sets are one class, represented by its smallest id.
2. Similar documents are put into groups: those whose sets share a min-hash band
   follow the same leader, mostly from a similarity of about one half on. A leader
   is compared with its followers, and documents that are linked by this are a
   group of their own. Groups are cut into blocks of bounded size and near sizes of
   sets. No result depends on the grouping.
3. The first shingles of a set, in one order for all, rare ones first, are its
   prefix. As of two similar sets the larger one is the query, it asks with its
   first n - ceil(t n) + 1 shingles for groups that hold one of them among the first
   m - ceil(2 t m / (1 + t)) + 1 of a member: these (shingle, group) rows are the
   sparse form of the token-group matrix.
4. The union of each group that is asked for is stored as a bit row, and a query's bit
   row bounds the overlap with it, and so with every member. Groups whose bound
   reaches the least overlap that any member needs are stored whole, as the union of
   shingles and each member's places in it. The exact overlap with the union bounds
   once more; then the group is opened and its members are compared, all at once.

Queries don't ask groups of documents that are all linked with them already, so
groups of copies never come as pairs, and no step holds more than a group of bounded
size, a query and a window of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.chunks import given_back, mixed, sliced, span_hashes, text_bytes, windows, word_spans
from loomframe.llm.components import components
from loomframe.llm.shared import dropped, hot_join, partitions, released, rows_with, written

#: Members of a group, and shingles of all of them together, if it has several.
BLOCK, BLOCK_SHINGLES = 32, 1 << 20
BANDS, ROWS = 8, 3
#: Common shingles are known by at most so many entries; the order is right with any of them.
COMMON = 1 << 18
#: Shingles that a task counts at a time.
COUNTED = 1 << 21
#: Queries to a group that one task compares.
QUERIES = 256
_random = np.random.default_rng(7)
_PLACES = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z to a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Starts of equal parts of the hash space; a part's least shingle is a min-hash of the set.
_PARTS = np.linspace(0, 2.0**64, BANDS * ROWS, endpoint=False).astype(np.uint64)


def least_hashes(values: np.ndarray) -> np.ndarray:
    """The least shingle of each part of the hash space; an empty part takes that of the next full one."""
    at = np.searchsorted(values, _PARTS)
    at[at == len(values)] = 0
    return values[at]


def sketch(values: np.ndarray) -> bytes:
    """A bit row of at least two bits a shingle, to a power of two: the bits of the set's shingles are set."""
    width = 1 << min(20, max(8, int(2 * len(values) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(values >> np.uint64(20)).astype(np.int64) & (width - 1)] = True
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bit row in ``size`` bytes."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def most_overlap(n: int, query: np.ndarray, union: np.ndarray) -> int:
    """An upper bound of the shingles that a set of n has in a union, by their bit rows: shingles that share a bit may all be in it."""
    size = min(len(query), len(union))
    query = folded(query, size)
    return int(np.bitwise_count(query & folded(union, size)).sum()) + n - int(np.bitwise_count(query).sum())


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text: A-Z lower-cased, words parted by 0x20 and 0x09-0x0D.

    A text of fewer words is one shingle; a text without words, or null, has none.
    """

    def sets(hashes: np.ndarray) -> np.ndarray:
        if len(hashes) >= words:
            out = np.zeros(len(hashes) - words + 1, np.uint64)
            for k in range(words):
                out += hashes[k : len(hashes) - words + 1 + k] * _PLACES[k]
            out.sort()
            out = mixed(out)
        elif len(hashes):
            out = mixed(np.sum(np.concatenate([hashes * _PLACES[: len(hashes)], _PLACES[50 + len(hashes) :][:1]]), keepdims=True, dtype=np.uint64))
        else:
            return hashes
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]

    data, offsets = text_bytes(column)
    held, row = [], -1
    for lo, hi, piece, at in windows(data, offsets):
        lower = _LOWER[piece]
        starts, ends = word_spans(lower, at)
        hashes = span_hashes(lower, starts, ends)
        if row >= 0 and row != lo:
            yield row, sets(np.concatenate(held))
            held, row = [], -1
        if hi == lo + 1:
            held.append(hashes)
            row = lo
            continue
        cut = np.searchsorted(starts, at).tolist()
        for k in range(hi - lo):
            yield lo + k, sets(hashes[cut[k] : cut[k + 1]])
    if row >= 0:
        yield row, sets(np.concatenate(held))


def needed(n: int, percent: int) -> int:
    """The least overlap that a set of n elements has with a similar one."""
    return -(-percent * n // 100)


def needed_by_larger(n: int, percent: int) -> int:
    """The least overlap that a set of n elements has with a similar one of no fewer."""
    return -(-2 * percent * n // (100 + percent))


def overlap(small: np.ndarray, large: np.ndarray) -> int:
    if not len(large):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small))


_SIGNATURES = "kind int, id long, n long, k1 long, k2 long, bands array<long>, bits binary"


def _signatures(words: int):
    """kind 0: a row per document with its set's size, fingerprint and bands; kind 1: shingles that several sets of a task have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held, n_held = [], 0

        def common() -> pa.RecordBatch:
            nonlocal held, n_held
            values, counts = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            held, n_held = [], 0
            seen.clear()
            values, counts = values[counts > 1], counts[counts > 1]
            none = pa.nulls(len(values), pa.int64())
            return pa.record_batch([pa.array(np.ones(len(values), np.int32)), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64)), none, none, pa.nulls(len(values), pa.list_(pa.int64())), pa.nulls(len(values), pa.binary())], schema=arrow)

        for batch in sliced(batches):
            rows = batch.num_rows
            sizes, k1, k2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            bands: list[list[int] | None] = [None] * rows
            bits: list[bytes | None] = [None] * rows
            for row, values in shingle_sets(batch.column("text"), words):
                if not len(values):
                    continue
                sizes[row] = len(values)
                key = k1[row], k2[row] = values.sum(dtype=np.uint64), mixed(values * _PLACES[9]).sum(dtype=np.uint64)
                least = least_hashes(values)
                joined = mixed((least.reshape(BANDS, ROWS) * _PLACES[10 : 10 + ROWS]).sum(axis=1, dtype=np.uint64) + _PLACES[20 : 20 + BANDS])
                bands[row] = joined.view(np.int64).tolist()
                bits[row] = sketch(values)
                if key not in seen:
                    seen.add(key)
                    for k in range(0, len(values), COUNTED):
                        held.append(values[k : k + COUNTED])
                        n_held += len(held[-1])
                        if n_held >= COUNTED:
                            yield common()
            full = sizes > 0
            yield pa.record_batch([pa.array(np.zeros(rows, np.int32)), batch.column("id"), pa.array(sizes), pa.array(k1.view(np.int64), mask=~full), pa.array(k2.view(np.int64), mask=~full), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())], schema=arrow)
        yield common()

    arrow = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.binary())])
    return run


def _common(signatures: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with the largest counts of what the tasks found, as many as ``COMMON`` holds, sorted by shingle.

    A histogram of the counts, at most a few hundred rows, gives the least count, so no more than these rows are sent.
    """
    counts = written(signatures.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter("n >= 6"), "ngram-counts")
    size_class = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    taken, least = 0, 1 << 30
    for row in counts.groupBy(size_class.alias("c")).agg(F.count("*").alias("m")).orderBy(F.desc("c")).collect():
        taken += row["m"]
        if taken > COMMON:
            break
        least = row["c"]
    table = counts.filter(size_class >= least).select("id", "n").toArrow()
    shingles, n = table.column("id").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(shingles)
    dropped(counts)
    return shingles[order], n[order]


def _prefixes(words: int, percent: int, common: np.ndarray, counts: np.ndarray):
    """(shingle, id, n, indexed) rows of each document's prefix; indexed is true for those with which it is found by larger sets.

    A set that the task has seen before is left out, its class has it already.
    """
    hints = np.zeros(1 << 20, bool)
    hints[(common >> np.uint64(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in sliced(batches):
            ids = batch.column("id").to_pylist()
            out, rows, sizes, first = [], [], [], []
            for row, values in shingle_sets(batch.column("text"), words):
                if not len(values) or ids[row] is None:
                    continue
                key = int(values.sum(dtype=np.uint64)), int(mixed(values * _PLACES[9]).sum(dtype=np.uint64))
                if key in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(key)
                n = len(values)
                width = n - needed(n, percent) + 1
                maybe = np.flatnonzero(hints[(values >> np.uint64(44)).astype(np.int64)])
                if len(maybe):
                    at = np.searchsorted(common, values[maybe])
                    at[at == len(common)] = 0
                    hit = common[at] == values[maybe]
                    if hit.any():
                        late = np.zeros(n, bool)
                        late[maybe[hit]] = True
                        hot, rank = values[late], counts[at[hit]]
                        values = np.concatenate([values[~late], hot[np.lexsort((hot, rank))]])
                out.append(values[:width])
                rows.append(ids[row])
                sizes.append(n)
                first.append(np.arange(width) <= n - needed_by_larger(n, percent))
            if out:
                each = [len(x) for x in out]
                yield pa.record_batch({"shingle": np.concatenate(out).view(np.int64), "id": np.repeat(rows, each), "n": np.repeat(sizes, each), "indexed": np.concatenate(first)})

    return run


def _met_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, indexed ones first, those of shingles that are indexed and have several different rows."""
    last = waiting = None
    good = False
    for batch in batches:
        if not batch.num_rows:
            continue
        s, who, n, indexed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "id", "n", "indexed"))
        again = np.concatenate([[last is not None and last == (s[0], who[0], n[0])], (s[1:] == s[:-1]) & (who[1:] == who[:-1]) & (n[1:] == n[:-1])])
        goes_on = last is not None and last[0] == s[0]
        last = s[-1], who[-1], n[-1]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        group = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
        sizes = np.add.reduceat((~again).astype(np.int64), starts)
        first = indexed[starts].copy()
        several = sizes > 1
        if goes_on:
            first[0] = good
            several[0] |= sizes[0] > 0
            if waiting is not None and good and several[0]:
                yield waiting
                waiting = None
            elif waiting is None:
                several[0] = True
        keep = (first & several)[group] & ~again
        good = bool(first[-1])
        if len(starts) > 1 or not goes_on:
            waiting = batch.slice(int(starts[-1]), 1) if good and sizes[-1] == 1 else None
        if keep.any():
            yield batch.filter(pa.array(keep))


def _sets(words: int):
    """(id, key, n, shingles) of each text's set; one that the task has given before for the id is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in sliced(batches):
            ids, out, size = batch.column("id").to_pylist(), [], 0
            for row, values in shingle_sets(batch.column("text"), words):
                key = int(mixed(values).sum(dtype=np.uint64).view(np.int64))
                if (ids[row], key) in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add((ids[row], key))
                out.append({"id": ids[row], "key": key, "n": len(values), "shingles": values.tobytes()})
                size += 8 * len(values)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])
    return run


_GROUP = "block long, parts int, low long, n_union long, n_members int, bytes binary"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams (block, parts, id, shingles) sorted by block; gives each group as one row: ids, sizes, union, and all members' places in the union. Without parts, a group has one."""

    def row(block: int, parts: int, members: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        union = members[0][1] if len(members) == 1 else np.unique(np.concatenate([v for _, v in members]))
        sizes = np.array([len(v) for _, v in members], np.int64)
        places = np.concatenate([np.searchsorted(union, v) for _, v in members]).astype(np.int32)
        blob = b"".join((np.array([i for i, _ in members], np.int64).tobytes(), sizes.tobytes(), union.tobytes(), places.tobytes()))
        return pa.RecordBatch.from_pylist([{"block": block, "parts": parts, "low": int(sizes.min()), "n_union": len(union), "n_members": len(members), "bytes": blob}], schema=arrow)

    arrow = pa.schema([("block", pa.int64()), ("parts", pa.int32()), ("low", pa.int64()), ("n_union", pa.int64()), ("n_members", pa.int32()), ("bytes", pa.binary())])
    block, parts, members = None, 0, []
    for batch in batches:
        shingles = batch.column("shingles")
        all_parts = batch.column("parts").to_pylist() if "parts" in batch.schema.names else [1] * batch.num_rows
        for k, (key, its_parts, doc) in enumerate(zip(batch.column("block").to_pylist(), all_parts, batch.column("id").to_pylist())):
            if key != block and members:
                yield row(block, parts, members)
                members = []
            block, parts = key, its_parts
            members.append((doc, np.frombuffer(shingles[k].as_buffer(), np.uint64).copy()))
    if members:
        yield row(block, parts, members)
    given_back()


class Group:
    """A stored group. Its members' places are read only when it is opened."""

    def __init__(self, low: int, n_union: int, n_members: int, blob: bytes):
        self.low, self.blob, self.n_union, self.n_members = low, blob, n_union, n_members
        self.union = np.frombuffer(blob, np.uint64, n_union, 16 * n_members)
        self.members = None

    def open(self) -> None:
        if self.members is None:
            self.ids = np.frombuffer(self.blob, np.int64, self.n_members)
            self.sizes = np.frombuffer(self.blob, np.int64, self.n_members, 8 * self.n_members)
            self.places = np.frombuffer(self.blob, np.int32, -1, 16 * self.n_members + 8 * self.n_union)
            self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
            self.members = True

    def linked(self, doc: int, values: np.ndarray, percent: int) -> list[int] | None:
        """Ids of similar members; None if the bound of the overlap with the union leaves the group closed."""
        at = np.searchsorted(self.union, values)
        at[at == self.n_union] = 0
        at = at[self.union[at] == values]
        n = len(values)
        if len(at) < least_overlap(n, self.low, percent):
            return None
        self.open()
        hit = np.zeros(self.n_union, bool)
        hit[at] = True
        both = np.add.reduceat(hit[self.places], self.starts, dtype=np.int64)
        return self.ids[(100 * both >= percent * (n + self.sizes - both)) & (self.ids != doc)].tolist()


def _opened(percent: int):
    """Streams (block, part, role, id, low, n_union, n_members, bytes): a stored group, then its queries; gives links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            a, b = [], []
            blobs = batch.column("bytes")
            for k, (role, doc, low, n_union, n_members) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("role", "id", "low", "n_union", "n_members")])):
                if role == 0:
                    group = Group(low, n_union, n_members, blobs[k].as_py())
                    continue
                found = group.linked(doc, np.frombuffer(blobs[k].as_buffer(), np.uint64), percent)
                if found:
                    a += [doc] * len(found)
                    b += found
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        given_back()

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams (block, parts, n, bits) sorted by block; gives each group's least size and the bit row of its union."""
    block, parts, low, bits = None, 0, 0, np.empty(0, np.uint8)
    for batch in batches:
        out, rows = [], batch.column("bits")
        for k, (key, its_parts, n) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("block", "parts", "n")])):
            row = np.frombuffer(rows[k].as_buffer(), np.uint8)
            if key == block:
                size = min(len(row), len(bits))
                low, bits = min(low, n), folded(bits, size) | folded(row, size)
                continue
            if block is not None:
                out.append({"block": block, "parts": parts, "low": low, "bits": bits.tobytes()})
            block, parts, low, bits = key, its_parts, n, row.copy()
        yield pa.RecordBatch.from_pylist(out, schema=_UNION)
    if block is not None:
        yield pa.RecordBatch.from_pylist([{"block": block, "parts": parts, "low": low, "bits": bits.tobytes()}], schema=_UNION)
    given_back()


_UNION = pa.schema([("block", pa.int64()), ("parts", pa.int32()), ("low", pa.int64()), ("bits", pa.binary())])


def least_overlap(n: int, low: int, percent: int) -> int:
    """What a set of n needs in common with any similar one of ``low`` or more."""
    return max(needed(n, percent), -(-percent * (n + low) // (100 + percent)))


def _qualified(percent: int):
    """Streams (block, part, role, id, n, bits): a group's union, then its queries; gives those whose bound leaves the group open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, union = 0, np.empty(0, np.uint8)
        for batch in batches:
            blocks, ids, bits = [], [], batch.column("bits")
            for k, (block, role, doc, n) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("block", "role", "id", "n")])):
                row = np.frombuffer(bits[k].as_buffer(), np.uint8)
                if role == 0:
                    low, union = n, row.copy()
                elif most_overlap(n, row, union) >= least_overlap(n, low, percent):
                    blocks.append(block)
                    ids.append(doc)
            yield pa.record_batch({"block": pa.array(blocks, pa.int64()), "id": pa.array(ids, pa.int64())})
        given_back()

    return run


def _parts(queries: DataFrame) -> DataFrame:
    """(block, parts): a group with many queries is sent to several tasks."""
    return queries.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))


def _dealt(queries: DataFrame) -> DataFrame:
    """Each query (block, id) with its part, before it has its bits or its set: these are then shuffled only to their group."""
    return queries.join(_parts(queries), "block").select("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")


def _met(offered: DataFrame, asking: DataFrame) -> DataFrame:
    """Rows of groups (role 0; block, parts) and of their queries (role 1; block, part), by group."""
    offered = offered.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "role": F.lit(0)}).drop("parts")
    rows = offered.unionByName(asking.withColumn("role", F.lit(1)), allowMissingColumns=True)
    return rows.repartition(partitions(offered.sparkSession), "block", "part").sortWithinPartitions("block", "part", "role")


def _links(queries: DataFrame, members: DataFrame, bits: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of queries (block, id) to members (block, id), written: unions bound the queries first, then groups are opened."""
    n = partitions(queries.sparkSession)
    by_block = lambda df: df.repartition(n, "block").sortWithinPartitions("block")
    asked = written(members.join(_parts(queries), "block"), "ngram-asked")
    some = written(queries.select("id").unionByName(asked.select("id")).distinct(), "ngram-some")
    bits = written(rows_with(bits, some, "id", exact=False), "ngram-bits")
    unions = written(by_block(asked.join(bits, "id").select("block", "parts", "n", "bits")).mapInArrow(_united, "block long, parts int, low long, bits binary"), "ngram-unions")
    met = _met(unions.withColumnRenamed("low", "n"), _dealt(queries).join(bits, "id").select("block", "part", "id", "n", "bits"))
    close = written(met.mapInArrow(_qualified(percent), "block long, id long"), "ngram-close")
    dropped(some, bits, unions)
    released(queries.sparkSession)
    opened = written(asked.select("block", "id").join(_parts(close), "block"), "ngram-opened")
    needed_ids = written(close.select("id").unionByName(opened.select("id")).distinct(), "ngram-needed")
    sets = rows_with(texts, needed_ids, "id", exact=False).mapInArrow(_sets(words), "id long, key long, n long, shingles binary")
    sets = written(sets.join(needed_ids, "id", "left_semi").dropDuplicates(["id", "n", "key"]).select("id", "shingles"), "ngram-sets")
    groups = written(by_block(opened.join(sets, "id").select("block", "parts", "id", "shingles")).mapInArrow(_stored, _GROUP), "ngram-groups")
    asking = _dealt(close).join(sets, "id").select("block", "part", "id", F.col("shingles").alias("bytes"))
    links = written(_met(groups, asking).mapInArrow(_opened(percent), "a long, b long"), "ngram-links")
    dropped(asked, close, opened, needed_ids, sets, groups)
    released(queries.sparkSession)
    return links


class Prepared(NamedTuple):
    """What the join knows before groups are opened; all tables are written."""

    rows: DataFrame
    """id, n of every input row."""
    copies: DataFrame
    """id, first: ids whose set is that of a smaller id."""
    stars: DataFrame
    """a, b: links of followers with their leaders."""
    members: DataFrame
    """block, id: who is in which group."""
    queries: DataFrame
    """block, id: which document asks which group."""
    bits: DataFrame
    """id, n, bits: the bit row of each class."""
    gone: list[DataFrame]


def prepared(texts: DataFrame, words: int = 5, percent: int = 75) -> Prepared:
    """Classes, groups and the queries of texts (id, text) to groups."""
    spark = texts.sparkSession
    signatures = written(texts.mapInArrow(_signatures(words), _SIGNATURES), "ngram-signatures")
    common, counts = _common(signatures)
    rows = written(signatures.filter("kind = 0").select("id", "n", "k1", "k2"), "ngram-rows")
    known = rows.filter("n > 0 and id is not null")
    classes = written(signatures.filter("kind = 0 and n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "ngram-classes")
    dropped(signatures)
    repeated = written(classes.filter("copies > 1").drop("bands", "bits"), "ngram-repeated")
    copies = written(hot_join(known.select("id", "n", "k1", "k2"), repeated, ["n", "k1", "k2"]).filter("first < id").select("id", "first"), "ngram-copies")

    bands = classes.select(F.col("first").alias("id"), F.explode(F.array_distinct("bands")).alias("band"))
    leaders = written(bands.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("copies")).filter("copies > 1"), "ngram-leaders")
    follows = written(hot_join(rows_with(bands, leaders, "band", exact=False), leaders, ["band"]).groupBy("id").agg(F.min("leader").alias("leader")).filter("leader < id"), "ngram-follows")
    bits = classes.select(F.col("first").alias("id"), "n", "bits")
    stars = _links(follows.select(F.col("leader").alias("block"), "id"), follows.select(F.col("leader").alias("block"), F.col("leader").alias("id")).distinct(), bits, texts, words, percent)
    linked = written(components(stars, "a", "b"), "ngram-linked")
    dropped(leaders)
    released(spark)

    cells = "shingle long, id long, n long, indexed boolean"
    in_order = lambda df: df.repartition(partitions(spark), "shingle").sortWithinPartitions("shingle", F.desc("indexed"), "id", "n").mapInArrow(_met_only, cells)
    found = written(in_order(texts.mapInArrow(_prefixes(words, percent, common, counts), cells)), "ngram-prefixes")
    released(spark)
    matrix = written(in_order(found.join(copies, "id", "left").select("shingle", F.coalesce("first", "id").alias("id"), "n", "indexed")), "ngram-matrix")
    dropped(found)
    released(spark)

    # groups: documents that are linked, else those of one leader; cut by size classes, and by a hash where there are still too many
    size_class = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    named = matrix.select("id", "n").distinct().join(linked.withColumnRenamed("node", "id"), "id", "left").join(follows, "id", "left")
    named = named.select("id", "n", size_class.alias("size_class"), F.coalesce("component", "id").alias("component"), F.xxhash64(F.col("component").isNull(), F.coalesce("component", "leader", "id")).alias("grp"))
    documents = written(named, "ngram-documents")
    crowds = written(documents.groupBy("grp", "size_class").agg(F.count("*").alias("copies"), F.sum("n").alias("shingles")), "ngram-crowds")
    slots = F.greatest(F.ceil(F.col("copies") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    blocks = hot_join(documents, crowds, ["grp", "size_class"]).select("id", "n", "component", F.xxhash64("grp", "size_class", F.pmod(F.xxhash64("id"), slots)).alias("block"))
    blocks = written(blocks, "ngram-blocks")
    ranges = blocks.groupBy("block").agg(F.max("n").alias("high"), F.min("component").alias("lowest"), F.max("component").alias("highest"))
    rows_of_matrix = matrix.join(blocks, ["id", "n"])
    by_group = rows_of_matrix.filter("indexed").groupBy("shingle", "block").agg(F.min("n").alias("least")).join(ranges, "block")
    met = rows_of_matrix.select("shingle", "id", "n", "component").join(by_group, "shingle")
    other = ~((F.col("lowest") == F.col("component")) & (F.col("highest") == F.col("component")))
    queries = written(met.filter(other & (F.col("n") >= F.col("least")) & (100 * F.col("high") >= percent * F.col("n"))).select("block", "id").distinct(), "ngram-queries")
    dropped(matrix, documents, crowds, linked, follows)
    released(spark)
    return Prepared(rows.select("id", "n"), copies, stars, blocks.select("block", "id"), queries, bits, [rows, classes, repeated, copies, stars, blocks, queries])


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Texts without words, and null ones, have no shingles and link with nothing. A null id links with nothing and
    has a null component. Rows that repeat an id are one document with the links of all of them. An empty table
    gives no rows. Other columns of the input don't matter, whatever their names.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    known = prepared(texts, words, percent)
    more = _links(known.queries, known.members, known.bits, texts, words, percent)
    edges = known.stars.unionByName(more).unionByName(known.copies.select(F.col("id").alias("a"), F.col("first").alias("b")))
    final = written(components(edges, "a", "b"), "ngram-components")
    out = known.rows.join(final.select(F.col("node").alias("id"), "component"), "id", "left")
    out = written(out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")), "ngram-result")
    dropped(final, more, *known.gone)
    released(docs.sparkSession)
    return out
