"""Similarity self-join on n-word shingles by a token-group matrix: an exact join that yields components, not pairs.

1. Equal sets become one class, named by a digest of the set; a class that holds a large part of all rows is found by
   Misra-Gries counters and leaves one row where it is read.
2. Signatures say which sets can link at all, and how many of them linked sets share at least. If the Jaccard similarity reaches the threshold, the sets differ in at most H
   tokens, where H follows from their size. With tokens dealt to more than H parts by their hash, some part is the same in both
   sets; the hash of a part's tokens is a signature. Sizes go by ranges, so that both sets of a pair use the same parts. There are e
   parts more than needed, so that e + 1 parts are the same, and a set with n empty parts shares e + 1 - n that are not
   empty; sets with more than e empty parts (rare) also give their prefix tokens, the least by hash, of which linked
   sets share one. Nothing is missed.
   A document whose shared signatures are fewer than any link needs is left out here.
3. Similar documents are partitioned into groups: each document lies with the centre that it shares most signatures with (the centre of a
   signature is the least id that has it). A group has about ``group_tokens`` tokens, where every document counts for ``ROW_TOKENS`` at
   least; larger ones are dealt to several groups by hash, each of which has a copy of the centre's set.
4. The token-group matrix is built and stored: a row for each group, the union of its members' tokens. As a group's members meet to make
   their row, links among them are found: a member's overlap with the union of the others bounds its overlap with any of them, and only
   a member that reaches what a link needs is held against the members of other components, in one count over the group's
   inverted index. Where all members link with the centre, one count settles the group.
5. Queries: a document is a candidate for the other groups around a centre that together hold enough of its signatures, in documents of
   larger components than its own. Its overlap with the group's stored union is counted against the matrix, and the group is opened only if that reaches what
   a link to any member needs; only then are the members' sets sent. No document asks its own group.
6. Links of both kinds give the components.

No step emits the pairs of a group. What goes to one task is a signature's rows, pre-aggregated in each batch, a group, or ``SALT_ROWS`` queries
of a group. Worst case, stated: documents of very many components that all share as many signatures as a link needs, but do not link, ask
each other's groups, which is documents times groups rows, not documents squared.

Defined cases: a null text counts as empty; documents without words link with nothing and are a component of their own; fewer
words than n are one shingle; repeated ids are one document as far as components go, each row has its own n_shingles; rows
with a null id belong to the component of equal sets that have an id, else to none (null); an empty table gives an empty result;
columns other than the id and the text are not read, or carried whole whatever their names (``one_of_each``). Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import col, discard, row_of, staged, text_of, with_shingles
from lectern.llm.components import components
from lectern.llm.exact_dedup import frequent

U64 = np.uint64
#: Queries of a group that go to one task.
SALT_ROWS = 64
#: What a short document counts for in a group, so that a group has not too many rows.
ROW_TOKENS = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Ranges:
    """Ranges of set sizes, each half as large again as the one before, and the number of parts in each."""

    def __init__(self, share: int, of: int, largest: int):
        self.share, self.of = share, of
        self.starts, self.parts, self.spare = [1], [], []
        while self.starts[-1] <= largest * of // share + 1:
            low = self.starts[-1]
            high = low + max(1, ceil(low / 2))
            differ = (of - share) * 2 * (high - 1) // (of + share)
            least, spare = max(1, low * share // of), 2
            for _ in range(20):
                k = differ + 1 + spare
                empty = k * exp(-least / k)
                spare = min(max(2, differ), max(2, ceil(empty + 3 * sqrt(empty))))
            self.parts.append(differ + 1 + spare if differ else 0)  # sets that may not differ are one class already
            self.spare.append(spare)
            self.starts.append(high)

    def of_sizes(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, range) twice: each in its own range, and those near its end in the next one too."""
        own = np.searchsorted(self.starts, sizes, "right") - 1
        following = np.array(self.starts)[own + 1]
        near = np.flatnonzero(self.of * sizes >= self.share * following)
        return [(np.arange(len(sizes)), own), (near, own[near] + 1)]


def signatures(values: np.ndarray, sizes: np.ndarray, ranges: Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, signature, least) of sets that lie one after the other in values. least: the range of sizes times 2**20, plus
    how many of its signatures in this range the document shares with any that it links with."""
    starts = np.cumsum(sizes) - sizes
    docs, found, least = [], [], []
    parts, spare = np.array([*ranges.parts, 0]), np.array([*ranges.spare, 0])
    for which, at in ranges.of_sizes(sizes):
        k = parts[at]
        which, at, k = which[k > 0], at[k > 0], k[k > 0]
        if not len(which):
            continue
        n = sizes[which]
        first = np.cumsum(k) - k  # of a document's cells
        inner = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        tokens = _mix(values[inner])
        cell = np.repeat(first, n) + ((tokens >> U64(20)) % np.repeat(k, n).astype(U64)).astype(np.int64)
        sums = np.zeros(k.sum(), U64)
        np.add.at(sums, cell, _mix(tokens + U64(1)))
        filled = np.zeros(len(sums), bool)
        filled[cell] = True
        owner = np.repeat(np.arange(len(which)), k)
        name = (np.repeat(at, k).astype(U64) << U64(40)) + (np.arange(len(sums)) - first[owner]).astype(U64)
        sums = _mix(sums ^ _mix(name + U64(7)))
        docs.append(which[owner[filled]])
        found.append(sums[filled])
        empty = k - np.bincount(owner[filled], minlength=len(which))
        least.append(((at << 20) + np.maximum(1, spare[at] + 1 - empty))[owner[filled]])
        for d in np.flatnonzero(empty > spare[at]):
            size = int(n[d])
            prefix = np.sort(values[starts[which[d]] : starts[which[d]] + size])[: size - ceil(ranges.share * size / ranges.of) + 1]
            docs.append(np.full(len(prefix), which[d]))
            found.append(_mix(_mix(prefix) ^ _mix(np.array([int(at[d]) + (1 << 60)], U64))))
            least.append(np.full(len(prefix), ((int(at[d]) + len(ranges.parts)) << 20) + 1))
    return (np.concatenate(docs), np.concatenate(found), np.concatenate(least)) if docs else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))


def _lists(sets: DataFrame, ranges: Ranges, batch_tokens: int) -> DataFrame:
    """(key, sig, a, least, many): each set's signatures. Of sets of one batch that share a signature, the one with the least digest
    stands for all in the shuffle (key = sig, many says that there were others); the others' rows are dealt by a key of their own."""
    schema = pa.schema([("key", pa.int64()), ("sig", pa.int64()), ("a", pa.int64()), ("least", pa.int64()), ("many", pa.bool_())])

    def emit(keys: list, values: list) -> pa.RecordBatch:
        ids = np.array(keys, np.int64)
        sizes = np.array([len(x) for x in values], np.int64)
        doc, sig, least = signatures(np.concatenate(values).view(U64), sizes, ranges)
        a = ids[doc]
        order = np.lexsort((a, sig))
        sig, a, least = sig[order].view(np.int64), a[order], least[order]
        again = np.zeros(len(sig), bool)
        again[1:] = (sig[1:] == sig[:-1]) & (a[1:] == a[:-1])
        sig, a, least = sig[~again], a[~again], least[~again]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        many = ~first
        many[:-1] |= ~first[1:]
        key = np.where(first, sig, _mix(sig.view(U64) ^ _mix(a.view(U64))).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(sig), pa.array(a), pa.array(least), pa.array(many)], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for batch in batches:
            tokens = batch.column(1)
            flat, offsets = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
            for k, a in enumerate(batch.column(0).to_pylist()):
                if offsets[k] == offsets[k + 1]:
                    continue  # without words; a filter before this step would be pushed down and compute the sets once more
                keys.append(a)
                values.append(flat[offsets[k] : offsets[k + 1]])
                held += len(values[-1])
                if held >= batch_tokens:
                    yield emit(keys, values)
                    keys, values, held = [], [], 0
        if keys:
            yield emit(keys, values)

    return sets.select("a", "set").mapInArrow(rows, "key long, sig long, a long, least long, many boolean")


class Group:
    """A row of the matrix: the union of a group's tokens; and, while its members are at hand, for each token those that have it."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], share: int, of: int):
        self.share, self.of = share, of
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(x) for x in sets])
        tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.union, self.starts = np.unique(tokens[order], return_index=True)
        self.owners, self.ends = owners[order], np.append(self.starts[1:], len(tokens))
        self.counted = 0  # how often members were looked at

    def needed(self, size: int) -> int:
        """The tokens that a set of this size must share with any that it links with."""
        return -(-self.share * size // self.of)

    def linked(self, own: np.ndarray) -> np.ndarray:
        """Which members link with a set."""
        self.counted += 1
        at = places(self.union, own)
        width = self.ends[at] - self.starts[at]
        inner = np.repeat(self.starts[at] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        common = np.bincount(self.owners[inner], minlength=len(self.ids))
        return self.of * common >= self.share * (self.sizes + len(own) - common)

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links that connect all members that are linked with each other."""
        found, component = [], np.arange(len(self.ids))
        many = self.ends - self.starts > 1
        for k, own in enumerate(sets):
            others = component != component[k]
            if not others.any():
                break
            if many[places(self.union, own)].sum() < self.needed(len(own)):
                continue  # the union of the others does not hold enough of it
            for m in np.flatnonzero(self.linked(own) & others):
                if component[m] != component[k]:
                    found.append((int(self.ids[k]), int(self.ids[m])))
                    component[component == component[m]] = component[k]
        return found


def places(union: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where in a sorted union the tokens of a sorted set are that it holds."""
    if not len(union):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(union, own), len(union) - 1)
    return at[union[at] == own]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, tuple, list, np.ndarray]]:
    """(whether a new run of the first ``keys`` columns begins, the run, the other values, set) of rows that come sorted; the set is the last column."""
    at = None
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in range(batch.num_columns - 1)]
        flat, offsets = batch.columns[-1].values.to_numpy(zero_copy_only=False), batch.columns[-1].offsets.to_numpy()
        for k, row in enumerate(zip(*values, strict=True)):
            new = row[:keys] != at
            at = row[:keys]
            yield new, at, row[keys:], flat[offsets[k] : offsets[k + 1]].copy()


MATRIX = "a long, b long, group long, members long, union array<long>"


def _matrix(rows: DataFrame, share: int, of: int) -> DataFrame:
    """From (group, id, set), sorted by group: a row of the matrix for each group, and (a, b) for the links within it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("group", pa.int64()), ("members", pa.int64()), ("union", pa.list_(pa.int64()))])

    def made(group: int, ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        own = Group(ids, sets, share, of)
        links = own.links(sets)
        columns = [[x[0] for x in links] + [None], [x[1] for x in links] + [None], [None] * len(links) + [group], [None] * len(links) + [len(ids)], [None] * len(links) + [own.union]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []
        for new, (at,), (key,), own in _runs(batches, 1):
            if new and ids:
                yield made(group, ids, sets)
                ids, sets = [], []
            group = at
            ids.append(key)
            sets.append(own)
        if ids:
            yield made(group, ids, sets)

    return rows.mapInArrow(build, MATRIX)


def _salted(rows: DataFrame, salts: str = "salts") -> DataFrame:
    """Rows (group, salts, first, ...) with a salt: rows that come first go to each salt of their group, others to one."""
    salt = F.when(F.col("first"), F.sequence(F.lit(0), F.col(salts) - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col(salts)).cast("int")))
    return rows.withColumn("salt", F.explode(salt)).drop(salts)


def _salts(queries: DataFrame) -> DataFrame:
    return queries.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))


def _sets(documents: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """wanted (id, group, ...) with the sets of the documents, each made once."""
    inner = [c for c in wanted.columns if c != "id"]
    dealt = wanted.groupBy("id").agg(F.collect_list(F.struct(*inner)).alias("at"))
    # A merge join at every size: what is wanted grows with the documents, so it is never broadcast.
    texts = documents.join(dealt.withColumnRenamed("id", "key").hint("merge"), F.col("id") == F.col("key")).select("id", "text", "at")
    sets = with_shingles(texts, F.col("text"), n, "set").select("id", "at", F.sort_array("set").alias("set"))
    return sets.withColumn("at", F.explode("at")).select("at.*", "id", "set")


def qualifying(queries: DataFrame, sets: DataFrame, matrix: DataFrame, share: int, of: int) -> DataFrame:
    """(group, id, overlap, qualifies) of queries (group, id, set): their overlap with the union of the group's tokens, and whether it is as large as a link
    to any member needs."""
    schema = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("overlap", pa.int64()), ("qualifies", pa.bool_())])
    salts = _salts(queries)
    unions = matrix.filter("union IS NOT NULL").join(salts, "group").select("group", "salts", F.lit(True).alias("first"), F.lit(None).cast("long").alias("id"), F.col("union").alias("set"))
    asking = sets.join(salts, "group").select("group", "salts", F.lit(False).alias("first"), "id", "set")
    rows = _salted(unions.unionByName(asking)).select("group", "salt", "first", "id", "set")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, found = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)], schema=schema)

        for _, (group, _), (first, key), own in _runs(batches, 2):
            if first:
                union = own
                continue
            overlap = len(places(union, own))
            found.append((group, key, overlap, of * overlap >= share * len(own)))
            if len(found) == 4096:
                yield out()
                found = []
        if found:
            yield out()

    return rows.repartition("group", "salt").sortWithinPartitions("group", "salt", F.desc("first")).mapInArrow(bounded, "group long, id long, overlap long, qualifies boolean")


def _opened(queries: DataFrame, members: DataFrame, documents: DataFrame, n: int, share: int, of: int) -> DataFrame:
    """(a, b): links of queries (group, id) with members (group, id) of the groups that are opened."""
    salts = _salts(queries)
    wanted = members.select("group", "id", F.lit(True).alias("first")).unionByName(queries.select("group", "id", F.lit(False).alias("first")))
    rows = _salted(_sets(documents, wanted.join(salts, "group"), n)).select("group", "salt", "first", "id", "set")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, group, found = [], [], None, []
        for new, _, (first, key), own in _runs(batches, 2):
            if new:
                ids, sets, group = [], [], None
            if first:
                ids.append(key)
                sets.append(own)
                continue
            if group is None:
                group, component = Group(ids, sets, share, of), np.arange(len(ids))
            for k, m in enumerate(at := np.flatnonzero(group.linked(own))):
                if k == 0 or component[m] != component[at[0]]:  # as many links as it takes to connect all
                    component[component == component[m]] = component[at[0]]
                    found.append((key, int(group.ids[m])))
            if len(found) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=schema)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=schema)

    return rows.repartition("group", "salt").sortWithinPartitions("group", "salt", F.desc("first"), "id").mapInArrow(links, "a long, b long")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, share: int = 85, of: int = 100, group_tokens: int = 1 << 18, counters: int = 1024, batch_tokens: int = 1 << 21, seen: dict | None = None) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (the least id reachable by links). Two documents link when
    of * |intersection| >= share * |union| of their shingle sets. ``seen``, if given, is told how many queries asked and qualified."""
    own = df.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    sets = with_shingles(own, F.col("text"), n, "set").select("id", F.sort_array("set").alias("set"))
    sets = sets.select("id", "set", F.xxhash64("set").alias("a"), F.xxhash64(F.lit(1), "set").alias("b"))
    keys = staged(sets.select("id", F.size("set").cast("long").alias("n_shingles"), "a", "b"), "sets")
    filled = keys.filter("n_shingles > 0")
    classes = staged(filled.groupBy("a", "b").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("size"), F.count(F.lit(1)).alias("copies")), "classes")
    rows, largest = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("size"), F.lit(1))).first()
    ranges = Ranges(share, of, largest)
    # Of classes with very many copies, one row is left; at most ``counters`` such classes are broadcast.
    heavy = classes.filter(F.col("copies") > max(1, rows / (counters + 1))).join(F.broadcast(frequent(filled, "a", counters).select(F.col("key").alias("a"))), "a", "left_semi")
    heavy = staged(heavy.groupBy("a").agg(F.min("rep").alias("only"), F.count(F.lit(1)).alias("n")).filter("n = 1 AND only IS NOT NULL").select("a", "only"), "heavy")
    single = sets.join(F.broadcast(heavy), "a", "left").filter("only IS NULL OR id = only")
    # Signatures that two classes or more share, with all their classes.
    each = Window.partitionBy("key")
    lists = _lists(single, ranges, batch_tokens).withColumns({"low": F.min("a").over(each), "high": F.max("a").over(each), "some": F.max("many").over(each)})
    several = staged(lists.filter("many OR some OR low <> high").select("sig", "a", "least"), "several")
    named = several.join(classes.filter("rep IS NOT NULL").select("a", "rep"), "a").select("sig", F.col("rep").alias("id"), "least").distinct()
    # A document that links shares ``least`` signatures of some range with the other one.
    enough = F.col("n") >= F.col("least") % (1 << 20)
    listed = staged(named, "listed")
    fit = listed.groupBy("id", "least").agg(F.count(F.lit(1)).alias("n")).filter(enough).select("id", "least")
    shared = staged(listed.join(fit, ["id", "least"], "left_semi"), "shared")
    discard(heavy, several, listed)
    # Groups: each document lies with the centre that it shares most signatures with.
    centres = shared.groupBy("sig").agg(F.min("id").alias("centre"))
    met = shared.join(centres, "sig").filter("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("n"))
    nearest = met.groupBy("id").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("cluster"))
    sizes = classes.filter("rep IS NOT NULL").groupBy(F.col("rep").alias("id")).agg(F.max("size").alias("size"))
    placed = staged(shared.select("id").distinct().join(nearest, "id", "left").join(sizes, "id").select("id", F.coalesce("cluster", "id").alias("cluster"), F.greatest("size", F.lit(ROW_TOKENS)).alias("load")), "clusters")
    loads = placed.groupBy("cluster").agg(F.ceil(F.sum("load") / group_tokens).alias("parts"))
    members = staged(placed.join(loads, "cluster").select("id", "cluster", F.xxhash64("cluster", F.pmod(F.xxhash64("id"), "parts")).alias("group")), "members")
    discard(placed)
    # The matrix; a centre's copies in other groups than its own are there for their links alone.
    wanted = members.select("id", "group").unionByName(members.select(F.col("cluster").alias("id"), "group")).distinct()
    built = _sets(own, wanted, n).select("group", "id", "set").repartition("group").sortWithinPartitions("group", "id")
    matrix = staged(_matrix(built, share, of), "matrix")
    links = matrix.filter("a IS NOT NULL").select("a", "b")
    linked = components(links)
    # Queries: groups that hold enough of a document's signatures, in documents of larger components; of two documents that may link, it is
    # the one of the smaller component that asks, whichever signatures they share, so those of a very large one need not ask. Signatures
    # are counted by cluster, which may be many groups; then its groups are asked, each once.
    counted = linked.join(linked.groupBy("component").agg(F.count(F.lit(1)).alias("documents")), "component")
    rank = F.struct(F.coalesce("documents", F.lit(1).cast("long")).alias("documents"), F.coalesce("component", "id").alias("component"))
    ranked = staged(members.join(counted, "id", "left").select("id", "cluster", "group", rank.alias("rank")), "ranked")
    known = staged(shared.join(ranked, "id").select("sig", "id", "least", "cluster", "rank"), "known")
    most = known.groupBy("sig").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).filter("low < high").select("sig", F.col("high").alias("most"))
    apart = staged(known.join(most, "sig"), "apart")
    across = apart.groupBy("sig", F.col("cluster").alias("asked")).agg(F.max("rank").alias("high"))
    asking = apart.filter("rank < most").join(across, "sig").filter("rank < high")
    asking = asking.groupBy("id", "asked", "least").agg(F.count(F.lit(1)).alias("n")).filter(enough).select("id", "asked").distinct().join(ranked.select("id", "group", "rank"), "id")
    held = ranked.groupBy(F.col("cluster").alias("asked"), F.col("group").alias("other")).agg(F.max("rank").alias("high"))
    queries = asking.join(held, "asked").filter("other <> group AND rank < high").select("id", F.col("other").alias("group"))
    queries = staged(queries, "queries")
    discard(known, apart, ranked, shared)
    tables = [linked, queries]
    if not queries.isEmpty():
        bounds = staged(qualifying(queries, _sets(own, queries, n), matrix, share, of), "bounds")
        opening = bounds.filter("qualifies").select("group", "id")
        if seen is not None:
            seen |= {"asked": bounds.count(), "qualified": opening.count()}
        more = staged(_opened(opening, members.join(opening.select("group").distinct(), "group", "left_semi").select("group", "id"), own, n, share, of), "more")
        linked = components(links.unionByName(more))
        tables += [bounds, more]
    classed = classes.join(linked, F.col("rep") == F.col("id"), "left").select("a", "b", F.coalesce("component", "rep").alias("component"))
    found = staged(keys.join(classed, ["a", "b"], "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")), "similar")
    discard(matrix, members, keys, classes, *({*tables, linked}))
    return found.select(col("id").alias(id_col), "n_shingles", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of df, with all their columns, whose id names their component: one document of each group of linked ones."""
    found = similar(df.select(col(id_col).alias("id"), col(how.pop("text_col", "text")).alias("text")), "id", **how)
    gone = found.filter("id <> component_id").select(F.col("id").alias("gone")).distinct()
    rows = df.select(row_of(df).alias("row"), col(id_col).alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
