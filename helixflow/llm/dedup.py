"""MinHash near-dedup with bottom-k sketches.

1. Each document's set of word shingles is hashed by one function. Documents with equal sets (an order-free digest of
   the whole set) are one class, so exact copies meet once, in an aggregate, however many there are.
2. A class's sketch is the k smallest hashes of its set. Two classes of the wanted similarity share at least t of
   them but for a chance under 1e-8 (t: six standard deviations under the mean; sets that fit into sketches have the
   exact t). So they share one of the rarest k - t + 1; only these values get inverted lists, and a value that many
   documents share (a licence line, a passage) gets one only from documents with little else.
3. A short list gives its pairs, as rows. Members of long lists are listed again by the rarest values of their full
   sets, by the same rule, which has no chance in it there: texts that share a template but are not alike enough share
   no such value. What is short now gives pairs.
4. The members of lists that are still long are dealt to blocks, by the longest list that each is in; blocks are
   bounded in members and in hashes. First each block is compared with itself and with one other block, so that all
   blocks that share lists make a chain; the links found make groups. Then two blocks of one list meet again only for members of different groups: those outside
   of the group that most of both belong to visit the other block. So a group of like classes takes rows in proportion
   to its size, however large. A task compares blocks as matrices and returns only links that join something.
5. A pair's similarity is estimated from the sketch of the union; what could reach the threshold is verified on the
   full sets. Links go to connected components.

Defined results: null and empty texts have no shingles and are linked with nothing; a document of fewer words than a
shingle is one shingle. Rows of one doc_id are one document: they share a component. Rows with a null doc_id join
their class but cannot be named: a class of only such rows has a null component, and kept is false for them. Repeated
rows give repeated results. The smallest doc_id of a component names it, so there are no ties. Texts of any length are
read whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, materialize, mix64, text_chunks
from .components import connected

SHINGLE = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 85
SKETCH = 64
#: Lists up to this length give all their pairs.
SHORT = 3
#: Bounds of a block: members and hashes (of their sets).
BLOCK_ROWS, BLOCK_HASHES = 1024, 400_000
_A = np.uint64(0xA0761D6478BD642F)
_PAD = np.iinfo(np.int64).max
#: Pairs estimated together.
_PAIRS = 4096


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes (int64) of its shingles."""
    w = Words(data, offsets)
    h = w.hashes()
    n = max(0, len(h) - size + 1)
    s = np.zeros(n, np.uint64)
    for i in range(size):
        s *= _A
        s += h[i : n + i]
    s = mix64(s + np.uint64(size)).view(np.int64)
    for a, b in zip(w.row_words[:-1].tolist(), w.row_words[1:].tolist()):
        if b - a >= size:
            yield np.unique(s[a : b - size + 1])
        elif b > a:
            x = np.zeros(1, np.uint64)
            for i in range(a, b):
                x = x * _A + h[i]
            yield mix64(x + np.uint64(b - a)).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def _digest(values: np.ndarray) -> tuple[int, int]:
    """An order-free digest of a set of hashes."""
    x = values.view(np.uint64)
    return int(mix64(x).sum().view(np.int64)), int(mix64(x ^ _A).sum().view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """(doc_id, n, lo, hi, sketch): the set's size, a 128-bit digest of the set and its k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in text_chunks(batch.column(1)):
                sets = list(_shingles(data, offsets, size))
                n = np.array([len(x) for x in sets], np.int64)
                digests = np.array([_digest(x) for x in sets], np.int64).reshape(len(sets), 2)
                cols = [ids.slice(row, len(sets)), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), _lists([x[:k] for x in sets])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "lo", "hi", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, lo bigint, hi bigint, sketch array<bigint>")


def full_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, full): the sets of rows of (doc_id, text); node is the first half of the set's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column("text")):
                sets = [x for x in _shingles(data, offsets, size) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_digest(x)[0] for x in sets], np.int64)), _lists(sets)], names=["node", "full"])

    return docs.mapInArrow(run, "node bigint, full array<bigint>")


def least_shared(n: Column, kept: Column, k: int = SKETCH, percent: int = PERCENT) -> Column:
    """How many of its kept values a class shares at least with a class that it links to."""
    j = percent / 100
    sampled = F.greatest(F.lit(1), F.floor(kept * j - 6 * F.sqrt(kept * (j * (1 - j)))))
    return F.when(n <= math.floor(j * k), F.ceil(n * percent / 100)).otherwise(sampled).cast("int")


def inverted_lists(values: DataFrame, least: Column) -> DataFrame:
    """(v, node, n, c): the values that classes are listed under, c: the list's length; lists of one member are left out.

    values: (node, n, kept, v), each value once, of which a class has kept; least: how many of these it shares at least
    with a class that it links to.
    """
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    rows = values.join(shared, "v").groupBy("node", "n", "kept").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"))
    # values of one class only are the rarest, and stand in no list of two
    first = F.size("vs") - least + 1
    rows = rows.filter(first > 0).select("node", "n", F.explode(F.slice("vs", F.lit(1), first)).alias("x")).select(F.col("x.v").alias("v"), "node", "n")
    rows = materialize(rows, "listed")
    many = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return materialize(rows.join(many, "v"), "lists")


def _exact_lists(long: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The lists of the members of long by their full sets."""
    members = long.select("node", "n").distinct()
    values = sets.join(members, "node").select("node", "n", F.col("n").alias("kept"), F.explode("full").alias("v"))
    return inverted_lists(values, F.ceil(F.col("n") * percent / 100).cast("int"))


def _short_pairs(short: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes that share a short list and are of like size."""
    own = short.select("v", F.col("node").alias("b"), F.col("n").alias("m"))
    pairs = short.select("v", F.col("node").alias("a"), "n").join(own, "v").filter("a < b")
    return pairs.filter(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select("a", "b").distinct()


def _dealt(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, block) of the members of long lists, and the pairs of blocks (x, y), x < y, that share a list."""
    top = long.groupBy("node", "n").agg(F.max(F.struct("c", "v")).alias("t")).select("node", "n", F.col("t.v").alias("top"))
    sums = top.groupBy("top").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("h"))
    parts = F.ceil(F.greatest(F.col("k") / BLOCK_ROWS, F.col("h") / BLOCK_HASHES))
    top = materialize(top.join(sums, "top").select("node", F.xxhash64("top", F.pmod(F.xxhash64("node"), parts)).alias("block")), "blocks", compact=True)
    met = long.join(top, "node").select("v", "block").distinct()
    met = materialize(met, "met", compact=True)
    pairs = met.select("v", F.col("block").alias("x")).join(met.select("v", F.col("block").alias("y")), "v").filter("x < y")
    return top, materialize(pairs.select("x", "y").distinct(), "block-pairs", compact=True)


def _first_meetings(dealt: DataFrame, chain: DataFrame | None) -> DataFrame:
    """(host, chunk, side, node): each block (side 0), and one other (side 1) as its guest: the next in the chain (node, label) of blocks."""
    own = dealt.select(F.col("block").alias("host"), F.lit(-1).alias("chunk"), F.lit(0).alias("side"), "node")
    if chain is None:
        return own
    following = F.lead("node").over(Window.partitionBy("label").orderBy("node"))
    hosts = chain.select(F.col("node").alias("host"), following.alias("block")).filter("block is not null")
    return own.union(dealt.join(hosts, "block").select("host", F.lit(-1).alias("chunk"), F.lit(1).alias("side"), "node"))


def _more_meetings(dealt: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, chunk, side, node): what must still be compared between the blocks of pairs, given the groups found so far."""
    named = dealt.join(labels, "node", "left").select("node", "block", F.coalesce("label", "node").alias("label"))
    named = materialize(named, "named", compact=True)
    counts = named.groupBy("block", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("block").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("k")).select("block", F.col("m.label").alias("main"), (F.col("m.c") == F.col("k")).alias("even"))
    side = lambda name: main.select(F.col("block").alias(name), F.col("main").alias(f"main_{name}"), F.col("even").alias(f"even_{name}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("same", F.col("main_x") == F.col("main_y"))
    # blocks of one main group: members outside of it visit the other block; else all of one block visit the other
    visits = F.array(F.struct(F.col("x").alias("host"), F.col("y").alias("from"), "same", F.col("even_y").alias("even")), F.struct(F.col("y").alias("host"), F.col("x").alias("from"), "same", F.col("even_x").alias("even")))
    visits = both.select(F.explode(visits).alias("s"), F.col("x")).filter("(s.same and not s.even) or (not s.same and s.host = x)").select("s.*")
    visits = materialize(visits.select("host", "from", "same"), "visits", compact=True)
    guests = visits.join(named.join(main, "block").select(F.col("block").alias("from"), "node", (F.col("label") == F.col("main")).alias("usual")), "from")
    guests = guests.filter("not (same and usual)").select("host", "node").distinct()
    sizes = guests.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("chunks"))
    guests = guests.join(sizes, "host").select("host", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "node")
    chunks = sizes.select("host", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"))
    own = chunks.join(dealt.select(F.col("block").alias("host"), "node"), "host").select("host", "chunk", F.lit(0).alias("side"), "node")
    return own.union(guests)


def _incidence(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Which of the sorted values each set holds."""
    out = np.zeros((len(sets), len(values)), np.float32)
    for row, s in zip(out, sets):
        at = np.searchsorted(values, s)
        at[at == len(values)] = 0
        row[at[values[at] == s]] = 1
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of two lists of sets (right None: of left with itself)."""
    every, times = np.unique(np.concatenate([*left, *(right or [])]), return_counts=True)
    every = every[times > 1]  # what one set alone holds is in no intersection
    out = np.zeros((len(left), len(right if right is not None else left)), np.float32)
    for a in range(0, len(every), 4096):
        x = _incidence(left, every[a : a + 4096])
        out += x @ (x if right is None else _incidence(right, every[a : a + 4096])).T
    return out


def estimates(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of the union's sketch that both have, its size) for rows of two padded sketches; the pad is the largest int64."""
    every = np.sort(np.concatenate([left, right], axis=1), axis=1)
    real = every < _PAD
    again = np.zeros(every.shape, bool)
    again[:, 1:] = (every[:, 1:] == every[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    return (again & (rank <= k)).sum(1), np.minimum(rank[:, -1], k)


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, k: int, percent: int) -> list[tuple[int, int]]:
    """Places of a spanning forest of the links between two blocks of sorted sets (right None: within left).

    Pairs of like size whose sketches overlap enough are estimated by the sketch of their union; what could reach the
    threshold is verified on the full sets. Pairs that are joined already are passed over.
    """
    other = left if right is None else right
    na, nb = np.array([len(s) for s in left]), np.array([len(s) for s in other])
    j = percent / 100
    bound = lambda kept: kept * j - 6 * np.sqrt(kept * j * (1 - j))
    maybe = np.minimum(na[:, None], nb) * 100 >= np.maximum(na[:, None], nb) * percent
    maybe &= _overlaps([s[:k] for s in left], None if right is None else [s[:k] for s in right]) >= bound(np.minimum(np.minimum(na[:, None], nb), k))
    if right is None:
        maybe &= np.triu(np.ones(maybe.shape, bool), 1)
    ia, ib = np.nonzero(maybe)
    if not len(ia):
        return []
    pads = [np.array([np.concatenate([s[:k], np.full(k - min(k, len(s)), _PAD)]) for s in side]) for side in (left, other)]
    shift = 0 if right is None else len(left)
    parent = list(range(len(left) + (len(other) if shift else 0)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, vain, both = [], 0, None
    for at in range(0, len(ia), _PAIRS):
        xs, ys = ia[at : at + _PAIRS], ib[at : at + _PAIRS]
        root = np.array([find(x) for x in range(len(parent))])
        apart = root[xs] != root[ys + shift]
        xs, ys = xs[apart], ys[apart]
        shared, kept = estimates(pads[0][xs], pads[1][ys], k)
        likely = shared >= bound(kept)
        for x, y in zip(xs[likely].tolist(), ys[likely].tolist()):
            a, b = find(x), find(y + shift)
            if a == b:
                continue
            if both is None and vain > _PAIRS:  # many are alike but not linked: all overlaps at once are cheaper
                both = _overlaps(left, right)
            n = len(np.intersect1d(left[x], other[y], assume_unique=True)) if both is None else both[x, y]
            if 100 * n >= percent * (len(left[x]) + len(other[y]) - n):
                parent[a] = b
                links.append((x, y))
            else:
                vain += 1
    return links


def _links(meetings: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among the members of each block that is a host, and between them and its guests; enough of them for the components."""
    rows = meetings.join(sets, "node").select("host", "chunk", "side", "node", "full")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group.column("side").to_numpy()
        names = group.column("node").to_numpy()
        lists = group.column("full").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        every = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        parts = []
        for s in (0, 1):  # a class may come from several rows
            at = np.flatnonzero(side == s)
            _, once = np.unique(names[at], return_index=True)
            parts.append(at[once])
        left, right = ([every[i] for i in p] for p in parts)
        a, b = [], []
        # blocks are compared with themselves in the first meetings only (chunk -1)
        alone = [(None, parts[0])] if group.column("chunk")[0].as_py() < 0 else []
        for guests, to in [*alone, *([(right, parts[1])] if right else [])]:
            for x, y in compare(left, guests, k, percent):
                a.append(names[parts[0][x]])
                b.append(names[to[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("host", "chunk").applyInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    sk = lambda name: classes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    both = pairs.join(sk("a"), "a").join(sk("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.withColumn("u", union).withColumn("got", F.size(F.array_intersect("u", F.array_intersect("sa", "sb"))))
    j = percent / 100
    kept = F.size("u")
    likely = both.filter(F.col("got") >= kept * j - 6 * F.sqrt(kept * (j * (1 - j)))).select("a", "b", "na", "nb")
    full = lambda name: sets.select(F.col("node").alias(name), F.col("full").alias(f"f{name}"))
    likely = likely.join(full("a"), "a").join(full("b"), "b").withColumn("i", F.size(F.array_intersect("fa", "fb")))
    return likely.filter(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE, percent: int = PERCENT, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    per_doc = materialize(sketches(docs, id_col, text_col, size, k), "sketches")
    some = per_doc.filter("n > 0")
    classes = some.groupBy("n", "lo", "hi").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumnRenamed("lo", "node"), "classes")
    # the classes of a doc_id that has several texts are linked to the first of them
    several = some.filter("doc_id is not null").groupBy("doc_id").agg(F.min("lo").alias("a"), F.max("lo").alias("z")).filter("a <> z")
    links = some.join(several, "doc_id").filter("lo <> a").select("a", F.col("lo").alias("b")).distinct()
    links = materialize(links, "links")
    values = classes.filter("rep is not null").select("node", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    lists = inverted_lists(values, least_shared(F.col("n"), F.col("kept"), k, percent))
    if not lists.isEmpty():
        wanted = lists.select("node").distinct().join(classes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct()
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id", "left_semi")
        texts = texts.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
        sets = materialize(full_sets(texts, size), "sets")
        long = lists.filter(F.col("c") > SHORT)
        again = _exact_lists(long, sets, percent)
        short = lists.filter(F.col("c") <= SHORT).union(again.filter(F.col("c") <= SHORT))
        pairs = materialize(_short_pairs(short, percent), "pairs", compact=True)
        links = materialize(links.union(_verified(pairs, classes, sets, k, percent).distinct()), "found", compact=True)
        long = again.filter(F.col("c") > SHORT)
        if not long.isEmpty():
            dealt, meet = _dealt(long)
            alone = meet.isEmpty()
            first = _first_meetings(dealt, None if alone else connected(meet.select(F.col("x").alias("a"), F.col("y").alias("b"))))
            links = materialize(links.union(_links(first, sets, k, percent)), "linked", compact=True)
            if not alone:
                groups = connected(links) if not links.isEmpty() else dealt.select("node", F.col("node").alias("label")).distinct()
                links = links.union(_links(_more_meetings(dealt, meet, groups), sets, k, percent))
                links = materialize(links, "linked", compact=True)
    labels = connected(links) if not links.isEmpty() else None
    named = classes.select("n", "node", "hi", "rep")
    if labels is not None:
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = named.groupBy("label").agg(F.min("rep").alias("component"))
        named = named.join(least, "label")
    else:
        named = named.withColumn("component", F.col("rep"))
    named = named.select("n", F.col("node").alias("lo"), "hi", "component")
    out = per_doc.drop("sketch").join(named, ["n", "lo", "hi"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
