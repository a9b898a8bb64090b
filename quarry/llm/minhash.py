"""Near-duplicate groups by bottom-k sketches.

A document's set is its distinct word shingles, each hashed by one hash function. Documents with equal sets
form a class, and classes are what is compared. The sketch of a class is the ``k`` least hashes of its set.

Candidates come from inverted lists of retained values. A list's key is a pair of values that are neighbours
in the sketch; a pair is much rarer than a value, so that a word pair which every other document holds makes
no list of half the corpus. Two sets with similarity 0.8 share about two thirds of their keys, and at least
``SHARED`` of them but for a chance of 4e-9 (``k`` = 48). Sets of at most ``k / threshold`` hashes are listed
under all pairs of values of a prefix so long that two sets which reach the threshold always share four of
its values, hence six (``SHARED``) keys: for them nothing is left to chance.

A list of at most ``SHORT_LIST`` classes gives all its pairs. A class with fewer than ``SHARED`` keys in longer
lists meets every partner in some short list, and leaves the longer ones. What stays there are groups of near
copies. Each long list has a hub, the class with the most list mates, and gives the links to it, in proportion
to its size. When all links are joined into components, a pair that could still join two components has a class
outside the hub's component in it: only such classes (stragglers) are held against the hub's whole group, in
blocks of bounded size that give back links and not pairs.

A pair is first held against the union sketch's estimate, with a margin of five deviations, and then confirmed
on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.scratch import discard, written
from quarry.llm.text import LOWER, WordHasher, kept_by, mix64, shingle_hashes, slices, text_bytes, values

SKETCH = 48
SHORT_LIST = 32
#: Keys that two linked classes share at least.
SHARED = 6
#: Hashes of stragglers, and of a hub's group, that one block compares.
BLOCKS = (1 << 17, 1 << 20)
_SIGN = np.uint64(1 << 63)
_HASHER = WordHasher()


def _claim() -> None:
    """The worker's table of word hashes, from here on this operator's."""
    kept_by("minhash", _HASHER.known)


def word_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text (one for a shorter text, none without words)."""
    return np.unique(shingle_hashes(_HASHER(text.translate(LOWER).split()), size))


def _list_keys(s: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """Keys of the inverted lists that hold a set (see the module's text)."""
    keys = []
    n = len(s)
    if n > k:
        keys.append((s[: k - 1], s[1:k]))
    if 3 < n <= k / threshold:
        p = n - math.ceil(threshold * n - 1e-9) + 4
        a, b = np.triu_indices(min(p, n), 1)
        keys.append((s[a] ^ np.uint64(0x5555), s[b]))
    if not keys:
        return s[:0]
    a, b = (np.concatenate(x) for x in zip(*keys, strict=True))
    return np.unique(mix64(mix64(a) * np.uint64(0x9E3779B97F4A7C15) + b))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, dtype=np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketches(docs: DataFrame, *, shingle: int, k: int, threshold: float, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n_shingles, set_id binary, sketch array<long>, keys array<long>`` of each row.

    ``set_id`` is a 128-bit hash of the whole set, null for the empty set. Sketches hold the hashes less 2 ** 63,
    so that signed longs have the hashes' order.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _claim()
        for whole in batches:
            for batch in slices(whole, "__text"):
                sizes, ids, least, keys = [], [], [], []
                for t in values(batch.column(1)):
                    s = word_set(t, shingle)
                    sizes.append(len(s))
                    ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    least.append(s[:k] ^ _SIGN)
                    keys.append(_list_keys(s, k, threshold))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), _lists(least), _lists(keys)], names=["doc_id", "n_shingles", "set_id", "sketch", "keys"]
                )

    schema = f"doc_id {kind}, n_shingles long, set_id binary, sketch array<long>, keys array<long>"
    return docs.select(F.col(doc_id).alias("__id"), text_bytes(docs, text).alias("__text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, *, shingle: int, doc_id: str, text: str) -> DataFrame:
    """``set_id, full array<long>`` of the classes in ``wanted`` (``set_id, rep``), computed anew from one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _claim()
        for whole in batches:
            for batch in slices(whole, "__text"):
                sets = [word_set(t, shingle) for t in values(batch.column(1))]
                ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), _lists(sets)], names=["wanted", "set_id", "full"])

    rows = docs.select(F.col(doc_id).alias("rep"), text_bytes(docs, text).alias("__text")).join(wanted.select("set_id", "rep"), "rep")
    sets = rows.select("set_id", "__text").mapInArrow(run, "wanted binary, set_id binary, full array<long>")
    return sets.where("wanted = set_id").select("set_id", "full").dropDuplicates(["set_id"])


def _estimate(a: Column, b: Column, k: int, threshold: float) -> Column:
    """Whether the sketches' estimate leaves the threshold possible: their union's ``k`` least values in both."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    margin = 5 * math.sqrt(threshold * (1 - threshold) / k)
    whole = (F.size(a) < k) & (F.size(b) < k)
    return both >= F.when(whole, F.size(union) * threshold - 1e-6).otherwise(F.size(union) * max(0.0, threshold - margin))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, *, shingle: int, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold, as links ``u, v``."""
    ca = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("set_id").alias("ia"))
    cb = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("set_id").alias("ib"))
    near = pairs.join(ca, "a").join(cb, "b").where(_estimate(F.col("sa"), F.col("sb"), k, percent / 100))
    near = written(near.select("a", "b", "na", "nb", "ia", "ib"), "near-pairs")
    wanted = near.select(F.col("ia").alias("set_id"), F.col("a").alias("rep")).union(near.select("ib", "b")).distinct()
    sets = written(full_sets(docs, wanted, shingle=shingle, doc_id=doc_id, text=text), "full-sets")
    full = near.join(sets.select(F.col("set_id").alias("ia"), F.col("full").alias("fa")), "ia").join(sets.select(F.col("set_id").alias("ib"), F.col("full").alias("fb")), "ib")
    both = F.size(F.array_intersect("fa", "fb"))
    links = written(full.where(both * 100 >= percent * (F.col("na") + F.col("nb") - both)).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    discard(near, sets)
    return links


def _fits(na: Column, nb: Column, percent: int) -> Column:
    """Sizes alone rule out a link if the smaller set is below the threshold's share of the larger."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, k: int = SKETCH, short_list: int = SHORT_LIST, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Groups of near-duplicate documents: ``doc_id, n_shingles long, component_id, kept boolean``.

    Two texts are linked if ``100 * intersection >= percent * union`` of their sets of distinct ``shingle``-word
    runs (A-Z lower-cased; a text with fewer words is one run). ``component_id`` is the smallest id reachable by
    links, ``kept`` whether it is the row's own id. A null, empty or blank text has the empty set and is linked
    with nothing. One row for each input row; a row with a null id is never linked, keeps a null component and
    is kept. Rows with equal sets are linked, those with one id too. Other columns are left out, whatever their
    names. Hashes of shingles have 64 bits.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is 80 to 100: the lists are made for such similarities")
    rows = written(sketches(docs, shingle=shingle, k=k, threshold=percent / 100, doc_id=doc_id, text=text), "sketches")
    usable = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    # One class for each set, named by its smallest id; a hot group is summed up before it is shuffled, and its
    # rows meet the name by set and id, so that they are dealt out.
    reps = usable.groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    named = usable.join(reps.withColumnRenamed("set_id", "__set"), (F.col("set_id") == F.col("__set")) & (F.col("doc_id") == F.col("rep")))
    classes = written(named.dropDuplicates(["set_id", "rep"]).select("set_id", "rep", F.col("n_shingles").alias("n"), "sketch", "keys"), "classes")
    # Rows that repeat an id with other texts share a class name; that only adds links within one document.
    entries = classes.select(F.explode("keys").alias("key"), "rep", "n")
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    listed = written(entries.join(counts, "key"), "lists")
    low = listed.where(F.col("size") <= short_list)
    left, right = low.select("key", F.col("rep").alias("a"), F.col("n").alias("na")), low.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"))
    near = left.join(right, "key").where((F.col("a") < F.col("b")) & _fits(F.col("na"), F.col("nb"), percent)).select("a", "b")
    groups = _hub_groups(listed.where(F.col("size") > short_list))
    apart = groups.where((F.col("rep") != F.col("hub")) & _fits(F.col("n"), F.col("hub_n"), percent))
    pairs = near.union(apart.select(F.least("rep", "hub"), F.greatest("rep", "hub"))).distinct()
    links = _confirmed(pairs, classes, docs, shingle=shingle, k=k, percent=percent, doc_id=doc_id, text=text)
    found = components(links)
    discard(listed, links)
    found = _with_stragglers(groups, found, classes, docs, shingle=shingle, percent=percent, doc_id=doc_id, text=text)
    names = classes.select("set_id", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    names = names.select("set_id", F.coalesce("component", "rep").alias("component"))
    out = rows.join(names, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _hub_groups(high: DataFrame) -> DataFrame:
    """``hub, hub_n, rep, n``: the classes that meet a hub in a long list, the hub itself among them."""
    # At most ``keys`` entries for each class, so its lists are gathered rather than joined.
    gathered = high.groupBy("rep", "n").agg(F.sum("size").alias("weight"), F.collect_list("key").alias("mine")).where(F.size("mine") >= SHARED)
    lists = written(gathered.select(F.explode("mine").alias("key"), "rep", "n", "weight"), "long-lists")
    order = F.struct("weight", (-F.col("rep")).alias("r"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"))
    hubs = lists.groupBy("key").agg(F.max(order).alias("o")).select("key", "o.hub", "o.hub_n")
    groups = written(lists.join(hubs, "key").select("hub", "hub_n", "rep", "n").distinct(), "hub-groups")
    discard(lists)
    return groups


def _with_stragglers(groups: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame, *, shingle: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """``node, component`` after the links that members of a hub's group have beside the hub."""
    labels = found.select(F.col("node").alias("rep"), "component")
    named = groups.select("hub", "rep", "n").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    hub_names = labels.select(F.col("rep").alias("hub"), F.col("component").alias("hub_component"))
    named = named.join(hub_names, "hub", "left").withColumn("straggler", F.col("component") != F.coalesce("hub_component", "hub"))
    sizes = named.groupBy("hub").agg(F.sum(F.when(F.col("straggler"), F.col("n"))).alias("s"), F.sum("n").alias("m")).where("s > 0")
    blocks = [F.ceil(F.col(c) / size).cast("int").alias(f"n{c}") for c, size in zip("sm", BLOCKS, strict=True)]
    members = written(named.join(sizes.select("hub", *blocks), "hub").select("hub", "rep", "component", "straggler", "ns", "nm"), "stragglers")
    discard(groups)
    if members.isEmpty():
        return found
    wanted = members.select("rep").distinct().join(classes.select("rep", "set_id"), "rep")
    sets = written(full_sets(docs, wanted, shingle=shingle, doc_id=doc_id, text=text).join(wanted, "set_id").select("rep", "full"), "full-sets")
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.where("straggler").select("hub", "rep", "component", part("ns").cast("int").alias("sb"), every("nm").alias("mb")).join(sets, "rep")
    right = members.select("hub", "rep", "component", part("nm").cast("int").alias("mb"), every("ns").alias("sb")).join(sets, "rep")
    # Columns of its own, which cogroup needs.
    right = right.select(*(F.col(c).alias(f"m_{c}") for c in ("hub", "sb", "mb", "rep", "component", "full")))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        us, vs = [], []
        if a.num_rows and b.num_rows:
            reps, names, full = (np.array(b["m_rep"].to_pylist()), np.array(b["m_component"].to_pylist()), b["m_full"].combine_chunks())
            flat, sizes = full.flatten().to_numpy(), full.value_lengths().to_numpy()
            order = np.argsort(flat, kind="stable")
            values_, owners = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            for rep, name, own in zip(a["rep"].to_pylist(), a["component"].to_pylist(), a["full"].to_pylist(), strict=True):
                mine = np.array(own, dtype=np.int64)
                start, end = np.searchsorted(values_, mine, "left"), np.searchsorted(values_, mine, "right")
                n = end - start
                places = np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                both = np.bincount(owners[places], minlength=len(sizes))
                linked = (both * 100 >= percent * (len(mine) + sizes - both)) & (names != name)
                for v in reps[linked].tolist():
                    us.append(rep)
                    vs.append(v)
        kind = a.schema.field("rep").type
        return pa.table({"u": pa.array(us, kind), "v": pa.array(vs, kind)})

    kind = classes.schema["rep"].dataType.simpleString()
    met = left.groupBy("hub", "sb", "mb").cogroup(right.groupBy("m_hub", "m_sb", "m_mb")).applyInArrow(compare, f"u {kind}, v {kind}")
    found = components(met.union(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    discard(members, sets)
    return found
