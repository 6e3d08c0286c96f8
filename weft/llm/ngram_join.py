"""Jaccard join of documents on word shingles through signature trees, down to connected components.

A node of a tree stands for documents and holds the OR of their token bitmaps and the range of their set sizes. Two nodes
are compared by the most overlap that a pair below them can have, the tokens their bitmaps share, against the least that
their sizes need; most pairs of nodes end there, and a pair already in one component is left alone too.

The forest over all documents is laid out in three layers:

1. Root: its bitmap says which tokens occur in more than one set. A set with too few such tokens has no partner. This is
   first asked of a prefix of each set (its smallest hashes), where some share of the tokens of any partner must be.
2. Blocks: sets of one smallest hash under a permutation, a few permutations a round, in trees of bounded size. Dual traversal links what is
   similar. After each round the root's question is asked again, now for tokens that occur in more than one component,
   until no set is left that could have a partner outside its component.
3. The rest, after some such rounds, falls into families that share tokens; every two chunks of a family meet in one
   tree, so no link is lost.

Equal sets are one node from the start, so copies cost nothing. Sets are compared by 64-bit hashes of their shingles.

Defined cases: null or wordless text has an empty set, is linked with nothing and is its own component; fewer words than a
shingle make one shingle; rows of one doc_id are documents of their own that share the id; a null doc_id is ignored where
the smallest is taken and remains null where a component has no other; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import buckets
from weft.llm.common import Scratch, drop_written, mix, sized_broadcast, steps, text_buffer, word_hashes, written
from weft.llm.components import components

WORDS = 5
#: Similarity as a fraction, 75 / 100.
PART, WHOLE = 75, 100
#: Share of a set that must be found shared in its prefix; the prefix is longer by as much.
SLACK = 10
ROUNDS = ((0, 1, 2),)
#: Bounds of one tree.
TREE_SETS, TREE_TOKENS = 512, 1 << 20

TOKENS = {"token": "<u8", "id": "<i8"}
_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = WORDS):
    """Sorted distinct shingle hashes of each document."""
    hashes, first = word_hashes(data, bounds)
    n = len(hashes)
    if n >= words:
        rolled = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            rolled = rolled * _K + hashes[k : n - words + 1 + k]
        rolled = mix(rolled)
    for a, b in itertools.pairwise(first.tolist()):
        if b - a >= words:
            x = np.sort(rolled[a : b - words + 1])
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            yield x[keep]
        elif b > a:
            whole = b - a
            for h in hashes[a:b]:
                whole = (whole * int(_K) + int(h)) & 0xFFFFFFFFFFFFFFFF
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def need(n):
    """Least overlap with any partner of a set of n."""
    return -(-n * PART // WHOLE)


def slack(n):
    return n // SLACK + 1


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, a, b, id, n): each document's set by its id; id is null for the empty set."""

    def run(batches):
        for step in steps(batches):
            ids, sizes = [], []
            for x in shingle_sets(*text_buffer(step.column("text")), words):
                ids.append(set_id(x) if len(x) else None)
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([*(step.column(c) for c in ("doc_id", "a", "b")), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "a", "b", "id", "n"])

    return docs.mapInArrow(run, "doc_id long, a long, b long, id long, n long")


def shared_counts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, shared): how many of a set's prefix tokens also occur in the prefix of another set."""
    n_buckets = buckets.how_many(docs)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, ids = [], []
            for step in steps([batch]):
                for x in shingle_sets(*text_buffer(step.column("text")), words):
                    if not len(x) or (i := set_id(x)) in seen:
                        continue
                    seen.add(i)
                    n = len(x)
                    tokens.append(x[: n - need(n) + slack(n)])
                    ids.append(i)
            if not tokens:
                continue
            id_of = np.repeat(np.array(ids), [len(t) for t in tokens])
            token = np.concatenate(tokens)
            # what this batch shares with itself is known here: the token goes on once, marked, however many sets have it
            order = np.argsort(token, kind="stable")
            token, id_of = token[order], id_of[order]
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            shared = ~new
            shared[:-1] |= ~new[1:]
            hit, count = np.unique(id_of[shared], return_counts=True)
            for a in range(0, len(hit), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield from buckets.packed(np.full(len(hit[part]), -1 - int(hit[a]) % n_buckets), {"token": count[part], "id": hit[part]}, TOKENS)
            send = new
            # an id of zero marks a token that the batch itself shares
            yield from buckets.packed((token[send] % np.uint64(n_buckets)).astype(np.int64), {"token": token[send], "id": np.where(shared[send], 0, id_of[send])}, TOKENS)

    def reduce(bucket, x):
        if bucket >= 0:
            order = np.argsort(x["token"], kind="stable")
            token, ids = x["token"][order], x["id"][order]
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            group = np.cumsum(new) - 1
            least, most = np.full(new.sum(), np.iinfo(np.int64).max), np.full(new.sum(), np.iinfo(np.int64).min)
            np.minimum.at(least, group, ids)
            np.maximum.at(most, group, ids)
            marked = np.bincount(group, weights=ids == 0) > 0
            hit, count = np.unique(ids[((least != most) | marked)[group] & (ids != 0)], return_counts=True)
        else:
            hit, count = x["id"], x["token"].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(count)], ["id", "shared"])

    sent = docs.mapInArrow(run, buckets.schema(TOKENS))
    return buckets.by_bucket(sent, TOKENS, reduce, "id long, shared long").groupBy("id").agg(F.sum("shared").alias("shared"))


def traversed(sets: DataFrame, group: list[str]) -> DataFrame:
    """Links (a, b) from one tree for each group of the sets (id, n, root, tokens)."""
    width = len(group)

    def run(batches):
        def items():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in (*group, "id", "root")), batch.column("tokens"), strict=True)

        a, b = [], []
        for _, found in itertools.groupby(items(), key=lambda x: x[:width]):
            found = list(found)
            if len(found) < 2:
                continue
            for i, r in enumerate(links_within([np.frombuffer(x[-1].as_buffer(), "<u8") for x in found], [x[-2] for x in found])):
                if r != i:
                    a.append(found[i][-3])
                    b.append(found[r][-3])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sets.select(*group, "n", "id", "root", "tokens").repartition(*group).sortWithinPartitions(*group, "n", "id").mapInArrow(run, "a long, b long")


class Tree:
    """A signature tree over sets in the given order, as arrays; leaves are single sets."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.left, self.right, self.low, self.high, self.first = [], [], [], [], []
        self.bitmap: list[np.ndarray] = []
        self._bitmaps = bitmaps
        self.root = self._build(0, len(sizes))

    def _build(self, a: int, b: int) -> int:
        if b - a == 1:
            children, bitmap = (-1, -1), self._bitmaps[a]
        else:
            middle = (a + b) // 2
            children = self._build(a, middle), self._build(middle, b)
            bitmap = self.bitmap[children[0]] | self.bitmap[children[1]]
        for held, v in ((self.left, children[0]), (self.right, children[1]), (self.low, int(self.sizes[a:b].min())), (self.high, int(self.sizes[a:b].max())), (self.first, a), (self.bitmap, bitmap)):
            held.append(v)
        return len(self.first) - 1


def links_within(tokens: list[np.ndarray], roots: list[int]) -> list[int]:
    """For each set the first one of its component, by dual traversal of one signature tree with itself.

    Sets of equal roots are in one component from the start.
    """
    m = len(tokens)
    first: dict[int, int] = {}
    parent = [first.setdefault(r, i) for i, r in enumerate(roots)]

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(t) for t in tokens])
    flat = np.concatenate(tokens)
    owner = np.repeat(np.arange(m), sizes)
    distinct, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    kept = counts[inverse] > 1
    width = int((counts > 1).sum())
    if not width:
        return [find(i) for i in range(m)]
    bits = np.zeros((m, -(-width // 64) * 64), bool)
    bits[owner[kept], column[inverse[kept]]] = True
    bitmaps = np.packbits(bits, axis=1).view(np.uint64)
    # a set that shares too few tokens with all the others together is left out
    alive = np.flatnonzero(np.bitwise_count(bitmaps).sum(axis=1) >= need(sizes))
    if len(alive) < 2:
        return [find(i) for i in range(m)]
    tree = Tree(bitmaps[alive], sizes[alive])
    joined = [False] * len(tree.first)
    tree_first = [int(alive[a]) for a in tree.first]

    def settle(node):
        """Whether all below the node is one component (checked anew until it is)."""
        if not joined[node]:
            left, right = tree.left[node], tree.right[node]
            joined[node] = left < 0 or (settle(left) and settle(right) and find(tree_first[left]) == find(tree_first[right]))
        return joined[node]

    def possible(a, b):
        low_a, low_b = tree.low[a], tree.low[b]
        if WHOLE * tree.high[a] < PART * low_b or WHOLE * tree.high[b] < PART * low_a:
            return 0
        shared = int(np.bitwise_count(tree.bitmap[a] & tree.bitmap[b]).sum())
        return shared if (PART + WHOLE) * shared >= PART * (low_a + low_b) else 0

    stack = [(tree.root, tree.root)]
    while stack:
        a, b = stack.pop()
        if a == b:
            if tree.left[a] >= 0:  # own halves first: what is one component by then needs one link at most to another
                stack += [(tree.left[a], tree.right[a]), (tree.right[a], tree.right[a]), (tree.left[a], tree.left[a])]
            continue
        if find(tree_first[a]) == find(tree_first[b]) and settle(a) and settle(b):
            continue
        if not possible(a, b):
            continue
        leaf_a, leaf_b = tree.left[a] < 0, tree.left[b] < 0
        if leaf_a and leaf_b:  # the bitmaps are exact, and what possible() let through is a link
            x, y = find(tree_first[a]), find(tree_first[b])
            parent[max(x, y)] = min(x, y)
        elif leaf_b or (not leaf_a and tree.high[a] - tree.low[a] >= tree.high[b] - tree.low[b]):
            stack += [(tree.right[a], b), (tree.left[a], b)]
        else:
            stack += [(a, tree.right[b]), (a, tree.left[b])]
    return [find(i) for i in range(m)]


def full_sets(docs: DataFrame, chosen: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, n, tokens) of the chosen (a, b, id), one document for each id."""
    joined = docs.join(chosen, ["a", "b"])

    def run(batches):
        for step in steps(batches):
            ids, sizes, out = [], [], []
            for wanted, x in zip(step.column("id").to_pylist(), shingle_sets(*text_buffer(step.column("text")), words), strict=True):
                if len(x) and set_id(x) == wanted:  # else another text of the same hashes
                    ids.append(wanted)
                    sizes.append(len(x))
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["id", "n", "tokens"])

    return joined.select("id", "text").mapInArrow(run, "id long, n long, tokens binary")


def block_links(sets: DataFrame, turns: tuple[int, ...]) -> DataFrame:
    """Links (a, b) found in the trees of some rounds. A block of more sets than a tree holds is dealt into several."""
    seeds = [mix(np.array([t + 1], np.uint64))[0] for t in turns]

    def keyed(batches):
        for batch in batches:
            tokens = [np.frombuffer(t.as_buffer(), "<u8") for t in batch.column("tokens")]
            keys = [[int(mix(t ^ seed).min()) - (1 << 63) for seed in seeds] for t in tokens]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array(keys, pa.list_(pa.int64())), batch.column("tokens")], ["id", "n", "keys", "tokens"])

    with_keys = sets.select("id", "n", "tokens").mapInArrow(keyed, "id long, n long, keys array<long>, tokens binary")
    with_key = with_keys.select("id", "n", F.explode("keys").alias("key"), "tokens")
    # only blocks of several sets travel with their tokens
    large = with_key.groupBy("key").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).where("sets > 1")
    large = large.select("key", F.greatest(F.lit(1), F.ceil(F.greatest(F.col("sets") / F.lit(TREE_SETS), F.col("total") / F.lit(TREE_TOKENS)))).cast("int").alias("trees"))
    dealt = with_key.join(large, "key").withColumn("tree", F.pmod(F.xxhash64("id", "key"), F.col("trees")))
    return traversed(dealt.withColumn("root", F.col("id")), ["key", "tree"])


COMPONENT_TOKENS = {"token": "<u8", "id": "<i8", "root": "<i8", "n": "<i4"}
#: Sizes of partners are told apart in classes of this ratio.
CLASS_RATIO = 1.04


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(CLASS_RATIO) + 1e-9).astype(np.int64)


def least_size(c: np.ndarray) -> np.ndarray:
    """A size that no set of the class is under."""
    return np.floor(CLASS_RATIO ** (c - 1e-6))


CLASS_COUNTS = {"id": "<i8", "kind": "<i2", "count": "<i4"}


def crossing_counts(sets: DataFrame, by_class: bool) -> DataFrame:
    """(id, kind, shared) of the sets (id, n, tokens, root): tokens shared with other components.

    by_class tells partners apart by the class of their size (kind); else kind is 0 for all.
    """
    n_buckets = buckets.how_many(sets)
    n_sums = max(1, n_buckets // 8)  # every token bucket sends to every one of these

    def run(batches):
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            token = np.concatenate([np.frombuffer(t.as_buffer(), "<u8") for t in batch.column("tokens")] or [np.zeros(0, np.uint64)])
            x = {"token": token, "id": np.repeat(batch.column("id").to_numpy(), sizes), "root": np.repeat(batch.column("root").to_numpy(), sizes), "n": np.repeat(sizes, sizes)}
            yield from buckets.packed((token % np.uint64(n_buckets)).astype(np.int64), x, COMPONENT_TOKENS)

    def reduce(bucket, x):
        order = np.argsort(x["token"], kind="stable")
        x = {k: v[order] for k, v in x.items()}
        at = np.flatnonzero(np.concatenate(([True], x["token"][1:] != x["token"][:-1])))
        cross = np.minimum.reduceat(x["root"], at) != np.maximum.reduceat(x["root"], at)
        keep = np.repeat(cross, np.diff(np.concatenate((at, [len(order)]))))
        x = {k: v[keep] for k, v in x.items()}
        if not len(x["id"]):
            return
        if by_class:
            ids, kinds = met_classes(x)
        else:
            ids, kinds = x["id"], np.zeros(len(x["id"]), np.int64)
        pair, count = np.unique(np.stack((ids, kinds)), axis=1, return_counts=True)
        yield from buckets.packed(pair[0] % n_sums, {"id": pair[0], "kind": pair[1], "count": count}, CLASS_COUNTS)

    def total(bucket, x):
        order = np.lexsort((x["kind"], x["id"]))
        ids, kinds = x["id"][order], x["kind"][order]
        at = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1]))))
        sums = np.add.reduceat(x["count"][order].astype(np.int64), at)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(kinds[at].astype(np.int64)), pa.array(sums)], ["id", "kind", "shared"])

    sent = sets.select("id", "n", "tokens", "root").mapInArrow(run, buckets.schema(COMPONENT_TOKENS))
    return buckets.by_bucket(buckets.by_bucket(sent, COMPONENT_TOKENS, reduce, buckets.schema(CLASS_COUNTS)), CLASS_COUNTS, total, "id long, kind long, shared long")


def met_classes(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(id, class) for every posting, sorted by token, and every class of sizes that holds its token in another component."""
    kind = size_class(x["n"])
    order = np.lexsort((kind, x["token"]))
    x, kind = {k: v[order] for k, v in x.items()}, kind[order]
    new_token = np.concatenate(([True], x["token"][1:] != x["token"][:-1]))
    at = np.flatnonzero(new_token | np.concatenate(([True], kind[1:] != kind[:-1])))
    low, high = np.minimum.reduceat(x["root"], at), np.maximum.reduceat(x["root"], at)
    first = np.flatnonzero(new_token[at])
    classes = np.diff(np.concatenate((first, [len(at)])))
    group = np.cumsum(new_token) - 1
    times = classes[group]
    one = np.repeat(np.arange(len(group)), times)
    met = np.repeat(first[group], times) + np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
    size, other = x["n"][one], x["n"][at][met]
    useful = ((low[met] != x["root"][one]) | (high[met] != x["root"][one])) & (other <= size * (WHOLE / PART) * CLASS_RATIO + 1) & (other * CLASS_RATIO + 1 >= size * (PART / WHOLE))
    return x["id"][one[useful]], kind[at][met[useful]]


def crossing(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The sets (id, n, tokens, root) that may have a partner in another component.

    First all partners are taken together: a set must share as many tokens as its own size needs. For those left, and among
    them, partners are told apart by size, and the tokens must be as many as both sizes need.
    """
    enough = F.col("shared") * WHOLE >= F.col("n") * PART
    left = crossing_counts(sets, False).join(sets.select("id", "n"), "id").where(enough).select("id")
    some = scratch(sets.join(left, "id", "left_semi"), "crossing")
    partner = F.floor(F.pow(F.lit(CLASS_RATIO), F.col("kind") - 1e-6))
    both = (F.col("shared") * (PART + WHOLE) >= (F.col("n") + partner) * PART) & enough
    last = crossing_counts(some, True).join(some.select("id", "n"), "id").where(both).select("id").distinct()
    return scratch(some.join(last, "id", "left_semi"), "crossing")


def rest_links(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between components among the sets (id, n, tokens, root) that are left, none of them lost.

    Sets that hang together by tokens of several components make a group; a group's sets are dealt into chunks, and a tree
    over each two chunks is traversed, so every pair of the group meets in a tree of bounded size.
    """

    def explode(batches):
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            token = np.concatenate([np.frombuffer(t.as_buffer(), "<i8") for t in batch.column("tokens")] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), sizes)), pa.array(np.repeat(batch.column("root").to_numpy(), sizes)), pa.array(token)], ["id", "root", "token"])

    rows = sets.select("id", "n", "root", "tokens").mapInArrow(explode, "id long, root long, token long")
    common = rows.groupBy("token").agg(F.min("id").alias("first"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("token", "first")
    together = components(rows.join(common, "token").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()).select("id", F.col("root").alias("family"))
    grouped = scratch(sets.join(together, "id"), "families")
    sums = grouped.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    chunks = sums.select("family", F.ceil(F.greatest(F.col("sets") * 2 / F.lit(TREE_SETS), F.col("total") * 2 / F.lit(TREE_TOKENS))).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), own))
    dealt = grouped.join(chunks, "family").select("family", "id", "n", "root", "tokens", own.alias("own"), F.explode(other).alias("other"))
    dealt = dealt.select("family", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "n", "id", "root", "tokens")
    return traversed(dealt, ["family", "p", "q"])


def near_duplicates(docs: DataFrame, words: int = WORDS, rounds: tuple[tuple[int, ...], ...] = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    labelled = components_of(keyed(docs), words, rounds)
    smallest = labelled.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(smallest, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs, of each component exactly one: that with the smallest doc_id, then the smallest hash of its text.

    A null doc_id comes last. Documents without words are linked with nothing, so all of them stay.
    """
    held = keyed(docs, row=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    labelled = written(components_of(held, words).where("root is not null").select("root", "doc_id", "a", "b"), "labelled")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    first = labelled.groupBy("root").agg(F.min(place).alias("first"))
    goes = written(labelled.join(first, "root").where(place != F.col("first")).select("a", "b").distinct(), "goes")
    again = written(labelled.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b").join(goes, ["a", "b"], "left_anti"), "again")
    n_goes, n_again = goes.count(), again.count()
    rest = held.join(sized_broadcast(goes, n_goes), ["a", "b"], "left_anti")
    drop_written(labelled)
    if not n_again:
        return rest.select("row.*")
    again = sized_broadcast(again, n_again)
    return rest.join(again, ["a", "b"], "left_anti").select("row").union(rest.join(again, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select("row")).select("row.*")


def keyed(docs: DataFrame, **more: Column) -> DataFrame:
    """(doc_id, text, a, b): a and b are hashes of doc_id and text, which name a row; equal rows have equal names."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("a"), F.xxhash64(text, doc_id).alias("b"), *[c.alias(k) for k, c in more.items()])


def components_of(docs: DataFrame, words: int = WORDS, rounds: tuple[tuple[int, ...], ...] = ROUNDS) -> DataFrame:
    """(doc_id, a, b, id, n, root) of the documents (doc_id, text, a, b); root names the component, and is null for the empty set."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "a", "b")
    scratch = Scratch()
    nodes = written(sets_of(docs, words), "sets")
    by_id = nodes.where("id is not null").groupBy("id").agg(F.min(F.struct("a", "b")).alias("key"), F.first("n").alias("n"))
    enough = F.col("shared") >= F.floor(F.col("n") / SLACK) + 1
    chosen = scratch(by_id.join(shared_counts(docs.select("text"), words), "id").where(enough).select("key.*", "id"), "chosen")
    rooted = scratch(full_sets(docs, sized_broadcast(chosen), words).withColumn("root", F.col("id")), "tokens")
    found = written(spark.createDataFrame([], "id long, root long"), "components")
    for turns in (*rounds, None):
        if rooted.isEmpty():
            break
        new = scratch(block_links(rooted, turns) if turns else rest_links(rooted, scratch), "new-links")
        if not new.isEmpty():
            known = found.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a != b")
            before, found = found, written(components(known.union(new)), "components")
            drop_written(before)
        if turns:
            rooted = crossing(rooted.drop("root").join(found, "id", "left").withColumn("root", F.coalesce("root", "id")), scratch)
            scratch.clear(rooted)
    scratch.clear()
    return nodes.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
