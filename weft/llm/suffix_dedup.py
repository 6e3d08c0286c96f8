"""Removal of repeated byte strings by prefix-free parsing and the suffix array of the dictionary.

Parse: the trigger of a 100-byte string is the smallest rolling hash among its 32-byte grams (the leftmost of equals), so
equal strings have equal triggers at equal offsets. Consecutive starts with one trigger make a phrase; its bytes reach to
the end of its last string. Phrases with equal bytes are one dictionary entry whose first place in corpus order is known
from one sort of (trigger, bytes, place); every later place repeats all of its strings and needs no more work, which is
what makes highly repetitive text cheap.

Dictionary: entries that share a trigger but differ in bytes may still share strings. A bucket gets all entries of its
triggers, and the suffix array of their bytes is built by prefix doubling, to a depth of 100 bytes. Neighbours in it with
100 bytes in common are one string, compared by its bytes; merged with the entries' places, all but the first in corpus
order are repeats. The parse needs no suffix array of its own: phrases overlap by 99 bytes, so every string lies within one
phrase, and the parse could only order strings by what comes after their 100 equal bytes.

Phrases are compared by their trigger and a second 64-bit hash of all their bytes. A trigger with very many different
phrases in one batch is hot; its strings are dealt by their own hash and not by the trigger's, so no bucket holds a hot
trigger's phrases; there, strings are compared by two 64-bit hashes.

Defined cases: null or short text has nothing to remove; rows with one doc_id and one text get the same result; rows with
one doc_id and different texts are ordered by a hash of the text; a null doc_id comes last; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import buckets
from weft.llm.common import Prefixes, drop_written, steps, text_buffer, written

SPAN = 100
GRAM = 32
REACH = SPAN - GRAM + 1
#: Different phrases of one trigger in a batch from which the trigger counts as hot.
HOT = 32
LAST = (1 << 63) - 1

PHRASES = {"key": "<u8", "block": "<u8", "doc": "<i8", "tag": "<i4", "start": "<i4", "size": "u1", "kind": "u1"}
#: What is known of a phrase: all its strings are repeats; look into it with its trigger's others; look into each string.
REPEAT, LOOK, SPREAD, MARK = 1, 2, 3, 4
PLACES = pa.schema([("doc", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("size", pa.int32()), ("kind", pa.int32())])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i:i + width] for each i that has as many; width - 1 shorter than x."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def parse(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Phrases of the documents in one buffer: document index, start in it, number of string starts, trigger and bytes hash."""
    n = len(data)
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "start", "size")} | {k: np.zeros(0, np.uint64) for k in ("key", "block")}
    if n < SPAN:
        return empty
    sizes = np.diff(bounds)
    at = np.arange(n - GRAM + 1)
    grams = Prefixes(data).of(at, at + GRAM)
    place = np.uint64(0xFFFF)
    least = sliding_least((grams & ~place) | (at.astype(np.uint64) & place), REACH)
    starts = np.arange(len(least))
    trigger = starts + ((least - starts.astype(np.uint64)) & place).astype(np.int64)
    for wrap in range(0x10000, len(grams), 0x10000):  # there the low bits do not tell left from right
        a, b = max(0, wrap - REACH + 1), min(wrap, len(least))
        if b > a:
            view = np.lib.stride_tricks.sliding_window_view(grams[a : b + REACH - 1] >> np.uint64(16), REACH)
            trigger[a:b] = np.arange(a, b) + view.argmin(axis=1)
    valid = np.zeros(n + 1, np.int32)
    long = sizes >= SPAN
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[1:][long] - SPAN + 1, -1)
    valid = np.cumsum(valid[: len(least)]) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (trigger[1:] != trigger[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (trigger[1:] != trigger[:-1])
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    if not len(begin):
        return empty
    doc = np.searchsorted(bounds, begin, side="right") - 1
    return {"doc": doc, "start": begin - bounds[doc], "size": end - begin + 1, "key": grams[trigger[begin]], "block": Prefixes(data, second=True).of(begin, end + SPAN)}


def _places(doc, tag, start, size, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in ((doc, "i8"), (tag, "i4"), (start, "i4"), (size, "i4"), (np.broadcast_to(kind, len(doc)), "i4"))], schema=PLACES)


def _ordered(arrays: dict[str, np.ndarray], *keys: str) -> dict[str, np.ndarray]:
    order = np.lexsort(tuple(arrays[k] for k in reversed(keys)))
    return {k: v[order] for k, v in arrays.items()}


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _later(x: dict[str, np.ndarray], new: np.ndarray) -> np.ndarray:
    """Of sorted rows in groups that begin where new is set: those of another place than their group's first."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (x["doc"] != x["doc"][first]) | (x["tag"] != x["tag"][first]) | (x["start"] != x["start"][first])


def _phrases(docs: DataFrame, n_buckets: int, many: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            parts = []
            for step in steps([batch]):
                data, bounds = text_buffer(step.column("text"))
                found = parse(data, bounds)
                index = found["doc"]
                found["doc"] = step.column("doc").to_numpy()[index]
                found["tag"] = step.column("tag").to_numpy()[index]
                parts.append(found)
            if not parts:
                continue
            x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            # the batch's own repeats need no trip: only first places go on, and a hot trigger sends one mark
            x = _ordered(x, "key", "block", "doc", "tag", "start")
            new_key, new = _new(x["key"]), _new(x["key"], x["block"])
            group = np.cumsum(new_key) - 1
            hot = (np.bincount(group, weights=new) > many)[group] if len(group) else new
            kind = np.where(_later(x, new), REPEAT, np.where(hot, SPREAD, 0))
            x["kind"] = kind
            mark = {k: v[hot & new_key] for k, v in x.items()}
            mark["kind"] = np.full(len(mark["key"]), MARK)
            x = {k: np.concatenate([x[k], mark[k]]) for k in x}
            yield from buckets.packed((x["key"] % np.uint64(n_buckets)).astype(np.int64), x, PHRASES)

    return docs.mapInArrow(run, buckets.schema(PHRASES))


def _decide(bucket: int, x: dict[str, np.ndarray]):
    done = (x["kind"] == REPEAT) | (x["kind"] == SPREAD)
    y = {k: v[done] for k, v in x.items()}
    yield _places(y["doc"], y["tag"], y["start"], y["size"], y["kind"])
    x = {k: v[~done] for k, v in x.items()}
    order = np.argsort(x["key"])
    key = x["key"][order]
    shared = np.zeros(len(key), bool)
    if len(key) > 1:
        same = key[1:] == key[:-1]
        shared[1:] |= same
        shared[:-1] |= same
    x = _ordered({k: v[order[shared]] for k, v in x.items()}, "key", "block", "doc", "tag", "start")
    if not len(x["key"]):
        return
    group = np.cumsum(_new(x["key"])) - 1
    marked = (np.bincount(group, weights=x["kind"] == MARK) > 0)[group]
    real = x["kind"] != MARK
    x, group, marked = {k: v[real] for k, v in x.items()}, group[real], marked[real]
    if not len(group):
        return
    new = _new(x["key"], x["block"])
    several = (np.bincount(group, weights=new) > 1)[group]
    kind = np.where(_later(x, new), REPEAT, np.where(marked, SPREAD, np.where(several, LOOK, 0)))
    keep = kind > 0
    yield _places(x["doc"][keep], x["tag"][keep], x["start"][keep], x["size"][keep], kind[keep])


STRINGS = {"first": "<u8", "second": "<u8", "doc": "<i8", "tag": "<i4", "start": "<i4"}
CONTEXTS = {"key": "<u8", "doc": "<i8", "tag": "<i4", "start": "<i4", "size": "<i4", "text": "u1"}


def _contexts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Bytes of the phrases to look into, by trigger; strings of hot triggers, each by its own hash."""

    def run(batches):
        for step in steps(batches):
            data, bounds = text_buffer(step.column("text"))
            lists = step.column("places")
            values = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(step.num_rows), counts)
            start, size, kind = (values.field(k).to_numpy() for k in ("start", "size", "kind"))
            doc, tag = step.column("doc").to_numpy()[row], step.column("tag").to_numpy()[row]
            begin = bounds[row] + start
            look = np.flatnonzero(kind == LOOK)
            if len(look):
                sums = Prefixes(data)
                width = size[look] + SPAN - 1
                # the trigger again, now only to choose a bucket: the least gram of the phrase's first string
                first = begin[look][:, None] + np.arange(REACH)
                grams = sums.of(first.ravel(), first.ravel() + GRAM).reshape(first.shape)
                key = grams[np.arange(len(look)), (grams >> np.uint64(16)).argmin(axis=1)]
                x = {"key": key, "doc": doc[look], "tag": tag[look], "start": start[look], "size": size[look]}
                bucket = (key % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows = next(buckets.packed(bucket, x, {k: v for k, v in CONTEXTS.items() if k != "text"}))
                ends = np.cumsum(np.bincount(bucket)[np.unique(bucket)])
                spans = np.split(order, ends[:-1])
                texts = [b"".join(data[begin[look[i]] : begin[look[i]] + width[i]].tobytes() for i in s) for s in spans]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.binary())], ["bucket", *CONTEXTS])
            spread = np.flatnonzero(kind == SPREAD)
            if len(spread):
                one = np.repeat(spread, size[spread])
                within = np.arange(len(one)) - np.repeat(np.cumsum(size[spread]) - size[spread], size[spread])
                at = begin[one] + within
                first, second = Prefixes(data).of(at, at + SPAN), Prefixes(data, second=True).of(at, at + SPAN)
                x = {"key": first, "doc": doc[one], "tag": tag[one], "start": start[one] + within, "size": second}
                bucket = n_buckets + (first % np.uint64(n_buckets)).astype(np.int64)
                fields = CONTEXTS | {"size": "<u8"}
                fields.pop("text")
                for rows in buckets.packed(bucket, x, fields):
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([b""] * rows.num_rows, pa.binary())], ["bucket", *CONTEXTS])

    return docs.mapInArrow(run, buckets.schema(CONTEXTS))


def suffix_classes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class of text[i:i + SPAN] for each i in at: classes are numbered in the order of their bytes.

    Prefix doubling over all suffixes of the text, from 8 bytes to 64, and one last step over those asked for.
    """
    padded = np.concatenate((text, np.zeros(SPAN + 8, np.uint8)))
    rank = np.zeros(len(text), np.uint64)
    for i in range(8):
        rank = rank << np.uint64(8) | padded[i : i + len(text)]
    width = 8
    while True:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        reach = min(width, SPAN - width)  # what is known of a suffix, and of the one that ends where the depth is reached
        last = width + reach >= SPAN
        here = at if last else np.arange(len(text))
        beyond = here + reach
        rank = rank[here] << np.uint64(32) | np.where(beyond < len(text), rank[np.minimum(beyond, len(text) - 1)] + np.uint64(1), np.uint64(0))
        if last:
            return np.unique(rank, return_inverse=True)[1]
        width += reach


def _strings(n_buckets: int):
    fields = {k: "u1" for k in CONTEXTS}

    def reduce(bucket, raw):
        x = {k: np.frombuffer(raw[k].tobytes(), t) for k, t in (CONTEXTS | ({"size": "<u8"} if bucket >= n_buckets else {})).items()}
        if bucket >= n_buckets:
            x = {"first": x["key"], "second": x["size"], "doc": x["doc"], "tag": x["tag"], "start": x["start"]}
        else:
            width = x["size"].astype(np.int64) + SPAN - 1
            begin = np.cumsum(width) - width
            one = np.repeat(np.arange(len(width)), x["size"])
            within = np.arange(len(one)) - np.repeat(np.cumsum(x["size"]) - x["size"], x["size"])
            order = suffix_classes(x["text"], begin[one] + within)
            x = {"first": order, "second": np.zeros(len(order), np.uint8), "doc": x["doc"][one], "tag": x["tag"][one], "start": x["start"][one] + within}
        x = _ordered(x, "first", "second", "doc", "tag", "start")
        again = _later(x, _new(x["first"], x["second"]))
        x = _ordered({k: x[k][again] for k in ("doc", "tag", "start")}, "doc", "tag", "start")
        if not len(x["doc"]):
            return
        new = np.ones(len(x["doc"]), bool)
        new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1]) | (x["start"][1:] != x["start"][:-1] + 1)
        at = np.flatnonzero(new)
        yield _places(x["doc"][at], x["tag"][at], x["start"][at], np.diff(np.concatenate((at, [len(new)]))), REPEAT)

    return fields, reduce


PLACE_ROWS = "doc long, tag int, start int, size int, kind int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _listed(places: DataFrame, name: str) -> DataFrame:
    """A document's places as one list (at most as long as the document has bytes)."""
    return places.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "size", "kind")).alias(name))


def repeats(docs: DataFrame, many: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(documents with key columns, spans): spans has, by (doc, tag), lists of string starts to remove."""
    n_buckets = buckets.how_many(docs)
    keyed = docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "tag": F.hash(F.coalesce("text", F.lit(""))), "text": F.coalesce("text", F.lit(""))})
    sent = _phrases(keyed.select("doc", "tag", "text"), n_buckets, many)
    places = written(buckets.by_bucket(sent, PHRASES, _decide, PLACE_ROWS).distinct(), "phrases")
    looked = keyed.select("doc", "tag", "text").join(_listed(places.where(F.col("kind") != REPEAT), "places"), ["doc", "tag"])
    fields, reduce = _strings(n_buckets)
    more = buckets.by_bucket(_contexts(looked, n_buckets), fields, reduce, PLACE_ROWS)
    found = written(places.where(F.col("kind") == REPEAT).unionByName(more), "repeats")
    drop_written(places)
    return keyed, found


def dedup(docs: DataFrame, keep_text: bool = False, many: int = HOT) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, SHA-256 of the kept bytes; with keep_text also the kept text."""
    keyed, spans = repeats(docs.select("doc_id", F.col("text").cast("string").alias("text")), many)
    joined = keyed.join(_listed(spans, "spans"), ["doc", "tag"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"kept": []} if keep_text else {})
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = text.as_py().encode()
                kept, removed, runs = [], 0, 0
                if found.is_valid:
                    start = found.values.field("start").to_numpy()
                    end = start + found.values.field("size").to_numpy() + SPAN - 1
                    order = np.argsort(start)
                    start, end = start[order], np.maximum.accumulate(end[order])
                    new = np.ones(len(start), bool)
                    new[1:] = start[1:] > end[:-1]
                    begin = start[new]
                    stop = end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(new) - 1]))]
                    removed, runs, at = int((stop - begin).sum()), len(begin), 0
                    for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
                        kept.append(data[at:a])
                        at = b
                    kept.append(data[at:])
                left = b"".join(kept) if found.is_valid else data
                out["n_bytes"].append(len(data))
                out["n_removed"].append(removed)
                out["n_spans"].append(runs)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    out["kept"].append(left)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return joined.mapInArrow(run, RESULT + (", kept binary" if keep_text else ""))
