"""Removal of repeated and nearly repeated lines by a segment-partition edit join, in DataFrame functions only.

A line is removed if an earlier line is equal to it or within the threshold of it: one edit for every WORDS_PER_EDIT words
(parameter words_per_edit) of the line with fewer of them, EDITS = 1 at least. Words are what stands between single blanks;
text without blanks is one word, so its threshold stays 1. Earlier is by doc_id, then by place in the document; lines are
compared without the blanks around them, and lines under MIN_CHARS characters stay as they are.

Equal lines are one entry from the start. Where the threshold is 1, an entry is split into EDITS + 1 = 2 segments: of two lines one edit apart, one
segment is equal, at the same distance from the start or from the end. So an entry of length L is indexed under both of its
halves, and probes, for lines one shorter, the same places of length L - 1. A bucket of more than BUCKET entries is not
expanded into pairs: the half that differs is split again, and its entries are dealt anew under all that is outside the
quarter with the edit, and so on, down to single characters, where a bucket is bounded by the alphabet. What shares a bucket
at last, and differs in one letter at most, is verified by a banded bit-parallel edit distance over longs.

Where it is k > 1, lines are cut into segments by what they say and not by place: at the blanks that follow a character of
CUTS. An edit spoils two segments at most, so two such lines share all but 2k of the different segments of either; with
one order for all segments, the longest first, they share one of the first 2k + 1. A line with fewer segments than that is cut
at every blank as well, equal words being numbered, which gives 12k or more. Those segments are indexed with the line's length cell, and
those down to that of the shortest line within the threshold, so no shifted windows are needed, whose number grows with the cube of k.
Lines that meet are compared by length, by 64 parities of their segments and by counts of letters; what is left is verified by
Spark's banded edit distance with the pair's own threshold: in column functions the bit-parallel form takes 2k + 1 steps a
character there. Where more than BUCKET lines have a segment, they are dealt by length, in cells as wide as their largest
threshold, and a full cell in blocks. There a line asks in a semi-join whether an earlier one is near, first in one bucket,
and only if none is, in all of its others: a large group of near copies makes one row of each line, not one of each pair.

Defined cases: null text is empty; rows of one doc_id and one text count as one document, so they keep the same lines; a
null doc_id comes last; extra columns pass through deduplicated(); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import Scratch, sized_broadcast

EDITS = 1
WORDS_PER_EDIT = 12
MIN_CHARS = 20
BUCKET = 64
#: Lines of a hot bucket's cell that one block holds.
BLOCK = 512
#: Blanks that end a segment: those after a character of about every second code.
CUTS = r" (?<=[!#%')+\-/13579;=?ACEGIKMOQSUWYacegikmoqsuwy] )"
#: Lengths of one cell of the index differ by less than this ratio.
CELL_RATIO = 1.1
LETTERS = "etnahirosdlucm"
LAST = (1 << 63) - 1
BAND = 2 * EDITS + 1


def lines_of(docs: DataFrame) -> DataFrame:
    """(key, doc, at, line) of the lines that are long enough; at counts from 0."""
    split = docs.select("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "line"))
    return split.withColumn("line", F.trim("line")).where(F.length("line") >= MIN_CHARS)


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64("line"), "h2": F.hash("line", F.length("line"))})


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def banded_distance(x: Column, y: Column) -> Column:
    """Edit distance of x and y, where x is not the shorter, if it is at most EDITS; else more than EDITS.

    The state is one diagonal band of the matrix: BAND bits each of vertical steps up and down, as longs. Both texts
    are longer than the band.
    """
    full, top, side = (1 << BAND) - 1, 1 << (BAND - 1), 1 << (BAND - 2)
    state = F.struct(F.lit((full << EDITS) & full).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(EDITS).alias("distance"), F.lit(side).cast("long").alias("side"))
    inverse = lambda v: F.bitwise_not(v).bitwiseAND(full)

    def step(a: Column, i: Column, xs: Column, ys: Column) -> Column:
        vp, vn = a["vp"], a["vn"]
        c = F.get(ys, i)
        match = F.lit(0).cast("long")
        for k in range(BAND):
            match = match + F.when(F.get(xs, i + (k - EDITS)) == c, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))

        def with_match(m: Column) -> Column:
            d0 = (m.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(full)
            return let(d0, with_d0)

        def with_d0(d0: Column) -> Column:
            hp, hn = vn.bitwiseOR(inverse(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
            right = F.shiftright(d0, 1)
            diagonal = i < F.size(xs) - EDITS
            along = F.when(hp.bitwiseAND(a["side"]) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(a["side"]) != 0, 1).otherwise(0)
            distance = a["distance"] + F.when(diagonal, F.when(d0.bitwiseAND(top) != 0, 0).otherwise(1)).otherwise(along)
            return F.struct(hn.bitwiseOR(inverse(right.bitwiseOR(hp))).alias("vp"), right.bitwiseAND(hp).alias("vn"), distance.alias("distance"), F.when(diagonal, a["side"]).otherwise(F.shiftright(a["side"], 1)).alias("side"))

        return let(match, with_match)

    return let(F.struct(F.split(x, "").alias("x"), F.split(y, "").alias("y")), lambda s: F.aggregate(F.sequence(F.lit(0), F.size(s["y"]) - 1), state, lambda a, i: step(a, i, s["x"], s["y"]), lambda a: a["distance"]))


def segment_rows(entries: DataFrame) -> DataFrame:
    """Rows (h1, h2, extra, size, a, b, bucket) of entries (h1, h2, line, extra, size, a, b): what is equal outside [a, b).

    size is the length that the row stands under; extra is 0 for an entry of that length and 1 for one that is longer by
    one, whose differing part is longer by one as well.
    """
    outside = F.xxhash64("size", "a", "b", F.substr("line", F.lit(1), F.col("a")), F.substr("line", F.col("b") + F.col("extra") + 1))
    return entries.select("h1", "h2", "extra", "size", "a", "b", outside.alias("bucket"))


def halves(a: Column, b: Column) -> Column:
    middle = F.floor((a + b) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b")))


def all_rows(lines: DataFrame) -> DataFrame:
    """Both halves of every line, under its own length and under the one below."""
    length = F.length("line")
    roles = F.array(F.struct(F.lit(0).alias("extra"), length.alias("size")), F.struct(F.lit(1).alias("extra"), (length - 1).alias("size")))
    each = lines.select("h1", "h2", "line", F.explode(roles).alias("r")).select("h1", "h2", "line", "r.*")
    return segment_rows(each.select("*", F.explode(halves(F.lit(0), F.col("size"))).alias("i")).select("h1", "h2", "line", "extra", "size", "i.a", "i.b"))


def letter_counts(line: Column) -> list[Column]:
    """Counts of the LETTERS, 127 at most each, as two longs of seven bytes."""
    packed = []
    for letters in (LETTERS[:7], LETTERS[7:]):
        column = F.lit(0).cast("long")
        for i, c in enumerate(letters):
            n = F.least(F.length(line) - F.length(F.replace(line, F.lit(c))), F.lit(127)).cast("long")
            column = column.bitwiseOR(F.shiftleft(n, 8 * i))
        packed.append(column)
    return packed


def surplus(a: Column, b: Column) -> Column:
    """What a has more than b, summed over the bytes, or less by a multiple of 255.

    All bytes at once and each term written once or twice: the join's code must stay small enough to be compiled.
    """
    high = 0x0080808080808080
    t = a.bitwiseOR(high) - b  # in each byte 128 + a - b
    more = t.bitwiseAND(high)
    return t.bitwiseAND(more - F.shiftright(more, 7)) % 255


def letters_allow(edits: Column) -> Column:
    """Whether so many edits can make up the difference in letters: each takes one letter away at most, and adds one."""
    low, high = (F.col("x_low"), F.col("y_low")), (F.col("x_high"), F.col("y_high"))
    return (surplus(*low) + surplus(*high) <= edits) & (surplus(*low[::-1]) + surplus(*high[::-1]) <= edits)


def near_pairs(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(x1, x2, y1, y2) of the different lines (h1, h2, line; repeats are allowed) within EDITS edits; x is not the longer.

    Which buckets hold different lines is known from hashes alone; only those lines' texts are read again, and no text is
    shuffled while they are few enough to be broadcast.
    """
    rows = all_rows(lines)
    live = rows.groupBy("bucket").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.min("extra").alias("least"))
    live = scratch(live.where("low != high and least = 0").select("bucket"), "buckets")
    rows = scratch(rows.join(sized_broadcast(live), "bucket", "left_semi").distinct(), "segments")
    needed = scratch(rows.select("h1", "h2").distinct(), "needed")
    texts = scratch(lines.join(sized_broadcast(needed), ["h1", "h2"], "left_semi").select("h1", "h2", "line").distinct(), "texts")
    pairs = None
    while True:
        counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("extra").alias("least")).where("n > 1 and least = 0").drop("least")
        several = scratch(rows.join(counts, "bucket"), "segments")
        ready = several.where((F.col("n") <= BUCKET) | (F.col("b") - F.col("a") <= 1))
        left = ready.where("extra = 0").select("bucket", F.col("h1").alias("x1"), F.col("h2").alias("x2"))
        right = ready.select("bucket", "extra", F.col("h1").alias("y1"), F.col("h2").alias("y2"))
        smaller = (F.col("x1") < F.col("y1")) | ((F.col("x1") == F.col("y1")) & (F.col("x2") < F.col("y2")))
        found = left.join(right, "bucket").where((F.col("extra") == 1) | smaller).select("x1", "x2", "y1", "y2")
        pairs = found if pairs is None else pairs.union(found)
        hot = several.where((F.col("n") > BUCKET) & (F.col("b") - F.col("a") > 1)).select("h1", "h2", "extra", "size", F.explode(halves(F.col("a"), F.col("b"))).alias("i"))
        if hot.isEmpty():
            break
        rows = segment_rows(hot.select("h1", "h2", "extra", "size", "i.a", "i.b").join(texts, ["h1", "h2"]))
    pairs = scratch(pairs.distinct(), "pairs")
    x, y = (texts.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("line").alias(f"{s}_line")) for s in "xy")
    both = pairs.join(x, ["x1", "x2"]).join(y, ["y1", "y2"])
    both = both.select("*", *[c.alias(f"{s}_{n}") for s in "xy" for c, n in zip(letter_counts(F.col(f"{s}_line")), ("low", "high"), strict=True)])
    return both.where(letters_allow(F.lit(EDITS)) & (banded_distance(F.col("y_line"), F.col("x_line")) <= EDITS)).select("x1", "x2", "y1", "y2")


def length_cell(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(CELL_RATIO))).cast("int")


def bucketed(lines: DataFrame) -> DataFrame:
    """The lines' rows by segment and bucket: every segment of keys under the length cells of the line."""
    shorter = F.sequence(length_cell(F.col("size") - F.col("edits")), length_cell(F.col("size")))
    columns = ("h1", "h2", "size", "edits", "parity")
    each = lines.select(*columns, "keys", F.explode(shorter).alias("cell")).select(*columns, "cell", F.explode("keys").alias("segment"))
    return each.select(*columns, "segment", F.xxhash64("cell", "segment").alias("bucket"))


def segment_key(segment: Column) -> Column:
    """A long that sorts longer segments first, up to 2048 characters, then by hash: one order for all lines."""
    return F.shiftleft((-F.length(segment)).cast("long"), 52).bitwiseOR(F.shiftrightunsigned(F.xxhash64(segment), 12))


def cut(line: Column, at: str) -> Column:
    return F.transform(F.split(line, at, -1), segment_key)


def prefix(keys: Column, edits: Column) -> Column:
    return F.slice(F.sort_array(keys), F.lit(1), 2 * edits + 1)


def parities(keys: Column) -> Column:
    """64 bits, each whether an odd number of the keys falls on it."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))


def signature(line: Column, edits: Column) -> Column:
    """(parity, keys) of a line: parities of its segments, and the segments that it is indexed under."""

    def numbered(words: Column) -> Column:  # of a line with too few segments: its words, equal ones being numbered
        return F.transform(words, lambda x, i: F.xxhash64(x, i - F.array_position(words, x)))

    def of(s: Column) -> Column:
        words = F.when(F.size(s) <= 2 * edits, let(prefix(cut(line, " "), edits), numbered)).otherwise(F.array().cast("array<long>"))
        return F.struct(parities(s).alias("parity"), F.concat(prefix(s, edits), words).alias("keys"))

    return let(F.array_distinct(cut(line, CUTS)), of)


def letters(line: Column) -> Column:
    """How often each of LETTERS is in the line."""
    return F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c))) for c in LETTERS])


def far_later(places: DataFrame, firsts: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2) of the lines that have an earlier one within a threshold over 1."""
    lines = places.where("signature is not null").select("h1", "h2", "size", "edits", "signature.*")
    rows = bucketed(lines)
    live = rows.groupBy("bucket").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least != most").select("bucket")
    live = scratch(live, "far-buckets")
    rows = scratch(rows.join(sized_broadcast(live), "bucket", "left_semi").distinct(), "far-rows")
    hot = rows.groupBy("bucket").agg(F.count("*").alias("n"), (F.max("edits") + 1).alias("width")).where(F.col("n") > BUCKET).drop("n")
    hot = sized_broadcast(scratch(hot, "far-hot"))

    def sides(x: DataFrame, y: DataFrame, *columns: str) -> list[DataFrame]:
        columns = ("h1", "h2", "size", "edits", "parity", *columns)
        default = lambda c: F.lit("") if c == "line" else F.array().cast("array<long>") if c == "keys" else F.array().cast("array<int>") if c == "letters" else F.lit(0)  # noqa: E731  none is null, and so Spark knows
        return [side.select(*[c for c in ("bucket", "cell", "block", "first") if c in side.columns], *[F.coalesce(c, default(c)).alias(f"{s}_{c}") for c in columns]).withColumnsRenamed({"first": f"{s}_first"}) for s, side in (("x", x), ("y", y))]

    edits = F.least("x_edits", "y_edits")
    # an edit takes two segments away at most and adds two
    differing = F.bit_count(F.col("x_parity").bitwiseXOR(F.col("y_parity")))
    meets = (F.abs(F.col("y_size") - F.col("x_size")) <= edits) & (differing <= 4 * edits)
    # each edit takes one letter away at most, and adds one
    more = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0))), F.lit(0), lambda n, x: n + x)
    close = lambda k: (more("x_letters", "y_letters") <= k) & (more("y_letters", "x_letters") <= k)
    # a line that goes on from another, or leads up to it, needs no matrix: their lengths are known to be close
    goes_on = "startswith(y_line, x_line) or endswith(y_line, x_line) or startswith(x_line, y_line) or endswith(x_line, y_line)"
    # of two lines within k, equally long prefixes are within 2k; a narrow band finds most of the rest
    start = lambda k: f"levenshtein(left(x_line, 4 * {k}), left(y_line, 4 * {k}), 2 * {k}) >= 0"
    within = lambda k: F.expr(f"{goes_on} or ({start(k)} and (levenshtein(x_line, y_line, least({k}, 4)) >= 0 or ({k} > 4 and levenshtein(x_line, y_line, {k}) >= 0)))")

    x, y = sides(*[rows.join(hot, "bucket", "left_anti")] * 2)
    smaller = (F.col("x_h1") < F.col("y_h1")) | ((F.col("x_h1") == F.col("y_h1")) & (F.col("x_h2") < F.col("y_h2")))
    pair = [F.col("x_h1").alias("x1"), F.col("x_h2").alias("x2"), F.col("y_h1").alias("y1"), F.col("y_h2").alias("y2")]
    pairs = scratch(x.join(y, "bucket").where(smaller & meets).select(*pair, edits.alias("edits")).distinct(), "far-pairs")
    many = scratch(rows.join(hot, "bucket").distinct(), "far-many")
    ids = pairs.selectExpr("x1 h1", "x2 h2").union(pairs.selectExpr("y1", "y2")).union(many.select("h1", "h2"))
    needed = scratch(firsts.join(sized_broadcast(scratch(ids.distinct(), "far-ids")), ["h1", "h2"]).select("h1", "h2", "first"), "far-needed")
    held = docs.join(sized_broadcast(scratch(needed.select("first.key").distinct(), "far-docs")), "key", "left_semi")
    texts = hashed(lines_of(held)).select("h1", "h2", "line", F.struct("doc", "key", "at").alias("first")).join(sized_broadcast(needed), ["h1", "h2", "first"], "left_semi")
    texts = scratch(texts.select("h1", "h2", "first", "line", letters(F.col("line")).alias("letters")), "far-texts")

    x, y = (texts.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("first").alias(f"{s}_first"), F.col("line").alias(f"{s}_line"), F.col("letters").alias(f"{s}_letters")) for s in "xy")
    found = scratch(later(pairs.join(x, ["x1", "x2"]).join(y, ["y1", "y2"]).where(close(F.col("edits")) & within("edits"))), "far-found")

    # whether there is an earlier line, and not which: a large group of near copies makes one row of each
    low, high = letter_counts(F.col("line"))
    ids = sized_broadcast(scratch(many.select("h1", "h2").distinct(), "far-many-ids"))
    keys = lines.select("h1", "h2", "keys").join(ids, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    many = many.join(texts.select("*", low.alias("low"), high.alias("high")), ["h1", "h2"]).join(keys, ["h1", "h2"])
    many = scratch(many.withColumn("cell", F.floor(F.col("size") / F.col("width")).cast("int")), "far-cells")
    blocks = many.groupBy("bucket", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = sized_broadcast(scratch(blocks, "far-blocks"))
    around = F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)

    def met(later: DataFrame, once: Column) -> DataFrame:
        x = many.join(blocks, ["bucket", "cell"]).withColumn("block", F.pmod("h2", "blocks"))
        y = later.withColumn("cell", F.explode(around)).join(blocks, ["bucket", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        x, y = sides(x, y, "line", "segment", "keys", "letters", "low", "high")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("bucket", "cell", "block")]
        cheap = (F.col("x_first") < F.col("y_first")) & meets & letters_allow(edits) & (F.col("x_segment") == F.col("y_segment"))
        found = y.alias("a").join(x.alias("b"), same[0] & same[1] & same[2] & cheap & once & close(edits) & within("least(x_edits, y_edits)"), "left_semi")
        return found.select(F.col("y_h1").alias("h1"), F.col("y_h2").alias("h2")).distinct()

    # most of a group are found in one bucket of each line; only the rest go to all of theirs, and verify a pair in one of them
    rest = many.join(sized_broadcast(found), ["h1", "h2"], "left_anti")
    least = rest.groupBy("h1", "h2").agg(F.min("bucket").alias("bucket"))
    one = scratch(met(rest.join(least, ["h1", "h2", "bucket"], "left_semi"), F.lit(True)), "far-one")
    rest = rest.join(sized_broadcast(one), ["h1", "h2"], "left_anti")
    rest = met(rest, F.get(F.array_intersect("x_keys", "y_keys"), F.lit(0)) == F.col("x_segment"))
    return found.union(one).union(rest).distinct()


def first_places(places: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2, first, n) of each line: its first place and how many it has.

    Least numbers are found by hash, least places by sorting: only lines with several places are sorted.
    """
    least = places.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.min(c).alias(c.replace(".", "_")) for c in ("doc", "key.a", "key.b", "at")])
    first = F.struct("doc", F.struct(F.col("key_a").alias("a"), F.col("key_b").alias("b")).alias("key"), "at")
    least = scratch(least.select("h1", "h2", first.alias("first"), "n"), "first-lines")
    several = scratch(least.where("n > 1").select("h1", "h2"), "repeated")
    several = places.join(sized_broadcast(several), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min(F.struct("doc", "key", "at")).alias("first"), F.count("*").alias("n"))
    return least.where("n = 1").union(scratch(several, "first-repeated"))


def later(pairs: DataFrame) -> DataFrame:
    """(h1, h2) of the later line of each pair."""
    x_later = F.col("x_first") > F.col("y_first")
    return pairs.select(F.when(x_later, F.col("x1")).otherwise(F.col("y1")).alias("h1"), F.when(x_later, F.col("x2")).otherwise(F.col("y2")).alias("h2"))


def near_later(lines: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2) of the lines (h1, h2, line) that have an earlier one within EDITS edits."""
    pairs = scratch(near_pairs(lines, scratch), "near-pairs")
    ids = pairs.selectExpr("x1 h1", "x2 h2").union(pairs.selectExpr("y1", "y2")).distinct()
    known = scratch(firsts.select("h1", "h2", "first").join(sized_broadcast(scratch(ids, "near-ids")), ["h1", "h2"], "left_semi"), "near-firsts")
    x, y = (known.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("first").alias(f"{s}_first")) for s in "xy")
    return later(pairs.join(x, ["x1", "x2"]).join(y, ["y1", "y2"]))


def dropped(docs: DataFrame, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """(key, drop, n_equal, n_near): indexes of the lines to remove from the documents (key, doc_id, text)."""
    if words_per_edit < 3:
        raise ValueError("an edit may touch two words, so words_per_edit is 3 at least")
    scratch = Scratch()
    lines = hashed(lines_of(docs)).withColumns({"size": F.length("line"), "n_words": F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1})
    lines = lines.withColumn("edits", F.floor(F.col("n_words") / words_per_edit).cast("int"))
    # a threshold of 1 goes with under 2 * words_per_edit words on one side, so with one more at most on the other
    short, far = F.col("n_words") <= 2 * words_per_edit, F.col("n_words") >= 2 * words_per_edit
    lines = lines.select("key", "doc", "at", "h1", "h2", "size", "edits", F.when(short, F.col("line")).alias("short"), F.when(far, signature(F.col("line"), F.col("edits"))).alias("signature"))
    lines = scratch(lines, "lines")
    places = lines.select("key", "doc", "at", "h1", "h2")
    place = F.struct("doc", "key", "at")
    firsts = first_places(places, scratch)
    near = near_later(lines.where("short is not null").select("h1", "h2", F.col("short").alias("line")), firsts, scratch).union(far_later(lines, firsts, docs, scratch))
    near = scratch(near.distinct(), "near")
    judged = firsts.join(sized_broadcast(near.withColumn("near", F.lit(True))), ["h1", "h2"], "left").where("n > 1 or near")
    out = places.join(sized_broadcast(scratch(judged, "judged")), ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | (place != F.col("first")))
    out = scratch(out.groupBy("key").agg(F.collect_set("at").alias("drop"), F.count_if(place != F.col("first")).alias("n_equal"), F.count_if(place == F.col("first")).alias("n_near")), "dropped")
    scratch.clear(out)
    held = out.agg(F.count("*") + F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()[0]  # rows and what their lists hold
    return sized_broadcast(out, held)


def keyed(docs: DataFrame) -> DataFrame:
    """key: two hashes of doc_id and text, so that no two of many documents share one by chance."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("key", F.struct(F.xxhash64("doc_id", text).alias("a"), F.xxhash64(text, "doc_id").alias("b")))


def kept_text(text: Column, drop: Column) -> Column:
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.when(drop.isNull(), text).otherwise(F.element_at(F.transform(F.array(lines), lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n")), 1))


def report(docs: DataFrame, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """Per document: lines, lines removed as equal and as near, characters kept, SHA-256 of the kept text."""
    docs = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    found = docs.join(dropped(docs, words_per_edit), "key", "left")
    kept = kept_text(F.col("text"), F.col("drop"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), zero("n_equal"), zero("n_near"), kept.alias("kept")).select(
        "doc_id", "n_lines", "n_equal", "n_near", F.length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256")
    )


def deduplicated(docs: DataFrame, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """The documents with their kept lines, all other columns as they were; those of which nothing is left go."""
    held = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("text").cast("string").alias("text")))
    found = held.join(dropped(held.select("key", "doc_id", "text"), words_per_edit), "key", "left").withColumn("kept", kept_text(F.col("text"), F.col("drop")))
    found = found.where(F.col("drop").isNull() | F.col("kept").rlike(r"\S"))
    return found.select(F.col("row").withField("text", F.col("kept")).alias("row")).select("row.*")
