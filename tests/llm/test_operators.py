"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import decontaminate, line_dedup, ngram_join, packing, pii, quality, suffix_dedup, token_rollup, tokens, warc, webp
from weft.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}


def table(spark, texts, extra=True):
    """Documents with their columns, and with extra columns whose names operators use inside."""
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in texts]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("key", "n", "id", "uid", "root", "words", "row", "spans", "score", "doc", "tag", "line", "drop", "kept")}) if extra else df


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], DOC)


# PII


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii_brute(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (name, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = name == "email" or (name == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (name == "card" and 12 <= len(d) <= 19 and luhn(d)) or (name == "phone" and 9 <= len(d) <= 15)
            if fine:
                out.append((m.start(), k, name, m.end()))
    out.sort()
    return (*[sum(x[2] == n for x in out) for n, _ in kinds], hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in out).encode()).hexdigest())


def test_pii_equals_brute_force(spark):
    r = random.Random(5)
    bits = ["a@b.c-x_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "0.0.0.0", "4111 1111 1111 1111", "4111111111111111", "+49 (30) 123-4567", "+1 2", "é", "𝒳", ".", "@", "+", "0", "12", "-", " ", "x", "79927398713", "00255.0.0.1", "a.b%c@d-e.f.g"]
    texts = [(i, "".join(r.choice(bits) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 60)))) for i in range(150)] + [(900, None), (901, "")]
    got = by_id(pii.summary(table(spark, texts)), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == {i: pii_brute(t) for i, t in texts}


def test_pii_long_runs_validators_and_context(spark):
    texts = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "a@b.co " * 5000), (4, "pay to DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00"), (5, "token = 0123456789abcdef0123456789abcdef"), (6, "0123456789abcdef0123456789abcdef")]
    got = {r.doc_id: r for r in pii.summary(table(spark, texts)).collect()}
    assert (got[1].spans, got[2].spans, got[3].n_email) == ("", "", 5000)
    assert got[4].spans == "iban:7:34" and got[5].spans == "secret:8:40" and got[6].spans == ""
    assert pii.redact(table(spark, texts).where("doc_id in (4, 5)")).orderBy("doc_id").first().text == "pay to <iban> or DE88 3704 0044 0532 0130 00"
    again = pii.redact(table(spark, texts)).where("doc_id = 5").first()
    assert again.asDict().keys() == set(table(spark, texts).columns) and again.text == "token = <secret>"
    idle = [(1, "0123456789abcdef0123456789abcdef an idea"), (2, "keyboard 0123456789abcdef0123456789abcdef"), (3, "key 0123456789abcdef0123456789abcdef")]
    assert {r.doc_id: r.spans for r in pii.summary(table(spark, idle)).collect()} == {1: "", 2: "", 3: "secret:4:36"}
    assert pii.summary(empty(spark)).count() == 0


# packing and tokens


def test_encoder_equals_the_tokenizer():
    e = tokens.WordEncoder(tokens.vocabulary_path(tokens.WORD_VOCABULARY))
    assert e.ranked is not None
    r = random.Random(0)
    words = ["<|startoftext|>", "<|endoftext|>", "it's", "DON'T", "a.b,", "Éa.", "ab.", "x<|EndOfText|>y"]
    letters = "abcXYZéÉßİıŉΣςаЯ中123.,!'-<|\t\n    ̧́ǅﬁ"
    texts = [None, "", " "] + ["".join(r.choice([r.choice(letters), r.choice(words) + " ", "".join(r.choice(letters[:12]) for _ in range(4)) + " "]) for _ in range(r.randint(1, 40))) for _ in range(500)]
    ids, bounds = e(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert e.tokenizer.encode(t or "", add_special_tokens=False).ids == ids[bounds[i] : bounds[i + 1]].tolist()
    plain = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzeeeaaatttüé") for _ in range(r.randint(1, 14))) for _ in range(20_000)]
    fast, _ = e._words(plain)
    e.ranked = None
    assert np.array_equal(fast, e._words(plain)[0])


def test_packing(spark):
    r = random.Random(1)
    texts = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.choice([0, 1, 30, 700])))) for i in range(120)] + [(500, None), (7, "again again"), (7, "again again")]
    df = table(spark, texts)
    got = packing.pack(df, length=256, window=1024).toPandas()
    e = tokens.WordEncoder(tokens.vocabulary_path(tokens.WORD_VOCABULARY)).tokenizer
    want = Counter()
    for _, t in texts:
        want[len(e.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    assert got.length.sum() == sum(k * v for k, v in want.items())
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate(([0], np.cumsum(g.length)[:-1]))).all() and g.length.sum() <= 256
    assert (got.groupby("sequence_id").length.sum().iloc[:-1] == 256).all()
    ids = {i: np.array([*e.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts if i != 7}
    for p in got[got.doc_id != 7].itertuples():
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    assert packing.pack(empty(spark)).count() == 0


def test_packing_keeps_the_mixture(spark):
    lengths = spark.createDataFrame([(i, "a" if i % 3 else "b", 10 + i % 7) for i in range(3000)], "uid long, source string, n long")
    placed = packing.positions(lengths, window=2000, mixture=1).join(lengths, "uid").groupBy("window_id").pivot("source", ["a", "b"]).agg(F.sum("n")).toPandas().sort_values("window_id")
    total = lengths.groupBy("source").agg(F.sum("n").alias("n")).toPandas().set_index("source").n
    for s in "ab":
        done, share = placed[s].cumsum(), total[s] / total.sum()
        assert (abs(done - share * 2000 * (placed.window_id + 1))[:-1] <= 16).all()  # within one document at any time
    weighted = packing.positions(lengths, window=2000, weights={"a": 1, "b": 3}).join(lengths, "uid")
    first = weighted.where("window_id = 0").groupBy("source").agg(F.sum("n").alias("n")).toPandas().set_index("source").n
    assert abs(first["b"] - 1500) <= 16 and abs(first["a"] - 500) <= 16
    spots = packing.positions(lengths, window=2000).join(lengths, "uid").orderBy("position").toPandas()
    assert (spots.position.to_numpy() == np.concatenate(([0], np.cumsum(spots.n)[:-1]))).all()


def round_robin(queues, quantum):
    """Deficit round-robin, one window after the other: {source: [window of each document]}."""
    out, sent, deficit, window = {s: [] for s in queues}, dict.fromkeys(queues, 0), dict.fromkeys(queues, 0.0), 0
    while any(sent[s] < len(q) for s, q in queues.items()):
        for s, q in queues.items():
            deficit[s] += quantum[s]
            while sent[s] < len(q) and q[sent[s]] <= deficit[s]:
                deficit[s] -= q[sent[s]]
                sent[s] += 1
                out[s].append(window)
        window += 1
    return out


def test_packing_equals_a_sequential_round_robin(spark):
    r = random.Random(13)
    queues = {s: [r.choice([1, 2, 3, 5, 8, 13, 100]) for _ in range(r.randint(50, 300))] for s in "abcd"}
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, q in queues.items() for n in q)]
    weights = {"a": 1.0, "b": 2.0, "c": 4.0, "d": 9.0}  # of 16, so quanta are exact: 2.5, 5, 10 and 22.5
    got = packing.positions(spark.createDataFrame(rows, "uid long, source string, n long"), window=40, weights=weights).collect()
    found = {x.uid: x.window_id for x in got}
    want = round_robin(queues, {s: 2.5 * w for s, w in weights.items()})
    assert {s: [found[i] for i, t, _ in rows if t == s] for s in queues} == want
    sizes = {i: n for i, _, n in rows}
    at = 0
    for x in sorted(got, key=lambda x: x.position):
        assert x.position == at
        at += sizes[x.uid]
    assert [x.window_id for x in sorted(got, key=lambda x: x.position)] == sorted(found.values())


# line dedup


def within_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return len(a) - len(b) <= 1 and a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def lines_brute(texts):
    seen, near, out = {}, set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        for p, line in enumerate((t or "").split("\n")):
            line = line.strip(" ")
            if len(line) >= 20 and line not in seen:
                if any(within_one(o, line) for o in seen):
                    near.add(line)
                seen[line] = (i, p)
    for i, t in texts:
        kept, equal, close = [], 0, 0
        for p, line in enumerate((t or "").split("\n")):
            s = line.strip(" ")
            if len(s) >= 20 and seen[s] != (i, p):
                equal += 1
            elif s in near:
                close += 1
            else:
                kept.append(line)
        out[i] = (equal, close, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcdeé 𝒳") for _ in range(r.randint(18, 60))) for _ in range(6)]

    def changed(x):
        p, o = r.randrange(len(x)), r.random()
        return x if o < 0.2 else x[:p] + r.choice("xyz") + x[p:] if o < 0.4 else x[:p] + x[p + 1 :] if o < 0.6 else x[:p] + r.choice("xyz") + x[p + 1 :] if o < 0.8 else x[:p] + "QQQ" + x[p:]

    texts = [(i, "\n".join(changed(r.choice(base)) for _ in range(r.randint(0, 8)))) for i in range(120)] + [(400, None), (401, ""), (402, "\n\n"), (403, "the same line twice here\n" * 3)]
    assert by_id(line_dedup.report(table(spark, texts)), "n_equal", "n_near", "kept_sha256") == lines_brute(texts)


def test_line_dedup_hot_buckets_and_columns(spark):
    stem = "one long template line with many small changes in it"
    texts = [(i, stem[: 10 + i % 40] + chr(97 + i % 26) * 3 + stem[10 + i % 40 :]) for i in range(400)] + [(1000, stem), (1001, stem[:-1])]
    assert by_id(line_dedup.report(table(spark, texts)), "n_equal", "n_near", "kept_sha256") == lines_brute(texts)
    df = table(spark, [(1, "keep this whole line please\nx"), (2, "keep this whole line please"), (3, None), (4, "")])
    out = line_dedup.deduplicated(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {1: "keep this whole line please\nx", 3: None, 4: ""}
    assert line_dedup.report(empty(spark)).count() == 0


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("bucket", [line_dedup.BUCKET, 2])
def test_line_dedup_threshold_grows(spark, monkeypatch, bucket):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdeé𝒳") for _ in range(r.randint(1, 7)))
    lines = []
    for n in (23, 24, 25, 36, 60):
        base = " ".join(word() for _ in range(n))
        for _ in range(12):
            x = base
            for _ in range(r.randint(0, n // 10)):
                p = r.randrange(len(x))
                x = x[:p] + r.choice(["", " ", "q", "q" + x[p]]) + x[p + 1 :]
            lines.append(x.strip(" "))
    lines = list(dict.fromkeys(lines))
    r.shuffle(lines)
    edits = lambda a, b: max(1, min(a.count(" ") + 1, b.count(" ") + 1) // 12)
    want = {i: (0, int(any(edits_between(o, x) <= edits(o, x) for o in lines[:i]))) for i, x in enumerate(lines)}
    assert 0 < sum(v[1] for v in want.values()) < len(lines)
    assert by_id(line_dedup.report(table(spark, list(enumerate(lines)))), "n_equal", "n_near") == want


def test_line_dedup_groups_of_near_copies(spark, monkeypatch):
    written, found = line_dedup.far_later, []
    monkeypatch.setattr(line_dedup, "far_later", lambda *a: found.append(written(*a)) or found[0])
    monkeypatch.setattr(line_dedup.Scratch, "clear", lambda *a: None)  # the tables stay for the count below
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    copies = [" ".join([*base[:p], base[p][:3] + "x" + base[p][4:], *base[p + 1 :]]) for p in range(60)]
    copies += [" ".join([*base[:p], base[p] + "yz"[p % 2], *base[p + 1 :]]) for p in range(60)]
    junk = [" ".join(["spam"] * n + ["eggs"] * (60 - n)) for n in range(0, 61, 20)] + [" ".join(["spam"] * 61)]
    lines = copies + junk
    want = {i: (0, int(any(edits_between(o, x) <= 5 for o in lines[:i]))) for i, x in enumerate(lines)}
    assert sum(v[1] for v in want.values()) == 120
    assert by_id(line_dedup.report(table(spark, list(enumerate(lines)))), "n_equal", "n_near") == want
    assert found[0].count() == 120  # a row of each line, where a row of each pair would be 7,141


def test_line_dedup_words_stay_in_their_row(spark):
    line = " ".join(["spam"] * 600 + ["eggs"] * 600)
    keys = spark.createDataFrame([(line, 100)], "line string, edits int").select(line_dedup.signature(F.col("line"), F.col("edits")).alias("s")).first().s["keys"]
    assert len(keys) == len(set(keys)) <= 2 * 201 and len(keys) >= 201


def test_banded_distance(spark):
    r = random.Random(4)
    pairs = []
    for _ in range(300):
        a = "".join(r.choice("ab") for _ in range(r.randint(20, 40)))
        b = list(a)
        for _ in range(r.randint(0, 3)):
            p = r.randrange(len(b))
            b[p : p + r.randint(0, 1)] = r.choice(["", "a", "c"])
        b = "".join(b)
        pairs.append((a, b) if len(a) >= len(b) else (b, a))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", (line_dedup.banded_distance(F.col("x"), F.col("y")) <= 1).alias("near")).collect()
    assert all(g.near == within_one(g.x, g.y) for g in got if len(g.x) - len(g.y) <= 1)


# media


def test_webp_round_trip(spark):
    texts = [(1, None), (2, ""), (3, "a"), (4, "ab" * 500), (5, "x" * 192), (6, "\x00é𝒳" * 300), (7, "hello world" * 20_000), (8, "a")]
    got = {r.doc_id: r for r in webp.media_column(table(spark, texts), keep_media=True).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        g = got[i]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert g.media_sha256 == hashlib.sha256(g.media).hexdigest() and webp.load(bytes(g.media)).tobytes() == payload
    assert got[3].feature == got[8].feature and webp.media_column(empty(spark)).count() == 0


def test_webp_many_rows():
    payload = b"abcdefgh" * (192 * (webp.MAX_ROWS + 3) // 8)
    assert webp.load(webp.store(payload)).tobytes() == payload


def tools_of(media):
    """Which tools the encoder used, from the file's head: a transform's kind, the colour cache, or neither."""
    bits = webp.Bits(bytes(media[20:]))
    bits.read(24)
    bits.read(16)
    if bits.read(1):
        return f"transform {bits.read(2)}"
    return "cache" if bits.read(1) else "no cache"


def test_webp_refers_back_where_that_is_smaller():
    r = random.Random(4)
    line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
    triples = ["".join(r.choice("abcdefghij") for _ in range(3)) for _ in range(24)]
    texts = {"periodic": "The " * 700, "pairs": "ab" * 400, "line": line * 9, "triples": "".join(r.choice(triples) for _ in range(3000)), "few": "".join(r.choice(triples[:8]) for _ in range(3000)), "prose": line * 1, "blank": " " * 600, "spam": "spam! " * 50 + "end", "one": "x"}
    found = {}
    for name, text in texts.items():
        payload = webp.payload_of(text.encode())
        rows = np.frombuffer(payload, np.uint8).reshape(-1, webp.WIDTH, webp.CHANNELS)
        media, plain = webp.store(payload), webp.encode_literals(rows)
        assert webp.load(media).tobytes() == payload and len(media) <= len(plain)
        every = webp.encode_repeats(rows)
        assert every is None or webp.load(every).tobytes() == payload
        found[name] = tools_of(media) if len(media) < len(plain) else "literals"
    assert found["periodic"] == found["line"] == "no cache" and found["few"] == "transform 3" and found["triples"] == "cache" and found["prose"] == "literals", found
    colours = np.array([0xFF000000 | i * 7919 for i in range(40)], np.uint32)
    pixels = colours[np.random.default_rng(0).integers(0, 40, 64 * 30)]
    parts = webp.copies(pixels) or []
    for cache_bits in (0, 1, 5, 11):
        values, widths = webp.entropy_coded(pixels, 64, True, parts, cache_bits)
        bits = webp.Bits(webp.put(np.array(values), np.array(widths)) + bytes(8))
        assert np.array_equal(webp.read_pixels(bits, 64, 30, True), pixels)


# WARC


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 200), (2, None, "x" * 200), (None, "q", "x" * 200), (3, "s", None), (4, "s", ""), (5, "t\r\nX: y", "é" * 60), (6, "t", "é" * 60), (7, "u", "short"), (8, "u", "short"), (2, None, "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"n": F.lit(1), "first": F.lit(2), "payload": F.lit("z")})
    got = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.round_trip(pages).collect()), key=str)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i is None, i or 0, len((t or "").encode()), *(("revisit", 1) if t == "x" * 200 and i != 1 else ("revisit", 5) if i == 6 else ("response", None)), digest(t)) for i, _, t in rows]
    assert got == sorted(want, key=str)
    path = warc.archive_pages(pages, f"file://{tmp_path}/w")
    light = warc.read_archive(spark, path, ["page_id", "record_type"]).where("record_type = 'revisit' and page_id in (2, 6)")
    assert sorted(r.page_id for r in light.collect()) == [2, 2, 6] and "Filter" not in light._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_skips_payloads_and_reads_plain_files(tmp_path):
    first = warc.record("response", 1, "u", None, "d", 50_000, bytes(random.Random(0).randbytes(50_000)))
    second = warc.record("revisit", 2, "u", 1, "d", 50_000, b"")
    (tmp_path / "a.warc.gz").write_bytes(first + second)

    class Counting:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def read(self, n):
            out = self.file.read(n)
            self.bytes += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.file, name)

    with open(tmp_path / "a.warc.gz", "rb") as f:
        counting = Counting(f)
        assert [h["page_id"] for h in warc.read_records(counting, lambda h: h["record_type"] == "revisit", True)] == [2]
        assert counting.bytes < 10_000
    with open(tmp_path / "a.warc.gz", "rb") as f:
        assert len(next(warc.read_records(f, lambda h: True, True))["payload"]) == 50_000
    plain = zlib.decompressobj(31)
    (tmp_path / "b.warc").write_bytes(plain.decompress(first) + zlib.decompressobj(31).decompress(second))
    with open(tmp_path / "b.warc", "rb") as f:
        assert [(h["page_id"], len(h["payload"] or b"")) for h in warc.read_records(f, lambda h: True, True)] == [(1, 50_000), (2, 0)]


def test_warc_appends_and_overwrites(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = lambda a, b: spark.createDataFrame([(i, "u", f"text {i}") for i in range(a, b)], "page_id long, url string, html string").repartition(3)
    ids = lambda: sorted(r.page_id for r in warc.read_archive(spark, path, ["page_id"]).collect())
    warc.archive_pages(pages(0, 10), path)
    warc.archive_pages(pages(10, 20), path)
    assert ids() == list(range(20))
    warc.records(pages(30, 35)).write.format("warc").mode("overwrite").save(path)
    assert ids() == list(range(30, 35)) and not [x for x in (tmp_path / "w").iterdir() if x.is_dir()]


def test_warc_refuses_what_is_cut_or_malformed(tmp_path):
    one = warc.record("response", 1, "u", None, "d", 5000, random.Random(0).randbytes(5000))
    plain = zlib.decompressobj(31).decompress(one)
    no_length = zlib.compress(plain, wbits=31)
    read = lambda data, payload=True: list(warc.read_records(warc.Blocks(io.BytesIO(data), 512), lambda h: True, payload))
    for whole in (one, plain, no_length):
        assert [len(x["payload"]) for x in read(whole * 3)] == [5000] * 3 and len(read(whole * 3, False)) == 3
        for end in (30, 200, 3000, len(whole) - 9):
            for payload in (True, False):
                with pytest.raises(ValueError, match="at byte"):
                    read(whole + whole[:end], payload)
    with pytest.raises(ValueError, match="Content-Length"):
        read(plain.replace(b"Content-Length: 5", b"Content-Length: x5", 1))
    assert read(plain.replace(b"X-Page-ID: 1", b"X-Page-ID: one"))[0]["page_id"] is None
    assert read(b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n")[0]["record_type"] == "metadata"


def test_warc_query_inflates_responses_only(spark):
    pages = spark.createDataFrame([(i, "u", "same text " * 50) for i in range(20)], "page_id long, url string, html string")
    plan = warc.round_trip(pages)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "BatchScan" in x]
    assert len(scans) == 2 and sum("payload#" in x for x in scans) == 1 and "record_type" not in "".join(x for x in plan.splitlines() if "Filter (" in x)


# Jaccard join


def jaccard_brute(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rounds", [ngram_join.ROUNDS, ()])
def test_jaccard_join(spark, rounds):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.choice([1, 2, 5, 12])):
            b = list(base)
            for _ in range(r.randint(0, 4)):
                b[r.randrange(len(b))] = r.choice(vocabulary)
            if r.random() < 0.3:
                b += [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
            texts.append((len(texts), " ".join(b).upper() if r.random() < 0.2 else " \t".join(b)))
    texts += [(len(texts) + i, t) for i, t in enumerate([None, "", " \n", "one", "one two", "ONE two", "a b c d", "a b c d e", "long " * 20_000])]
    assert by_id(ngram_join.near_duplicates(table(spark, texts), rounds=rounds), "n_shingles", "component_id") == jaccard_brute(texts)


def test_jaccard_join_edges(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f"), (None, "other words are in here")], "doc_id long, text string")
    assert Counter((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df).collect()) == Counter([(5, 5), (5, 5), (None, 5), (9, 5), (None, None)])
    nameless = spark.createDataFrame([(None, f"{x} b c d e f g h i j k l m n o p q r s t u v w x y z") for x in "a1"] + [(7, "1 b c d e f g h i j k l m n o p q r s t u v w x y z 2")], "doc_id long, text string")
    assert [r.component_id for r in ngram_join.near_duplicates(nameless).collect()] == [7] * 3  # links of texts without an id count


def test_one_of_each_keeps_a_row_of_each_component(spark):
    texts = ["a b c d e f", "a b c d e f", "other words are all in here", "A b c d e f"]
    rows = [(5, texts[0], "x"), (5, texts[0], "y"), (None, texts[0], "z"), (9, texts[3], "x"), (9, texts[2], "x"), (None, None, "n"), (4, "", "n"), (4, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string")
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    found = sorted(((r.doc_id or 0, r.text or "") for r in got.collect()))
    assert found == [(0, ""), (4, ""), (4, ""), (5, texts[0]), (9, texts[2])]
    assert ngram_join.one_of_each(empty(spark)).count() == 0


def test_tree_keeps_one_large_group_cheap():
    base = np.arange(1000, 1400, dtype=np.uint64)
    sets = [np.sort(np.concatenate((base, np.array([10_000 + i, 20_000 + i], np.uint64)))) for i in range(300)]
    assert set(ngram_join.links_within(sets, list(range(300)))) == {0}


def test_components(spark):
    r = random.Random(0)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.id: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}


# byte strings


def suffix_brute(texts):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        data = (t or "").encode()
        mask = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                mask[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        out[i] = (len(data), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(data, mask, strict=True) if not m)).hexdigest())
    return out


def test_suffix_classes_follow_the_order_of_the_bytes():
    r = np.random.default_rng(2)
    for text in (r.integers(0, 2, 3000), np.tile(r.integers(0, 256, 130), 9), np.zeros(500), np.repeat(r.integers(0, 256, 8), 150)):
        text = text.astype(np.uint8)
        at = r.permutation(len(text) - suffix_dedup.SPAN + 1)
        strings = [text[i : i + suffix_dedup.SPAN].tobytes() for i in at]
        rank = {x: i for i, x in enumerate(sorted(set(strings)))}
        assert suffix_dedup.suffix_classes(text, at).tolist() == [rank[x] for x in strings]


@pytest.mark.parametrize("many", [suffix_dedup.HOT, 2])
def test_suffix_dedup(spark, many):
    r = random.Random(1)
    base = ["".join(r.choice("abcd ") for _ in range(r.randint(120, 400))) for _ in range(6)]
    texts = [(i, "".join(r.choice([r.choice(base), r.choice(base)[20:300], "a" * r.randint(1, 300), "xyz" * r.randint(1, 90), str(r.random()), "é\n"]) for _ in range(r.randint(0, 6)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "ab" * 40_000), (103, base[0] * 300)]
    assert by_id(suffix_dedup.dedup(table(spark, texts), many=many), "n_bytes", "n_removed", "n_spans", "kept_sha256") == suffix_brute(texts)


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.dedup(empty(spark)).count() == 0
    t = "".join(random.Random(9).choices("abcdef", k=150))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (3, "x" + t), (7, "x" * 99)], "doc_id long, text string")
    assert Counter((r.doc_id, r.n_removed) for r in suffix_dedup.dedup(df).collect()) == Counter([(3, 0), (5, 150), (5, 150), (None, 150), (7, 0)])


# decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def contamination_brute(texts, items):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = {}
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if f := windows.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= f
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark):
    r = random.Random(6)
    some = ["a", "b", "c1", "É", "d"]
    texts = [(i, r.choice([" ", "-", ", "]).join(r.choice(some) for _ in range(r.randint(0, 40)))) for i in range(200)] + [(500, None), (501, ""), (502, "a b " * 20_000)]
    items = [(i, " ".join(r.choice(some) for _ in range(r.choice([0, 2, 5, 9, 10, 11, 14])))) for i in range(30)] + [(77, None), (78, " A  b "), (78, "a b")]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    df = table(spark, texts)
    assert by_id(decontaminate.report(df, b), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == contamination_brute(texts, items)
    long_items = [(1, " ".join(f"q{i}" for i in range(30)))]
    planted = [(1, "x y z " + " ".join(f"Q{i}" for i in range(5, 15)) + " tail"), (2, " ".join(f"q{i}" for i in range(9))), (3, None)]
    b2 = spark.createDataFrame(long_items, "item_id long, text string")
    kept = decontaminate.clean(table(spark, planted), b2)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == table(spark, planted).columns
    assert decontaminate.report(empty(spark), b).count() == 0 and not any(r.contaminated for r in decontaminate.report(df, b.limit(0)).collect())


def test_decontamination_counts_items_without_an_id(spark):
    b = spark.createDataFrame([(None, " ".join(f"q{i}" for i in range(12))), (None, "r s t"), (4, "u v")], "item_id long, text string")
    texts = [(1, "x " + " ".join(f"Q{i}" for i in range(1, 11)) + " y"), (2, "a r s t u v"), (3, "a b c")]
    got = by_id(decontaminate.report(table(spark, texts), b), "n_hit", "n_items", "contaminated")
    assert got == {1: (10, 0, True), 2: (5, 1, True), 3: (0, 0, False)}
    assert [r.doc_id for r in decontaminate.clean(table(spark, texts), b).collect()] == [3]


def test_decontamination_takes_ids_of_any_type(spark):
    b = spark.createDataFrame([("b-2", "u v"), ("a", "r s t"), (None, "x y")], "item_id string, text string")
    got = by_id(decontaminate.report(table(spark, [(1, "u v r s t x y"), (2, "u")]), b), "n_hit", "n_items", "items_sha256")
    assert got == {1: (7, 2, hashlib.sha256(b"a,b-2").hexdigest()), 2: (0, 0, hashlib.sha256(b"").hexdigest())}


# quality


def test_quality(spark):
    r = random.Random(8)
    good = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(60)) + "."
    bad = lambda: r.choice([(r.choice(["ab", "cde"]) + " ") * 50, " ".join(w.upper() + "!!" for w in good().split())])
    texts = [(i, good() if i % 3 else bad()) for i in range(400)] + [(1000, None), (1001, ""), (1002, "\x00" * 50), (5, "repeated row"), (1003, "word " * 100_000)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(400)] + [(9999, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = table(spark, texts)
    rows = quality.report(df, labels).collect()
    assert len(rows) == len(texts) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)
    held = [x for x in rows if x.held_out and x.doc_id < 400]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in rows) and len(held) > 50
    assert sum(x.predicted == (x.doc_id % 3 != 0) for x in held) / len(held) > 0.97
    again = quality.report(df.drop("lang").withColumns({"source": F.lit("z"), "lang": F.lit("q")}), labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert {(x.doc_id, round(x.score, 9)) for x in again.collect()} == {(x.doc_id, round(x.score, 9)) for x in rows}
    assert {x.score for x in quality.report(df, labels.limit(0)).collect()} == {0.5} and quality.report(empty(spark), labels).count() == 0
    assert quality.keep_good(df, labels).columns == df.columns


def test_quality_votes_as_plain_neighbours_do():
    r = np.random.default_rng(3)
    x = r.integers(0, 5, (200, quality.TRIGRAMS + quality.TERMS)).astype(np.float32)
    x[100:150] = x[:50]  # ties, also between the labels
    y = r.integers(0, 2, 200)
    model = quality.Model(x, y, neighbours=7)
    ask = np.concatenate((r.integers(0, 5, (30, x.shape[1])).astype(np.float32), x[:20], np.zeros((2, x.shape[1]), np.float32)))
    got = model(ask.copy())
    vectors = quality.unit(quality.weighted(ask.copy(), model.idf) @ model.projection)
    for v, score in zip(vectors, got, strict=True):
        if not v.any():
            assert score == 0.5
            continue
        near = [(round(float(v @ w), 5), label) for w, label in zip(model.vectors, y, strict=True)]
        last = sorted((c for c, _ in near), reverse=True)[6]
        share = {q: np.mean(y == q) for q in (0, 1)}
        votes = {q: sum(np.exp(8 * (c - 1)) * 0.5 / share[q] for c, label in near if label == q and c >= last - 2e-5) for q in (0, 1)}
        strict = {q: sum(np.exp(8 * (c - 1)) * 0.5 / share[q] for c, label in near if label == q and c >= last) for q in (0, 1)}
        assert min(abs(v[1] / (v[0] + v[1]) - score) for v in (votes, strict)) < 1e-3


def test_quality_fit_takes_one_text_of_a_repeated_id(spark):
    texts = [(1, f"good words number {i} are here") for i in range(500)] + [(2, "BAD BAD BAD!!"), (3, "more good words"), (4, "")]
    labels = spark.createDataFrame([(i, int(i != 2), 0) for i in range(5)], "doc_id long, quality int, toxic int")
    model = quality.fit(table(spark, texts), labels)
    used = sorted(i for i in range(1, 5) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert len(model.label if model else used) == len(used)


# token counts


def test_rollup(spark):
    texts = [(i, t) for i, t in enumerate(["one two", "three", None, "", "vier fünf", "six " * 1000])]
    df = table(spark, texts)
    count = tokens.byte_counter(tokens.vocabulary_path(tokens.BYTE_VOCABULARY))
    held = token_rollup.Rollup(spark)
    assert held.apply("b0", token_rollup.deltas(df)) and not held.apply("b0", token_rollup.deltas(df))
    total = lambda: {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens, r.n_chars) for r in held.totals().collect()}
    want = Counter()
    for r in df.collect():
        for k, v in enumerate((1, count(r.text or ""), len(r.text or ""))):
            want[r.source, r.lang, k] += v
    assert total() == {(s, g, token_rollup.VERSION): (want[s, g, 0], want[s, g, 1], want[s, g, 2]) for s, g, _ in want}
    held.apply("b1", token_rollup.revision(df, token_rollup.VERSION, "v2"))
    assert {k[2] for k in total()} == {"v2"}
    before = total()
    assert held.compact() and not held.compact() and total() == before and not held.apply("b0", token_rollup.deltas(df))
    held.apply("b/2 .%", token_rollup.deltas(df, -1, "v2"))
    held.apply("", token_rollup.deltas(empty(spark)))
    assert total() == {} and held.batches() == ["", "b/2 .%", "b0", "b1"]
    assert held.compact() and total() == {}
    other = token_rollup.Rollup(spark, held.path)  # a second driver that was a moment later
    other.committed = lambda batch: False
    assert held.apply("b4", token_rollup.deltas(df)) and not other.apply("b4", token_rollup.deltas(df))
    held._write(token_rollup.deltas(df))  # written and never committed
    assert sum(v[0] for v in total().values()) == len(texts)


def test_rollup_history_equals_a_plain_count(spark):
    texts = [(i, f"text number {i} " * (i % 9)) for i in range(60)] + [(70, None), (3, "again"), (3, "again")]
    df = table(spark, texts)
    count = tokens.byte_counter(tokens.vocabulary_path(tokens.MULTI_VOCABULARY))
    want = Counter()
    for r in df.collect():
        for k, v in enumerate((1, count(r.text or ""), len(r.text or ""))):
            want[r.source, r.lang, k] += v
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens, r.n_chars) for r in token_rollup.rollup(df).collect()}
    assert got == {(s, g, token_rollup.MULTI_VERSION): tuple(want[s, g, k] for k in range(3)) for s, g, _ in want}
    assert token_rollup.rollup(empty(spark)).count() == 0
