"""Each operator against a brute-force version, on real rows and on a table of awkward ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_row string, Row int, has_letters string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def awkward():
    base = " ".join(WORDS * 3)
    texts = [
        None, "", " \t\n", "one", "one two three", base, base, base.upper(), base + " tail one two", "x" * 5000, "a\x00b \x01 c", "😀 déjà vu 中文 текст", " ".join(WORDS * 400), "call +1 (743) 555-3824 or mail a.b@example.com, card 4111111111111111",
        "word " * 300, "\n".join(["same line here"] * 20), base.replace("kappa", "KAPPA x"), "!!! ### $$$", "1234567890123456", None,
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None][i % 4], len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    return rows + [rows[5], (5, "another text with the same id", "en", "s1", 1, None, None, None), (None, base, "en", "s1", 1, "x", 1, "y")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").persist()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).persist()


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def words(t):
    return t.encode().split()


# Words and their hashes
def thue_morse(n):
    """Two words that every polynomial hash modulo a power of two takes for one."""
    s = b"a"
    while len(s) < n:
        s += bytes(195 - c for c in s)
    return s.decode(), bytes(195 - c for c in s).decode()


def test_hashes_tell_words_apart():
    from polislake.llm._tokens import Words, same_spans

    rng = np.random.default_rng(3)
    a, b = thue_morse(512)
    texts = [a, b, "x" * 9, "x" * 10, "x" * 8, "\0" * 8, "\0" * 9, "ABCDEFGHIjkl", "abcdefghijkl", *("".join(map(chr, rng.integers(97, 99, int(rng.integers(1, 40))))) for _ in range(500))]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]))
    assert len(w.start) == len(texts)
    for seed in (0, 1):
        h = w.hashes(seed)
        assert len(set(h.tolist())) == len(set(texts))
        assert {t: x for t, x in zip(texts, h.tolist())} == dict(zip(texts, h.tolist())) and all(h[i] == h[texts.index(t)] for i, t in enumerate(texts))
        low = w.hashes(seed, lower=True)
        assert low[7] == low[8] and h[7] != h[8]
    order = rng.permutation(len(texts))
    same = same_spans(data, w.start, w.end, data, w.start[order], w.end[order])
    assert same.tolist() == [texts[i] == texts[j] for i, j in enumerate(order)]


def test_words_alike_by_weak_hashes_stay_apart(spark):
    from polislake.llm.bm25_search import search
    from polislake.llm.jaccard_join import jaccard_components
    from polislake.llm.lattice_lm import score_texts
    from polislake.llm.sampling import decode_column, sample_segmentations
    from polislake.llm.substring_dedup import remove_repeats

    a, b = thue_morse(512)
    tail = [f"{a} {x}" for x in "pqrstuvwxyzklmno"], [f"{b} {x}" for x in "pqrstuvwxyzklmno"]
    df = spark.createDataFrame([(1, a), (2, b), (3, " ".join(tail[0])), (4, " ".join(tail[1]))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(df, percent=50).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert remove_repeats(df).agg(F.sum("n_removed")).first()[0] == 0
    assert all(r["query_id"] % 2 == r["doc_id"] % 2 for r in search(df.where("doc_id < 3"), F.lit(True)).collect())
    assert {r["doc_id"]: r["n_known"] for r in score_texts(df.where("doc_id < 3"), F.col("doc_id") == 1, class_column=None).collect()} == {1: 2, 2: 1}
    got = decode_column(sample_segmentations(df)).select("doc_id", "decoded").distinct().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, df.collect()))


# 1
@pytest.mark.parametrize("name", ["docs", "odd"])
def test_quality_counts(name, request):
    from polislake.llm.quality_rules import quality_rules

    df = request.getfixturevalue(name)
    got = Counter(tuple(r)[:8] for r in quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("kept") | F.lit(True)).collect())
    want = Counter()
    for i, t in rows_of(df):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {p + k for p in range(len(w) - 2) if grams[w[p], w[p + 1], w[p + 2]] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w), True] += 1
    assert got == want


def test_quality_keeps_clean_documents(spark, sf, docs):
    from polislake.llm.quality_rules import quality_rules

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_rules(docs).join(labels, "doc_id").where("NOT base_failed")
    r = {(x["quality"], x["kept"]): x["count"] for x in judged.groupBy("quality", "kept").count().collect()}
    assert r.get((1, True), 0) >= 0.97 * (r.get((1, True), 0) + r.get((1, False), 0))


def test_sketch_buckets(spark):
    from polislake.llm.quality_rules import bucket_floor, bucket_of

    df = spark.range(0, 5000).withColumn("b", bucket_of(F.col("id"))).withColumn("f", bucket_floor(F.col("b")))
    rows = [(r["id"], r["b"], r["f"]) for r in df.orderBy("id").collect()]
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert all(f <= x <= f + max(1, x / 32) for x, _, f in rows)


def test_quality_empty(spark, odd):
    from polislake.llm.quality_rules import quality_rules

    assert quality_rules(odd.limit(0)).count() == 0


# 2
def test_language_id(docs, odd):
    from polislake.llm.language_id import identify, learn

    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    net = learn(docs, train)
    got = identify(docs, train, net).join(docs.select("doc_id", "lang"), "doc_id").where(~train)
    n = got.count()
    assert got.where("lang = lang_pred").count() >= 0.97 * n
    assert got.where("score < 0 OR score > 1").count() == 0
    r = [(x["lang_pred"], x["score"]) for x in identify(odd, train, net).collect()]
    assert len(r) == odd.count()
    assert sum(p == "und" for p, _ in r) == sum(not re.search(r"[^\W\d_]", t or "") for _, t, *_ in awkward())
    assert identify(odd.limit(0), train, net).count() == 0
    assert identify(odd.withColumn("lang", F.lit(None).cast("string")), train).where("lang_pred <> 'und'").count() == 0


def test_backpropagation():
    from polislake.llm.language_id import PAD, Network

    net = Network(["a", "b", "c"], hidden=4)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (7, 5))
    x[5:, 2] = PAD
    y = rng.integers(0, 3, 5)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    _, g = net.gradients(x, y)
    for name in net.w:
        at = tuple(rng.integers(0, s) for s in net.w[name].shape) if not name.startswith("in_") else (int(x[1, 1]), 3)
        old, eps = net.w[name][at], 1e-4
        net.w[name][at] = old + eps
        up = net.gradients(x, y)[0]
        net.w[name][at] = old - eps
        down = net.gradients(x, y)[0]
        net.w[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-4, name


def test_forward_pass_by_hand():
    """Each byte's distribution and their mean, a cell and a byte at a time."""
    from polislake.llm.language_id import WINDOW, Network

    net = Network(["a", "b", "c"], hidden=3)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 5, WINDOW, WINDOW + 1, 3 * WINDOW - 7, 0)]
    got = net.label_texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(part, d):
        k, w_in, w_rec = net.hidden, net.w[f"in_{d}"].astype(float), net.w[f"rec_{d}"].astype(float)
        h, out = [0.0] * k, {}
        for t in range(len(part)) if d == "f" else reversed(range(len(part))):
            x = w_in[part[t]]
            g = [sum(h[j] * w_rec[j, i] for j in range(k)) for i in range(3 * k)]
            z = [sigmoid(x[i] + g[i]) for i in range(k)]
            r = [sigmoid(x[k + i] + g[k + i]) for i in range(k)]
            n = [math.tanh(x[2 * k + i] + r[i] * g[2 * k + i]) for i in range(k)]
            h = [(1 - z[i]) * n[i] + z[i] * h[i] for i in range(k)]
            out[t] = h
        return out

    for text, p in zip(texts, got):
        total = np.zeros(3)
        for a in range(0, len(text), WINDOW):
            part = text[a : a + WINDOW]
            f, b = states(part, "f"), states(part, "b")
            for t in range(len(part)):
                e = np.exp(np.array(f[t]) @ net.w["out_f"] + np.array(b[t]) @ net.w["out_b"] + net.w["bias"])
                total += e / e.sum()
        assert np.allclose(p, total / max(len(text), 1), atol=1e-5)


def test_windows_cover_every_byte():
    from polislake.llm.language_id import WINDOW, Network

    net = Network(["a", "b"])
    data = np.arange(3 * WINDOW + 5, dtype=np.int64).astype(np.uint8)
    p = net.label_texts(data, np.array([0, len(data), len(data)]))
    assert abs(p[0].sum() - 1) < 1e-5 and p[1].sum() == 0


# 3
def test_arc_round_trip():
    from polislake.llm.warc import arc_bytes, parse_arc

    pages = [(1, "http://a/b c", b"<p>one\n\n</p>"), (2, None, b""), (3, "http://x/\n", "é\r\n\r\nWARC/1.1".encode()), (None, "filedesc://not.a.block", b"x"), (4, "filedesc://", b"y")]
    for version in (1, 2):
        data = arc_bytes(version, "n.arc", pages)
        got = list(parse_arc(data))
        assert [r["body"].partition(b"\r\n\r\n")[2] for r in got] == [p[2] for p in pages]
        assert got[0]["URL"] == "http://a/b%20c" and got[1]["URL"] == "urn:none"
        assert ("Checksum" in got[0]) == (version == 2)
        for r in got:
            assert data[r["offset"] :].startswith(r["URL"].encode() + b" ")
            assert version == 1 or int(r["Offset"]) == r["offset"]
    with pytest.raises(ValueError):
        list(parse_arc(arc_bytes(1, "n.arc", pages)[:-20]))


def record(line, body):
    return f"{line} {len(body)}\n".encode() + body + b"\n"


def test_foreign_archives(spark, tmp_path):
    """Archives as the published format describes them, not made by this library."""
    from polislake.llm.warc import convert_arc, convert_archives, read_warc

    v1 = b"1 0 SomeCrawler\nURL IP-address Archive-date Content-type Archive-length\n\n"
    v2 = b"2 0 SomeCrawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
    page = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<html>" + b"z" * 200
    one = record("filedesc://a.arc 0.0.0.0 19960923142103 text/plain", v1) + record("http://a.b/with space?q=1 10.0.0.1 19960923142104 text/html; charset=utf-8", page) + record("dns:a.b 10.0.0.2 19960923 text/dns", b"a.b 10 IN A 10.0.0.1")
    two = record("filedesc://b.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 b.arc", v2) + record("http://c.d/ 10.0.0.3 19970101000001 text/html 200 abc - 120 b.arc", page)
    cut = one[:-30]
    odd = b"no header line at all\nxx"
    df = spark.createDataFrame([("a.arc", bytearray(one)), ("b.arc", bytearray(two)), ("cut.arc", bytearray(cut)), ("odd.arc", bytearray(odd)), ("empty.arc", bytearray()), ("null.arc", None)], "archive string, content binary")
    got = {(r["archive"], r["offset"]): r for r in convert_arc(df).collect()}
    whole = [r for r in got.values() if not r["malformed"]]
    assert sorted(r["target_uri"] for r in whole) == ["dns:a.b", "http://a.b/with%20space?q=1", "http://a.b/with%20space?q=1", "http://c.d/"]
    assert sorted(r["archive"] for r in got.values() if r["malformed"]) == ["cut.arc", "odd.arc"]
    dns = next(r for r in whole if r["target_uri"] == "dns:a.b")
    assert bytes(dns["payload"]) == b"a.b 10 IN A 10.0.0.1" and dns["warc_date"] == "1996-09-23T00:00:00Z" and dns["http_head"] == ""
    assert all(bytes(r["payload"]).startswith(b"<html>zz") and r["warc_date"][:4] in ("1996", "1997") for r in whole if r is not dns)
    convert_archives(df, f"file://{tmp_path}/warc")
    back = read_warc(spark, f"file://{tmp_path}/warc").collect()
    assert sorted(r["payload_digest"] for r in back) == sorted(r["payload_digest"] for r in whole)
    assert {r["record_type"] for r in back} == {"response"} and {r["page_id"] for r in back} == {None}
    import gzip

    ids = re.findall(rb"WARC-Record-ID: (\S+)", b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("*.gz")))
    assert len(ids) == len(set(ids)) == len(whole)


def test_warc(spark):
    from polislake.llm.warc import archive_pages, read_warc

    long, short = "<p>" + "x" * 200, "tiny"
    rows = [(5, "u", long), (3, "u", long), (9, None, None), (1, "v", short), (2, "v", short), (7, "w", "a\r\n\r\nWARC/1.1\r\nb" * 20), (8, "é", ""), (3, "u", long), (None, "u", long), (None, None, None), (11, "filedesc://x", long), (12, "n", long * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted(((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read_warc(spark, archive_pages(df)).collect()), key=lambda x: (x[0], x[1]))
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and len(b) >= 100 and i != first[h or ""]
        want.append((-1 if i is None else i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert read_warc(spark, archive_pages(df.limit(0))).count() == 0


def test_pages_without_an_id(spark, tmp_path):
    from polislake.llm import warc

    same = "x" * 200
    rows = [(None, "http://a/1", same), (None, "http://a/2", same), (None, None, None), (5, "http://a/5", same), (7, "http://a/7", same)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = warc.archive_pages(pages, f"{tmp_path}/warc")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, path).collect()), key=str)
    assert got == sorted([(None, 200, "response", None), (None, 200, "response", None), (None, 0, "response", None), (5, 200, "response", None), (7, 200, "revisit", 5)], key=str)
    text = "".join(r[0] for r in spark.read.text(path, lineSep="\r\n").collect() if r[0].startswith("WARC-Record-ID"))
    assert len(set(text.split("WARC-Record-ID: ")[1:])) == 5


# 4
@pytest.mark.parametrize("name", ["docs", "odd"])
def test_base_scores(name, request):
    from polislake.llm.lattice_lm import score_texts

    df = request.getfixturevalue(name)
    train = F.crc32(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) % 10 != 0
    got = score_texts(df, train).collect()
    c = Counter()
    for i, t in rows_of(df):
        if zlib.crc32(str(-1 if i is None else i).encode()) % 10 != 0:
            c.update([*t.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows_of(df):
        w = [*t.encode().lower().split(), None]
        want.append((-1 if i is None else i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    key = lambda x: (x[0], x[1], round(x[4], 3))
    have = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    want.sort(key=key)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    assert np.allclose([h[4] for h in have], [w[4] for w in want])
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_lattice_is_the_sum_over_segmentations():
    from polislake.llm.lattice_lm import Chart, lattices_of
    from polislake.llm.pieces import MARK, default_vocabulary, vocabulary

    path = default_vocabulary()
    v, lat = vocabulary(path), lattices_of(path)
    assert abs(np.exp(v.logp[np.isfinite(v.logp)]).sum() - 1) < 1e-9
    ws = ["the", "herean", "été", "x"]
    b = [w.encode() for w in ws]
    chart = Chart(lat, np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)]))
    got = chart.forward(v.logp)[chart.last]

    def total(raw, at):  # over bytes; a mark is one position
        if at == len(raw):
            return 1.0
        out = np.exp(v.logp[v.byte_ids[raw[at] if raw[at] != 0xFF else 32]]) * total(raw, at + 1)
        for k in range(at + 1, len(raw) + 1):
            try:
                name = raw[at:k].replace(b"\xff", MARK.encode()).decode()
            except UnicodeDecodeError:
                continue
            p = v.piece.get(name)
            if p is not None and MARK not in name[1:]:
                out += np.exp(v.logp[p]) * total(raw, k)
        return out

    assert np.allclose(got, [np.log(total(b"\xff" + x, 0)) for x in b])
    use = chart.expected(v.logp, np.ones(len(ws)), len(v.names))
    # Each segmentation covers the word's bytes and its mark once.
    covers = np.array([1 if b else len(x.replace(MARK, " ").encode()) for x, b in zip(v.names, v.is_byte)])
    assert abs((use * covers).sum() - sum(len(x) + 1 for x in b)) < 1e-6 and use.min() >= 0


def segmentations(v, raw, at, seen):
    """The probability of all segmentations of raw[at:]; a mark (0xFF) is one position."""
    if at == len(raw):
        return 1.0
    if at not in seen:
        out = np.exp(v.logp[v.byte_ids[raw[at] if raw[at] != 0xFF else 32]]) * segmentations(v, raw, at + 1, seen)
        for k in range(at + 1, min(len(raw), at + v.longest * 4) + 1):
            try:
                p = v.piece.get(raw[at:k].replace(b"\xff", "▁".encode()).decode())
            except UnicodeDecodeError:
                continue
            if p is not None:
                out += np.exp(v.logp[p]) * segmentations(v, raw, k, seen)
        seen[at] = out
    return seen[at]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_lattice_scores(name, request):
    """lattice_score of whole texts, and score with one class and no fitted words, by sums over all segmentations."""
    from polislake.llm.lattice_lm import score_texts
    from polislake.llm.pieces import default_vocabulary, vocabulary

    v = vocabulary(default_vocabulary())
    df = request.getfixturevalue(name).where("coalesce(length(text), 0) < 2500")
    got = score_texts(df, F.lit(False), class_column=None, classes=1, rounds=0, whole_words=False).collect()
    known = {}

    def score(t):
        total = 0.0
        for w in t.encode().lower().split():
            if w not in known:
                known[w] = np.log10(segmentations(v, b"\xff" + w, 0, {}))
            total += known[w]
        return total

    n = Counter((r["doc_id"], round(r["lattice_score"], 2)) for r in got)
    want = [(i, score(t), len(t.encode().split())) for i, t in rows_of(df)]
    assert np.allclose(sorted(x for _, x in n.elements()), sorted(x for _, x, _ in want), rtol=1e-5, atol=0.02)
    # Without training text the end has a probability of 1 in 1000, once for each text, and each word goes on.
    whole = sorted(s + np.log10(1 / 1001) + k * np.log10(1000 / 1001) for _, s, k in want)
    assert np.allclose(sorted(r["score"] for r in got), whole, rtol=1e-5, atol=1e-3)


def test_model_beats_base(spark):
    from polislake.llm.lattice_lm import score_texts

    # The base gives all unseen words together the weight of one; on a very small corpus, where most are unseen, that flatters it.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    r = score_texts(docs, train).where(~train).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
    assert score_texts(docs.limit(0), train).count() == 0


# 5
@pytest.mark.parametrize("name", ["docs", "odd"])
def test_substring_dedup(name, request):
    from polislake.llm.substring_dedup import COVER, PERIOD, WINDOW, is_difference_cover, remove_repeats

    assert is_difference_cover(COVER, PERIOD)
    df = request.getfixturevalue(name)
    rows = [(-(10**18) if i is None else i, t) for i, t in rows_of(df)]
    least = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - WINDOW + 1):
            k = tuple(w[p : p + WINDOW])
            least[k] = min(i, least.get(k, i))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {p + k for p in range(len(w) - WINDOW + 1) if least[tuple(w[p : p + WINDOW])] < i for k in range(WINDOW)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    got = [(-(10**18) if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()]
    assert sorted(got) == sorted(want)


def test_substring_dedup_empty(odd):
    from polislake.llm.substring_dedup import remove_repeats

    assert remove_repeats(odd.limit(0)).count() == 0


# 6
@pytest.mark.parametrize("name", ["docs", "odd"])
def test_search(name, request):
    from polislake.llm.bm25_search import B, K, K1, search

    df = request.getfixturevalue(name)
    step = 20 if name == "docs" else 1
    rows = [(i, Counter(t.encode().lower().split())) for i, t in rows_of(df)]
    n, mean = len(rows), sum(sum(c.values()) for _, c in rows) / len(rows)
    df_ = Counter(w for _, c in rows for w in c)
    queries = {}
    for i, c in rows:
        if i is not None and i % step == 0:
            queries.setdefault(i, set()).update(c)
    want = {}
    for q, terms in queries.items():
        found = []
        for i, c in rows:
            s = sum(math.log(1 + (n - df_[w] + 0.5) / (df_[w] + 0.5)) * c[w] * (K1 + 1) / (c[w] + K1 * (1 - B + B * sum(c.values()) / mean)) for w in terms if w in c)
            if s > 0:
                found.append((-round(s, 6), -(1 << 63) if i is None else i))
        want[q] = sorted(found)[:K]
    got = {}
    for r in search(df, F.col("doc_id") % step == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], -(1 << 63) if r["doc_id"] is None else r["doc_id"]))
    assert set(got) == {q for q, f in want.items() if f}
    for q, f in got.items():
        assert np.allclose([x[0] for x in f], [x[0] for x in want[q]], atol=2e-6)
        assert len(f) == len(want[q])
    assert search(df.limit(0), F.col("doc_id") % step == 0).count() == 0


# 7
def sample(texts, keys, k, lattice=None):
    from polislake.llm.pieces import default_vocabulary, vocabulary
    from polislake.llm.sampling import Lattice, lattices_for, sample_texts

    path = default_vocabulary()
    b = [t.encode() for t in texts]
    return sample_texts(lattice or Lattice(lattices_for(path), vocabulary(path).logp), np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)]).astype(np.int64), keys, k)


def test_samples_decode_and_differ(docs, odd):
    from polislake.llm.sampling import decode_column, sample_segmentations

    for df in (docs, odd):
        texts = df.select("doc_id", "text").where("text IS NOT NULL").dropDuplicates(["doc_id", "text"])
        got = decode_column(sample_segmentations(df)).withColumnRenamed("doc_id", "of").join(texts, F.col("of").eqNullSafe(F.col("doc_id"))).drop("of")
        rows = got.where("decoded = text").select("doc_id", "text", "sample_rank", "ids", "perturbed", "inclusion").collect()
        by = {}
        for r in rows:
            by.setdefault((r["doc_id"], r["text"]), {})[r["sample_rank"]] = r
        assert set(by) == {(r["doc_id"], r["text"]) for r in df.where("text IS NOT NULL").collect()}
        for r in by.values():
            assert len({tuple(x["ids"]) for x in r.values()}) == len(r)
            assert all(r[i]["perturbed"] >= r[i + 1]["perturbed"] for i in r if i + 1 in r)
            assert all(0 <= x["inclusion"] <= 1 for x in r.values())
    assert sample_segmentations(odd.limit(0)).count() == 0


def test_samples_of_long_texts_and_white_space():
    from polislake.llm.pieces import default_vocabulary, vocabulary
    from polislake.llm.sampling import Lattice, decode, lattices_for

    rng = np.random.default_rng(5)
    v = vocabulary(default_vocabulary())
    texts = ["  two  spaces    in\t\ta\r\n\r\n   row  ", "\n", " ", " " * 40, "\x0b\x0c \r", "▁ literal ▁▁mark", " ".join("".join(map(chr, rng.integers(97, 123, int(rng.integers(1, 12))))) for _ in range(20_000)), "y" * 20_000, *thue_morse(512)]
    lattice = Lattice(lattices_for(default_vocabulary()), v.logp, most=50_000)
    found = [sample(texts, [b"%d" % i for i in range(len(texts))], 4, lattice) for _ in range(3)]  # the second and third time from units that were kept, or forgotten
    for run in found:
        for t, (samples, _, log_z), (first, _, z) in zip(texts, run, found[0]):
            assert all(decode(s[0]) == t for s in samples)
            assert len({tuple(s[0]) for s in samples}) == len(samples)
            assert all((s[0] == f[0]).all() and abs(s[1] - f[1]) < 1e-6 for s, f in zip(samples, first)) and abs(z - log_z) < 1e-6
    assert any(v.names[i].startswith("▁▁") for s in found[0][0][0] for i in s[0])


def test_samples_follow_the_distribution():
    from polislake.llm.pieces import default_vocabulary, vocabulary

    v = vocabulary(default_vocabulary())
    text, n, k = "herean", 4000, 3
    out = {}

    def go(t, i, ids, w):
        if i == len(t):
            out[tuple(ids)] = w
        for j in range(i + 1, len(t) + 1):
            p = v.piece.get(t[i:j])
            if p is not None:
                go(t, j, [*ids, p], w + v.logp[p])

    go("▁" + text, 0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    p = {q: float(np.exp(w - z)) for q, w in out.items()}
    first, member = Counter(), Counter()
    for samples, _, log_z in sample([text] * n, [str(i).encode() for i in range(n)], k):
        assert abs(log_z - z) < 1e-9
        first[tuple(samples[0][0])] += 1
        for ids, log_p, _ in samples:
            member[tuple(ids)] += 1
            assert abs(np.exp(log_p) - p[tuple(ids)]) < 1e-9
    for q, x in p.items():
        assert abs(first[q] / n - x) < 5 * math.sqrt(x * (1 - x) / n) + 1e-3
    rng = np.random.default_rng(0)
    names, lp, want = list(p), np.log(list(p.values())), Counter()
    for _ in range(n):
        for j in np.argsort(-(lp - np.log(-np.log(rng.random(len(lp))))))[:k]:
            want[names[j]] += 1
    assert all(abs(member[q] - want[q]) / n < 0.02 for q in p)


def test_samples_need_only_the_key():
    a = sample(["some words here"], [b"7"], 4)[0]
    b = sample(["other", "some words here", ""], [b"1", b"7", b"2"], 4)[1]
    assert all((x[0] == y[0]).all() and abs(x[2] - y[2]) < 1e-9 for x, y in zip(a[0], b[0]))


# 8
def test_mix(docs, odd):
    from polislake.llm.mixing import identity, mix_plan, mixed, training_order

    for df in (docs, odd):
        plan = mix_plan(df)
        of = {}
        for r in df.select("doc_id", "source", identity(df).alias("row")).collect():
            of[r["row"]] = r["source"]
        rows = [r.asDict(recursive=False) | {"source": of[r["row"]]} for r in plan.collect()]
        assert len(rows) == df.count()
        by, sizes = {}, {}
        for r in rows:
            by[r["source"]] = by.get(r["source"], 0) + r["taken"]
            sizes[r["source"]] = (r["source_size"], r["target"])
            assert 0 <= r["taken"] <= 2 * r["size"]
            assert sum(c["words"] for c in r["copies"]) == r["taken"]
            assert all(0 <= c["position"] <= 1 for c in r["copies"])
        for s, (size, target) in sizes.items():
            assert target <= 2 * size + 1e-9
            assert abs(by[s] - target) <= 1
        total = sum(x for x, _ in sizes.values())
        assert abs(sum(t for _, t in sizes.values()) - 1.5 * total) < 1e-6 * total + 1e-6
    order = [r["position"] for r in training_order(mix_plan(docs)).collect()]
    assert order == sorted(order)
    out = mixed(odd)
    assert out.columns == odd.columns
    # Whole documents: as often as the plan says, and with all columns of one row.
    whole = {tuple(r["row"]): len(r["copies"]) for r in mix_plan(odd, split_boundary=False).groupBy("row").agg(F.flatten(F.collect_list("copies")).alias("copies")).collect()}
    got = Counter(tuple(r["row"]) for r in out.select(identity(out).alias("row")).collect())
    assert got == Counter({k: n for k, n in whole.items() if n}) and sum(got.values()) > 0
    assert mix_plan(odd.limit(0)).count() == 0 and mixed(odd.limit(0)).count() == 0


# 9
PRIVATE = [
    "mail éch.12@mail7.example.com, x", "ip 152.143.123.131. and 999.1.1.1", "call +1 (743) 555-3824 ok", "card 4111111111111111!! 4111-1111-1111-1111", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###',
    "born 1985-03-12 or 31/12/1999 or 1985-13-12", "ssn 123-45-6789 bad 000-12-1234", "Version 2.0. BY-NC 4.0. 4316522678525457", None, "", "no digits", "again 4111111111111111 (743) 555-3824", "iban DE89370400440532013000, DE89 3704 0044 0532 0130 00 and DE88370400440532013000", "born 12 March 1985 or March 12, 1985 not 31 June 1985", "4111111111111111 12/25",
]


def test_pseudonyms(spark):
    from polislake.llm.pii import pseudonymize

    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(PRIVATE)], "doc_id long, text string, pseudonymized string")
    got = {r["doc_id"]: (r["text"], r["n"]) for r in pseudonymize(df, "k", count="n").collect()}
    assert [got[i][1] for i in range(len(PRIVATE))] == [1, 1, 1, 2, 1, 2, 1, 0, 0, 0, 0, 2, 2, 2, 1]
    for i in (7, 8, 9, 10):
        assert got[i][0] == PRIVATE[i]
    for i, t in enumerate(PRIVATE):
        if t:
            assert len(got[i][0].split(" ")) == len(t.split(" "))
    for secret in ("éch.12", "152.143.123.131", "555-3824", "4111111111111111", "24be64439e3e", "1985-03-12", "123-45-6789", "DE893704", "12 March 1985", "March 12, 1985"):
        assert not any(secret in (x or "") for x, _ in got.values())
    assert "999.1.1.1" in got[1][0] and "1985-13-12" in got[5][0] and "000-12-1234" in got[6][0]
    iban = got[12][0].split(" ")
    assert iban[1][:-1] == "".join(iban[2:8]) and int("".join(str(int(c, 36)) for c in iban[1][4:-1] + iban[1][:4])) % 97 == 1
    assert "DE88370400440532013000" in got[12][0] and "31 June 1985" in got[13][0]
    card = got[3][0].split(" ")[1][:16]
    assert card in got[11][0] and got[3][0].split(" ")[2].replace("-", "") == card
    assert got[2][0].split("(")[1] == got[11][0].split("(")[1] + " ok"
    letters = f'api_key: "{"abcdef" * 6}" here'  # a secret without a digit
    assert [r["n"] for r in pseudonymize(spark.createDataFrame([(letters,)], "text string"), "k", count="n").collect()] == [1]
    other = {r["doc_id"]: r["text"] for r in pseudonymize(df, "another key").collect()}
    assert other[3] != got[3][0]
    assert pseudonymize(df.limit(0), "k").count() == 0


def by_hand(text, key):
    """Pseudonyms value by value, without Spark."""
    import datetime

    from polislake.llm import pii as P

    def number(*parts):
        return int(hashlib.sha256("|".join(map(str, (key, *parts))).encode()).hexdigest()[:15], 16)

    def feistel(kind, v, m):
        half, n = len(v) // 2, len(v)
        left, right = v[:half], v[half:]
        for turn in range(1, P.ROUNDS // 2 + 1):
            left = [(x + number(kind, "l", turn, n, ",".join(map(str, right)), i)) % m[i] for i, x in enumerate(left)]
            right = [(x + number(kind, "r", turn, n, ",".join(map(str, left)), i)) % m[half + i] for i, x in enumerate(right)]
        return left + right

    def permute(kind, t, alphabet):
        a = [alphabet(c, i) for i, c in enumerate(t)]
        new = iter(feistel(kind, [x.index(c) for c, x in zip(t, a) if x], [len(x) for x in a if x]))
        return "".join(x[next(new)] if x else c for c, x in zip(t, a))

    usual = lambda c, i: next((a for a in (P.DIGITS, P.LOWER, P.UPPER, P.LATIN_LOWER, P.LATIN_UPPER) if c in a), "")
    digit = lambda c: P.DIGITS if c in P.DIGITS else ""
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    months = "January February March April May June July August September October November December".split()
    mod97 = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    only = lambda t: "".join(c for c in t if c in P.DIGITS)

    def moved(y, m, d, write, old):
        try:
            n = (datetime.date(int(y), int(m), int(d)) - datetime.date(1800, 1, 1)).days
        except ValueError:
            return old
        if not 0 <= n < 189 * 773:
            return old
        a, b = feistel("date", [n // 773, n % 773], [189, 773])
        return write(datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 773 + b))

    def new(match):
        kind, t = match.lastgroup, match.group()
        if kind == "email":
            name, _, domain = t.partition("@")
            return permute("email", name, usual) + "@" + domain
        if kind == "secret":
            before, value, _ = t.split('"')
            if re.search("[A-F]", value) and re.search("[a-f]", value):
                value = value.lower()
            a = P.HEX_UPPER if re.search("[A-F]", value) else P.HEX
            return f'{before}"{permute("secret", value, lambda c, i: a)}"'
        if kind == "ip":
            o = list(map(int, t.split(".")))
            return ".".join(map(str, feistel("ip", o, [256] * 4))) if max(o) < 256 else t
        if kind == "iso":
            return moved(*t.split("-"), lambda d: d.isoformat(), t)
        if kind == "dmy":
            d, m, y = re.split(r"[./]", t)
            mark, two = re.search(r"[./]", t)[0], len(d) == 2
            return moved(y, m, d, lambda x: mark.join([f"{x.day:02}" if two else str(x.day), f"{x.month:02}" if two else str(x.month), f"{x.year:04}"]), t)
        if kind == "written":
            if t[0].isdigit():
                d, m, y = t.split(" ")
                return moved(y, months.index(m) + 1, d, lambda x: f"{x.day} {months[x.month - 1]} {x.year:04}", t)
            m, d, y = t.replace(",", "").split(" ")
            return moved(y, months.index(m) + 1, d, lambda x: f"{months[x.month - 1]} {x.day}, {x.year:04}", t)
        if kind == "ssn":
            a, b, c = map(int, t.split("-"))
            if not (0 < a < 900 and a != 666 and b and c):
                return t
            a, b, c = feistel("ssn", [a - 2 if a > 666 else a - 1, b - 1, c - 1], [898, 99, 9999])
            return f"{a + 2 if a >= 665 else a + 1:03}-{b + 1:02}-{c + 1:04}"
        if kind == "phone":
            n = len(only(t))

            def alphabet(c, i):
                place = len(only(t[:i])) - (n - 10)
                return "" if not digit(c) or place < 0 else ("23456789" if c >= "2" else "01") if place in (0, 3) else P.DIGITS

            return permute("phone", t, alphabet)
        if kind == "iban":
            plain = t.replace(" ", "")
            if mod97(plain[4:] + plain[:4]) != 1:
                return t
            body = permute("iban", t[4:], usual)
            return f"{t[:2]}{98 - mod97(body.replace(' ', '') + t[:2] + '00'):02}{body}"
        if not luhn(only(t)):
            return t
        body = permute("card", t[:-1], lambda c, i: digit(c) if i else "")
        return body + next(d for d in P.DIGITS if luhn(only(body) + d))

    return regex.sub("|".join(f"(?P<{k}>{p})" for k, p in P.PATTERNS.items()), new, text)


def test_pseudonyms_by_hand(spark, docs):
    from polislake.llm.pii import pseudonymize

    rows = [(i, t) for i, t in enumerate(PRIVATE)] + [(1000 + i, r["text"]) for i, r in enumerate(docs.select("text").collect())]
    got = {r["doc_id"]: r["text"] for r in pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    want = {i: None if t is None else by_hand(t, "k") for i, t in rows}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert sum(t != want[i] for i, t in rows) > 20


def test_feistel_is_a_bijection(spark):
    from polislake.llm.pii import feistel

    for sizes in ((10, 10), (3, 7), (2, 3, 5), (6,)):
        total = math.prod(sizes)
        values, rest = [], F.col("id")
        for s in reversed(sizes):
            values.insert(0, (rest % s).cast("long"))
            rest = F.floor(rest / s)
        df = spark.range(total).select(feistel("key", "t", F.array(*values), F.array(*[F.lit(s).cast("long") for s in sizes])).alias("v"))
        assert len({tuple(r["v"]) for r in df.collect()}) == total


# 10
def components(rows, n, percent):
    sets = {}
    for at, (_, t) in enumerate(rows):
        w = t.encode().lower().split()
        sets[at] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    inverted = {}
    for i, s in sets.items():
        seen = Counter(j for x in s for j in inverted.get(x, ()))
        for x in s:
            inverted.setdefault(x, []).append(i)
        for j, c in seen.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[find(i)] = find(j)
    least = {}
    for i in sets:
        d = rows[i][0]
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(rows[i][0], len(s), least.get(find(i)) if s else rows[i][0]) for i, s in sets.items()]


@pytest.mark.parametrize(("name", "options"), [("docs", {}), ("odd", {}), ("docs", {"shingle": 5, "percent": 80}), ("docs", {"slice_elements": 500, "percent": 50})])
def test_jaccard(name, options, request):
    from polislake.llm.jaccard_join import jaccard_components

    df = request.getfixturevalue(name)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df, **options).collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(components(rows_of(df), options.get("shingle", 4), options.get("percent", 85)), key=key)


def test_near_copies_in_slices(spark):
    from polislake.llm import jaccard_join as J

    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.integers(0, 120, 2):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, J.GROUP_SLICE = J.GROUP_SLICE, 40
    try:
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df, slice_elements=5000).collect())
    finally:
        J.GROUP_SLICE = old
    assert got == sorted(components(rows, 4, 85))


def test_divide_skip_merge():
    from polislake.llm.jaccard_join import merge_counts

    for lists in ([np.array([1, 4, 6]), np.array([4]), np.array([0, 4, 6])], [np.arange(40), np.arange(0, 40, 2)], []):
        members, counts = merge_counts(lists)
        want = Counter(int(x) for a in lists for x in a)
        assert dict(zip(members.tolist(), counts.tolist())) == dict(want)


def test_components(spark):
    from polislake.llm._graph import components as connected

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (300, 100), (7, 7)] + [(1000, i) for i in range(1001, 1100)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == 100 and all(got[i] == 1000 for i in range(1001, 1100))


def test_keep_one(docs, odd):
    from polislake.llm.jaccard_join import jaccard_components, keep_one

    kept = keep_one(docs)
    assert kept.columns == docs.columns
    classes = {r["component_id"] for r in jaccard_components(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)
    assert keep_one(odd).columns == odd.columns
    assert keep_one(odd.limit(0)).count() == 0 and jaccard_components(odd.limit(0)).count() == 0


# The pipeline
def test_pipeline(spark, sf, docs):
    import corpus_pipeline as P
    from polislake.llm._store import materialize
    from polislake.llm.mixing import mix_plan, training_order

    # Some documents get a secret and a phone number: not every small table has them.
    private_words = F.concat(F.lit(' token = "'), F.sha2(F.col("doc_id").cast("string"), 256), F.lit('" and +1 (212) 555-'), F.lpad((F.col("doc_id") % 9000 + 1000).cast("string"), 4, "0"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", private_words)).otherwise(F.col("text"))).persist()
    state = docs
    seen = []
    before_mix = None
    for name, stage in P.STAGES[:-1]:
        before_mix = state
        after = materialize(stage(spark, state, sf), "test-stage")
        assert after.columns == docs.columns, name
        seen.append({r["doc_id"] for r in after.select("doc_id").collect()})
        state = after
    assert len(P.STAGES) == 5 and all(b <= a for a, b in zip(seen, seen[1:]))
    assert len(seen[0]) >= 0.95 * docs.count()
    assert seen[1] == {i for i, _, c in components([(r["doc_id"], r["text"]) for r in docs.where(F.col("doc_id").isin(list(seen[0]))).collect()], 5, 80) if i == c}
    from polislake.llm.pii import PATTERNS

    private = lambda df, kind: {m for (t,) in df.select("text").collect() for m in regex.findall(PATTERNS[kind], t)}
    for kind in ("phone", "secret"):  # the values that the documents had are gone
        assert private(docs, kind) and not private(docs, kind) & private(state, kind)
    last = materialize(P.STAGES[-1][1](spark, state, sf), "test-stage")
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == seen[3]
    # The mix's order, through two writes and reads; each copy has samples of its own.
    order = [r["doc_id"] for r in training_order(mix_plan(before_mix, split_boundary=False)).select("doc_id").collect()]
    rows = last.orderBy("position", "sample_rank").collect()
    places = dict.fromkeys((r["position"], r["doc_id"]) for r in rows)
    assert list(places) == list(enumerate(order)) and len(order) > len(set(order))
    samples = {}
    for r in rows:
        samples.setdefault((r["doc_id"], r["position"]), []).append(tuple(r["ids"]))
    twice = [[v for (j, _), v in samples.items() if j == i] for i in {i for i in order if order.count(i) > 1}]
    assert sum(a != b for a, b in twice) > 0.9 * len(twice)


def test_positions_read_back(spark, tmp_path):
    from polislake.llm.mixing import read_positions

    df = spark.range(0, 1000, numPartitions=5).selectExpr("id", "repeat('x', CAST(1000 - id AS INT)) AS text", "1 AS position")
    df.write.option("maxRecordsPerFile", 70).parquet(f"{tmp_path}/t")
    got = read_positions(spark.read.parquet(f"{tmp_path}/t"))
    assert got.columns == ["id", "text", "position", "position_"] and got.where("id <> position_ OR position <> 1").count() == 0 and got.count() == 1000
    assert {r["place"] for r in read_positions(spark.range(3), "place").collect()} == {None}


def test_pipeline_stages_on_awkward_rows(spark, sf, odd):
    import corpus_pipeline as P

    for df in (odd, odd.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, df, sf)
            ids = {r["doc_id"] for r in out.collect()}
            assert ids <= {r["doc_id"] for r in df.select("doc_id").collect()}, name
            assert bool(ids) == bool(df.count()) or name == P.STAGES[0][0], name
            if name != P.STAGES[-1][0]:
                assert out.columns == odd.columns
