"""Exact dedup, ball k-means and the source divergence audit against brute force, on real rows and on awkward ones."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, h string, Row int, sha string, id string, part string, n long"


def awkward():
    long = " ".join(f"wort{i % 700} straße" for i in range(20_000))
    texts = [None, "", " ", "one two", "one two", "One two", "one two ", long, long, "a\x00b \x01 c", "😀 déjà vu 中文 текст x1y", "1234 ...", "tail", None, "naïve NAÏVE naive", "one two\n"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None, "a\x00b"][i % 5], "h", 1, "s", "i", "p", 2) for i, t in enumerate(texts)]
    rows += [(100 + i, "hot text of many rows", ["en", "de"][i % 2], f"s{i % 3}", *rows[0][4:]) for i in range(40)]
    rows += [(None, "one two", "en", "s1", *rows[0][4:]), (None, "only null ids", "en", "s1", *rows[0][4:]), (None, "only null ids", "en", "s1", *rows[0][4:])]
    return rows + [rows[6], rows[6], (6, "another text of the same id", "", "", *rows[0][4:])]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").persist()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).persist()


# 13
def copies(rows, best=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = best((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        for i in ids:
            want[i, keep, len(ids), False, digest] += 1
        want[keep, keep, len(ids), False, digest] -= 1
        want[keep, keep, len(ids), True, digest] += 1
    return +want


@pytest.mark.parametrize("name", ["docs", "odd"])
@pytest.mark.parametrize("digest", [None, lambda t: F.unhex(F.hex(F.length(t) % 3)), lambda t: F.lit(b"same")])
def test_exact_copies(name, digest, request):
    from polislake.llm.exact_dedup import content_hash, drop_exact_copies, exact_copies

    df = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = exact_copies(df, digest=digest or content_hash)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == copies(rows)
    kept = drop_exact_copies(df, digest=digest or content_hash)
    assert kept.columns == df.columns
    stays = [(k[0], k[4]) for k, n in copies(rows).items() if k[3]]
    assert sorted(map(str, stays)) == sorted(str((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest())) for r in kept.collect())


def test_exact_copies_options(odd):
    from polislake.llm.exact_dedup import drop_exact_copies, exact_copies

    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(map(tuple, exact_copies(odd, keep="smallest").collect())) == copies(rows, min)
    trimmed = exact_copies(odd, normal=lambda t: F.lower(F.trim(t))).collect()
    assert Counter(map(tuple, trimmed)) == copies([(i, (t or "").strip(" ").lower()) for i, t in rows])
    none = odd.limit(0)
    assert exact_copies(none).count() == 0 and drop_exact_copies(none).columns == odd.columns


def test_exact_dedup_is_native():
    import polislake.llm.exact_dedup as m

    source = open(m.__file__).read()
    assert not re.search(r"udf|pandas|mapIn|applyIn|rdd|arrow", source, re.I)


# 11
def lloyd(vectors, k=8, rounds=10, dim=64, scale=1024):
    """Plain rounds over (id, components), in whole numbers of Python."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found)


def odd_vectors(n, dim, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, dim) / 2 + 0.0004]) for i in range(n)]
    rows += [rows[3], rows[3], (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), (900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [1.0] * (dim + 1))]
    rows += [(904 + i, [0.5] * (dim - 1) + [x]) for i, x in enumerate((None, float("nan"), float("inf"), -float("inf")))]
    return rows


@pytest.mark.parametrize("n", [300, 5, 1])
def test_ball_kmeans(spark, n):
    from polislake.llm.ball_kmeans import ball_kmeans

    rows = odd_vectors(max(n, 8), 4) if n > 5 else odd_vectors(8, 4)[:n]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    got = ball_kmeans(df, dim=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == lloyd(rows, dim=4)
    assert ball_kmeans(df.where("false"), dim=4).count() == 0


def test_ball_kmeans_of_the_tables(spark, sf):
    from polislake.llm.ball_kmeans import ball_kmeans

    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert Counter(map(tuple, ball_kmeans(df).collect())) == lloyd([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_balls_spare_distances():
    from polislake.llm.ball_kmeans import ball_assign

    rng = np.random.default_rng(1)
    centroids = rng.integers(-400, 400, (12, 6))
    x = (centroids[rng.integers(0, 12, 4000)] + rng.integers(-90, 90, (4000, 6))).astype(np.int64)
    all_of = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    want = all_of.argmin(1)
    for own in (want, rng.integers(0, 12, 4000), np.zeros(4000, np.int64)):  # any assignment to start from
        nearest, distance, computed = ball_assign(x, own, centroids)
        assert (nearest == want).all() and (distance == all_of.min(1)).all()
    assert ball_assign(x, want, centroids)[2] < 0.35 * all_of.size
    tie = np.array([[0, 0], [4, 0], [2, 0]], np.int64)  # equally far from both: the smaller number
    assert ball_assign(tie, np.array([1, 1, 1]), np.array([[4, 0], [0, 0]]))[0].tolist() == [1, 0, 0]


def test_large_components_are_refused(spark):
    from polislake.llm.ball_kmeans import ball_kmeans

    with pytest.raises(Exception, match="would not fit 64 bits"):
        ball_kmeans(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


# 12
def audit(rows, least=3, most=200):
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups, docs, everywhere = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = Counter(w.translate(low) for w in pattern.findall(text or ""))
        groups[lang or "", source or ""].update(terms)
        everywhere[lang or ""].update(terms)
        docs[lang or ""].update(set(terms))
    kept = {lang: {w for w, n in c.items() if n >= least} for lang, c in docs.items()}
    share = lambda count, total, v: 1 + 10**9 * (count + 1) // (total + v)
    want = Counter()

    def rank(key, part, values, limit):
        values.sort(key=lambda x: (-x[1], x[0].encode()))
        for k, (item, value) in enumerate(values[:limit], 1):
            want[(*key, part, item, value, k)] += 1

    p = {}
    for (lang, source), c in groups.items():
        words = kept.get(lang, set())
        n = sum(c[w] for w in words)
        p[lang, source] = {w: share(c[w], n, len(words)) for w in words}
    for (lang, source), c in groups.items():
        words = kept.get(lang, set())
        n = sum(everywhere[lang][w] for w in words)
        mine = p[lang, source]
        others = [(s, sum((mine[w] - q[w]) ** 2 // q[w] for w in words)) for (x, s), q in p.items() if x == lang and s != source]
        rank((lang, source), "pair", others, None)
        q = {w: share(everywhere[lang][w], n, len(words)) for w in words}
        rank((lang, source), "term", [(w, (mine[w] - q[w]) ** 2 // q[w]) for w in words if c[w] > 0 and mine[w] > q[w]], most)
    return want


@pytest.mark.parametrize("name", ["docs", "odd"])
@pytest.mark.parametrize("weak", [False, True])
def test_source_divergence(name, weak, request, monkeypatch):
    import polislake.llm.divergence as D

    df = request.getfixturevalue(name)
    options = {"hashes": lambda data, start, end: D.xxh64(data, start, end) & np.uint64(0x30F00000)} if weak else {}
    if weak:
        monkeypatch.setattr(D, "BROADCAST", -1)  # totals joined by language and bucket
        monkeypatch.setattr(D, "FLUSH", 100)
    got = D.source_divergence(df.repartition(3), **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == audit([(r["text"], r["lang"], r["source"]) for r in df.collect()])


def test_source_divergence_empty(odd):
    from polislake.llm.divergence import source_divergence

    assert source_divergence(odd.limit(0)).count() == 0
    rare = odd.where("doc_id < 3").withColumn("text", F.col("doc_id").cast("string"))  # no term anywhere, two sources in a language
    assert all(r["value"] == 0 and r["part"] == "pair" for r in source_divergence(rare.withColumn("lang", F.lit("en"))).collect())


def test_xxh64_and_slices():
    from polislake.llm.divergence import distinct_slices, term_slices, xxh64

    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in [*range(70), *rng.integers(0, 40, 300)]] * 2
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    start = ends - [len(w) for w in words]
    assert xxh64(data, start, ends).tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    for hashes in (xxh64, lambda d, s, e: xxh64(d, s, e) & np.uint64(1), lambda d, s, e: np.zeros(len(s), np.uint64)):
        number, first, h = distinct_slices(data, start, ends, hashes)
        assert len(first) == len(h) == len(set(words)) and all((number[i] == number[words.index(w)]) and words[first[number[i]]] == w for i, w in enumerate(words))
    texts = ["Ab1c dé", "", "f", "g h", "7", "中i_j", ""]
    raw = [t.encode() for t in texts]
    s, e = term_slices(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    whole = b"".join(raw)
    assert [whole[a:b].decode() for a, b in zip(s, e)] == ["Ab", "c", "dé", "f", "g", "h", "中i", "j"]


def test_shares_are_exact():
    from polislake.llm.divergence import divergences, departure, share

    count, total = [0, 1, 10**12, 5 * 10**15, 7], [1, 3, 10**12 + 7, 9 * 10**15, 8]
    assert share(np.array(count), np.array(total)).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count, total)]
    rng = np.random.default_rng(4)
    dense = rng.integers(0, 3, (50, 6)) * rng.integers(0, 2, (50, 6))
    dense[:, 2] = 0  # a source without cells
    none = rng.integers(1, 40, 6)
    p = np.where(dense > 0, dense * 100 + 7, none)
    t, s = np.nonzero(dense)
    got = divergences(50, t, s, p[t, s], none)
    assert got.tolist() == [[sum(int(departure(p[w, a], p[w, b])) for w in range(50)) for b in range(6)] for a in range(6)]
