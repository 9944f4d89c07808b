"""Periodic runs, hard negatives and WARC archives against brute-force versions."""

import base64
import glob
import gzip
import hashlib
import io
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import archives, hard_negatives, periodic


# ---- periodic runs

def brute_runs(words):
    """Every longest stretch per period; of stretches with equal ends, the smallest period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def cyclic_texts():
    rng = random.Random(7)
    out = []
    for _ in range(150):
        kinds, words = rng.choice([1, 2, 3, 12]), []
        while len(words) < rng.choice([0, 6, 40, 300]):
            cycle = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, rng.choice([2, 5, 40])))]
            words += (cycle * rng.randint(1, 8))[:rng.randint(1, 250)]
        out.append(" ".join(words))
    out += [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a\x0ba\x0ca\ra\ta a", "    " * 5, "x\x1cx x\x1cx " * 3]
    return out + [out[3], out[3], "a b " * 3 + "a", "a b " * 4, " ".join(["na"] * 3000), "one two three four five\n" * 400]


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    for size in (1, 2, 8, 64):
        x = rng.integers(0, periodic.PRIME, (3, size)).astype(np.uint64)
        assert (periodic.backward(periodic.forward(x)) == x).all()
        words = rng.integers(0, 3, 40 + 6 * size)
        starts = np.arange(0, 40 + 3 * size, 3)
        at, distance = periodic.copies(words, starts, size)
        want = [(s, d) for s in starts for d in range(size, 2 * size) if (words[s:s + size] == words[s + d:s + d + size]).all()]
        assert sorted(zip(at.tolist(), distance.tolist())) == sorted((int(s), d) for s, d in want)


def test_periodic_runs(spark):
    texts = cyclic_texts()
    rows = [(i, t, "kept", i) for i, t in enumerate(texts)] + [(None, texts[3], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, _words_of_ long").repartition(3)
    got = periodic.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "_words_of_", "n_words", "runs", "collapsed"]
    for r in got.collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        runs = brute_runs(words)
        assert [tuple(x) for x in r.runs] == runs, r.text
        assert (r.n_words, r.collapsed) == (len(words), brute_collapse(words, runs))
    assert got.count() == len(rows)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    assert periodic.periodic_runs(docs.select("text"), keep_text=False).columns == ["n_words", "runs", "collapsed"]


def test_runs_across_groups_of_texts():
    """Equal cycles that end one text and begin the next are no run together."""
    words, edges = periodic.split(pa.array(["a b a b a", "b a b a b", "a a a a a a"]))
    assert periodic.runs_together(words, edges) == [[], [], [(0, 6, 1)]]


# ---- hard negatives

def brute_negatives(rows, percent=80, count=5):
    usable = [
        (k, label, [math.floor(256 * x) for x in v]) for k, label, v in rows
        if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    unique = {(k, label, tuple(v)) for k, label, v in usable}
    out = []
    for k, label, v in unique:
        if k % 10:
            continue
        scored = [
            (-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, other == label)
            for j, other, w in unique if j != k and len(w) == len(v)
        ]
        for p, positive, _ in sorted(x for x in scored if x[2])[:count]:
            fit = sorted(x for x in scored if not x[2] and percent * -p <= 100 * -x[0] <= 100 * -p)
            out += [(k, positive, rank, j, -p, -n) for rank, (n, j, _) in enumerate(fit[:count], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, anchor string"


def mined(spark, rows):
    df = spark.createDataFrame([(k, v, label, "x") for k, label, v in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect())


def test_hard_negatives(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((4, 8))
    rows = [
        (i, int(rng.integers(0, 3)), (centres[i % 4] + 0.6 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(300)
    ]
    same = rows[0][2]
    rows += [(i, i % 3, same) for i in range(300, 340)]  # a group of copies: ties by id
    rows += [(400, 0, None), (410, None, same), (420, 0, [None] + same[1:]), (430, 0, [math.nan] + same[1:]), (440, 1, [math.inf] + same[1:])]
    rows += [(450, 0, [0.0] * 8), (460, 0, [0.0] * 8), (461, 1, [0.0] * 8), (None, 0, same), rows[0], rows[310], rows[310]]
    rows += [(470, 0, []), (471, 0, []), (472, 1, []), (480, 0, same[:3]), (481, 0, same[:3]), (482, 1, same[:3])]
    rows += [(490, 5, [-x for x in same]), (491, 5, same)]  # a negative score is no positive's window
    want = brute_negatives(rows)
    assert len(want) > 300
    assert mined(spark, rows) == want


def test_hard_negatives_beyond_double_precision(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, (rng.standard_normal(4) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(60)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []


def test_windows_hold_every_row_in_bounds():
    rng = np.random.default_rng(8)
    x, a = (np.floor(256 * rng.standard_normal((n, 3))) for n in (500, 40))
    (u, norms), (v, lengths) = hard_negatives.unit(x), hard_negatives.unit(a)
    direction = v[0]
    along, angle = np.arccos(np.clip(u @ direction, -1, 1)), np.arccos(np.clip(v @ direction, -1, 1))
    order = np.argsort(along)
    got = hard_negatives.scores(a, x[order], 0.0)
    least = np.quantile(got, 0.9, axis=1).astype(np.int64)
    most = np.quantile(got, 0.95, axis=1).astype(np.int64)
    begin, end = hard_negatives.windows(angle, lengths, least, most, along[order], norms.min(), norms.max())
    place = np.arange(len(x))
    inside = (place >= begin[:, None]) & (place < end[:, None])
    assert not ((got >= least[:, None]) & (got <= most[:, None]) & ~inside).any()
    assert inside.mean() < 0.9  # and they leave some out


# ---- archives

PAGES = "page_id long, url string, html string, digest string"


def pages():
    rng = random.Random(2)
    shared = "<p>shared</p>" * 20
    rows = [(i, f"http://h/{i}", "".join(chr(rng.randrange(32, 1200)) for _ in range(rng.randint(1, 3000))), "x") for i in range(60)]
    rows += [(60 + i, "http://s", shared, None) for i in range(40)]  # a hot payload
    rows += [(200, None, None, None), (201, "a b\r\nX: y%é", "", "x"), (None, "u", shared, "x"), (None, "u", "only null ids", "x")]
    return rows + [(203, "u", "twice", "x"), (203, "u", "twice", "x"), (202, "u", "twice", "x"), (204, "big", "é" * (9 << 20), "x")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "all")
    df = spark.createDataFrame(pages(), PAGES).repartition(3)
    archives.write_archives(df, path, "page_id", "url", "html", prefix="page")
    return path


def facts(df):
    rows = df.select(
        archives.key_of("record_id", "page").cast("long").alias("id"), "payload_bytes", "payload_digest", "record_type",
        archives.key_of("refers_to", "page").cast("long").alias("to"), "problem",
    )
    return sorted(map(tuple, rows.collect()), key=str)


def wanted():
    rows, out = pages(), []
    for key, _, html, _ in rows:
        ids = [k for k, _, h, _ in rows if (h or "") == (html or "") and k is not None]
        first = max(ids, default=None)
        revisit = first is not None and key != first
        size = len((html or "").encode())
        out.append((key, size, digest(html), "revisit" if revisit else "response", first if revisit else None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "20k", "700b"])
def test_archives_come_back_from_ranges_of_any_size(spark, written, split):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = archives.read_archives(spark, written)
        assert facts(found) == wanted()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    by_id = {r.record_id: r for r in found.where("record_type = 'response'").collect()}
    for key, url, html, _ in pages():
        if (row := by_id.get(archives.urn("page", key))) and key is not None and key < 60:
            assert bytes(row.payload).decode() == html and row.target_uri == url
    odd = found.where(F.col("record_id") == archives.urn("page", 201)).first()
    assert odd.target_uri == "a%20b%0D%0AX:%20y%25é" and odd.headers["warc-date"] == "1970-01-01T00:00:00Z"


def test_archives_are_plain_gzip_members(written):
    """Another reader of concatenated members sees the same records."""
    count = 0
    for file in glob.glob(f"{written}/part-*"):
        raw = gzip.open(file).read()
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            size = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size:size + 4] == b"\r\n\r\n"
            raw, count = rest[size + 4:], count + 1
    assert count == len(pages())


def test_least_size_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "longer one"), (4, "u", "longer one")], "id long, url string, payload string")
    archives.write_archives(df, f"{tmp_path}/a", least=5, prefix="page")
    assert [(r[0], r[3]) for r in facts(archives.read_archives(spark, f"{tmp_path}/a"))] == [
        (1, "response"), (2, "response"), (3, "revisit"), (4, "response")
    ]
    archives.write_archives(df.limit(0), f"{tmp_path}/b")
    assert archives.read_archives(spark, f"{tmp_path}/b").count() == 0


def raw_record(key, payload):
    return archives.record(key, "u", payload, hashlib.sha1(payload).hexdigest(), None, "page", "d")


def stored(raw):
    """A member that keeps its bytes as they are."""
    out = zlib.compressobj(0, wbits=archives.GZIP)
    return out.compress(raw) + out.flush()


def read_file(spark, path, data, split="128m"):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(data)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        return archives.read_archives(spark, str(path.parent)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("split", ["128m", "3k", "500b"])
@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_magic_inside_members(spark, tmp_path, name, split):
    """By chance, and whole archives inside an archive, in ranges smaller than a member."""
    rng = random.Random(1)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    inner = b"".join(stored(raw_record(f"inner{i}", noise(200))) for i in range(8))
    bodies = [noise(900) + archives.MAGIC + noise(900) + archives.MAGIC * 3 + noise(4000), inner, noise(10), inner + archives.MAGIC, b""] * 3
    data = b"".join(stored(raw_record(i, b)) for i, b in enumerate(bodies))
    got = read_file(spark, tmp_path / f"{name}-{split}" / name, data, split)
    assert sorted((r.record_id, bytes(r.payload), r.problem) for r in got) == sorted(
        (archives.urn("page", i), b, None) for i, b in enumerate(bodies)
    )


def test_damaged_archives(spark, tmp_path):
    good = [archives.member(raw_record(i, bytes([65 + i]) * 500)) for i in range(4)]
    cut = good[1][:-20]
    got = read_file(spark, tmp_path / "cut" / "x", good[0] + cut + good[2] + good[3][:-9])
    assert sorted((r.record_id or "", r.problem or "") for r in got) == [
        ("", "damaged"), ("", "damaged"), ("<urn:page:0>", ""), ("<urn:page:2>", "")
    ]
    wrong = archives.record(7, "u", b"abc", "00" * 20, None, "page", "d")
    short = wrong.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    got = read_file(spark, tmp_path / "odd" / "x", b"no member" + archives.member(wrong) + archives.member(short) + archives.member(b"WARC/1.0"))
    assert sorted(r.problem for r in got) == ["digest", "header", "length", "stray"]
    assert gzip.GzipFile(fileobj=io.BytesIO(good[0])).read().startswith(b"WARC/1.1")
