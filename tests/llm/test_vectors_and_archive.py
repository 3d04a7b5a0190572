"""Clustering and compression of vectors against plain loops, and the archive against its records' bytes."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import centroid_tree as T
from tallyloom.llm import dual_tree as D
from tallyloom.llm import warc_archive as A

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, n long"
PAGES = "page_id long, url string, html string, digest string, row long"


def ints(x):
    return [int(np.floor(256 * float(np.float32(c)))) for c in x]


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def whole(x):
    return x is not None and all(c is not None and np.isfinite(c) for c in x)


def made(n, dim, seed, groups=4):
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-0.4, 0.4) for _ in range(dim)] for _ in range(groups)]
    return [[m + rnd.gauss(0, 0.05) for m in rnd.choice(middles)] for _ in range(n)]


def plain_clusters(rows, k, rounds, dim, salt):
    kept = [(i, ints(x)) for i, x in rows if whole(x) and len(x) == dim]
    name = lambda i: hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest()
    middles = [x for _, x in sorted((name(i), x) for i, x in kept)[:k]]
    for turn in range(rounds + 1):
        near = [min((gap(x, c), j) for j, c in enumerate(middles)) for _, x in kept]
        if turn < rounds:
            for j in range(len(middles)):
                own = [x for (_, x), (_, c) in zip(kept, near) if c == j]
                if own:
                    middles[j] = [sum(v) // len(own) for v in zip(*own)]
    total = sum(d for d, _ in near) if kept else 0
    per = {j: sum(d for d, c in near if c == j) for j in range(len(middles))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return sorted(((i, c, d, per[c], total, sha[c]) for (i, _), (d, c) in zip(kept, near)), key=str)


def odd_vectors(dim):
    good = made(60, dim, 1)
    rows = [(i, x) for i, x in enumerate(good)]
    rows += [(7, good[7]), (7, good[8]), (None, good[9]), (100, None), (101, [float("nan")] * dim), (102, [float("inf")] + good[0][1:]), (103, [None] + good[0][1:])]
    rows += [(104, good[0][: dim - 4]), (105, []), (106, [0.0] * dim), (107, [0.0] * dim)] + [(200 + i, good[3]) for i in range(40)]
    return rows


def frame(spark, rows, labels=None):
    return spark.createDataFrame([(i, x, None if i is None else i % 3 if labels is None else labels, 5, 6) for i, x in rows], VECTORS)


@pytest.mark.parametrize("k, rounds", [(9, 3), (500, 1), (1, 2)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rows = odd_vectors(8)
    got = T.cluster_vectors(frame(spark, rows).repartition(5), k, rounds, 8).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows, k, rounds, 8, "2:")


def test_clusters_of_nothing(spark):
    empty = T.cluster_vectors(frame(spark, []), 4, 2, 8)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert T.cluster_vectors(frame(spark, [(1, None), (2, [])]), 4, 2, 8).count() == 0


def test_a_component_no_long_can_hold(spark):
    with pytest.raises(Exception, match="fit a long"):
        T.cluster_vectors(frame(spark, [(1, [3e38] * 8)]), 2, 1, 8).collect()


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_first_of_the_nearest_and_prunes(seed):
    rnd = np.random.default_rng(seed)
    middles = rnd.integers(-3, 4, (60, 3)) if seed % 2 else np.repeat(rnd.integers(-90, 90, (30, 3)), 2, axis=0)  # ties, equal centroids
    vectors = rnd.integers(-100, 100, (3000, 3)) if seed < 2 else rnd.integers(-4, 5, (3000, 3))
    number, distance, work = T.VantageTree(middles).nearest(vectors, block=700)
    far = ((vectors[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (number == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    if seed == 0:  # vectors far from most centroids
        assert work < far.size / 2


def plain_codes(rows, parts, n, rounds, dim):
    kept = [(i, ints(x), len(x) == dim) for i, x in rows if whole(x)]
    cut = [(i, x) for i, x, fits in kept if fits]
    width = dim // parts
    piece = lambda x, p: x[p * width : (p + 1) * width]
    first = [x for _, _, x in sorted((i is None, i or 0, x) for i, x in cut)[:n]]
    books = [[piece(x, p) for x in first] for p in range(parts)]
    for turn in range(rounds + 1):
        near = [[min((gap(piece(x, p), b), j) for j, b in enumerate(books[p])) for p in range(parts)] for _, x in cut]
        if turn < rounds:
            for p in range(parts):
                for j in range(len(first)):
                    own = [piece(x, p) for (_, x), c in zip(cut, near) if c[p][1] == j]
                    if own:
                        books[p][j] = [sum(v) // len(own) for v in zip(*own)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    found = iter(near if cut else [])
    out = [(i, next(found) if fits else None) for i, _, fits in kept]
    return [(i, None if c is None else "".join(f"{j:02x}" for _, j in c), None if c is None else sum(d for d, _ in c)) for i, c in out], sha


@pytest.mark.parametrize("n, rounds, leaf", [(16, 2, 4), (64, 1, 2), (200, 2, 8)])
def test_codes_equal_plain_rounds(spark, n, rounds, leaf):
    rows = odd_vectors(8)
    got = D.compress_vectors(frame(spark, rows).repartition(4), 4, n, rounds, 8, leaf).collect()
    want, sha = plain_codes(rows, 4, n, rounds, 8)
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=str) == sorted(want, key=str)
    assert {r.codebooks_sha256 for r in got} == {sha}
    for r in got:
        assert r.label_error == sum(o.error or 0 for o in got if o.label == r.label)


def test_codes_of_nothing_and_without_labels(spark):
    assert D.compress_vectors(frame(spark, []), 4, 8, 1, 8).count() == 0
    assert D.compress_vectors(frame(spark, [(1, None)]), 4, 8, 1, 8).count() == 0
    alone = D.compress_vectors(frame(spark, [(1, [0.5] * 8), (2, [0.25] * 4)]).drop("label"), 4, 8, 1, 8).orderBy("vec_id").collect()
    assert [(r.code, r.error, r.label_error) for r in alone] == [("00000000", 0, 0), (None, None, 0)]


@pytest.mark.parametrize("seed", range(6))
def test_dual_tree_assigns_all_places_once(seed):
    rnd = np.random.default_rng(seed)
    spread = (2, 40, 4000)[seed % 3]
    points, entries = rnd.integers(-spread, spread, (1500, 4)), rnd.integers(-spread, spread, (64, 4))
    tree, book = D.PointTree(points, 8), D.EntryTree(entries)
    ranges, places, found, work = D.assign(tree, book)
    covered = np.concatenate([places, *(np.arange(a, b) for a, b, _ in ranges)])
    assert sorted(covered.tolist()) == list(range(1500))
    far = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (D.codes_of(points, book, 8) == far.argmin(axis=1)).all() and work < far.size
    counts, sums = D.sums_of(points, book, 64, 8)
    for j in range(64):
        own = points[far.argmin(axis=1) == j]
        assert counts[j] == len(own) and (sums[j] == own.sum(axis=0)).all()


def test_near_points_are_assigned_by_cached_sums():
    points = np.concatenate([np.tile(m, (500, 1)) for m in np.random.default_rng(0).integers(-900, 900, (6, 4))])
    ranges, places, _, work = D.assign(D.PointTree(points, 8), D.EntryTree(points[::500]))
    assert len(places) < 200 and sum(b - a for a, b, _ in ranges) > 2800 and work < 1000


def base32_digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def odd_pages():
    long = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 40000
    return [(3, "http://a/", "x"), (1, "http://b/", "x"), (2, None, "x"), (4, "http://c/\r\nX: 1", long), (5, "u", None), (6, "u", ""), (7, "u", "y"), (7, "u", "y"), (7, "v", "y"),
            (None, "w", "x"), (None, "w", "z"), (8, "u", long)]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "d", 3) for r in rows], PAGES)


@pytest.mark.parametrize("least", [0, 2])
def test_archive_gives_records_back(spark, least, tmp_path):
    rows = odd_pages()
    pages = pages_of(spark, rows).repartition(3)
    path = A.archive_pages(pages, str(tmp_path / "a"), least)
    back = A.read_records(spark, path).collect()
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    assert sorted((str(r.page_id), bytes(r.payload)) for r in back) == sorted((str(i), (html or "").encode()) for i, _, html in rows)
    responses = {}
    for r in back:
        payload, record = bytes(r.payload), bytes(r.record)
        head, http = r.header.encode().split(b"\r\n\r\n")[:2]
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        body = record[len(head) + 4 : -4]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(body)
        assert fields["WARC-Payload-Digest"] == "sha1:" + base32_digest(payload) and fields["WARC-Type"] == r.record_type and "X" not in fields
        assert body == http + b"\r\n\r\n" + (payload if r.record_type == "response" else b"")
        if r.record_type == "response":
            responses.setdefault(payload, []).append((r.page_id, fields["WARC-Record-ID"]))
        else:
            assert fields["WARC-Refers-To"] == f"<urn:page:{'' if r.refers_to is None else r.refers_to}:" + fields["WARC-Refers-To"].rsplit(":", 1)[1]
    assert len({x for v in responses.values() for _, x in v}) == sum(map(len, responses.values()))
    for payload, ids in groups.items():
        known = [i for i in ids if i is not None]
        if len(payload) >= least:
            assert [i for i, _ in responses[payload]] == [min(known) if known else None]
            assert {r.refers_to for r in back if bytes(r.payload) == payload and r.record_type == "revisit"} <= ({min(known)} if known else set())
        else:
            assert len(responses[payload]) == len(ids)
    assert spark.read.parquet(f"{path}/payloads").count() == len(groups)


def test_page_records_and_empty_table(spark):
    got = A.page_records(pages_of(spark, [(2, "u", "aé"), (1, "u", "aé"), (3, "u", None)])).orderBy("page_id").collect()
    sha = base32_digest("aé".encode())
    assert [tuple(r) for r in got] == [(1, 3, sha, "response", None), (2, 3, sha, "revisit", 1), (3, 0, base32_digest(b""), "response", None)]
    assert A.page_records(pages_of(spark, [])).count() == 0


def test_export_is_a_readable_archive(spark, tmp_path):
    rows = odd_pages()
    path = A.archive_pages(pages_of(spark, rows), str(tmp_path / "a"))
    A.export_warc(spark, path, str(tmp_path / "files"))
    records = []
    for file in (tmp_path / "files").glob("part-*"):
        data = file.read_bytes()
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            records.append(head + b"\r\n\r\n" + rest[: size + 4])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
    assert sorted(records) == sorted(bytes(r.record) for r in A.read_records(spark, path).collect())


def test_digests_are_verified(spark, tmp_path):
    weak = lambda payload: F.substring(F.unhex(F.sha2(payload, 256)), 1, 1).substr(0, 0)  # noqa: E731  every payload has the same
    with pytest.raises(ValueError, match="two payloads"):
        A.archive_pages(pages_of(spark, odd_pages()), str(tmp_path / "weak"), digest=weak)
    path = A.archive_pages(pages_of(spark, odd_pages()), str(tmp_path / "a"))
    spoilt = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    spoilt.write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(f"{path}/records").write.parquet(str(tmp_path / "b" / "records"))
    with pytest.raises(Exception, match="doesn't have its digest"):
        A.read_records(spark, str(tmp_path / "b")).collect()
