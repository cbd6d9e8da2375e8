"""Operators 8, 9 and 10: files written and read again, flows, archives, searches."""

import base64
import gzip
import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import resharding, shared, topk, warc


class TestFlow:
    def test_least_bytes_move(self):
        rng = np.random.default_rng(0)
        for n, m in ((3, 5), (5, 3), (4, 4)):
            supply = rng.integers(0, 50, n).tolist()
            flow = resharding.cheapest_flow(supply, resharding.even(sum(supply), m), lambda i, j: int(i != j))
            for i in range(n):
                assert sum(v for (a, _), v in flow.items() if a == i) == supply[i]
            into = [sum(v for (_, b), v in flow.items() if b == j) for j in range(m)]
            assert into == resharding.even(sum(supply), m)
            stays = sum(min(a, b) for a, b in zip(supply, into, strict=False))
            assert sum(v for (a, b), v in flow.items() if a != b) == sum(supply) - stays

    def test_other_costs_by_trying_all(self):
        cost = [[4, 1], [2, 3]]
        flow = resharding.cheapest_flow([2, 3], [3, 2], lambda i, j: cost[i][j])
        best = min(4 * a + (2 - a) + 2 * (3 - a) + 3 * a for a in range(3))
        assert sum(cost[i][j] * v for (i, j), v in flow.items()) == best


class TestResharding:
    def test_rows(self, spark, clashing, odd_rows):
        got = resharding.digests(clashing, shared.scratch(spark, "shards")).collect()
        raw = lambda t: (t or "").encode()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t, *_ in odd_rows)
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(24))
        assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}

    def test_near_equal_and_few_moves(self, spark):
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 400).cast("int")).alias("text"), F.lit(1).alias("extra"), F.lit("own").alias("Shard"))
        old, new = f"{shared.scratch(spark, 'shards')}/old", shared.scratch(spark, "shards")
        schema = resharding.write(docs, F.pmod(F.xxhash64("doc_id"), F.lit(4)), 4, old, least=5_000)
        was = {r["doc_id"]: r["shard"] for r in spark.read.parquet(old).collect()}
        root = Path(old.removeprefix("file://"))
        before = {p: hashlib.sha1(p.read_bytes()).hexdigest() for p in root.rglob("*.parquet")}
        done = resharding.reshard(spark, schema, old, 4, 6, new)
        rows = done.read(spark).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(range(3000)) and {r["extra"] for r in rows} == {1}
        sizes = Counter()
        for r in rows:
            sizes[r["shard"]] += len(r["text"]) + 8
        total = sum(sizes.values())
        assert total == done.total and set(sizes) == set(range(6)) and all(abs(v - total / 6) < 409 for v in sizes.values())
        # the fewest bytes move: what is in the old shards beyond the new capacity
        held = Counter()
        for r in rows:
            held[was[r["doc_id"]]] += len(r["text"]) + 8
        assert done.moved == total - sum(min(v, c) for v, c in zip((held[i] for i in range(4)), resharding.even(total, 6), strict=False))
        moved = sum(len(r["text"]) + 8 for r in rows if was[r["doc_id"]] != r["shard"])
        assert abs(moved - done.moved) < 4 * 6 * 409
        # files that are not affected keep name and bytes, and are not read into new ones
        assert before == {p: hashlib.sha1(p.read_bytes()).hexdigest() for p in root.rglob("*.parquet")}
        kept = {Path(urlparse(k).path) for k in done.kept}
        assert len(kept) > len(before) / 3 and kept < set(before) and all(k.parent.name in {f"shard={i}" for i in range(4)} for k in kept)
        fresh = spark.read.parquet(new)
        assert fresh.agg(F.sum(F.length("text") + 8)).first()[0] == done.rewritten < total * 0.7

    def test_empty_table(self, spark, odd):
        assert resharding.digests(odd.limit(0), shared.scratch(spark, "shards")).count() == 0


PAGES = [
    (1, "http://a/x y\r\n", "same"), (2, "http://b/", "same"), (3, "http://c/", "same"), (4, None, None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: response\r\n\r\n"),
    (7, "u", "é한😀" * 5000), (None, "u", "only null"), (None, "u", "with null"), (8, "u", "with null"), (9, "u", "twice"), (9, "u", "twice"), (10, "u", "line\n"),
]


class TestWarc:
    @pytest.fixture
    def pages(self, spark):
        return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("key", F.lit("own")).repartition(3)

    def test_round_trip(self, spark, pages):
        got = warc.round_trip(pages, shared.scratch(spark, "warc")).collect()
        sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        groups = defaultdict(list)
        for i, _, h in PAGES:
            groups[h or ""].append(i)
        want = Counter()
        for h, ids in groups.items():
            top = max((i for i in ids if i is not None), default=None)
            for i in ids:
                want[i, len(h.encode()), sha(h), "response" if i == top else "revisit", None if i == top else top] += 1
        assert Counter(tuple(r) for r in got) == want

    def test_least_size(self, spark, pages):
        got = warc.round_trip(pages, shared.scratch(spark, "warc"), least=5).collect()
        assert {r["page_id"]: r["record_type"] for r in got if r["payload_bytes"] == 4} == {1: "response", 2: "response", 3: "response"}

    def test_files_are_archives(self, spark, pages, tmp_path):
        warc.write(pages, f"{tmp_path}/w", per_file=4)
        files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")]
        records = [r for f in files for r in warc.parsed(f)]
        kinds = Counter(f["warc-type"][0] for f, _ in records)
        assert kinds["request"] == kinds["metadata"] == len(PAGES) == kinds["response"] + kinds["revisit"] and len(files) > 3
        ids = [f["warc-record-id"][0] for f, _ in records]
        responses = {f["warc-record-id"][0]: f["warc-payload-digest"] for f, _ in records if f["warc-type"] == ["response"]}
        for f, _ in records:
            if f["warc-type"] == ["revisit"] and "warc-refers-to" in f:
                assert responses[f["warc-refers-to"][0]] == f["warc-payload-digest"]
        assert sum("warc-refers-to" in f for f, _ in records) == 4  # two of "same", one of the empty ones and one of "with null"
        assert len(set(ids)) == len(ids) and all(f["warc-profile"] == [warc.PROFILE] for f, _ in records if f["warc-type"] == ["revisit"])

    def test_hot_payloads(self, spark, monkeypatch):
        """Many copies of one page, which are looked up apart, and a group whose response is there twice."""
        looked_up = shared.looked_up
        monkeypatch.setattr(shared, "looked_up", lambda rows, values, key: looked_up(rows, values, key, 4, 5))
        rows = [(i, "u", "hot") for i in range(60)] + [(i, "u", f"cold {i // 2}") for i in range(60, 90)] + [(99, "u", "x"), (99, "u", "x"), (98, "u", "x")]
        got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), shared.scratch(spark, "warc")).collect()}
        want = {(i, "revisit", 59) for i in range(59)} | {(59, "response", None), (99, "response", None), (98, "revisit", 99)}
        assert got == want | {(i, "response", None) if i % 2 else (i, "revisit", i + 1) for i in range(60, 90)}

    def test_captures_are_nested_whoever_names_whom(self, spark):
        rows = [("response", "r1", ["q1"], None), ("request", "q1", [], None), ("metadata", "m1", ["r1"], None), ("metadata", "lost", ["none"], None), ("revisit", "r2", [], "r1"), ("request", "q2", ["r2"], None)]
        d = spark.createDataFrame([(t, i, c, x, "u", None, None, None, None) for t, i, c, x in rows], warc.RECORD)
        got = {r["capture"]: r for r in warc.captures(d).collect()}
        assert got["r1"]["request"]["id"] == "q1" and got["r1"]["metadata"]["id"] == "m1" and got["r2"]["request"]["id"] == "q2" and got["r2"]["metadata"] is None and len(got) == 2

    def test_broken_archives_are_errors(self):
        with pytest.raises(ValueError, match="no WARC record"):
            list(warc.parsed(b"GARBAGE"))
        with pytest.raises(ValueError, match="does not end"):
            list(warc.parsed(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc"))
        assert warc.unpacked(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab" and warc.unpacked(b"plain") == b"plain"

    def test_empty_table(self, spark, pages):
        assert warc.round_trip(pages.limit(0), shared.scratch(spark, "warc")).count() == 0


class TestTopK:
    def rows(self, n=300, dim=6):
        rng = np.random.default_rng(2)
        v = [[float(x) for x in rng.normal(size=dim).round(1)] for _ in range(n)]
        rows = list(enumerate(v)) + [(1000, None), (1001, [1.0, None]), (1002, [1.0, math.nan]), (1003, [math.inf]), (1004, []), (1005, v[0][:3]), (None, v[1]), (10, v[10]), (11, v[3]), (1050, v[7])]
        return rows

    @staticmethod
    def by_hand(rows, k, queries):
        fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
        out = set()
        asked = {(i, tuple(v)) for i, v in fine if queries(i)}
        for q, v in asked:
            score = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in fine if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:k])}
        return out

    @pytest.mark.parametrize("sizes", [(4096, 1024, 1 << 26), (40, 3, 1 << 26), (40, 3, 1), (7, 100, 1 << 26)])
    def test_as_brute_force(self, spark, monkeypatch, sizes):
        """One block of candidates in a task, or several one after the other."""
        monkeypatch.setattr(topk, "MOST_HELD", sizes[2])
        rows = self.rows()
        d = spark.createDataFrame([(i, v, 0, "own") for i, v in rows], "vec_id long, embedding array<double>, block int, id string")
        got = topk.search(d, F.col("id") % 25 == 0, per_block=sizes[0], queries_per_block=sizes[1]).collect()
        assert {tuple(r) for r in got} == self.by_hand(rows, 5, lambda i: i % 25 == 0) and len(got) == len(set(got))

    @staticmethod
    def best(q_ids, q, c_ids, c, k, pivots):
        most = float((c.astype(float) ** 2).sum(1).max())
        tall = topk.raised(c, most)
        points = tall[np.linspace(0, len(c) - 1, pivots).astype(int)]
        return topk.best(q_ids, q, topk.distances(topk.raised(q, None), points), c_ids, c, topk.distances(tall, points), most, k)

    def test_elimination_stops_early_and_is_exact(self):
        rng = np.random.default_rng(3)
        centers = rng.integers(-3000, 3000, (12, 4))
        c = (centers[rng.integers(0, 12, 6000)] + rng.integers(-20, 20, (6000, 4))).astype(np.int64)
        q, ids = c[:5], np.arange(6000)
        _, _, s, evaluated = self.best(ids[:5], q, ids, c, 5, 64)
        want = np.sort(np.where(ids[:5, None] == ids, -(10**12), q @ c.T), 1)[:, ::-1][:, :5]
        assert (s == want.ravel()).all() and evaluated < 5 * 6000 / 2

    def test_the_best_so_far_stop_the_next_block_sooner(self):
        rng = np.random.default_rng(5)
        centers = rng.integers(-3000, 3000, (12, 4))
        c = (centers[rng.integers(0, 12, 6000)] + rng.integers(-20, 20, (6000, 4))).astype(np.int64)
        q, ids, most = c[:5], np.arange(6000), float((c.astype(float) ** 2).sum(1).max())
        tall = topk.raised(c, most)
        points = tall[:64]
        of_q, table = topk.distances(topk.raised(q, None), points), topk.distances(tall, points)
        halves = [(ids[a:b], c[a:b], table[:, a:b]) for a, b in ((0, 3000), (3000, 6000))]
        at, found, s, _ = topk.best(ids[:5], q, of_q, *halves[0], most, 5)
        start = [(found[at == i], s[at == i]) for i in range(5)]
        alone, carried = (topk.best(ids[:5], q, of_q, *halves[1], most, 5, start=x) for x in (None, start))
        whole = topk.best(ids[:5], q, of_q, ids, c, table, most, 5)
        assert carried[1].tolist() == whole[1].tolist() and carried[2].tolist() == whole[2].tolist() and carried[3] <= alone[3]

    def test_large_numbers_stay_exact(self):
        big = np.array([[1 << 27, 3], [1 << 27, 2], [1, 1]], np.int64)
        _, c, s, _ = self.best(np.array([0]), big[:1], np.arange(3), big, 2, 3)
        assert c.tolist() == [1, 2] and s.tolist() == [(1 << 54) + 6, (1 << 27) + 3]

        huge = np.array([[1 << 31, 0], [1 << 30, 0], [1, 1 << 31]], np.int64)
        _, c, s, _ = self.best(np.array([0]), huge[:1], np.arange(3), huge, 2, 3)
        assert c.tolist() == [1, 2] and s.tolist() == [1 << 61, 1 << 31]
        with pytest.raises(OverflowError):
            self.best(np.array([9]), huge[:1] * 2, np.arange(3), huge * 2, 2, 3)

    def test_tables_are_made_once(self, spark, monkeypatch):
        """Neither what is sent to the meetings nor the meetings make distances: they come with the blocks."""
        rows = self.rows()
        d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        made, blocks = [], topk.blocks
        monkeypatch.setattr(topk, "blocks", lambda *a: made.append(a) or blocks(*a))
        topk.search(d, F.col("id") % 25 == 0, per_block=40, queries_per_block=3)
        assert len(made) == 2 and made[0][3] is made[1][3]
        monkeypatch.setattr(topk, "distances", None)
        rng = np.random.default_rng(0)
        c = rng.integers(-9, 9, (50, 3))
        assert len(topk.best(np.arange(2), c[:2], np.zeros((4, 2), np.float32), np.arange(50), c, np.zeros((4, 50), np.float32), 400.0, 5)[0]) == 10

    def test_too_large_components(self, spark):
        d = spark.createDataFrame([(0, [1e300]), (1, [2.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="too large"):
            topk.search(d, F.col("id") == 0)

    def test_few_and_none(self, spark):
        d = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
        assert [tuple(r) for r in topk.search(d, F.col("id") == 0).collect()] == [(0, 1, 1, 131072)]
        assert topk.search(d.limit(0), F.col("id") == 0).count() == 0 and topk.search(d, F.col("id") == 9).count() == 0
