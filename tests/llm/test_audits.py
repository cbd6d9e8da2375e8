"""Operators 11, 12 and 13: shares of terms, lists of urls, texts with their middle last."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import divergence, fill_middle, shared, url_filters
from sievework.llm.text import texts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit_by_hand(rows, most=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    has, count, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (lang, source, found) in enumerate(docs):
        groups[lang].add(source)
        for t in found:
            has[lang, t].add(i)
    kept = defaultdict(set)
    for (lang, t), who in has.items():
        if len(who) >= 3:
            kept[lang].add(t)
    for lang, source, found in docs:
        count[lang, source].update(t for t in found if t in kept[lang])
        count[lang, None].update(t for t in found if t in kept[lang])
    share = lambda lang, source, t: 1 + 10**9 * (count[lang, source][t] + 1) // (sum(count[lang, source].values()) + len(kept[lang]))
    gap = lambda p, q: (p - q) ** 2 // q
    out = []
    for lang, sources in groups.items():
        for s in sources:
            pair = [(-sum(gap(share(lang, s, t), share(lang, o, t)) for t in kept[lang]), o) for o in sources - {s}]
            each = [(t, share(lang, s, t), share(lang, None, t)) for t in kept[lang] if count[lang, s][t]]
            term = [(-gap(p, q), t) for t, p, q in each if p > q]
            for part, found, cut in (("pair", pair, None), ("term", term, most)):
                ordered = sorted(found, key=lambda x: (x[0], x[1].encode()))[:cut]
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


def audited(df, **how):
    return sorted(tuple(r) for r in divergence.audit(df, **how).collect())


class TestDivergence:
    def test_odd_rows(self, clashing, odd_rows):
        got = audited(clashing)
        assert got == audit_by_hand([(t, lang, s) for _, t, lang, s, _ in odd_rows])
        assert {x[2] for x in got} == {"pair", "term"}

    @pytest.fixture
    def rows(self):
        rng = random.Random(3)
        words = [f"w{chr(97 + k)}{rng.choice(['', 'é', '-x', ',', '1', '_Wa'])}" for k in range(26)] + ["été", "日本", "A1B", "42", "***", "\u00a0", "https://wa.wb/" + "q" * 50]
        rows = [(" ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None])) for _ in range(120)]
        return rows + [("only-once", "xx", "a"), (None, "xx", "b"), ("rare rare", "en", "d"), ("x" * 70_000 + "-ha" * 500, "de", "a"), *[("same same", "fr", "s")] * 3]

    def test_by_hand(self, spark, rows):
        assert audited(spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)) == audit_by_hand(rows)

    def test_counts_merge_in_any_steps(self, rows):
        """Counts of a few texts at a time, merged one after the other, are those of all texts at once."""
        pairs = sorted({(x or "", y or "") for _, x, y in rows})
        langs = sorted({x for x, _ in pairs})
        lang_of = np.array([langs.index(x) for x, _ in pairs])
        held, done = [], 0
        for k in range(0, len(rows), 7):
            for t in texts(pa.array([x for x, *_ in rows[k : k + 7]])):
                g = np.array([pairs.index((x or "", y or "")) for _, x, y in rows[done : done + len(t)]])
                held.append(divergence.counted(t, g, lang_of, done))
                done += len(t)
        whole, step = divergence.by_text(divergence.joined(held)), held[0]
        for x in held[1:]:
            step = divergence.by_text(divergence.joined([step, x]))

        def plain(c):
            stop = np.cumsum(c.size)
            parts = [sorted(zip(c.g[b - s : b].tolist(), c.n[b - s : b].tolist(), strict=True)) for s, b in zip(c.size, stop, strict=True)]
            return sorted(zip(c.lang.tolist(), c.text.to_pylist(), c.first.tolist(), c.last.tolist(), parts, strict=True))

        assert plain(whole) == plain(step) and whole.n.sum() == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t, *_ in rows)

    def test_a_text_over_many_batches(self, spark, monkeypatch):
        """Rows of one chunk that arrive in many batches are one when they are used."""
        rows = [(0, "same", k, k, (k % 3).to_bytes(4, "little") + (1).to_bytes(8, "little")) for k in range(3000)] + [(1, "same", 5, 6, bytes(4) + (2).to_bytes(8, "little")), (0, "tail", 9, 9, bytes(4) + (7).to_bytes(8, "little"))]
        df = spark.createDataFrame(rows, divergence.Counts.KIND).repartition(7)

        def use(whole):
            for c in whole:
                yield from c.batches()

        at_once = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
        try:
            got = sorted((r["lang"], r["text"], r["first"], r["last"], np.frombuffer(r["parts"], divergence.PART).tolist()) for r in divergence.met(df, "text", use=use).collect())
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
        assert got == [(0, "same", -1, -1, [(0, 1000), (1, 1000), (2, 1000)]), (0, "tail", 9, 9, [(0, 7)]), (1, "same", 5, 6, [(0, 2)])]

    def test_few_terms(self, spark, rows):
        df = spark.createDataFrame(rows, "text string, lang string, source string")
        assert audited(df, most=3) == audit_by_hand(rows, 3)

    def test_empty(self, spark):
        df = spark.createDataFrame([], "text string, lang string, source string")
        assert audited(df) == []
        one = spark.createDataFrame([(None, None, None)], "text string, lang string, source string")
        assert audited(one) == []

    def test_large_counts(self):
        count, total = np.array([10**13, 3, 0]), np.array([10**13 + 5, 7, 9])
        assert divergence.share(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]
        sums, rng = divergence.Sums(3), random.Random(1)
        x = [rng.randint(-(10**18), 10**18) for _ in range(2000)]
        sums.add(np.zeros(2000, np.int64), np.ones(2000, np.int64), np.array(x))
        divergence.times(sums, np.array([0]), np.array([1]), np.array([10**9]), np.array([4 * 10**9]))
        (a, b, value), = sums.take()
        assert (a.tolist(), b.tolist()) == ([0], [1]) and int(value[0]) == sum(x) + 4 * 10**18


def judged_by_hand(pages, rules, blocked):
    """page_id, host, path, rule and verdict of each page."""
    out = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(-len(r), r, v) for r, v in rules if (h := r.split("/")[0]) is not None and (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        rule, verdict = min(fits)[1:] if fits else (None, "block" if (url or "") in blocked else "allow")
        out.append((i, host, path, rule, verdict))
    return Counter(out)


class TestUrls:
    RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("a.b/", "block"), ("b/xy", "allow"), ("é.fr/", "block")]
    URLS = [
        None, "", "net/", "http://net/", "http://x.NET/a?b#c", "http://example.net/en/1", "http://example.net/en", "https://www.example.net/EN/", "http://notnet/", "http://notexample.com/de/",
        "http://m.example.com/de/x", "http://example.com/fr/", "ftp://w.org/fr/?q=://net/", "http://a.b/xyz", "http://a.b/", "http://b/xy", "http://.net/", "http://net", "http://net?x", "x://y://net/",
        "http://é.fr/ü", "http://É.fr/", "http://user@net:80/", "://", ":// ", "http://net/\n/en", "a\n://net/",
    ]

    @pytest.mark.parametrize("most", [20_000_000, 5])
    def test_by_hand(self, spark, most):
        rng = random.Random(8)
        pages = [(i, u) for i, u in enumerate(self.URLS)] + [(None, "http://x.net/"), (3, "http://net/"), (3, "http://net/")]
        pages += [(100 + i, f"http://h{rng.randint(0, 40)}.{rng.choice(['example.net', 'example.org', 'b'])}/{rng.choice(['en', 'fr', 'xy'])}/{i}") for i in range(400)]
        blocked = {u or "" for _, u in pages[::3]}
        df = spark.createDataFrame([(i, u, "own") for i, u in pages], "page_id long, url string, verdict string").withColumns({"keys": F.lit(1), "high": F.lit("x"), "host": F.lit(2)}).repartition(4)
        listed = spark.createDataFrame([(u,) for u in sorted(blocked)] * 2, "url string")
        got = url_filters.judged(df, url_filters.rule_table(spark, self.RULES), listed, most)
        assert Counter(tuple(r) for r in got.collect()) == judged_by_hand(pages, self.RULES, blocked)

    def test_no_rules_no_list_no_pages(self, spark):
        none = spark.createDataFrame([], "page_id long, url string")
        rules = url_filters.rule_table(spark, self.RULES)
        nothing = none.select("url")
        assert url_filters.judged(none, rules, nothing).collect() == []
        one = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
        assert [tuple(r) for r in url_filters.judged(one, rules.limit(0), nothing).collect()] == [(1, "net", "/", None, "allow")]

    def test_a_cascade_makes_no_mistake(self, spark):
        keys = spark.range(30_000).select(F.xxhash64("id").alias("high"), F.xxhash64("id", F.lit(1)).alias("low"), "id")
        with shared.Workspace(spark, "test") as work:
            listed, others = work.written(keys.where("id % 20 = 3"), "listed"), work.written(keys.where("id % 20 <> 3"), "others")
            found = url_filters.build(listed.drop("id"), others.drop("id"), work)
        rows = keys.toPandas()
        got = found.has(rows["high"].to_numpy(), rows["low"].to_numpy())
        assert (got == (rows["id"] % 20 == 3).to_numpy()).all()
        assert len(found.filters) > 2 and found.n_bits < 1500 * 16  # a list of 1,500 keys has 8 bytes a hash, and would leave mistakes
        assert not all(url_filters.Cascade(found.filters[:1]).has(rows["high"].to_numpy(), rows["low"].to_numpy()) == got)

    def test_only_copies(self, spark):
        pages = [(1, "u", "x"), (2, "v", "x"), (3, "w", "y"), (4, "w", "x"), (5, None, None), (6, "z", ""), (None, "n", "x"), (7, "v", "x")]
        got = url_filters.only_copies(spark.createDataFrame(pages, "page_id long, url string, html string"))
        assert sorted(r["url"] for r in got.collect()) == ["v", "z"]


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def cut_by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


class TestFillMiddle:
    def rows(self, odd_rows):
        rng = random.Random(4)
        odd = ["<P> a b", "a<S>b", "x <M", "<P", "<", "> <P", "S> <", "\t\n", " ", "é" * 5000, "é " * 5000, "a" * 4096, "a" * 4095 + " b", " " * 9000 + "x", "\u2003 \x1c y", "😀 " * 3000]
        more = [(1000 + 40 * k + j, t) for k, t in enumerate(odd) for j in range(8)]
        return [(i, t) for i, t, *_ in odd_rows] + more + [(5000 + k, "".join(rng.choices("ab é\n<P>SM", k=rng.randint(0, 60)))) for k in range(300)]

    def test_by_hand(self, spark, odd_rows):
        rows = self.rows(odd_rows)
        df = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
        made = fill_middle.transform(df)
        got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter(cut_by_hand(*x) for x in rows)
        assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t in rows)
        assert {r["form"] for r in got} == {"plain", "psm", "spm"}

    def test_digests(self, spark, odd_rows):
        rows = self.rows(odd_rows)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        got = fill_middle.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        want = [(*(c := cut_by_hand(i, t))[:5], sha(c[5]), sha(t or "")) for i, t in rows]
        assert Counter(tuple(r) for r in got) == Counter(want)

    @pytest.mark.parametrize("size", [1, 3, 16])
    def test_small_blocks(self, size):
        rows = ["one two  three\n", "", " ", "é ü", "word", "a b c d e f g h i j k l m n o p"]
        blocks = fill_middle.Blocks(next(texts(pa.array(rows))), size)
        for i, t in enumerate(rows):
            units = UNIT.findall(t)
            for k in range(len(units) + 1):
                n, cuts = blocks.cuts(i, (k, len(units)))
                head = "".join(units[:k])
                assert n == len(units) and cuts == [(len(head.encode()), len(head)), (len(t.encode()), len(t))]

    def test_fenwick(self):
        counts = np.random.default_rng(1).integers(0, 4, 37)
        tree = fill_middle.Fenwick(counts)
        assert [tree.before(k) for k in range(38)] == [0, *np.cumsum(counts).tolist()]
        ends = np.cumsum(counts)
        for k in range(1, counts.sum() + 1):
            block, before = tree.find(k)
            assert before < k <= ends[block] and before == ends[block] - counts[block]

    def test_empty(self, spark):
        assert fill_middle.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
