"""Operators 1, 5 and 7: token ids against the libraries, exact round trips, packing and the cache of counts."""

import random
import time
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import merge_dropout, ngram_join, packing, quality_rules, shared, text, token_counts
from sievework.llm.merges import Memo, Pairs, Table, in_rounds, merge
from sievework.llm.text import Texts, mixed, mixed_one, texts
from sievework.llm.tokens import Encoder

WORDS, BYTES, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


class TestMerges:
    def test_table(self):
        keys = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 5000)).astype(np.uint64)
        t = Table(len(keys))
        assert (t.keys[t.put(keys)] == keys).all() and (t.keys[t.find(keys)] == keys).all()
        assert (t.keys[t.find(keys + np.uint64(1 << 63))] == Table.EMPTY).all()

    def test_lowest_rank_then_leftmost(self):
        # a=0 b=1 c=2, ab=3 (rank 1), bc=4 (rank 0), aa=5 (rank 2)
        pairs = Pairs(np.array([0, 1, 0]), np.array([1, 2, 0]), np.array([1, 0, 2]), np.array([3, 4, 5]))
        sym, n = merge(np.array([0, 1, 2, 0, 0, 0, 0, 1]), np.array([3, 0, 3, 2]), pairs)
        assert sym.tolist() == [0, 4, 5, 0, 3] and n.tolist() == [2, 0, 2, 1]

    @pytest.mark.parametrize("share", [0.0, 0.3])
    def test_a_heap_gives_what_rounds_give(self, share):
        pairs, rng = merge_dropout.Model(PIECES, 0.0, 1).pairs, np.random.default_rng(2)
        length = np.array([3, 700, 0, 40, 300])
        letters = merge_dropout.Model(PIECES, 0.0, 1).symbol[rng.choice([ord(c) for c in "thearioné"], length.sum())]
        gone = lambda word, origin, merged: mixed(word.astype(np.uint64) + mixed(origin.astype(np.uint64) + mixed(merged.astype(np.uint64)))) < np.uint64(share * 2**64)
        gone_one = lambda word, origin, merged: mixed_one((word + mixed_one((origin + mixed_one(merged)) % 2**64)) % 2**64) < int(share * 2**64)
        with np.errstate(over="ignore"):
            a, n = merge(letters, length, pairs, gone, gone_one)
            b, m = in_rounds(letters, length, pairs, gone)
        assert a.tolist() == b.tolist() and n.tolist() == m.tolist() and n.sum() < length.sum()

    def test_memo_forgets_and_goes_on(self):
        m, work = Memo(most_keys=3), lambda keys: (lambda at: (np.repeat(keys[at], 2).astype(np.uint32), np.full(len(at), 2)))
        for part in ([1, 2, 2], [3, 4, 5, 6], [1, 6]):
            keys, words = np.array(part, np.uint64), np.array(part, np.uint8)
            at = np.arange(len(part))
            flat, n = m.get(keys, words, at, at + 1, work(keys))
            assert flat.tolist() == np.repeat(part, 2).tolist() and n.tolist() == [2] * len(part)

    def test_memo_compares_words_of_one_key(self):
        data = np.frombuffer(b"abcabdabxyabc", np.uint8)
        starts, ends = np.array([0, 3, 6, 10]), np.array([3, 6, 10, 13])
        work = lambda at: (np.repeat(data[ends[at] - 1], ends[at] - starts[at]).astype(np.uint32), ends[at] - starts[at])
        m = Memo()
        for _ in range(2):
            flat, n = m.get(np.full(4, 7, np.uint64), data, starts, ends, work)
            assert n.tolist() == [3, 3, 4, 3] and bytes(flat.astype(np.uint8)) == b"cccdddyyyyccc"


def complements(n=10):
    """Two words of 2**n letters, of which one has b where the other has a: sums of their letters times powers of any odd base meet in 64 bits."""
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


class TestWordsThatPowersCannotTell:
    def test_hashes(self):
        for n in (10, 11, 12):
            t = next(texts(pa.array([" ".join(complements(n))])))
            assert len(set(t.word_hashes().tolist())) == 2

    def test_long_spans_are_hashed_in_pieces(self, monkeypatch):
        data = np.frombuffer(b"the same words, the same words; and others" * 9, np.uint8)
        starts, ends = np.array([0, 10, 16, 40, 58]), np.array([9, 15, 30, 55, 300])
        whole = text.hashed(data, starts, ends)
        monkeypatch.setattr(text, "AT_ONCE", 16)
        assert text.hashed(data, starts, ends).tolist() == whole.tolist() and len(set(whole.tolist())) == 5

    @pytest.mark.parametrize("dropout", [0.0, 0.1])
    def test_op1_is_lossless(self, spark, dropout):
        x, y = complements()
        docs = spark.createDataFrame([(1, f"{x} {y}"), (2, y), (3, x)], "doc_id long, text string").coalesce(1)
        assert all(r["lossless"] for r in merge_dropout.digests(docs, PIECES, dropout).collect())

    @pytest.mark.parametrize("path", [WORDS, PIECES])
    def test_ids_are_the_library_s(self, path):
        e, both = Encoder(path), [" ".join(complements(n)) for n in (10, 11)] + [" ".join(reversed(complements(10)))]
        assert [f[a:b].tolist() for f, at in e.ids(pa.array(both)) for a, b in zip(at, at[1:], strict=False)] == [list(x) for x in e.library(both)]

    def test_lines_and_shingles(self):
        x, y = complements()
        found = quality_rules.counts(pa.array([f"{x}\n{y}\n{x}"]))
        assert found["n_dup_lines"].tolist() == [1]
        a, b = (next(texts(pa.array([f"one {w} two three four"]))) for w in (x, y))
        assert len(set(ngram_join.shingles(a, 3)[0].tolist()) & set(ngram_join.shingles(b, 3)[0].tolist())) == 1


class TestEncoder:
    @pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
    def test_as_the_library(self, path, odd_rows):
        e, texts = Encoder(path), [t or "" for _, t, *_ in odd_rows]
        got = [f[a:b].tolist() for f, at in e.ids(pa.array(texts)) for a, b in zip(at, at[1:], strict=False)]
        assert got == [list(x) for x in e.library(texts)] and len(got) == len(texts)

    def test_slices_and_nulls(self):
        e = Encoder(WORDS)
        flat, at = next(e.ids(pa.array(["zero", "one two", None, "three"]).slice(1, 2)))
        assert at.tolist() == [0, 2, 2] and flat.tolist() == list(e.library(["one two"])[0])


class TestMergeDropout:
    def test_without_dropout_as_the_library(self, odd_rows):
        model, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), [t or "" for _, t, *_ in odd_rows if "▁" not in (t or "")]
        m = merge_dropout.Model(PIECES, 0.0, 1, 1)
        got = [f[a:b].tolist() for f, at, _ in m.encode(pa.array(texts), np.zeros(len(texts), np.uint64)) for a, b in zip(at, at[1:], strict=False)]
        assert got == model.encode(texts)

    @pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
    def test_round_trip(self, odd, odd_rows, dropout):
        e = merge_dropout.encode(odd, PIECES, dropout)
        got = Counter((r["doc_id"], r["text"]) for r in merge_dropout.decode(e, PIECES).collect())
        assert got == Counter((i, t or "") for i, t, *_ in odd_rows)

    def test_seeded_and_varied(self, spark):
        d = spark.createDataFrame([(i, "the information of the situation") for i in range(40)], "doc_id long, text string")
        pieces = lambda seed, n: [tuple(r["ids"]) for r in merge_dropout.encode(d.repartition(n), PIECES, 0.3, seed).orderBy("doc_id").collect()]
        a = pieces(1, 2)
        assert a == pieces(1, 5) != pieces(2, 2) and len(set(a)) > 10

    def test_each_occurrence_is_drawn(self):
        m, n = merge_dropout.Model(PIECES, 0.1, 1), 4000

        def pieces(texts, salts):
            return [tuple(f[a:b]) for f, at, _ in m.encode(pa.array(texts), salts) for a, b in zip(at, at[1:], strict=False)]

        got = Counter(pieces(["situation"] * n, merge_dropout.salts(pa.array(range(n)))))
        whole = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode("situation")
        share = self.share_whole("situation", 0.1, n)
        assert len(whole) == 1 and len(got) > 8 and abs(got[tuple(whole)] / n - share) < 0.04
        # the same word at the places of one text
        ids = pieces([" ".join(["situation"] * n)], np.zeros(1, np.uint64))[0]
        assert abs(ids.count(whole[0]) / n - share) < 0.04

    def share_whole(self, word, dropout, n):
        """How often a word stays one piece, by random draws in plain Python."""
        sp, rng, count = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(8), 0
        score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())}
        for _ in range(n):
            sym, off = list("\u2581" + word), set()
            while found := [(-score[a + b], i) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if a + b in score and (i, a, b) not in off]:
                i = min(found)[1]
                if rng.random() < dropout:
                    off.add((i, sym[i], sym[i + 1]))
                else:
                    sym[i : i + 2] = [sym[i] + sym[i + 1]]
                    off = {(j - (j > i), x, y) for j, x, y in off}
            count += len(sym) == 1
        return count / n

    def test_as_a_plain_agenda(self):
        """With the same key, a slow agenda in plain Python gives the same pieces."""
        sp, m = sentencepiece.SentencePieceProcessor(model_file=PIECES), merge_dropout.Model(PIECES, 0.25, 9)
        score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())}
        text, salt = "the situation of information " * 6 + "antidisestablishmentarianism" * 12, merge_dropout.salts(pa.array([77]))
        got = next(iter(m.encode(pa.array([text]), salt)))[0].tolist()
        t = Texts(np.frombuffer((" " + text).encode(), np.uint8), np.array([0, len(text) + 1]))
        stops = t.ends
        words = t.hashes(np.concatenate([[0], stops[:-1]]), stops)
        with np.errstate(over="ignore"):
            keys = mixed(words + mixed(salt + mixed(np.arange(len(words)).astype(np.uint64) + m.seed))).tolist()
        want = []
        for word, key in zip(text.split(), keys, strict=True):
            sym, off = [(c, k) for k, c in enumerate("\u2581" + word)], set()
            while found := [(-score[a + b], i) for (a, i), (b, _) in zip(sym, sym[1:], strict=False) if a + b in score and (i, a + b) not in off]:
                origin = min(found)[1]
                i = next(k for k, (_, at) in enumerate(sym) if at == origin)
                merged = sym[i][0] + sym[i + 1][0]
                if mixed_one(key ^ m._place_one(origin, sp.piece_to_id(merged))) < int(m.limit):
                    off.add((origin, merged))
                else:
                    sym[i : i + 2] = [(merged, origin)]
            want += [sp.piece_to_id(x) for x, _ in sym]
        assert got == want and len(words) == 25

    def test_a_very_long_word(self):
        rng = np.random.default_rng(3)
        word = bytes(rng.choice(np.frombuffer(b"etaoinshrdlu", np.uint8), 300_000)).decode()
        m, began = merge_dropout.Model(PIECES, 0.1, 1), time.time()
        (ids, _, t), = m.encode(pa.array([word]), np.zeros(1, np.uint64))
        assert time.time() - began < 40 and m.decode(ids).tobytes() == t.data.tobytes()
        assert len(ids) > len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(word))

    def test_remembered_or_not_the_same(self, odd_rows):
        texts = [t or "" for _, t, *_ in odd_rows]
        salts = merge_dropout.salts(pa.array(range(len(texts))))
        found = []
        for most, parts in ((1, [slice(i, i + 1) for i in range(len(texts))]), (1000, [slice(0, None)])):
            m = merge_dropout.Model(PIECES, 0.2, 3, most)
            found.append([f[a:b].tolist() for x in parts for f, at, _ in m.encode(pa.array(texts[x]), salts[x]) for a, b in zip(at, at[1:], strict=False)])
        assert found[0] == found[1]

    def test_full_dropout_has_no_merges(self, spark):
        d = spark.createDataFrame([(1, "the end")], "doc_id long, text string")
        assert len(merge_dropout.encode(d, PIECES, 1.0).first()["ids"]) == 8

    def test_digests(self, clashing, odd_rows):
        rows = merge_dropout.digests(clashing, PIECES).collect()
        assert all(r["lossless"] for r in rows)
        assert Counter((r["doc_id"], r["n_bytes"], r["decoded_crc32"]) for r in rows) == Counter((i, len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
        assert merge_dropout.digests(clashing.limit(0), PIECES).count() == 0


class TestPacking:
    def check(self, df, rows, library, capacity):
        got = df.collect()
        want = Counter()
        for i, t, *_ in rows:
            ids = array("I", [*library(t), 1])
            for k, at in enumerate(range(0, len(ids), capacity)):
                want[i, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        by = {}
        for r in got:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in by.values():
            places.sort()
            assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= capacity
        return len(by), -(-sum(r["length"] for r in got) // capacity)

    @pytest.mark.parametrize("capacity", [64, 4096])
    def test_pieces_and_places(self, clashing, odd_rows, library, capacity):
        used, least = self.check(packing.pack(clashing, WORDS, capacity), odd_rows, library, capacity)
        assert used <= least * 1.01 + 1

    def test_sequences_do_not_hang_on_partitions(self, odd):
        a, b = (sorted(map(str, packing.pack(odd.repartition(n), WORDS, 256, group=10).collect())) for n in (1, 5))
        assert a == b

    def test_equal_rows_by_the_thousand(self, spark, library, monkeypatch):
        monkeypatch.setattr(packing, "COPIES", 7)
        rows = [(1, "one two")] * 50 + [(2, "one two"), (None, None)]
        self.check(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 16, group=10), rows, library, 16)

    def test_many_groups(self, odd, odd_rows, library):
        used, least = self.check(packing.pack(odd, WORDS, 256, group=10), odd_rows, library, 256)
        assert used <= least * 1.3

    def test_ids_come_along(self, odd, library):
        r = packing.pack(odd.where("doc_id = 207"), WORDS, with_ids=True).first()
        assert r["ids"] == [*library("one"), 1]

    def test_empty_table(self, odd):
        assert packing.pack(odd.limit(0), WORDS).count() == 0

    def test_rule(self):
        """Each piece goes where the squares become smallest, by trying all places."""
        rng = np.random.default_rng(1)
        sizes = np.sort(rng.integers(1, 20, 60))[::-1]
        seq, off = packing.sum_of_squares(sizes, 20)
        level = {}
        for s, q, o in zip(sizes.tolist(), seq.tolist(), off.tolist(), strict=True):
            gaps = Counter(20 - v for v in level.values() if v < 20)
            options = {}
            for g in gaps:
                if g >= s:
                    after = gaps - Counter([g]) + (Counter([g - s]) if g > s else Counter())
                    options[g] = sum(n * n for n in after.values())
            assert level.get(q, 0) == o
            if options:
                assert options[20 - o] == min(options.values()) and o > 0
            else:
                assert o == 0
            level[q] = o + s


class TestTokenCounts:
    def test_counts(self, spark, clashing, odd_rows, library):
        got = token_counts.counted(clashing, shared.scratch(spark, "cache"), WORDS, 100).collect()
        want = Counter((i, len((t or "").encode()), len(library(t)), len(library(t)) > 100) for i, t, *_ in odd_rows)
        assert Counter(map(tuple, got)) == want

    def test_only_distinct_misses_are_encoded_and_kept(self, spark, odd):
        cache = shared.scratch(spark, "cache")
        token_counts.fill(odd.where("doc_id < 20"), cache, WORDS)
        first = spark.read.parquet(cache).count()
        token_counts.fill(odd, cache, WORDS)
        rows = spark.read.parquet(cache)
        assert first < rows.count() == rows.select("digest").distinct().count() < odd.count()
        # what the cache says is believed
        forged = rows.withColumn("n_tokens", F.lit(7).cast("long"))
        other = shared.scratch(spark, "cache")
        forged.write.parquet(other)
        assert {r["n_tokens"] for r in token_counts.counted(odd, other, WORDS).collect()} == {7}

    def test_versions_do_not_mix(self, spark, odd):
        cache = shared.scratch(spark, "cache")
        a = token_counts.counted(odd, cache, WORDS).agg(F.sum("n_tokens")).first()[0]
        b = token_counts.counted(odd, cache, PIECES).agg(F.sum("n_tokens")).first()[0]
        assert a != b and spark.read.parquet(cache).select("version").distinct().count() == 2

    def test_common_texts_are_looked_up_apart(self, spark):
        rows = spark.createDataFrame([(i, "often" if i < 40 else None if i < 50 else f"k{i}") for i in range(90)], "i long, k string")
        values = spark.createDataFrame([("often", 1)] + [(f"k{i}", i) for i in range(50, 80)], "k string, v long")
        for least in (10, 1000):
            got = {r["i"]: r["v"] for r in shared.looked_up(rows, values, "k", 5, least).collect()}
            assert got == {i: 1 if i < 40 else i if 50 <= i < 80 else None for i in range(90)}

    def test_white_space_is_normal(self, spark):
        d = spark.createDataFrame([(1, "a  b\n"), (2, "a b"), (3, "A b")], "doc_id long, text string")
        cache = shared.scratch(spark, "cache")
        assert {r["n_tokens"] for r in token_counts.counted(d, cache, WORDS).collect()} == {2} and spark.read.parquet(cache).count() == 2

    def test_empty_table(self, spark, odd):
        assert token_counts.counted(odd.limit(0), shared.scratch(spark, "cache"), WORDS).count() == 0
