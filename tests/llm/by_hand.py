"""Slow twins of the operators in plain Python."""

import math
import re
from collections import defaultdict

import numpy as np
import xxhash

from sievework.llm import quality_classifier, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def hashed(number, text):
    """Spark's xxhash64 of a long and a string."""
    first = xxhash.xxh64_intdigest(int(number).to_bytes(8, "little", signed=True), seed=42)
    x = xxhash.xxh64_intdigest(text.encode(), seed=first)
    return x - (1 << 64) if x >> 63 else x


def kept_by_hand(rows, labels, risk=0.02, delta=0.05, rules=quality_rules.RULES):
    """doc_id -> base_failed and kept. rows: doc_id, text, lang, ...; ids are there once."""
    values, base, lang = {}, {}, {}
    for i, text, stratum, *_ in rows:
        n_words, chars, symbols, dup, repeats = by_hand(text)
        t = text or ""
        m = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats}
        m["n_lines"] = sum(1 for x in t.split("\n") if WORD.search(x))
        m["n_upper"] = sum("A" <= c <= "Z" for c in t)
        m["n_marks"] = sum("!" <= c <= "~" and not c.isalnum() and c not in ".," for c in t)
        values[i] = [m[r.top] / m[r.bottom] if m[r.bottom] else 0.0 for r in rules]
        base[i], lang[i] = n_words < 50 or 100 * repeats > 50 * n_words, stratum
    marks = defaultdict(set)
    for i, quality, *_ in labels:
        if i is not None:
            marks[i].add(quality)
    good = [i for i, x in marks.items() if x == {1} and i in values]
    bad = [i for i, x in marks.items() if 1 not in x and None not in x and i in values and not base[i]]
    first = [i for i in good if hashed(i, "order") % 8 == 0]
    steps, at, room = [], [len(r.cutoffs) for r in rules], risk * len(first)
    while True:
        best = (0.0, None, None)
        for k, r in enumerate(rules):
            for j in range(at[k] - 1, -1, -1):
                goods, bads = (sum(values[i][k] > r.cutoffs[j] for i in some) for some in (first, bad))
                if goods <= room and bads / (goods + 1) > best[0]:
                    best = (bads / (goods + 1), k, j)
        _, k, j = best
        if k is None:
            break
        steps += [(k, rules[k].cutoffs[x]) for x in range(at[k] - 1, j - 1, -1)]
        at[k], room = j, room - sum(values[i][k] > rules[k].cutoffs[j] for i in first)
        first, bad = ([i for i in some if values[i][k] <= rules[k].cutoffs[j]] for some in (first, bad))
    tests = defaultdict(list)
    for i in good:
        if hashed(i, "order") % 8:
            tests[lang[i]].append(i)
    strata = sum(len(x) >= math.log(delta) / math.log1p(-risk) for x in tests.values())
    allowed = {}
    for stratum, ids in tests.items():
        n, done = len(ids), 0
        for k in range(len(steps)):
            gone = sum(any(values[i][r] > c for r, c in steps[: k + 1]) for i in ids)
            if sum(math.comb(n, x) * risk**x * (1 - risk) ** (n - x) for x in range(gone + 1)) > delta / max(1, strata):
                break
            done = k + 1
        allowed[stratum] = steps[:done]
    return {i: (base[i], not base[i] and not any(values[i][r] > c for r, c in allowed.get(lang[i], []))) for i in values}


def score_by_hand(model, text):
    """The log-odds of a text under a toxicity model."""
    words = [w.strip(".,;:!?\"'()") for w in text.lower().split()]
    if not words:
        return model.bias
    each = []
    for w in words:
        grams, _ = toxicity.subwords([w], len(model.score))
        assert len(grams) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in (3, 4, 5))  # the word, and its runs of 3 to 5 characters with its ends
        each.append(sum(float(model.score[g]) for g in grams) / len(grams))
    size = toxicity.WINDOW
    windows = [each[k : k + size] for k in range(0, max(1, len(each) - size + toxicity.STEP), toxicity.STEP)]
    z = [sum(x) / len(x) for x in windows]
    weights = np.exp(np.array(z) - max(z))
    return model.bias + float((weights / weights.sum()) @ np.array(z))


def grade_by_hand(model, text, least=1, keep=0.3):
    """expected_grade, tail_probability and kept of a text under a model of grades."""
    data = (text or "").encode()
    low = data.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    count = defaultdict(int)
    for i in range(len(data) - 3):
        x = int.from_bytes(low[i : i + 4], "little")
        shape = sum((low[i + k] != data[i + k]) << k for k in range(4))
        h = (x ^ (shape * 0x85EBCA6B & 0xFFFFFFFF)) * 0x9E3779B1 & 0xFFFFFFFF
        h = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
        count[h >> (32 - quality_classifier.BITS)] += 1
    w = WORD.findall(text or "")
    n = max(1, len(w))
    extra = [sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, (len(w) - len(set(w))) / n, sum(65 <= b <= 90 for b in data) / max(1, len(data))]
    length = math.sqrt(max(sum(c * model.rarity[b] ** 2 for b, c in count.items()), 1e-12))
    score = sum(math.sqrt(c) * model.rarity[b] * model.weights[b] for b, c in count.items()) / length
    score += sum(math.sqrt(e) * v for e, v in zip(extra, model.weights[quality_classifier.BUCKETS :], strict=True))
    above = [1 / (1 + math.exp(t - score)) for t in model.theta]
    return sum(above), above[least - 1], above[least - 1] >= keep
