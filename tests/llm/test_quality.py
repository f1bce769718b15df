"""Quality statistics against plain versions, the binomial bound, and what cutoffs guarantee."""

import math
import random
import re
from collections import Counter
from math import comb

from factorloom.llm import quality


def covered(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    return len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)})


def test_statistics_match_plain_versions():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "É", " ", "\n", "\t", "#", "<", "\x0b", "\x1c", " ", "Z"]) for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = dict(zip(quality.STAT_NAMES, quality.text_stats(text)))
        assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
        assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and got["n_repeat_words"] == covered(words)
        assert got["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines)) and got["n_lines"] == len(lines)
    words = [str(rng.randint(0, 40_000)) for _ in range(9000)] * 2
    assert quality.repeated_words(words) == covered(words)
    assert quality.text_stats(None) == quality.text_stats("") == (0,) * 7


def test_tail_is_the_binomial_sum():
    for n, p in ((20, 0.1), (300, 0.02), (1000, 0.3)):
        for k in range(0, int(n * p)):
            exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            assert abs(quality.tail(k, n, p) - exact) < 1e-9
    assert quality.tail(5, 0, 0.1) == 1.0


def labelled(frame, n, leak):
    """n good and n/5 bad rows in one stratum; `leak` good rows look bad under the symbol rule."""
    noise = "".join(f" ##{j}##" for j in range(12))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(12)) + (noise if i < leak else ""), "en", 1) for i in range(n)]
    rows += [(n + i, " ".join(f"b{i}x{j}" for j in range(12)) + noise, "en", 0) for i in range(n // 5)]
    return rows


def test_cutoffs_need_enough_good_rows(frame):
    for n, leak, kept_bad in ((2500, 0, False), (300, 0, True), (2500, 60, True)):
        rows = labelled(frame, n, leak)
        docs, labels = frame([r[:3] for r in rows], "doc_id long, text string, lang string"), frame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
        kept = {r["doc_id"] for r in quality.filter_quality(docs, "doc_id", "text", "lang", labels).collect()}
        assert (n in kept) == kept_bad
        assert len([i for i in kept if i < n]) == n


def test_edges(frame):
    docs = frame([(1, None, None, 1), (None, "x " * 4 + "a b c d e f g h", "en", 2), (2, "", "en", 3), (3, "one two three four five six seven eight nine ten", None, 4), (3, "one two three four five six seven eight nine ten", None, 4)], "doc_id long, text string, lang string, _kept int")
    labels = frame([(1, None), (None, 1), (3, 1), (3, 0), (99, 0)], "doc_id long, quality int")
    out = quality.filter_quality(docs, "doc_id", "text", "lang", labels)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "3", "None"]
    assert quality.filter_quality(docs.where("false"), "doc_id", "text", "lang", labels.where("false")).collect() == []
    assert quality.filter_quality(docs, "doc_id", "text", "lang", labels.where("false")).count() == 3


def test_cutoffs_against_plain_sums(frame):
    """Three strata, one of them null, with enough good rows for some cutoffs; every rule and cutoff by exact sums."""
    rng, rows = random.Random(11), []
    for lang, n in (("en", 2600), (None, 2300), ("de", 400)):
        for i in range(n):
            good = rng.random() < 0.85
            words = rng.randint(0, 200)
            s = {x: rng.randint(0, 3 if good else 60) for x in quality.STAT_NAMES} | {"n_words": words, "word_chars": words * rng.randint(3, 9), "n_repeat_words": rng.randint(0, words // 4), "n_lines": rng.randint(1, 60)}
            rows.append((lang, rng.choice([good, good, good, None]), tuple(s[x] for x in quality.STAT_NAMES)))
    df = frame(rows, "lang string, good boolean, s struct<" + ",".join(f"{x}:bigint" for x in quality.STAT_NAMES) + ">")
    got = {r["stratum"]: r.asDict() for r in quality.cutoffs(df, "s", "lang", "good").collect()}
    by = {}
    for lang, good, s in rows:
        s = dict(zip(quality.STAT_NAMES, s))
        if good is not None and not (s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]):
            by.setdefault(lang, []).append((good, s))
    found = 0
    for lang, some in by.items():
        n = sum(g for g, _ in some)
        for rule, (num, den, grid) in quality.RULES.items():
            best = None
            for c in grid:
                hit = [g for g, s in some if 100 * s[num] > c * s[den]]
                k, bad = sum(hit), len(hit) - sum(hit)
                p = quality.ALPHA / len(quality.RULES)
                exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
                if exact <= quality.DELTA / (len(by) * len(quality.RULES)) and bad - quality.COST * k > 0:
                    best = max(best or (float("-inf"), 0), (bad - quality.COST * k, c))
            assert (got.get(lang) or {}).get(rule) == (best and best[1])
            found += best is not None
    assert found >= 2


def test_columns_of_any_name(frame):
    rows = labelled(frame, 200, 0)
    docs = frame([(*r[:3], 1, "x", 2.0, "k", "t") for r in rows] + [(None, None, None, 1, "x", 2.0, "k", "t")], "doc_id long, text string, lang string, _limit int, _limit_of string, _stats double, _key string, _text string")
    labels = frame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    out = quality.filter_quality(docs, "doc_id", "text", "lang", labels)
    assert out.columns == docs.columns and out.count() == len(rows)
