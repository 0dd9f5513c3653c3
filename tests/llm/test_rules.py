"""Quality rules against plain Python, and the order of the cascade."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import rules, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, rule string, source string"


def covered(words, size):
    windows = Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    return len({i + k for i in range(len(words) - size + 1) if windows[tuple(words[i:i + size])] > 1 for k in range(size)})


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, dup, three = len(words), sum(map(len, words)), len(lines) - len(set(lines)), covered(words, 3)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = n < 50 or 100 * three > 50 * n
    bare = sum(not re.search(r"[A-Za-z]|[^\x00-\x7F]", w) for w in words)
    caps = sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words)
    bad = failed or (2 * chars < 5 * n or chars > 12 * n or 10 * symbols > n or 2 * dup > len(lines)
                     or 10 * sum(WORD.search(x)[0][0] in "-*" for x in lines) > 9 * len(lines) or 10 * bare > 3 * n or 2 * caps > n
                     or 10 * max(Counter(words).values(), default=0) > 3 * n or 10 * covered(words, 5) > 3 * n)
    return n, chars, symbols, dup, three, failed, not bad


def texts():
    rnd = random.Random(1)
    words = [f"w{k}ord" for k in range(400)] + ["é", "日本", "CAPS", "12", "--", "a#b", "-", "*"]
    made = [None, "", " \n\t", "\n\n", "one", "a\nb\na\n\n \n \n", "x " * 60, "A1 " * 20 + "\n" + "b " * 40, "w" * 50_000]
    def some(n, among=words):
        return " ".join(rnd.choice(among) for _ in range(n))
    for _ in range(60):
        made += [some(rnd.randrange(120)), "\n".join(some(6) for _ in range(12)), "\n".join([some(7)] * 3 + [some(30), some(30)]), "\n".join("- " + some(6) for _ in range(12)),
                 some(80, ["12", "--", "3.4", "x", "yes", "no", "abc", "more", "words"]), some(80, ["ABC", "DEF", "GHI", "AB1", "XY", "ZZ"]), some(80, words[:12]), some(80).replace("ord", "#rd"),
                 " ".join(["top" if rnd.random() < 0.4 else rnd.choice(words) for _ in range(90)]), some(40) + "\n" + (some(9) + " ") * 3, "ab " * 5 + " " .join(f"{rnd.randrange(99)}" for _ in range(70))]
    made += ["é " * 49 + "\x00 \x85  ", some(20_000), some(30) + "\r\n" + some(40) + "\x0b" + some(5)]
    return list(enumerate(made))


def test_measures_and_verdicts(spark):
    rows = texts() + [(None, "null id"), (None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, "own", "own", "s") for i, t in rows], SCHEMA).repartition(3)
    got = rules.apply(df, sample=300)
    assert got.columns == ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    got = got.collect()
    assert sorted(repr((r["doc_id"], *r[2:9])) for r in got) == sorted(repr((i, *brute(t))) for i, t in rows)
    assert {r["rule"] for r in got} > {None, "base", "symbols", "bullets"}
    assert all((r["rule"] is None) == r["kept"] for r in got)


def test_any_order_gives_one_verdict():
    s = rules.Slice(*runs.content(pa.array([t for _, t in texts()])))
    want = [not brute(t)[-1] for _, t in texts()]
    for seed in range(6):
        mixed = random.Random(seed).sample(rules.RULES, len(rules.RULES))
        failed, by = rules.cascade(s, tuple(mixed))
        assert (failed | (by >= 0)).tolist() == want


@pytest.mark.parametrize("rule", rules.RULES, ids=lambda r: r.name)
def test_each_rule_decides_alone_on_a_part(rule):
    """A rule gives a text the same verdict in the whole slice and among the texts that are left."""
    whole = rules.Slice(*runs.content(pa.array([t for _, t in texts()])))
    whole = whole.only(~rules.base(whole))
    fresh = rules.Slice(whole.data, whole.at)
    verdict = rule.rejects(whole)
    assert (rule.rejects(fresh) == verdict).all()
    some = np.random.default_rng(0).random(whole.size) < 0.4
    assert (rule.rejects(whole.only(some)) == verdict[some]).all()


def test_order_by_rejections_per_cost():
    rejected = np.zeros((100, 4), bool)
    rejected[:40, 0] = True   # 40 at cost 10
    rejected[:30, 1] = True   # 30 at cost 1: first; leaves 10 to rule 0
    rejected[90:, 2] = True   # 10 at cost 2: five per cost, before 10 at cost 10
    assert rules.order(rejected, np.array([10.0, 1.0, 2.0, 0.1])) == [1, 2, 0, 3]
    assert rules.order(np.zeros((0, 2), bool), np.array([2.0, 1.0])) == [1, 0]


def test_the_cascade_stops_early():
    seen = []
    def counted(f):
        return rules.Rule(f.__name__, lambda s: (seen.append(s.size), f(s))[1])
    s = rules.Slice(*runs.content(pa.array([t for _, t in texts()])))
    passed = int((~rules.base(s)).sum())
    rules.cascade(s, tuple(counted(r.rejects) for r in rules.RULES))
    assert seen[0] == passed and all(b <= a for a, b in itertools.pairwise(seen)) and seen[-1] < passed


def test_empty_and_unplanned(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rules.apply(none).count() == 0
    short = spark.createDataFrame([(1, "a", None, None, None)], SCHEMA)
    assert rules.plan(short) == rules.RULES
