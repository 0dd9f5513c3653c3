"""Fill-in-the-middle against cuts by regular expression, and exact rebuilding."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n string, output string, draws string, source string"


def brute(doc_id, text, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(tokens[lo:hi]) for lo, hi in ((0, a), (a, b), (b, n)))
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def texts():
    rnd = random.Random(4)
    passage = " ".join(f"shared{rnd.randrange(500)}" for _ in range(3000))
    made = [None, "", " ", "\n\t ", "a", " a", "a ", "  a  b  ", "é", "é ü x  y", "x" * 30_000, " " * 30_000, "<P>", "a <S> b", "<P", "P> a", "<M b <", "日本語 テキスト " * 2000,
            "\x00 \x1f \x85 a", passage, passage + " end", "start " + passage]
    for _ in range(250):
        made.append("".join(rnd.choice(["a", "bc", "é", "𝄞", " ", "\n", "  ", "<", ">", "P", "word"]) for _ in range(rnd.randrange(0, 3000))))
    return list(enumerate(made))


def test_rows_match_cuts_by_expression(spark):
    rows = texts() + [(None, "one two three"), (None, "one two three"), (7, "a repeated id"), (7, "a repeated id")]
    df = spark.createDataFrame([(i, t, "own", "own", "kept", "s") for i, t in rows], SCHEMA)
    got = fim.transform(df).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    assert set(got[0].asDict()) == {"doc_id", "draws", "source", "n", "form", "prefix_chars", "middle_chars", "output", "again"}
    want = sorted((repr(i), *map(repr, brute(i, t)), t or "") for i, t in rows)
    assert sorted((repr(r["doc_id"]), *(repr(r[c]) for c in ("n", "form", "prefix_chars", "middle_chars", "output")), r["again"]) for r in got) == want
    assert {r["draws"] for r in got} == {"kept"}
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_cover_the_text_and_survive_a_shift():
    data = np.random.default_rng(1).integers(32, 127, 600_000, dtype=np.uint8)
    bounds = list(fim.chunks(data))
    assert bounds[0][0] == 0 and bounds[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    assert max(hi - lo for lo, hi in bounds) <= fim.LARGEST
    shifted = list(fim.chunks(np.concatenate([np.full(100, 65, np.uint8), data])))
    same = {data[lo:hi].tobytes() for lo, hi in bounds} & {np.concatenate([np.full(100, 65, np.uint8), data])[lo:hi].tobytes() for lo, hi in shifted}
    assert len(same) > 0.95 * len(bounds)


def test_rolling_hash_does_not_depend_on_blocks(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 50_000, dtype=np.uint8)
    whole = list(fim.chunks(data))
    monkeypatch.setattr(fim, "BLOCK", 777)
    assert list(fim.chunks(data)) == whole


@pytest.mark.parametrize("limit", [0, 5000, 1 << 30])
def test_memo_shares_chunks_and_compares_their_content(monkeypatch, limit):
    memo = fim.Memo(limit)
    sample = [t for _, t in texts() if t]
    for _ in range(2):
        for t in sample:
            text, tokens = fim.Text(t.encode(), memo), TOKEN.findall(t)
            assert text.n == len(tokens)
            for k in {0, 1, len(tokens) // 2, len(tokens)}:
                if k <= len(tokens):
                    head = "".join(tokens[:k])
                    assert text.cut(k) == (len(head.encode()), len(head))
    assert limit < 1 << 20 or memo.hits > memo.misses
    monkeypatch.setattr(fim.xxhash, "xxh3_64_intdigest", lambda _: 0)  # every chunk collides
    memo = fim.Memo()
    assert [fim.Text(t.encode(), memo).n for t in sample] == [len(TOKEN.findall(t)) for t in sample]
