"""Quality rules as a short-circuit cascade.

Five measures are taken of every document (words, their code points, symbols, repeated lines, words in repeated
three-word windows), and a base rule judges by them.  The rules of ``RULES`` follow for documents that pass it.
``plan`` runs every rule on a sample of documents, which tells its cost (seconds a document) and which documents
it rejects.  The rule with the most rejections per cost goes first; the sampled documents it rejects are put
aside, and the next is chosen for the rest, so that rules which reject the same documents are not paid twice.  In the
cascade a rule sees only the documents that all rules before it have kept.

The order changes the work alone: a document is kept if no rule rejects it, whatever the order.  Only the extra
column ``rule`` names the first to reject, which follows the order.  Among rules of equal worth the one listed first
goes first.

Nulls and texts without a word have zero measures and fail the base rule.  Very long texts are measured whole; a
task holds the arrays of one slice of about 4 MB, or of one text.  Repeated rows get equal results, an empty table gives
an empty one.  The text is dropped; input columns named like an added one are replaced, all others pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import runs
from riskloom.llm.grams import slices

SAMPLE = 2000
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
IS_UPPER = (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))
IS_LOWER = (np.arange(256) >= ord("a")) & (np.arange(256) <= ord("z"))
IS_LETTER = IS_UPPER | IS_LOWER | (np.arange(256) >= 0x80)
NEWLINE = ord("\n")
ADDED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                     + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("rule", T.StringType())])


class Slice:
    """Texts as arrays; what only some rules need is worked out when first asked for."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.size = data, at, len(at) - 1

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return runs.places(IS_WORD[self.data], self.at)

    @cached_property
    def word_bounds(self) -> np.ndarray:
        return np.searchsorted(self.words[0], self.at)

    @cached_property
    def word_codes(self) -> np.ndarray:
        starts, ends = self.words
        return runs.codes(self.data[IS_WORD[self.data]], ends - starts)[0]

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Non-empty lines with a word: starts and ends."""
        starts, ends = runs.places(self.data != NEWLINE, self.at)
        first = self.words[0]
        worded = np.searchsorted(first, ends) > np.searchsorted(first, starts)
        return starts[worded], ends[worded]

    @cached_property
    def line_bounds(self) -> np.ndarray:
        return np.searchsorted(self.lines[0], self.at)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.diff(self.line_bounds)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return runs.per_text(IS_WORD[self.data] & (self.data & 0xC0 != 0x80), self.at)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return runs.per_text(IS_SYMBOL[self.data], self.at)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        starts, ends = self.lines
        if not len(starts):
            return np.zeros(self.size, np.int64)
        step = np.zeros(len(self.data) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        code = runs.codes(self.data[np.cumsum(step[:-1], dtype=np.int8) > 0], ends - starts)[0]
        text = np.repeat(np.arange(self.size), self.n_lines)
        distinct = np.unique(runs.joint(code, text), return_index=True)[1]
        return self.n_lines - np.bincount(text[distinct], minlength=self.size)

    def repeat_words(self, window: int) -> np.ndarray:
        """Words inside windows of so many words that the text holds twice or more."""
        code, n = self.word_codes, len(self.word_codes)
        text = np.repeat(np.arange(self.size), self.n_words)
        m = max(0, n - window + 1)
        first = np.flatnonzero(text[:m] == text[n - m:])
        if not len(first):
            return np.zeros(self.size, np.int64)
        again = first[runs.repeated(runs.joint(text[first], *[code[first + k] for k in range(window)]))]
        covered = np.zeros(n, bool)
        for k in range(window):
            covered[again + k] = True
        return runs.per_text(covered, self.word_bounds)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        return self.repeat_words(3)

    def words_with(self, kind: np.ndarray) -> np.ndarray:
        """Whether each word has a byte of the kind."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(kind[self.data], out=total[1:])
        starts, ends = self.words
        return total[ends] > total[starts]

    def only(self, rows: np.ndarray) -> Slice:
        """The chosen texts, with the measures that are known."""
        byte = np.repeat(rows, np.diff(self.at))
        at = np.zeros(int(rows.sum()) + 1, np.int64)
        np.cumsum(np.diff(self.at)[rows], out=at[1:])
        out = Slice(self.data[byte], at)
        moved = (self.at[:-1][rows] - at[:-1])
        for name, bounds in (("words", "word_bounds"), ("lines", "line_bounds")):
            if name in self.__dict__ and bounds in self.__dict__:
                n = np.diff(getattr(self, bounds))
                own, shift = np.repeat(rows, n), np.repeat(moved, n[rows])
                out.__dict__[name] = tuple(x[own] - shift for x in getattr(self, name))
                if name == "words" and "word_codes" in self.__dict__:
                    out.__dict__["word_codes"] = self.word_codes[own]
        for name in ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
            if name in self.__dict__:
                out.__dict__[name] = getattr(self, name)[rows]
        return out


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which ``rejects`` is true."""

    name: str
    rejects: Callable[[Slice], np.ndarray]


def base(s: Slice) -> np.ndarray:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def word_length(s: Slice) -> np.ndarray:
    """A mean word of under 2.5 or over 12 code points."""
    return (2 * s.word_chars < 5 * s.n_words) | (s.word_chars > 12 * s.n_words)


def symbols(s: Slice) -> np.ndarray:
    """More than one symbol in ten words."""
    return 10 * s.n_symbols > s.n_words


def dup_lines(s: Slice) -> np.ndarray:
    """More than half of the lines repeat an earlier one."""
    return 2 * s.n_dup_lines > s.n_lines


def bullets(s: Slice) -> np.ndarray:
    """More than 90 % of the lines begin with a dash or an asterisk."""
    starts, ends = s.words
    first = s.data[starts[np.searchsorted(starts, s.lines[0])]]
    return 10 * runs.per_text((first == ord("-")) | (first == ord("*")), s.line_bounds) > 9 * s.n_lines


def bare_words(s: Slice) -> np.ndarray:
    """More than 30 % of the words have no letter."""
    return 10 * runs.per_text(~s.words_with(IS_LETTER), s.word_bounds) > 3 * s.n_words


def capitals(s: Slice) -> np.ndarray:
    """More than half of the words are written in capitals."""
    return 2 * runs.per_text(s.words_with(IS_UPPER) & ~s.words_with(IS_LOWER), s.word_bounds) > s.n_words


def top_word(s: Slice) -> np.ndarray:
    """One word makes up more than 30 % of the text."""
    text = np.repeat(np.arange(s.size), s.n_words)
    keys, first, n = np.unique(runs.joint(text, s.word_codes), return_index=True, return_counts=True)
    most = np.zeros(s.size, np.int64)
    np.maximum.at(most, text[first], n)
    return 10 * most > 3 * s.n_words


def repeat_runs(s: Slice) -> np.ndarray:
    """More than 30 % of the words stand in repeated five-word windows."""
    return 10 * s.repeat_words(5) > 3 * s.n_words


RULES = tuple(Rule(f.__name__, f) for f in (word_length, symbols, dup_lines, bullets, bare_words, capitals, top_word, repeat_runs))


def order(rejected: np.ndarray, cost: np.ndarray) -> list[int]:
    """Rules (columns) by rejections among the rows left over, per cost."""
    left, rest, out = np.ones(len(rejected), bool), list(range(len(cost))), []
    while rest:
        worth = [(rejected[left, k].sum() / max(float(cost[k]), 1e-12), -cost[k] if not rejected[left, k].any() else 0.0, -k) for k in rest]
        best = rest.pop(max(range(len(rest)), key=worth.__getitem__))
        out.append(best)
        left &= ~rejected[:, best]
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, seed: int = 0) -> tuple[Rule, ...]:
    """The rules in the order of their worth on about ``sample`` documents (never more than twice as many)."""
    n = docs.count()
    if not n:
        return rules
    chosen = docs.select("text").sample(fraction=min(1.0, sample / n), seed=seed).limit(2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(0)):
                s = Slice(*runs.content(b.column(0).slice(lo, hi - lo)))
                s = s.only(~base(s))
                if not s.size:
                    continue
                s.n_dup_lines  # noqa: B018  a base measure: not part of a rule's cost
                masks, seconds = np.zeros(s.size, np.int64), []
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    masks |= rule.rejects(s).astype(np.int64) << k
                    seconds.append((time.perf_counter() - began) / s.size)
                yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array([seconds] * s.size, pa.list_(pa.float64()))], names=["mask", "seconds"])

    rows = chosen.mapInArrow(run, "mask long, seconds array<double>").collect()
    if not rows:
        return rules
    masks = np.array([r["mask"] for r in rows])
    cost = np.mean([r["seconds"] for r in rows], axis=0)
    rejected = masks[:, None] >> np.arange(len(rules)) & 1 != 0
    return tuple(rules[k] for k in order(rejected, cost))


def cascade(s: Slice, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text fails the base rule, and the place of the first rule that rejects it (-1: none does)."""
    failed, by = base(s), np.full(s.size, -1)
    left = np.flatnonzero(~failed)
    rest = s.only(~failed)
    for k, rule in enumerate(rules):
        if not rest.size:
            break
        out = rule.rejects(rest)
        by[left[out]] = k
        if out.any():
            left, rest = left[~out], rest.only(~out)
    return failed, by


def judge(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The input's columns without ``text``, with the measures, base_failed, kept, and the rule that rejects first
    in the given order (``base`` for the base rule)."""
    gone = {"text", *ADDED.names}
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in kept] + ADDED.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(whole.column("text")):
                b = whole.slice(lo, hi - lo)
                s = Slice(*runs.content(b.column("text")))
                measures = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words]
                failed, by = cascade(s, rules)
                rule = ["base" if f else rules[k].name if k >= 0 else None for f, k in zip(failed, by, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(f.name) for f in kept] + [pa.array(m, pa.int64()) for m in measures]
                    + [pa.array(failed), pa.array(~failed & (by < 0)), pa.array(rule, pa.string())], names=names)

    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col("text"))
    return rows.mapInArrow(run, T.StructType([*kept, *ADDED.fields]))


def apply(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``judge`` in the order that ``plan`` finds."""
    return judge(docs, plan(docs, rules, sample))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x FROM t)),
v AS (SELECT *, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d, lead(w, 4) OVER o AS e FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
three AS (SELECT doc_id, i FROM v WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w, b, c) > 1),
five AS (SELECT doc_id, i FROM v WHERE e IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w, b, c, d, e) > 1),
r3 AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM three, range(3) g(k) GROUP BY doc_id),
r5 AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM five, range(5) g(k) GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL) GROUP BY doc_id),
words AS (SELECT doc_id, count(*) AS n, sum(length(w))::BIGINT AS chars,
    count(*) FILTER (NOT regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')) AS bare,
    count(*) FILTER (regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS caps FROM w GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS kinds, count(*) FILTER (regexp_matches(l, '^[\x20\x09-\x0D]*[-*]')) AS bullets
    FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, coalesce(words.n, 0) AS n_words, coalesce(chars, 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n - kinds, 0) AS n_dup_lines, coalesce(r3.n, 0) AS n_repeat_words,
    coalesce(r5.n, 0) AS fives, coalesce(top.n, 0) AS top, bare, caps, coalesce(lines.n, 0) AS n_lines, bullets
    FROM t LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN r3 USING (doc_id) LEFT JOIN r5 USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    CASE WHEN base_failed THEN false ELSE NOT (2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words
        OR 2 * n_dup_lines > n_lines OR 10 * bullets > 9 * n_lines OR 10 * bare > 3 * n_words OR 2 * caps > n_words
        OR 10 * top > 3 * n_words OR 10 * fives > 3 * n_words) END AS kept
FROM b
"""
