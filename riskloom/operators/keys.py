"""Application keys: normalisation, overlap of key sets across sources, fuzzy matching."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.keys import normalize_key
from riskloom.session import cut_lineage, stored


def normalize_keys(df: DataFrame, col: str, out: str = "key") -> DataFrame:
    return df.withColumn(out, normalize_key(F.col(f"`{col}`")))


def key_overlap(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Tagged union of every source's keys -> one bit mask per key -> keys per mask.

    One shuffle for any number of sources (map-side ``bit_or`` combine); output has one row
    per combination of sources present, with the source names spelled out."""
    names = list(sources)
    parts = [df.select(F.col(f"`{c}`").cast("string").alias("key"), F.lit(1 << i).alias("tag"))
             .where(F.col("key").isNotNull()) for i, (n, (df, c)) in enumerate(sources.items())]
    masks = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.bit_or("tag").alias("mask"))
    per_mask = masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n_keys"))
    in_src = [F.when((F.col("mask").bitwiseAND(1 << i)) > 0, F.lit(n)) for i, n in enumerate(names)]
    return per_mask.select("mask", F.concat_ws("+", *in_src).alias("sources"), "n_keys")


def _ratio(threshold: float) -> tuple[int, int]:
    """threshold as p/q, so that "similarity >= threshold" is the integer test ed*q <= (q-p)*m."""
    from fractions import Fraction
    f = Fraction(str(threshold))  # the decimal as the caller wrote it
    return f.numerator, f.denominator


# At most so many characters that one side alone holds are left out of the cores (a bound for the driver; the rest are tried like any other).
ONE_SIDED = 256


def _cores(lk: DataFrame, rk: DataFrame) -> list[DataFrame]:
    """(key, core) of both sides: the key without the characters that no key of the other side holds, as no common subsequence keeps them."""
    chars = [k.select(F.explode(F.array_distinct(F.split("key", ""))).alias("char"), F.lit(side).alias("side")) for k, side in ((lk, 1), (rk, 2))]
    alone = chars[0].unionAll(chars[1]).where(F.col("char") != "").groupBy("char").agg(F.bit_or("side").alias("side"), F.count(F.lit(1)).alias("n")) \
        .where(F.col("side") < 3).orderBy(F.desc("n"), "char").limit(ONE_SIDED).collect()
    out = ["".join(r["char"] for r in alone if r["side"] == side) for side in (1, 2)]
    return [k.select("key", (F.translate("key", c, "") if c else F.col("key")).alias("core")) for k, c in zip((lk, rk), out, strict=True)]


def _classes(keys: DataFrame) -> list[tuple[int, int]]:
    """The (length, core length) that occur: a row for each on the driver."""
    return [tuple(r) for r in keys.groupBy(F.length("key").alias("a"), F.length("core").alias("c")).agg(F.lit(1)).select("a", "c").collect()]


def _shorter(keys: DataFrame, n: int) -> DataFrame:
    """(key, v): the core less n characters, each distinct v once, so that nothing need be shuffled to tell them apart.

    Characters go from left to right, and none that equals the one kept before it: of equal neighbours the first ones go."""
    cur = keys.select("key", F.col("core").alias("v"), F.lit(1).alias("_i"))
    for _ in range(n):
        cur = cur.where(F.col("_i") <= F.length("v")) \
            .select("key", "v", F.explode(F.sequence("_i", F.length("v"))).alias("_i")) \
            .where((F.col("_i") == 1) | (F.expr("substring(v, _i, 1)") != F.expr("substring(v, _i - 1, 1)"))) \
            .select("key", F.expr("concat(substring(v, 1, _i - 1), substring(v, _i + 1))").alias("v"), "_i")
    return cur.select("key", "v")


def _meet(left: DataFrame, right: DataFrame, lc: list[tuple[int, int]], rc: list[tuple[int, int]],
          size: Callable[[int, int, int, int], int | None]) -> DataFrame | None:
    """Pairs (key, match_key, v) with a common subsequence v, for the sizes that ``size`` names for two classes of keys (None: none); pairs may
    repeat.  Only classes that have a partner are cut down, only as far as that partner needs it, and no side is ever broadcast."""
    cuts: tuple[dict, dict] = ({}, {})
    for x in lc:
        for y in rc:
            s = size(*x, *y)
            if s is not None and 0 <= s <= min(x[1], y[1]):
                cuts[0].setdefault(x[1] - s, set()).add(x)
                cuts[1].setdefault(y[1] - s, set()).add(y)
    if not cuts[0]:
        return None

    def cut(keys: DataFrame, by: dict) -> DataFrame:
        is_in = lambda some: reduce(lambda u, w: u | w, ((F.length("key") == a) & (F.length("core") == c) for a, c in sorted(some)))
        return reduce(DataFrame.unionAll, (_shorter(keys.where(is_in(some)), n) for n, some in sorted(by.items())))

    return cut(left, cuts[0]).hint("merge").join(cut(right, cuts[1]).withColumnRenamed("key", "match_key"), "v")


def _without(keys: DataFrame, done: DataFrame) -> DataFrame:
    return cut_lineage(keys.join(done.select("key").hint("merge"), "key", "left_anti"))


def _distinct_keys(keys: DataFrame, name: str) -> DataFrame:
    return stored(keys.select(F.col(f"`{keys.columns[0]}`").cast("string").alias("key")).where(F.col("key").isNotNull()).distinct(), name)


def _has_long(*sides: DataFrame) -> bool:
    """Whether a key is over ``SHORT_KEY`` characters."""
    return any(not k.where(F.length("key") > SHORT_KEY).isEmpty() for k in sides)


# Keys up to this length meet by deletion variants, pairs with a longer one by rare grams; both ways are exact.
SHORT_KEY = 16
GRAM = 2


def _best(pairs: DataFrame, p: int, q: int, most: int | None = None) -> DataFrame:
    """Of candidate pairs (key, match_key) those that qualify, within ``most`` edits if given; the best per key."""
    m = F.greatest(F.length("key"), F.length("match_key"))
    distance = F.levenshtein("key", "match_key") if most is None else F.levenshtein("key", "match_key", most)
    ok = pairs.select("key", "match_key", distance.alias("distance"), m.alias("_m")) \
        .where((F.col("distance") >= 0) & (F.col("distance") * F.lit(q) <= F.lit(q - p) * F.col("_m")))
    return ok.groupBy("key").agg(F.min(F.struct("distance", (-F.col("_m")).alias("_negm"), "match_key")).alias("b"))


def _grams(keys: DataFrame, name: str, budget: Column) -> DataFrame:
    """(key, gram, place): the key's grams, padded at both ends."""
    pad = F.lit("\u0001" * (GRAM - 1))
    padded = F.concat(pad, F.col(name), pad)
    places = F.sequence(F.lit(1), F.length(padded) - (GRAM - 1))
    grams = keys.select(name, budget.alias("_budget"), F.transform(places, lambda i: F.substr(padded, i, F.lit(GRAM))).alias("_g"))
    placed = F.transform("_g", lambda x, i: F.struct(x.alias("gram"), (i + 1).alias("place")))
    return grams.select(name, "_budget", F.explode(placed).alias("_t")).select(name, "_budget", "_t.*")


def _with_long(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of both sides that meet in ``on`` and of which at least one is of a long key: two short keys are never brought together."""
    long, rlong = F.length("key") > SHORT_KEY, F.length("match_key") > SHORT_KEY
    return left.where(long).join(right, on).unionByName(left.where(~long).join(right.where(rlong), on))


def _long_pairs(lk: DataFrame, rk: DataFrame, budget: Callable[[str], Column], p: int, q: int) -> DataFrame:
    """Candidate pairs of which at least one key is over ``SHORT_KEY`` characters.

    d edits spoil at most GRAM * d grams and move the others at most d places, so of two keys within the budget d
    one has, among its GRAM * d + 1 grams that are rarest among all keys, an unspoiled one; the other key keeps that
    gram as well, since all places of a kept gram are kept.  Grams of a common prefix are the last to be compared."""
    least = SHORT_KEY * p // q  # the shorter key of such a pair is longer than this
    lg, rg = (_grams(k.where(F.length(n) > least), n, budget(n)) for k, n in ((lk, "key"), (rk.withColumnRenamed("key", "match_key"), "match_key")))
    # a row per gram: few, and stored, so that Spark checks the size before it broadcasts them
    often = stored(lg.select("gram").unionAll(rg.select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("_often")), "grams")

    def rare(g: DataFrame, name: str) -> DataFrame:
        rank = F.rank().over(Window.partitionBy(name).orderBy("_often", "gram"))  # one rank for all places of a gram
        return g.join(often, "gram").withColumn("_r", rank).where(F.col("_r") <= GRAM * F.col("_budget") + 1).select(name, "_budget", "gram", "place")

    left, right = rare(lg, "key"), rare(rg, "match_key").withColumnsRenamed({"place": "_rplace", "_budget": "_rbudget"})
    near = F.abs(F.col("place") - F.col("_rplace")) <= F.least("_budget", "_rbudget")
    return _with_long(left, right, "gram").where(near).select("key", "match_key").distinct()


def fuzzy_key_map(left_keys: DataFrame, right_keys: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Best right key per left key: (key, match_key, distance, similarity).

    similarity = 1 - levenshtein / longer length; a pair qualifies when it reaches
    ``threshold`` (tested in integers).  Best = smallest distance, then highest
    similarity, then smallest right key.

    Exact without comparing all pairs: two keys within distance d have a common subsequence of the longer one's length
    less d.  Keys up to ``SHORT_KEY`` characters meet by symmetric deletion: each is cut down to its subsequences of that
    length, level by level (0, 1, ..., the largest distance that qualifies); a left key leaves the search at the first level where it has
    a qualifying pair, and a level looks at nothing that a shorter or longer partner would need but does not exist.  Pairs with a longer
    key meet by the rarest of their grams, the work for which grows with the length, not with its binomials; below t = 2/3
    the grams cannot vouch for all pairs, and long keys meet by deletion too.  The best of both ways is kept; the keys are
    written once, each level's result is checkpointed."""
    p, q = _ratio(threshold)
    lk, rk = _distinct_keys(left_keys, "left"), _distinct_keys(right_keys, "right")

    def budget(name: str) -> Column:
        return F.floor(F.length(name) * F.lit(q - p) / F.lit(p)).cast("int") if p > 0 else F.length(name)

    by_grams = 3 * p >= 2 * q
    short = F.length("key") <= SHORT_KEY if by_grams else F.lit(True)
    rest, right = _cores(lk.where(short), rk.where(short))
    lc, rc = _classes(rest), _classes(right)
    found = [_best(lk.select("key", F.col("key").alias("match_key")).limit(0), p, q)]
    for d in range(max((max(x[0], y[0]) * (q - p) // q for x in lc for y in rc), default=-1) + 1):
        pairs = _meet(rest, right, lc, rc, lambda a, _c, b, _e, d=d: max(a, b) - d if d * q <= (q - p) * max(a, b) else None)
        if pairs is None:
            continue
        longest = F.greatest(F.length("key"), F.length("match_key"))
        found.append(cut_lineage(_best(pairs.where(F.length("v") == longest - d), p, q, d)))
        rest = _without(rest, found[-1])
        lc = _classes(rest)
    if by_grams and _has_long(lk, rk):
        found.append(cut_lineage(_best(_long_pairs(lk, rk, budget, p, q), p, q)))
    b = F.min("b").alias("b")
    return reduce(DataFrame.unionByName, found).groupBy("key").agg(b).select(
        "key", F.col("b.match_key").alias("match_key"), F.col("b.distance").alias("distance"),
        (F.lit(1.0) - F.col("b.distance") / (-F.col("b._negm"))).alias("similarity"))


def _pieces_of(keys: DataFrame, name: str) -> DataFrame:
    """(key, token): every character with the number of its occurrence, so that equal tokens count a multiset's overlap."""
    head = lambda i: F.substr(F.col(name), F.lit(1), i)
    char = lambda i: F.substr(F.col(name), i, F.lit(1))
    token = lambda i: F.struct(char(i).alias("char"), (F.length(head(i)) - F.length(F.replace(head(i), char(i), F.lit("")))).alias("nth"))
    return keys.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), token)).alias("token"))


def _needed(name: str, p: int, q: int) -> Column:
    """Characters that a key of this length shares with any partner that reaches p/q."""
    return F.ceil(F.length(name) * F.lit(p) / F.lit(2 * q - p)).cast("int")


def _shared(a: int, b: int, p: int, q: int) -> int:
    """Characters that two keys of a and b characters share if they reach p/q."""
    return -(-p * (a + b) // (2 * q))


def _subsequence_pairs(left: DataFrame, right: DataFrame, lc: list[tuple[int, int]], rc: list[tuple[int, int]], p: int, q: int,
                       spare: int | None) -> DataFrame | None:
    """Candidate pairs (key, match_key, v) of short keys that share all but ``spare`` characters of the shorter core (None: as many as needed)."""
    def size(a: int, c: int, b: int, e: int) -> int | None:
        least = _shared(a, b, p, q)
        return least if spare is None else min(c, e) - spare if min(c, e) - spare >= least else None

    pairs = _meet(left, right, lc, rc, size)
    enough = F.length("v") * F.lit(2 * q) >= (F.length("key") + F.length("match_key")) * F.lit(p)
    return None if pairs is None else pairs.where(enough)


def _overlap_pairs(lk: DataFrame, rk: DataFrame, p: int, q: int) -> DataFrame:
    """Candidate pairs (key, match_key) with a key over ``SHORT_KEY`` characters: they meet by the overlap of their characters, which a
    subsequence cannot exceed: of the tokens of a key all but the needed overlap, and one, in order of rarity, must hold one of the other's."""
    right = rk.select(F.col("key").alias("match_key"))
    least = SHORT_KEY * p // (2 * q - p)  # the shorter key of a pair with a long one is longer than this, or as long
    lt, rt = (_pieces_of(k.where(F.length(n) >= least), n) for k, n in ((lk, "key"), (right, "match_key")))
    often = stored(lt.select("token").unionAll(rt.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_often")), "tokens")

    def rare(tokens: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(name).orderBy("_often", "token"))
        kept = tokens.join(often, "token").withColumn("_r", place).where(F.col("_r") <= F.length(name) - _needed(name, p, q) + 1)
        return kept.select(name, "token")

    a, b = F.length("key"), F.length("match_key")
    fits = F.greatest(a, b) * F.lit(p) <= F.least(a, b) * F.lit(2 * q - p)
    limit = F.floor((a + b) * F.lit(q - p) / F.lit(q)).cast("int")
    pairs = _with_long(rare(lt, "key"), rare(rt, "match_key"), "token").where(fits).select("key", "match_key").distinct()
    return pairs.where(F.levenshtein("key", "match_key") <= limit)


def _block_pairs(lk: DataFrame, rk: DataFrame, p: int, q: int) -> DataFrame:
    """Candidate pairs for the matching-blocks ratio; no pair that reaches p/q is missing.

    The blocks of two keys of a and b characters form a common subsequence, so a ratio of t needs one of t * (a + b) / 2
    characters, and neither key is longer than (2 - t) / t times the other.  Keys up to ``SHORT_KEY`` characters meet by such a
    subsequence, pairs with a longer key by the overlap of their characters."""
    left, right = _cores(*(k.where(F.length("key") <= SHORT_KEY) for k in (lk, rk)))
    short = _subsequence_pairs(left, right, _classes(left), _classes(right), p, q, None)
    parts = [] if short is None else [short.select("key", "match_key")]
    return reduce(DataFrame.unionByName, [*parts, _overlap_pairs(lk, rk, p, q)]).distinct()


def block_ratio(left: Column, right: Column) -> Column:
    """Share of the characters of two texts that lie in their matching blocks: the longest common block, and so on on both sides of it."""
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(ratios, "double").asNondeterministic()(left, right)  # else Spark computes it for the filter and again


def _rated(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of candidate pairs the best per key by the ratio, of equal ratios the smallest match."""
    # written, and dealt out evenly before the ratios are computed
    rated = cut_lineage(pairs.select("key", "match_key")).withColumn("similarity", block_ratio(F.col("key"), F.col("match_key"))) \
        .where(F.col("similarity") >= float(threshold))
    return cut_lineage(rated.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("n"), "match_key")).alias("b")))


def block_key_map(left_keys: DataFrame, right_keys: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Best right key per left key by the matching-blocks ratio: (key, match_key, similarity); of equal ratios the smallest key.

    Candidates are those of ``_block_pairs``, taken from the largest common subsequence down: one of s characters bounds the ratio by
    2 * s / (a + b).  Of each level's pairs the first by bound and key is rated; where it reaches its bound nothing else of the level can be
    better, elsewhere all of the level's pairs are rated.  A key leaves the search once its ratio exceeds every bound still to come."""
    p, q = _ratio(threshold)
    if p <= 0:
        raise ValueError("the matching-blocks ratio needs a threshold above 0")
    lk, rk = _distinct_keys(left_keys, "left"), _distinct_keys(right_keys, "right")
    found = [_rated(lk.select("key", F.col("key").alias("match_key")).limit(0), threshold)]
    if _has_long(lk, rk):
        found.append(_rated(_overlap_pairs(lk, rk, p, q), threshold))
    rest, right = _cores(*(k.where(F.length("key") <= SHORT_KEY) for k in (lk, rk)))
    lc, rc = _classes(rest), _classes(right)
    both = F.length("key") + F.length("match_key")
    bound = F.when(both > 0, F.lit(2.0) * F.length("v") / both).otherwise(F.lit(1.0))
    deepest = max((min(x[1], y[1]) - _shared(x[0], y[0], p, q) for x in lc for y in rc), default=-1)
    for spare in range(deepest + 1):
        pairs = _subsequence_pairs(rest, right, lc, rc, p, q, spare)
        if pairs is None:
            continue
        first = pairs.groupBy("key").agg(F.min(F.struct((-bound).alias("n"), "match_key")).alias("b")).select("key", "b.*")
        first = cut_lineage(first).withColumn("similarity", block_ratio(F.col("key"), F.col("match_key")))
        first = cut_lineage(first.select("key", "match_key", "similarity", (F.col("similarity") >= -F.col("n")).alias("settled")))
        found.append(first.where("settled").select("key", F.struct((-F.col("similarity")).alias("n"), "match_key").alias("b")))
        unsettled = first.where(~F.col("settled")).select("key")
        doubt = cut_lineage(rest.join(unsettled.hint("merge"), "key", "left_semi"))
        again = _subsequence_pairs(doubt, right, _classes(doubt), rc, p, q, spare)
        if again is not None:
            found.append(_rated(again.select("key", "match_key").distinct(), threshold))
        # the largest ratio that pairs of a later level can have
        still = {x: max((2.0 * (min(x[1], y[1]) - spare - 1) / (x[0] + y[0]) for y in rc
                         if x[0] + y[0] and min(x[1], y[1]) - spare - 1 >= _shared(x[0], y[0], p, q)), default=-1.0) for x in lc}
        later = reduce(lambda u, w: u.when((F.length("key") == w[0]) & (F.length("core") == w[1]), F.lit(still[w])), sorted(still), F.when(F.lit(False), F.lit(-1.0)))
        had = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.min("b.n").alias("_n"))
        rest = cut_lineage(rest.join(had.hint("merge"), "key", "left").where((later >= 0) & (F.col("_n").isNull() | (-F.col("_n") <= later))).select("key", "core"))
        lc = _classes(rest)
    best = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.min("b").alias("b"))
    return best.select("key", F.col("b.match_key").alias("match_key"), (-F.col("b.n")).alias("similarity"))


def fuzzy_key_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                   threshold: float = 0.8, measure: str = "edits") -> DataFrame:
    """Rows of ``left`` joined (inner) with the rows of ``right`` whose key is the best
    fuzzy match of the left key; adds ``key_similarity``.  ``measure``: ``edits`` (``fuzzy_key_map``) or ``blocks``
    (``block_key_map``)."""
    best = {"edits": fuzzy_key_map, "blocks": block_key_map}[measure]
    # written, so that Spark knows its size
    mapping = stored(best(left.select(F.col(f"`{left_key}`")), right.select(F.col(f"`{right_key}`")), threshold), "matches")
    lm = left.join(mapping.select(F.col("key").alias("_lk"), F.col("match_key").alias("_rk"),
                                  F.col("similarity").alias("key_similarity")),
                   F.col(f"`{left_key}`").cast("string") == F.col("_lk"))
    return lm.join(right, F.col("_rk") == F.col(f"`{right_key}`").cast("string")).drop("_lk", "_rk")
