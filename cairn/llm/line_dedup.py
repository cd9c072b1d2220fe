"""Line dedup: an exact set-similarity join over all lines, in built-in functions only.

A line's tokens are its distinct five-word shingles, A-Z as a-z (a line of fewer
words is one token); two lines match if their sets have a Jaccard similarity of
LEAST percent or more, and a line is removed if any earlier line (smaller
doc_id, or same document and earlier) matches it. Lines without a word stay.

Tokens are ordered by their hash. Two matching lines share a token within their
prefixes (all but the last ceil(0.8 n) - 1), and lengths and positions bound how
much more they can share; what passes these filters is verified on the full sets.

Texts are split and hashed once for the prefixes. Equal lines meet first, by a hash of
their words, and only the earliest of them takes part. Tokens that several lines share
make crowds. In a crowd every line is first held against two leaders, the crowd's earliest
line and the one that meets most others; only lines that this leaves unmatched meet the
others, and of those only the ones whose sketches of the sets (SKETCH times 64 bits, of
which a token turns one) differ in as few bits as a match's must. In crowds of more than LARGE
lines they meet by new prefixes, whose tokens are ordered by how many lines of large crowds hold
them: lines with words of their own share few of these. So a group
of n near copies costs about n comparisons, and no pair that could remove a line
is skipped. Full sets are made for lines of crowds alone. Tokens and lines are kept as
64-bit hashes.

Null text has no lines and stays null; an empty text keeps its one empty line. A
document that loses every line keeps an empty text. A row is known by its id and a
hash of its text: rows of equal id and text are one place, so neither is earlier;
rows of one id with different texts are documents of their own, in the order of
that hash. Null ids come first. Long lines are lines like any other. An empty
table gives no rows. Columns of the input that are named like a result are replaced in
``dedup``; ``cleaned`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.exprs import SPACE, SPACE_RUN, lowered_bytes
from cairn.llm.tables import gathered, settled_parquet

SHINGLE = 5
LEAST = 80
#: Words of 64 bits in the sketch of a line's set, a power of two.
SKETCH = 4
#: Words of 64 bits, at most, of the map that spares lines outside crowds a shuffle.
MAP_WORDS = 1 << 20
#: A crowd of more lines is large: its open lines meet by the rarest of all their tokens.
LARGE = 4096
#: Stands for a null id.
NO_ID = -(1 << 63)

PLACE = ("doc_id", "twin", "line")


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select(_id().alias("doc_id"), _twin().alias("twin"), "text")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _twin() -> Column:
    return F.xxhash64("text")


# ---------------------------------------------------------------- lines and their tokens


def _lines(placed: DataFrame) -> DataFrame:
    """place and body of every line with a word."""
    lines = placed.select("doc_id", "twin", F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
    return lines.filter(_worded(F.col("body")))


def _worded(body: Column) -> Column:
    """Whether a line has a word."""
    return F.ltrim(body, F.lit(SPACE)) != ""


def _sets(lines: DataFrame) -> DataFrame:
    """place, ``key`` (a hash of the words in order) and ``tokens`` (the distinct tokens in order) of ``lines``."""
    many = F.greatest(F.size("words") - (SHINGLE - 1), F.lit(0))
    found = F.array_remove(F.split(lowered_bytes(F.col("body")), SPACE_RUN, -1), "")
    words = lines.select(*PLACE, found.alias("found")).select(*PLACE, F.transform("found", lambda w: F.xxhash64(w)).alias("words"))
    # one step for each token: the hashes of its words are looked up by index
    five = F.transform(F.slice("words", F.lit(1), many), lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, SHINGLE))))
    key = F.xxhash64("words")
    return words.select(*PLACE, key.alias("key"), F.sort_array(F.array_distinct(F.when(many == 0, F.array(key)).otherwise(five))).alias("tokens"))


def needed(n: Column) -> Column:
    """The least a set of ``n`` shares with a match: ceil(n * LEAST / 100)."""
    return F.ceil(n * LEAST / 100).cast("int")


def _prefixes(placed: DataFrame) -> DataFrame:
    """All lines: place, whether an equal line comes before (``gone``), and of one of the first of equal lines the size of its set and its prefix."""
    n = F.size("tokens")
    lines = _sets(_lines(placed)).select(*PLACE, "key", n.alias("n"), F.slice("tokens", F.lit(1), n - needed(n) + 1).alias("prefix"))
    equal = Window.partitionBy("key").orderBy(*PLACE)
    ranked = lines.select("*", F.row_number().over(equal).alias("rank"), F.first(F.struct(*PLACE)).over(equal).alias("head"))
    lead = F.col("rank") == 1
    return ranked.select(*PLACE, (F.struct(*PLACE) != F.col("head")).alias("gone"), F.when(lead, F.col("n")).alias("n"), F.when(lead, F.col("prefix")).alias("prefix"))


def _crowds(lines: DataFrame) -> DataFrame:
    """Tokens of prefixes that several lines share: token, line (x), size of its set, position in the prefix; the same of the crowd's earliest line; how many of the crowd come before and after."""
    entries = lines.filter("n is not null").select(*PLACE, "n", F.posexplode("prefix").alias("pos", "token"))
    crowd = Window.partitionBy("token").orderBy(*PLACE)
    shared = entries.select("*", F.count("*").over(crowd.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int").alias("size")).filter("size > 1")
    head = F.first(F.struct(F.struct(*PLACE).alias("y"), "n", "pos")).over(crowd).alias("head")
    ranked = shared.select("*", (F.row_number().over(crowd) - 1).alias("ahead"), head)
    return ranked.select("token", F.struct(*PLACE).alias("x"), "n", "pos", F.col("head.y").alias("y"), F.col("head.n").alias("h_n"), F.col("head.pos").alias("h_pos"), "ahead", (F.col("size") - 1 - F.col("ahead")).alias("behind"))


def _passes(nx: Column, px: Column, ny: Column, py: Column) -> Column:
    """Length and positional filters on two prefix entries of one token."""
    length = (nx * 100 >= ny * LEAST) & (ny * 100 >= nx * LEAST)
    most = F.least(nx - px, ny - py) + F.least(px, py)
    return length & (most * (100 + LEAST) >= LEAST * (nx + ny))


# ---------------------------------------------------------------- full sets and verification


def sketches(tokens: np.ndarray, n: np.ndarray) -> pa.StructArray:
    """Of each set of ``n`` tokens its sketch, as ``_sketch`` makes it: two sketches differ in no more bits than their sets in tokens."""
    bit, word = np.uint64(1) << (tokens & np.uint64(63)), (tokens >> np.uint64(6)) % np.uint64(SKETCH)
    turned = lambda k: np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), np.cumsum(n) - n) if len(n) else np.empty(0, np.uint64)
    return pa.StructArray.from_arrays([pa.array(turned(k).view(np.int64)) for k in range(SKETCH)], [f"s{k}" for k in range(SKETCH)])


_BIT = "shiftleft(1L, cast(t & 63 as int))"
_WORD = f"((t >> 6) & {SKETCH - 1})"


def _sketch(tokens: str) -> Column:
    """Of a set of tokens SKETCH words of 64 bits, of which each token turns one bit."""
    return F.struct(*(F.expr(f"aggregate({tokens}, 0L, (a, t) -> if({_WORD} = {k}, a ^ {_BIT}, a))").alias(f"s{k}") for k in range(SKETCH)))


def _sketched(sets: DataFrame) -> DataFrame:
    """x and ``_sketch`` of its tokens, for each of ``sets`` (a place once, tokens), a row a token and no loop over arrays."""
    bits = sets.select(*PLACE, F.explode("tokens").alias("t"))
    turned = bits.groupBy(*PLACE).agg(*(F.expr(f"bit_xor(if({_WORD} = {k}, {_BIT}, 0L))").alias(f"s{k}") for k in range(SKETCH)))
    return turned.select(F.struct(*PLACE).alias("x"), F.struct(*(f"s{k}" for k in range(SKETCH))).alias("sketch"))


def _near(x: str, nx: str, y: str, ny: str) -> Column:
    """Whether the sketches x and y of sets of nx and ny tokens differ in as few bits as those of a match must."""
    apart = sum((F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(SKETCH)), F.lit(0))
    return apart * (100 + LEAST) <= (F.col(nx) + F.col(ny)) * (100 - LEAST)


def _among(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The ``rows`` at ``places``, and few others: a map of bits, of bounded size, spares most a shuffle to the exact join behind it."""
    words = min(MAP_WORDS, 1 + places.count() // 4)
    word = F.pmod(F.shiftright(F.xxhash64(*PLACE), 6), F.lit(words))
    bit = F.expr(f"shiftleft(1L, cast(xxhash64({', '.join(PLACE)}) & 63 as int))")
    marked = places.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = rows.select("*", word.alias("word"), bit.alias("bit")).join(F.broadcast(marked), "word")
    return found.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).select(*rows.columns)


def _full_sets(placed: DataFrame, places: DataFrame) -> DataFrame:
    """place and tokens of the lines at ``places``."""
    # an inner join: a semi join would be pushed below the join with the map
    own = _among(_lines(placed), places).join(places, list(PLACE)).dropDuplicates(list(PLACE))
    return _sets(own).select(*PLACE, "tokens")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The places x of the pairs (x, y) of places whose sets match."""
    named = settled_parquet(gathered(pairs.select("x.*").union(pairs.select("y.*")).distinct()))
    own = settled_parquet(gathered(_among(sets, named).select(F.struct(*PLACE).alias("x"), "tokens")))  # few of all: the joins move these alone
    both = pairs.join(own.select("x", F.col("tokens").alias("tx")), "x").join(own.select(F.col("x").alias("y"), F.col("tokens").alias("ty")), "y")
    common = both.select("x", F.size("tx").alias("nx"), F.size("ty").alias("ny"), F.size(F.array_intersect("tx", "ty")).alias("common"))
    return common.filter(F.col("common") * 100 >= (F.col("nx") + F.col("ny") - F.col("common")) * LEAST).select("x.*")


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, twin, line of every line that an earlier line matches; a line may come more than once."""
    placed = _placed(docs)
    lines = settled_parquet(gathered(_prefixes(placed)))
    equal = lines.filter("gone").select(*PLACE)
    members = settled_parquet(gathered(_crowds(lines)))

    x = F.struct(*PLACE).alias("x")
    tried = members.filter("ahead > 0").filter(_passes(F.col("n"), F.col("pos"), F.col("h_n"), F.col("h_pos")))
    tried = settled_parquet(gathered(tried.select("x", "n", "y", "h_n").distinct()))
    more = members.filter("ahead > 1 or (ahead = 1 and behind > 0)").select("token", "x", "n", "pos", "ahead", "behind")  # what pairs without the head are made of
    wanted = settled_parquet(gathered(tried.select("x.*").union(tried.select("y.*")).union(more.select("x.*")).distinct()))
    sets = settled_parquet(gathered(_full_sets(placed, wanted)))
    sketch = settled_parquet(gathered(_sketched(sets)))
    tried = tried.join(sketch, "x").join(sketch.select(F.col("x").alias("y"), F.col("sketch").alias("h_sketch")), "y")
    tried = settled_parquet(gathered(tried.filter(_near("sketch", "n", "h_sketch", "h_n")).select("x", "y")))
    done = settled_parquet(gathered(_verified(tried, sets).distinct()))

    # a second leader of a crowd: the line that meets most others in all its crowds
    large = F.col("ahead") + F.col("behind") >= LARGE
    company = more.groupBy("x").agg(F.sum(F.col("ahead") + F.col("behind")).alias("company"), F.collect_list(F.when(~large, F.col("token"))).alias("shares"))
    sketched = settled_parquet(gathered(more.join(company.join(sketch, "x"), "x")))
    leaders = sketched.groupBy("token").agg(F.min_by(F.struct("x", "n", "pos", "sketch"), F.struct(-F.col("company"), "x")).alias("l"))
    sketched = sketched.drop("company")
    left = settled_parquet(gathered(sketched.filter("ahead > 1").join(done.select(x), "x", "left_anti")))
    led = left.join(leaders, "token").filter(F.col("x") > F.col("l.x"))
    led = led.filter(_passes(F.col("n"), F.col("pos"), F.col("l.n"), F.col("l.pos")) & _near("sketch", "n", "l.sketch", "l.n")).select("x", F.col("l.x").alias("y")).distinct()
    led = settled_parquet(gathered(led.join(tried, ["x", "y"], "left_anti")))
    found = settled_parquet(gathered(_verified(led, sets).distinct()))
    done = done.union(found)
    tried = tried.union(led)

    # what the leaders leave: in small crowds all pairs, in large ones those that share a rare token
    open_ = left.join(found.select(x), "x", "left_anti")
    shared = open_.filter(large).select("token").distinct()
    crowds = sketched.filter(large).join(shared, "token", "left_semi").select("x").distinct()
    rare = settled_parquet(gathered(_rarest(sets.select(x, "tokens").join(crowds, "x", "left_semi")).join(sketch, "x")))
    rest = _met(open_.filter(~large), sketched.filter(~large & (F.col("behind") > 0)))
    rest = rest.union(_met(rare.join(open_.filter(large).select("x").distinct(), "x", "left_semi"), rare)).distinct()
    rest = settled_parquet(gathered(rest.join(tried, ["x", "y"], "left_anti")))
    return equal.union(done).union(_verified(rest, sets))


def _rarest(sets: DataFrame) -> DataFrame:
    """Of ``sets`` (x, tokens) the prefixes, tokens in order of how many of the sets hold them; tokens of one set alone are left out."""
    held = sets.select("x", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    ranked = held.select("*", F.count("*").over(Window.partitionBy("token")).alias("many"))
    ranked = ranked.select("*", (F.row_number().over(Window.partitionBy("x").orderBy("many", "token")) - 1).alias("pos"))
    prefixes = ranked.filter((F.col("pos") <= F.col("n") - needed(F.col("n"))) & (F.col("many") > 1))
    return prefixes.select("token", "x", "n", "pos", F.collect_list("token").over(Window.partitionBy("x")).alias("shares"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (x, y) of entries of ``left`` and earlier ones of ``right`` that share a token and pass the filters.

    ``shares`` has all tokens of an entry's line; a pair comes of the least that both share, so near copies do not meet once for each token.
    """
    l, r = left.alias("l"), right.select("token", F.col("x").alias("y"), "n", "pos", "sketch", "shares").alias("r")  # noqa: E741
    later = (F.col("l.token") == F.col("r.token")) & (F.col("l.x") > F.col("r.y"))
    close = _near("l.sketch", "l.n", "r.sketch", "r.n") & _passes(F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos"))
    least = F.array_min(F.array_intersect("l.shares", "r.shares")) == F.col("l.token")
    return l.join(r, later & close & least).select(F.col("l.x").alias("x"), F.col("r.y").alias("y"))


def _cut(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one column ``row``, with ``text`` (what is left), ``n_lines`` and ``n_removed`` beside it."""
    gone = removed_lines(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("of"), F.col("twin").alias("of_twin")).agg(F.collect_set("line").alias("gone"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), _id().alias("id"), _twin().alias("twin"))
    joined = packed.join(gone, (F.col("id") == F.col("of")) & (F.col("twin") == F.col("of_twin")), "left")
    pieces = F.split("row.text", "\n", -1)
    left = F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n")
    n_lines = F.size(F.filter(pieces, _worded))
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left).alias("text"),
        F.when(F.col("row.text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that an earlier line matches, plus ``n_lines`` and ``n_removed``, which replace columns of these names."""
    made = ("text", "n_lines", "n_removed")
    return _cut(docs).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in made), *made)


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, without the lines that an earlier line matches."""
    return _cut(docs).select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
