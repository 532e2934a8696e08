"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemrank.llm.common import components, drop, materialize, number_rows, table
from tandemrank.llm.registry import query

BITS_APART, SIMILARITY, FILTER_BITS = 3, 0.8, 24
# Lines of a bucket that meet all others in the first round after the star, and how many times more in each later round.
HUBS, MORE_HUBS = 4, 8
# Lines of a bucket that are compared with as many others in one row, and low bits of an end's key that name the end.
BLOCK, END_BITS = 32, 12
# Five blocks of the 64 bits: if at most 3 bits differ, two blocks are free of differences.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f\x0b"))


def normal(line: Column) -> Column:
    """A line for comparison: lower case, without white space at its ends."""
    return F.lower(_trimmed(line))


def line_key(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def _lines(rows: DataFrame) -> DataFrame:
    """``(rid, pos, doc_id, norm)`` of all lines with something on them."""
    each = rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.posexplode(F.split(F.col("row.text"), "\n", -1)).alias("pos", "line"))
    return each.filter(_trimmed(F.col("line")) != "").select("rid", "doc_id", "pos", normal(F.col("line")).alias("norm"))


def keyed_lines(rows: DataFrame) -> DataFrame:
    """``_lines`` with their keys ``h``."""
    return _lines(rows).withColumn("h", line_key(F.col("norm")))


def _power(similarity: float) -> Column:
    """The smaller of the powers of a line's ends (see ``_ends``)."""
    return F.floor(F.log(F.col("len") * (similarity / 2)) / -math.log(similarity)).cast("int")


def _ends(similarity: float) -> dict[str, Column]:
    """Negative keys of the first and of the last m characters of ``norm``, for two neighbouring powers m of 1 / similarity.

    Lengths of similar lines differ by at most one power, so two such lines have keys of the same m, at most
    similarity / 2 of the longer one. A changed stretch of 1 - similarity of it leaves m characters whole at one end. Null
    for lines too short for any. The key's low bits name the power and the end (see ``_without_end``).
    """
    k = _power(similarity)
    out = {}
    for up in (0, 1):
        m = F.floor(F.pow(F.lit(1 / similarity), k + up)).cast("int")
        for side, part in (("first", F.substring("norm", F.lit(1), m)), ("last", F.substring("norm", F.col("len") - m + 1, m))):
            name = F.shiftleft(k + up, 1) + (1 if side == "last" else 0)
            key = F.shiftleft(F.xxhash64(k + up, F.lit(side), part), END_BITS).bitwiseOR(name.cast("bigint")).bitwiseOR(F.lit(-(1 << 63)))
            out[f"{side}{up}"] = F.when(m > 0, key)
    return out


def simhashes(lines: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """``(h, len, sim)`` of each distinct line: bit b of ``sim`` is set if most of its distinct words' hashes have it set.

    Words are counted by 32 sums that hold two bits each, 32 bits apart, so a word costs 32 additions in generated
    code; copies of a line only scale all counts. Words combine before the shuffle, which has one row per line and task.
    ``more`` are further numbers of each line, from its ``norm`` and ``len`` or other columns, of which the smallest counts.
    """
    more = more or {}
    whole = lines.withColumn("len", F.length("norm")).select("h", "norm", "len", *[c.alias(n) for n, c in more.items()])
    words = whole.select("h", "len", *more, F.explode(F.array_distinct(F.split("norm", " "))).alias("w"))
    words = words.filter("w <> ''").select("h", "len", *more, F.xxhash64("w").alias("x"))
    lane = [F.sum(F.shiftrightunsigned("x", j).bitwiseAND(F.lit(0x100000001))).alias(f"s{j}") for j in range(32)]
    sums = words.groupBy("h", "len").agg(F.count("*").alias("n"), *lane, *[F.min(n).alias(n) for n in more])
    # Bit 30 of a lane of 2 * sum - n - 1 + 2**30 says whether most words have the bit; below 2**30 no lane reaches its neighbour.
    n = F.when(F.col("n") < 1 << 30, F.col("n")).otherwise(F.raise_error(F.lit("a line has 2**30 words in all its copies")).cast("bigint"))
    start = (F.lit((1 << 30) - 1) - n) * F.lit(0x100000001)
    # Worked out in lambdas: written out for each sum, the generated method is longer than the JVM compiles (8000 bytes).
    lanes = F.transform(
        F.array(*[f"s{j}" for j in range(32)]),
        lambda two, j: F.call_function("shiftleft", F.shiftrightunsigned(two + two + F.col("start"), 30).bitwiseAND(F.lit(0x100000001)), j),
    )
    sim = F.aggregate(lanes, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))
    sums = sums.withColumn("start", start)
    return sums.select("h", "len", sim.alias("sim"), *more)


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` once for each pair of blocks of ``sim``, with their bits and the pair's number as ``key``."""
    cut = lambda b: F.shiftrightunsigned("sim", BLOCKS[b][0]).bitwiseAND(F.lit((1 << BLOCKS[b][1]) - 1))
    keys = [
        F.shiftleft(F.shiftleft(cut(a), 13).bitwiseOR(cut(b)), 4).bitwiseOR(F.lit(i).cast("bigint"))
        for i, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    return df.select("*", F.explode(F.array(*keys)).alias("key"))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _allowed(a: str, b: str, similarity: float) -> Column:
    """The largest edit distance of an edit similarity 1 - distance / longer length of ``similarity``."""
    return F.floor(F.greatest(a, b) * (1 - similarity) + 1e-9).cast("int")


def _close(similarity: float) -> Column:
    """What can be asked of a pair without its texts: a common key, SimHash distance unless it is one of an end, lengths."""
    return (
        (F.col("a.key") == F.col("b.key")) & ((F.col("a.key") < 0) | (_apart("a.sim", "b.sim") <= BITS_APART))
        & (F.abs(F.col("a.len") - F.col("b.len")) <= _allowed("a.len", "b.len", similarity))
    )


def _bound(a: str, b: str) -> Column:
    """At least the edit distance of two texts cut at their spaces into the arrays ``a`` and ``b``: the cost of one way from a to b.

    Equal words are passed; a word that is not the other text's next one is left out, put in or turned into that one. Each
    word is taken with a space after it, so every step is a true edit of the texts. The work grows with the number of words.
    """
    def step(s, _):
        u, v = F.get(a, s["i"]), F.get(b, s["j"])
        is_next = lambda x, y: F.coalesce(x == y, F.lit(False))
        to = lambda i, j, cost: F.struct((s["i"] + i).alias("i"), (s["j"] + j).alias("j"), (s["cost"] + cost).alias("cost"))
        return (
            F.when(is_next(u, v), to(1, 1, 0))
            .when(u.isNull() & v.isNull(), s)
            .when(v.isNull() | is_next(F.get(a, s["i"] + 1), v), to(1, 0, F.length(u) + 1))
            .when(u.isNull() | is_next(u, F.get(b, s["j"] + 1)), to(0, 1, F.length(v) + 1))
            .otherwise(to(1, 1, F.levenshtein(u, v)))
        )

    zero = F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), F.struct(zero.alias("i"), zero.alias("j"), zero.alias("cost")), step, lambda s: s["cost"])


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of line keys whose texts have the edit similarity; each distinct pair is compared once.

    Further columns of ``pairs`` stay. Most links are proved by ``_bound``; only for other pairs the edit distance is worked
    out. Words that both texts start or end with are left out first, which changes no edit distance.
    """
    one = lambda c: texts.select(F.col("h").alias(c), F.split("norm", " ").alias(f"w{c}"), F.col("len").alias(f"l{c}"))
    more = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.distinct().join(one("a"), "a").join(one("b"), "b")
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda u, v: F.coalesce(u == v, F.lit(False))), False).cast("int")
    rows = both.select("a", "b", *more, "la", "lb", "wa", "wb", same(F.col("wa"), F.col("wb")).alias("head"), same(F.reverse("wa"), F.reverse("wb")).alias("tail"))
    # Positions of the first difference from either end; what is left out must not overlap in the shorter text.
    shorter = F.least(F.size("wa"), F.size("wb"))
    head = F.when(F.col("head") > 0, F.col("head") - 1).otherwise(shorter)
    tail = F.when(F.col("tail") > 0, F.col("tail") - 1).otherwise(shorter)
    rows = rows.select("a", "b", *more, "la", "lb", "wa", "wb", head.alias("head"), F.least(tail, shorter - head).alias("tail"))
    middle = lambda w: F.array_join(F.slice(w, F.col("head") + 1, F.size(w) - F.col("head") - F.col("tail")), " ")
    rows = rows.select("a", "b", *more, "la", "lb", "wa", "wb", middle("wa").alias("ma"), middle("wb").alias("mb"))
    # One text may be left empty: the space next to its neighbour is then part of the difference.
    gap = F.when((F.col("ma") == "") != (F.col("mb") == ""), 1).otherwise(0)
    allowed = _allowed("la", "lb", similarity)
    distance = F.call_function("levenshtein", F.col("ma"), F.col("mb"), allowed - gap)
    return rows.filter((_bound("wa", "wb") <= allowed) | (distance >= 0)).select("a", "b", *more)


def _perhaps(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``df`` with ``perhaps``: false only if ``wanted`` surely lacks the row's ``key``.

    One bit per hash of a wanted key makes a table of at most 2**(FILTER_BITS - 6) rows of 16 bytes at any input size: a
    proven bound for the broadcast.
    """
    spot = f"pmod(xxhash64({key}), {1 << FILTER_BITS})"
    bit = F.expr(f"shiftleft(1L, cast(pmod({spot}, 64) as int))")
    bits = wanted.select(F.expr(f"shiftright({spot}, 6)").alias("_cell"), bit.alias("_bit")).groupBy("_cell").agg(F.bit_or("_bit").alias("_bits"))
    near = df.withColumn("_cell", F.expr(f"shiftright({spot}, 6)")).join(F.broadcast(bits), "_cell", "left")
    hit = F.expr(f"(shiftrightunsigned(_bits, cast(pmod({spot}, 64) as int)) & 1) = 1")
    return near.withColumn("perhaps", F.coalesce(hit, F.lit(False))).drop("_cell", "_bits")


def _open(state: DataFrame) -> DataFrame:
    """The rows ``(key, h, sim, len, root)`` of buckets that hold lines of more than one group, written."""
    mixed = state.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return materialize(state.join(mixed.select("key"), "key", "left_semi"))


def _rest(similarity: float) -> Column:
    """``norm`` after the end that all lines of a bucket ``key`` share, read from that end: edit distances stay the same."""
    name = F.col("key").bitwiseAND(F.lit((1 << END_BITS) - 1))
    m = F.floor(F.pow(F.lit(1 / similarity), F.shiftright(name, 1))).cast("int")
    read = F.when(name.bitwiseAND(F.lit(1)) == 1, F.reverse("norm")).otherwise(F.col("norm"))
    return F.when(F.col("key") >= 0, F.col("norm")).otherwise(F.substring(read, m + 1, F.col("len")))


def _block_links(state: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, ra, rb)``: for each two groups of a bucket of ``state`` that a link joins, the smallest such pair of lines.

    The lines of a bucket, by what follows their common end, are cut into blocks of BLOCK; each two blocks meet in one row,
    dealt out over all tasks, and only links leave it. So texts move once per block pair and no row holds a pair that is no
    link. What all lines of two blocks have in common next to the end is left out. Lines of one group are not compared, nor
    two lines at the longer of two ends they share. The number of comparisons still grows with the square of the unlike
    lines with one end: nothing short of the edit distance tells two such lines apart for certain.
    """
    whole = state.join(texts.select("h", "norm"), "h").withColumn("rest", _rest(similarity)).withColumn("power", _power(similarity))
    place = F.row_number().over(Window.partitionBy("key").orderBy("rest", "h")) - 1
    numbered = whole.withColumn("block", F.floor(place / BLOCK).cast("int"))
    line = F.struct("h", "sim", "len", "root", "power", "rest")
    sums = [F.min("len").alias("low"), F.max("len").alias("high"), F.min("root").alias("least"), F.max("root").alias("most")]
    sums += [F.min("rest").alias("from"), F.max("rest").alias("to")]
    packs = materialize(numbered.groupBy("key", "block").agg(F.collect_list(line).alias("lines"), *sums))
    heads = packs.select("key", "block", "low", "high", "least", "most")
    meet = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block"))
        & (F.col("b.low") - F.col("a.high") <= _allowed("b.low", "b.low", similarity))
        & (F.col("a.low") - F.col("b.high") <= _allowed("a.low", "a.low", similarity))
        & (F.least("a.least", "b.least") != F.greatest("a.most", "b.most"))
    )
    met = heads.alias("a").join(heads.alias("b"), meet).select("a.key", F.col("a.block").alias("block"), F.col("b.block").alias("other"))
    side = lambda block, lines: packs.select("key", F.col("block").alias(block), *[F.col(c).alias(f"{lines}_{c}") for c in ("lines", "from", "to")])
    both = met.join(side("block", "left"), ["key", "block"]).join(side("other", "right"), ["key", "other"])
    # Rows between the first and the last in order share what these two begin with.
    ends = [F.split(F.least("left_from", "right_from"), ""), F.split(F.greatest("left_to", "right_to"), "")]
    same = F.array_position(F.zip_with(*ends, lambda u, v: F.coalesce(u == v, F.lit(False))), False).cast("int")
    cut = F.when(same > 0, same).otherwise(1)
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.select("key", "block", "other", cut.alias("cut"), "left_lines", "right_lines").repartition(parts, "key", "block", "other")

    def linked(x, y):
        allowed = F.floor(F.greatest(x["len"], y["len"]) * (1 - similarity) + 1e-9).cast("int")
        power = F.shiftright(F.col("key").bitwiseAND(F.lit((1 << END_BITS) - 1)), 1)
        once = (F.col("key") >= 0) | (F.greatest(x["power"], y["power"], F.lit(0)) == power)
        after = lambda z: F.substring(z["rest"], F.col("cut"), z["len"])
        return (
            (x["root"] != y["root"]) & ((F.col("block") != F.col("other")) | (x["h"] < y["h"])) & once
            & (F.abs(x["len"] - y["len"]) <= allowed)
            & ((F.col("key") < 0) | (F.bit_count(x["sim"].bitwiseXOR(y["sim"])) <= BITS_APART))
            & (F.call_function("levenshtein", after(x), after(y), allowed) >= 0)
        )

    def pair(x, y):
        swap = x["root"] > y["root"]
        of = lambda c, u, v: F.when(swap, u[c]).otherwise(v[c])
        return F.struct(of("root", y, x).alias("ra"), of("root", x, y).alias("rb"), of("h", y, x).alias("a"), of("h", x, y).alias("b"))

    found = F.flatten(F.transform("left_lines", lambda x: F.transform(F.filter("right_lines", lambda y: linked(x, y)), lambda y: pair(x, y))))
    links = both.select(F.inline(found)).groupBy("ra", "rb").agg(F.min(F.struct("a", "b")).alias("ab"))
    out = materialize(links.select("ab.a", "ab.b", "ra", "rb"))
    drop(packs)
    return out


def _join_rest(keyed: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``roots(node, root)`` after all links between lines of a bucket ``keyed(key, h, sim, len)`` whose groups differ.

    In rounds: some lines of a bucket, each of another group, are compared with all lines of the bucket's other groups. They
    are then settled there and leave it, groups that a link joins become one, and a bucket left with one group is done. In
    a bucket of like lines a few speak for all. A later round takes MORE_HUBS times the lines, so there is one only if so
    many times fewer rows are left: no round compares more pairs than the first. What is left otherwise are mostly unlike
    lines, which meet in blocks (see ``_block_links``). No link between groups is left out.
    """
    state = keyed.join(roots, F.col("h") == F.col("node"), "left").select("key", "h", "sim", "len", F.coalesce("root", "h").alias("root"))
    state, hubs = _open(state), HUBS
    n, before = state.count(), None
    while n:
        in_blocks = before is not None and n * MORE_HUBS > before
        if in_blocks:
            used = _block_links(state, texts, similarity)
            pairs = used
        else:
            turn = F.row_number().over(Window.partitionBy("key").orderBy("h"))
            first = state.groupBy("key", "root").agg(F.min(F.struct("h", "sim", "len")).alias("hub")).select("key", "root", "hub.*")
            used = materialize(first.withColumn("turn", turn).filter(F.col("turn") <= hubs).drop("turn"))
            pairs = state.alias("a").join(used.alias("b"), _close(similarity) & (F.col("a.root") != F.col("b.root")))
            of = lambda c, u, v: F.when(F.col("a.h") < F.col("b.h"), F.col(f"{u}.{c}")).otherwise(F.col(f"{v}.{c}"))
            pairs = pairs.select(of("h", "a", "b").alias("a"), of("h", "b", "a").alias("b"), of("root", "a", "b").alias("ra"), of("root", "b", "a").alias("rb"))
        links = _verified(pairs, texts, similarity)
        joined = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        into = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
        fresh = joined.join(roots.select("node"), "node", "left_anti")
        roots = materialize(roots.join(into, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(fresh))
        if in_blocks:
            drop(state)
            drop(used)
            return roots
        rest = state.join(used.select("key", "h"), ["key", "h"], "left_anti").join(into, "root", "left")
        after = _open(rest.select("key", "h", "sim", "len", F.coalesce("top", "root").alias("root")))
        for done in (state, used):
            drop(done)
        state, hubs = after, hubs * MORE_HUBS
        n, before = state.count(), n
    drop(state)
    return roots


def groups(lines: DataFrame, similarity: float = SIMILARITY, ends: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` of the distinct lines that belong to a connected group of unequal lines.

    ``lines`` has ``h`` and ``norm``. Two lines are linked if their SimHashes differ in at most BITS_APART bits and their
    edit similarity is at least ``similarity``; with ``ends`` also those of that edit similarity that begin or end alike
    (see ``_ends``), whatever their SimHashes. First each bucket's smallest line is compared with the others (a star),
    then in rounds only lines whose groups still differ (see ``_join_rest``), so a group of near copies emits no square
    of links; its connected groups are those of all links. With the numbered ``rows`` that ``lines`` were cut from, which
    then have ``rid``, only rows with a line whose text is asked for are cut again.
    """
    more = _ends(similarity) if ends else {}
    first = {"rid": F.col("rid")} if rows is not None else {}
    sims = materialize(simhashes(lines, more | first))
    counted = sims.groupBy("sim").agg(F.count("*").alias("n"))
    met = F.count("*").over(Window.partitionBy("key"))
    # Keys that several SimHashes have; lines of one SimHash share all keys, of which the first one does.
    crowded = _keyed(counted).withColumn("met", met).filter("met > 1 OR (n > 1 AND (key & 15) = 0)").select("sim", "key")
    near = sims.select("h", "len", "sim", *first).join(crowded, "sim")
    used = [sims]
    if ends:
        each = sims.select("h", "len", "sim", *first, F.explode(F.array(*more)).alias("key")).filter("key IS NOT NULL")
        shared = materialize(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
        each = _perhaps(each, shared, "key").filter("perhaps").drop("perhaps")
        near = near.unionByName(each.join(shared, "key", "left_semi"))
        used.append(shared)
    near = materialize(near)
    for done in used:
        drop(done)
    close = _close(similarity)
    partner = near.alias("a").join(near.alias("b"), close & (F.col("a.h") != F.col("b.h")), "left_semi")
    wanted = materialize(partner.select("h", "len", "sim", *first).distinct())
    if rows is not None:
        lines = keyed_lines(_perhaps(rows, wanted, "rid").filter("perhaps").drop("perhaps"))
    asked = _perhaps(lines.select("h", "norm"), wanted, "h").filter("perhaps").drop("perhaps")
    texts = materialize(asked.groupBy("h").agg(F.first("norm").alias("norm")).join(wanted, "h").select("h", "len", "norm"))
    keyed = materialize(near.select("key", "h", "sim", "len").join(wanted.select("h"), "h", "left_semi"))
    for done in (near, wanted):
        drop(done)
    hubs = keyed.groupBy("key").agg(F.min(F.struct("h", "sim", "len")).alias("hub")).select("key", "hub.*")
    star = keyed.alias("a").join(hubs.alias("b"), close & (F.col("a.h") != F.col("b.h"))).select(F.col("a.h").alias("a"), F.col("b.h").alias("b"))
    first = components(_verified(star, texts, similarity))
    out = _join_rest(keyed.join(hubs.select("key", "h"), ["key", "h"], "left_anti"), first, texts, similarity)
    for done in (keyed, texts):
        drop(done)
    return out


def removals(rows: DataFrame, similarity: float = SIMILARITY, ends: bool = False) -> DataFrame:
    """``(rid, gone)``: the positions of the lines of each numbered row that repeat an earlier line of their group.

    The kept occurrence of a group has the smallest (doc_id, rid, position), null ids last.
    """
    lines = keyed_lines(rows)
    joined = groups(lines.select("h", "norm", "rid"), similarity, ends, rows)
    places = materialize(lines.select("rid", "pos", "doc_id", "h").join(joined, F.col("h") == F.col("node"), "left").select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "pos").alias("at"), F.coalesce("root", "h").alias("g")))
    firsts = places.groupBy("g").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select("g", "first")
    gone = places.join(firsts, "g").filter(F.col("at") != F.col("first"))
    return gone.groupBy("at.rid").agg(F.collect_list("at.pos").alias("gone"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, ends: bool = False) -> DataFrame:
    """``row`` (all columns of ``docs``, its text without repeated lines), ``n_lines``, ``n_removed``.

    Of each group of equal or nearly equal lines over all documents one occurrence stays (see ``removals`` and ``groups``). Lines
    without letters or signs are no lines: they stay and count for nothing. A null text stays null; repeated rows are
    separate documents, of which the first keeps its lines; an empty table stays so. The documents are written once
    with row numbers, then only those with lines to remove move, in one join with the positions.
    """
    rows = number_rows(docs)
    gone = materialize(removals(rows, similarity, ends))
    asked = _perhaps(rows, gone, "rid")
    moved = asked.filter("perhaps").drop("perhaps").join(gone, "rid", "left")
    whole = moved.unionByName(asked.filter("NOT perhaps").drop("perhaps"), allowMissingColumns=True)
    parts = F.split(F.col("row.text"), "\n", -1)
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(removed, i)), "\n")
    )
    filled = F.size(F.filter(parts, lambda x: normal(x) != ""))
    return whole.select(
        F.col("row").withField("text", kept).alias("row"), F.coalesce(F.when(F.col("row.text").isNull(), 0).otherwise(filled), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size(removed).cast("bigint").alias("n_removed"),
    )


def drop_emptied(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without repeated lines; documents all of whose lines were repeats go, those that had none stay."""
    got = deduplicate(docs, similarity, ends=True).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    out = got.select("row.*")
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


@query("op9_fuzzy_lines")
def op9(spark, sf_dir):
    got = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), ends=True)
    return got.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"))
