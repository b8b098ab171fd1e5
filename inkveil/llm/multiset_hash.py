"""Operator 4: a homomorphic multiset hash of a text's paragraphs.

Each paragraph (line) has a wide vector: two 64-bit hashes of the whole paragraph as four lanes, two
counts, and LANES signed lanes, of which each of the paragraph's pieces (every PIECE words in a row)
adds 1 to one or takes 1 from it, as its hash says. A text's fingerprint is the sum of its
paragraphs' vectors, each lane modulo 2^32. So the order of paragraphs doesn't matter, and adding or
removing one adds or subtracts its vector. The signed lanes of two fingerprints estimate how alike
the texts' multisets of pieces are; the estimate's error falls as 0.7 / sqrt(LANES).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import shuffle_partitions, text_of

PIECE = 2
LANES = 2048
#: Lanes before the signed ones: four sums of hashes, the number of paragraphs, and that of pieces.
PLAIN = 6


def _wrapped(x: str) -> str:
    """A sum modulo 2^32, as a signed integer."""
    return f"cast(pmod({x} + 2147483648L, 4294967296L) - 2147483648L as int)"


def pieces_of(text: str) -> str:
    """SQL for the pieces of column `text`; a line of at most PIECE words is one, others have one for each start."""
    words = rf"filter(transform(split({text}, '\\n'), x -> regexp_extract_all(x, '\\S+', 0)), w -> size(w) > 0)"
    piece = "concat(" + ", ' ', ".join(["x", *[f"w[k + {j}]" for j in range(1, PIECE)]]) + ")"
    return f"flatten(transform({words}, w -> if(size(w) < {PIECE}, array(array_join(w, ' ')), transform(slice(w, 1, size(w) - {PIECE - 1}), (x, k) -> {piece}))))"


def touched_lanes(pieces: str) -> str:
    """SQL for the signed lanes that an array of pieces touches: struct(at, v), their numbers in order and values.

    A piece's hash gives one of 2 * LANES slots: lane k is slot 2k's count less that of slot 2k + 1.
    The slots are sorted, so that each lane's are a run, mostly of one slot.
    """
    slots = f"sort_array(transform({pieces}, x -> cast(pmod(xxhash64(x), {2 * LANES}) as int)))"
    starts = "filter(sequence(0, size(m) - 1), i -> i = 0 or shiftright(m[i], 1) <> shiftright(m[i - 1], 1))"
    own = "if(till - i = 1, 1 - 2 * (m[i] & 1), aggregate(slice(m, i + 1, till - i), 0, (acc, x) -> acc + 1 - 2 * (x & 1)))"
    runs = f"named_struct('at', transform(q, i -> shiftright(m[i], 1)), 'v', zip_with(q, concat(slice(q, 2, size(q)), array(size(m))), (i, till) -> {own}))"
    none = "named_struct('at', cast(array() as array<int>), 'v', cast(array() as array<int>))"
    return f"transform(array({slots}), m -> if(size(m) = 0, {none}, transform(array({starts}), q -> {runs})[0]))[0]"


def touched_lanes_of(text: str) -> str:
    """SQL for struct(plain, s) of column `text`: the PLAIN lanes, and struct(at, v) of the signed ones that pieces touch."""
    lines = f"filter(split({text}, '\\n'), x -> x <> '')"
    total = lambda own: _wrapped(f"aggregate(z.l, 0L, (acc, x) -> acc + {own})")
    sums = [total(half) for h in ("xxhash64(x)", "xxhash64('paragraph', x)") for half in (f"({h} & 4294967295L)", f"shiftrightunsigned({h}, 32)")]
    plain = f"array({', '.join(sums)}, {_wrapped('size(z.l)')}, {_wrapped('size(z.p)')})"
    return f"transform(array(named_struct('l', {lines}, 'p', {pieces_of(text)})), z -> named_struct('plain', {plain}, 's', {touched_lanes('z.p')}))[0]"


#: SQL for the lanes without a piece between the lane k, the j-th of s.at, and the one before it, and for those after the last.
_GAP = "k - if(j = 0, 0, s.at[j - 1] + 1)"
_REST = f"{LANES - 1} - s.at[size(s.at) - 1]"


def signed_array(touched: str) -> str:
    """SQL for all signed lanes as an array, from struct(at, v) of those that pieces touch."""
    runs = f"concat(flatten(transform(s.at, (k, j) -> concat(array_repeat(0, {_GAP}), array(s.v[j])))), array_repeat(0, {_REST}))"
    return f"transform(array({touched}), s -> if(size(s.at) = 0, array_repeat(0, {LANES}), {runs}))[0]"


def signed_lanes(pieces: str) -> str:
    """SQL for all signed lanes of an array of pieces."""
    return signed_array(touched_lanes(pieces))


def touched_as_text(touched: str) -> Column:
    """What as_text() says of all lanes, from struct(plain, s) of touched_lanes_of(), without making an array of them."""
    runs = f"concat(array_join(transform(s.at, (k, j) -> concat(repeat('0,', {_GAP}), s.v[j])), ','), repeat(',0', {_REST}))"
    signed = f"transform(array({touched}.s), s -> if(size(s.at) = 0, concat('0', repeat(',0', {LANES - 1})), {runs}))[0]"
    return F.expr(f"concat(array_join(cast({touched}.plain as array<string>), ','), ',', {signed})")


def placed_lanes_of(text: str) -> Column:
    """struct(lanes, at) of column `text`: its lanes, an array of PLAIN + LANES integers, and the places of the signed
    ones that may differ from zero."""
    placed = f"named_struct('lanes', concat(o.plain, {signed_array('o.s')}), 'at', transform(o.s.at, k -> {PLAIN} + k))"
    return F.expr(f"transform(array({touched_lanes_of(text)}), o -> {placed})[0]")


def lanes_of(text: str) -> Column:
    """The lanes of column `text`, an array of PLAIN + LANES integers."""
    return placed_lanes_of(text)["lanes"]


def as_text(lanes: str) -> Column:
    """The lanes as decimal numbers, joined by commas: equal just where all lanes are."""
    return F.array_join(F.col(lanes).cast("array<string>"), ",")


def used(lanes: str) -> str:
    """SQL for the places of the signed lanes that aren't zero."""
    return f"filter(sequence({PLAIN}, {PLAIN + LANES - 1}), i -> {lanes}[i] <> 0)"


def product(a: str, b: str, at: str) -> str:
    """SQL for the inner product of two texts' lanes over the places `at`."""
    return f"aggregate({at}, 0D, (acc, i) -> acc + cast({a}[i] as double) * {b}[i])"


def likeness(a: str, b: str) -> Column:
    """Twice the inner product of the texts' counts of pieces by the sum of the counts' squares, as
    the signed lanes estimate it; 0 where that is negative, and 1 for equal lanes. Only lanes that are used()
    add to it."""
    used_a = used(a)
    squares = f"({product(a, a, used_a)} + {product(b, b, used(b))})"
    return F.expr(f"case when {a} = {b} then 1D else least(1D, greatest(0D, coalesce(2 * {product(a, b, used_a)} / nullif({squares}, 0D), 0D))) end")


def touched_likeness(a: str, b: str, lanes: str) -> Column:
    """likeness() of struct(plain, s) columns with their `_squares`; `lanes` has all signed lanes of `a`.

    Texts of equal hash sums and numbers of paragraphs have equal paragraphs, and so equal lanes.
    """
    both = f"aggregate(zip_with({b}.s.at, {b}.s.v, (k, x) -> cast({lanes}[k] as double) * x), 0D, (acc, y) -> acc + y)"
    return F.expr(f"case when {a}.plain = {b}.plain then 1D else least(1D, greatest(0D, coalesce(2 * {both} / nullif({a}_squares + {b}_squares, 0D), 0D))) end")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and `after` of every row: the text of the next row in ascending doc_id order, the
    first row's after the last.

    Rows cross one shuffle, by block (a range of doc_id). Of each block only the first row goes to another block.
    """
    spark = docs.sparkSession
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    blocks = 4 * shuffle_partitions(spark)
    #: As many numbers as there are blocks.
    bounds = rows.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 10 * blocks).alias("x")).first()["x"] or []
    bounds = sorted(set(bounds))
    found = F.lit(0)
    if bounds:
        constant = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        found = F.coalesce(F.size(F.filter(constant, lambda b: b < F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("block", found)
    order = [F.asc_nulls_first("doc_id"), F.asc("th")]
    w = Window.partitionBy("block").orderBy(*order)
    first = rows.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", "th")).alias("f"))
    first = first.select("block", F.col("f.doc_id").alias("f_id"), F.col("f.th").alias("f_th"))
    texts = rows.withColumnRenamed("block", "b").join(F.broadcast(first), F.expr("b = block and doc_id <=> f_id and th = f_th")).groupBy("block").agg(F.min("text").alias("text"))
    one = Window.orderBy("block")
    #: One row for each block.
    edges = texts.select("block", F.coalesce(F.lead("text").over(one), F.first("text").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    placed = rows.withColumn("after", F.lead("text").over(w))
    return placed.join(edges, "block").select("doc_id", "text", F.coalesce("after", "edge").alias("after"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, lanes and fingerprint of every row; null texts count as empty. No row moves."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.select("doc_id", lanes_of("text").alias("lanes")).withColumn("fingerprint", as_text("lanes"))


def inserted(lanes: str, more: str) -> Column:
    """The lanes after adding a paragraph's (or a text's) own lanes."""
    return F.expr(f"zip_with({lanes}, {more}, (x, y) -> {_wrapped('cast(x as bigint) + y')})")


def deleted(lanes: str, less: str) -> Column:
    """The lanes after taking a paragraph's (or a text's) own lanes away."""
    return F.expr(f"zip_with({lanes}, {less}, (x, y) -> {_wrapped('cast(x as bigint) - y')})")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones (or
    all) of the next document. Null texts count as empty. Rows are in ascending doc_id order, null
    first; rows that repeat a doc_id are in the order of their texts' hashes, each a document. A
    table of one row has itself as the next document. All but the order is made row by row: the next
    document's lanes are made anew from its text, so that no lanes are sorted or shuffled.
    """
    rows = in_order(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("after", F.lit(1), half)))
    kinds = (("text", "own"), ("edited", "changed"), ("after", "next"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[F.expr(touched_lanes_of(c)).alias(name) for c, name in kinds])
    squares = [F.expr(f"aggregate({name}.s.v, 0D, (acc, x) -> acc + cast(x as double) * x)").alias(f"{name}_squares") for _, name in kinds]
    rows = rows.select("*", F.expr(signed_array("own.s")).alias("lanes"), *squares)
    near = [touched_likeness("own", name, "lanes").alias(f"near_{kind}") for name, kind in (("changed", "edited"), ("next", "next"))]
    return rows.select("doc_id", "n_chars", "edited_sha256", touched_as_text("own").alias("fingerprint"), touched_as_text("changed").alias("edited_fingerprint"), *near)
