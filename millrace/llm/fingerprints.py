"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame operations only.

A text's paragraphs are its lines, cut at each sentence end and after WIDTH characters; a text of fewer than FEW of them
has its words as well, so that two short texts of which one half is equal share something. Each distinct paragraph has a
64-bit digest, which goes into one cell of each of three tables of W cells: a cell holds how many digests it has, their
XOR, and the XOR of their check hashes. Sketches are kept as their cells that aren't empty, in order, so building,
folding and subtracting are all one merge of cells by number (`combine`).

A fingerprint is the sketch of a text at a width W that grows with its paragraphs (3 * W cells are eight times as many at
least), so it gives its own digests away as well. Two fingerprints are folded to the smaller width, subtracted and
peeled: a cell with one digest gives it away, taking it out of its other cells frees more. Where peeling fails, the
difference is tried again in larger sketches, of a width for all digests of both texts, and of four times that; where
two digests share all cells even there (one pair in billions), the digests themselves are compared. So the likeness is
always exact: 1 - differing digests / digests of both (1 where neither has any).

Defined cases: null text is empty, and an empty text has no paragraphs; equal texts have equal fingerprints; a very long
text has a wide fingerprint (at most 2^20 cells a table); repeated doc_ids follow in the order of the hash of their texts;
null doc_ids come last; an empty table gives no rows; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import documents, partitions

WIDTH, FEW = 240, 8
#: Cells of a table, at least and at most (powers of two).
LEAST, MOST = 16, 1 << 20
#: Rounds of peeling; each frees all cells that have one digest.
ROUNDS = 24
#: Cells left that are looked for one by one; more are merged with all.
SCANNED = 256


def paragraphs(text: str) -> Column:
    """The distinct paragraphs' digests."""
    cut = rf"regexp_extract_all({text}, '[^\n][^\n.!?]{{0,{WIDTH - 1}}}[.!?]*', 0)"
    said = f"transform(regexp_extract_all({text}, '[^\\\\s]+', 0), w -> xxhash64(w, 'word'))"
    digests = f"transform(array({cut}), c -> concat(transform(c, p -> xxhash64(trim(p))), if(size(c) < {FEW}, {said}, array())))[0]"
    return F.expr(f"array_distinct({digests})")


def width(n: str) -> str:
    """The width for n digests, as SQL."""
    return f"cast(least({MOST}, greatest({LEAST}, pow(2, ceil(log2(greatest({n}, 1) * 8.0D / 3))))) as bigint)"


def _check(k: str) -> str:
    return f"shiftrightunsigned(xxhash64({k}, 1), 32)"


def _cells_of(k: str, w: str, c: str) -> str:
    """The three cells (j, c, k, h) that a digest k is in, c times. A cell's number j is its place times 3, plus its table."""
    one = ", ".join(f"named_struct('j', (shiftrightunsigned(e.e, {20 * t}) & ({w} - 1)) * 3 + {t}, 'c', {c}, 'k', {k}, 'h', e.h)" for t in range(3))
    return f"transform(array(named_struct('e', xxhash64({k}), 'h', {_check(k)})), e -> array({one}))[0]"


def entries(digests: str, w: str, sign: int = 1) -> str:
    return f"flatten(transform({digests}, d -> {_cells_of('d', w, f'{sign}L')}))"


def combine(cells: str) -> str:
    """Cells in order, those of one number merged, empty ones left out. (transform(array(x), y -> ...)[0] binds x.)"""
    last = "coalesce(get(starts, r + 1), size(s)) - i"
    merged = "aggregate(slice(s, i + 1, %s), named_struct('j', s[i].j, 'c', 0L, 'k', 0L, 'h', 0L), (a, x) -> named_struct('j', a.j, 'c', a.c + x.c, 'k', a.k ^ x.k, 'h', a.h ^ x.h))" % last
    runs = f"filter(transform(starts, (i, r) -> if({last} = 1, s[i], {merged})), x -> x.c != 0 or x.k != 0 or x.h != 0)"
    starts = "filter(sequence(0, size(s) - 1), i -> i = 0 or s[i].j != s[greatest(i - 1, 0)].j)"
    return f"transform(array(sort_array({cells})), s -> if(size(s) = 0, s, transform(array({starts}), starts -> {runs})[0]))[0]"


def fold(cells: str, w: str) -> str:
    """A sketch at a smaller width: its cells under their new numbers, not yet merged."""
    return f"transform({cells}, x -> named_struct('j', ((x.j div 3) & ({w} - 1)) * 3 + x.j % 3, 'c', x.c, 'k', x.k, 'h', x.h))"


def negated(cells: str) -> str:
    return f"transform({cells}, x -> named_struct('j', x.j, 'c', -x.c, 'k', x.k, 'h', x.h))"


def peel(diff: str, w: str) -> str:
    """struct: found, the digests (c, k) that peeling recovers from a difference of sketches, c being 1 or -1 by the side
    that has them, and whole, whether these are all. In a round, the digests of all cells that have one come out, and are
    taken out of their other cells; where few cells are left, only those of them that are meant are merged."""
    one = f"abs(x.c) = 1 and x.h = {_check('x.k')}"
    side = lambda c: f"array_distinct(transform(filter(st.cells, x -> x.c = {c} and x.h = {_check('x.k')}), x -> x.k))"
    gone = lambda side, c: f"flatten(transform(got.{side}, k -> {_cells_of('k', w, c)}))"
    out = f"concat({gone('plus', '-1L')}, {gone('minus', '1L')})"
    few = combine(f"concat(got.rest, transform(array(transform(got.rest, x -> x.j)), js -> filter({out}, x -> array_contains(js, x.j)))[0])")
    left = f"if(size(got.rest) = 0, got.rest, if(size(got.rest) <= {SCANNED}, {few}, {combine(f'concat(st.cells, {out})')}))"
    found = "concat(st.found, transform(got.plus, k -> named_struct('c', 1L, 'k', k)), transform(got.minus, k -> named_struct('c', -1L, 'k', k)))"
    got = f"named_struct('plus', {side('1')}, 'minus', {side('-1')}, 'rest', filter(st.cells, x -> not ({one})))"
    step = f"if(size(st.cells) = 0, st, transform(array({got}), got -> if(size(got.plus) + size(got.minus) = 0, st, named_struct('cells', {left}, 'found', {found})))[0])"
    run = f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {diff}, 'found', cast(array() as array<struct<c: bigint, k: bigint>>)), (st, round) -> {step})"
    return f"transform(array({run}), z -> named_struct('found', z.found, 'whole', size(z.cells) = 0))[0]"


def likeness(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """Adds the column name, the likeness of the fingerprints of two texts, and name_tries: how many sizes of sketches it
    took, 4 where the digests themselves were compared. a and b name columns: x (digests), x_n, x_w (width), x_cells."""
    low, both = f"least({a}_w, {b}_w)", f"({a}_n + {b}_n)"
    large = width(both)
    tried = [f"_{name}_{i}" for i in range(3)]
    peeled = lambda cells, w: f"transform(array({peel(cells, w)}), z -> if(z.whole, size(z.found), null))[0]"
    # the counts tell about how many digests differ (a sum of squares, less what the surplus of one side adds), and sizes
    # how many at least; where that is more than a sketch of this width gives away, it is not peeled
    about = f"(aggregate(diff, 0L, (s, x) -> s + x.c * x.c) / 3.0D - pow({a}_n - {b}_n, 2) / _low)"
    first = F.expr(f"abs({a}_n - {b}_n) <= 2.4D * {low}")
    df = df.withColumn("_low", F.expr(low)).withColumn("_large", F.expr(large))
    folded = combine(f"concat({fold(f'{a}_cells', '_low')}, {negated(fold(f'{b}_cells', '_low'))})")
    df = df.withColumn(tried[0], F.when(first, F.expr(f"transform(array({folded}), diff -> if({about} <= 2.4D * _low, {peeled('diff', '_low')}, null))[0]")))
    open_ = F.col(tried[0]).isNull()
    for i, w in ((1, "_large"), (2, f"least({MOST}, _large * 4)")):
        df = df.withColumn("_w", F.expr(w))
        df = df.withColumn(tried[i], F.when(open_, F.expr(peeled(combine(f"concat({entries(a, '_w')}, {entries(b, '_w', -1)})"), "_w")))).drop("_w")
        open_ = open_ & F.col(tried[i]).isNull()
    apart = F.when(open_, F.expr(f"size(array_except({a}, {b})) + size(array_except({b}, {a}))"))
    n = F.coalesce(*tried, apart)
    tries = F.when(F.col(tried[0]).isNotNull(), 1).when(F.col(tried[1]).isNotNull(), 2).when(F.col(tried[2]).isNotNull(), 3).otherwise(4)
    out = df.withColumn(f"{name}_tries", tries).withColumn(name, F.when(F.expr(both) == 0, F.lit(1.0)).otherwise(1 - n / F.greatest(F.expr(both), F.lit(1))))
    return out.drop("_low", "_large", *tried)


def text_form(x: str) -> Column:
    """A fingerprint as text: width, number of digests, then each cell that isn't empty: number, count, XOR and check in
    hexadecimal."""
    cell = f"transform({x}_cells, y -> concat_ws('.', y.j, y.c, hex(y.k), hex(y.h)))"
    return F.expr(f"concat({x}_w, ':', {x}_n, ':', array_join({cell}, ','))")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), bucket and place, sorted within buckets: runs of descending doc_id, of about equal
    numbers of rows. A bucket ends with a copy (ghost = true) of the row that comes after it; the last with the first.

    Bounds come from quantiles of doc_id; buckets are a few per shuffle partition, so what the driver holds depends on
    the cluster's settings alone. The text is dealt out once."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("double").alias("d"))
    n = 8 * partitions(spark)
    found = ids.where("d is not null").approxQuantile("d", [i / n for i in range(1, n)], 1 / (4 * n))
    bounds = sorted({-x for x in found})
    # the bucket of a row: how many bounds are below -doc_id, counted in two steps
    group = 64
    heads = bounds[::group]
    down = -F.col("doc_id").cast("double")
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs]) if xs else F.expr("cast(array() as array<double>)")
    lead = F.size(F.filter(lit(heads), lambda b: b < down)) - 1
    within = F.size(F.filter(F.slice(lit(bounds), lead * group + 1, F.lit(group)), lambda b: b < down))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.when(lead < 0, F.lit(0)).otherwise(lead * group + within))
    tops = {r["bucket"]: r["top"] for r in docs.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    filled = sorted(tops)
    before = {b: a for a, b in pairwise(filled)} | ({filled[0]: filled[-1]} if filled else {})
    size = len(bounds) + 2
    top = F.array(*[F.lit(tops.get(b)).cast("long") for b in range(size)])
    prev = F.array(*[F.lit(before.get(b)).cast("int") for b in range(size)])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), bucket.alias("home"))
    is_top = F.col("doc_id").eqNullSafe(F.get(top, F.col("home")))
    here = F.struct(F.col("home").alias("bucket"), F.lit(False).alias("ghost"))
    there = F.struct(F.get(prev, F.col("home")).alias("bucket"), F.lit(True).alias("ghost"))
    dealt = rows.withColumn("at", F.explode(F.when(is_top, F.array(here, there)).otherwise(F.array(here))))
    return dealt.select("doc_id", "text", "at.bucket", "at.ghost", F.xxhash64("text").alias("text_hash"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The rows of docs with their fingerprints, those of their edited texts, and the likenesses."""
    in_bucket = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text_hash")
    df = with_next(docs).withColumn("next", F.lead("text").over(in_bucket))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("next")
    df = df.select("doc_id", "bucket", "ghost", "text_hash", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraphs("text").alias("own"), paragraphs("edited").alias("other"))
    sketched = lambda df, x: df.withColumn(f"{x}_n", F.size(x).cast("long")).withColumn(f"{x}_w", F.expr(width(f"{x}_n"))).withColumn(f"{x}_cells", F.expr(combine(entries(x, f"{x}_w"))))
    df = sketched(sketched(df, "own"), "other")
    for c in ("own", "own_n", "own_w", "own_cells"):
        df = df.withColumn(c.replace("own", "follows", 1), F.lead(c).over(in_bucket))
    df = likeness(likeness(df.where("not ghost"), "near_edited", "own", "other"), "near_next", "own", "follows")
    return df.select("doc_id", "n_chars", "edited_sha256", text_form("own").alias("fingerprint"), text_form("other").alias("edited_fingerprint"), "near_edited", "near_next", "near_edited_tries", "near_next_tries")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir).select("doc_id", "text"))
