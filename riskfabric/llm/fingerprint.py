"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (a long one in pieces) are hashed; each digest is added to one cell in each of three tables. A cell keeps how many digests it
holds and the XOR of them and of their check values, so sketches of two versions subtract cell by cell, which leaves the digests they do not share.
Peeling reads a digest from a cell that holds one alone and takes it out of its other cells, until nothing is left; a difference too large for the
tables leaves a rest, and is tried again with larger tables. Everything is a column expression or a hash aggregation over rows that are partitioned
by document beforehand, so cells and peeling rounds need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfabric.llm.shared import written

TABLES = 3
#: Cells per table of a fingerprint, factor of the next size, turns through the tables before a try counts as failed, and code points of a piece.
CELLS, GROWTH, TURNS, PIECE = 8, 8, 3, 128


def paragraphs(text: Column, piece: int = PIECE) -> Column:
    """Digests of the distinct paragraphs of a text, which line feeds separate; one of more than `piece` code points is cut into such pieces."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"[^\n]{{1,{piece}}}"), 0), lambda p: F.xxhash64(p)))


def _place(digest: Column, table: int, cells: int) -> Column:
    return F.lit(table * cells).cast("long") + F.pmod(F.xxhash64(digest, F.lit(table), F.lit(cells)), F.lit(cells))


def _tagged(name: str, version: int) -> Column:
    """The digests of a set as (version, digest)."""
    return F.transform(name, lambda x: F.struct(F.lit(version).alias("v"), x.alias("digest")))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def cells(rows: DataFrame, keys: list[str], digest: str, size: int) -> DataFrame:
    """Non-empty cells of the sketches of the digests under each key: keys, cell, n, ids, checks."""
    spread = rows.select(*keys, digest, F.explode(F.array(*[_place(F.col(digest), t, size) for t in range(TABLES)])).alias("cell"))
    return spread.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(digest).alias("ids"), F.bit_xor(_check(F.col(digest))).alias("checks"))


def _merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    summed = rows.groupBy(*keys, "found", "cell").agg(F.sum("n").alias("n"), F.bit_xor("ids").alias("ids"), F.bit_xor("checks").alias("checks"))
    return summed.where("n != 0 OR ids != 0 OR checks != 0")


def peel(difference: DataFrame, keys: list[str], size: int, turns: int = TURNS) -> DataFrame:
    """Rows of a subtracted sketch after peeling: found digests (`found`, n > 0 in the first text alone, n < 0 in the second) and the cells left.

    One table is peeled at a time: a digest lies in one of its cells, so it is never taken out twice.
    """
    row = lambda found, cell, n, ids, checks: F.struct(F.lit(found).alias("found"), cell.alias("cell"), n.alias("n"), ids.alias("ids"), checks.alias("checks"))
    n, ids, checks, cell = (F.col(c) for c in ("n", "ids", "checks", "cell"))
    rest = difference.withColumn("found", F.lit(False))
    for step in range(turns * TABLES):
        table = step % TABLES
        alone = ~F.col("found") & (F.abs(n) == 1) & (cell == _place(ids, table, size)) & (checks == _check(ids))
        same = F.struct("found", "cell", "n", "ids", "checks")
        out = F.array(row(True, ids, n, ids, F.lit(0).cast("long")), *[row(False, _place(ids, t, size), -n, ids, checks) for t in range(TABLES) if t != table])
        spread = rest.select(*keys, F.explode(F.when(alone, out).otherwise(F.array(same))).alias("r")).select(*keys, "r.*")
        rest = _merge(spread, keys)
    return rest


def likeness(first: Column, second: Column, different: Column) -> Column:
    """Shared digests as a share of all, from the sizes of two sets and the number of digests in one alone; two empty sets are alike."""
    return F.when(first + second == 0, 1.0).otherwise((first + second - different) / (first + second + different))


def compare(rows: DataFrame, key: str, first: str, others: list[str], size: int = CELLS, growth: int = GROWTH) -> DataFrame:
    """key, and for each other set of digests: `<other>_alone` (of the first), `<other>_new` (of the other): the digests that peeling recovered.

    `first` and `others` are arrays of distinct digests; `key` is unique. Each try subtracts sketches of one size and hands what did not peel to the
    next, `growth` times larger, until nothing is left. Rows are partitioned by key once per try, and only those still open; what a try writes
    are its findings, not the sets.
    """
    number = {name: i for i, name in enumerate(others)}
    sets, done, width = rows.select(key, first, *others), [], size
    spread = sets.withColumn("_open", F.array(*[F.lit(i) for i in number.values()])).repartition(F.col(key))
    while True:
        version = [_tagged(first, -1)]
        version += [F.when(F.array_contains("_open", i), _tagged(name, i)).otherwise(
            F.array().cast("array<struct<v:int,digest:bigint>>")) for name, i in number.items()]
        digests = spread.select(key, "_open", F.explode(F.concat(*version)).alias("d")).select(key, "_open", "d.*")
        sketch = cells(digests, [key, "_open", "v"], "digest", width)
        sides = F.when(F.col("v") == -1, F.col("_open")).otherwise(F.array("v"))
        signed = sketch.withColumn("side", F.explode(sides)).withColumn("n", F.when(F.col("v") == -1, F.col("n")).otherwise(-F.col("n"))).withColumn("found", F.lit(False))
        rest = peel(_merge(signed.select(key, "side", "found", "cell", "n", "ids", "checks"), [key, "side"]).drop("found"), [key, "side"], width)
        ends = rest.groupBy(key, "side").agg(
            F.count_if(~F.col("found")).alias("left"), F.collect_list(F.when(F.col("found") & (F.col("n") > 0), F.col("cell"))).alias("alone"),
            F.collect_list(F.when(F.col("found") & (F.col("n") < 0), F.col("cell"))).alias("new"))
        ends = ends.groupBy(key).agg(F.collect_list(F.struct("side", "left", "alone", "new")).alias("_ends"))
        tried = written(spread.select(key, "_open").join(ends, key, "left").withColumn("_ends", F.coalesce("_ends", F.array().cast("array<struct<side:int,left:bigint,alone:array<bigint>,new:array<bigint>>>"))), "peeled")
        failed = F.transform(F.filter("_ends", lambda e: e["left"] > 0), lambda e: e["side"])
        closed = F.array_except("_open", failed)
        done.append(tried.select(key, F.explode(closed).alias("side"), "_ends").select(key, "side", F.get(F.filter("_ends", lambda e: e["side"] == F.col("side")), F.lit(0)).alias("e")))
        still_open = tried.where(F.size(failed) > 0).select(key, failed.alias("_open"))
        if still_open.isEmpty():
            break
        # Merged by key, so the rows are partitioned for the next try.
        spread = sets.hint("merge").join(still_open, key)
        width *= growth
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    none = F.array().cast("array<bigint>")
    pick = lambda i, field: F.coalesce(F.first(F.when(F.col("side") == i, F.coalesce(F.col(f"e.{field}"), none)), ignorenulls=True), none)
    return ended.groupBy(key).agg(*[pick(i, field).alias(f"{name}_{field}") for name, i in number.items() for field in ("alone", "new")])


def sketch_text(rows: DataFrame, key: str, sets: list[str], size: int = CELLS) -> DataFrame:
    """key and, per set, its fingerprint as text: the number of digests, then the non-empty cells in order. Equal sets have equal fingerprints."""
    version = [_tagged(name, i) for i, name in enumerate(sets)]
    digests = rows.select(key, F.explode(F.concat(*version)).alias("d")).select(key, "d.*")
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    cell = F.struct("cell", F.concat_ws(".", F.col("cell").cast("string"), F.col("n").cast("string"), hexed(F.col("ids")), hexed(F.col("checks"))).alias("text"))
    lists = cells(digests, [key, "v"], "digest", size).groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("v") == i, cell))).alias(f"_{i}") for i in range(len(sets))])
    joined = rows.join(lists, key, "left")
    return joined.select(*rows.columns, *[F.concat(F.size(name).cast("string"), F.lit(":"), F.coalesce(F.array_join(F.transform(f"_{i}", lambda c: c["text"]), ","), F.lit(""))).alias(f"{name}_fingerprint")
                                          for i, name in enumerate(sets)])


def with_next(documents: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """All documents with `row` (unique), `text` (missing: empty) and `next_text`: the text of the next document by ascending key, of the first after the last.

    Rows are dealt into ranges of the key; a window inside a range finds the next row, and the first rows of the ranges (a row each) bridge them.
    Missing keys come first; rows of equal keys are ordered by text. Other columns are not kept.
    """
    spark = documents.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    bounds = sorted(set(bounds))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    rows = rows.withColumn("part", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(part))
    order = Window.partitionBy("part").orderBy(F.col(key).asc_nulls_first(), "text")
    rows = rows.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("following"))
    firsts = rows.where("place = 1").select("part", "text")
    whole = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("text").over(whole), F.first("text").over(whole)).alias("bridge"))
    row = F.col("part").cast("long") * F.lit(1 << 40) + F.col("place")
    return rows.join(after, "part").select(row.alias("row"), key, "text", F.coalesce("following", "bridge").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many code points, or all, of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.char_length(text) - half), F.substr(following, F.lit(1), half))
