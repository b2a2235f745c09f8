"""Leader clustering of stories and their roll-up."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskfabric import vocabulary as V
from riskfabric.functions import places, tone
from riskfabric.functions.text import (blank, contains_any, fact_variance, labels_present, numbers, phrase, plural, sentence_case,
                                       story_words, summary_text)
from riskfabric.operators import pairing
from riskfabric.operators.match import event_features, matches, with_event_features
from riskfabric.operators.store import latest_per_key, top_per_key
from riskfabric.session import cut, kept

LARGEST_BATCH = 1000  # keeps the partial group limit of Spark in effect


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Seeds of one ordered batch: a row is a seed when none of its earlier neighbours is one."""
    seeds, chosen = set(), []
    for rank, earlier in sorted(zip(pdf["rank"], pdf["earlier"])):
        if not seeds.intersection(earlier):
            seeds.add(rank)
            chosen.append(rank)
    kept = pdf[pdf["rank"].isin(chosen)]
    return kept[["rep"]]


def leader_clusters(items: DataFrame, block, item="item_id", time="published_at", tie="url", headline="headline", days=7,
                    first_batch=64, ratio=True) -> DataFrame:
    """Assign every item to the earliest matching seed, newest items first: (item, seed).

    The result equals the sequential rule "join the first cluster whose seed describes the same event within
    ``days``, else open a cluster" (``days=None``: no time bound). Items are compared with seeds only;
    items with the same event features (and time) are one candidate, however many copies exist.

    A block of up to ONE_TASK candidates is walked in order by one task (``pairing.leaders``). Larger ones go through rounds, which end when nothing is undecided:

    * per round, the next rows in order of every block form a small batch whose seeds are found exactly;
    * all undecided rows are matched with the new seeds through an index of words and anchors (see ``match.matches``) and leave when they match.

    No row, pair or partner is dropped. ``ratio=False`` leaves the sequence ratio out of the rule.
    """
    block = list(block)
    span = None if days is None else days * 86_400_000_000
    rows = items.withColumns({"f": event_features(F.col(headline)), "__t": F.unix_micros(F.col(time).cast("timestamp"))})
    # fixed-size digest of the event identity; the time joins it only when it matters
    rows = rows.withColumn("__sig", F.sha2(F.concat_ws("\u0001", F.array_join("f.tokens", " "), F.col("f.armed").cast("string"),
                                                      *([blank(F.col("__t").cast("string"))] if span is not None else [])), 256))
    order = F.struct(F.coalesce(F.col("__t"), F.lit(-(2 ** 62))).alias("t"), blank(F.col(tie)).alias("tie"), F.col(item).alias("id"))
    rows = kept(rows.select(*block, F.col(item), F.col(tie), F.col(headline).alias("__head"), "__t", "__sig", "f"), "items")  # headlines are turned into features once
    reps = rows.groupBy(*block, "__sig").agg(F.max_by(F.struct(F.col(item).alias("rep"), order.alias("o"), F.col("__t").alias("t"), "__head", "f"), order).alias("r"))
    reps = kept(reps.select(*block, "__sig", "r.rep", "r.o", "r.t", "r.__head", "r.f"), "candidates")
    sizes = kept(reps.groupBy(*block).agg(F.count("*").alias("n")), "block-sizes")
    keyed = _walked(reps.join(sizes.filter(F.col("n") <= ONE_TASK).drop("n"), block), block, span, ratio, max(1, sizes.count()))
    large = sizes.filter(F.col("n") > ONE_TASK).drop("n")
    if not large.isEmpty():
        keyed = keyed.unionByName(_rounds(reps.join(large, block), block, span, ratio, first_batch))
    return rows.select(*block, "__sig", F.col(item)).join(keyed, block + ["__sig"]).select(item, "seed")


ONE_TASK = 16384  # candidates of a block that one task walks


def _walked(reps: DataFrame, block, span, ratio, blocks) -> DataFrame:
    """Seeds of the candidates of blocks, a block a task: (block…, __sig, seed)."""
    kind = lambda c: T.StructField(c, reps.schema[c].dataType)
    kinds = T.StructType([*map(kind, block), kind("__sig"), T.StructField("seed", reps.schema["rep"].dataType)])
    schema = to_arrow_schema(kinds)

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__o", "descending"), ("__tie", "descending"), ("rep", "descending")]).combine_chunks()
        events = pairing.Events(pairing.flat(rows.column("tokens")), pairing.flat(rows.column("armed")))
        when = pairing.flat(rows.column("t"))
        seeds = pa.array(pairing.leaders(events, events.number, when.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), len(when) - when.null_count, span, ratio))
        return pa.table([*(rows.column(c) for c in [*block, "__sig"]), rows.column("rep").take(seeds)], names=schema.names).cast(schema)

    slim = reps.select(*block, "__sig", "rep", F.col("o.t").alias("__o"), F.col("o.tie").alias("__tie"), "t", "f.tokens", "f.armed")
    return slim.repartition(min(blocks, 1000), *block).groupBy(*block).applyInArrow(walk, kinds)


def _rounds(reps: DataFrame, block, span, ratio, first_batch) -> DataFrame:
    """Seeds of the candidates of blocks of any size, a batch of every block a round: (block…, __sig, seed)."""
    kind = reps.schema["rep"].dataType.simpleString()
    reps = undecided = kept(with_event_features(reps.drop("f"), "__head").drop("__head"), "featured")
    decided, size = [], first_batch
    while True:
        batch = cut(top_per_key(undecided, block, [F.desc("o")], size, "rank"))
        if batch.isEmpty():
            break
        earlier = batch.select(*block, F.col("rank").alias("rank_b"), F.col("f").alias("b"), F.col("t").alias("t_b"))
        later = batch.select(*block, "rep", "rank", F.col("f").alias("a"), F.col("t").alias("t_a"))
        edges = matches(later, earlier, block, span, ratio, where=F.col("rank_b") < F.col("rank"))  # a bounded batch per block
        edges = edges.groupBy("rep").agg(F.collect_list("rank_b").alias("earlier"))
        nodes = batch.select(*block, "rep", "rank").join(edges, "rep", "left").withColumn("earlier", F.coalesce("earlier", F.array().cast("array<int>")))
        seeds = nodes.groupBy(*block).applyInPandas(_greedy, f"rep {kind}")
        seeds = cut(batch.join(seeds, "rep", "left_semi").select(*block, F.col("rep").alias("seed"), F.col("o").alias("o_b"), F.col("t").alias("t_b"), F.col("f").alias("b")))
        open_items = undecided.select(*block, "rep", "o", F.col("t").alias("t_a"), F.col("f").alias("a"))
        star = matches(open_items, seeds, block, span, ratio, where=F.col("o_b") > F.col("o"))
        hits = star.groupBy("rep").agg(F.max_by("seed", "o_b").alias("seed"))
        own = seeds.select(F.col("seed").alias("rep"), "seed")
        step = cut(hits.join(own.select("rep"), "rep", "left_anti").unionByName(own))
        decided.append(step)
        undecided = cut(undecided.join(step.select("rep"), "rep", "left_anti"))
        size = min(LARGEST_BATCH, size * 2)
    assigned = decided[0]
    for step in decided[1:]:
        assigned = assigned.unionByName(step)
    return reps.select(*block, "__sig", "rep").join(assigned, "rep").select(*block, "__sig", "seed")


def roll_up(items: DataFrame, clusters: DataFrame, block=("country", "category"), item="item_id", time="published_at", tie="url") -> DataFrame:
    """One story per cluster: newest item, one source per family (newest first), scope label, summary."""
    joined = items.join(clusters, item)
    family = F.coalesce(F.nullif(F.col("source_family"), F.lit("")), places.source_family(F.col("publisher"), F.coalesce("source_home", "url")))
    joined = joined.withColumn("source_family", family)
    order = [time, tie]
    per_family = latest_per_key(joined.select("seed", "source_family", "publisher", "url", "source_home", "coverage_scope", "source_type", "headline", "country", time),
                                ["seed", "source_family"], [time, "url"])
    origin = F.when((F.col("origin_country") == "Origin unverified") & (F.col("coverage_scope") == "Local / regional"),
                    F.concat("country", F.lit(" (local-edition inference)"))).otherwise(F.col("origin_country"))
    located = places.with_source_origin(per_family, places.country_dimension(items.sparkSession)).withColumn("origin_country", origin)
    entry = F.struct(F.col(time).alias("t"), F.col("url").alias("u"), F.struct(
        "publisher", "url", "origin_country", "coverage_scope", F.coalesce("source_type", F.lit("News reporting")).alias("source_type"), "source_family",
        F.lit(None).cast("string").alias("indexed_by"), "headline", tone.tone(F.col("headline")).alias("tone")).alias("s"))
    sources = located.groupBy("seed").agg(F.transform(F.sort_array(F.collect_list(entry), asc=False), lambda e: e["s"]).alias("sources"))
    newest = latest_per_key(joined, ["seed"], order)
    story = newest.drop("coverage_scope").join(sources, "seed")
    scopes = F.array_distinct(F.transform("sources", lambda s: s["coverage_scope"]))
    base = summary_text(F.col("country"), F.col("category"), F.col("headline"), F.col("publisher"), F.col("description"))
    return (story.withColumn("coverage_scope", F.when(F.size(scopes) > 1, "Local + international").otherwise(F.coalesce(F.get(scopes, F.lit(0)), F.lit("International"))))
                 .withColumn("summary", F.concat(base, _matched_sentence())))


def _matched_sentence() -> Column:
    n = F.size("sources")
    return F.concat(F.lit(" This update was matched across "), n.cast("string"), F.lit(" reporting "), plural(n, "source"), F.lit("."))


def merge_sources(stories: DataFrame, additions: DataFrame, key="article_id", block=("country",), days=7, ratio=True) -> DataFrame:
    """Append sources of the same event from new families, newest addition per family.

    Only the newest match of a family counts. Stories and additions of a block and time slot meet in cells (``_slice``), where every story walks its window from the newest end until a
    family is found. Where the sequence ratio is left out and words are selective, so that pairs meet less often in the index of words and anchors than in their block, they meet there.
    """
    span, block = days * 86_400_000_000, list(block)
    added = ["publisher", "url", "coverage_scope", "source_type", "source_family", "indexed_by", "headline"]
    when = lambda name: F.unix_micros(F.col("published_at").cast("timestamp")).alias(name)
    seen = F.transform("sources", lambda x: x["source_family"]).alias("__seen")
    f = event_features(F.col("headline"))
    a = kept(additions.select(*block, *added, when("t_b"), f.alias("b")), "additions")
    s = kept(stories.select(*block, key, F.col("headline").alias("__head"), when("t_a"), seen, f.alias("a")), "stories")
    one = None
    if not ratio:
        per = lambda df, n, *by: df.groupBy(*by).agg(F.count("*").alias(n))
        met = lambda df, other, *by: per(df, "m", *by).join(per(other, "n", *by), list(by)).agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0  # one number
        a_keys, s_keys = kept(with_event_features(a, into="b"), "keyed"), kept(with_event_features(s, "__head", "a"), "keyed")
        keys = lambda df, f: df.select(*block, F.explode(f"{f}.keys").alias("__k"))
        if met(keys(s_keys, "a"), keys(a_keys, "b"), *block, "__k") * INDEXED < met(s, a, *block):
            packed = a_keys.select(*block, F.struct(*added).alias("__added"), F.col("url").alias("__u"), "t_b", "b")
            found = matches(s_keys, packed, block, span, ratio, where=~F.array_contains("__seen", F.col("__added.source_family")))
            one = found.select(key, F.struct("__added", "__head").alias("x"), F.col("t_b"), "__u")
    if one is None:
        one = _slice(s, a, block, span, 0, 2 * span + 1, ratio).select(key, F.struct(F.struct(*added).alias("__added"), "__head").alias("x"), "t_b", F.col("url").alias("__u"))
    one = one.repartition(F.col(key)).groupBy(key, F.col("x.__added.source_family").alias("__family")).agg(F.max_by("x", F.struct("t_b", "__u")).alias("x"))
    fresh = one.withColumn("__variance", fact_variance(F.col("x.__head"), F.col("x.__added.headline")))
    element = stories.schema["sources"].dataType.elementType
    def value(field):
        if field.name == "fact_variance":
            return F.col("__variance").alias(field.name)
        if field.name == "tone":
            return tone.tone(F.col("x.__added.headline")).alias(field.name)
        given = ("publisher", "url", "coverage_scope", "source_type", "source_family", "indexed_by", "headline")
        return (F.col(f"x.__added.{field.name}") if field.name in given else F.lit(None)).cast(field.dataType).alias(field.name)
    grouped = fresh.select(key, "__variance", "x", "__family").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("__family", F.struct(*[value(f) for f in element.fields]).alias("s"), "__variance"))).alias("__new"))
    merged = stories.join(grouped, key, "left")
    new = F.coalesce("__new", F.array().cast(grouped.schema["__new"].dataType))
    return (merged.withColumn("sources", F.concat("sources", F.transform(new, lambda e: e["s"])))
                  .withColumn("fact_variances", F.filter(F.transform(new, lambda e: e["__variance"]), lambda v: v != "")).drop("__new"))


INDEXED = 4  # a pair in the index of words and anchors costs about as much as so many in a cell
STORIES, ADDITIONS = 8192, 32768  # stories and additions of a cell at most


def _slice(stories: DataFrame, additions: DataFrame, block, span, since, width, ratio) -> DataFrame:
    """Newest matching addition per story and family that it has not seen, of those that lie ``since`` to ``since + width`` before the end of the story's window.

    The key of a cell is the block and the span-wide slot of the story's time; additions are copied to the slots beside theirs, and cells beyond STORIES by ADDITIONS are dealt to several, so
    a (story, family) may come once per share of the additions. What has no time is near everything and meets its block in cells of its own.
    """
    block, slots = list(block), F.array(*[F.floor(F.col("t_b") / span) + i for i in (-1, 0, 1)])
    key = next(c for c in stories.columns if c not in [*block, "__head", "t_a", "__seen", "a"])
    timeless, waiting = F.lit(-(2 ** 62)).cast("bigint"), F.lit(-(2 ** 62) + 1).cast("bigint")  # cells of stories, and of additions, without a time
    left = stories.filter(F.col("__seen").isNotNull() & ~F.exists("__seen", lambda x: x.isNull()))
    right = additions.filter(F.col("source_family").isNotNull())
    untimed = right.filter("t_b IS NULL").limit(1).count() > 0, left.filter("t_a IS NULL").limit(1).count() > 0
    own = F.floor(F.col("t_a") / span)
    left = left.withColumn("__slot", F.explode(F.when(F.col("t_a").isNull(), F.array(timeless)).otherwise(F.array(own, waiting) if untimed[0] else F.array(own))))
    right = right.withColumn("__slot", F.explode(F.when(F.col("t_b").isNull(), F.array(timeless, waiting)).otherwise(F.concat(slots, F.array(timeless)) if untimed[1] else slots)))
    place = [*block, "__slot"]
    shares = lambda df, size, name: df.groupBy(*place).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    plan = kept(shares(left, STORIES, "__shares").join(shares(right, ADDITIONS, "__parts"), place), "cells")
    cells = plan.agg(F.sum(F.col("__shares") * F.col("__parts"))).first()[0] or 1  # one number
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda columns, n: F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")
    cell = [*place, "__share", "__part"]
    deal = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(min(int(cells), 1000), *cell).groupBy(*cell)  # both sides may come from one table
    left = left.join(plan, place).withColumn("__share", dealt([key], "__shares")).withColumn("__part", every("__parts")).drop("__shares", "__parts")
    right = right.join(plan, place).withColumn("__part", dealt(["url", "source_family", "headline"], "__parts")).withColumn("__share", every("__shares")).drop("__shares", "__parts")
    given = [c for c in additions.columns if c not in (*block, "b", "t_b")]
    kinds = T.StructType([T.StructField(c, stories.schema[c].dataType) for c in (key, "__head")] + [T.StructField(c, additions.schema[c].dataType) for c in (*given, "t_b")])
    schema = to_arrow_schema(kinds)

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        y = y.sort_by([("t_b", "descending"), ("url", "descending")]).combine_chunks()
        f, g = pairing.flat(x.column("a")), pairing.flat(y.column("b"))
        events = pairing.Events(pa.concat_arrays([f.field("tokens"), g.field("tokens")]), pa.concat_arrays([f.field("armed"), g.field("armed")]))
        families = pairing.flat(y.column("source_family")).dictionary_encode()
        listed = pairing.flat(x.column("__seen"))
        known = pc.index_in(listed.flatten(), value_set=families.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(x.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
        t_a, t_b = pairing.flat(x.column("t_a")), pairing.flat(y.column("t_b"))
        timed = y.num_rows - t_b.null_count
        older = -t_b.slice(0, timed).to_numpy(zero_copy_only=False).astype(np.int64)  # the newest first, what has no time last
        free = np.array(t_a.is_null()) if timed else np.ones(x.num_rows, bool)
        newest = t_a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + span - since
        first = np.where(free, 0, np.searchsorted(older, -newest, side="left"))
        last = np.where(free, y.num_rows, np.searchsorted(older, -newest + width, side="left"))
        item, at = pairing.newest_of_families(events, events.number[:x.num_rows], events.number[x.num_rows:], families.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                                              (owner[known >= 0], known[known >= 0]), first, last, ratio)
        one, other = x.select([key, "__head"]).take(pa.array(item)), y.select([*given, "t_b"]).take(pa.array(at))
        return pa.table([*one.columns, *other.columns], names=schema.names).cast(schema)

    return deal(left).cogroup(deal(right)).applyInArrow(meet, kinds)


# ------------------------------------------------------------------ synthesised wording
def synthesize(stories: DataFrame, headlines="headlines", country="country") -> DataFrame:
    """Add ``event_headline`` and ``event_summary`` from the source headlines of each story."""
    bare = F.filter(F.transform(headlines, lambda h: F.trim(F.regexp_replace(blank(h), r"\s+-\s+[^-]+$", ""))), lambda h: h != "")
    df = stories.withColumn("__heads", bare)
    df = df.withColumn("__sets", F.transform("__heads", lambda h: F.array_distinct(story_words(h))))
    # words carried by more than one headline weigh three, others one
    df = df.withColumn("__all", F.sort_array(F.flatten("__sets"))).withColumn("__low", F.lower(F.array_join("__heads", " ")))
    df = df.withColumn("__shared", F.array_distinct(F.filter("__all", lambda w, i: w == F.get(F.col("__all"), i - 1))))  # equal words are neighbours
    scored = F.zip_with("__heads", "__sets", lambda h, s: F.struct((F.size(s) + 2 * F.size(F.array_intersect(s, F.col("__shared")))).alias("p"), F.length(h).alias("l"), h.alias("h")))
    best = F.aggregate(scored, F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("l"), F.lit("").alias("h")),
                       lambda acc, s: F.when((s["p"] > acc["p"]) | ((s["p"] == acc["p"]) & (s["l"] > acc["l"])), s).otherwise(acc))["h"]
    df = df.withColumn("__best", F.regexp_replace(F.regexp_replace(best, V.LEAD_IN_PATTERN, ""), r"^[ .:;\-–—]+|[ .:;\-–—]+$", ""))
    low = F.col("__low")
    first_actor = F.get(F.array_sort(F.array_intersect("__all", F.lit(V.EVENT_ACTORS))), F.lit(0))
    actor = F.when(first_actor == first_actor, _case(first_actor, V.ACTOR_LABELS))
    asset = F.coalesce(*[F.when(contains_any(low, m), F.lit(label)) for label, m in V.ASSET_LABELS.items()])
    route = F.get(labels_present(low, V.SYNTHESIS_ROUTES), F.lit(0))
    df = df.withColumns({"__actor": F.coalesce(F.concat(actor, F.lit(" ")), F.lit("")), "__asset": asset, "__route": route})
    event = F.lit(None).cast("string")
    for markers, template in reversed(V.EVENT_TEMPLATES):
        pieces = template.replace("{actor}", "\0{actor}\0").replace("{asset}", "\0{asset}\0").split("\0")
        text = F.concat(*[F.col("__actor") if p == "{actor}" else F.col("__asset") if p == "{asset}" else F.lit(p) for p in pieces if p])
        event = F.when(contains_any(low, markers), text).otherwise(event)
    outcome = F.slice(F.array_compact(F.array(*[F.when(contains_any(low, m), F.lit(p)) for m, p in V.CONSEQUENCE_PHRASES])), 1, 2)
    df = df.withColumns({"__event": event, "__outcome": outcome})
    place = F.when(F.col("__route").isNotNull(), F.concat(F.lit(" in "), "__route")).otherwise(F.concat(F.lit(" affecting "), country))
    built = F.concat("__event", place, F.when(F.size("__outcome") > 0, F.concat(F.lit(", with "), F.array_join("__outcome", " and "))).otherwise(""))
    chosen = F.when(F.size("__heads") == 0, F.concat(F.lit("Supply-chain development affecting "), country)).otherwise(
        sentence_case(F.when(F.col("__asset").isNull() | F.col("__event").isNull(), F.col("__best")).otherwise(built)))
    df = df.withColumn("event_headline", chosen)
    sets = F.filter(F.transform(headlines, numbers), lambda s: F.size(s) > 0)
    df = df.withColumn("__numbers", sets)
    count = F.size(headlines)
    note = F.when(F.size(F.array_distinct("__numbers")) > 1, F.concat(
        F.lit(" Published numeric details differ across sources ("), F.array_join(F.array_sort(F.array_distinct(F.flatten("__numbers"))), ", "),
        F.lit("), so the consolidated headline does not assert a disputed figure."))).otherwise("")
    text = F.concat(count.cast("string"), F.lit(" independent source "), plural(count, "headline"), F.when(count == 1, " describe").otherwise(" describe"),
                    F.lit(" the same event: "), F.regexp_replace("event_headline", r"\.+$", ""), F.lit("."), note)
    helper = [c for c in df.columns if c.startswith("__") and c not in stories.columns]
    return df.withColumn("event_summary", text).drop(*helper)


def _case(column: Column, mapping: dict) -> Column:
    result = F.initcap(column)
    for key, value in mapping.items():
        result = F.when(column == key, F.lit(value)).otherwise(result)
    return result


def consolidate(rows: DataFrame, item="item_id", time="published_at", tie="url", ratio=True) -> DataFrame:
    """Merge same-event rows of a country across categories: newest row, merged sources, synthesised wording.

    ``rows`` carry country, sources and relevance_score.
    """
    rows = cut(rows)  # the filtered candidates are read by the clustering and by the roll-up
    clusters = leader_clusters(rows, ["country"], item, time, tie, days=None, ratio=ratio)
    joined = rows.join(clusters, item)
    flat = joined.select("seed", F.col(time).alias("__t"), F.col(tie).alias("__u"), F.posexplode("sources").alias("__i", "s"))
    flat = flat.withColumn("__family", F.coalesce(F.nullif(F.col("s.source_family"), F.lit("")), F.col("s.publisher"))).filter(F.col("__family").isNotNull())
    one = flat.groupBy("seed", "__family").agg(F.max_by(F.struct("__t", "__u", F.struct("s").alias("x")), F.struct("__t", "__u", (-F.col("__i")).alias("i"))).alias("b"))
    sources = one.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("b.__t", "b.__u", "__family", "b.x")), asc=False).alias("o"))
    sources = sources.select("seed", F.transform("o", lambda e: e["x"]["s"]).alias("sources"))
    best = joined.groupBy("seed").agg(F.max("relevance_score").alias("relevance_score"), F.count("*").alias("members"))
    newest = latest_per_key(joined.drop("sources", "relevance_score"), ["seed"], [time, tie])
    stories = newest.join(best, "seed").join(sources, "seed", "left")
    empty = F.array().cast(rows.schema["sources"].dataType)
    stories = stories.withColumn("sources", F.coalesce("sources", empty))
    heads = F.filter(F.transform("sources", lambda s: s["headline"]), lambda h: blank(h) != "")
    stories = stories.withColumn("headlines", F.when(F.size(heads) > 0, heads).otherwise(F.array("headline")))
    out = synthesize(stories)
    return (out.withColumn("headline", F.col("event_headline")).withColumn("summary", F.col("event_summary"))
               .drop("event_headline", "event_summary", "headlines", "seed"))
