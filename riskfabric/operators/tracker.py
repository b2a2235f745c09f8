"""Story patterns across refresh windows."""

from dataclasses import asdict, dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskfabric.functions.text import entity_context, story_key
from riskfabric.operators import match, volume
from riskfabric.operators.match import JACCARD, LETTERS, RATIO, sequence_ratio_at_least
from riskfabric.session import cut, stage

SOURCE = "struct<publisher:string,url:string>"
PATTERN = (f"country string, category string, collected_at timestamp, pattern_id string, canonical_key string, story_key string, headline string, "
           f"first_seen timestamp, active_windows bigint, observation_count bigint, sources array<{SOURCE}>, place bigint")
LIFE = pd.Timedelta(days=30)
LIFE_MICROS = LIFE // pd.Timedelta(microseconds=1)


@lru_cache(maxsize=100_000)
def _facts(key: str) -> tuple[frozenset, np.ndarray]:
    """Words of a story key and how often it holds each letter, the space, and any other character."""
    return frozenset(key.split()), np.bincount([LETTERS.find(c) + 1 for c in key], minlength=len(LETTERS) + 1)


@lru_cache(maxsize=100_000)
def key_matches(left: str, right: str) -> bool:
    """Word Jaccard, or the sequence ratio where the letters that both keys hold allow it."""
    (a, x), (b, y) = _facts(left), _facts(right)
    shared = len(a & b)
    if shared and shared / (len(a) + len(b) - shared) >= JACCARD:
        return True
    return 2 * int(np.minimum(x, y).sum()) >= RATIO * (len(left) + len(right)) - 1e-9 and sequence_ratio_at_least(left, right)


@dataclass(frozen=True)
class Pattern:
    """What is remembered of a pattern between windows."""
    pattern_id: str
    canonical_key: str
    first_seen: pd.Timestamp
    last_seen: pd.Timestamp
    active_windows: int = 1
    observation_count: int = 1
    sources: tuple = ()

    def seen(self, moment: pd.Timestamp, sources: tuple) -> "Pattern":
        """The pattern after one more story of the window at ``moment``."""
        return replace(self, last_seen=moment, active_windows=self.active_windows + int(self.last_seen != moment),
                       observation_count=self.observation_count + 1, sources=joined_sources(self.sources, sources))

    def stored(self) -> dict:
        return {**asdict(self), "first_seen": self.first_seen.isoformat(), "last_seen": self.last_seen.isoformat()}

    @classmethod
    def load(cls, row: dict) -> "Pattern":
        times = {name: pd.Timestamp(row[name]) for name in ("first_seen", "last_seen")}
        return cls(**{**row, **times, "sources": tuple(map(tuple, row["sources"]))})


def source_name(source) -> tuple:
    """What tells sources apart: the publisher in any case, and the url."""
    return (source[0] or "").lower(), source[1] or ""


def joined_sources(old: tuple, new: tuple) -> tuple:
    """Old sources, then the new ones that differ from them and from each other by publisher (in any case) and url."""
    first = {source_name(s): s for s in reversed(new)}
    fresh, held = dict.fromkeys(map(source_name, new)), set(map(source_name, old))
    return old + tuple(first[key] for key in fresh if key not in held)


def pattern_id(country: str, category: str, key: str) -> str:
    import hashlib
    return hashlib.sha1(f"{country}|{category}|{key}".encode()).hexdigest()


def series_rows(pdf: pd.DataFrame, known: list[Pattern]) -> tuple[pd.DataFrame, list[Pattern]]:
    """The touches of one series' windows, in time order, and the patterns alive after them (last seen first).

    A story belongs to the first living pattern whose key it matches; those opened in its own window come last. All stories of a window
    start from what was remembered before it, and the last one of a pattern is remembered.
    """
    country, category = pdf["country"].iloc[0], pdf["category"].iloc[0]
    touches = []
    for moment, window in pdf.sort_values(["collected_at", "place"]).groupby("collected_at", sort=True):
        living = {p.pattern_id: p for p in known if p.last_seen >= moment - LIFE}
        after = {}
        for story in window.to_dict("records"):
            key, sources = story["story_key"], tuple((s["publisher"], s["url"]) for s in story["sources"])
            base = next((p for p in living.values() if key_matches(key, p.canonical_key)), None)
            if base is None:
                now = Pattern(pattern_id(country, category, key), key, moment, moment, sources=sources)
                living[now.pattern_id] = now
            else:
                now = base.seen(moment, sources)
            after[now.pattern_id] = now
            touches.append({**asdict(now), "sources": [dict(zip(("publisher", "url"), s)) for s in now.sources], "country": country, "category": category,
                            "collected_at": moment, "story_key": key, "headline": story["headline"], "place": story["place"]})
        known = sorted((after.get(name, p) for name, p in living.items()), key=lambda p: p.last_seen, reverse=True)
    return pd.DataFrame(touches, columns=[field.split()[0] for field in PATTERN.split(", ")]), known


def window_stories(stories: DataFrame, per_window: int = None) -> DataFrame:
    """The stories of every window with their key and place (newest first); with ``per_window`` the first ones only."""
    keyed = stories.withColumn("story_key", story_key(F.col("headline")))
    order = W.partitionBy("country", "category", "collected_at").orderBy(F.desc("published_at"), F.desc("url"))
    placed = keyed.withColumn("place", F.row_number().over(order).cast("bigint"))
    kept = placed.filter(F.col("place") <= per_window) if per_window else placed
    slim = F.transform("sources", lambda s: F.struct(s["publisher"].alias("publisher"), s["url"].alias("url")))
    return kept.filter(F.col("story_key") != "").select("country", "category", "collected_at", "place", "headline", "story_key", slim.alias("sources"))


SERIES = ["country", "category"]
KEYS_TOGETHER = 2_000  # distinct story keys of a life that meet others in one part of the comparison


def lives(moments: DataFrame) -> DataFrame:
    """``life`` of every window (country, category, collected_at): a new one begins after more than 30 days without a window, since no pattern outlives such a gap."""
    order = W.partitionBy(*SERIES).orderBy("collected_at")
    gap = F.unix_micros("collected_at") - F.lag(F.unix_micros("collected_at")).over(order)
    marked = moments.select(*SERIES, "collected_at").distinct().withColumn("__new", (F.coalesce(gap, F.lit(0)) > LIFE // pd.Timedelta(microseconds=1)).cast("int"))
    return marked.withColumn("life", F.sum("__new").over(order)).drop("__new")


def key_matches_of(rows: DataFrame, openers: DataFrame) -> DataFrame:
    """Per story key of a life the other keys that match it and were there before its last window: (series, life, story_key, near).

    A life's keys are compared in parts, so that a series with many of them is spread over many tasks.
    """
    block = [*SERIES, "life"]
    micros = F.unix_micros("collected_at")
    keys = cut(rows.groupBy(*block, "story_key").agg(F.max(micros).alias("last_a")))
    first = openers.groupBy(*block, "opener").agg(F.min("first_b").alias("first_b"))
    sizes = keys.groupBy(*block).agg(F.ceil(F.count("*") / KEYS_TOGETHER).cast("int").alias("__parts"))
    features = lambda key, t: [match.key_features(F.col(key)).alias("b" if t == "t_b" else "a"), F.lit(None).cast("long").alias(t)]
    items = keys.join(sizes, block).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).select(*block, "__part", "story_key", "last_a", *features("story_key", "t_a"))
    seeds = first.join(sizes, block).withColumn("__part", F.pmod(F.xxhash64("opener"), F.col("__parts")).cast("int")).select(*block, "__part", "opener", "first_b", *features("opener", "t_b"))
    earlier = (F.col("first_b") <= F.col("last_a")) & (F.col("opener") != F.col("story_key"))
    pairs = match.matches(items, seeds, [*block, "__part"], native=match.near_tokens, where=earlier)
    return pairs.groupBy(*block, "story_key").agg(F.collect_set("opener").alias("near"))


class Living:
    """A living pattern as it was remembered: its counts, and the names of its sources instead of the sources. Times are in microseconds."""
    __slots__ = ("pattern_id", "key", "first_seen", "last_seen", "active_windows", "observation_count", "names", "source_count")

    def __init__(self, pattern_id, key, first_seen, last_seen, active_windows, observation_count, sources):
        self.pattern_id, self.key, self.first_seen, self.last_seen = pattern_id, key, first_seen, last_seen
        self.active_windows, self.observation_count = active_windows, observation_count
        self.names, self.source_count = {source_name(s) for s in sources}, len(sources)

    def fresh(self, sources) -> list:
        """The sources that a story adds, as in ``joined_sources``."""
        first = {}
        for s in sources:
            first.setdefault(source_name(s), s)
        return [s for name, s in first.items() if name not in self.names]

    def remember(self, moment: int, added: list) -> None:
        self.active_windows, self.observation_count, self.last_seen = self.active_windows + int(self.last_seen != moment), self.observation_count + 1, moment
        self.names.update(map(source_name, added))
        self.source_count += len(added)


class Series:
    """The living patterns of one series while its windows pass in time order. A story belongs to the first living pattern that it matches; see ``series_rows``.

    A touch tells the sources that it adds to what was remembered before its window or, in the window that opened the pattern, to the opening story.
    """

    def __init__(self, name: tuple):
        self.name, self.known, self.moment, self.living, self.place, self.after = name, [], None, {}, {}, {}

    def close(self) -> None:
        if self.moment is not None:
            for name, added in self.after.items():
                self.living[name].remember(self.moment, added)
            self.known = sorted(self.living.values(), key=lambda p: p.last_seen, reverse=True)

    def touch(self, moment: int, key: str, near, sources: list) -> tuple:
        """(pattern_id, canonical_key, first_seen, active_windows, observation_count, added sources, number of sources) after the story."""
        if moment != self.moment:
            self.close()
            self.moment, self.after = moment, {}
            self.living = {p.key: p for p in self.known if p.last_seen >= moment - LIFE_MICROS}
            self.place = {name: i for i, name in enumerate(self.living)}
        found = [name for name in (key, *near) if name in self.place]
        if not found:
            p = Living(pattern_id(*self.name, key), key, moment, moment, 1, 1, sources)
            self.place[key], self.living[key] = len(self.place), p
            return p.pattern_id, key, moment, 1, 1, sources, p.source_count
        name = min(found, key=self.place.get)
        p = self.living[name]
        added = self.after[name] = p.fresh(sources)
        return p.pattern_id, p.key, p.first_seen, p.active_windows + int(p.last_seen != moment), p.observation_count + 1, added, p.source_count + len(added)


ROWS_TOGETHER = 500  # rows that the ordered step holds as Python objects
STEP = (f"country string, category string, life bigint, collected_us bigint, place bigint, headline string, story_key string, pattern_id string, canonical_key string, first_us bigint, "
        f"active_windows bigint, observation_count bigint, added array<{SOURCE}>, source_count int")


def _follow(batches):
    """Touches of rows that are sorted by series, life, time and place; stored patterns of a life come before its stories."""
    kind = pa.list_(pa.struct([("publisher", pa.string()), ("url", pa.string())]))
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, types.get(t, kind)) for name, t in (field.split(" ", 1) for field in STEP.split(", "))])
    life, series = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_TOGETHER):
            out = []
            for row in batch.slice(at, ROWS_TOGETHER).to_pylist():
                sources = [(s["publisher"], s["url"]) for s in row["sources"]]
                here = (row["country"], row["category"], row["life"])
                if life != here:
                    life, series = here, Series(here[:2])
                if row["stored"]:
                    series.known.append(Living(row["pattern_id"], row["story_key"], row["first_us"], row["collected_us"], row["active_windows"], row["observation_count"], sources))
                    continue
                name, key, first, windows, count, added, total = series.touch(row["collected_us"], row["story_key"], row["near"], sources)
                out.append({**{c: row[c] for c in ("country", "category", "life", "collected_us", "place", "headline", "story_key")}, "pattern_id": name, "canonical_key": key, "first_us": first,
                            "active_windows": windows, "observation_count": count, "added": [{"publisher": p, "url": u} for p, u in added], "source_count": total})
            yield pa.RecordBatch.from_pylist(out, schema)


def with_sources(steps: DataFrame, stored: DataFrame = None) -> DataFrame:
    """Sources of a pattern after every touch: what was remembered before its window (stored, the opening story's, those of each window's last touch), then what it adds.

    They are put together by a window over the pattern, which Spark leaves out where nobody reads them; lists of sources grow with every touch, what is added does not.
    """
    one = [*SERIES, "life", "pattern_id", "first_us"]
    opening = (F.col("collected_us") == F.col("first_us")) & (F.col("observation_count") == 1)
    marked = steps.withColumns({"__at": 2 * F.col("collected_us") + F.when(opening, 0).otherwise(1), "__last": F.max("place").over(W.partitionBy(*one, "collected_us")) == F.col("place")})
    before = W.partitionBy(*one).orderBy("__at").rangeBetween(W.unboundedPreceding, -1)
    earlier = F.flatten(F.collect_list(F.when(opening | F.col("__last"), F.col("added"))).over(before))
    if stored is not None:
        marked = marked.join(stored.select(*SERIES, "life", "pattern_id", F.unix_micros("first_seen").alias("first_us"), F.col("sources").alias("__stored")), one, "left")
        earlier = F.concat(F.coalesce("__stored", F.array().cast(f"array<{SOURCE}>")), earlier)
    return marked.withColumn("sources", F.concat(earlier, "added")).drop("__at", "__last", "__stored")


def track(stories: DataFrame, per_window: int = None, stored: DataFrame = None) -> DataFrame:
    """Pattern state after every touch; a series (country, category) goes on from its ``stored`` patterns. Equal to ``series_rows`` on every series.

    Which keys match is found for all stories at once, by index and in parts. The ordered step gets short lists of matching keys: it reads a life of a series as a stream and holds
    its living patterns only; a touch tells the sources it adds and how many there are (``source_count``). Lives of a series are independent and run in different tasks.
    """
    block = [*SERIES, "life"]
    rows = cut(window_stories(stories, per_window))
    goes_on = stored is not None
    if stored is None:
        stored = rows.sparkSession.createDataFrame([], "country string, category string, pattern_id string, canonical_key string, first_seen timestamp, last_seen timestamp, "
                                                   f"active_windows bigint, observation_count bigint, sources array<{SOURCE}>")
    old = stored.select(*SERIES, "pattern_id", F.col("canonical_key").alias("story_key"), "first_seen", F.col("last_seen").alias("collected_at"), "active_windows", "observation_count", "sources")
    # A stored pattern that is older than every life of its series is in a life of its own, without stories.
    when = cut(lives(rows.select(*SERIES, "collected_at").unionByName(old.select(*SERIES, "collected_at"))))
    new, old = rows.join(when, [*SERIES, "collected_at"]), old.join(when, [*SERIES, "collected_at"])
    openers = new.select(*block, F.col("story_key").alias("opener"), F.unix_micros("collected_at").alias("first_b")).unionByName(
        old.select(*block, F.col("story_key").alias("opener"), F.unix_micros("collected_at").alias("first_b")))
    near = key_matches_of(new, openers)
    none, micros = F.lit(None), F.unix_micros
    new = new.join(near, [*block, "story_key"], "left").select(
        *block, micros("collected_at").alias("collected_us"), "place", "headline", "story_key", "sources", F.coalesce("near", F.array().cast("array<string>")).alias("near"),
        F.lit(False).alias("stored"), none.cast("string").alias("pattern_id"), none.cast("bigint").alias("first_us"), none.cast("bigint").alias("active_windows"),
        none.cast("bigint").alias("observation_count"))
    remembered = old.withColumn("sources", F.col("sources").cast(f"array<{SOURCE}>"))
    old = remembered.select(*block, micros("collected_at").alias("collected_us"), F.lit(-1).cast("bigint").alias("place"), none.cast("string").alias("headline"), "story_key", "sources",
                            F.array().cast("array<string>").alias("near"), F.lit(True).alias("stored"), "pattern_id", micros("first_seen").alias("first_us"),
                            F.col("active_windows").cast("bigint"), F.col("observation_count").cast("bigint"))
    late_first = F.when(F.col("stored"), -F.col("collected_us")).otherwise(F.col("collected_us"))
    ordered = new.unionByName(old).repartition(*block).sortWithinPartitions(*block, F.desc("stored"), late_first, "place", "pattern_id")
    touches = with_sources(ordered.mapInArrow(_follow, STEP), remembered if goes_on else None)
    moments = {"collected_at": F.timestamp_micros("collected_us"), "first_seen": F.timestamp_micros("first_us")}
    return touches.withColumns(moments).select(*[field.split()[0] for field in PATTERN.split(", ")], "source_count")


def score_patterns(touches: DataFrame, windows: DataFrame, as_of: Column = None) -> DataFrame:
    """Add anomaly, change, persistence, status, context and early warning to pattern touches.

    ``windows`` is the volume series; its baseline excludes the current window.
    """
    stats = volume.with_baseline(windows).select(*SERIES, "collected_at", "cluster_count", "baseline")
    return stage(score_touches(touches.join(stats, [*SERIES, "collected_at"]), as_of), "patterns")


def score_touches(touches: DataFrame, as_of: Column = None) -> DataFrame:
    """``score_patterns`` for touches that carry ``cluster_count`` of their window and the ``baseline`` of counts before it; no shuffle."""
    change = volume.cusum(F.col("cluster_count"))
    df = volume.with_robust_statistics(touches).select(
        *[c for c in touches.columns if c not in ("cluster_count", "baseline")], volume.robust_z(F.col("cluster_count")).alias("anomaly_score"),
        change["score"].alias("change_score"), change["status"].alias("change_status"), F.size("baseline").alias("baseline_windows"))
    df = df.withColumn("source_count", F.greatest(F.lit(1), F.col("source_count") if "source_count" in touches.columns else F.size("sources")))
    df = df.withColumn("persistence_score", volume.persistence(F.col("first_seen"), F.col("active_windows"), F.col("source_count"), F.col("collected_at") if as_of is None else as_of))
    df = df.withColumn("context", entity_context(F.col("headline")))
    w = volume.early_warning(F.col("anomaly_score"), F.col("persistence_score"), F.col("change_score"), F.col("source_count"), F.col("context.operational_relevance"), F.col("baseline_windows"))
    df = df.withColumn("warning", w)
    status = (F.when((F.col("active_windows") >= 3) | (F.col("persistence_score") >= 70), "Persistent").when(F.col("active_windows") >= 2, "Developing").otherwise("Emerging"))
    return df.select("*", status.alias("status"), F.col("warning.score").alias("early_warning_score"), F.col("warning.level").alias("alert_level"),
                     F.col("warning.confidence").alias("alert_confidence"), F.col("collected_at").alias("last_seen"))


def latest_patterns(scored: DataFrame) -> DataFrame:
    """Current row of each pattern: the last touch of its last window."""
    from riskfabric.operators.store import latest_per_key
    return latest_per_key(scored, ["pattern_id"], ["collected_at", "place"])
