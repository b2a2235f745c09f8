"""The story tracker as a stream: windows close by event time, patterns and volumes are state of their series."""

import json
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from riskfabric.functions.text import story_key
from riskfabric.operators import tracker
from riskfabric.operators.tracker import LIFE, LIFE_MICROS, PATTERN, SOURCE, Living, Pattern, Series, key_matches, series_rows, source_name

TOUCH = f"{PATTERN}, cluster_count bigint, baseline array<bigint>"
HISTORY = 30  # windows of a series whose volumes are the baseline
COLUMNS = [field.split()[0] for field in TOUCH.split(", ")]
LEAN = TOUCH.replace(f"sources array<{SOURCE}>", f"added array<{SOURCE}>, source_count int")
LEAN_COLUMNS = [field.split()[0] for field in LEAN.split(", ")]
TOGETHER = 500  # waiting stories of a batch and moment that are one entry


def _ms(moment: int) -> int:
    """The first whole millisecond that is not before a time in microseconds."""
    return -(-moment // 1000)


class StoredNames:
    """Names of a pattern's sources in the state, looked up one by one. A pattern that is opened again has others."""

    def __init__(self, names, pattern: str, first_seen: int):
        self.names, self.pattern = names, (pattern, first_seen)

    def __contains__(self, name) -> bool:
        return self.names.containsKey((*self.pattern, *name))

    def update(self, names) -> None:
        for name in names:
            self.names.updateValue((*self.pattern, *name), (True,))


class PatternTracker(StatefulProcessor):
    """Patterns and volumes of one (country, category).

    Stories wait in ``pending`` until the watermark has passed their window, so its parts may arrive in several batches and windows out of order. A timer closes the window: its
    stories are placed (newest first) and matched with the living patterns, one map entry each; only touched patterns are written. ``volumes`` holds the
    counts of the last 30 windows. Patterns are removed when a window or, in a series without news, a timer comes more than 30 days after they were last seen.
    With ``lists`` a touch tells all sources of its pattern, which is quadratic in the touches of a pattern; without, those it adds and their number (see ``tracker.track``).
    """

    def __init__(self, lists=True):
        self.lists, self.columns = lists, COLUMNS if lists else LEAN_COLUMNS

    def init(self, handle):
        self.handle = handle
        self.pending = handle.getMapState("pending", "ms bigint, number bigint", "stories string")
        self.arrived = handle.getMapState("arrived", "ms bigint", "entries bigint")
        self.names = handle.getMapState("names", "pattern_id string, first_seen bigint, publisher string, url string", "held boolean")
        self.patterns = handle.getMapState(
            "patterns", "pattern_id string", "canonical_key string, first_seen bigint, last_seen bigint, place bigint, active_windows bigint, observation_count bigint, sources string, source_count bigint")
        self.volumes = handle.getListState("volumes", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = {}
        for pdf in rows:
            for moment, headline, words, published, url, sources in zip(pdf["moment"], pdf["headline"], pdf["story_key"], pdf["published"], pdf["url"], pdf["sources"]):
                if pd.isna(moment) or key[0] is None:
                    continue  # only moves the watermark
                stories = waiting.setdefault(_ms(int(moment)), [])
                stories.append((int(moment), headline, words or "", None if pd.isna(published) else int(published), url, sources or "[]"))
                if len(stories) == TOGETHER:
                    self._wait(_ms(int(moment)), stories)
                    stories.clear()
        for ms, stories in waiting.items():
            if stories:
                self._wait(ms, stories)
        yield pd.DataFrame(columns=self.columns)

    def _wait(self, ms, stories) -> None:
        number = self.arrived.getValue((ms,))[0] if self.arrived.containsKey((ms,)) else 0
        self.pending.updateValue((ms, number), (json.dumps(stories),))
        self.arrived.updateValue((ms,), (number + 1,))
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        windows: dict[int, list] = {}
        if self.arrived.containsKey((now,)):  # only the stories of this moment are read
            for number in range(self.arrived.getValue((now,))[0]):
                for moment, *story in json.loads(self.pending.getValue((now, number))[0]):
                    windows.setdefault(moment, []).append(tuple(story))
                self.pending.removeKey((now, number))
            self.arrived.removeKey((now,))
        for moment in sorted(windows):
            yield self._closed(key, moment, windows[moment])
            self.handle.registerTimer(_ms(moment) + LIFE // pd.Timedelta(milliseconds=1) + 1)
        if not windows:
            self._forget({name[0]: row for name, row in self.patterns.iterator() if _ms(row[2]) + LIFE // pd.Timedelta(milliseconds=1) < now})

    def _forget(self, dead: dict) -> None:
        """Remove patterns and the names of their sources."""
        for name in dead:
            self.patterns.removeKey((name,))
        if dead and not self.lists:
            lives = {(name, row[1]) for name, row in dead.items()}
            for held in [held for held in self.names.keys() if tuple(held[:2]) in lives]:
                self.names.removeKey(held)

    def _closed(self, key, moment, stories) -> pd.DataFrame:
        """Touches of one window; brings the state up to it."""
        volumes = [row[0] for row in self.volumes.get()]
        count = len({headline for headline, *_ in stories if headline is not None})
        self.volumes.put([(n,) for n in (volumes + [count])[-HISTORY:]])
        newest = sorted(sorted(stories, key=lambda s: (s[3] is not None, s[3] or ""), reverse=True), key=lambda s: (s[2] is not None, s[2] or 0), reverse=True)
        time = pd.Timestamp(moment, unit="us")
        stored = {name[0]: row for name, row in self.patterns.iterator()}
        order = sorted(stored, key=lambda name: (-stored[name][2], stored[name][3]))
        if not self.lists:
            return self._lean(key, moment, newest, {name: stored[name] for name in order}).assign(cluster_count=count, baseline=lambda df: [volumes] * len(df))[LEAN_COLUMNS]
        known = [Pattern(name, row[0], pd.Timestamp(row[1], unit="us"), pd.Timestamp(row[2], unit="us"), row[4], row[5], tuple(map(tuple, json.loads(row[6]))))
                 for name in order for row in [stored[name]]]
        window = pd.DataFrame([{"country": key[0], "category": key[1], "collected_at": time, "place": i, "headline": headline, "story_key": words,
                                "sources": [{"publisher": publisher, "url": url} for publisher, url in json.loads(sources)]}
                               for i, (headline, words, _, _, sources) in enumerate(newest, 1) if words])
        if window.empty:
            return pd.DataFrame(columns=COLUMNS)
        touches, after = series_rows(window, known)
        for place, p in enumerate(after):
            if p.last_seen == time:
                self.patterns.updateValue((p.pattern_id,), (p.canonical_key, p.first_seen.value // 1000, moment, place, p.active_windows, p.observation_count, json.dumps(p.sources), len(p.sources)))
        self._forget({name: stored[name] for name in set(stored) - {p.pattern_id for p in after}})
        return touches.assign(cluster_count=count, baseline=[volumes] * len(touches))[COLUMNS]

    def _lean(self, key, moment, newest, stored) -> pd.DataFrame:
        """The touches of a window without whole lists of sources; what a pattern's sources are called is looked up."""
        series, out = Series(tuple(key)), []
        for name, row in stored.items():
            p = Living(name, row[0], row[1], row[2], row[4], row[5], ())
            p.names, p.source_count = StoredNames(self.names, name, row[1]), row[7]
            series.known.append(p)
        living = dict.fromkeys(p.key for p in series.known if p.last_seen >= moment - LIFE_MICROS)
        for place, (headline, words, _, _, sources) in enumerate(newest, 1):
            if words:
                near = [k for k in living if k != words and key_matches(words, k)]
                name, canonical, first, windows, n, added, total = series.touch(moment, words, near, [tuple(s) for s in json.loads(sources)])
                living.setdefault(canonical)
                out.append((*key, pd.Timestamp(moment, unit="us"), name, canonical, words, headline, pd.Timestamp(first, unit="us"), windows, n,
                            [{"publisher": publisher, "url": url} for publisher, url in added], total, place))
        series.close()
        if out:
            for place, p in enumerate(series.known):
                if p.last_seen == moment:
                    if not isinstance(p.names, StoredNames):
                        StoredNames(self.names, p.pattern_id, p.first_seen).update(p.names)
                    self.patterns.updateValue((p.pattern_id,), (p.key, p.first_seen, moment, place, p.active_windows, p.observation_count, None, p.source_count))
            self._forget({name: row for name, row in stored.items() if row[0] not in series.living})
        return pd.DataFrame(out, columns=LEAN_COLUMNS[:-2])

    def close(self):
        pass


def track_stream(stories: DataFrame, delay="1 hour", lists=True) -> DataFrame:
    """Touches of the patterns of a stream of stories (country, category, collected_at, headline, published_at, url, sources), given out when the watermark passes a window.

    Each carries the volume of its window and of up to 30 windows before it. A row without a country moves the watermark only. Without ``lists`` a touch has the sources it adds
    (``added``) and their number (``source_count``) instead of all of them.
    """
    source = F.transform("sources", lambda s: F.array(s["publisher"].cast("string"), s["url"].cast("string")))
    rows = stories.withWatermark("collected_at", delay).select(
        "country", "category", "collected_at", F.unix_micros("collected_at").alias("moment"), "headline", story_key(F.col("headline")).alias("story_key"),
        F.unix_micros("published_at").alias("published"), "url", F.to_json(source).alias("sources"))
    return rows.groupBy("country", "category").transformWithStateInPandas(PatternTracker(lists), TOUCH if lists else LEAN, "append", "EventTime")


def warnings(touches: DataFrame) -> DataFrame:
    """Anomaly, change, persistence, status and early warning of streamed touches, without further state."""
    return tracker.score_touches(touches)
