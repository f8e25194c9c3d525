"""Facts of one inference run: one table, bucketed by fact, with a directory per predicate key and phase.

Every phase reads tables that were written before it, so plans do not grow with the number of
phases and a lost executor costs a re-read of files, never a recomputation of earlier phases. The
buckets are the partitions of the shuffle that removes duplicate candidates, so candidates meet the
known facts without a shuffle of these.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from hornfold.functions.terms import RDF_TYPE, is_type, pred_key
from hornfold.sources.folders import hadoop_path, read_text, remove_folder, write_text
from hornfold.sources.rules import Key, RuleSet
from hornfold.sources.triples import TRIPLE_COLUMNS, relation, rules_only, stored_by_key, union_triples

PAIR_SCHEMA = "s string, o string"
FACT = ["k", "s", "o"]
MERGE_EVERY = 16
#: Values of a side of a key that can be split over tasks, and those the sketch that finds them counts.
HOT_VALUES, HOT_TRACKED = 32, 4096
#: Pieces for each task's fair share of rows, so that pieces that meet in a task don't make it a long one.
PIECES_A_SHARE = 4
#: Facts that a task can sort in little memory: with more in a bucket on average they are dealt anew, to so
#: many buckets that the facts can grow by ``HEADROOM`` until the next time.
FACTS_A_BUCKET, HEADROOM = 1_000_000, 3
#: The settings that say how many partitions a shuffle has.
SHUFFLE_PARTITIONS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
#: The phase of base facts; facts added to a finished run have the number of its last phase above ``ADDED``.
BASE, ADDED = 0, 1_000_000_000


def profile(hot: bool) -> list[Column]:
    """Rows, distinct subjects and distinct objects of a key's facts; with ``hot`` the values most of them share."""
    sides = (("s", "subjects"), ("o", "objects"))
    distinct = [F.approx_count_distinct(side).alias(name) for side, name in sides]
    frequent = [most_frequent(F.col(side)).alias(f"hot {name}") for side, name in sides] if hot else []
    return [F.count("*").alias("facts"), *distinct, *frequent]


def most_frequent(values: Column) -> Column:
    """The ``HOT_VALUES`` most frequent values with about how often they come, by a sketch of fixed size."""
    return F.call_function("approx_top_k", values, F.lit(HOT_VALUES), F.lit(HOT_TRACKED))


def key_metrics(ids: Iterable[int], wanted: Column, hot: bool) -> list[Column]:
    """The ``profile`` of each key's ``wanted`` rows, as metrics that a write reports."""
    found = []
    for i in ids:
        of_key = wanted & (F.col("k") == i)
        found.append(F.count_if(of_key).alias(f"facts {i}"))
        found += [F.approx_count_distinct(F.when(of_key, F.col(c))).alias(f"{c} {i}") for c in ("s", "o")]
        found += [most_frequent(F.when(of_key, F.col(c))).alias(f"hot {c} {i}") for c in ("s", "o") if hot]
    return found


class FactTables:
    """Base facts and the new facts of each phase, as ``(s, o)`` rows per predicate key."""

    def __init__(
        self, kb: DataFrame, rules: RuleSet, folder: str, *, staged: bool, distinct_input: bool, salt: bool = False
    ):
        self.spark = kb.sparkSession
        columns = [*TRIPLE_COLUMNS, *(["is_type", "pred_key"] if stored_by_key(kb) else [])]
        self.kb = kb if staged or distinct_input else kb.select(*columns).distinct()
        self.rules = rules
        self.distinct_input = distinct_input
        self.folder = folder
        self.ids: dict[Key, int] = {key: i for i, key in enumerate(rules.keys)}
        self.staged = staged
        self.explained = False
        self.explained_before = 0
        self.explain_path = f"{folder}/explanations"
        self.base_rows: dict[Key, int] | None = None
        self.base_frames: dict[Key, DataFrame] = {}
        # Phases of derived facts, grouped by how often merged; ``rows_in`` has the keys of a phase
        # with their number of facts.
        self.levels: list[list[int]] = [[]]
        # Phases of runs that this one goes on from, and facts that were added to them.
        self.frozen: list[int] = []
        self.newest: int | None = None
        self.newly_added: list[int] = []
        self.rows_in: dict[int, dict[Key, int]] = {}
        self.copied: list[int] = []
        # Per key the most distinct subjects and objects seen in one phase.
        self.distinct: dict[Key, tuple[int, int]] = {}
        # Per key, with ``salt``: the largest share of one write's facts that a subject or object had.
        self.salt = salt
        self.shares: dict[Key, tuple[dict[str, float], dict[str, float]]] = {}
        # The partitions of every shuffle of a phase; more of them as the facts grow (``deal_anew``).
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # How often the facts were dealt anew, the times before which frames of earlier results read, and
        # those that nothing reads once the next manifest is written.
        self.dealt = 0
        self.shared: list[int] = []
        self.left: list[int] = []
        self.table = f"hornfold_{uuid.uuid4().hex}"

    def create(self) -> None:
        """Name the table in the session's catalog; the files are in the run's folder and stay.

        While it has a name, shuffles are as wide as the table, so candidates come dealt as its buckets are.
        """
        self.before = {name: self.spark.conf.get(name, None) for name in SHUFFLE_PARTITIONS}
        self._name()
        if self.rows_in or self.base_rows:  # of a run that this one goes on from
            self.spark.catalog.recoverPartitions(self.table)

    def _name(self) -> None:
        for name in SHUFFLE_PARTITIONS:
            self.spark.conf.set(name, str(self.buckets))
        self.spark.sql(
            f"CREATE TABLE {self.table} (k INT, s STRING, o STRING, kp INT, phase INT) USING parquet "
            f"PARTITIONED BY (kp, phase) CLUSTERED BY (k, s, o) INTO {self.buckets} BUCKETS LOCATION '{self.home(self.dealt)}'"
        )

    def forget(self) -> None:
        """Take the name out of the catalog again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        for name, value in self.before.items():
            self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)

    def home(self, dealt: int) -> str:
        """The folder of the facts since they were dealt anew for the ``dealt``-th time."""
        return f"{self.folder}/facts-{dealt}" if dealt else f"{self.folder}/facts"

    def fit_buckets(self, facts: int) -> bool:
        """Take more buckets when so many facts would make them too large; whether that was so."""
        if facts <= self.buckets * FACTS_A_BUCKET:
            return False
        self.buckets = math.ceil(facts * HEADROOM / FACTS_A_BUCKET)
        return True

    def fit_input(self) -> None:
        """Choose the buckets by the number of facts that will be staged."""
        if self.staged:
            self.fit_buckets(self.keyed(self.kb).count())

    def deal_anew(self) -> None:
        """Copy the facts to a table with more buckets when they have grown too many for those there are.

        The number of buckets at least triples, so that in all no more than one and a half times the facts
        that there are in the end are copied. What ``drop_copied`` deletes is read no more once the manifest is written.
        """
        stored = [*([BASE] if self.staged else []), *self.phases]
        if not self.fit_buckets(sum(sum(self.rows_of(phase).values()) for phase in stored)):
            return
        rows = self.spark.table(self.table).filter(F.col("phase").isin(stored))
        before, old = self.table, self.dealt
        self.table, self.dealt = f"hornfold_{uuid.uuid4().hex}", self.dealt + 1
        remove_folder(self.spark, self.home(self.dealt))  # of a run that was lost here
        self._name()
        self.bucketed(rows.select(*FACT, "kp", "phase")).write.insertInto(self.table)
        self.spark.sql(f"DROP TABLE IF EXISTS {before}")
        if self.staged:
            self.base_frames.clear()
        self.copied.clear()
        self.left += [old] if old not in self.shared else []

    def rows_of(self, phase: int) -> dict[Key, int]:
        return (self.base_rows or {}) if phase == BASE else self.rows_in[phase]

    def prepare(self) -> None:
        if self.staged:
            self._stage()
        elif stored_by_key(self.kb):
            self._count_stored()

    def keyed(self, triples: DataFrame) -> DataFrame:
        """The facts of ``triples`` that the rules can use, as ``(k, s, o)``, each once."""
        ids = self.spark.createDataFrame(
            [(i, key, of_type) for (key, of_type), i in self.ids.items()], "k int, pred_key string, is_type boolean"
        )
        return (
            rules_only(triples, self.rules)
            .select("s", "o", is_type(F.col("p")).alias("is_type"), pred_key(F.col("p"), F.col("o")).alias("pred_key"))
            # One row per key that a rule names: its size is bounded by the rule text.
            .join(F.broadcast(ids), ["pred_key", "is_type"])
            .select(*FACT)
        )

    def bucketed(self, facts: DataFrame) -> DataFrame:
        """Dealt as the table's buckets are, so that each task writes one bucket."""
        return facts.repartition(self.buckets, *FACT)

    def write(self, facts: DataFrame, phase: int) -> None:
        """Add ``(k, s, o)`` rows as the facts of a phase."""
        rows = facts.select(*FACT, F.col("k").alias("kp"), F.lit(phase).alias("phase"))
        rows.write.insertInto(self.table)

    def _stage(self) -> None:
        """Copy the facts the rules can use, once, into one directory per key; the write counts them."""
        facts = self.bucketed(self.keyed(self.kb))
        facts = facts if self.distinct_input else facts.distinct()
        seen = Observation("staged")
        self.write(facts.observe(seen, *key_metrics(self.ids.values(), F.lit(True), self.salt)), BASE)
        found = seen.get
        self._know({key: self.profile_of(found, i) for key, i in self.ids.items() if found[f"facts {i}"]})

    def profile_of(self, metrics: dict[str, int], i: int) -> dict[str, int]:
        found = {"facts": metrics[f"facts {i}"], "subjects": metrics[f"s {i}"], "objects": metrics[f"o {i}"]}
        if self.salt:
            found |= {"hot subjects": metrics[f"hot s {i}"], "hot objects": metrics[f"hot o {i}"]}
        return found

    def _count_stored(self) -> None:
        """Sizes and fan-outs of a table stored by key: one scan of the directories that the rules use."""
        rows = rules_only(self.kb, self.rules).groupBy("pred_key", "is_type").agg(*profile(self.salt)).collect()
        self._know({(row["pred_key"], row["is_type"]): row for row in rows})

    def _know(self, found: dict[Key, Row | dict[str, int]]) -> None:
        self.base_rows = {key: found[key]["facts"] if key in found else 0 for key in self.ids}
        for key, row in found.items():
            self.learn(key, row)

    def add(self, triples: DataFrame, after: int) -> None:
        """Make the facts of ``triples`` that aren't known the newest ones, and all known ones old."""
        self.frozen += self.phases
        self.shared.append(self.dealt)
        self.levels, self.newest = [[]], None
        fresh = self.bucketed(self.keyed(triples)).distinct()
        known = self.known(list(self.ids))
        fresh = fresh if known is None else fresh.join(known, FACT, "left_anti")
        seen = Observation("added")
        self.write(fresh.observe(seen, *key_metrics(self.ids.values(), F.lit(True), self.salt)), ADDED + after)
        found = seen.get
        rows = {key: found[f"facts {i}"] for key, i in self.ids.items() if found[f"facts {i}"]}
        for key in rows:
            self.learn(key, self.profile_of(found, self.ids[key]))
        self.advance(ADDED + after, rows)
        self.newly_added = [ADDED + after] if rows else []

    def learn(self, key: Key, profiled: Row | dict[str, int]) -> None:
        known = self.distinct.get(key, (1, 1))
        self.distinct[key] = (max(known[0], profiled["subjects"]), max(known[1], profiled["objects"]))
        if not self.salt:
            return
        shares = self.shares.setdefault(key, ({}, {}))
        for side, name in zip(shares, ("hot subjects", "hot objects"), strict=True):
            for value, rows in profiled[name]:
                # A sketch of many keys counts the other keys' rows as nulls.
                if value is not None and rows * self.buckets > profiled["facts"]:
                    side[value] = max(side.get(value, 0.0), min(1.0, rows / profiled["facts"]))

    def pieces(self, key: Key) -> tuple[dict[str, int], dict[str, int]]:
        """Subjects and objects with more facts than a task's fair share, and into how many pieces they are cut."""
        subjects, objects = (
            {value: math.ceil(share * self.buckets * PIECES_A_SHARE) for value, share in side.items()}
            for side in self.shares.get(key, ({}, {}))
        )
        return subjects, objects

    def fanout(self, key: Key) -> tuple[float, float, float] | None:
        """Facts per distinct subject and object and in all, where the facts of the key were counted."""
        if self.base_rows is None or key not in self.distinct:
            return None
        subjects, objects = self.distinct[key]
        return self.rows(key) / max(1, subjects), self.rows(key) / max(1, objects), float(self.rows(key))

    def base(self, key: Key) -> DataFrame:
        """Base facts of a key; the same frame every time, so files are listed once per run."""
        if key not in self.base_frames:
            self.base_frames[key] = self._read([self._path(key, BASE)]) if self.staged else relation(self.kb, *key)
        return self.base_frames[key]

    def has_base(self, key: Key) -> bool:
        return self.base_rows is None or self.base_rows[key] > 0

    @property
    def older(self) -> list[int]:
        return self.frozen + [phase for level in self.levels for phase in level]

    @property
    def phases(self) -> list[int]:
        """The phases that facts beside the base ones are stored under."""
        return self.older + ([self.newest] if self.newest is not None else [])

    @property
    def newest_rows(self) -> dict[Key, int]:
        return self.rows_in[self.newest] if self.newest is not None else {}

    def rows(self, key: Key) -> int:
        """Known number of facts of a key; unknown base facts are left out."""
        return (self.base_rows or {}).get(key, 0) + sum(self.rows_in[phase].get(key, 0) for phase in self.phases)

    def old(self, key: Key) -> DataFrame | None:
        """Facts known before the latest phase; None when there are none."""
        return self._together(key, self.older)

    def all(self, key: Key) -> DataFrame | None:
        return self._together(key, self.phases)

    def delta(self, key: Key) -> DataFrame | None:
        return self._derived(key, [self.newest]) if self.newest is not None else None

    def _together(self, key: Key, phases: list[int]) -> DataFrame | None:
        derived = self._derived(key, phases)
        if not self.has_base(key):
            return derived
        return self.base(key) if derived is None else self.base(key).select("s", "o").unionByName(derived)

    def _derived(self, key: Key, phases: list[int]) -> DataFrame | None:
        paths = [self._path(key, phase) for phase in phases if key in self.rows_in[phase]]
        return self._read(paths) if paths else None

    def _path(self, key: Key, phase: int) -> str:
        return f"{self.home(self.dealt)}/kp={self.ids[key]}/phase={phase}"

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(PAIR_SCHEMA).parquet(*paths)

    def known(self, keys: list[Key]) -> DataFrame | None:
        """``(k, s, o)`` facts of some keys known so far; None when there are none.

        Those of the run's table come with its buckets, so a join by fact shuffles only the other side.
        """
        stored = None
        if self.staged or self.phases:
            rows = self.spark.table(self.table).filter(F.col("kp").isin([self.ids[key] for key in keys]))
            stored = rows.select(*FACT)
        if self.staged:
            return stored
        found = [(self.ids[key], self.base(key)) for key in keys if self.has_base(key)]
        parts = ([tagged(found)] if found else []) + ([stored] if stored is not None else [])
        return union_triples(*parts) if parts else None

    def advance(self, phase: int, new_rows: dict[Key, int]) -> None:
        """Make the new facts of a phase the newest ones."""
        if self.newest is not None and self.newest >= ADDED:
            self.frozen.append(self.newest)
        elif self.newest is not None:
            self.levels[0].append(self.newest)
            self._merge(phase)
        self.newest = None
        if new_rows:
            self.newest = phase
            self.rows_in[phase] = dict(new_rows)

    def _merge(self, phase: int) -> None:
        """Rewrite the facts of many phases as one, so the number of directories grows with log(phases)."""
        for level, phases in enumerate(list(self.levels)):
            if len(phases) < MERGE_EVERY:
                continue
            target = -(phase * 100 + level)
            rows = {key: n for key in self.ids if (n := sum(self.rows_in[p].get(key, 0) for p in phases))}
            parts = [(self.ids[key], self._derived(key, phases)) for key in rows]
            self.write(self.bucketed(tagged(parts)), target)
            self.rows_in[target] = rows
            self.copied += phases
            phases.clear()
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(target)

    def drop_copied(self) -> None:
        """Delete what was merged or dealt anew; no later phase reads it."""
        for dealt in self.left:
            remove_folder(self.spark, self.home(dealt))
        self.left.clear()
        gone = [(key, phase) for phase in self.copied for key in self.rows_in[phase]]
        if not gone:
            return
        parts = ", ".join(f"PARTITION (kp={self.ids[key]}, phase={phase})" for key, phase in gone)
        self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS {parts}")
        for key, phase in gone:
            remove_folder(self.spark, self._path(key, phase))
        self.copied.clear()

    def clear_unrecorded(self) -> None:
        """Delete what a run that was lost wrote after its last manifest, and what it had merged."""
        recorded = {BASE, *self.phases}
        home = self.home(self.dealt)
        folder, system = hadoop_path(self.spark, home)
        found = system.globStatus(hadoop_path(self.spark, f"{home}/kp=*/phase=*")[0]) if system.exists(folder) else []
        for status in found:
            if int(status.getPath().getName().split("=")[1]) not in recorded:
                system.delete(status.getPath(), True)
        self.copied.clear()
        kept = {self.home(dealt).rsplit("/", 1)[1] for dealt in (self.dealt, *self.shared)}
        for status in system.listStatus(hadoop_path(self.spark, self.folder)[0]):
            name = status.getPath().getName()
            if (name == "facts" or name.startswith("facts-")) and name not in kept:
                system.delete(status.getPath(), True)
        self.left.clear()

    def state(self) -> dict[str, object]:
        """What a resumed run needs to know of this one, besides its files."""
        by_id = lambda rows: {str(self.ids[key]): n for key, n in rows.items()}
        return {
            "keys": [list(key) for key in self.ids],
            "buckets": self.buckets,
            "dealt": self.dealt,
            "shared": self.shared,
            "staged": self.staged,
            "base_rows": None if self.base_rows is None else by_id(self.base_rows),
            "levels": self.levels,
            "frozen": self.frozen,
            "newest": self.newest,
            "rows_in": {str(phase): by_id(self.rows_in[phase]) for phase in [*self.phases, *self.copied]},
            "copied": self.copied,
            "distinct": {str(self.ids[key]): list(pair) for key, pair in self.distinct.items()},
            "shares": {str(self.ids[key]): list(pair) for key, pair in self.shares.items()},
            "explained": self.explained,
            "explained_before": self.explained_before,
            "explain_path": self.explain_path,
        }

    def restore(self, state: dict) -> None:
        """Take up the ``state`` of a run over the same rules."""
        if [list(key) for key in self.ids] != state["keys"] or self.staged != state["staged"]:
            raise ValueError(f"{self.folder} is a run of other rules or of another way to read the facts")
        keys = list(self.ids)
        by_key = lambda rows: {keys[int(i)]: n for i, n in rows.items()}
        self.buckets = state["buckets"]
        self.dealt, self.shared = state.get("dealt", 0), state.get("shared", [])  # absent from older manifests
        self.base_rows = None if state["base_rows"] is None else by_key(state["base_rows"])
        self.levels, self.newest, self.copied = state["levels"], state["newest"], state["copied"]
        self.frozen = state["frozen"]
        self.rows_in = {int(phase): by_key(rows) for phase, rows in state["rows_in"].items()}
        self.distinct = {key: tuple(pair) for key, pair in by_key(state["distinct"]).items()}
        self.shares = {key: tuple(pair) for key, pair in by_key(state.get("shares", {})).items()}
        self.explained, self.explain_path = state["explained"], state["explain_path"]
        self.explained_before = state.get("explained_before", 0)  # absent from older manifests

    def derived(self) -> DataFrame:
        """All facts that this run derived, as triples."""
        parts = self._triples([p for p in self.phases if p not in self.frozen and p < ADDED])
        return union_triples(*parts) if parts else self.spark.createDataFrame([], "s string, p string, o string")

    def added(self) -> list[DataFrame]:
        """The facts that ``add`` found to be new, as triples."""
        return self._triples(self.newly_added)

    def _triples(self, phases: list[int]) -> list[DataFrame]:
        parts = []
        for key, of_type in self.ids:
            pairs = self._derived((key, of_type), phases)
            if pairs is not None:
                parts.append(pairs.select("s", F.lit(RDF_TYPE if of_type else key).alias("p"), "o"))
        return parts

    def manifest(self, phase: int) -> str:
        return f"{self.folder}/manifest/phase-{phase:06d}.json"

    def save_manifest(self, phase: int, progress: dict[str, object]) -> None:
        """Record a finished phase; the file appears whole or not at all."""
        write_text(self.spark, self.manifest(phase), json.dumps({"phase": phase, **progress, "facts": self.state()}))

    def last_manifest(self) -> dict | None:
        folder, system = hadoop_path(self.spark, f"{self.folder}/manifest")
        if not system.exists(folder):
            return None
        names = sorted(status.getPath().getName() for status in system.listStatus(folder))
        whole = [name for name in names if name.endswith(".json")]
        return json.loads(read_text(self.spark, f"{self.folder}/manifest/{whole[-1]}")) if whole else None


def tagged(relations: Iterable[tuple[int, DataFrame]]) -> DataFrame:
    """Union of per-key relations with the key's id as ``k``."""
    return union_triples(*(rel.select(F.lit(i).alias("k"), "s", "o") for i, rel in relations))
