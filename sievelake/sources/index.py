"""A stored pattern index: rows, and postings of their characters by position, as Parquet segments under a versioned manifest.

Layout under the index's path: ``rows/seg=<s>`` (rid and the table's columns), ``chars/seg=<s>`` (one row for each character:
ch, off from the start, neg from the end, len, rid), ``lengths/seg=<s>`` (len, rid), ``dead/seg=<s>`` (rids) and
``manifest/v=<n>``: a state is a manifest version, written last, so a reader sees the old state or the new one; a version
that its writer didn't finish is passed over. Both cases are stored (ci: of the lowered key, whose length may differ). Postings
stand in a folder for each key and case, sorted by character, so a search reads those of its key and its letters. With a
partition column (``by``) rows and postings also stand in a folder for each of its values.

Ids are dense from 1 and never used again. Nulls have no postings; a row that is null in one key is still found by the others.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.pattern import Pattern
from sievelake.plans.planner import Predicate, ordered

from .files import text_key

#: Deletions that make the next change rewrite the index.
CLEANUP = 1000
#: Postings (or rows, where these are more) that a task sorts or groups, about: with the table tasks grow in number, not in memory.
TASK_ROWS = 1 << 20
_BY = "_part"  # the partition value of a row, as text
_RECORD_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


@dataclass(frozen=True)
class Manifest:
    name: str
    keys: dict[str, str]
    by: str | None = None
    schemas: dict[str, str] = field(default_factory=dict)
    segments: list[str] = field(default_factory=list)
    dead: list[str] = field(default_factory=list)
    next_rid: int = 1
    inserts: int = 0
    updates: int = 0
    deletes: int = 0
    tombstones: int = 0
    load: int | None = None  # rows of the segments or characters of a key in one case, whichever are most
    status: str = "ready"
    written_at: float = 0.0


class PatternIndex:
    """An index over one or more text keys of a table. ``keys``: name -> SQL expression over the table's columns."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        found = ((v, m) for v in ([version] if version is not None else sorted(self._versions(), reverse=True)) if (m := self._state(v)) is not None)
        self.version, self.manifest = next(found, (0, None))
        if self.manifest is None:
            raise FileNotFoundError(f"no index at {self.path}")

    # -- building -----------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, df: DataFrame, path: str, keys: dict[str, str] | list[str], name: str | None = None, by: str | None = None) -> PatternIndex:
        """Index the rows of ``df`` (for a partial index, filter it first). Keys must be text: cast others in their expression.

        ``by``: a column with few values, by which rows and postings are stored apart.
        """
        keys = {k: f"`{k}`" for k in keys} if not isinstance(keys, dict) else dict(keys)
        if not keys:
            raise ValueError("an index needs a key")
        for expression in keys.values():
            text_key(df, F.expr(expression))
        self = cls.__new__(cls)
        self.spark, self.path, self.version = df.sparkSession, path.rstrip("/"), 0
        self.manifest = Manifest(name or self.path.rsplit("/", 1)[-1], keys, by)
        n, segment, load = self._add(df, 1)
        self._publish(replace(self.manifest, segments=[segment], next_rid=1 + n, load=load))
        return self

    def _versions(self) -> list[int]:
        return [int(p.rsplit("=", 1)[-1]) for p in _list(self.spark, f"{self.path}/manifest")]

    def _state(self, version: int) -> Manifest | None:
        """The manifest of a version; None where its writer was lost before it was done."""
        line = self.spark.read.schema("value string").text(f"{self.path}/manifest/v={version}").first()
        try:
            return Manifest(**json.loads(line[0])) if line else None
        except json.JSONDecodeError:
            return None

    def _publish(self, manifest: Manifest) -> None:
        """Write the next version; of two writers at once the second fails, since its version is there."""
        manifest = replace(manifest, written_at=time.time())
        self.version = max([0, *self._versions()]) + 1
        row = self.spark.range(1).select(F.lit(json.dumps(asdict(manifest))).alias("value"))
        row.coalesce(1).write.text(f"{self.path}/manifest/v={self.version}")
        self.manifest = manifest

    def _add(self, df: DataFrame, first: int) -> tuple[int, str, int]:
        """Write rows and postings of ``df`` with ids from ``first``; the number of rows, the segment and its load."""
        segment = uuid.uuid4().hex
        staged = f"{self.path}/staged/{segment}"
        # rows are written once as they come; their partition and place are then facts, and ids follow from counts by partition
        df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(staged)
        staged_rows = self.spark.read.schema(df.withColumn("_at", F.lit(0).cast("long")).schema).parquet(staged)
        part = F.shiftright("_at", _RECORD_BITS)
        sizes = sorted((r["p"], r["n"]) for r in staged_rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        starts, total = [], first
        for p, n in sizes:
            starts.append((p, total))
            total += n
        if starts:
            start = self.spark.createDataFrame(starts, "p long, start long")
            rows = staged_rows.join(F.broadcast(start), part == F.col("p"))
            rows = rows.select((F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << _RECORD_BITS) - 1))).alias("rid"), *df.columns)
        else:
            rows = staged_rows.select(F.col("_at").alias("rid"), *df.columns)
        if self.manifest.by is not None:
            rows = rows.withColumn(_BY, F.col(f"`{self.manifest.by}`").cast("string"))
        self._store_rows(segment, rows, total - first)
        load = self._post(segment)
        _delete(self.spark, staged)
        return total - first, segment, load

    def _store_rows(self, segment: str, rows: DataFrame, n: int) -> None:
        # folders by partition value take a sort of whole rows, which are wider than postings
        self._store("rows", segment, _dealt(rows, _parts(4 * n)) if self._by else rows)

    def _post(self, segment: str) -> int:
        """Write the postings of a segment's stored rows; its load."""
        rows = self._read("rows", [segment])
        cased = lambda i, ci: F.lower(f"_s{i}") if ci else F.col(f"_s{i}")
        texts = [(name, ci, cased(i, ci)) for i, name in enumerate(self.manifest.keys) for ci in (False, True)]
        # keys are dealt as whole texts, which are far fewer than their characters
        whole = rows.select("rid", *self._by, *[F.expr(e).alias(f"_s{i}") for i, e in enumerate(self.manifest.keys.values())])
        n, *chars = whole.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.length(s)), F.lit(0)) for *_, s in texts]).first()
        each = F.inline(F.array(*[F.struct(F.lit(name).alias("key"), F.lit(ci).alias("ci"), s.alias("s")) for name, ci, s in texts]))
        keyed = lambda rows: _dealt(whole, _parts(rows)).select("rid", *self._by, each).where("s is not null")
        self._store("lengths", segment, keyed(n * len(texts)).select(*self._by, "key", "ci", F.length("s").alias("len"), "rid"))
        chars_of = keyed(sum(chars)).select(*self._by, "key", "ci", "rid", F.length("s").alias("len"), F.posexplode(F.split("s", "")).alias("off", "ch")).where("len > 0")
        self._store("chars", segment, chars_of.select(*self._by, "key", "ci", "ch", "off", (F.col("off") - F.col("len")).alias("neg"), "len", "rid"))
        return max(n, *chars)

    @property
    def _by(self) -> list[str]:
        return [_BY] if self.manifest.by is not None else []

    def _store(self, what: str, segment: str, frame: DataFrame) -> None:
        """Write a table of a segment in folders by partition value, and by key and case where it has these."""
        apart = [c for c in (_BY, "key", "ci") if c in frame.columns]
        inside = [c for c in ("ch", "off") if c in frame.columns]
        writer = (frame.sortWithinPartitions(*apart, *inside) if inside else frame).write
        (writer.partitionBy(*apart) if apart else writer).parquet(f"{self.path}/{what}/seg={segment}")
        self.manifest = replace(self.manifest, schemas=self.manifest.schemas | {what: frame.schema.json()})

    # -- reading ------------------------------------------------------------------------------------------------------

    def _read(self, what: str, segments: list[str]) -> DataFrame:
        """Segments of a table; folder names are read as what they were written as."""
        schema = T.StructType.fromJson(json.loads(self.manifest.schemas[what]))
        paths = [f"{self.path}/{what}/seg={s}" for s in segments]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*paths).select(*schema.names)

    def rows(self) -> DataFrame:
        """Live rows with their rid."""
        return self._live_rows().drop(_BY)

    def _live_rows(self) -> DataFrame:
        rows = self._read("rows", self.manifest.segments)
        many = self.manifest.dead and self.manifest.tombstones > TASK_ROWS >> 4
        return self._live(_dealt(rows, self.parts) if many else rows)

    def _live(self, df: DataFrame) -> DataFrame:
        """Without the deleted rows; where these are many, ``df`` is dealt by row already."""
        if not self.manifest.dead:
            return df
        dead = self._read("dead", self.manifest.dead)
        if self.manifest.tombstones <= TASK_ROWS >> 4:
            return df.join(F.broadcast(dead), "rid", "left_anti")
        return self._met(df, _dealt(dead, self.parts), "left_anti")

    @property
    def parts(self) -> int:
        """Partitions in which rows and what is found of them meet, by rid."""
        if self.manifest.load is None:  # written before loads were kept
            sums = self.lengths().groupBy("key", "ci").agg(F.sum("len").alias("n")).agg(F.max("n")).first()
            self.manifest = replace(self.manifest, load=max(self.manifest.next_rid - 1, sums[0] or 0))
        return _parts(self.manifest.load)

    def _met(self, df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
        """A join by rid of two sides that are dealt alike; the size of ids is known from the index, not from that of its files."""
        return df.join(ids.hint("merge") if self.parts > 1 else ids, "rid", how)

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Live rows, with their rid, of a table of rids; repeated ones make no difference."""
        return self._met(self._live(_dealt(self._read("rows", self.manifest.segments), self.parts)), _dealt(ids, self.parts)).drop(_BY)

    def _within(self, df: DataFrame, values: list[str | None] | None) -> DataFrame:
        """The rows of some partition values: other folders are not read."""
        if values is None:
            return df
        return df.where(F.col(_BY).isin(*[v for v in values if v is not None]) | (F.col(_BY).isNull() if None in values else F.lit(False)))

    def chars(self) -> DataFrame:
        return self._read("chars", self.manifest.segments)

    def lengths(self) -> DataFrame:
        return self._read("lengths", self.manifest.segments)

    def _matches(self, key: str, pattern: Pattern, ci: bool, values: list[str | None] | None = None) -> DataFrame:
        """rids that match one pattern, from postings alone, dealt by row; deleted rows not yet taken out."""
        of_key = (F.col("key") == key) & (F.col("ci") == F.lit(ci))
        lengths = self._within(self.lengths(), values).where(of_key)
        n, parts = pattern.least_length, pattern.parts
        long_enough = (F.col("len") >= n) if pattern.has_run else (F.col("len") == n)
        letters = [(p, i, t) for p, part in enumerate(parts) for i, t in enumerate(part) if isinstance(t, str)]
        if not letters:
            return _dealt(lengths.where(long_enough).select("rid"), self.parts)
        places: dict[str, list[Column]] = {}  # letter: (part, place in it) where the pattern wants it
        for p, i, t in letters:
            places.setdefault(t, []).append(F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")))
        found = self._within(self.chars(), values).where(of_key & long_enough & F.col("ch").isin(*sorted(places)))
        wanted = F.element_at(F.create_map(*[x for t, own in places.items() for x in (F.lit(t), F.array(*own))]), F.col("ch"))
        last = len(parts) - 1
        # a letter of an anchored part has one place only: postings elsewhere are left out before any shuffle
        at = F.col("off") - F.col("i")
        fits = (at >= 0) & (at <= F.col("len") - F.element_at(F.array(*[F.lit(len(p)) for p in parts]), F.col("p") + 1))
        if not pattern.starts_open:
            fits &= (F.col("p") != 0) | (at == 0)
        if not pattern.ends_open:
            fits &= (F.col("p") != last) | (F.col("neg") - F.col("i") == -len(parts[last]))
        # one shuffle, by row: both aggregations below and the joins with other predicates keep to it, but for letters of many places
        own_parts = self.parts
        n_parts = _parts(self.manifest.load * max(map(len, places.values())))
        hits = found.select("*", F.inline(wanted)).where(fits).select("rid", "len", "p", at.alias("start")).repartition(n_parts, "rid")
        back = (lambda ids: ids) if n_parts == own_parts else lambda ids: _dealt(ids, own_parts)
        need = F.element_at(F.array(*[F.lit(sum(isinstance(t, str) for t in part)) for part in parts]), F.col("p") + 1)
        starts = hits.groupBy("rid", "len", "p", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == need)
        lettered = sorted({p for p, _, _ in letters})
        if len(parts) == 1:  # any start will do
            return back(starts.select("rid").distinct())
        by_row = starts.groupBy("rid", "len").agg(*[F.array_sort(F.collect_list(F.when(F.col("p") == p, F.col("start")))).alias(f"s{p}") for p in lettered])
        # greedy from the left: each part at the first start that the part before leaves free; null once there is none
        place: Column = F.lit(0)
        for p, part in enumerate(parts):
            if p in lettered:
                place = _first_from(F.col(f"s{p}"), place) + len(part)
            elif p == last and not pattern.ends_open:
                place = F.when(F.col("len") - len(part) >= place, F.col("len"))
            else:
                place = place + len(part)
        return back(by_row.where(place.isNotNull() & (place <= F.col("len"))).select("rid"))

    def ids(self, predicates: Iterable[Predicate], values: list[str | None] | None = None) -> DataFrame:
        """Live rids that pass all predicates (columns are key names), most selective first; negations subtract from the non-null rows.

        ``values``: only rows with one of these values of the partition column.
        """
        out = None
        for p in ordered(predicates):
            if p.column not in self.manifest.keys:
                raise KeyError(f"no key {p.column!r} in the index")
            if p.pattern is None:
                return self.lengths().select("rid").where("false")
            pattern = p.parsed.lowered() if p.ignores_case else p.parsed
            own = self._matches(p.column, pattern, p.ignores_case, values)
            if p.negated:
                not_null = self._within(self.lengths(), values).where((F.col("key") == p.column) & ~F.col("ci")).select("rid")
                not_null = _dealt(not_null, self.parts)
                out = self._met(not_null if out is None else self._met(out, not_null), own, "left_anti")
            else:
                out = own if out is None else self._met(out, own)
        return self._live(out if out is not None else _dealt(self._within(self._read("rows", self.manifest.segments), values).select("rid"), self.parts))

    def search(self, predicates: Iterable[Predicate], values: list[str | None] | None = None) -> DataFrame:
        """Matching rows, without their rids."""
        rows = _dealt(self._within(self._read("rows", self.manifest.segments), values), self.parts)
        return self._met(rows, self.ids(predicates, values)).drop("rid", _BY)

    def count(self, predicates: Iterable[Predicate], name: str = "n") -> DataFrame:
        return self.ids(predicates).agg(F.count(F.lit(1)).alias(name))

    # -- maintenance --------------------------------------------------------------------------------------------------

    def append(self, df: DataFrame) -> None:
        n, segment, load = self._add(df, self.manifest.next_rid)
        m = self.manifest
        self._publish(replace(m, segments=[*m.segments, segment], next_rid=m.next_rid + n, inserts=m.inserts + n, load=self._more(load)))

    def _more(self, load: int) -> int | None:
        """The load with another segment's; unknown stays unknown."""
        return None if self.manifest.load is None else self.manifest.load + load

    def _bury(self, condition: Column) -> tuple[int, str]:
        segment = uuid.uuid4().hex
        self._store("dead", segment, self.rows().where(condition).select("rid"))
        return self._read("dead", [segment]).count(), segment

    def delete(self, condition: Column, cleanup: bool = True) -> int:
        """Mark the rows that satisfy ``condition``; with CLEANUP marks or more the index is rewritten, unless ``cleanup`` is off. The number of rows."""
        n, segment = self._bury(condition)
        m = self.manifest
        self._publish(replace(m, dead=[*m.dead, segment], deletes=m.deletes + n, tombstones=m.tombstones + n))
        if cleanup and self.manifest.tombstones >= CLEANUP:
            self.compact()
        return n

    def update(self, condition: Column, changes: dict[str, Column]) -> int:
        """Rows that satisfy ``condition`` with changed columns: the old ids die, the new rows get new ones; one state change."""
        new = self.rows().where(condition).drop("rid").withColumns(changes)
        old = self.rows().drop("rid").schema
        new = new.select(*[F.col(f.name).cast(f.dataType) for f in old.fields])
        n, added, load = self._add(new, self.manifest.next_rid)
        _, buried = self._bury(condition)
        m = self.manifest
        self._publish(replace(m, segments=[*m.segments, added], dead=[*m.dead, buried], next_rid=m.next_rid + n, updates=m.updates + n, tombstones=m.tombstones + n, load=self._more(load)))
        if self.manifest.tombstones >= CLEANUP:
            self.compact()
        return n

    def compact(self) -> None:
        """Rewrite the live rows as one segment, and their postings from these; ids stay."""
        m, segment = self.manifest, uuid.uuid4().hex
        self._store_rows(segment, self._live_rows(), m.next_rid - 1)
        load = self._post(segment)
        self._publish(replace(m, segments=[segment], dead=[], tombstones=0, load=load))

    def rebuild(self, keys: dict[str, str] | None = None) -> None:
        """Index the live rows anew, with new ids (and new keys, if given)."""
        rows = self.rows().drop("rid")
        self.manifest = replace(self.manifest, keys=keys or self.manifest.keys)
        n, segment, load = self._add(rows, self.manifest.next_rid)
        self._publish(replace(self.manifest, segments=[segment], dead=[], tombstones=0, next_rid=self.manifest.next_rid + n, load=load))

    def vacuum(self) -> None:
        """Remove files that the current state no longer names."""
        live = {*self.manifest.segments, *self.manifest.dead}
        for what in ("rows", "chars", "lengths", "dead", "staged"):
            for path in _list(self.spark, f"{self.path}/{what}"):
                if path.rsplit("/", 1)[-1].removeprefix("seg=") not in live:
                    _delete(self.spark, path)
        for path in _list(self.spark, f"{self.path}/manifest"):
            if int(path.rsplit("=", 1)[-1]) < self.version:
                _delete(self.spark, path)

    def drop(self) -> None:
        _delete(self.spark, self.path)

    # -- diagnostics --------------------------------------------------------------------------------------------------

    def size_bytes(self) -> int:
        """Bytes of the files of the current state's postings and lengths."""
        return sum(_size(self.spark, f"{self.path}/{what}/seg={s}") for what in ("chars", "lengths") for s in self.manifest.segments)

    def stats(self) -> DataFrame:
        """One row: name, active, slots, free, tombstones, max_len, inserts, updates, deletes."""
        m = self.manifest
        slots = m.next_rid - 1
        active = self.rows().agg(F.count(F.lit(1)).alias("active"))
        longest = self.lengths().where(~F.col("ci")).agg(F.coalesce(F.max("len"), F.lit(0)).alias("max_len"))
        fixed = {"name": F.lit(m.name), "slots": F.lit(slots).cast("long"), "tombstones": F.lit(m.tombstones).cast("long"), "inserts": F.lit(m.inserts).cast("long"), "updates": F.lit(m.updates).cast("long"), "deletes": F.lit(m.deletes).cast("long")}
        out = active.crossJoin(longest).withColumns(fixed).withColumn("free", F.col("slots") - F.col("active") - F.col("tombstones"))
        return out.select("name", "active", "slots", "free", "tombstones", "max_len", "inserts", "updates", "deletes")


def _first_from(starts: Column, place: Column) -> Column:
    """The first of sorted starts at or after a place; null if there is none."""
    return F.get(F.filter(starts, lambda s: s >= place), F.lit(0))


def _parts(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """``df`` in so many partitions by rid; as it is where one would do."""
    return df.repartition(parts, "rid") if parts > 1 else df


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _list(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [str(s.getPath()) for s in fs.listStatus(p)] if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """What changes when a table is written anew: its length and time of change."""
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def _size(spark: SparkSession, path: str) -> int:
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
