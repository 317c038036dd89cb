"""Versioned snapshots of the clinic: write aside, check, then publish.

A table is a set of files, each a range of the table's cluster key (orders, panels and
payments by order number). A change is a list of edits: which rows it touches, what
becomes of them, which rows are new. Only files with touched rows are written anew; all
other files stay as they are and belong to the new version as well. The rows that really
differ are checked against the rest of the clinic before the version is published.

Writers do not wait for each other. Each prepares its files and then takes the next
version number; whoever finds it taken looks at what the others changed meanwhile. If
they touched one of its files or keys, or its rows now break a rule, it starts over from
the new version; otherwise it takes the number after. Readers see a version or not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from clinicframe.model import Clinic
from clinicframe.operators import guards, quality
from clinicframe.operators.edits import Edit
from clinicframe.operators.skew import join_grouped
from clinicframe.schemas import CLUSTER_KEY, LOAD_ORDER, PRIMARY_KEY, TABLES
from clinicframe.session import ensure_checkpoint_dir
from clinicframe.sources.versions import FULL_EVERY, LINES, State, Version, history, publish, remove_old, state


class Conflict(Exception):
    """Another writer changed the same rows, time and again or in a way that cannot be repeated."""


def current_version(spark: SparkSession, root: str) -> int:
    known = history(spark, root)
    return known[-1].version if known else 0


def _state(spark: SparkSession, root: str, version: int | None = None) -> State:
    found = state(spark, root, version)
    if found is None:
        raise ValueError(f"no snapshot {version or 0} under {root}")
    return found


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Clinic:
    """The current clinic, or an earlier version of it."""
    return clinic_of(_state(spark, root, version))


def clinic_of(found: State) -> Clinic:
    return Clinic(**{name: (lambda name=name: found.read(name)) for name in TABLES if name != "lab_test"}, lab_test=found.read("lab_test"))


def high_water_marks(spark: SparkSession, root: str) -> dict[str, int]:
    """The highest key each table ever held since the last reset."""
    return {name: mark or 0 for name, mark in _state(spark, root).entry.marks.items()}


def _write(df: DataFrame, table: str, root: str, parts: int | None = None) -> tuple[list[tuple], int]:
    """Write rows as files that are ranges of the cluster key; returns a line for each and the highest primary key.

    Without ``parts`` adaptive execution sizes the files. The primary key comes second,
    so a key with very many rows is spread over several files.
    """
    spark, key, primary = df.sparkSession, CLUSTER_KEY[table], PRIMARY_KEY[table]
    order = list(dict.fromkeys((key, primary)))
    spread = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    path = f"{root}/{table}/{uuid.uuid4().hex}"
    spread.sortWithinPartitions(*order).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.max(primary).alias("top")
    )
    found = stored.collect()
    top = 0 if table == "clinic_patients" else max((r["top"] or 0 for r in found), default=0)
    text = lambda value: None if value is None else str(value)
    return [(table, r["path"], r["n"], text(r["low"]), text(r["high"]), False) for r in found], top


def _stored_lines(lines: DataFrame, root: str) -> str:
    path = f"{root}/_lines/{uuid.uuid4().hex}"
    lines.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LINES.split(", ")]).coalesce(1).write.parquet(path)
    return path


def commit_snapshot(
    clinic: Clinic, root: str, changed: tuple[str, ...] | None = None, reset: bool = False, check: bool = True, parts: int | None = None
) -> int:
    """Publish whole tables as the next version; with ``changed``, other tables keep their files.

    ``check`` tests every rule on the tables written and refuses broken ones. ``reset``
    forgets the high-water marks, as a full reload does. If another version appears
    meanwhile, the commit is refused: it replaces rows that it has not seen.
    """
    spark, base = clinic.spark, state(clinic.spark, root)
    names = [n for n in LOAD_ORDER if base is None or changed is None or n in changed]
    if check:
        quality.enforce(guards.of_tables(clinic, names))
    marks = {} if base is None else dict(base.entry.marks)
    schemas = {} if base is None else dict(base.entry.schemas)
    lines = [base.lines.filter(~F.col("table_name").isin(names))] if base else []
    for name in names:
        written, top = _write(clinic.table(name), name, root, parts)
        lines.append(spark.createDataFrame(written, LINES))
        schemas[name] = clinic.table(name).schema.json()
        if name != "clinic_patients":
            marks[name] = top if reset else max(top, marks.get(name) or 0)
    number = base.version + 1 if base else 1
    entry = Version(number, _stored_lines(reduce(DataFrame.unionByName, lines), root), True, None, marks, schemas)
    if not publish(spark, root, entry):
        raise Conflict(f"version {number} was published meanwhile")
    return number


def reload(clinic: Clinic, root: str, check: bool = True) -> int:
    """Replace everything with the given tables and start key numbering over."""
    return commit_snapshot(clinic, root, reset=True, check=check)


def touched_files(found: State, edit: Edit) -> list[str]:
    """Paths of the files that hold rows the edit touches; reads no other columns than those it looks for."""
    table, key, bounds = edit.table, CLUSTER_KEY[edit.table], None
    column = None if edit.keys is None else edit.keys.columns[0]
    if column == key:
        bounds = edit.keys.agg(F.min(column), F.max(column)).first()
        if bounds[0] is None:
            return []
    paths = found.files(table, bounds)
    if not paths:
        return []
    rows, path = found.read(table, paths), F.col("_metadata.file_path").alias("path")
    if column is None:
        hits = rows.filter(edit.condition).select(path)
    else:
        hits = join_grouped(rows.select(column, path), edit.keys.distinct(), column, "left_semi").select("path")
    return [r["path"] for r in hits.distinct().collect()]


class _Staged(NamedTuple):
    """Files written for a change but not published: lines, changed and removed rows by table."""

    lines: list[tuple]
    stored: str
    changed: str
    gone: set[str]
    rows: dict[str, tuple[DataFrame, DataFrame]]
    marks: dict[str, int]
    schemas: dict[str, str]


def _widened(schema: T.StructType, other: T.StructType) -> T.StructType:
    """A table's columns and those that a change brings in; files without them read as NULL."""
    return T.StructType([*schema.fields, *[f for f in other.fields if f.name not in schema.names]])


def _stage(base: State, edits: Sequence[Edit]) -> _Staged | None:
    """Write what the edits change; None if they touch nothing."""
    spark, root = base.spark, base.root
    ensure_checkpoint_dir(spark)
    lines, gone, rows, marks, schemas, keys = [], set(), {}, dict(base.entry.marks), dict(base.entry.schemas), []
    repeated = {e.table for e in edits if sum(o.table == e.table for o in edits) > 1}
    if repeated:
        raise ValueError(f"more than one edit of {', '.join(sorted(repeated))}")
    for edit in edits:
        table, written, tops, schema = edit.table, [], [], base.entry.schema(edit.table)
        files = touched_files(base, edit) if edit.rewrite else []
        pieces = [(edit.rewrite(base.read(table, files)), len(files))] if files else []
        pieces += [(edit.added, None)] if edit.added is not None else []
        for rows_of, parts in pieces:
            schema = _widened(schema, rows_of.schema)
            found, top = _write(rows_of, table, root, parts)
            written += found
            tops.append(top)
        gone |= set(files)
        schemas[table] = schema.json()
        if not pieces:
            continue
        lines += written + [(table, path, None, None, None, True) for path in files]
        new = spark.read.schema(schema).parquet(*[w[1] for w in written]) if written else spark.createDataFrame([], schema)
        old = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
        rows[table] = tuple(part.checkpoint() for part in guards.difference(new, old))
        for part in rows[table]:
            keys.append(part.select(F.lit(CLUSTER_KEY[table]).alias("space"), F.col(CLUSTER_KEY[table]).cast("string").alias("key")))
        marks[table] = max(*tops, marks.get(table) or 0) if table != "clinic_patients" else None
    if not lines:
        return None
    changed = f"{root}/_changed/{uuid.uuid4().hex}"
    reduce(DataFrame.unionByName, keys).distinct().write.parquet(changed)
    return _Staged(lines, _stored_lines(spark.createDataFrame(lines, LINES), root), changed, gone, rows, marks, schemas)


def _collides(staged: _Staged, later: list[Version], latest: State) -> bool:
    """Whether versions published since then replaced one of our files or changed rows of one of our keys."""
    if any(v.changed is None for v in later) or not staged.gone <= latest.all_files():
        return True
    theirs = latest.spark.read.parquet(*[v.changed for v in later])
    return not latest.spark.read.parquet(staged.changed).join(theirs, ["space", "key"], "left_semi").isEmpty()


def commit_changes(spark: SparkSession, root: str, change: Callable[[Clinic], Sequence[Edit]], tries: int = 8) -> int:
    """Publish a change as the next version, or raise and publish nothing.

    ``change`` gets the current clinic and returns edits, at most one a table; after a
    collision with another writer it is called again with the clinic as it is then. A
    broken rule is an error; ``Conflict`` is raised after ``tries`` collisions.
    """
    for _ in range(tries):
        base = _state(spark, root)
        staged = _stage(base, change(clinic_of(base)))
        if staged is None:
            return base.version
        latest, first = base, True
        while True:
            entry = _entry(staged, base, latest)
            after = latest.after(staged.lines, entry)
            broken = guards.of_changes(clinic_of(after), staged.rows)
            if broken is not None and first:
                quality.enforce(broken)
            elif broken is not None and not broken.isEmpty():
                break
            if entry.version % FULL_EVERY == 0:
                entry = entry._replace(lines=_stored_lines(after.lines, root), full=True)
            if publish(spark, root, entry):
                return entry.version
            latest, first = _state(spark, root), False
            if _collides(staged, history(spark, root, base.version + 1, latest.version), latest):
                break
    raise Conflict(f"other writers changed the same rows {tries} times")


def _entry(staged: _Staged, base: State, latest: State) -> Version:
    """The version after ``latest``: of marks the higher, of schemas our own where we changed it."""
    marks = {t: max(staged.marks.get(t) or 0, latest.entry.marks.get(t) or 0) for t in {*staged.marks, *latest.entry.marks}}
    own = {t: s for t, s in staged.schemas.items() if s != base.entry.schemas[t]}
    return Version(latest.version + 1, staged.stored, False, staged.changed, marks, {**latest.entry.schemas, **own})


def reclaim(spark: SparkSession, root: str, keep: int = 1, hours: float = 24 * 7) -> int:
    """Delete files that none of the last ``keep`` versions holds; returns how many.

    Left alone are files younger than ``hours``: a commit under way may be about to name
    them, and a reader may still use an older version. Older versions become unreadable
    where they need a deleted file; their entries go with them.
    """
    versions = history(spark, root)
    if not versions:
        return 0
    kept = versions[-keep:]
    start = max(v.version for v in versions if v.full and v.version <= kept[0].version)
    needed = [v for v in versions if v.version >= start]
    used = spark.read.schema(LINES).parquet(*[v.lines for v in needed])
    # A file that came before the first kept version and was gone by then is named by the lines, but not needed.
    first = _state(spark, root, kept[0].version).all_files()
    named = {r["path"] for r in used.select("path").distinct().collect()}
    early = [v.lines for v in needed if v.version <= kept[0].version]
    dead = {r["path"] for r in spark.read.schema(LINES).parquet(*early).select("path").distinct().collect()} - first
    folders = [f"{root}/{t}" for t in TABLES]
    gone = remove_old(spark, folders, (named - dead), hours)
    gone += remove_old(spark, [f"{root}/_lines", f"{root}/_changed"], {x for v in needed for x in (v.lines, v.changed) if x}, hours)
    return gone + remove_old(spark, [f"{root}/_versions"], {f"{root}/_versions/{v.version:012d}.json" for v in needed}, hours)
