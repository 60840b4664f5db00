"""A database of declared tables. Each table is an immutable DataFrame; a statement makes new ones,
checks constraints over whole sets of rows, and takes effect as a whole or not at all.

With a ``root`` folder (any file system that Spark reaches) a statement's new rows are written as
Parquet below it, so that later statements read files; an INSERT adds files and rewrites none.
Without a root, tables stay lazy DataFrames. ``version`` is the state after a statement, to which
``back_to`` returns; what is to outlive the session is written by ``dump``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConstraintError, SchemaError, ValueTypeError
from ..functions.predicates import definitely, is_false
from ..session import dialect_session
from .schema import Check, Column_, ForeignKey, Index, Kind, Table, Unique

State = dict[str, tuple[Table, DataFrame, tuple[str, ...]]]  # declaration, rows, the folders they are in


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class Database:
    """Statements run in a session of their own, under the dialect's settings; its views are its tables."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = dialect_session(spark), root
        self.state: State = {}
        #: The last micro-batch of each stream that is in the tables.
        self.batches: dict[str, int] = {}

    def _keep(self, table: Table, rows: DataFrame, more: DataFrame | None = None, paths: tuple[str, ...] = ()) -> tuple[Table, DataFrame, tuple[str, ...]]:
        """A table of ``rows``; or of the rows in ``paths`` (``rows``) and ``more``, of which alone is written."""
        if not self.root:
            return table, rows if more is None else rows.unionByName(more), ()
        path = f"{self.root}/{table.name}/{uuid.uuid4().hex}"
        new = rows if more is None else more
        for index in table.indexes[:1]:
            new = new.sortWithinPartitions(*index.columns)
        new.write.parquet(path)
        paths = (path,) if more is None else (*paths, path)
        return table, self.spark.read.schema(table.spark()).parquet(*paths), paths

    # --- versions ----------------------------------------------------------------------------

    def version(self) -> State:
        """All tables as they are now; later statements do not change it."""
        return dict(self.state)

    def back_to(self, version: State) -> None:
        """All tables as they were; what statements did since is no longer seen."""
        self.state = dict(version)

    @contextmanager
    def together(self) -> Iterator[None]:
        """Several statements that take effect all or, if one fails, not at all."""
        before = self.version()
        try:
            yield
        except BaseException:
            self.back_to(before)
            raise

    @contextmanager
    def _statement(self) -> Iterator[State]:
        """A copy of the state that takes effect if the block ends well."""
        state = dict(self.state)
        yield state
        self.state = state

    # --- reading -----------------------------------------------------------------------------

    def tables(self) -> list[str]:
        return sorted(self.state)

    def declaration(self, name: str) -> Table:
        return self._find(self.state, name)[0]

    def table(self, name: str) -> DataFrame:
        """The rows as of now: later statements do not change them."""
        return self._find(self.state, name)[1]

    @staticmethod
    def _find(state: State, name: str) -> tuple[Table, DataFrame, tuple[str, ...]]:
        if name not in state:
            raise SchemaError(f"no table {name}")
        return state[name]

    def select(self, sql: str, params: list[Any] | None = None) -> DataFrame:
        """A SELECT over all tables, as Spark SQL; each ``?`` takes the next parameter as a value."""
        for name in self.tables():
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=list(params or []))

    # --- declarations ------------------------------------------------------------------------

    def create_table(self, table: Table, if_not_exists: bool = False) -> None:
        with self._statement() as state:
            if table.name in state:
                if if_not_exists:
                    return
                raise SchemaError(f"table {table.name} is there already")
            for key in table.foreign:
                parent = table if key.parent == table.name else self._find(state, key.parent)[0]
                if set(key.parent_columns) not in [set(k) for k in parent.keys()]:
                    raise SchemaError(f"{key.parent} has no key on {', '.join(key.parent_columns)}")
            state[table.name] = (table, self.spark.createDataFrame([], table.spark()), ())

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        with self._statement() as state:
            if name not in state and if_exists:
                return
            self._find(state, name)
            if users := [t.name for t, _, _ in state.values() if t.name != name and any(f.parent == name for f in t.foreign)]:
                raise SchemaError(f"{name} is referenced by {', '.join(users)}")
            del state[name]

    def add_column(self, name: str, column: Column_) -> None:
        """Append a column; old rows get its default."""
        with self._statement() as state:
            table, rows, _ = self._find(state, name)
            table = replace(table, columns=(*table.columns, column))
            if column.not_null and column.default is None and not rows.isEmpty():
                raise ConstraintError(f"{column.name} would be null in rows of {name}")
            value, _ = column.kind.cast(F.lit(column.default), self.spark.range(1).select(F.lit(column.default)).schema[0].dataType)
            state[name] = self._keep(table, rows.withColumn(column.name, value.cast(column.kind.spark())))

    def drop_column(self, name: str, column: str) -> None:
        with self._statement() as state:
            table, rows, _ = self._find(state, name)
            users = [g for g in (*table.unique, *table.foreign, *table.indexes) if column in g.columns]
            users += [c for c in table.checks if not self._resolves(rows.drop(column), c.sql)]
            users += [f for t, _, _ in state.values() for f in t.foreign if f.parent == name and column in f.parent_columns]
            if users:
                raise SchemaError(f"{column} is used by {users[0]}")
            if column not in table.names:
                raise SchemaError(f"{name} has no column {column}")
            table = replace(table, columns=tuple(c for c in table.columns if c.name != column))
            state[name] = self._keep(table, rows.drop(column))

    @staticmethod
    def _resolves(rows: DataFrame, sql: str) -> bool:
        """Whether an expression needs no other columns than those of the rows."""
        try:
            return bool(rows.select(F.expr(sql)).columns)
        except AnalysisException:
            return False

    def create_index(self, name: str, index: Index) -> None:
        """Later scans of a stored table find its files sorted by the index's columns."""
        with self._statement() as state:
            table, rows, _ = self._find(state, name)
            if any(i.name == index.name for i in table.indexes):
                raise SchemaError(f"index {index.name} is there already")
            table = replace(table, indexes=(index, *table.indexes))
            if index.unique:
                self._check_unique(table, rows)
            state[name] = self._keep(table, rows)

    def drop_index(self, name: str, index: str) -> None:
        with self._statement() as state:
            table, rows, path = self._find(state, name)
            if all(i.name != index for i in table.indexes):
                raise SchemaError(f"no index {index} on {name}")
            state[name] = (replace(table, indexes=tuple(i for i in table.indexes if i.name != index)), rows, path)

    # --- changes -----------------------------------------------------------------------------

    def insert(self, name: str, rows: DataFrame | list[tuple], columns: list[str] | None = None) -> int:
        """Add rows; columns that are left out get their defaults. Returns the number of rows."""
        with self._statement() as state:
            table, old, paths = self._find(state, name)
            columns = columns or table.names
            if not isinstance(rows, DataFrame):
                rows = self._literal(rows, columns)
            if len(rows.columns) != len(columns) or set(columns) - set(table.names):
                raise SchemaError(f"{name}: columns and values do not match")
            new, count = self._checked(table, rows.toDF(*columns))
            self._check_unique(table, old, new)
            state[name] = self._keep(table, old, new, paths)
            self._check_parents(state, table, new, state[name][1])
            return count

    def _literal(self, rows: list[tuple], columns: list[str]) -> DataFrame:
        if any(len(r) != len(columns) for r in rows):
            raise SchemaError("columns and values do not match")
        mixed = [len({type(r[k]) for r in rows if r[k] is not None}) > 1 for k in range(len(columns))]
        rows = [tuple(str(v) if m and v is not None else v for v, m in zip(r, mixed, strict=True)) for r in rows]
        empty = [k for k in range(len(columns)) if all(r[k] is None for r in rows)]
        if len(empty) == len(columns) or not rows:
            return self.spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
        known = [k for k in range(len(columns)) if k not in empty]
        frame = self.spark.createDataFrame([tuple(r[k] for k in known) for r in rows], [columns[k] for k in known])
        return frame.select(*(F.col(f"`{c}`") if k in known else F.lit(None).cast("string").alias(c) for k, c in enumerate(columns)))

    def _checked(self, table: Table, rows: DataFrame, kept: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
        """Rows in the table's types and order, with the columns ``kept`` behind, and their number.

        A value that does not fit raises, and so does a row that breaks NOT NULL or CHECK; all of
        that is one pass over the rows."""
        given = {f.name: f.dataType for f in rows.schema.fields}
        one, out, tests = self.spark.range(1), [], {}
        for c in table.columns:
            if c.name in given:
                value, fits = c.kind.cast(F.col(f"`{c.name}`"), given[c.name])
                tests[c.name] = F.col(f"`{c.name}`").isNotNull() & ~F.coalesce(fits, F.lit(False))
            else:
                value, _ = c.kind.cast(F.lit(c.default), one.select(F.lit(c.default)).schema[0].dataType)
            out.append(value.cast(c.kind.spark()).alias(c.name))
        new = rows.select(*out, *kept)
        rules = self._rules(table)
        marked = rows.select(*out, *(t.alias(f"_misfit_{n}") for n, t in tests.items()))
        flags = [F.max(f"_misfit_{n}").alias(f"_misfit_{n}") for n in tests] + [F.max(r).alias(f"_rule_{k}") for k, r in enumerate(rules.values())]
        got = marked.agg(F.count(F.lit(1)).alias("_n"), *flags).first()
        for c in table.columns:
            if c.name in tests and got[f"_misfit_{c.name}"]:
                raise ValueTypeError(f"{table.name}.{c.name}: a value is no {c.kind}")
        self._raise(table, rules, got)
        return new, got["_n"]

    @staticmethod
    def _rules(table: Table) -> dict[str, Column]:
        """What no row may do, by name."""
        return {f"{c.name} is null": F.col(f"`{c.name}`").isNull() for c in table.columns if c.not_null} | {f"CHECK ({c.sql})": is_false(F.expr(c.sql)) for c in table.checks}

    @staticmethod
    def _raise(table: Table, rules: dict[str, Column], got: Any) -> None:
        for k, name in enumerate(rules):
            if got[f"_rule_{k}"]:
                raise ConstraintError(f"{table.name}: {name}")

    def _check_rows(self, table: Table, rows: DataFrame) -> None:
        """NOT NULL and CHECK in one pass."""
        if rules := self._rules(table):
            self._raise(table, rules, rows.agg(*(F.max(r).alias(f"_rule_{k}") for k, r in enumerate(rules.values()))).first())

    def _check_unique(self, table: Table, others: DataFrame, changed: DataFrame | None = None, columns: set[str] | None = None) -> None:
        """No key twice among ``others`` and the ``changed`` rows; only keys of changed rows need a
        look, and only those with one of ``columns``, if that is given."""
        for key in table.keys():
            if columns is not None and not columns & set(key):
                continue
            known = others.select(*key).dropna()
            if changed is not None:
                new = changed.select(*key).dropna()
                known = known.join(new, list(key), "left_semi").unionByName(new)
            if not known.groupBy(*key).count().where("count > 1").isEmpty():
                raise ConstraintError(f"{table.name}: two rows have the same {', '.join(key)}")

    def _check_parents(self, state: State, table: Table, rows: DataFrame, own: DataFrame, columns: set[str] | None = None) -> None:
        for f in table.foreign:
            if columns is not None and not columns & set(f.columns):
                continue
            parent = own if f.parent == table.name else self._find(state, f.parent)[1]
            wanted = rows.select(*f.columns).dropna().distinct()
            keys = parent.select(*f.parent_columns).toDF(*f.columns)
            if not wanted.join(keys, list(f.columns), "left_anti").isEmpty():
                raise ConstraintError(f"{table.name}: no row of {f.parent} for {', '.join(f.columns)}")

    def update(self, name: str, changes: dict[str, Column | Any], where: Column | None = None) -> int:
        """Set columns from expressions over the old row. Returns the number of rows that matched.

        Keys and references are looked at only if one of their columns is set."""
        with self._statement() as state:
            table, old, _ = self._find(state, name)
            if unknown := set(changes) - set(table.names):
                raise SchemaError(f"{name} has no column {', '.join(sorted(unknown))}")
            hit = definitely(where) if where is not None else F.lit(True)
            exprs = {c: v if isinstance(v, Column) else F.lit(v) for c, v in changes.items()}
            before = tuple(f"_old_{c}" for c in table.names)
            raw = old.where(hit).select(*(exprs.get(c, F.col(f"`{c}`")).alias(c) for c in table.names), *(F.col(f"`{c}`").alias(f"_old_{c}") for c in table.names))
            new, count = self._checked(table, raw, before)
            rest = old.where(~hit)
            self._check_unique(table, rest, new, set(changes))
            state[name] = self._keep(table, rest.unionByName(new.select(*table.names)))
            self._after_update(state, table, new, set(changes))
            self._check_parents(state, table, new, state[name][1], set(changes))
            return count

    def _after_update(self, state: State, table: Table, new: DataFrame, columns: set[str]) -> None:
        """Rows that referenced a changed key follow it, are set null, or forbid the change; then
        those that referenced such a row's changed key, level by level."""
        frontier = [(table, new, columns, 0)]
        while frontier:
            parent, moved, columns, depth = frontier.pop(0)
            for child_name, (child, _, _) in list(state.items()):
                for f in (f for f in child.foreign if f.parent == parent.name and columns & set(f.parent_columns)):
                    same = _all([F.col(f"`{c}`").eqNullSafe(F.col(f"_old_{c}")) for c in f.parent_columns])
                    sides = {f"_from_{k}": F.col(f"_old_{c}") for k, c in enumerate(f.parent_columns)} | {f"_to_{k}": F.col(f"`{c}`") for k, c in enumerate(f.parent_columns)}
                    pairs = moved.where(~same).select(*(v.alias(k) for k, v in sides.items()))
                    rows = state[child_name][1]
                    on = _all([F.col(f"`{c}`") == F.col(f"_from_{k}") for k, c in enumerate(f.columns)])
                    if f.on_update == "restrict":
                        still = state[parent.name][1].select(*f.parent_columns).toDF(*(f"_from_{k}" for k in range(len(f.columns))))
                        lost = pairs.join(still, list(still.columns), "left_anti")  # another row may have taken the old key
                        if not rows.join(lost, on, "left_semi").isEmpty():
                            raise ConstraintError(f"{child_name} references a changed key of {parent.name}")
                        continue
                    if depth > len(state):
                        raise ConstraintError(f"{child_name}: references that cascade run in a circle")
                    values = {c: F.col(f"_to_{k}") if f.on_update == "cascade" else F.lit(None) for k, c in enumerate(f.columns)}
                    after = rows.join(pairs, on).select(*(values.get(c, F.col(f"`{c}`")).cast(child.spark()[c].dataType).alias(c) for c in child.names), *(F.col(f"`{c}`").alias(f"_old_{c}") for c in child.names))
                    if after.isEmpty():
                        continue
                    rest = rows.join(pairs, on, "left_anti")
                    self._check_rows(child, after)
                    self._check_unique(child, rest, after, set(f.columns))
                    state[child_name] = self._keep(child, rest.unionByName(after.select(*child.names)))
                    frontier.append((child, after, set(f.columns), depth + 1))

    def delete(self, name: str, where: Column | None = None) -> int:
        """Delete rows, and what their deletion reaches. Returns the number of rows deleted from ``name``."""
        with self._statement() as state:
            table, rows, _ = self._find(state, name)
            hit = definitely(where) if where is not None else F.lit(True)
            gone = rows.where(hit)
            count = gone.count()
            if count:
                state[name] = self._keep(table, rows.where(~hit))
                self._after_delete(state, table, gone)
            return count

    def _after_delete(self, state: State, table: Table, gone: DataFrame) -> None:
        """Level by level: the children of each level's deleted rows. Rows leave a table at most once,
        so cycles end."""
        frontier = [(table, gone)]
        while frontier:
            parent, lost = frontier.pop(0)
            for child_name, (child, _, _) in list(state.items()):
                for f in (f for f in child.foreign if f.parent == parent.name):
                    rows = state[child_name][1]
                    keys = lost.select(*f.parent_columns).dropna().distinct().toDF(*f.columns)
                    hit = rows.join(keys, list(f.columns), "left_semi")
                    if hit.isEmpty():
                        continue
                    if f.on_delete == "restrict":
                        raise ConstraintError(f"{child_name} references a deleted row of {parent.name}")
                    if f.on_delete == "cascade":
                        stay = rows.join(keys, list(f.columns), "left_anti").select(*child.names)
                        state[child_name] = self._keep(child, stay)
                        frontier.append((child, hit.select(*child.names)))
                    else:
                        marked = rows.join(keys.withColumn("_hit", F.lit(True)), list(f.columns), "left")
                        after = marked.select(*((F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(f"`{c}`")).cast(child.spark()[c].dataType) if c in f.columns else F.col(f"`{c}`")).alias(c) for c in child.names))
                        self._check_rows(child, after)
                        state[child_name] = self._keep(child, after)

    # --- dumps -------------------------------------------------------------------------------

    def in_order(self) -> list[str]:
        """Tables with parents before children."""
        out: list[str] = []
        rest = {t.name: {f.parent for f in t.foreign} - {t.name} for t, _, _ in self.state.values()}
        while rest:
            free = sorted(n for n, parents in rest.items() if parents <= set(out)) or sorted(rest)[:1]
            out += free
            rest = {n: p for n, p in rest.items() if n not in out}
        return out

    def dump(self, path: str) -> None:
        """Declarations and rows of all tables as Parquet below ``path``."""
        text = json.dumps({"tables": [asdict(self.declaration(n)) for n in self.in_order()], "batches": self.batches}, default=lambda v: v.hex() if isinstance(v, (bytes, bytearray)) else str(v))
        for name in self.tables():
            self.table(name).write.parquet(f"{path}/rows/{name}")
        self.spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(f"{path}/declarations")

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> Database:
        """The tables of a dump as they lie there; statements go on from them in this session."""
        db = cls(spark)
        found = json.loads(db.spark.read.text(f"{path}/declarations").first()[0])
        for table in map(_table, found["tables"]):
            db.state[table.name] = (table, db.spark.read.schema(table.spark()).parquet(f"{path}/rows/{table.name}"), ())
        db.batches = found["batches"]
        return db

    def restore(self, path: str) -> int:
        """Create and fill the tables of a dump, all or none, under their constraints; returns the number of rows."""
        other = Database.stored(self.spark, path)
        with self.together():
            for name in other.in_order():
                self.create_table(other.declaration(name))
            count = sum(self.insert(name, other.table(name)) for name in other.in_order())
            self.batches |= other.batches
        return count


def _table(entry: dict) -> Table:
    names = lambda g: {k: tuple(v) if isinstance(v, list) else v for k, v in g.items()}
    default = lambda c: bytes.fromhex(c["default"]) if c["kind"]["name"] == "BLOB" and c["default"] is not None else c["default"]
    return Table(
        entry["name"],
        tuple(Column_(c["name"], Kind(**c["kind"]), c["not_null"], default(c)) for c in entry["columns"]),
        tuple(Unique(**names(u)) for u in entry["unique"]),
        tuple(Check(**c) for c in entry["checks"]),
        tuple(ForeignKey(**names(f)) for f in entry["foreign"]),
        tuple(Index(**names(i)) for i in entry["indexes"]),
    )
