"""What the engine knows of tables, views, indexes and routines. All of it is copied on write, so a snapshot is a plain copy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame

from heddle.errors import DependencyError, DuplicateError, MissingError
from heddle.plans.statements import Kind

#: Changes that are listed, the latest ones.
MOST_CHANGES = 1000
#: What stands between a schema's name and a table's.
MARK = "__"


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind
    not_null: bool = False
    default: str | None = None
    #: Its name in the table's pieces, if that is another.
    stored: str | None = None

    @property
    def serial(self) -> bool:
        return self.kind.name in ("SERIAL", "BIGSERIAL")


@dataclass(frozen=True)
class Constraint:
    """``kind`` is primary, unique, check or foreign. ``columns`` of a check are those that it names."""

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    check: str | None = None
    to_table: str | None = None
    to_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Table:
    """A table. Its rows are those of all its pieces, or a registered DataFrame's until it is changed."""

    name: str
    columns: tuple[Column, ...]
    constraints: tuple[Constraint, ...]
    df: DataFrame
    version: int = 0
    pieces: tuple[str, ...] = ()
    #: Greatest number given in each serial column.
    serials: tuple[tuple[str, int], ...] = ()
    #: Names that the pieces use, of columns that were dropped too.
    used: tuple[str, ...] = ()
    #: Whether its rows are a registered DataFrame's, and in no piece yet.
    external: bool = False

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise MissingError(f"table {self.name} has no column {name}")

    def names(self) -> set[str]:
        return {c.name.lower() for c in self.columns}


@dataclass(frozen=True)
class View:
    """A view's query. A materialized one has rows, and the versions of the tables that it was made from."""

    name: str
    query: str
    columns: tuple[str, ...] = ()
    materialized: bool = False
    df: DataFrame | None = None
    piece: str | None = None
    made_from: tuple[tuple[str, int], ...] = ()
    refreshed: int = 0
    #: Seconds between refreshes, when the last one was, and how long it took.
    every: float | None = None
    made_at: float | None = None
    took: float | None = None


@dataclass(frozen=True)
class Routine:
    name: str
    parameters: tuple[tuple[str, str, str], ...]
    body: str


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    routines: dict[str, Routine] = field(default_factory=dict)
    functions: dict[str, str] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=lambda: {"public"})
    #: Tables' definitions over time: table, version, statement.
    history: list[tuple[str, int, str]] = field(default_factory=list)
    #: Changes of rows: table, version, kind, rows.
    changes: list[tuple[str, int, str, int]] = field(default_factory=list)
    #: Last batch of each stream that was inserted.
    streams: dict[str, int] = field(default_factory=dict)

    def copy(self) -> Catalog:
        return Catalog(dict(self.tables), dict(self.views), dict(self.indexes), dict(self.routines), dict(self.functions), set(self.schemas), list(self.history), list(self.changes), dict(self.streams))

    def table(self, name: str) -> Table:
        if (t := self.tables.get(name.lower())) is None:
            raise MissingError(f"there is no table {name}")
        return t

    def put(self, table: Table) -> None:
        self.tables[table.name.lower()] = table

    def free(self, name: str) -> None:
        if name.lower() in self.tables or name.lower() in self.views:
            raise DuplicateError(f"there is already a table or view {name}")

    def changed(self, table: Table, kind: str, rows: int) -> None:
        self.changes = [*self.changes, (table.name, table.version, kind, rows)][-MOST_CHANGES:]

    def unique_keys(self, name: str) -> list[tuple[str, tuple[str, ...], bool]]:
        """Names and columns of what must be unique, and whether it is the primary key."""
        t = self.table(name)
        out = [(c.name, c.columns, c.kind == "primary") for c in t.constraints if c.kind in ("primary", "unique")]
        return out + [(i.name, i.columns, False) for i in self.indexes.values() if i.unique and i.table == name.lower()]

    def referrers(self, name: str, column: str | None = None) -> list[tuple[Table, Constraint]]:
        """Foreign keys to a table, its own too."""
        return [(t, c) for t in self.tables.values() for c in t.constraints if c.kind == "foreign" and c.to_table == name.lower() and (column is None or column.lower() in [x.lower() for x in c.to_columns])]

    def refer_to(self, table: str, rename: Callable[[tuple[str, ...]], tuple[str, ...]], name: str | None = None) -> None:
        """Let foreign keys to a table follow its new name, and its columns' new names."""

        def followed(c: Constraint) -> Constraint:
            return replace(c, to_table=(name or table).lower(), to_columns=rename(c.to_columns)) if c.kind == "foreign" and c.to_table == table.lower() else c

        self.tables = {k: replace(t, constraints=tuple(followed(c) for c in t.constraints)) for k, t in self.tables.items()}

    def drop_table(self, name: str) -> None:
        self.table(name)
        if used := [t for t, _ in self.referrers(name) if t.name.lower() != name.lower()]:
            raise DependencyError(f"table {name} is referred to by {used[0].name}", "drop the constraint first")
        del self.tables[name.lower()]
        self.indexes = {k: i for k, i in self.indexes.items() if i.table != name.lower()}

    # ---- on disk

    def live(self) -> set[str]:
        """All pieces that it names."""
        return {p for t in self.tables.values() for p in t.pieces} | {v.piece for v in self.views.values() if v.piece}

    def state(self, kept: Callable[[Table], bool]) -> dict:
        """As plain values; rows are named by their pieces, and tables that aren't ``kept`` are left out."""

        def plain(x: Table | View) -> dict:
            return {k: v for k, v in asdict(replace(x, df=None)).items() if k != "df"}

        return {
            "tables": [plain(t) for t in self.tables.values() if kept(t)],
            "views": [plain(v) | {"schema": v.df.schema.json() if v.piece else None} for v in self.views.values()],
            "indexes": [asdict(i) for i in self.indexes.values()],
            "routines": [asdict(r) for r in self.routines.values()],
            "functions": self.functions, "schemas": sorted(self.schemas), "history": self.history, "changes": self.changes, "streams": self.streams,
        }

    @classmethod
    def of(cls, state: dict, table_rows: Callable[[Table], DataFrame], view_rows: Callable[[str, str], DataFrame]) -> Catalog:
        """The catalog of plain values, with rows read by the two functions."""
        tuples = lambda xs: tuple(tuple(x) if isinstance(x, list) else x for x in xs)
        out = cls()
        for t in state["tables"]:
            columns = tuple(Column(**c | {"kind": Kind(**c["kind"])}) for c in t["columns"])
            constraints = tuple(Constraint(**c | {"columns": tuple(c["columns"]), "to_columns": tuple(c["to_columns"])}) for c in t["constraints"])
            table = Table(t["name"], columns, constraints, None, t["version"], tuple(t["pieces"]), tuples(t["serials"]), tuple(t["used"]))
            out.put(replace(table, df=table_rows(table)))
        for v in state["views"]:
            schema = v.pop("schema")
            view = View(**v | {"columns": tuple(v["columns"]), "made_from": tuples(v["made_from"])})
            out.views[view.name.lower()] = replace(view, df=view_rows(view.piece, schema)) if view.piece else view
        out.indexes = {i["name"].lower(): Index(**i | {"columns": tuple(i["columns"])}) for i in state["indexes"]}
        out.routines = {r["name"].lower(): Routine(**r | {"parameters": tuples(r["parameters"])}) for r in state["routines"]}
        out.functions, out.schemas, out.streams = dict(state["functions"]), set(state["schemas"]), dict(state["streams"])
        out.history, out.changes = [tuple(x) for x in state["history"]], [tuple(x) for x in state["changes"]]
        return out
