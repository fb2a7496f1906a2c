"""The database facade: SQL over versioned tables, with sessions, constraints and statistics.

Queries go to Spark SQL over views of the tables' pinned versions; DDL and DML become
DataFrame transformations that write new folders.  Each statement outside a session is a
transaction of its own; a session pins a snapshot, sees its own changes and commits them
together, or raises Conflict if someone else changed the same table first, or one that a check
of keys has read.  Names of tables are found in any case.
"""

from __future__ import annotations

import copy
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.types import named
from millrace.plans.sqltext import Constraint, Reader, SqlError, doubles, null_placement
from millrace.sources.versioned import Conflict, Store

__all__ = ["Conflict", "ConstraintError", "Database", "Result", "Session", "SqlError"]
ROW_ID = "row_id"


class ConstraintError(ValueError):
    """Rows that break a declared constraint."""


@dataclass
class Result:
    """What a statement gives: rows, a count of affected rows, or a message."""

    rows: DataFrame | None = None
    affected: int | None = None
    message: str | None = None

    def collect(self) -> list:
        return self.rows.collect() if self.rows is not None else []


class Session:
    """A transaction over one snapshot; a context manager that rolls back unless committed."""

    def __init__(self, db: Database):
        self.db = db
        self.lease, self.base = db.store.begin()
        self.tables: dict = copy.deepcopy(self.base["tables"])
        self.changed: set[str] = set()
        #: Tables that checks of keys have read.
        self.read: set[str] = set()
        self.open = True

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        if self.open:
            self.rollback()

    def commit(self) -> None:
        self._check_open()
        try:
            if self.changed:
                self.db.store.commit(self.base, self.tables, self.changed, self.read)
        finally:
            self._close()

    def rollback(self) -> None:
        self._check_open()
        self._close()

    def _close(self) -> None:
        self.open = False
        self.db.store.end(self.lease)

    def _check_open(self) -> None:
        if not self.open:
            raise SqlError("the transaction has ended")

    # -- tables

    def _known(self, name: str) -> str:
        """The table's own spelling of a name, or the name."""
        return name if name in self.tables else next((t for t in self.tables if t.lower() == name.lower()), name)

    def _meta(self, name: str) -> dict:
        name = self._known(name)
        if name not in self.tables:
            raise SqlError(f"no such table: {name}")
        return self.tables[name]

    def _schema(self, meta: dict) -> T.StructType:
        return T.StructType([T.StructField(ROW_ID, T.DecimalType(20, 0)), *(T.StructField(c["name"], named(c["type"]).spark) for c in meta["columns"])])

    def table(self, name: str) -> DataFrame:
        """A table's rows with its hidden row_id."""
        meta = self._meta(name)
        return self.db.store.read(meta["folders"], self._schema(meta))

    def _write(self, rows: DataFrame, cluster: list[str] | None = None) -> str:
        return self.db.store.write(rows, self.lease, cluster)

    def _put(self, name: str, **changes) -> None:
        self.tables[name] = self.tables[name] | changes | {"stamp": uuid.uuid4().hex}
        self.changed.add(name)

    # -- statements

    def execute(self, sql: str) -> Result:
        self._check_open()
        r = Reader(sql)
        word = r.peek()
        run = {"CREATE": self._create, "DROP": self._drop, "ALTER": self._alter, "INSERT": self._insert, "UPDATE": self._update, "DELETE": self._delete}.get(word)
        if run is not None:
            r.at += 1
            return run(r)
        if word in ("BEGIN", "COMMIT", "ROLLBACK"):
            raise SqlError(f"{word}: use session(), commit() and rollback()")
        return Result(rows=self._query(sql))

    def _query(self, sql: str) -> DataFrame:
        """Spark SQL over views of this transaction's tables, in a session of Spark's of their own."""
        spark = self.db.spark.newSession()
        words = {t.text.strip('`"').lower() for t in Reader(sql).found}
        for name in self.tables:
            if name.lower() in words:
                meta = self._meta(name)
                own = self.db.store.read(meta["folders"], self._schema(meta), spark)
                (own if ROW_ID in words else own.drop(ROW_ID)).createOrReplaceTempView(f"`{name}`")
        return spark.sql(doubles(null_placement(sql)))

    def _create(self, r: Reader) -> Result:
        if r.take("UNIQUE", "INDEX"):
            there = r.take("IF", "NOT", "EXISTS")
            index = r.name()
            r.need("ON")
            table = self._known(r.name())
            columns = r.names()
            r.end()
            meta = self._meta(table)
            if any(c["name"] == index for t in self.tables.values() for c in t["constraints"]):
                if there:
                    return Result(message=f"index {index} exists")
                raise SqlError(f"index {index} exists")
            self._columns(meta, columns)
            constraint = vars(Constraint("unique", columns, index))
            self._check(table, self.table(table), [constraint])
            # the table is rewritten in the index's order, so that scans of a range skip row groups
            self._put(table, constraints=[*meta["constraints"], constraint], cluster=columns, folders=[self._write(self.table(table), columns)])
            return Result(message=f"index {index} created")
        r.need("TABLE")
        there = r.take("IF", "NOT", "EXISTS")
        name = self._known(r.name())
        columns, constraints = [], []
        r.need("(")
        while True:
            found = r.constraint()
            if found is not None:
                constraints.append(found)
            else:
                column, more = r.column()
                columns.append(column)
                constraints += more
            if not r.take(","):
                break
        r.need(")")
        r.end()
        if name in self.tables:
            if there:
                return Result(message=f"table {name} exists")
            raise SqlError(f"table {name} exists")
        if len({c.name for c in columns}) < len(columns) or any(c.name == ROW_ID for c in columns) or not columns:
            raise SqlError("column names must differ from each other and from row_id")
        if sum(c.kind == "primary" for c in constraints) > 1:
            raise SqlError("a table has one primary key")
        for c in columns:
            named(c.type)
        self.tables[name] = {"columns": [vars(c) for c in columns], "constraints": [], "folders": [], "next_row_id": 1, "cluster": None, "stats": None}
        for c in constraints:
            self._add_constraint(name, c)
        self._put(name)
        return Result(message=f"table {name} created")

    def _columns(self, meta: dict, names: list[str]) -> list[dict]:
        known = {c["name"]: c for c in meta["columns"]}
        for n in names:
            if n not in known:
                raise SqlError(f"no such column: {n}")
        return [known[n] for n in names]

    def _add_constraint(self, table: str, c: Constraint) -> None:
        meta = self._meta(table)
        own = self._columns(meta, c.columns)
        if c.kind == "primary":
            if any(x["kind"] == "primary" for x in meta["constraints"]):
                raise SqlError("a table has one primary key")
            for column in own:
                column["not_null"] = True
        if c.kind == "foreign":
            c.table = self._known(c.table)
            self.read.add(c.table)
            self._columns(self._meta(c.table), c.target)
            if len(c.columns) != len(c.target):
                raise SqlError("a foreign key has as many columns as its target")
        meta["constraints"] = [*meta["constraints"], vars(c)]

    def _drop(self, r: Reader) -> Result:
        r.need("TABLE")
        there = r.take("IF", "EXISTS")
        name = self._known(r.name())
        cascade = r.take("CASCADE")
        r.end()
        if name not in self.tables:
            if there:
                return Result(message=f"no table {name}")
            raise SqlError(f"no such table: {name}")
        for other, meta in self.tables.items():
            refers = [c for c in meta["constraints"] if c["kind"] == "foreign" and c["table"] == name]
            if refers and other != name:
                if not cascade:
                    raise SqlError(f"{other} refers to {name}")
                self._put(other, constraints=[c for c in meta["constraints"] if c not in refers])
        del self.tables[name]
        self.changed.add(name)
        return Result(message=f"table {name} dropped")

    def _alter(self, r: Reader) -> Result:
        r.need("TABLE")
        name = self._known(r.name())
        before = copy.deepcopy(self._meta(name))
        meta = self.tables[name] = copy.deepcopy(before)
        rows, old = self.table(name), self._schema(before)
        try:
            if r.take("ADD"):
                constraint = r.constraint()
                if constraint is not None:
                    self._add_constraint(name, constraint)
                else:
                    r.take("COLUMN")
                    column, more = r.column()
                    named(column.type)
                    if column.name in old.names:
                        raise SqlError(f"column {column.name} exists")
                    meta["columns"].append(vars(column))
                    for c in more:
                        self._add_constraint(name, c)
                    rows = rows.withColumn(column.name, F.expr(column.default or "NULL").cast(named(column.type).spark))
            elif r.take("DROP"):
                r.take("COLUMN")
                gone = r.name()
                self._columns(meta, [gone])
                if any(gone in c["columns"] for c in meta["constraints"]) or any(c["kind"] == "foreign" and c["table"] == name and gone in c["target"] for t in self.tables.values() for c in t["constraints"]):
                    raise SqlError(f"a constraint names column {gone}")
                meta["columns"] = [c for c in meta["columns"] if c["name"] != gone]
                rows = rows.drop(gone)
            elif r.take("ALTER") or r.take("MODIFY"):
                r.take("COLUMN")
                column = self._columns(meta, [r.name()])[0]
                if r.take("SET", "DEFAULT"):
                    column["default"] = r.until()
                elif r.take("DROP", "DEFAULT"):
                    column["default"] = None
                elif r.take("SET", "NOT", "NULL"):
                    column["not_null"] = True
                elif r.take("DROP", "NOT", "NULL"):
                    column["not_null"] = False
                else:
                    r.take("TYPE")
                    column["type"] = r.type_name()
                    rows = rows.withColumn(column["name"], F.col(column["name"]).cast(named(column["type"]).spark))
            else:
                raise SqlError("expected ADD, DROP, ALTER or MODIFY")
            r.end()
            self._check(name, rows, meta["constraints"])
            changed = rows.schema.names != old.names or self._schema(meta) != old
            self._put(name, folders=[self._write(rows, meta["cluster"])] if changed else meta["folders"])
        except Exception:
            self.tables[name] = before
            raise
        return Result(message=f"table {name} altered")

    # -- constraints

    def _check(self, name: str, rows: DataFrame, constraints: list[dict], old: DataFrame | None = None) -> None:
        """Raise unless rows satisfy NOT NULL, ranges and the constraints.

        Rows are the whole new table, or those added to `old`, of which only keys are read.
        """
        meta = self._meta(name)
        broken = []
        for c in meta["columns"]:
            column = F.col(c["name"])
            if c["not_null"]:
                broken.append((f"{c['name']} is NULL", column.isNull()))
            if (inside := named(c["type"]).in_range(column)) is not None:
                broken.append((f"{c['name']} is out of the range of {c['type']}", ~inside))
        if broken:
            counts = rows.agg(*(F.count(F.when(bad, 1)).alias(f"c{k}") for k, (_, bad) in enumerate(broken))).first()
            for k, (what, _) in enumerate(broken):
                if counts[k]:
                    raise ConstraintError(f"{name}: {what} in {counts[k]} rows")
        for c in constraints:
            some = rows.dropna(subset=c["columns"])
            if c["kind"] in ("primary", "unique"):
                if some.groupBy(*c["columns"]).count().where("count > 1").limit(1).count():
                    raise ConstraintError(f"{name}: {', '.join(c['columns'])} is not unique")
                if old is not None and some.join(old.select(*c["columns"]), c["columns"], "left_semi").limit(1).count():
                    raise ConstraintError(f"{name}: {', '.join(c['columns'])} is not unique")
            else:
                self.read.add(c["table"])
                parent = self.table(c["table"]) if c["table"] != name else rows if old is None else old.unionByName(rows)
                target = parent.select(*(F.col(t).alias(f"t{k}") for k, t in enumerate(c["target"]))).distinct()
                on = [F.col(own) == F.col(f"t{k}") for k, own in enumerate(c["columns"])]
                if some.join(target, on, "left_anti").limit(1).count():
                    raise ConstraintError(f"{name}: {', '.join(c['columns'])} has no match in {c['table']}")

    def _check_children(self, name: str, rows: DataFrame) -> None:
        """Raise if rows, the whole new table, lack a key that another table refers to."""
        for other, meta in self.tables.items():
            for c in meta["constraints"]:
                if c["kind"] == "foreign" and c["table"] == name and other != name:
                    self.read.add(other)
                    target = rows.select(*(F.col(t).alias(f"t{k}") for k, t in enumerate(c["target"]))).distinct()
                    on = [F.col(own) == F.col(f"t{k}") for k, own in enumerate(c["columns"])]
                    if self.table(other).dropna(subset=c["columns"]).join(target, on, "left_anti").limit(1).count():
                        raise ConstraintError(f"{other} refers to rows of {name}")

    # -- DML

    def _insert(self, r: Reader) -> Result:
        r.need("INTO")
        name = self._known(r.name())
        meta = self._meta(name)
        given = r.names() if r.peek() == "(" else [c["name"] for c in meta["columns"]]
        if len(set(given)) < len(given):
            raise SqlError("a column is named twice")
        self._columns(meta, given)
        if r.peek() not in ("VALUES", "SELECT", "WITH"):
            raise SqlError("expected VALUES or SELECT")
        source = self._query(r.rest() if r.peek() != "VALUES" else f"SELECT * FROM {r.rest()}")
        if len(source.columns) != len(given):
            raise SqlError(f"{len(given)} columns, {len(source.columns)} values")
        fresh = source.toDF(*(f"v{k}" for k in range(len(given))))
        out = []
        for c in meta["columns"]:
            value = F.col(f"v{given.index(c['name'])}") if c["name"] in given else F.expr(c["default"] or "NULL")
            out.append(value.cast(named(c["type"]).spark).alias(c["name"]))
        fresh = fresh.select(*out)
        return Result(affected=self._append(name, fresh))

    def _append(self, name: str, fresh: DataFrame) -> int:
        """Number rows, which have the table's columns, write them and check them against the table."""
        meta = self._meta(name)
        # number rows within the partitions that they have, then shift each partition by those before it
        spread = fresh.withColumn("p_", F.spark_partition_id())
        staged = self._write(spread)
        held = self.db.store.read([staged], spread.schema)
        counted = held.groupBy("p_").agg(F.count(F.lit(1)).alias("n_"))
        before = F.coalesce(F.sum("n_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shifts = counted.select("p_", before.alias("before_"))
        n = counted.agg(F.sum("n_")).first()[0] or 0
        if n:
            within = F.row_number().over(Window.partitionBy("p_").orderBy(F.monotonically_increasing_id()))
            rows = held.withColumn("w_", within).join(shifts, "p_").withColumn(ROW_ID, (F.col("before_") + F.col("w_") + (meta["next_row_id"] - 1)).cast(T.DecimalType(20, 0))).select(ROW_ID, *(c["name"] for c in meta["columns"]))
            folder = self._write(rows, meta["cluster"])
            added = self.db.store.read([folder], self._schema(meta))
            self._check(name, added, meta["constraints"], self.table(name) if meta["folders"] else None)
            self._put(name, folders=[*meta["folders"], folder], next_row_id=meta["next_row_id"] + n)
        self.db.store.drop(staged)
        return n

    def _where(self, r: Reader) -> str:
        """The condition that ends the statement, or TRUE."""
        if not r.take("WHERE"):
            r.end()
            return "TRUE"
        if not r.rest():
            raise SqlError("expected a condition")
        return r.rest()

    def _marked(self, name: str, condition: str, values: list[str]) -> DataFrame:
        """The table's rows with hit_, whether the condition is true, and values as n0_, n1_, ..."""
        more = "".join(f", ({v}) AS n{k}_" for k, v in enumerate(values))
        found = self._query(f"SELECT {ROW_ID}, `{name}`.*, coalesce(({condition}), false) AS hit_{more} FROM `{name}`")
        return found.toDF("id_", *self._schema(self._meta(name)).names, "hit_", *(f"n{k}_" for k in range(len(values)))).drop("id_")

    def _update(self, r: Reader) -> Result:
        name = self._known(r.name())
        meta = self._meta(name)
        r.need("SET")
        sets: list[tuple[str, str]] = []
        while True:
            column = r.name()
            r.need("=")
            sets.append((column, r.until(",", "WHERE")))
            if not r.take(","):
                break
        condition = self._where(r)
        if ROW_ID in [c for c, _ in sets] or len({c for c, _ in sets}) < len(sets):
            raise SqlError("a column is set twice, or row_id is set")
        kinds = {c["name"]: named(c["type"]).spark for c in self._columns(meta, [c for c, _ in sets])}
        marked = self._marked(name, condition, [e for _, e in sets])
        n = marked.where("hit_").count()
        if n:
            new = marked.withColumns({c: F.when(F.col("hit_"), F.col(f"n{k}_").cast(kinds[c])).otherwise(F.col(c)) for k, (c, _) in enumerate(sets)})
            self._replace(name, new.select(*self._schema(meta).names))
        return Result(affected=n)

    def _delete(self, r: Reader) -> Result:
        r.need("FROM")
        name = self._known(r.name())
        marked = self._marked(name, self._where(r), [])
        n = marked.where("hit_").count()
        if n:
            self._replace(name, marked.where("NOT hit_").drop("hit_"))
        return Result(affected=n)

    def _replace(self, name: str, rows: DataFrame) -> None:
        meta = self._meta(name)
        folder = self._write(rows, meta["cluster"])
        new = self.db.store.read([folder], self._schema(meta))
        self._check(name, new, meta["constraints"])
        self._check_children(name, new)
        self._put(name, folders=[folder])


class Database:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Database:
        if Store.exists(spark, path):
            raise SqlError(f"a database is at {path}")
        db = cls(spark, path)
        db.store.create()
        return db

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Database:
        if not Store.exists(spark, path):
            raise SqlError(f"no database at {path}")
        return cls(spark, path)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str) -> Database:
        return cls.open(spark, path) if Store.exists(spark, path) else cls.create(spark, path)

    def session(self) -> Session:
        return Session(self)

    def execute(self, sql: str) -> Result:
        """One statement as a transaction of its own."""
        with self.session() as s:
            result = s.execute(sql)
            s.commit()
            return result

    def append(self, name: str, rows: DataFrame) -> int:
        """Insert rows of the table's columns, as INSERT ... SELECT does; the number of rows."""
        with self.session() as s:
            name = s._known(name)
            kinds = {c["name"]: named(c["type"]).spark for c in s._meta(name)["columns"]}
            n = s._append(name, rows.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items())))
            s.commit()
            return n

    def execute_batch(self, statements: list[str]) -> list[Result]:
        """All statements or none."""
        with self.session() as s:
            results = [s.execute(x) for x in statements]
            s.commit()
            return results

    def explain(self, sql: str) -> str:
        if Reader(sql).peek() not in ("SELECT", "WITH", "VALUES"):
            raise SqlError("only queries are explained")
        with self.session() as s:
            df = s._query(sql)
            return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def analyze(self, rate: float = 1.0, max_rows: int | None = None) -> dict:
        """Row counts and for each column distinct values, NULLs, least, greatest and average length; kept in the manifest.

        Of a table a share of `rate` is read, and about max_rows rows at most.
        """
        with self.session() as s:
            out = {}
            for name, meta in s.tables.items():
                rows = s.table(name)
                share = min(rate, max_rows / max(1, rows.count())) if max_rows is not None else rate
                rows = rows.sample(share, seed=1) if share < 1 else rows
                aggs = [F.count(F.lit(1)).alias("n")]
                for k, c in enumerate(meta["columns"]):
                    column = F.col(f"`{c['name']}`")
                    text = column.cast("string")
                    ordered = [F.min(column).cast("string"), F.max(column).cast("string")] if c["type"].upper() != "BLOB" else [F.lit(None).cast("string")] * 2
                    values = [F.count_distinct(column), F.count(F.when(column.isNull(), 1)), *ordered, F.avg(F.length(text))]
                    aggs += [v.alias(f"{x}{k}") for v, x in zip(values, ("ndv", "nulls", "min", "max", "len"), strict=True)]
                row = rows.agg(*aggs).first()
                columns = {c["name"]: {x: row[f"{x}{k}"] for x in ("ndv", "nulls", "min", "max", "len")} for k, c in enumerate(meta["columns"])}
                out[name] = {"rows": round(row["n"] / share) if share else 0, "sampled": row["n"], "columns": columns}
                s.tables[name] = meta | {"stats": out[name]}
                s.changed.add(name)
            s.commit()
            return out

    def vacuum(self) -> dict:
        """Remove versions that no open session of any process needs, and what ended transactions left."""
        return self.store.vacuum()
