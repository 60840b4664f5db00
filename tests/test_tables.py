"""Declared tables: types, constraints, DML with cascades, versions, storage."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyrock.errors import ConstraintError, SchemaError, ValueTypeError
from tallyrock.streaming import ingest
from tallyrock.tables import BIGINT, BLOB, BOOL, DATE, DATETIME, DECIMAL, INT, VARCHAR, Check, Column_, Database, ForeignKey, Index, Table, Unique

c = F.col
PK = (Unique(("id",), primary=True),)


def rows(db, name):
    return sorted((tuple(r) for r in db.table(name).collect()), key=str)


def blog(db, on_delete="cascade", on_update="cascade"):
    db.create_table(Table("authors", (Column_("id", INT), Column_("name", VARCHAR(50), not_null=True)), PK))
    db.create_table(Table("posts", (Column_("id", INT), Column_("author_id", INT), Column_("views", INT, True, 0)), PK, (Check("views >= 0"),), (ForeignKey(("author_id",), "authors", ("id",), on_delete, on_update),)))
    db.create_table(Table("comments", (Column_("id", INT), Column_("post_id", INT)), PK, (), (ForeignKey(("post_id",), "posts", ("id",), on_delete),)))
    db.insert("authors", [(1, "Ann"), (2, "Bob")])
    db.insert("posts", [(10, 1, 5), (11, 1, 7), (12, 2, 0)])
    db.insert("comments", [(100, 10), (101, 11), (102, 12)])
    return db


@pytest.mark.parametrize("kind,given,want", [
    (INT, "7", 7), (INT, 7.0, 7), (INT, "+5", 5), (BIGINT, 1 << 40, 1 << 40), (VARCHAR(4), "éé", "éé"), (VARCHAR(9), 12, "12"), (DECIMAL(10, 2), "99.5", Decimal("99.50")),
    (DECIMAL(2, 2), "0.25", Decimal("0.25")), (BOOL, "T", True), (BOOL, 0, False), (BOOL, "f", False), (DATE, "2024-02-29", dt.date(2024, 2, 29)),
    (DATETIME, "2024-01-02 03:04:05.678", dt.datetime(2024, 1, 2, 3, 4, 5, 678000)), (DATETIME, "2024-01-02", dt.datetime(2024, 1, 2)), (BLOB, "ab", bytearray(b"ab")),
])
def test_values_that_fit(spark, kind, given, want):
    db = Database(spark)
    db.create_table(Table("t", (Column_("v", kind),)))
    db.insert("t", [(given,), (None,)])
    assert {r[0] if not isinstance(r[0], bytearray) else bytes(r[0]) for r in db.table("t").collect()} == {bytes(want) if isinstance(want, bytearray) else want, None}


@pytest.mark.parametrize("kind,given", [
    (INT, 1 << 40), (INT, "x"), (INT, 1.5), (INT, True), (VARCHAR(3), "éé"), (DECIMAL(10, 2), "1.235"), (DECIMAL(3, 1), "1234"), (BOOL, "yes"), (BOOL, 2), (DATE, "2024-02-30"),
    (DATE, "24-1-1"), (DATETIME, "noon"), (BLOB, 5),
])
def test_values_that_do_not_fit(spark, kind, given):
    db = Database(spark)
    db.create_table(Table("t", (Column_("v", kind),)))
    with pytest.raises(ValueTypeError):
        db.insert("t", [(given,)])
    assert rows(db, "t") == []


def test_constraints(spark):
    db = Database(spark)
    db.create_table(Table("a", (Column_("id", INT), Column_("email", VARCHAR(100), not_null=True), Column_("balance", INT), Column_("on", BOOL, default=True)), (*PK, Unique(("email",)), Unique(("balance", "on"))), (Check("balance >= 0"),)))
    assert db.insert("a", [(1, "a@x", 100)], ["id", "email", "balance"]) == 1
    for bad in [(1, "b@x", 1), (2, "a@x", 1), (2, None, 1), (2, "b@x", -1), (None, "b@x", 1), (2, "b@x", 100)]:
        with pytest.raises(ConstraintError):
            db.insert("a", [bad], ["id", "email", "balance"])
    with pytest.raises(ConstraintError):  # as a whole or not at all
        db.insert("a", [(5, "e", 5), (5, "f", 6)], ["id", "email", "balance"])
    db.insert("a", [(2, "b@x", None), (3, "c@x", None)], ["id", "email", "balance"])  # null passes CHECK and UNIQUE
    assert rows(db, "a") == [(1, "a@x", 100, True), (2, "b@x", None, True), (3, "c@x", None, True)]
    assert db.update("a", {"id": c("id") + 1}) == 3  # checked on the final state
    with pytest.raises(ConstraintError):
        db.update("a", {"email": "same"})
    with pytest.raises(SchemaError):
        db.insert("a", [(9, "x")])


def test_dml(spark):
    db = blog(Database(spark))
    assert db.update("posts", {"views": c("views") + 1}, c("author_id") == 1) == 2
    assert rows(db, "posts") == [(10, 1, 6), (11, 1, 8), (12, 2, 0)]
    with pytest.raises(ConstraintError):
        db.update("posts", {"views": -1})
    with pytest.raises(ConstraintError):
        db.insert("posts", [(13, 99, 0)])
    db.insert("posts", [(13, None, 0)])  # a null reference is no reference
    assert db.delete("posts", c("views") > 100) == 0
    assert db.delete("authors", c("id") == 1) == 1
    assert rows(db, "posts") == [(12, 2, 0), (13, None, 0)] and rows(db, "comments") == [(102, 12)]


def test_actions(spark):
    db = blog(Database(spark), "restrict", "restrict")
    for change in (lambda: db.delete("authors", c("id") == 1), lambda: db.update("authors", {"id": 9}, c("id") == 1)):
        with pytest.raises(ConstraintError):
            change()
    assert len(rows(db, "authors")) == 2
    db = blog(Database(spark), "set null", "set null")
    db.delete("authors", c("id") == 1)
    assert rows(db, "posts") == [(10, None, 5), (11, None, 7), (12, 2, 0)]
    db.update("authors", {"id": 5}, c("id") == 2)
    assert (12, None, 0) in rows(db, "posts")
    db = blog(Database(spark))
    db.update("authors", {"id": c("id") + 1})  # keys 1, 2 become 2, 3: posts follow their author
    assert rows(db, "authors") == [(2, "Ann"), (3, "Bob")]


def test_cascade_blocked_below_and_cycles(spark):
    db = Database(spark)
    db.create_table(Table("a", (Column_("id", INT),), PK))
    db.create_table(Table("b", (Column_("id", INT), Column_("a", INT)), PK, (), (ForeignKey(("a",), "a", ("id",), "cascade"),)))
    db.create_table(Table("d", (Column_("id", INT), Column_("b", INT)), PK, (), (ForeignKey(("b",), "b", ("id",)),)))
    db.insert("a", [(1,)]), db.insert("b", [(2, 1)]), db.insert("d", [(3, 2)])
    with pytest.raises(ConstraintError):
        db.delete("a")
    assert (rows(db, "a"), rows(db, "b")) == ([(1,)], [(2, 1)])
    db.create_table(Table("tree", (Column_("id", INT), Column_("up", INT)), PK, (), (ForeignKey(("up",), "tree", ("id",), "cascade"),)))
    db.insert("tree", [(1, None), (2, 1), (3, 2)])
    db.update("tree", {"up": 3}, c("id") == 1)  # a cycle
    db.delete("tree", c("id") == 2)
    assert rows(db, "tree") == []


def test_declarations(spark):
    db = blog(Database(spark))
    with pytest.raises(SchemaError):
        db.create_table(Table("authors", (Column_("id", INT),)))
    db.create_table(Table("authors", (Column_("id", INT),)), if_not_exists=True)
    for bad in (lambda: db.drop_table("authors"), lambda: db.drop_table("none"), lambda: db.drop_column("posts", "views"), lambda: db.drop_column("authors", "id"), lambda: db.table("none")):
        with pytest.raises(SchemaError):
            bad()
    db.drop_table("none", if_exists=True)
    db.add_column("authors", Column_("born", DATE))
    with pytest.raises(ConstraintError):
        db.add_column("authors", Column_("x", INT, not_null=True))
    db.add_column("authors", Column_("x", INT, not_null=True, default=4))
    assert rows(db, "authors") == [(1, "Ann", None, 4), (2, "Bob", None, 4)]
    db.drop_column("authors", "born")
    db.create_index("posts", Index("by_author", ("author_id",)))
    with pytest.raises(ConstraintError):
        db.create_index("posts", Index("one_author", ("author_id",), unique=True))
    db.drop_index("posts", "by_author")
    with pytest.raises(SchemaError):
        db.drop_index("posts", "by_author")
    assert "PRIMARY KEY" in db.declaration("authors").ddl() and 'REFERENCES "authors"' in db.declaration("posts").ddl()
    for bad in (lambda: DECIMAL(19), lambda: VARCHAR(0), lambda: Table("t", ()), lambda: Table("t", (Column_("a", INT),), (Unique(("b",)),))):
        with pytest.raises(SchemaError):
            bad()


def test_versions(spark):
    db = blog(Database(spark))
    first = db.version()
    db.delete("comments")
    second = db.version()
    db.delete("posts")
    db.back_to(second)
    assert len(rows(db, "posts")) == 3 and rows(db, "comments") == []
    with pytest.raises(ConstraintError), db.together():  # all or none
        db.insert("comments", [(200, 10)])
        db.insert("comments", [(201, 99)])
    assert rows(db, "comments") == []
    db.back_to(first)
    assert len(rows(db, "comments")) == 3


def test_update_to_every_level(spark):
    db = blog(Database(spark))
    db.update("authors", {"id": c("id") + 1})
    assert rows(db, "posts") == [(10, 2, 5), (11, 2, 7), (12, 3, 0)]  # each follows its own author
    db.update("authors", {"id": F.lit(5) - c("id")})  # a swap
    assert rows(db, "posts") == [(10, 3, 5), (11, 3, 7), (12, 2, 0)]
    for action in ("cascade", "restrict", "set null"):
        db = Database(spark)
        db.create_table(Table("p", (Column_("id", INT),), PK))
        db.create_table(Table("c", (Column_("id", INT),), PK, (), (ForeignKey(("id",), "p", ("id",), "restrict", "cascade"),)))
        db.create_table(Table("g", (Column_("up", INT),), (), (), (ForeignKey(("up",), "c", ("id",), "restrict", action),)))
        for name in "pcg":
            db.insert(name, [(1,)])
        if action == "restrict":
            with pytest.raises(ConstraintError):
                db.update("p", {"id": 5})
            assert [rows(db, n) for n in "pcg"] == [[(1,)]] * 3
        else:
            db.update("p", {"id": 5})
            assert [rows(db, n) for n in "pcg"] == [[(5,)], [(5,)], [(5,) if action == "cascade" else (None,)]]


def test_columns_that_checks_read(spark):
    db = Database(spark)
    db.create_table(Table("t", (Column_("id", INT), Column_("bal", INT), Column_("balance", INT), Column_("note", VARCHAR(9), default="it's")), PK, (Check("balance >= 0 AND length('bal') = 3"),)))
    with pytest.raises(SchemaError):
        db.drop_column("t", "balance")
    db.drop_column("t", "bal")
    assert db.table("t").columns == ["id", "balance", "note"] and "DEFAULT 'it''s'" in db.declaration("t").ddl()


def test_storage(spark, tmp_path):
    db = blog(Database(spark, str(tmp_path / "db")))
    before, files = db.table("authors"), len(db.table("comments").inputFiles())
    db.insert("comments", [(103, 12)])
    assert set(db.state["comments"][2]) > set() and len(db.table("comments").inputFiles()) > files  # files are added, none rewritten
    db.delete("authors", c("id") == 1)
    assert rows(db, "authors") == [(2, "Bob")] and before.count() == 2  # a table read before stays as it was
    db.create_table(Table("b", (Column_("x", BLOB, default=b"a\x00"), Column_("d", DATE, default=dt.date(2024, 1, 2)), Column_("id", INT))))
    db.dump(str(tmp_path / "dump"))
    other = Database.stored(spark, str(tmp_path / "dump"))
    assert rows(other, "posts") == rows(db, "posts") and other.declaration("posts") == db.declaration("posts")
    other.insert("b", [(1,)], ["id"])
    assert rows(other, "b") == [(bytearray(b"a\x00"), dt.date(2024, 1, 2), 1)]
    copy = Database(spark, str(tmp_path / "copy"))
    assert copy.restore(str(tmp_path / "dump")) == 4
    assert rows(copy, "posts") == rows(db, "posts") and copy.in_order() == ["authors", "b", "posts", "comments"]
    assert [tuple(r) for r in copy.select("SELECT name FROM authors WHERE id = ?", [2]).collect()] == [("Bob",)]
    with pytest.raises(SchemaError):  # the tables are there already
        copy.restore(str(tmp_path / "dump"))


def test_ingest(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string").write.parquet(str(tmp_path / "in"))
    db = Database(spark)
    db.create_table(Table("t", (Column_("id", INT), Column_("name", VARCHAR(5))), PK))
    stream = spark.readStream.schema("id int, name string").parquet(str(tmp_path / "in"))
    ingest(db, "t", stream, str(tmp_path / "check")).awaitTermination()
    assert rows(db, "t") == [(1, "x"), (2, "y")]
    db.batches[str(tmp_path / "again")] = 0  # this batch is in the tables already
    ingest(db, "t", stream, str(tmp_path / "again")).awaitTermination()
    assert rows(db, "t") == [(1, "x"), (2, "y")]
