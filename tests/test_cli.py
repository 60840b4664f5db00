"""The commands over a stored database."""

from tallyrock.__main__ import main
from tallyrock.tables import INT, VARCHAR, Column_, Database, Table, Unique


def test_commands(spark, tmp_path, capsys):
    root = str(tmp_path / "db")
    db = Database(spark)
    db.create_table(Table("users", (Column_("id", INT), Column_("name", VARCHAR(20))), (Unique(("id",), primary=True),)))
    db.insert("users", [(1, "o'brien"), (2, None)])
    db.dump(root)
    run = lambda *args: (main(list(args), spark), capsys.readouterr().out)[1]
    assert "o'brien" in run("query", root, "SELECT * FROM users")
    assert run("query", root, "SELECT id, name FROM users WHERE name = ?", "--param", "o'brien", "--format", "json") == '{"id":1,"name":"o\'brien"}\n'
    assert run("query", root, "SELECT id, name FROM users ORDER BY id", "--format", "csv").splitlines() == ["id,name", "1,o'brien", "2,"]
    assert "RECORD 0" in run("query", root, "SELECT * FROM users", "--format", "vertical")
    assert "PRIMARY KEY" in run("tables", root)
    assert "Scan parquet" in run("explain", root, "SELECT * FROM users")
    run("export", root, "users", str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())[0].startswith('INSERT INTO "users"')
    run("dump", root, str(tmp_path / "dump"))
    assert run("restore", str(tmp_path / "copy"), str(tmp_path / "dump")) == "2 rows\n"
    assert "o'brien" in run("query", str(tmp_path / "copy"), "SELECT * FROM users")
