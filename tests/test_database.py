import pytest

from millrace.database import Conflict, ConstraintError, Database, SqlError
from millrace.plans.sqltext import doubles, null_placement


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, str(tmp_path / "db"))


def rows(db, sql):
    return [tuple(r) for r in db.execute(sql).collect()]


def people(db, n=5):
    db.execute("CREATE TABLE users (id BIGINT, name TEXT NOT NULL, age INT DEFAULT 7, PRIMARY KEY (id))")
    if n:
        db.execute("INSERT INTO users VALUES " + ", ".join(f"({k}, 'User{k}', {20 + k})" for k in range(1, n + 1)))
    return db


def test_insert_defaults_row_id_and_star(db):
    people(db, 3)
    assert db.execute("INSERT INTO users (id, name) SELECT id + 10, name FROM users WHERE age > 21").affected == 2
    assert rows(db, "SELECT * FROM users ORDER BY id") == [(1, "User1", 21), (2, "User2", 22), (3, "User3", 23), (12, "User2", 7), (13, "User3", 7)]
    assert [int(r[0]) for r in rows(db, "SELECT row_id FROM users ORDER BY row_id")] == [1, 2, 3, 4, 5]
    with pytest.raises(SqlError):
        db.execute("INSERT INTO users (id, id) VALUES (1, 2)")


@pytest.mark.parametrize(("where", "n"), [("age > 23", 2), ("age > 100", 0), ("id = 1", 1)])
def test_update(db, where, n):
    people(db)
    assert db.execute(f"UPDATE users SET age = age * 2 + 100, name = 'x' WHERE {where}").affected == n
    assert rows(db, "SELECT count(*) FROM users WHERE age > 100 AND name = 'x'") == [(n,)]
    assert rows(db, "SELECT count(*) FROM users") == [(5,)]


@pytest.mark.parametrize(("where", "n"), [("id = 2", 1), ("age > 23", 2), ("age > 100", 0), ("NULL", 0)])
def test_delete(db, where, n):
    people(db)
    assert db.execute(f"DELETE FROM users WHERE {where}").affected == n
    assert rows(db, "SELECT count(*) FROM users") == [(5 - n,)]


def test_constraints(db):
    people(db)
    for bad in ("INSERT INTO users VALUES (1, 'again', 1)", "INSERT INTO users VALUES (9, NULL, 1)", "INSERT INTO users VALUES (NULL, 'x', 1)", "UPDATE users SET id = 1"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    db.execute("CREATE TABLE orders (id BIGINT, user_id BIGINT, amount DOUBLE, u UINT, UNIQUE (amount), FOREIGN KEY (user_id) REFERENCES users (id))")
    assert db.execute("INSERT INTO orders VALUES (1, 1, 2.5, 0), (2, NULL, NULL, 1), (3, 2, NULL, 4294967295)").affected == 3
    for bad in ("INSERT INTO orders VALUES (4, 99, 1.0, 1)", "INSERT INTO orders VALUES (4, 1, 2.5, 1)", "INSERT INTO orders VALUES (4, 1, 1.0, -1)", "DELETE FROM users WHERE id = 2"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    with pytest.raises(SqlError):
        db.execute("DROP TABLE users")
    db.execute("DROP TABLE users CASCADE")
    assert db.execute("INSERT INTO orders VALUES (5, 99, 9.0, 1)").affected == 1
    assert rows(db, "SELECT count(*) FROM orders") == [(4,)]


def test_unique_index(db):
    db.execute("CREATE TABLE items (id BIGINT, sku TEXT)")
    db.execute("INSERT INTO items VALUES (1, 'b'), (2, 'a'), (3, NULL), (4, NULL)")
    db.execute("CREATE UNIQUE INDEX IF NOT EXISTS by_sku ON items (sku DESC)")
    assert db.execute("CREATE UNIQUE INDEX IF NOT EXISTS by_sku ON items (sku)").message.endswith("exists")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO items VALUES (5, 'a')")
    db.execute("INSERT INTO items VALUES (5, 'c')")
    with pytest.raises(SqlError):
        db.execute("CREATE INDEX x ON items (id)")


def test_alter(db):
    people(db, 2)
    db.execute("ALTER TABLE users ADD COLUMN email TEXT DEFAULT 'none'")
    assert rows(db, "SELECT email FROM users WHERE id = 1") == [("none",)]
    db.execute("ALTER TABLE users ALTER COLUMN age DOUBLE")
    db.execute("ALTER TABLE users MODIFY age SET DEFAULT 1.5")
    db.execute("INSERT INTO users (id, name) VALUES (3, 'c')")
    assert rows(db, "SELECT age, email FROM users WHERE id = 3") == [(1.5, "none")]
    with pytest.raises(ConstraintError):
        db.execute("ALTER TABLE users ADD CONSTRAINT e UNIQUE (email)")
    db.execute("ALTER TABLE users DROP COLUMN email")
    assert len(rows(db, "SELECT * FROM users")[0]) == 3
    with pytest.raises(SqlError):
        db.execute("ALTER TABLE users DROP COLUMN id")
    db.execute("ALTER TABLE users ALTER name DROP NOT NULL")
    db.execute("INSERT INTO users VALUES (4, NULL, NULL)")
    with pytest.raises(ConstraintError):
        db.execute("ALTER TABLE users ALTER name SET NOT NULL")


def test_sessions(db):
    people(db)
    with db.session() as s:
        s.execute("UPDATE users SET age = 999 WHERE id = 1")
        assert [tuple(r) for r in s.execute("SELECT age FROM users WHERE id = 1").collect()] == [(999,)]
        assert rows(db, "SELECT age FROM users WHERE id = 1") == [(21,)]
        s.rollback()
    assert rows(db, "SELECT age FROM users WHERE id = 1") == [(21,)]
    a, b = db.session(), db.session()
    a.execute("UPDATE users SET age = 50 WHERE id = 1")
    b.execute("UPDATE users SET age = 60 WHERE id = 2")
    a.commit()
    assert [tuple(r) for r in b.execute("SELECT age FROM users WHERE id = 1").collect()] == [(21,)]
    with pytest.raises(Conflict):
        b.commit()
    assert rows(db, "SELECT age FROM users WHERE id IN (1, 2) ORDER BY id") == [(50,), (22,)]
    with pytest.raises(SqlError):
        a.execute("SELECT 1")


def test_batch_is_atomic(db):
    people(db, 2)
    with pytest.raises(ConstraintError):
        db.execute_batch(["INSERT INTO users VALUES (5, 'e', 1)", "INSERT INTO users VALUES (5, 'f', 1)"])
    assert rows(db, "SELECT count(*) FROM users") == [(2,)]


def test_reopen_vacuum_analyze_explain(db, spark):
    people(db)
    with db.session() as s:
        db.execute("DELETE FROM users WHERE id > 2")
        db.vacuum()
        assert s.execute("SELECT count(*) FROM users").collect()[0][0] == 5
    assert db.vacuum()["folders_removed"] >= 1
    again = Database.open_or_create(spark, str(db.store.path))
    assert rows(again, "SELECT count(*) FROM users") == [(2,)]
    stats = again.analyze()["users"]
    assert stats["rows"] == 2 and stats["columns"]["age"] == {"ndv": 2, "nulls": 0, "min": "21", "max": "22", "len": 2.0}
    assert "Filter" in again.explain("SELECT name FROM users WHERE age > 3")
    with pytest.raises(SqlError):
        again.explain("DROP TABLE users")
    with pytest.raises(SqlError):
        Database.create(spark, str(db.store.path))


def test_null_placement(db):
    people(db, 2)
    db.execute("INSERT INTO users VALUES (3, 'c', NULL)")
    assert [r[0] for r in rows(db, "SELECT id FROM users ORDER BY age")] == [1, 2, 3]
    assert [r[0] for r in rows(db, "SELECT id FROM users ORDER BY age DESC LIMIT 2")] == [3, 2]
    assert null_placement("SELECT ')ORDER BY x' FROM (SELECT a FROM t ORDER BY f(a, b) DESC, c LIMIT 3) ORDER BY d NULLS FIRST, e") == (
        "SELECT ')ORDER BY x' FROM (SELECT a FROM t ORDER BY f(a, b) DESC NULLS FIRST, c NULLS LAST LIMIT 3) ORDER BY d NULLS FIRST, e NULLS LAST"
    )


def test_standard_semantics(db):
    """Where engines go wrong: NULL counts, negated predicates, DISTINCT aggregates, expressions over aggregates."""
    db.execute("CREATE TABLE t (a INT, b INT)")
    db.execute("INSERT INTO t VALUES (1, 1), (1, NULL), (2, 3), (NULL, 4)")
    assert rows(db, "SELECT count(*), count(b), count(DISTINCT a), sum(DISTINCT a) FROM t") == [(4, 3, 2, 3)]
    assert rows(db, "SELECT b FROM t WHERE b NOT BETWEEN 1 AND 3 AND b NOT IN (9) AND b IS NOT NULL") == [(4,)]
    assert rows(db, "SELECT a, sum(b) + count(*) AS x FROM t GROUP BY a HAVING count(*) > 1 ORDER BY x") == [(1, 3)]
    assert rows(db, "SELECT 1 + 1") == [(2,)]
    assert rows(db, "SELECT x.a FROM t x JOIN t y ON x.a = y.a AND x.b = 3") == [(2,)]
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        db.execute("SELECT a FROM t garbage after it")


def test_vacuum_leaves_open_transactions_alone(db, spark):
    people(db)
    other = Database.open(spark, db.store.path)
    with other.session() as s:
        s.execute("INSERT INTO users VALUES (50, 'late', 1)")
        db.execute("CREATE TABLE more (k INT)")
        db.vacuum()
        assert len(s.execute("SELECT * FROM users").collect()) == 6
        s.commit()
    db.vacuum()
    assert rows(db, "SELECT count(*) FROM users") == [(6,)]


def test_keys_hold_between_sessions(db):
    people(db)
    db.execute("CREATE TABLE orders (id BIGINT, user_id BIGINT, FOREIGN KEY (user_id) REFERENCES users (id))")
    with db.session() as child, db.session() as parent:
        child.execute("INSERT INTO orders VALUES (1, 5)")
        parent.execute("DELETE FROM users WHERE id = 5")
        parent.commit()
        with pytest.raises(Conflict):
            child.commit()
    assert rows(db, "SELECT count(*) FROM orders") == [(0,)]


def test_names_in_any_case_and_doubles(db):
    people(db)
    assert rows(db, "SELECT sum(id), abs(id - 9) FROM USERS GROUP BY abs(id - 9) HAVING SUM(age) > 24") == [(5.0, 4.0)]
    assert [type(x) for x in rows(db, "SELECT sum(id) OVER (ORDER BY id), ceil(id + 0.5), floor(1.5), round(id) FROM Users LIMIT 1")[0]] == [float] * 4
    assert db.execute("UPDATE Users SET age = 1 WHERE id = 1").affected == 1
    assert doubles("SELECT a.sum, sum(x) FILTER (WHERE y) FROM t -- sum(") == "SELECT a.sum, CAST(sum(x) FILTER (WHERE y) AS DOUBLE) FROM t -- sum("
    assert db.analyze(max_rows=2)["users"]["sampled"] <= 5
