from veriscope.operators.relationships import comparable_columns, declared_and_checked, relationships, stem


def found(spark, tables, **options):
    rows = relationships(spark, tables, **options).collect()
    return {
        (f"{r.source_table}.{r.source_column}", f"{r.target_table}.{r.target_column}"): (r.relationship_type, r["values"], r.missing, r.contained)
        for r in rows
    }


def test_names_and_values_over_all_tables(spark):
    tables = {
        "customers": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "_id long, c_name string"),
        "orders": spark.createDataFrame(
            [(10, 1, 7, "a"), (11, 1, 8, None), (12, 2, 9, "x" * 100)], "o_key long, customer_id int, agent_id long, o_name string"),
        "names": spark.createDataFrame([("a",), ("b",), ("x" * 100,)], "n_name string"),
        "lines": spark.createDataFrame([(10, 1.0), (10, 2.0), (99, 1.0), (None, 1.0)], "l_key long, l_price double"),
    }
    got = found(spark, tables)
    # an integer column of another width meets a long one; the name rule points to the key of the table
    assert got["orders.customer_id", "customers._id"] == ("inferred", 2, 0, True)
    # a table that is not there is still a relationship by name
    assert got["orders.agent_id", "agents._id"] == ("inferred", None, None, False)
    # equal stems speak for a relationship, also if values are missing
    assert got["lines.l_key", "orders.o_key"] == ("inferred", 2, 1, False)
    # a text longer than the limit is compared as a whole
    assert got["orders.o_name", "names.n_name"] == ("inferred", 2, 0, True)
    # values alone: every customer number lies in no other key but ... prices are numbers, never integers
    assert ("lines.l_price", "customers._id") not in got
    # l_key holds 10 twice, so it is no key and nothing points to it
    assert not any(target == "lines.l_key" for _, target in got)


def test_containment_without_a_name(spark):
    tables = {
        "a": spark.createDataFrame([(i,) for i in range(20)], "alpha long"),
        "b": spark.createDataFrame([(3,), (3,), (5,), (None,)], "beta int"),
        "c": spark.createDataFrame([(3,), (77,)], "gamma long"),
    }
    got = found(spark, tables)
    assert got == {("b.beta", "a.alpha"): ("contained", 2, 0, True)}
    assert found(spark, tables, least=3) == {}


def test_many_columns_need_more_than_one_word(spark):
    wide = spark.range(5).selectExpr(*[f"id + {i} AS col{i:03d}" for i in range(130)])
    tables = {"wide": wide, "last": spark.createDataFrame([(133,), (130,)], "number long")}
    got = found(spark, tables)
    want = {f"wide.col{i:03d}" for i in range(130) if i <= 130 and i + 4 >= 133}
    assert {t for s, t in got if s == "last.number"} == want == {"wide.col129"}


def test_empty_and_odd_tables(spark):
    assert relationships(spark, {}).count() == 0
    tables = {
        "e": spark.createDataFrame([], "e_key long, x array<int>"),
        "f": spark.createDataFrame([(1, [1]), (None, None)], "f_key long, m array<int>"),
        "g": spark.createDataFrame([(None,)], "g_key long"),
    }
    assert [c.column for c in comparable_columns(tables)] == ["e_key", "f_key", "g_key"]
    got = found(spark, tables)
    # a column without values lies in no key, but its name still points to one
    assert got["e.e_key", "f.f_key"] == ("inferred", 0, 0, False) and got["g.g_key", "f.f_key"] == ("inferred", 0, 0, False)
    assert ("f.f_key", "e.e_key") not in got


def test_hot_value_and_odd_names(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 1L, id) AS `s key.1`")
    got = found(spark, {"many": rows, "all": spark.range(3000).withColumnRenamed("id", "t_number")})
    assert got["many.s key.1", "all.t_number"][0] == "contained"


def test_stem():
    assert [stem(x) for x in ("o_custkey", "doc_id", "ps_partkey", "x", "_id", "a_")] == ["custkey", "doc_id", "partkey", "x", "id", "a_"]


def test_declared_keys_are_checked(spark):
    tables = {"p": spark.createDataFrame([(1, "a"), (2, "b")], "p_id long, p_name string"), "c": spark.createDataFrame([(1, 5), (2, 1), (9, None)], "c_parent int, c_x int")}
    names = ("c", "c_parent", "p", "p_id"), ("c", "c_x", "p", "p_id"), ("c", "c_x", "p", "p_name"), ("c", "gone", "p", "p_id")
    rows = [("s", t, c, "s", u, k, f"fk{i}") for i, (t, c, u, k) in enumerate(names)]
    shape = "source_schema string, source_table string, source_column string, target_schema string, target_table string, target_column string, constraint_name string"
    got = declared_and_checked(spark, tables, spark.createDataFrame(rows, shape)).collect()
    assert [(r.constraint_name, r["values"], r.missing, r.contained) for r in sorted(got, key=lambda r: r.constraint_name)] == [
        ("fk0", 3, 1, False), ("fk1", 2, 1, False), ("fk2", None, None, False), ("fk3", None, None, False)]
    assert declared_and_checked(spark, {}, spark.createDataFrame(rows, shape)).count() == 4
