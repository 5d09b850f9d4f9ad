import pytest

from lustra.operators import duplicate_key, remove_duplicates


@pytest.fixture
def people(make):
    return make(
        "pos int, user_id int, name string, city string",
        (1, 10, "Ann", None),
        (2, 11, " Ann ", None),
        (3, 12, "Bob", "X"),
        (4, 13, "Ann", None),
        (5, 14, "Eve", "X"),
    )


def test_first_last_and_none(people, values):
    def kept(keep):
        return [r[0] for r in values(remove_duplicates(people, keep=keep, order_by="pos"), "pos")]

    assert kept("first") == [1, 3, 5]
    assert kept("last") == [3, 4, 5]
    assert kept(False) == [3, 5]


def test_text_is_trimmed_and_stays_trimmed(people, values):
    last = remove_duplicates(people.filter("pos < 3"), keep="last", order_by="pos")
    assert values(last) == [(2, 11, "Ann", None)]


def test_text_leftovers_use_the_ranked_form(people, values):
    first = remove_duplicates(people, subset=["city"], order_by=["pos"])
    assert values(first) == [(1, 10, "Ann", None), (3, 12, "Bob", "X")]
    last = remove_duplicates(people, subset=["city"], keep="last", order_by=["pos", "user_id"])
    assert [r[0] for r in values(last)] == [4, 5]


def test_key_rules(people, make):
    assert duplicate_key(people) == ["pos", "name", "city"]
    assert duplicate_key(people, order_by=["pos"]) == ["name", "city"]
    assert duplicate_key(people, subset=[]) == people.columns
    ids_only = make("id int, user_id int", (1, 1))
    assert duplicate_key(ids_only) == ["id", "user_id"]


def test_whole_row_key_needs_no_order(make, values):
    df = make("a int, b string", (1, "x"), (1, "x "), (2, None), (2, None))
    assert values(remove_duplicates(df, subset=[])) == [(1, "x"), (2, None)]


def test_order_is_required_where_it_matters(people):
    with pytest.raises(ValueError, match="order_by"):
        remove_duplicates(people, subset=["name"])
    with pytest.raises(ValueError, match="exists"), pytest.warns(UserWarning):
        remove_duplicates(people, subset=["nope"], order_by="pos")
    with pytest.raises(ValueError, match="keep"):
        remove_duplicates(people, keep="any", order_by="pos")


def test_map_columns_never_take_part(spark):
    df = spark.sql("select 1 as pos, 'x' as a, map('k', 1) as m union all select 2, 'x', map('k', 2)")
    assert duplicate_key(df, order_by=["pos"]) == ["a"]
    assert remove_duplicates(df, order_by="pos").select("pos").collect()[0][0] == 1


def test_idempotent_and_independent_of_partitions(spark, values):
    df = spark.range(1000).selectExpr(
        "id as pos", "id % 7 as k", "cast(id % 3 as string) as t", "id as order_id"
    )
    once = remove_duplicates(df, order_by="pos")
    assert once.count() == 21
    assert values(remove_duplicates(once, order_by="pos")) == values(once)
    assert values(remove_duplicates(df.repartition(13), order_by="pos")) == values(once)


def test_one_key_with_a_third_of_the_rows(spark, values):
    df = spark.range(3000).selectExpr("id as pos", "case when id % 3 = 0 then -1 else id end as k")
    assert remove_duplicates(df, order_by="pos").count() == 2001
    none = remove_duplicates(df, keep=False, order_by="pos")
    assert none.count() == 2000 and none.filter("k = -1").count() == 0


@pytest.mark.parametrize("extra", ["int", "string"])
def test_rows_without_order_value_come_first_in_both_forms(make, values, extra):
    df = make(
        f"pos int, k string, v int, t {extra}",
        *[
            (pos, k, v, v if extra == "int" else str(v))
            for pos, k, v in [(None, "a", 1), (2, "a", 2), (3, "b", 3), (4, "b", None), (None, "c", 5)]
        ],
    )

    def kept(keep):
        return values(remove_duplicates(df, ["k"], keep, "pos").select("k", "pos", "v"))

    assert kept("first") == [("a", None, 1), ("b", 3, 3), ("c", None, 5)]
    assert kept("last") == [("a", 2, 2), ("b", 4, None), ("c", None, 5)]
