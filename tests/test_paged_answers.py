import json

from grantweave.sources import paged


def save(path, resource, entries, size):
    pages = paged.page_count(len(entries), size) or 1
    for n in range(1, pages + 1):
        folder = path / f"resource={resource}" / f"page={n}"
        folder.mkdir(parents=True)
        answer = {"pagination": {"pageSize": str(size), "totalAvailable": str(len(entries))}}
        if entries:
            answer["users"] = {"user": entries[(n - 1) * size : n * size]}
        (folder / "part-0.txt").write_text(json.dumps(answer))


def users(n, prefix):
    return [{"id": f"{prefix}{i}", "name": f"name {i}", "gone": "yes" if i % 3 == 0 else None} for i in range(n)]


FIELDS = "id string, name string, gone string"


def test_pages_and_pushed_conditions(spark, tmp_path):
    sizes = {"a": 25, "b": 10, "c": 0, "d": 1}
    for r, n in sizes.items():
        save(tmp_path, r, users(n, r), 10)
    every = [(r, e["id"]) for r, n in sizes.items() for e in users(n, r)]
    for parallel in (1, 3, 50):  # more resources than slots, and fewer
        df = paged.answers(spark, str(tmp_path), "users.user", FIELDS, parallel)
        assert sorted((r.resource, r.id) for r in df.collect()) == sorted(every)
        assert df.rdd.getNumPartitions() <= parallel
    some = df.where("resource IN ('a', 'd') AND gone IS NULL AND name != 'name 4'")
    assert sorted(r.id for r in some.collect()) == sorted(e["id"] for r in "ad" for e in users(sizes[r], r) if not e["gone"] and e["name"] != "name 4")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and ") Filter" not in plan


def test_what_the_reader_cannot_check_stays_with_spark(spark, tmp_path):
    save(tmp_path, "a", users(25, "a"), 10)
    df = paged.answers(spark, str(tmp_path), "users.user", FIELDS)
    assert df.where("length(name) = 6 AND page > 1").count() == 0
    assert df.where("length(name) = 7 AND page > 1").count() == 15


def test_only_wanted_resources_are_asked_for(spark, tmp_path):
    save(tmp_path, "a", users(5, "a"), 10)
    (tmp_path / "resource=broken" / "page=1").mkdir(parents=True)
    (tmp_path / "resource=broken" / "page=1" / "part-0.txt").write_text("not json")
    assert paged.answers(spark, str(tmp_path), "users.user", FIELDS).where("resource = 'a'").count() == 5


def test_entries_that_moved_between_pages(spark):
    rows = spark.createDataFrame([("a", 1, "x", "old"), ("a", 2, "x", "new"), ("b", 1, "x", "other")], "resource string, page int, id string, name string")
    assert {(r.resource, r.name) for r in paged.latest(rows).collect()} == {("a", "new"), ("b", "other")}
