"""The engine end to end on small extracts with one case of each kind, and operators beside it."""

import pytest
from pyspark.sql import functions as F

from tributary.config import Config
from tributary.operators import decisions, duplicates, escalations, mapping, merge, sink, store
from tributary.plans import pipeline
from tributary.sources import target
from tributary.sources.delimited import records

HR = (
    ["EmpCode", "Employee Name", "DOB", "Gender", "Dept", "Designation", "Title", "DOJ", "Status", "Location", "GrossCTC", "EmpType", "Cost Center"],
    [
        ["APX-1", "ANN LEE", "21/03/1988", "F", "Sales", "Plant Lead", "Lead", "15-Jun-2014", "Active", "Pune", "980000", "Permanent", "X"],
        ["APX-2", "Dr. Bo Kim", "05/06/1991", "M", "Sales", "Clerk", "Clerk", "2015-01-02", "Absconding", "Delhi", "500000", "Contract", "X"],
        ["APX-3", "Cy Roy", "1990-01-05", "M", "IT", "Clerk", "Clerk", "2016-01-02", "Active", "Goa", "700000", "Intern", "X"],
    ],
)
PAY = (
    ["employee_no", "ctc", "email_official", "office", "mobile", "first_name", "last_name"],
    [
        ["1", "920000", "ann.lee@corp.in", "Pune Plant", "98765 43210", "", ""],
        ["2", "500000", "bo@gmail.com", "Mumbai", "98765 43211", "", ""],
        ["3", "700000", "", "", "98765 43212", "", ""],
        ["3B", "", "c.roy@corp.in", "Goa", "98765 43212", "C", "Roy"],
    ],
)


@pytest.fixture(scope="module")
def result(spark):
    return pipeline.run([("hr.csv", records(spark, *HR)), ("pay.csv", records(spark, *PAY))], at=-1000)


def test_mappings(result):
    got = {r["header"]: (r["target"], r["status"]) for r in result.mappings.collect()}
    assert got["EmpCode"] == ("employeeNumber", "auto") and got["Employee Name"] == ("fullName", "auto")
    assert got["Designation"] == ("designation", "auto") and got["Title"] == ("designation", "escalated")
    assert got["Cost Center"][1] == "ignored" and got["EmpType"] == ("employmentType", "auto")
    claims = result.mappings.filter("status = 'auto' and target <> 'fullName'").groupBy("file_name", "target").count()
    assert claims.filter("count > 1").isEmpty()


def test_records(result):
    rows = {r["employee_number"]: r for r in result.records.collect()}
    assert set(rows) == {"1", "2", "3", "3B"}
    one = rows["1"]
    assert one["cells"]["ctcAnnual"]["value"] == "980000" and one["cells"]["ctcAnnual"]["conflicts"] == ["920000"]
    assert one["cells"]["workLocation"]["value"] == "Pune Plant" and one["cells"]["currency"]["value"] == "INR"
    assert set(one["flags"]) == {"ctcAnnual:conflict"}
    assert set(rows["2"]["flags"]) == {"dateOfBirth:ambiguous_date", "status:unknown_enum", "email:personal_email", "workLocation:conflict"}
    assert [x["row"] for x in one["cells"]["employeeNumber"]["lineage"]] == [2, 2]
    assert sum(len(r["row_ids"]) for r in rows.values()) == 7


def test_escalations_and_decisions(spark, result):
    kinds = sorted(r["kind"] for r in result.escalations.collect())
    assert kinds == ["conflict_cross_file"] * 2 + ["duplicate_fuzzy", "mapping_competing", "validation_failed", "value_ambiguous_date", "value_unknown_enum"]
    assert result.status == "awaiting_human"
    choices = result.escalations.select("escalation_id", F.lit(None).cast("string").alias("choice"), F.lit(False).alias("reject"), F.col("confidence").cast("long").alias("at"))
    after = result.decided(choices)
    assert after.status == "ready_to_push"
    rows = {r["employee_number"]: r for r in after.records.collect()}
    assert rows["3B"]["excluded"] and rows["3"]["cells"]["email"]["value"] == "c.roy@corp.in" and len(rows["3"]["row_ids"]) == 3
    assert rows["2"]["cells"]["status"]["value"] == "terminated" and rows["2"]["cells"]["dateOfBirth"]["value"] == "1991-06-05"
    assert {r["title"] for r in after.rules.collect()} >= {"Strip employee prefix", "Merge people who share a phone"}
    no = result.escalations.filter("kind = 'value_unknown_enum'").select("escalation_id", F.lit("x").alias("choice"), F.lit(True).alias("reject"), F.lit(1).cast("long").alias("at"))
    refused = result.decided(no)
    assert refused.records.filter("excluded").count() == 1 and refused.escalations.filter("status = 'open'").count() == 6


def fold(spark, first, second, target):
    config = Config()
    a = merge.Source(records(spark, ["id", "v"], [["1", first]]), 0, "a", (("id", "employeeNumber"), ("v", target)))
    b = merge.Source(records(spark, ["id", "v"], [["1", second]]), 1, "b", (("id", "employeeNumber"), ("v", target)))
    r = merge.merge_sources([a, b], config).first()
    return r["cells"][target]["value"], sorted(r["flags"])


@pytest.mark.parametrize(
    "target, first, second, value, flags",
    [
        ("dateOfBirth", "1990-01-02", "05/06/1991", "1990-01-02", ["dateOfBirth:ambiguous_date", "dateOfBirth:conflict"]),
        ("dateOfBirth", "05/06/1991", "1990-01-02", "1990-01-02", ["dateOfBirth:ambiguous_date"]),
        ("status", "active", "inactive", "inactive", []),
        ("employmentType", "Permanent", "Contract", "full_time", ["employmentType:conflict"]),
        ("ctcAnnual", "abc", "5", "abc", ["ctcAnnual:conflict", "ctcAnnual:invalid"]),
        ("department", "", "Sales", "Sales", []),
    ],
)
def test_fold(spark, target, first, second, value, flags):
    assert fold(spark, first, second, target) == (value, flags)


def test_keys(spark):
    s = merge.Source(records(spark, ["id", "mail"], [["", "A@x.in"], ["", "a@X.in"], ["7", "a@x.in"], ["", ""], ["", ""]]), 0, "f", (("id", "employeeNumber"), ("mail", "email")))
    got = sorted((r["key"], len(r["row_ids"])) for r in merge.merge_sources([s]).collect())
    assert got == [("email:a@x.in", 2), ("emp:7", 1), ("row:0:3", 1), ("row:0:4", 1)]


def test_fuzzy_pairs(spark):
    rows = [(1, "a", "Farhan", "Qureshi", "9", "", "1"), (2, "b", "F", "Qureshi", "9", "", "2"), (3, "c", "Priya", "Mehta", "8", "d", "3"), (4, "d", "Priya", "Mehta", "7", "d", "3"), (5, "e", "Priya", "Mehta", "6", "d", "4")]
    df = spark.createDataFrame(rows, "ord int, id string, first string, last string, phone string, dob string, number string")
    assert sorted((r["keep_id"], r["drop_id"]) for r in duplicates.fuzzy_pairs(df).collect()) == [("a", "b"), ("c", "e"), ("d", "e")]


def test_competition_and_updates(spark):
    schema = "file_ord int, file_name string, col_ord int, header string, target string, confidence double, margin double, status string, reason string, candidates array<struct<field:string,score:double>>"
    m = spark.createDataFrame([(0, "f", 0, "a", "email", 0.9, 0.3, "auto", "match", []), (0, "f", 1, "b", "email", 0.85, 0.3, "auto", "match", []), (0, "f", 2, "c", "email", 0.5, 0.3, "escalated", "weak", [])], schema)
    got = [(r["status"], r["target"]) for r in mapping.compete(m).orderBy("col_ord").collect()]
    assert got == [("auto", "email"), ("escalated", "email"), ("ignored", None)]
    up = spark.createDataFrame([(0, 2, "phone", 0.9), (0, 1, "nonsense", 0.99)], "file_ord int, col_ord int, target string, confidence double")
    got = [(r["status"], r["target"]) for r in mapping.apply_updates(m, up).orderBy("col_ord").collect()]
    assert got == [("auto", "email"), ("auto", "email"), ("auto", "phone")]


def test_push_and_rollback(spark):
    r = spark.createDataFrame([("r1", "18", None, False, "x"), ("r2", "18", None, False, "x"), ("r3", "5", None, False, "x"), ("r4", "6", None, False, ""), ("r5", "7", None, True, "x"), ("r6", "9", None, False, "x")], "record_id string, employee_number string, push_status string, excluded boolean, f string")
    target = spark.createDataFrame([("5",)], "employee_number string")
    none = spark.createDataFrame([], "record_id string, employee_number string, status int")
    calls = sink.push(r, ["f"], target, none)
    assert {x["record_id"]: x["status"] for x in calls.collect()} == {"r1": 503, "r2": 201, "r3": 409, "r4": 422, "r5": 409, "r6": 201}
    after = sink.after_push(r, calls)
    again = sink.push(sink.pending(after, True).filter("record_id = 'r1'"), ["f"], target, calls.select("record_id", "employee_number", "status"))
    assert again.first()["status"] == 201 and again.first()["attempt"] == 2
    gone, left, undone = sink.rollback(after, target.unionByName(spark.createDataFrame([("18",), ("9",)], "employee_number string")))
    assert {(x["status"], x["method"]) for x in gone.collect()} == {(204, "DELETE")} and gone.count() == 2 and left.isEmpty() and undone.filter("push_status = 'rolled_back'").count() == 2


def _open(spark, rows):
    """Escalations (id, record, field, command type, drop id) whose one option is that command."""
    command = "named_struct('type', t, 'record_id', r, 'mapping_id', cast(null as string), 'field', f, 'value', 'v', 'keep_id', k, 'drop_id', d)"
    df = spark.createDataFrame(rows, "escalation_id string, r string, f string, t string, k string, d string")
    return df.selectExpr("escalation_id", "r as record_id", "f as field", "'x' as kind", "'open' as status", f"array(named_struct('id', 'o', 'label', 'o', 'apply', {command})) as options")


def test_decisions_are_folded_in_order(spark):
    rows = [
        ("e1", "a", "f", "set_field", None, None), ("e2", "a", "f", "accept_value", None, None), ("e3", "a", "g", "set_field", None, None),
        ("e4", "b", "employeeNumber", "merge_records", "c", "b"), ("e5", "b", "f", "set_field", None, None),
        ("e6", "c", "f", "set_field", None, None), ("e7", "c", "g", "set_field", None, None), ("e8", "d", None, "merge_records", "d", "c"),
        ("e9", None, None, "set_field", None, None),
    ]
    esc = _open(spark, rows)
    say = lambda *x: spark.createDataFrame([(e, "o", no, at) for e, no, at in x], "escalation_id string, choice string, reject boolean, at long")
    status = lambda d: {r["escalation_id"]: r["status"] for r in decisions.close(esc, decisions.resolve(esc, d)).collect()}
    counted = lambda d: sorted(r["escalation_id"] for r in decisions.resolve(esc, d).collect())
    first = say(("e2", False, 2), ("e1", False, 1), ("e1", False, 9), ("e9", False, 3))
    assert counted(first) == ["e1", "e9"] and status(first)["e2"] == "resolved" and status(first)["e3"] == "open"
    assert status(say(("e4", False, 1)))["e5"] == "resolved"  # the one that goes is the escalation's own record
    no = say(("e1", True, 1), ("e3", False, 2))
    assert counted(no) == ["e1", "e3"] and status(no)["e2"] == "resolved"  # out since the rejection, closed by what follows
    assert status(say(("e1", True, 1)))["e2"] == "open"
    away = say(("e8", False, 1), ("e6", False, 2), ("e7", False, 3))
    assert counted(away) == ["e6", "e8"]  # c went into d, so the first decision on c closes the rest
    assert counted(say(("e6", False, 1), ("e7", False, 2), ("e8", False, 3))) == ["e6", "e7", "e8"]


def test_job_life(spark, result, tmp_path):
    from tributary.plans.job import Job

    job = Job.of("job_000042", result, "Harbour Ltd", "Staff move", 3)
    where = target.Target(spark, f"file://{tmp_path}/target")
    n_run = job.events.count()
    assert {r["step"] for r in job.events.collect()} == set(pipeline.STEPS) and job.audit.filter("actor = 'agent' and action = 'map.auto'").count() == job.counts()["auto"]
    with pytest.raises(ValueError):
        job.push(1)
    choices = result.escalations.select("escalation_id", F.when(F.col("field") == "email", "clear").alias("choice"), F.lit(False).alias("reject"), F.col("confidence").cast("long").alias("at"))
    job = job.decided(choices)
    assert job.status == "ready_to_push" and job.audit.count() >= 4 and job.events.count() == n_run + result.escalations.count()
    pushed = job.push(5, to=where)
    job.push(5, to=where)  # lost on the way and run again: the same attempt
    assert where.attempts("batch_000042") == [1] and where.read(pushed.target.schema).count() == pushed.target.count()
    assert pushed.status == "partial_failure" and pushed.counts()["pushed"] + pushed.counts()["failed"] == 3
    log = {r["employee_number"]: r for r in pushed.log.collect()}
    assert all((r["status"] == 201) == r["ok"] == (r["error"] is None) for r in log.values()) and all(r["status"] in (201, 422) for r in log.values())
    assert pushed.target.count() == pushed.counts()["pushed"] and {r["batch_id"] for r in pushed.target.collect()} <= {"batch_000042"}
    assert pushed.audit.filter("actor = 'target'").count() == 3
    saved = pushed.save(f"file://{tmp_path}")
    assert saved.turn == 1
    with pytest.raises(store.Stale):
        pushed.save(f"file://{tmp_path}")  # a second writer that went on from the same state
    assert [tuple(r) for r in Job.recent(spark, f"file://{tmp_path}").collect()] == [("job_000042", "Harbour Ltd", "partial_failure", 3)]
    loaded = Job.load(spark, f"file://{tmp_path}", "job_000042")
    assert (loaded.client, loaded.engagement, loaded.pushes, loaded.turn) == ("Harbour Ltd", "Staff move", 1, 1)
    again = loaded.push(6, retry_failed=True, to=where)
    assert where.attempts("batch_000042") == [1, 2]
    assert again.log.count() == 3 + pushed.counts()["failed"] and again.log.agg(F.max("attempt")).first()[0] == 2
    back = again.rollback(7, to=where)
    assert where.read(pushed.target.schema).isEmpty()
    assert back.status == "rolled_back" and back.target.isEmpty() and back.counts()["pushed"] == 0
    assert back.audit.filter("action = 'batch.rollback'").count() == 1 and back.recent_events(1).first()["step"] == "rollback"
    assert Job.load(spark, f"file://{tmp_path}", "nothing") is None


def test_a_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    sources = lambda: [("hr.csv", records(spark, *HR)), ("empty.csv", records(spark, ["a"], [])), ("pay.csv", records(spark, *PAY))]
    folder = f"file://{tmp_path}"
    with monkeypatch.context() as m:
        m.setattr(duplicates, "record_pairs", lambda r: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            pipeline.run(sources(), folder=folder)
    written = (tmp_path / "records" / "_SUCCESS").stat().st_mtime_ns
    done = pipeline.run(sources(), folder=folder, helper=lambda c, p: 1 / 0)
    assert (tmp_path / "records" / "_SUCCESS").stat().st_mtime_ns == written and done.escalations.count() == 7


def test_a_failing_helper_changes_nothing(spark, result):
    with pytest.warns(UserWarning):
        assert mapping.assist(result.mappings, result.profiles, lambda c, p: 1 / 0) is result.mappings


def test_store(spark, tmp_path):
    jobs = store.JobStore(spark, f"file://{tmp_path}")
    assert jobs.get("a") is None
    make = lambda i, at, data: spark.createDataFrame([(i, "c", "running", at, at, data)], store.JOBS)
    for i in range(5):
        some = make(f"j{i}", i, '{"x": [1]}')
        for j in (i + 5, i + 10):
            some = some.unionByName(make(f"j{j}", j, '{"x": [1]}'))
        jobs.save(some)
    jobs.save(make("j3", 99, '{"x": {"y": 2}}'))
    assert jobs.get("j3") == {"x": {"y": 2}} and jobs.all().count() == 15
    assert [r["id"] for r in jobs.recent().collect()] == [f"j{i}" for i in range(14, 2, -1)]
    assert jobs.compact() and jobs.all().count() == 15 and len(jobs._commits()) == 1
    # two writers that read the same version: the second is refused, and nothing of it counts
    one, two = (jobs.all().filter("id = 'j5'").withColumn("data", F.lit(d)) for d in ('{"by": 1}', '{"by": 2}'))
    one, two = (spark.createDataFrame(x.collect(), x.schema) for x in (one, two))
    jobs.save(one)
    with pytest.raises(store.Stale):
        jobs.save(two)
    assert jobs.get("j5") == {"by": 1}
    # two writers of different jobs that claim one number: the second goes behind the first
    real, once = jobs._commit, []

    def late(folder, base, number):
        if not once:
            once.append(store.JobStore(spark, jobs.path).save(make("other", 1, "{}")))
        return real(folder, base, number)

    jobs._commit = late
    assert jobs.save(make("mine", 1, "{}")) == once[0] + 1 and {"mine", "other"} <= {r["id"] for r in jobs.all().collect()}


def test_ready_state():
    assert decisions.ready_state("awaiting_human", 0) == "ready_to_push" and decisions.ready_state("complete", 0) == "complete"


def test_validation_skips(spark):
    r = spark.createDataFrame([("a", "1", {"value": "1"})], "record_id string, employee_number string, e struct<value:string>")
    cells = F.struct(*[(F.col("e") if f.key == "employeeNumber" else F.struct(F.lit("2019-01-01" if f.key == "dateOfBirth" else "2014-06-15" if f.key == "dateOfJoining" else None).cast("string").alias("value"))).alias(f.key) for f in Config().fields])
    r = r.select("record_id", "employee_number", cells.alias("cells"))
    titles = sorted(x["title"] for x in escalations.validate(r).collect())
    assert titles == ["DOB after joining · 1", "Missing required · 1"]
    assert escalations.validate(r, r.select("record_id")).isEmpty()


def test_mappings_do_not_reach_into_cells(spark, tmp_path):
    from tributary.operators import profile

    spark.range(20).selectExpr("id as row_idx", "concat('APX-', id) as empcode").write.parquet(f"{tmp_path}/cells")
    profiles = profile.profile_columns(profile.long_cells(spark.read.parquet(f"{tmp_path}/cells"), 0, "a.csv"))
    found = mapping.propose(profiles)
    assert [r["target"] for r in found.collect()] == ["employeeNumber"]
    assert found.inputFiles() and not any(f"{tmp_path}/cells" in f for f in found.inputFiles())  # headers are tested a column, not a cell


def test_rows_of_one_scan_task_are_cleaned_in_all(spark):
    df = spark.range(1000).selectExpr("id as row_idx", "cast(id as string) as no").coalesce(1)
    rows = merge.fold_rows(merge.Source(df, 0, "a", (("no", "employeeNumber"),)))
    shares = [n for n in rows.rdd.glom().map(len).collect() if n]
    assert len(shares) >= 4 and sum(shares) == 1000 and max(shares) < 500
