"""Decisions against a plain sequential fold, in one call and in several."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_catalogue import plain
from tributary.config import Config, Field
from tributary.operators import decisions, merge
from tributary.plans import catalogue

CONFIG = Config(fields=(Field("f", "F"), Field("g", "G")))


def sequential(escalations, choices, excluded):
    """escalations: id to (record, field, options as commands, status); excluded: record to bool. Both change in place;
    returns the ids that counted."""
    counted = []
    for e, choice, reject, _ in sorted(choices, key=lambda c: (c[3], c[0])):
        record, field, options, status = escalations[e]
        if status != "open":
            continue
        counted.append(e)
        if reject:
            escalations[e] = (record, field, options, "rejected")
            if record in excluded:
                excluded[record] = True
            continue
        command = options.get(choice, next(iter(options.values()), None))
        if command and command[0] == "exclude_record" and command[1] in excluded:
            excluded[command[1]] = True
        if command and command[0] == "merge_records" and {command[1], command[2]} <= set(excluded):
            excluded[command[2]] = True
        escalations[e] = (record, field, options, "resolved")
        if record is not None:
            for other, (r, f, o, s) in escalations.items():
                if s == "open" and r == record and (f == field or excluded.get(record)):
                    escalations[other] = (r, f, o, "resolved")
    return counted


def given(seed):
    rng = random.Random(seed)
    ids = [f"r{i}" for i in range(7)]
    excluded = {i: rng.random() < 0.15 for i in ids[:6]}  # the last is in no table
    escalations = {}
    for k in range(60):
        own = rng.choice([*ids, None])
        made = {}
        for o in "ab"[: rng.choice([0, 1, 2, 2])]:
            kind = rng.choice(["set_field", "accept_value", "exclude_record", "merge_records", "merge_records"])
            made[o] = (kind, rng.choice(ids), rng.choice(ids)) if kind == "merge_records" else (kind, rng.choice([own or "r0", rng.choice(ids)]), None)
        escalations[f"e{k:02}"] = (own, rng.choice(["f", "g", None]), made, "open")
    choices = [(e, rng.choice(["a", "b", "?", None]), rng.random() < 0.25, rng.randint(0, 20)) for e in rng.sample(sorted(escalations), 45)]
    return escalations, choices, excluded


def frames(spark, escalations, excluded):
    command = lambda c: (c[0], None if c[0] == "merge_records" else c[1], None, "f", "v", c[1] if c[0] == "merge_records" else None, c[2])
    schema = "escalation_id string, record_id string, field string, kind string, status string, options array<struct<id:string,label:string,apply:struct<type:string,record_id:string,mapping_id:string,field:string,value:string,keep_id:string,drop_id:string>>>"
    e = spark.createDataFrame([(k, r, f, "x", s, [(o, o, command(c)) for o, c in opts.items()]) for k, (r, f, opts, s) in escalations.items()], schema)
    empty = F.lit(None).cast(merge.CELL)
    r = spark.createDataFrame(list(excluded.items()), "record_id string, excluded boolean")
    return e, r.select("record_id", F.struct(empty.alias("f"), empty.alias("g")).alias("cells"), F.expr("array('f:conflict')").alias("flags"), F.array("record_id").alias("row_ids"), "excluded")


@pytest.mark.parametrize("seed, calls", [(1, 1), (2, 1), (3, 2), (4, 3)])
def test_equal_to_a_sequential_fold(spark, seed, calls):
    escalations, choices, excluded = given(seed)
    e, r = frames(spark, escalations, excluded)
    choices = sorted(choices, key=lambda c: (c[3], c[0]))
    step = -(-len(choices) // calls)
    for k in range(0, len(choices), step):
        now = choices[k : k + step]
        said = spark.createDataFrame(now, "escalation_id string, choice string, reject boolean, at long")
        done = decisions.resolve(e, said, r)
        want = sequential(escalations, now, excluded)
        assert sorted(x["escalation_id"] for x in done.collect()) == sorted(want)
        e, r = decisions.close(e, done), decisions.apply(r, done, CONFIG)
        e, r = (spark.createDataFrame(x.collect(), x.schema) for x in (e, r))
        assert {x["escalation_id"]: x["status"] for x in e.collect()} == {k: s for k, (*_, s) in escalations.items()}
        assert {x["record_id"]: x["excluded"] for x in r.collect()} == excluded


def test_a_rejection_of_an_earlier_call_counts(spark):
    """Three escalations of one record; the first is rejected in one call, the second accepted in another."""
    escalations = {f"e{i}": ("r0", "fgh"[i], {"a": ("accept_value", "r0", None)}, "open") for i in range(3)}
    excluded = {"r0": False}
    e, r = frames(spark, escalations, excluded)
    say = lambda *x: spark.createDataFrame([x], "escalation_id string, choice string, reject boolean, at long")
    for said in (say("e0", None, True, 1), say("e1", "a", False, 2)):
        done = decisions.resolve(e, said, r)
        e, r = decisions.close(e, done), decisions.apply(r, done, CONFIG)
    assert {x["escalation_id"]: x["status"] for x in e.collect()} == {"e0": "rejected", "e1": "resolved", "e2": "resolved"}


@pytest.mark.parametrize("name", ["resolve_decisions", "close_related"])
def test_queries_on_a_larger_table(spark, name):
    """At ten times the smallest tables decisions from outside meet records that have others."""
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"create view orders as select * from '{sf}/orders.parquet'")
    df = catalogue.queries()[name](spark, sf)
    names = sorted(df.columns)
    rel = duck.sql(catalogue.oracle_sql()[name])
    want = sorted(repr([plain(dict(zip(rel.columns, r))[c]) for c in names]) for r in rel.fetchall())
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == want


def test_orders_against_a_sequential_fold(spark):
    """The query's own orders and decisions, folded one by one."""
    sf = "/root/testdata/sf0.01"
    e, d = catalogue._decided(spark, sf)
    escalations = {}
    for r in e.collect():
        opts = {o["id"]: (o["apply"]["type"], o["apply"]["keep_id"] or o["apply"]["record_id"], o["apply"]["drop_id"]) for o in r["options"]}
        escalations[r["escalation_id"]] = [r["record_id"], r["field"], opts, r["status"]]
    by_record = {}
    for k, (r, *_) in escalations.items():
        by_record.setdefault(r, []).append(k)
    out, counted = set(), 0
    for r in sorted(d.collect(), key=lambda r: (r["at"], r["escalation_id"])):
        own = escalations[r["escalation_id"]]
        if own[3] != "open":
            continue
        counted += 1
        if r["reject"]:
            own[3] = "rejected"
            out.add(own[0])
            continue
        kind, first, drop = own[2].get(r["choice"]) or own[2]["act"]
        if kind in ("exclude_record", "merge_records"):
            out.add(drop if kind == "merge_records" else first)
        own[3] = "resolved"
        if own[0] is not None:
            for k in by_record[own[0]]:
                other = escalations[k]
                if other[3] == "open" and (other[1] == own[1] or own[0] in out):
                    other[3] = "resolved"
    done = decisions.resolve(e, d)
    assert done.count() == counted
    assert {r["escalation_id"]: r["status"] for r in decisions.close(e, done).collect()} == {k: v[3] for k, v in escalations.items()}
